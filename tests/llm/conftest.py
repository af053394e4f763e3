import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, size string, rid int, taken string, score string, text_hash int"
BASE = "The quick brown fox jumps over the lazy dog while the small cat sleeps near the old stone wall and dreams of fish all day long"
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE, "en", "a"),
    (3, BASE + " again", "en", "b"),
    (4, None, None, None),
    (5, "", "en", ""),
    (6, "Écrivez à jean.dupont@mail.example.com ou +33 1 23 45 67 89, ip 10.0.0.255, carte 4111 1111 1111 1111.", "fr", "b"),
    (7, "one", "en", "c"),
    (8, "word " * 6000 + "end", "en", "a"),
    (9, "x" * 5000, "xx", "a"),
    (9, "x" * 5000, "xx", "a"),
    (10, "tab\tand\nline  two spaces <|endoftext|> <s> ▁   日本語 \x00 .", "en", None),
    (11, "You are an idiot, a moron and a loser!", "en", "c"),
    (None, "a row without an id", "en", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, "x", 2, "y", "z", 3) for i, t, lang, s in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
