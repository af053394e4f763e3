"""Dictionaries, discovery, globs, regular expressions: no Spark. Then files, reports, the command line, streams."""

import argparse
import io
import json
import random
import re

import pytest

from prosescan import report
from prosescan.cli import run
from prosescan.config import Rules, Thresholds, bundled_patterns, find_dictionary, parse_dictionary, validate, Pattern
from prosescan.dimensions import SOURCES, spellings
from prosescan.errors import DictionaryInvalid, DictionaryLoadError, ExcludeError, SourceError
from prosescan.functions.text import reachable, trie_regex
from prosescan.operators.segment import numbered
from prosescan.plans.engine import Engine, at_least
from prosescan.sources.documents import from_conversations, from_files, from_pages, from_table
from prosescan.sources.globs import Excludes, glob_regex
from prosescan.streaming.micro_batch import scan_stream_to_parquet


def test_bundled():
    patterns = bundled_patterns()
    assert len(patterns) == 42 and sum(len(p.phrases) for p in patterns) == 253
    assert {s for p in patterns for s in p.sources} == set(SOURCES)
    assert len(spellings()) == len(set(spellings())) == 230 and ("color", "colour") in spellings()


def test_trie_agrees_with_alternation():
    rng = random.Random(1)
    for _ in range(300):
        literals = list(dict.fromkeys("".join(rng.choice("ab.[-") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))))
        text = "".join(rng.choice("ab.[-") for _ in range(40))
        plain = "|".join(map(re.escape, literals))
        assert [m.span() for m in re.finditer(trie_regex(reachable(literals)), text)] == [m.span() for m in re.finditer(plain, text)]


@pytest.mark.parametrize("text", ["nonsense", "colour = 1", 'dialect = "scots"', '[[patterns]]\nid = "a"', '[thresholds."composition.dead_metaphor"]\nmin_repeats = -1', '[thresholds."composition.dead_metaphor"]\nother = 1'])
def test_bad_dictionaries(text):
    with pytest.raises(DictionaryLoadError):
        parse_dictionary(text)


@pytest.mark.parametrize(("patterns", "message"), [
    ([(" ", "n", ["x"])], "without an id"), ([("a", " ", ["x"])], "no name"), ([("a", "n", [])], "no phrases"),
    ([("a", "n", ["x"]), ("a", "m", ["y"])], "given twice"), ([("a", "n", [" "])], "white space only"), ([("a", "n", ["x"]), ("b", "n", [" X"])], "share the phrase"),
])
def test_validation(patterns, message):
    with pytest.raises(DictionaryInvalid, match=message):
        validate(tuple(Pattern(i, n, "low", tuple(p)) for i, n, p in patterns))


def test_thresholds():
    t = Thresholds({"composition": {"dead_metaphor": {"min_repeats": 9}, "other": {}}, "formatting.em_dash_addiction": {"count": 0}, "nothing": 3})
    assert t("dead_metaphor", "min_repeats") == 9 and t("em_dash", "count") == 2
    assert sorted(t.unknown) == ["composition.other", "nothing"]


def test_discovery(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "prosescan.toml").write_text("")
    assert find_dictionary(tmp_path / "a" / "b") is None
    (tmp_path / ".git").write_text("gitdir: elsewhere")
    assert find_dictionary(tmp_path / "a" / "b") == tmp_path / "prosescan.toml"
    (tmp_path / "a" / "prosescan.toml").write_text('allow = ["robust"]')
    assert Rules.resolve(start=tmp_path / "a" / "b").dictionary == str(tmp_path / "a" / "prosescan.toml")


@pytest.mark.parametrize(("glob", "path", "hit"), [("*.md", "a.md", True), ("*.md", "x/a.md", False), ("**/*.md", "x/y/a.md", True), ("docs/", "docs/x/y", True), ("a?c", "abc", True), ("[!a]b", "cb", True), ("{a,b}.txt", "b.txt", True), ("a.b", "axb", False)])
def test_globs(glob, path, hit):
    assert bool(re.match(glob_regex(glob), path)) == hit


def test_excludes(tmp_path):
    e = Excludes(tmp_path, ("gen/",))
    assert e(tmp_path / "gen" / "x.md") and not e("/elsewhere/gen/x.md") and not Excludes()("x")
    with pytest.raises(ExcludeError):
        Excludes(tmp_path, ("a{b",))


def scan(spark, tmp_path, inputs, **options):
    out, err = io.StringIO(), io.StringIO()
    args = argparse.Namespace(inputs=inputs, dictionary=None, dictionary_name=None, marker="prosescan", json=False, quiet=False)
    vars(args).update(options)
    code = run(args, spark, out, err)
    return code, out.getvalue(), err.getvalue()


def test_command_line(spark, tmp_path, monkeypatch):
    (tmp_path / ".git").mkdir()
    (tmp_path / "prosescan.toml").write_text('exclude = ["skip.md"]\n[thresholds]\n"no.rule" = 1\n')
    (tmp_path / "b.md").write_text("We built it fast.\nWe built it wrong.\nWe built it twice.\n")
    (tmp_path / "a.md").write_text("prosescan-ignore-next-line typo\nNothing of note stands here at all.\n")
    monkeypatch.chdir(tmp_path)
    code, out, err = scan(spark, tmp_path, ["b.md", "skip.md", "a.md"])
    assert code == 1 and out == (
        "⚠ medium struct sentence_structure.anaphora_abuse\n⚠ medium struct paragraph_structure.short_punchy_fragments\n"
        "  ├─ b.md:1:1-3:18\n  └─ We built it fast.\n     We built it wrong.\n     We built it twice.\n"
    )
    assert "thresholds for no.rule, which isn't a rule" in err and "a.md:1:1: typo isn't a rule" in err
    code, out, _ = scan(spark, tmp_path, ["b.md"], json=True)
    report = json.loads(out)
    assert report["version"] == 1 and [f["rule_id"] for f in report["findings"]] == ["sentence_structure.anaphora_abuse", "paragraph_structure.short_punchy_fragments"] and "cross_file" not in report
    code, out, err = scan(spark, tmp_path, ["a.md"])
    assert code == 0 and out == "" and "no findings" in err
    assert scan(spark, tmp_path, ["missing.md"])[0] == 2


def test_rows_of_json_and_colours(spark):
    docs = spark.createDataFrame([(3, "d3", "We delve into it, and robust it is.")], "doc_ord long, name string, text string")
    located = Engine().scan_located(docs)
    rows = report.json_rows(located, docs).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and json.loads(rows[0].json)["path"] == "d3" and json.loads(rows[0].json)["matched"] == "delve into"
    text = report.to_text(report.ordered(located, docs), [], colour=True)
    assert "\x1b[" in text and "\x1b[" not in report.to_text(report.ordered(located, docs), [])
    severe = at_least(located, "high")
    assert {r.severity for r in severe.collect()} <= {"high"} and at_least(located, "low").count() == located.count()


def test_rows_without_ids_are_numbered(spark):
    rows = spark.createDataFrame([(None, "a", "We delve into it."), (1, "b", "Robust."), (1, "c", "We delve into it.")], "doc_ord long, name string, text string")
    found = Engine().scan(numbered(rows)).collect()
    assert len({r.doc_ord for r in found}) == len(found) == 3


def test_files(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes("é\r\n".encode())
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    got = from_files(spark, [str(tmp_path / "x.txt"), str(tmp_path / "x.txt")]).orderBy("doc_ord").collect()
    assert [(r.doc_ord, r.text) for r in got] == [(0, "é\r\n"), (1, "é\r\n")]
    with pytest.raises(SourceError):
        from_files(spark, [str(tmp_path / "bad.txt")])


def test_tables(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    assert from_table(read("documents")).columns == from_pages(read("pages")).columns == from_conversations(read("conversations")).columns == ["doc_ord", "name", "text"]
    assert from_pages(read("pages")).where("text rlike '<[a-z]+>'").count() == 0


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"d{k}", "We delve into it.") for k in range(3)], "doc_ord long, name string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    query = scan_stream_to_parquet(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), Engine(), str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
