"""Every detector below and at its boundary, scanned in one job; spans, masks, places and suppression on small texts."""

import pytest
from pyspark.sql import functions as F

from prosescan.config import Rules, Thresholds, parse_dictionary
from prosescan.operators import crossdoc, locate, suppress
from prosescan.operators.segment import Segments
from prosescan.plans.engine import Engine

#: name: text, rules that must be reported (exactly, unless the last entry is "...").
CASES = {
    "empty": ("", set()),
    "white space": (" \n\t\n ", set()),
    "phrase in any case": ("We should DELVE INTO the plan.", {"word_choice.delve"}),
    "longer phrase wins": ("It will fundamentally reshape it.", {"tone.grandiose_stakes"}),
    "consumed phrase": ("Please note that it works.", {"composition.throat_clearing"}),
    "ascii folding only": ("A robuſt plan.", set()),
    "phrase in a fence": ("Text.\n```\ndelve into\n```\n", set()),
    "phrase after an unclosed fence": ("Text.\n~~~\ndelve into\n", set()),
    "phrase in front matter": ("---\ntitle: delve into\n---\nText here.\n", set()),
    "unclosed front matter": ("---\ntitle: delve into\nText here.\n", {"word_choice.delve"}),
    "two dashes": ("One — two — three.", set()),
    "three dense dashes": ("One — two — three — four.", {"formatting.em_dash_addiction"}),
    "five dashes in a long text": ("word " * 300 + "a — b — c — d — e — f", set()),
    "six dashes in a long text": ("word " * 400 + "a — b — c — d — e — f — g", {"formatting.em_dash_addiction"}),
    "number ranges": ("Pages 1–2, 3–4, 5–6, 7–8–9.", set()),
    "spaced double hyphens": ("a -- b -- c -- d, but x--y --z", {"formatting.em_dash_addiction"}),
    "three arrows": ("a → b ← c ⇒ d", {"formatting.unicode_decoration"}),
    "arrows apart": ("a → b ← c\n\nd ⇒ e", set()),
    "three bold leads": ("- **A** x\n- **B** y\n  wrapped\n\n__C__ z\n", {"formatting.bold_first_leads"}),
    "a heading between": ("- **A** x\n- **B** y\n# H\n- **C** z\n", set()),
    "bold without content": ("**** a\n\n**** b\n\n**** c\n", set()),
    "anaphora": ("We built walls for years here. We built roads for years there. We built homes for years again.", {"sentence_structure.anaphora_abuse"}),
    "anaphora in a list": ("- We built it for a long time.\n- We built it for a short time.\n- We built it for a year now.", set()),
    "tricolon": ("They came for years, they saw for years, they stayed for years.", {"sentence_structure.tricolon_abuse"}),
    "one echo": ("They came for years, they saw for years, we stayed for years.", set()),
    "fragments": ("No. Never. Not at all.", {"paragraph_structure.short_punchy_fragments"}),
    "two fragments": ("No. Never. But this one is quite a bit longer.", set()),
    "indented under a list": ("- item\n  No. Never. Not now.\n", set()),
    "listicle": ("The first is long.\n\nOther words stand here.\n\nThe second is long.\n\nThe third is long.", {"paragraph_structure.listicle_in_trench_coat"}),
    "summaries": ("In this section we go.\n\nAs we've seen it goes.\n\nAs we have seen it went.", {"composition.fractal_summaries"}),
    "companies": ("Apple grew over the long years. Laws changed over the long years. Cobwebs grew over the long years.", {"composition.historical_analogy_stacking"}),
    "five walls": ("A wall, one wall, that wall, my wall and his wall stood.", {"composition.dead_metaphor"}),
    "four walls": ("A wall, one wall, that wall and my wall stood; walls too.", set()),
    "dilution": ("Engines carry valleys.\n\nValleys carry engines there.\n\nEngines in valleys carry us.", {"composition.one_point_dilution"}),
    "copies": ("This sentence is just about long enough to count.\n\nthis sentence is, just about, long enough to count!", {"composition.content_duplication"}),
    "short copies": ("This one is short.\n\nThis one is short.", set()),
    "crlf": ("We built walls for years here.\r\nWe built roads for years there.\r\nWe built homes for years again.\r\n", {"sentence_structure.anaphora_abuse"}),
    "suppressed line": ("prosescan-ignore-next-line\nWe delve into it.\nWe delve into it.", {"word_choice.delve"}),
    "suppressed region": ("<!-- prosescan-ignore-start word_choice -- quoted -->\nWe delve into it.\n<!-- prosescan-ignore-end -->", set()),
    "another rule suppressed": ("prosescan-ignore-start tone\nWe delve into it.", {"word_choice.delve"}),
    "markers in a fence": ("```\nprosescan-ignore-start\n```\nWe delve into it.", {"word_choice.delve"}),
}


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame([(k, name, text) for k, (name, (text, _)) in enumerate(CASES.items())], "doc_ord long, name string, text string").cache()


@pytest.fixture(scope="module")
def found(cases):
    return Engine().scan_located(cases).collect()


def test_rules(found):
    got = {k: {r.rule_id for r in found if r.doc_ord == k} for k in range(len(CASES))}
    assert {name: got[k] for k, name in enumerate(CASES)} == {name: want for name, (_, want) in CASES.items()}


def test_spans_and_places(found):
    names = list(CASES)
    of = lambda name: [(r.start, r.end, r.matched, r.line, r.column, r.end_line, r.end_column) for r in found if r.doc_ord == names.index(name)]
    assert of("phrase in any case") == [(10, 20, "DELVE INTO", 1, 11, 1, 20)]
    assert of("three arrows") == [(2, 17, "→ ← ⇒", 1, 3, 1, 11)]
    assert of("suppressed line") == [(48, 58, "delve into", 3, 4, 3, 13)]
    assert of("crlf") == [(0, 96, CASES["crlf"][0].rstrip(), 1, 1, 3, 31)]
    assert of("copies")[0][0] == 0 and of("copies")[0][1] == len(CASES["copies"][0])


def test_masks_keep_bytes(cases):
    s = Segments(cases)
    assert s.masked.join(s.source, "doc_ord").where("octet_length(masked) <> octet_length(text)").count() == 0
    masked = {name: r.masked for name, r in zip(CASES, s.masked.orderBy("doc_ord").collect(), strict=True)}
    assert "delve" not in masked["phrase in a fence"] and masked["unclosed front matter"] == CASES["unclosed front matter"][0]


def test_segments(spark):
    text = "Hello there. \"no.\" Then? Yes!\nNext line  goes. end\n\n\n  # Head\n   hangs\n\n    still under\nfree again"
    s = Segments(spark.createDataFrame([(0, "x", text)], "doc_ord long, name string, text string"))
    assert [r.text for r in s.sentences.orderBy("start").collect()] == ["Hello there.", '"no." Then?', "Yes!", "Next line  goes.", "end", "free again"]
    assert [r.text for r in s.paragraphs.orderBy("start").collect()] == [text.split("\n\n\n")[0], "# Head\n   hangs", "still under\nfree again"]
    assert all(text.encode()[r.start : r.end].decode() == r.text for r in s.sentences.collect() + s.paragraphs.collect())


def test_thresholds_are_clamped_and_tuned(spark):
    zero = Thresholds({"formatting": {"em_dash_addiction": {"floor": 0, "count": 0, "rate_per_hundred_words": 0}}, "sentence_structure.anaphora_abuse": {"min_sentences": 0}})
    df = spark.createDataFrame([(0, "a", "Plain prose stands here. It says one thing."), (1, "b", "We go home. We go out.")], "doc_ord long, name string, text string")
    got = Engine(Rules(thresholds=zero)).scan(df).collect()
    assert {(r.doc_ord, r.rule_id) for r in got} == {(1, "sentence_structure.anaphora_abuse")}


def test_dialect(spark):
    text = "The COLOUR of Grey colorant behaviours, and color_ organise."
    df = spark.createDataFrame([(0, "a", text)], "doc_ord long, name string, text string")
    american = Engine(Rules(dialect="american")).scan(df).orderBy("start").collect()
    assert [(r.matched, r.expected) for r in american] == [("COLOUR", "COLOR"), ("Grey", "Gray"), ("behaviours", "behaviors"), ("organise", "organize")]
    assert [(r.matched, r.expected) for r in Engine(Rules(dialect="british")).scan(df).collect()] == [("color", "colour")]


def test_own_patterns(spark):
    rules = Rules.of(parse_dictionary('allow = ["ROBUST"]\n[[patterns]]\nid = "own.rule"\nname = "Own"\nseverity = "high"\nphrases = ["Delve"]\n'))
    df = spark.createDataFrame([(0, "a", "A robust plan to delve into.")], "doc_ord long, name string, text string")
    assert [(r.rule_id, r.severity, r.matched) for r in Engine(rules).scan(df).collect()] == [("own.rule", "high", "delve")]


def test_unknown_rules(spark):
    df = spark.createDataFrame([(0, "a", "x\nprosescan-ignore-start tone because, no.rule -->\n```\nprosescan-ignore-next-line word_choice.delv\n```\nz")], "doc_ord long, name string, text string")
    assert [(r.marker_start, r.rule) for r in suppress.unknown_rules(df, Rules().rule_ids).orderBy("marker_start", "at").collect()] == [(2, "because"), (2, "no.rule"), (55, "word_choice.delv")]


def test_span_groups(spark, cases):
    found = [(0, 1, 5, 2, 0, "b"), (0, 1, 5, 1, 3, "c"), (0, 1, 5, 1, 0, "d"), (0, 1, 6, 0, 0, "a"), (1, 1, 5, 0, 0, "a")]
    got = locate.span_groups(spark.createDataFrame(found, "doc_ord long, start long, end long, det int, seq int, rule_id string")).collect()
    assert sorted((r.doc_ord, r.start, r.end, r.n, r.rule_ids) for r in got) == [(0, 1, 5, 3, "d,c,b"), (0, 1, 6, 1, "a"), (1, 1, 5, 1, "a")]
    scanned = Engine().scan(cases)
    assert locate.span_groups(scanned).agg(F.sum("n")).first()[0] == scanned.count()


def runs(texts, n, files):
    """Shared runs by plain loops: (words, documents)."""
    words = [t.lower().split() for t in texts]
    at: dict = {}
    for d, w in enumerate(words):
        for k in range(len(w) - n + 1):
            at.setdefault(tuple(w[k : k + n]), []).append((d, k))
    out = []
    for places in at.values():
        if len(places) < 2 or len({d for d, _ in places}) < files:
            continue
        before = {words[d][k - 1] if k else None for d, k in places}
        if len(before) == 1 and None not in before:
            continue
        size = n
        while len({words[d][k + size] if k + size < len(words[d]) else (d, k) for d, k in places}) == 1:
            size += 1
        out += [(" ".join(words[places[0][0]][places[0][1] : places[0][1] + size]), d) for d, _ in places]
    return sorted(out)


@pytest.mark.parametrize(("n", "files"), [(2, 2), (3, 3)])
def test_shared_runs_by_brute_force(spark, n, files):
    import random

    rng = random.Random(n)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(12)]
    df = spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_ord long, name string, text string")
    s = Segments(df)
    got = crossdoc.shared_runs(s, suppress.regions(s.texts), n, files).collect()
    assert sorted((r.matched, r.doc_ord) for r in got) == runs(texts, n, files)


def test_shared_runs_in_parts_with_equal_codes(spark, monkeypatch):
    """Many parts and ranges; every window has one code, so that only words tell groups; few words are looked at first."""
    import random

    rng = random.Random(5)
    texts = [" ".join(rng.choice(("a", "B", "it's", "http://x.y/é-Z")) for _ in range(rng.randint(0, 30))) for _ in range(30)]
    texts += [" ".join(f"w{k}" for k in range(40))] * 3
    df = spark.createDataFrame([(k, f"d{k}", t) for k, t in enumerate(texts)], "doc_ord long, name string, text string")
    starts = crossdoc.start_places
    monkeypatch.setattr(crossdoc, "start_places", lambda *x: starts(*x).withColumn("h", F.lit(0).cast("long")))
    monkeypatch.setattr(crossdoc, "PART_BYTES", 400)
    monkeypatch.setattr(crossdoc, "RANGE_BYTES", 900)
    monkeypatch.setattr(crossdoc, "LOOKS", (2, 5, None))
    s = Segments(df)
    got = crossdoc.shared_runs(s, suppress.regions(s.texts), 3, 2).collect()
    assert sorted((r.matched.lower(), r.doc_ord) for r in got) == runs(texts, 3, 2)


def test_shared_runs_shuffle_no_windows(spark):
    """What is shuffled stays under 30 MB at sf0.01, where windows with their words took 49."""
    from prosescan.plans import catalog

    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite() / 1e6
    before = shuffled()
    assert catalog.QUERIES["shared_runs"](spark, "/root/testdata/sf0.01").count() == 13306
    assert shuffled() - before < 30


def test_links_are_words(spark):
    df = spark.createDataFrame([(0, "a", "See https://a.b/c?d=e now, xhttp://f.g too yhttps://! end")], "doc_ord long, name string, text string")
    text = df.first().text
    (row,) = crossdoc.cross_words(Segments(df).texts).select("words", F.transform(F.sequence(F.lit(0), F.size("words") - 1), crossdoc.start_of).alias("starts"), "spans").collect()
    assert row.words == ["see", "https://a.b/c?d=e", "now", "xhttp", "http://f.g", "too", "yhttps", "end"]
    assert [text[a : a + s.size].lower() for a, s in zip(row.starts, row.spans, strict=True)] == row.words
