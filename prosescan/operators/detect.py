"""Detectors: segments and limits in, findings out, as (doc_ord, rule_id, start, end, matched, expected, det, seq).

det orders detectors as they report, seq the findings of one detector that start and end alike. Names, severities and kinds
of rules are joined once, in the engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.config import Pattern, Thresholds
from prosescan.dimensions import BUILTIN_RULES, COMPANIES, DEAD_METAPHORS, DECORATIONS, ORDINALS, STOP_WORDS, SUMMARIES, spellings
from prosescan.functions.text import LOWER, SPACE, UPPER, ascii_lower, reachable, starts_with_any, trie_regex, words
from prosescan.operators.segment import Segments, placed

FOLD = str.maketrans(UPPER, LOWER)
COLUMNS = ["doc_ord", "rule_id", "start", "end", "matched", "expected", "det", "seq"]


#: Put around matches. A text's own are taken as another control character of one byte, so offsets stay.
OPEN, CLOSE = "\x01", "\x02"


def found_in(text: Column, regex: str) -> Column:
    """The matches of regex in order, as (gap: bytes between it and the one before, m), in one pass over the text."""
    plain = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, "\x00\x00")).otherwise(text)
    parts = F.split(F.regexp_replace(plain, regex, f"{OPEN}$0{CLOSE}"), CLOSE, -1)
    return F.transform(F.filter(parts, lambda x: x.contains(OPEN)), lambda x: F.struct(F.octet_length(F.substring_index(x, OPEN, 1)).alias("gap"), F.substring_index(x, OPEN, -1).alias("m")))


def matches(docs: DataFrame, of: list[str], text: Column, regex: str, at_least: int = 1) -> DataFrame:
    """of, ix, start, end, matched: matches of regex in order, in rows that have enough of them. Rows carry no text but the match."""
    found = F.when(F.monotonically_increasing_id() >= 0, found_in(text, regex))  # computed once, as in mask
    rows = docs.select(*of, found.alias("found")).where(F.size("found") >= at_least).select(*of, F.posexplode("found").alias("ix", "x")).select(*of, "ix", "x.gap", "x.m")
    out = placed(rows, of, "ix", F.col("gap") + F.octet_length("m")).withColumn("start", F.col("start") + F.col("gap"))
    return out.select(*of, "ix", "start", (F.col("start") + F.octet_length("m")).alias("end"), F.col("m").alias("matched"))


def runs_in(docs: DataFrame, of: list[str], text: Column, regex: str, at_least: Column | int) -> DataFrame:
    """of, n, start, end, matched of all matches in a row together, in rows that have enough of them; no window and no shuffle."""
    rows = docs.withColumn("found", F.when(F.monotonically_increasing_id() >= 0, found_in(text, regex))).where(F.size("found") >= at_least)
    size = F.aggregate("found", F.lit(0), lambda n, x: n + x.gap + F.octet_length(x.m))
    return rows.select(*of, F.size("found").alias("n"), F.get("found", F.lit(0)).gap.cast("long").alias("start"), size.cast("long").alias("end"), F.array_join(F.transform("found", lambda x: x.m), " ").alias("matched"))


def findings(df: DataFrame, rule: str | None, det: int, seq: Column | int = 0) -> DataFrame:
    out = df if rule is None else df.withColumn("rule_id", F.lit(BUILTIN_RULES[rule][0]))
    if "expected" not in out.columns:
        out = out.withColumn("expected", F.lit(None).cast("string"))
    return out.withColumn("det", F.lit(det)).withColumn("seq", (F.lit(seq) if isinstance(seq, int) else seq).cast("long")).select(*COLUMNS)


def sliced(df: DataFrame, s: Segments) -> DataFrame:
    """Adds matched, sliced from the masked text by start and end. A document meets its findings once, as bytes."""
    keys = [c for c in df.columns if c != "doc_ord"]
    grouped = df.groupBy("doc_ord").agg(F.collect_list(F.struct(*keys)).alias("found"))
    raw = F.when(F.monotonically_increasing_id() >= 0, F.col("masked").cast("binary"))
    joined = grouped.join(s.documents, "doc_ord").select("doc_ord", "found", raw.alias("raw"))
    cut = lambda x: F.substring(F.col("raw"), (x.start + 1).cast("int"), (x.end - x.start).cast("int")).cast("string")
    return joined.select("doc_ord", F.explode(F.transform("found", lambda x: F.struct(x.alias("f"), cut(x).alias("matched")))).alias("x")).select("doc_ord", "x.f.*", "x.matched")


def phrases(s: Segments, patterns: tuple[Pattern, ...]) -> DataFrame:
    """All phrases of all patterns in one pass: leftmost, non-overlapping, the earlier phrase first, ASCII case aside. White space
    around a phrase is part of it."""
    low = lambda x: x.translate(FOLD)
    of = {low(x): p.id for p in reversed(patterns) for x in reversed(p.phrases)}
    ordered = [low(x) for p in patterns for x in p.phrases]
    if not ordered:
        return findings(s.texts.limit(0).selectExpr("doc_ord", "'' as rule_id", "0L as start", "0L as end", "masked as matched"), None, 0)
    dim = s.texts.sparkSession.createDataFrame(list(of.items()), "phrase string, rule_id string")
    found = matches(s.texts, ["doc_ord"], F.col("masked"), "(?i)" + trie_regex(reachable(ordered)))
    return findings(found.withColumn("phrase", ascii_lower(F.col("matched"))).join(F.broadcast(dim), "phrase"), None, 0)


DASHES = rf"—|(?<![0-9])–|–(?![0-9])|(?<![^{SPACE}])--(?![^{SPACE}])"


def em_dash(s: Segments, t: Thresholds) -> DataFrame:
    words_ = F.when(F.monotonically_increasing_id() >= 0, F.regexp_count("masked", F.lit("[A-Za-z0-9']+")).cast("long"))
    runs = runs_in(s.texts.where(F.col("masked").rlike("[—–]|--")), ["doc_ord", "masked"], F.col("masked"), DASHES, t("em_dash", "floor"))
    n, w = F.col("n"), F.col("n_words")
    dense = (w == 0) | (F.expr("n * 100 div greatest(n_words, 1)") >= t("em_dash", "rate_per_hundred_words"))
    return findings(runs.withColumn("n_words", words_).where((n >= t("em_dash", "count")) | dense), "em_dash", 1)


def decoration(s: Segments, t: Thresholds) -> DataFrame:
    out, own = None, s.paragraphs.withColumnRenamed("start", "p")
    for k, marks in enumerate(DECORATIONS):
        runs = runs_in(own, ["doc_ord", "p"], F.col("text"), f"[{marks}]", t("decoration", "min_occurrences"))
        one = findings(runs.withColumn("start", F.col("start") + F.col("p")).withColumn("end", F.col("end") + F.col("p")), "decoration", 2, k)
        out = one if out is None else out.unionByName(one)
    return out


def bold_leads(s: Segments, t: Thresholds) -> DataFrame:
    w = Window.partitionBy("doc_ord").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    runs = s.markdown_blocks.withColumn("run", F.sum(F.when(F.col("opens_bold"), 0).otherwise(1)).over(w)).where("opens_bold")
    long = runs.groupBy("doc_ord", "run").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("n") >= t("bold_leads", "min_leads"))
    return findings(sliced(long, s), "bold_leads", 3)


def anaphora(s: Segments, t: Thresholds) -> DataFrame:
    n = t("anaphora", "min_sentences")
    keyed = s.sentences.where(F.size("words") > 0).withColumn("key", ascii_lower(F.array_join(F.slice("words", 1, 2), " ")))
    w = Window.partitionBy("doc_ord", "block").orderBy("sent_ix")
    ahead = w.rowsBetween(0, n - 1)
    out = keyed.withColumn("n", F.count("*").over(ahead)).withColumn("low", F.min("key").over(ahead)).withColumn("high", F.max("key").over(ahead)).withColumn("end", F.max("end").over(ahead))
    return findings(sliced(out.where((F.col("n") == n) & (F.col("low") == F.col("high"))).select("doc_ord", "block", "start", "end"), s), "anaphora", 4, 0)


def tricolon(s: Segments, t: Thresholds) -> DataFrame:
    marks = F.length("text") - F.length(F.translate("text", ",;", ""))
    firsts = F.filter(F.transform(F.split("text", "[,;]", -1), lambda c: ascii_lower(F.regexp_extract(c, "[A-Za-z0-9']+", 0))), lambda w: w != "")
    same = F.size(F.filter(F.zip_with("firsts", F.slice("firsts", 2, 2**31 - 2), lambda a, b: a == b), lambda x: x))
    out = s.sentences.where(marks >= t("tricolon", "min_separators")).withColumn("firsts", firsts).where(same >= t("tricolon", "min_repeated_starts"))
    return findings(out.withColumn("matched", F.col("text")), "tricolon", 4, 1)


def fragments(s: Segments, t: Thresholds) -> DataFrame:
    w = Window.partitionBy("doc_ord", "block").orderBy("sent_ix").rowsBetween(Window.unboundedPreceding, 0)
    short = F.size("words") <= t("fragments", "max_words")
    runs = s.sentences.withColumn("short", short).withColumn("run", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(w)).where("short")
    long = runs.groupBy("doc_ord", "block", "run").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).where(F.col("n") >= t("fragments", "min_sentences"))
    return findings(sliced(long, s), "fragments", 4, 2)


def analogy(s: Segments, t: Thresholds) -> DataFrame:
    n = t("analogy", "min_sentences")
    ahead = Window.partitionBy("doc_ord", "block").orderBy("sent_ix").rowsBetween(0, n - 1)
    named = s.sentences.withColumn("hit", ascii_lower(F.col("text")).rlike("|".join(COMPANIES)).cast("int"))
    out = named.withColumn("hits", F.sum("hit").over(ahead)).withColumn("end", F.max("end").over(ahead)).where(F.col("hits") == n)
    return findings(sliced(out.select("doc_ord", "block", "start", "end"), s), "analogy", 4, 3)


def listicle(s: Segments, t: Thresholds) -> DataFrame:
    n = t("listicle", "min_paragraphs")
    w = Window.partitionBy("doc_ord").orderBy("start")
    hits = s.paragraphs.where(starts_with_any(F.col("text"), ORDINALS))
    return findings(sliced(hits.withColumn("end", F.lead("end", n - 1).over(w)).where(F.col("end").isNotNull()).select("doc_ord", "start", "end"), s), "listicle", 5)


def fractal(s: Segments, t: Thresholds) -> DataFrame:
    hits = s.paragraphs.where(starts_with_any(F.col("text"), SUMMARIES)).groupBy("doc_ord").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return findings(sliced(hits.where(F.col("n") >= t("fractal", "min_openings")), s), "fractal", 6)


def dead_metaphor(s: Segments, t: Thresholds) -> DataFrame:
    term = rf"(?i)(?<![A-Za-z0-9'])(?:{'|'.join(sorted(DEAD_METAPHORS, key=len, reverse=True))})(?![A-Za-z0-9'])"
    found = matches(s.texts, ["doc_ord"], F.col("masked"), term, t("dead_metaphor", "min_repeats"))
    runs = found.groupBy("doc_ord", ascii_lower(F.col("matched")).alias("term")).agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return findings(sliced(runs.where(F.col("n") >= t("dead_metaphor", "min_repeats")), s), "dead_metaphor", 7)


def top_terms(s: Segments, k: int = 5) -> DataFrame:
    """doc_ord, start, end, terms: the k most frequent long words of each paragraph, ties by word."""
    term = s.paragraphs.select("doc_ord", "start", "end", F.explode(words(ascii_lower(F.col("text")))).alias("term")).where((F.length("term") >= 5) & ~F.col("term").isin(STOP_WORDS))
    counted = term.groupBy("doc_ord", "start", "end", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_ord", "start", "end").orderBy(F.desc("n"), "term")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def dilution(s: Segments, t: Thresholds) -> DataFrame:
    least = t("dilution", "min_shared_terms")
    terms = top_terms(s).groupBy("doc_ord", "start", "end").agg(F.collect_set("term").alias("terms")).where(F.size("terms") >= least)
    w = Window.partitionBy("doc_ord").orderBy("start")
    shared = F.array_intersect(F.array_intersect("terms", F.lead("terms", 1).over(w)), F.lead("terms", 2).over(w))
    out = terms.withColumn("shared", F.size(shared)).withColumn("end", F.lead("end", 2).over(w)).where((F.col("shared") >= least) & F.col("end").isNotNull())
    return findings(sliced(out.select("doc_ord", "start", "end"), s), "dilution", 8)


def _copies(passages: DataFrame, s: Segments, least: int, det: int) -> DataFrame:
    keyed = passages.withColumn("key", ascii_lower(F.array_join("words", " "))).where(F.length("key") >= least)
    w = Window.partitionBy("doc_ord", "key")
    later = keyed.withColumn("first", F.min("start").over(w)).where(F.col("start") > F.col("first")).select("doc_ord", F.col("first").alias("start"), "end")
    return findings(sliced(later, s), "duplication", det)


def dup_paragraphs(s: Segments, t: Thresholds) -> DataFrame:
    return _copies(s.paragraphs.withColumn("words", words(F.col("text"))), s, t("duplication", "min_length"), 9)


def dup_sentences(s: Segments, t: Thresholds) -> DataFrame:
    return _copies(s.sentences, s, t("duplication", "min_length"), 10)


def dialect(s: Segments, wanted: str) -> DataFrame:
    """Spellings of the other dialect, as whole words, with the wanted spelling in the same case."""
    pairs = [(b, a) if wanted == "american" else (a, b) for a, b in spellings()]
    edge = r"[\p{IsAlphabetic}\p{N}]"
    forms = trie_regex(sorted((x for x, _ in pairs), key=lambda x: (-len(x), x)), ahead=False)
    first = "".join(sorted({x[0] for x, _ in pairs}))
    dim = s.texts.sparkSession.createDataFrame(pairs, "form string, form_expected string")
    # The first letter is looked at before what is behind it, as few places pass that test; the longest form that ends a word matches.
    found = matches(s.texts, ["doc_ord"], F.col("masked"), f"(?i)(?=[{first}])(?<!{edge}){forms}(?!{edge})").withColumn("form", ascii_lower(F.col("matched"))).join(F.broadcast(dim), "form")
    m, e = F.col("matched"), F.col("form_expected")
    first = F.substring(m, 1, 1)
    cased = F.when(m == F.upper(m), F.upper(e)).when(first == F.upper(first), F.concat(F.upper(F.substring(e, 1, 1)), F.substring(e, 2, 100))).otherwise(e)
    return findings(found.withColumn("expected", cased), "dialect", 11)


DETECTORS = (em_dash, decoration, bold_leads, anaphora, tricolon, fragments, analogy, listicle, fractal, dead_metaphor, dilution, dup_paragraphs, dup_sentences)
