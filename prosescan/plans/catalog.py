"""Named queries over the driver's tables and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.config import Rules, Thresholds, parse_dictionary
from prosescan.functions.text import words
from prosescan.operators import crossdoc, detect, locate, suppress
from prosescan.operators.segment import Segments
from prosescan.plans import oracles as o
from prosescan.plans.corpora import seeded
from prosescan.plans.engine import Engine, at_least
from prosescan.sources.documents import from_conversations, from_pages, from_table

RULES = Rules()
FINDING = ["doc_ord", "rule_id", "start", "end", "matched", "expected"]
_FINDING_SQL = 'doc_ord, rule_id, start, "end", matched, expected'

#: Redefines one pattern, allows two phrases and adds a pattern that wins overlaps.
OVERRIDES = """
allow = ["Robust", "in the heart of"]
[[patterns]]
id = "word_choice.delve"
name = "Own delve"
severity = "low"
phrases = ["delve", "leverage it"]
[[patterns]]
id = "house.style"
name = "House style"
severity = "high"
phrases = ["a robust", "we say"]
"""


def _segments(run: Callable[[Segments], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(Segments(seeded(spark, sf_dir)))


def _detector(detector) -> Callable[[SparkSession, str], DataFrame]:
    return _segments(lambda s: detector(s, RULES.thresholds).select(*FINDING))


def _phrases(s: Segments) -> DataFrame:
    return detect.phrases(s, RULES.patterns)


def word_counts(s: Segments) -> DataFrame:
    return s.masked.select("doc_ord", F.size(words(F.col("masked"))).cast("long").alias("n_words"), F.octet_length("masked").cast("long").alias("n_bytes"))


def severity_rollup(s: Segments) -> DataFrame:
    table = Engine().rule_table(s.texts.sparkSession)
    return _phrases(s).join(F.broadcast(table), "rule_id").groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("doc_ord").alias("n_docs"), F.count_distinct("rule_id").alias("n_rules"))


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().scan(seeded(spark, sf_dir)).select("doc_ord", "rule_id", "rule_name", "severity", "kind", "matched", "start", "end")


def located_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().scan_located(seeded(spark, sf_dir)).select("doc_ord", "rule_id", "start", "end", "line", "column")


def placed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of every finding, and its rank in its document's report."""
    found = locate.numbered_findings(Engine().scan_located(seeded(spark, sf_dir)))
    return found.select("doc_ord", "rule_id", "start", "end", "line", "column", "end_line", "end_column", F.col("place").cast("long").alias("place"))


def all_findings_american(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(Rules(dialect="american")).scan(seeded(spark, sf_dir)).select("doc_ord", "rule_id", "severity", "matched", "expected", "start", "end")


TUNED = Thresholds({"composition": {"fractal_summaries": {"min_openings": 2}, "dead_metaphor": {"min_repeats": 2}}, "paragraph_structure.listicle_in_trench_coat": {"min_paragraphs": 2}})


def tuned_findings(s: Segments) -> DataFrame:
    return detect.fractal(s, TUNED).unionByName(detect.dead_metaphor(s, TUNED)).unionByName(detect.listicle(s, TUNED)).select(*FINDING)


def severe_phrases(s: Segments) -> DataFrame:
    named = _phrases(s).join(F.broadcast(Engine().rule_table(s.texts.sparkSession)), "rule_id")
    return at_least(named, "medium").groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


def _read(name: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_ngrams(s: Segments) -> DataFrame:
    grams = crossdoc.windows(crossdoc.cross_words(s.texts), RULES.thresholds("shared", "min_words"))
    return crossdoc.shared_starts(grams, RULES.thresholds("shared", "min_files")).select("run", "n", "first_doc", "first_w")


def shared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine().scan_shared(seeded(spark, sf_dir))


def dictionary_overrides(s: Segments) -> DataFrame:
    return detect.phrases(s, Rules.of(parse_dictionary(OVERRIDES)).patterns).groupBy("rule_id", F.translate("matched", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("phrase")).agg(F.count("*").alias("n"))


def _overrides_sql() -> str:
    rows = [(x.translate(str.maketrans(o.UPPER, o.LOWER)), p.id) for p in Rules.of(parse_dictionary(OVERRIDES)).patterns for x in p.phrases]
    found = o.matches("found", "masked", "doc_ord", o.low("masked"), o.either([x for x, _ in rows]))
    table = ", ".join(f"({o.q(x)}, {o.q(r)})" for x, r in rows)
    return o.sql(found, f"phrases(phrase, rule_id) as (values {table})", select="select rule_id, phrase, count(*) as n from found join phrases on phrase = m group by all")


def _rules_text(column: str = "rules"):
    return F.array_join(column, ",")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "masked": _segments(lambda s: s.masked),
    "lines": _segments(lambda s: s.lines.select("doc_ord", "line_no", "start", "end", "line", "blank", "structure", "prose", "indented")),
    "paragraphs": _segments(lambda s: s.paragraphs),
    "prose_blocks": _segments(lambda s: s.prose_blocks.select("doc_ord", "start", "end", "text")),
    "sentences": _segments(lambda s: s.sentences.select("doc_ord", "block", "sent_ix", "start", "end", "text", F.size("words").cast("long").alias("n_words"))),
    "markdown_blocks": _segments(lambda s: s.markdown_blocks),
    "word_counts": _segments(word_counts),
    "phrase_findings": _segments(lambda s: _phrases(s).select(*FINDING)),
    "phrase_counts_by_rule": _segments(lambda s: _phrases(s).groupBy("rule_id").agg(F.count("*").alias("n"), F.count_distinct("doc_ord").alias("n_docs"))),
    "phrase_severity_rollup": _segments(severity_rollup),
    **{d.__name__: _detector(d) for d in detect.DETECTORS},
    "top_terms": _segments(lambda s: detect.top_terms(s).select("doc_ord", "start", "end", "term", "n", F.col("place").cast("long").alias("place"))),
    "dialect_american": _segments(lambda s: detect.dialect(s, "american").select(*FINDING)),
    "dialect_british": _segments(lambda s: detect.dialect(s, "british").select(*FINDING)),
    "suppression_regions": _segments(lambda s: suppress.regions(s.texts).select("doc_ord", "start", "end", "marker_start", _rules_text().alias("rules"))),
    "suppressed_findings": _segments(lambda s: _phrases(s).select(*FINDING).exceptAll(suppress.unsuppressed(_phrases(s).select(*FINDING), suppress.regions(s.texts)))),
    "unknown_rules": _segments(lambda s: suppress.unknown_rules(s.source, RULES.rule_ids).select("doc_ord", "marker_start", "rule")),
    "all_findings": all_findings,
    "located_findings": located_findings,
    "span_groups": lambda spark, sf_dir: locate.span_groups(Engine().scan(seeded(spark, sf_dir))),
    "shared_ngrams": _segments(shared_ngrams),
    "shared_runs": shared_runs,
    "dictionary_overrides": _segments(dictionary_overrides),
    "placed_spans": placed_spans,
    "all_findings_american": all_findings_american,
    "tuned_findings": _segments(tuned_findings),
    "severe_phrases": _segments(severe_phrases),
    "table_documents": _read("documents", from_table),
    "conversation_documents": _read("conversations", from_conversations),
    "page_documents": _read("pages", from_pages),
}

_line, _column = o.at(o.upto("start"))
#: The part of the text before the last character of a finding.
_last = f"""left({o.upto('"end"')}, length({o.upto('"end"')}) - 1)"""
_end_line, _end_column = o.at(_last)
ORACLE_SQL: dict[str, str] = {
    "masked": o.sql(select="select doc_ord, masked from masked"),
    "lines": o.sql(o.LINES, select='select doc_ord, line_no, start, "end", line, blank, structure, prose, indented from lines'),
    "paragraphs": o.sql(o.PARAGRAPHS, select='select doc_ord, start, "end", text from paragraphs'),
    "prose_blocks": o.sql(o.LINES, o.BLOCKS, select='select doc_ord, start, "end", text from prose_blocks'),
    "sentences": o.sql(o.LINES, o.BLOCKS, select='select doc_ord, block, sent_ix, start, "end", text, len(words) as n_words from sentences'),
    "markdown_blocks": o.sql(o.LINES, o.MARKDOWN, select='select doc_ord, start, "end", opens_bold from markdown_blocks'),
    "word_counts": o.sql(select=f"select doc_ord, len(regexp_extract_all(masked, {o.q(o.WORD)})) as n_words, strlen(masked) as n_bytes from masked"),
    "phrase_findings": o.sql(o.PHRASES, select=f"select {_FINDING_SQL} from phrase_findings"),
    "phrase_counts_by_rule": o.sql(o.PHRASES, select="select rule_id, count(*) as n, count(distinct doc_ord) as n_docs from phrase_findings group by rule_id"),
    "phrase_severity_rollup": o.sql(o.PHRASES, select="select severity, count(*) as n, count(distinct doc_ord) as n_docs, count(distinct rule_id) as n_rules from phrase_findings join (select distinct rule_id, severity from phrase_table) using (rule_id) group by severity"),
    "em_dash": o.sql(o.EM_DASH, select=f"select {_FINDING_SQL} from em_dash"),
    "decoration": o.sql(o.DECORATION, select=f"select {_FINDING_SQL} from decoration"),
    "bold_leads": o.sql(o.LINES, o.BOLD, select=f"select {_FINDING_SQL} from bold_leads"),
    **{n: o.sql(o.LINES, o.BLOCKS, t, select=f"select {_FINDING_SQL} from {n}") for n, t in (("anaphora", o.ANAPHORA), ("tricolon", o.TRICOLON), ("fragments", o.FRAGMENTS), ("analogy", o.ANALOGY), ("dup_sentences", o.DUP_SENTENCES))},
    **{n: o.sql(o.PARAGRAPHS, t, select=f"select {_FINDING_SQL} from {n}") for n, t in (("listicle", o.LISTICLE), ("fractal", o.FRACTAL), ("dilution", o.DILUTION), ("dup_paragraphs", o.DUP_PARAGRAPHS))},
    "dead_metaphor": o.sql(o.METAPHOR, select=f"select {_FINDING_SQL} from dead_metaphor"),
    "top_terms": o.sql(o.PARAGRAPHS, o.TOP, select='select doc_ord, start, "end", term, n, place from top_terms'),
    "dialect_american": o.sql(o.dialect("american"), select=f"select {_FINDING_SQL} from dialect"),
    "dialect_british": o.sql(o.dialect("british"), select=f"select {_FINDING_SQL} from dialect"),
    "suppression_regions": o.sql(o.regions("regions", "masked", "masked"), select="""select doc_ord, start, "end", marker_start, array_to_string(rules, ',') as rules from regions"""),
    "suppressed_findings": o.sql(o.PHRASES, o.regions("regions", "masked", "masked"), select=f"select {_FINDING_SQL} from phrase_findings f where exists (select 1 from regions r where {o.covered('f', 'r')})"),
    "unknown_rules": o.sql(o.regions("regions", "docs", "text"), select=f"""select doc_ord, marker_start, rule from (select doc_ord, marker_start, unnest(rules) as rule from regions)
      where not exists (select 1 from (values {", ".join(f"({o.q(r)})" for r in RULES.rule_ids)}) k(id) where id = rule or starts_with(id, rule || '.'))"""),
    "all_findings": o.sql(o.ALL, select='select doc_ord, rule_id, rule_name, severity, kind, matched, start, "end" from all_findings'),
    "located_findings": o.sql(o.ALL, select=f'select doc_ord, rule_id, start, "end", {_line} as line, {_column} as "column" from all_findings join docs using (doc_ord)'),
    "span_groups": o.sql(o.ALL, select="""select doc_ord, start, "end", count(*) as n, string_agg(rule_id, ',' order by det, seq, rule_id) as rule_ids from all_findings group by doc_ord, start, "end" """),
    "shared_ngrams": o.sql(o.SHARED, select="select run, n, first[1] as first_doc, first[2] as first_w from shared_ngrams"),
    "shared_runs": o.sql(o.regions("regions", "masked", "masked"), o.RUNS, select='select run_doc, run_start, rule_id, matched, doc_ord, start, "end" from kept join quoted using (run)'),
    "dictionary_overrides": _overrides_sql(),
    "placed_spans": o.sql(o.ALL, select=f"""select doc_ord, rule_id, start, "end", {_line} as line, {_column} as "column", {_end_line} as end_line, {_end_column} as end_column,
      row_number() over (partition by doc_ord order by start, "end", det, seq, rule_id) as place from all_findings join docs using (doc_ord)"""),
    "all_findings_american": o.sql(o.ALL_AMERICAN, select='select doc_ord, rule_id, severity, matched, expected, start, "end" from all_findings'),
    "tuned_findings": o.sql(o.PARAGRAPHS, o.fractal(2), o.metaphor(2), o.listicle(2), select=" union all ".join(f"select {_FINDING_SQL} from {n}" for n in ("fractal", "dead_metaphor", "listicle"))),
    "severe_phrases": o.sql(o.PHRASES, select="select rule_id, severity, count(*) as n from phrase_findings join (select distinct rule_id, severity from phrase_table) using (rule_id) where severity <> 'low' group by all"),
    "table_documents": "select doc_id as doc_ord, 'doc_id-' || doc_id as name, coalesce(text, '') as text from documents",
    "conversation_documents": "select conv_id as doc_ord, 'conv-' || conv_id as name, string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn, role, text) as text from conversations group by conv_id",
    "page_documents": r"""select page_id as doc_ord, url as name, regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '<[^>]*>', chr(10), 'g') as text from pages""",
}
