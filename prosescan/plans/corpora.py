"""Corpora that hold every shape the detectors look for, as SQL that Spark and DuckDB read alike.

The driver's documents have no headings, lists, fences, dashes or phrases, so a query over them as they are would prove
little. ``SEEDED`` gives each document, by its id, some of these shapes around its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosescan.config import bundled_patterns
from prosescan.sources.documents import spread

NL = "chr(10)"


def _text(*parts: str) -> str:
    return "concat(" + ", ".join(parts) + ")"


def _lines(*lines: str) -> str:
    """A string literal of these lines, each ended by a line feed."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"replace({quote('~'.join((*lines, '')))}, '~', {NL})"


def _when(test: str, *lines: str) -> str:
    return f"case when {test} then {_lines(*lines)} else '' end"


_ALL = [x for p in bundled_patterns() for x in p.phrases]


def _phrase(number: str) -> str:
    return "split_part('{}', '~', cast({} + 1 as int))".format("~".join(_ALL).replace("'", "''"), number)


SEEDED = "select doc_id as doc_ord, concat('doc-', cast(doc_id as {string})) as name, " + _text(
    _when("doc_id % 5 = 0", "---", "title: a robust tapestry", "---"),
    f"case when doc_id % 2 = 0 then replace(text, {NL}, concat({NL}, {NL})) else text end",
    NL, NL,
    f"concat('We say ', {_phrase(f'(doc_id % {len(_ALL)})')}, ' and ', upper({_phrase(f'((doc_id * 7 + 3) % {len(_ALL)})')}), '.')",
    NL,
    _when("doc_id % 3 = 0", "", "- **Speed** is first", "  and goes on here", "- **Cost** is next.", "* __Care__ is last", "1. **Four** leads. **", "- **** no lead"),
    _when("doc_id % 4 = 0", "", "```text", "- **Hidden** — robust — “a” “b”", "We said so. We said so. We said so.", "```"),
    _when("doc_id % 4 = 1", "", "One — two – three -- four — five, pages 1–2–3 and a--b — done — so —."),
    _when("doc_id % 4 = 2", "", "“One” “two” ’three’ → four → five ← six"),
    _when("doc_id % 6 = 0", "", "First, we agree on this long plan.", "", "The second plan is weaker, as plans go.", "", "# Heading", "", "Third, there is nothing left to plan at all."),
    _when("doc_id % 6 = 1", "", "In this section colour is grey.", "", "As we've seen, the neighbours organise.", "", "To sum up: COLOUR, Colour, the theatre."),
    _when("doc_id % 6 = 2", "", "Apple did it. Then Stripe did it too! Did AWS follow? Laws say so. No."),
    _when("doc_id % 6 = 3", "", "We ran far, we ran fast, we ran on; they stood.", "It was a wall. A wall. Walls, wall, WALL; the door's wall, a wall."),
    _when("doc_id % 7 = 1", "", "Systems engines carry systems engines through valleys.", "", "Valleys engines carry systems engines through valleys again.", "", "Engines valleys carry systems valleys, engines, carry.", "", "Engines valleys carry systems valleys, engines, carry."),
    _when("doc_id % 7 = 2", "", "<!-- prosescan-ignore-start tone, word_choice.delve -- they are quoted -->", "A robust, breathtaking landscape — leverage it.", "<!-- prosescan-ignore-end -->", "A robust, breathtaking landscape."),
    _when("doc_id % 7 = 3", "", "prosescan-ignore-next-line", "Let's unpack this vibrant and robust plan.", "Let's unpack it."),
    _when("doc_id % 7 = 4", "", "prosescan-ignore-start no.such_rule because tone", "Nestled in the heart of a stunning plan.", "", "> quoted. quoted. quoted.", "   indented under it. yes. no.", "Café ﬁne. Über alles! Nein? Ja."),
    _when("doc_id % 11 = 0", "", "See https://example.org/a/b?c=d for the same seven shared words in all of these places today."),
    _when("doc_id % 11 = 1", "", "We know the same seven shared words in all of these places, xhttp://x.y too."),
    _when("doc_id % 13 = 0", "", "````", "never closed. never closed. never closed. — — —"),
) + " as text from documents"


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded corpus of the documents under sf_dir."""
    return spark.sql(SEEDED.format(string="string").replace("from documents", "from {docs}"), docs=spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))

