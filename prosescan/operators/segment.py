"""Masking and segmentation. All offsets are bytes, half-open, in the masked text, whose byte length is the text's.

``documents`` have doc_ord, name, text; doc_ord is unique and not null (``numbered`` gives any rows such a number). ``Segments`` deals
masked texts by doc_ord once; every window and group below is by doc_ord and reads that one exchange. What needs no window reads
``masked``, which isn't shuffled.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.functions.stored import stored
from prosescan.functions.text import BLANK_LINES, LIST_ITEM, SPACE, lead, trim, trim_left, words


def _fence(line: Column) -> Column:
    """The run of backticks or tildes that opens the line, or an empty string."""
    return F.when(F.octet_length(lead(line)) <= 3, F.regexp_extract(trim_left(line), "^(`{3,}|~{3,})", 1)).otherwise("")


def mask(docs: DataFrame) -> DataFrame:
    """Adds masked: front matter and fenced blocks as spaces, line feeds kept."""
    lines = F.split("text", "\n", -1)
    closes = F.transform(F.slice(lines, 2, 2**31 - 2), lambda x: trim(x).isin("---", "..."))
    front = F.when(trim(F.get(lines, F.lit(0))) == "---", F.array_position(closes, True).cast("int")).otherwise(F.lit(0))
    front = F.when(front > 0, front).otherwise(-1)  # no front matter: fences may open on the first line
    # Only lines that look like fences enter the fold: (line, run, nothing after the run).
    runs = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), _fence(x).alias("run"), (trim(F.regexp_replace(trim_left(x), "^(`+|~+)", "")) == "").alias("bare"))), lambda m: F.length(m.run) > 0)
    start = F.struct(F.lit(-1).alias("open"), F.lit("").alias("run"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        closing = (F.substring(m.run, 1, 1) == F.substring(acc.run, 1, 1)) & (F.length(m.run) >= F.length(acc.run)) & m.bare
        ended = F.struct(F.lit(-1).alias("open"), F.lit("").alias("run"), F.array_append(acc.spans, F.struct(acc.open.alias("a"), m["at"].alias("b"))).alias("spans"))
        opened = F.struct(m["at"].alias("open"), m.run.alias("run"), acc.spans.alias("spans"))
        return F.when(acc.open >= 0, F.when(closing, ended).otherwise(acc)).otherwise(opened)

    fold = F.aggregate(F.filter(F.col("_runs"), lambda m: m["at"] > F.col("_front")), start, step)
    spans = F.when(F.col("_fold.open") >= 0, F.array_append(F.col("_fold.spans"), F.struct(F.col("_fold.open").alias("a"), F.lit(2**31 - 1).alias("b")))).otherwise(F.col("_fold.spans"))
    hidden = lambda i: ((F.col("_front") > 0) & (i <= F.col("_front"))) | F.exists(F.col("_spans"), lambda s: (i >= s.a) & (i <= s.b))
    masked = F.array_join(F.transform(lines, lambda x, i: F.when(hidden(i), F.repeat(F.lit(" "), F.octet_length(x))).otherwise(x)), "\n")
    may = F.col("text").rlike(rf"(?:^|\n)[{SPACE}]*(?:```|~~~)") | F.col("text").rlike(rf"^[{SPACE}]*---")
    # Called non-deterministic (it isn't: the id is never under 0), a column is computed once. Else the optimizer would put its whole
    # expression wherever it is named, into filters before the exchange and into each step of a fold.
    once = lambda x: F.when(F.monotonically_increasing_id() >= 0, x)
    marked = docs.withColumn("_front", once(F.when(may, front).otherwise(-1))).withColumn("_runs", once(F.when(may, runs)))
    folded = marked.withColumn("_fold", once(F.when(may, fold))).withColumn("_spans", once(spans))
    return folded.withColumn("masked", once(F.when(may, masked).otherwise(F.col("text")))).drop("_front", "_runs", "_fold", "_spans")


def placed(parts: DataFrame, of: list[str], order: str, length: Column, gap: Column | int = 0) -> DataFrame:
    """Adds start: the bytes of the parts (and gaps behind them) before each part."""
    before = Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start", F.coalesce(F.sum(length + gap).over(before), F.lit(0)).cast("long"))


def lines_of(docs: DataFrame, column: str) -> DataFrame:
    """doc_ord, line_no, start, end (without line feed), line. A text's last line feed begins no line."""
    parts = docs.select("doc_ord", F.posexplode(F.split(column, "\n", -1)).alias("line_no", "line"), F.octet_length(column).cast("long").alias("size"))
    out = placed(parts, ["doc_ord"], "line_no", F.octet_length("line"), 1)
    return out.where((F.col("start") < F.col("size"))).select("doc_ord", F.col("line_no").cast("long").alias("line_no"), "start", (F.col("start") + F.octet_length("line")).alias("end"), "line")


def trimmed(df: DataFrame) -> DataFrame:
    """Trims text on both sides, moving start and end; drops what is only white space."""
    return df.withColumn("start", F.col("start") + F.octet_length(lead(F.col("text")))).withColumn("text", trim(F.col("text"))).where("text <> ''").withColumn("end", F.col("start") + F.octet_length("text"))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a doc_ord of its own for each row, for tables whose ids are null or repeat."""
    return docs.withColumn("doc_ord", F.monotonically_increasing_id())


class Segments:
    """Segments of documents."""

    def __init__(self, docs: DataFrame):
        #: doc_ord and the text as it is.
        self.source = docs.select(F.col("doc_ord").cast("long").alias("doc_ord"), F.coalesce("text", F.lit("")).alias("text"))
        self.masked = mask(self.source).select("doc_ord", "masked")
        self.documents = self.masked.repartition("doc_ord")
        #: What detectors without windows read.
        self.texts = self.masked

    def stored(self) -> Segments:
        """The same segments written to the shared folder, for scans by many detectors: each reads the columns it needs, and no plan holds
        the segmentation of another."""
        self.masked = self.documents = self.texts = stored(self.masked, "masked")
        for name in ("lines", "paragraphs", "sentences"):  # the later ones are made of the earlier
            self.__dict__[name] = stored(getattr(self, name), name)
        return self

    @cached_property
    def lines(self) -> DataFrame:
        """Lines of the masked text with what they are: blank, item (list item), structure, prose, indented."""
        line, low = F.col("line"), trim_left(F.col("line"))
        item = low.rlike(LIST_ITEM)
        out = lines_of(self.documents, "masked").withColumn("blank", low == "").withColumn("item", item).withColumn("structure", ~F.col("blank") & (low.rlike(r"^[#|>]") | item))
        return out.withColumn("prose", ~F.col("blank") & ~F.col("structure")).withColumn("indented", F.octet_length(lead(line)) >= 2)

    @cached_property
    def paragraphs(self) -> DataFrame:
        """doc_ord, start, end, text: runs of lines that aren't blank, trimmed."""
        found = F.regexp_extract_all("masked", F.lit(BLANK_LINES), F.lit(0))
        parts = self.documents.select("doc_ord", F.posexplode(F.arrays_zip(F.split("masked", BLANK_LINES, -1).alias("text"), found.alias("gap"))).alias("at", "p")).select("doc_ord", "at", "p.text", "p.gap")
        return trimmed(placed(parts, ["doc_ord"], "at", F.octet_length("text") + F.coalesce(F.octet_length("gap"), F.lit(0)))).select("doc_ord", "start", "end", "text")

    @cached_property
    def prose_blocks(self) -> DataFrame:
        """doc_ord, block (start of its first line), start, end, text: runs of adjacent prose lines; an indented line under structure belongs to the structure."""
        w = Window.partitionBy("doc_ord").orderBy("line_no")
        decides = F.when(F.col("structure"), 1).when(F.col("prose") & ~F.col("indented"), 0)
        under = F.coalesce(F.last(decides, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
        flagged = self.lines.withColumn("own", F.col("prose") & ~(F.col("indented") & under))
        runs = flagged.withColumn("run", F.sum(F.when(F.col("own"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("own")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x.line), "\n")
        return trimmed(runs.groupBy("doc_ord", "run").agg(F.min("start").alias("start"), text.alias("text"))).select("doc_ord", F.col("start").alias("block"), "start", "end", "text")

    @cached_property
    def sentences(self) -> DataFrame:
        """doc_ord, block, sent_ix, start, end, text, words (ASCII runs in their own case)."""
        parts = self.prose_blocks.select("doc_ord", "block", F.posexplode(F.split("text", rf"(?<=[.!?])(?=[{SPACE}])", -1)).alias("at", "text"))
        out = placed(parts, ["doc_ord", "block"], "at", F.octet_length("text")).withColumn("start", F.col("start") + F.col("block"))
        w = Window.partitionBy("doc_ord", "block").orderBy("at")
        return trimmed(out).withColumn("sent_ix", (F.row_number().over(w) - 1).cast("long")).select("doc_ord", "block", "sent_ix", "start", "end", "text", words(F.col("text")).alias("words"))

    @cached_property
    def markdown_blocks(self) -> DataFrame:
        """doc_ord, start, end, opens_bold: list items, paragraphs and structure lines; prose lines go on with an open block."""
        w = Window.partitionBy("doc_ord").orderBy("line_no")
        low = trim_left(F.col("line"))
        body = trim_left(F.regexp_replace(low, LIST_ITEM, ""))
        bold = lambda x: (x.startswith("**") & (F.instr(F.substring(x, 3, 2**31 - 3), "**") > 1)) | (x.startswith("__") & (F.instr(F.substring(x, 3, 2**31 - 3), "__") > 1))
        # A prose line opens a block unless the line before is an item or prose (which then is in an open block).
        opened = F.coalesce(F.lag(F.col("item") | F.col("prose")).over(w), F.lit(False))
        kept = self.lines.withColumn("new", ~F.col("blank") & (F.col("structure") | ~opened))
        blocks = kept.withColumn("block", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("blank"))
        opens = F.when(F.col("new"), F.when(F.col("item"), bold(body)).when(F.col("prose"), bold(low)).otherwise(False))
        right = F.octet_length(F.regexp_replace("line", rf"[{SPACE}]+\z", ""))
        return blocks.withColumn("bold", opens).groupBy("doc_ord", "block").agg(F.min("start").alias("start"), F.max(F.col("start") + right).cast("long").alias("end"), F.bool_or("bold").alias("opens_bold")).select("doc_ord", "start", "end", "opens_bold")
