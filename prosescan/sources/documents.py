"""Documents from files, standard input and tables, as (doc_ord, name, text)."""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosescan.errors import SourceError
from prosescan.sources.globs import Excludes

STDIN = "-"
SCHEMA = "doc_ord long, name string, text string"


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read from files, dealt out to all cores if its files give fewer splits than there are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def _uri(path: str) -> str:
    """A path with a scheme of its own (of any store that Spark reads) as it is, another one as a local file."""
    return path if "://" in path else Path(path).resolve().as_uri()


def from_files(spark: SparkSession, paths: list[str], excludes: Excludes | None = None) -> DataFrame:
    """Files named, whole, in the order given; excluded ones aren't read, so they may be missing. Any other failure is raised before
    there is output."""
    kept = [p for p in paths if not (excludes and excludes(p))]
    if missing := [p for p in kept if "://" not in p and not Path(p).is_file()]:
        raise SourceError(f"{missing[0]}: there is no such file")
    if not kept:
        return spark.createDataFrame([], SCHEMA)
    order = spark.createDataFrame([(i, p, _uri(p)) for i, p in enumerate(kept)], "doc_ord long, name string, uri string")
    files = spark.read.format("binaryFile").load(sorted({_uri(p) for p in kept})).select(F.regexp_replace("path", "^file:/+", "file:///").alias("uri"), "content")
    docs = order.join(files, "uri", "left").withColumn("fine", F.expr("content is not null and is_valid_utf8(cast(content as string))"))
    if bad := docs.where(~F.col("fine")).orderBy("doc_ord").select("name").first():
        raise SourceError(f"{bad.name}: this isn't UTF-8 text")
    return docs.select("doc_ord", "name", F.col("content").cast("string").alias("text"))


def from_text(spark: SparkSession, text: str, name: str = STDIN) -> DataFrame:
    return spark.createDataFrame([(0, name, text)], SCHEMA)


def from_stdin(spark: SparkSession) -> DataFrame:
    try:
        return from_text(spark, sys.stdin.buffer.read().decode("utf-8"))
    except UnicodeDecodeError as error:
        raise SourceError("standard input: this isn't UTF-8 text") from error


def from_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """A table's rows; its id orders them."""
    name = F.col(name_col) if name_col else F.concat(F.lit(f"{id_col}-"), F.col(id_col).cast("string"))
    return df.select(F.col(id_col).cast("long").alias("doc_ord"), name.alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def from_conversations(df: DataFrame) -> DataFrame:
    """A document for each conversation: its turns in order, with blank lines between."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    text = F.array_join(F.transform(turns, lambda t: t.text), "\n\n")
    return df.groupBy("conv_id").agg(text.alias("text")).select(F.col("conv_id").cast("long").alias("doc_ord"), F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("name"), "text")


def from_pages(df: DataFrame) -> DataFrame:
    """A document for each page: its HTML without scripts, styles and tags."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    return df.select(F.col("page_id").cast("long").alias("doc_ord"), F.col("url").alias("name"), F.regexp_replace(bare, "<[^>]*>", "\n").alias("text"))
