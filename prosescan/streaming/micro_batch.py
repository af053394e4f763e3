"""Scans of documents that arrive as a stream: every detector needs one document only, so a micro-batch gives what a batch gives.
What documents share needs the whole corpus and is a batch operation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from prosescan.plans.engine import Engine


def scan_stream(docs: DataFrame, engine: Engine, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands the located findings of each micro-batch to sink(findings, batch id). docs: doc_ord, name, text."""

    def batch(df: DataFrame, number: int) -> None:
        sink(engine.scan_located(df), number)

    return docs.writeStream.foreachBatch(batch)


def scan_stream_to_parquet(docs: DataFrame, engine: Engine, path: str, checkpoint: str) -> DataStreamWriter:
    """Findings to Parquet, a folder for each micro-batch, which a repeated batch overwrites: each finding is there once."""
    return scan_stream(docs, engine, lambda found, number: found.write.mode("overwrite").parquet(f"{path}/batch={number}")).option("checkpointLocation", checkpoint)
