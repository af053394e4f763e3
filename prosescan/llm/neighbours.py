"""Each document beside the next one in descending id order, without a global sort in one task.

Rows are ordered by descending id (nulls last), then by descending hash of the text (xxhash64), then by text. Ids alone are read
first and cut into ranges at approximate quantiles; an id (or null) that holds more rows than two ranges should is a range of its
own, cut further by the hash. Of each range the first row's id and hash and the bytes of its texts are noted. Then every row
goes to its range, and the first row of a range also goes to the range before as a guest, so each range holds the next
document of its last one. Neighbouring ranges are put together into partitions of about PART_BYTES, each under a key that
the hash partitioner sends there, so no partition gets more by chance. Partitions are sorted and streamed.

Scale: texts are shuffled once, ids once for the counts. The driver holds a few numbers per range, of which there are about
2 MAX_RANGES at most. Equal rows (id and text) are one key and stay in one range, however many there are: that range is sorted
(and spilled) by its task, not held by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text in a range, about (whichever is less); ranges, about; bytes of text in a partition, about.
ROWS, RANGE_BYTES, MAX_RANGES, PART_BYTES = 1000, 4_000_000, 20_000, 12_000_000


class Ranges:
    """Numbers of ranges, growing in the order of (id, hash), nulls first."""

    def __init__(self, cuts: list[int], hot: dict[int | None, int], share: int):
        own = {i for i in hot if i is not None}
        starts = {c for c in cuts if c not in own} | own | {i + 1 for i in own if i < (1 << 63) - 1}
        self.bounds = np.array(sorted(starts), np.int64)
        pieces = {i: -(-n // share) for i, n in hot.items()}
        #: Ranges of null ids, and of the ids from each bound to the next.
        self.pieces = np.array([pieces.get(None, 1), 1, *(pieces.get(b, 1) for b in self.bounds.tolist())], np.int64)
        self.first = np.cumsum(self.pieces) - self.pieces

    def __call__(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        at = np.searchsorted(self.bounds, np.asarray(ids.fill_null(0), np.int64), side="right") + 1
        at = np.where(np.asarray(ids.is_null()), 0, at)
        share = (np.asarray(hashes, np.int64).astype(np.float64) + 2.0**63) / 2.0**64
        return self.first[at] + np.minimum((share * self.pieces[at]).astype(np.int64), self.pieces[at] - 1)


def partition_keys(spark: SparkSession, parts: int) -> list[int]:
    """A key for each of parts hash partitions that the partitioner sends to it (a few may have none)."""
    keys = spark.range(32 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("id"))
    return sorted(r.id for r in keys.collect())


def in_descending_ranges(docs: DataFrame) -> DataFrame:
    """docs: doc_id long, text string. Rows (range, guest, doc_id, text), each range whole and in order within a partition:
    its own rows, and after them guests, the first of which is the next row."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    rows = max(1, min(ROWS, RANGE_BYTES * n // max(1, size)))
    parts = max(1, min(MAX_RANGES, n // rows))
    share = max(rows, -(-n // parts))
    cuts = []
    if parts > 1:
        cuts = sorted({c for c in docs.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []})
    hot = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > 2 * share).collect()}
    place = Ranges(cuts, hot, share)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(b.column(0), b.column(1)), pa.int64()), *b.columns], ["range", "doc_id", "hash", "bytes"])

    measured = keyed.select("doc_id", "hash", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(ranges, "range long, doc_id long, hash long, bytes long")
    noted = measured.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("first"), F.sum("bytes").alias("bytes")).orderBy("range").collect()
    firsts = {r.range: (r.first.doc_id, r.first.hash) for r in noted}
    before = {r.range: noted[(k + 1) % len(noted)].range for k, r in enumerate(noted)}  # the range of larger ids; after the first row comes the last's
    group, parts_of, held = 0, {}, 0
    for r in noted:
        if held and held + r.bytes > PART_BYTES:
            group, held = group + 1, 0
        parts_of[r.range], held = group, held + r.bytes
    keys = partition_keys(docs.sparkSession, group + 1)
    key_of = {r: keys[g % len(keys)] for r, g in parts_of.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, ids, hashes, texts = place(b.column(0), b.column(1)).tolist(), b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            guests: dict[int, int] = {}
            for k, (r, i, h) in enumerate(zip(own, ids, hashes, strict=True)):
                if firsts[r] == (i, h) and (r not in guests or texts[k].as_py() > texts[guests[r]].as_py()):
                    guests[r] = k
            yield packed(own, 0, b)
            if guests:
                yield packed([before[r] for r in guests], 1, b.take(pa.array(list(guests.values()))))

    def packed(to: list[int], guest: int, b: pa.RecordBatch) -> pa.RecordBatch:
        columns = [pa.array([key_of[r] for r in to], pa.int64()), pa.array(to, pa.int64()), pa.array([guest] * len(to), pa.int32()), *b.columns]
        return pa.RecordBatch.from_arrays(columns, ["key", "range", "guest", "doc_id", "hash", "text"])

    dealt = keyed.mapInArrow(deal, "key long, range long, guest int, doc_id long, hash long, text string")
    order = [F.col("range"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("hash").desc(), F.col("text").desc()]
    return dealt.repartition(group + 1, "key").sortWithinPartitions(*order).select("range", "guest", "doc_id", "text")
