"""Approximate nearest neighbours by a hash-prefix forest: largest cosine, in double precision.

Each of TREES trees gives every vector a string of BITS sign bits of random projections; a tree is the sorted array of its
strings. A query descends in every tree to its longest-prefix match, whatever its length. From the greatest depth reached, all
trees ascend together, a bit at a time, and what shares that long a prefix with the query in any tree becomes a candidate, until
there are enough; then candidates are scored exactly.

Every task cuts the rows it reads into blocks and builds each block's forest, once; forests are written to the shared folder.
Queries are packed into sets, and each set meets each forest: a cell holds a few forests and gets the sets as a stream, so
forests are dealt out once per SETS_A_LANE sets, rows aren't shuffled before, and no task holds more than a cell's forests and one
set. Each block gives a query its k nearest ids, and the k nearest of all blocks are kept by a window that cuts before it shuffles.
How large a share of a block is enough is fitted on a bounded sample (SAMPLE rows): the least share of SHARES at which the forest
finds GOAL of the sample's true neighbours.

Defined cases: rows with null ids, null, empty or zero vectors, or null or non-finite components take no part;
vectors of each length have forests of their own and are answered among themselves; ties go to the smaller id; a row with
a query's own id is never its neighbour; an id is returned once to a query, with its best score, whether its rows are equal or
not; rows that share a divisible id are one query each, and the best of their answers are kept; fewer ids than k give all; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosescan.llm.common import tidied, written

TREES, BITS, SEED = 16, 64, 11
SAMPLE, SAMPLE_QUERIES, GOAL = 4096, 128, 0.95
SHARES = (0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
#: Rows of a block and queries of a set at most; blocks of a cell, about; sets that a copy of the forests serves, about.
BLOCK, QUERIES, BLOCKS_A_CELL, SETS_A_LANE = 8192, 512, 4, 64


class Forest:
    """Sorted arrays of strings. order and codes, where given, are those of a forest built before."""

    def __init__(self, unit: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED, built: tuple[np.ndarray, np.ndarray] | None = None):
        self.trees, self.bits = trees, bits
        self.planes = np.random.default_rng(seed).standard_normal((unit.shape[1], trees * bits)).astype(np.float32)
        if built is None:
            codes = self.strings(unit)
            order = np.argsort(codes, axis=0, kind="stable").T
            built = order, np.take_along_axis(codes.T, order, axis=1)
        self.order, self.sorted = built

    def strings(self, unit: np.ndarray) -> np.ndarray:
        out = np.zeros((len(unit), self.trees), np.uint64)
        bits = (unit.astype(np.float32) @ self.planes > 0).reshape(len(unit), self.trees, self.bits)
        for k in range(self.bits):
            out = (out << np.uint64(1)) | bits[:, :, k].astype(np.uint64)
        return out

    def reached(self, codes: np.ndarray) -> np.ndarray:
        """The longest prefix that each query shares with a string of any tree: with one of its two neighbours in order."""
        out, n = np.zeros(len(codes), np.int64), self.sorted.shape[1]
        for t in range(self.trees if n else 0):
            at = np.searchsorted(self.sorted[t], codes[:, t])
            for near in (np.maximum(at - 1, 0), np.minimum(at, n - 1)):
                apart = self.sorted[t][near] ^ codes[:, t]
                out = np.maximum(out, self.bits - _bit_length(apart))
        return out

    def ranges(self, t: int, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings of a tree lie that share the first depth bits with the queries."""
        if depth == 0:
            return np.zeros(len(codes), np.int64), np.full(len(codes), self.sorted.shape[1])
        rest = np.uint64((1 << (self.bits - depth)) - 1)
        return np.searchsorted(self.sorted[t], codes & ~rest, "left"), np.searchsorted(self.sorted[t], codes | rest, "right")

    def candidates(self, unit: np.ndarray, enough: int) -> np.ndarray:
        """For each query (row) the rows (columns) that share long enough a prefix with it, at least enough of them (or all)."""
        codes, n = self.strings(unit), self.sorted.shape[1]
        seen, reached = np.zeros((len(unit), n), bool), self.reached(codes)
        open_, few = np.ones(len(unit), bool), np.ones(len(unit), bool)
        for depth in range(int(reached.max(initial=0)), -1, -1):
            active = np.flatnonzero(open_ & (reached >= depth))
            if not len(active):
                continue
            a, b = (np.stack(x, 1) for x in zip(*(self.ranges(t, codes[active, t], depth) for t in range(self.trees)), strict=True))
            few[active] = (b - a).sum(1) < min(enough, n)  # what lies deeper is among what lies here, so fewer needn't be marked yet
            for q, low, high in zip(active.tolist(), a.tolist(), b.tolist(), strict=True):
                if few[q] and depth:
                    continue
                for t, (x, y) in enumerate(zip(low, high, strict=True)):
                    if y > x:
                        seen[q, self.order[t, x:y]] = True
                open_[q] = depth > 0 and np.count_nonzero(seen[q]) < enough
        return seen


def _bit_length(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for shift in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(shift) > 0
        out += np.where(big, shift, 0)
        x = np.where(big, x >> np.uint64(shift), x)
    return out + (x > 0)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Vectors with components about 1, through powers of two, which change no cosine, so that no square over- or underflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None]) if len(rows) else rows


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(1))


def nearest(forest: Forest, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, share: float, k: int):
    """(query, id, score) of the k nearest ids among the candidates of every query. rows, queries: scaled vectors."""
    enough = int(np.ceil(share * len(rows))) + 1
    norm, q_norm = norms(rows), norms(queries)
    q_unit = queries / q_norm[:, None]
    close = q_unit @ (rows / norm[:, None]).T
    close[query_ids[:, None] == ids[None, :]] = -np.inf
    rough = np.where(forest.candidates(q_unit, enough), close, -np.inf)
    for q in range(len(queries)):
        if len(np.unique(ids[rough[q] > -np.inf][: 64 * k])) < k and len(np.unique(ids[rough[q] > -np.inf])) < k:
            rough[q] = close[q]  # too few ids among the candidates: all rows are
        wanted = k
        while True:  # as many of the best rows as hold k ids
            at = np.arange(len(ids)) if wanted >= len(ids) else np.flatnonzero(rough[q] >= np.partition(rough[q], -wanted)[-wanted] - 1e-9)
            at = at[rough[q, at] > -np.inf]
            if wanted >= len(ids) or len(np.unique(ids[at])) >= k:
                break
            wanted *= 4
        score = (rows[at] * queries[q]).sum(1) / (norm[at] * q_norm[q])
        order = np.lexsort((-score, ids[at]))  # the best row of each id
        order = order[np.flatnonzero(np.append(True, ids[at][order][1:] != ids[at][order][:-1]))] if len(at) else order
        for x in order[np.lexsort((ids[at][order], -score[order]))][:k]:
            yield int(query_ids[q]), int(ids[at[x]]), float(score[x])


def fitted_share(sample: np.ndarray, ids: np.ndarray, k: int, goal: float = GOAL) -> float:
    """The least share of a block at which the forest finds the goal of the sample's neighbours."""
    if len(sample) <= 2 * k:
        return 1.0
    rows = scaled(sample)
    some, forest = np.arange(0, len(ids), max(1, len(ids) // SAMPLE_QUERIES)), Forest(rows / norms(rows)[:, None])
    ask = lambda share: {(q, i) for q, i, _ in nearest(forest, rows, ids, rows[some], ids[some], share, k)}
    true = ask(1.0)
    return next((share for share in SHARES if len(ask(share) & true) >= goal * len(true)), 1.0)


def usable(column: Column) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0)


def search(vectors: DataFrame, *, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row whose id is divisible by every."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull())
    own = own.where(F.when(F.col("v").isNotNull(), usable(F.col("v"))).otherwise(False))
    lengths = [r.n for r in own.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()] or [0]
    found = reduce(DataFrame.union, [_of_length(own.where(F.size("v") == n), n, k, every, block, queries) for n in lengths])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return distinct.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _packed(df: DataFrame, length: int, size: int, forests: bool) -> DataFrame:
    """Rows packed by size, as they are read: name, ids, scaled vectors and, for forests, orders and strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, seq = [], TaskContext.get().partitionId(), 0

        def out(n: int) -> pa.RecordBatch:
            nonlocal held, seq
            t = pa.Table.from_batches(held)
            held = t.slice(n).to_batches()
            t = t.slice(0, n)
            flat = np.concatenate([np.asarray(c.flatten(), np.float64) for c in t.column("v").chunks])
            rows, ids = scaled(flat.reshape(n, length)), t.column("vec_id").to_numpy()
            built = Forest(rows / norms(rows)[:, None]) if forests else None
            seq += 1
            parts = [ids.astype("<i8"), rows.astype("<f8"), *((built.order.astype("<i4"), built.sorted.astype("<u8")) if built else (np.empty(0), np.empty(0)))]
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], ["name", "ids", "vectors", "orders", "strings"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                yield out(size)
        if rest := sum(b.num_rows for b in held):
            yield out(rest)

    return df.select("vec_id", "v").mapInArrow(tidied(run), "name long, ids binary, vectors binary, orders binary, strings binary")


def _of_length(own: DataFrame, length: int, k: int, every: int, block: int, queries: int) -> DataFrame:
    """query_id, vec_id and score of what the blocks find among vectors of one length."""
    sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    share = fitted_share(np.array([r.v for r in sample], np.float64).reshape(len(sample), length), np.array([r.vec_id for r in sample], np.int64), k)
    forests = written(_packed(own, length, block, True), "forests")
    asked = written(_packed(own.where(F.col("vec_id") % every == 0), length, queries, False), "queries")
    cells, lanes = max(1, forests.count() // BLOCKS_A_CELL), max(1, asked.count() // SETS_A_LANE)
    lane, cell = F.pmod(F.xxhash64("name"), F.lit(lanes)), F.pmod(F.xxhash64("name"), F.lit(cells))
    every_one = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = forests.select(cell.alias("cell"), every_one(lanes).alias("lane"), F.lit(0).alias("asks"), "ids", "vectors", "orders", "strings").union(
        asked.select(every_one(cells).alias("cell"), lane.alias("lane"), F.lit(1).alias("asks"), "ids", "vectors", "orders", "strings")
    )
    matrix = lambda raw: np.frombuffer(raw.as_buffer(), "<f8").reshape(-1, length)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                where = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if where != at:
                    at, held = where, []
                ids, vectors = np.frombuffer(batch.column(3)[i].as_buffer(), "<i8"), matrix(batch.column(4)[i])
                if not batch.column(2)[i].as_py():
                    built = (np.frombuffer(batch.column(5)[i].as_buffer(), "<i4").reshape(TREES, -1).copy(), np.frombuffer(batch.column(6)[i].as_buffer(), "<u8").reshape(TREES, -1).copy())
                    held.append((Forest(vectors, built=built), vectors.copy(), ids.copy()))
                    continue
                for forest, rows, row_ids in held:
                    found = list(nearest(forest, rows, row_ids, vectors, ids, share, k))
                    if found:
                        q, v, s = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    streamed = dealt.repartition("cell", "lane").sortWithinPartitions("cell", "lane", "asks")
    return streamed.mapInArrow(tidied(answer), "query_id long, vec_id long, score double")
