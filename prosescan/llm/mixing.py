"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A document's size is its number of words. Sources are given targets by weight, none above ``max_epochs`` times
its own size (the excess goes to the others by weight). The mix is cut into equal blocks of words; a source gets
the blocks that the highest quotients target / (2k + 1) give it, and within a source each shard (a seeded hash of
the document id) gets blocks by the same rule on its size. A shard lays its documents out in seeded order; whole
passes over the shard come first and what is left of its quota is a seeded choice of its blocks. The words taken
from a document are those that the chosen blocks cover, so no document gives more than ``max_epochs`` times its size.

Defined cases: null or empty texts have size 0 and give nothing; a null source is a source of its own, ordered last;
repeated rows are separate documents;
a row without an id is dealt by a hash of its text (equal rows, and rows of one id, share a shard, which is sorted and spilled by one task); an empty table gives no rows; columns other than the id, text and source are
not read, so extra columns with any names do no harm. No words at all: every target is 0.

Scale: one scan of the texts writes (id, source, size) to the shared folder. The driver holds a row per source and
per shard; shards are sized so that there are at most MAX_SHARDS beyond one per source, whatever the input.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosescan.llm.common import WORD, text_of, written

#: Words in a shard at least, and shards in all at most (beside one for each source).
SHARD_WORDS, MAX_SHARDS = 131_072, 100_000
#: Words in a block at most; blocks that the smallest target is cut into; blocks that all words are cut into at most, for small blocks.
BLOCK_WORDS, BLOCKS_OF_LEAST, MANY_BLOCKS = 1024, 50, 500_000
#: Sources the driver accepts.
MAX_SOURCES = 1_000_000
#: A prime above any number of blocks in a shard: steps through them in a fixed scattered order.
STRIDE = 2_147_483_647


def targets(sizes: list[int], weights: list[int], ratio: float, max_epochs: int) -> list[float]:
    """Shares of ratio * sum(sizes) by weight, none above max_epochs times its size."""
    # Those that reach their caps first, by cap for weight, are filled one after the other; the rest share what is left.
    order = sorted(range(len(sizes)), key=lambda i: max_epochs * sizes[i] / weights[i])
    total, filled, weight = float(sum(sizes)), 0, sum(weights)
    out = [float(max_epochs * s) for s in sizes]
    for k, i in enumerate(order):
        unit = (ratio * total - filled) / weight
        if weights[i] * unit <= max_epochs * sizes[i]:
            for j in order[k:]:
                out[j] = weights[j] * unit
            break
        filled, weight = filled + max_epochs * sizes[i], weight - weights[i]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by the highest quotients votes / (2k + 1), ties to the earlier party, none above its cap."""
    seats = min(seats, sum(c for v, c in zip(votes, caps, strict=True) if v > 0))
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)

    def at(divisor: float) -> list[int]:
        return [min(c, int(v / divisor + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps, strict=True)]

    low, high = 0.0, 2.0 * max(votes) + 1.0  # at high nobody has a seat
    for _ in range(200):  # the smallest divisor found that doesn't give too many seats
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if sum(at(mid)) > seats else (low, mid)
    got = at(high * (1 + 1e-12))
    heap = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, caps, strict=True)) if v > 0 and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def block_words(total: int, least_target: float) -> int:
    return max(1, min(BLOCK_WORDS, max(total // MANY_BLOCKS, int(least_target) // BLOCKS_OF_LEAST)))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), ratio: float = 1.5, max_epochs: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source_ix, size, source_size, target, taken for every document; see the module."""
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"), F.when(F.col(id_col).isNull(), F.concat(F.lit("text "), F.md5(text_of(text_col).cast("binary")))).alias("mark")), "mix-sizes")
    sources = [(r.source, r.words) for r in sized.groupBy("source").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()]
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sources.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [w for _, w in sources]
    total = sum(sizes)
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], ratio, max_epochs)
    block = block_words(total, min([g for g in goal if g > 0], default=0))
    per_shard = max(SHARD_WORDS, -(-total // MAX_SHARDS))
    shards = [max(1, -(-w // per_shard)) for w in sizes]
    plan = spark.createDataFrame([(s, i, n, w, g) for i, ((s, w), n, g) in enumerate(zip(sources, shards, goal, strict=True))], "m_source string, source_ix int, n_shards long, source_size long, target double")
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("mark"))))
    dealt = (
        sized.join(plan, F.col("source").eqNullSafe(F.col("m_source")))
        .withColumn("key", key)
        .withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.col("n_shards")))
        .select("doc_id", "size", "source_ix", "source_size", "target", "key", "shard")
    )
    cells = sorted((r.source_ix, r.shard, r.words) for r in dealt.groupBy("source_ix", "shard").agg(F.sum("size").alias("words")).collect())
    blocks = [-(-w // block) for _, _, w in cells]
    caps = [0] * len(sizes)
    for (i, _, _), n in zip(cells, blocks, strict=True):
        caps[i] += max_epochs * n
    quota = sainte_lague(goal, math.floor(sum(goal) / block + 0.5), caps)
    rows, at = [], 0
    while at < len(cells):
        end = at
        while end < len(cells) and cells[end][0] == cells[at][0]:
            end += 1
        got = sainte_lague([float(w) for _, _, w in cells[at:end]], quota[cells[at][0]], [max_epochs * n for n in blocks[at:end]])
        rows += [(i, s, n, g // n if n else 0, g % n if n else 0) for (i, s, _), n, g in zip(cells[at:end], blocks[at:end], got, strict=True)]
        at = end
    quotas = spark.createDataFrame(rows, "source_ix int, shard long, n_blocks long, passes long, extra long")
    order = Window.partitionBy("source_ix", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("source_ix").cast("string"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    laid = dealt.join(quotas, ["source_ix", "shard"]).withColumn("to", F.sum("size").over(order)).withColumn("from", F.col("to") - F.col("size")).withColumn("first", first)
    chosen = F.expr(
        f"""case when size = 0 or extra = 0 then 0L else aggregate(
              sequence(`from` div {block}L, (`to` - 1) div {block}L), 0L,
              (got, b) -> got + case when pmod(({STRIDE}L % n_blocks) * b + first, n_blocks) < extra
                                     then least(`to`, (b + 1) * {block}L) - greatest(`from`, b * {block}L) else 0L end) end"""
    )
    return laid.select("doc_id", "source_ix", "size", "source_size", "target", (F.col("passes") * F.col("size") + chosen).alias("taken"))


def mixed_documents(docs: DataFrame, *, seed: str = "mix", **options) -> DataFrame:
    """The mix as documents, with the columns of docs: each document in whole copies, as many as its taken words make, the
    fraction left as one more by a seeded draw with that probability, so sources keep their expected totals at any length.

    Rows that agree in id and size take the same number of copies (by the mean of what they got).
    """
    got = mix(docs.select("doc_id", "text", "source"), seed=seed, **options).where("size > 0")
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("copies"), F.coalesce(F.col("m_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    copies = F.floor(F.col("m_taken") / F.col("m_size") + drawn).cast("int").alias("m_copies")
    keyed = got.groupBy(F.col("doc_id").alias("m_id"), F.col("size").alias("m_size")).agg(F.avg("taken").alias("m_taken")).select("m_id", "m_size", copies).where("m_copies > 0")
    sized = docs.withColumn("m_words", F.regexp_count(text_of(), F.lit(WORD)).cast("long"))
    return sized.join(keyed, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("m_words") == F.col("m_size"))).withColumn("m_copy", F.explode(F.sequence(F.lit(1), "m_copies"))).select(*[F.col(f"`{c}`") for c in docs.columns])
