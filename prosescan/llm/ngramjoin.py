"""N-gram Jaccard self-join of texts: MinHash banding, verified on full n-gram sets.

1. Texts with the same words are one node; the first of its rows (least id, nulls last) stands for it, the others are copies.
   Nodes are told apart by 128 bits of their words, never by ids, so different texts may share an id.
2. A text's distinct word n-grams are hashed to 64 bits; bands x rows minima give a hash per band. Bands and rows are
   chosen so that a pair at the least similarity shares a band with probability ``recall``.
3. Shuffled on band hashes. In buckets of up to HOT nodes every pair is a candidate, kept once. Members of larger
   buckets are joined to groups by shared large buckets, and a group is compared whole, in pairs of blocks with bounded
   numbers of members and n-grams. Pairs of blocks are dealt out by (group, block, block), so a hot group is neither gathered
   in one task nor spread into rows of pairs.
4. Candidates are verified on their full n-gram sets; no candidate is dropped, and there is no cap on partners.
5. Links give classes (connected components). Copies are linked to each other and to all that their text is linked to.

Scale: every grouping aggregates before it shuffles. Joins by node, band or label have one row a key on one side, so adaptive
execution may split a hot key's rows; a group's number of blocks reaches its members by salted keys. The driver sees counts only.

Defined cases: a text of fewer words than n is one n-gram of all its words; texts without words (null ones too) are linked
to nothing and each row is a class of its own; repeated rows are copies, and so are equal texts under one id; rows with null ids
take part and stand behind all others, and a class whose ids are all null has a null class_id; where different texts share an
id, class_id alone may not tell two classes apart, class_key does; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import one_thread, slices, text_of, tidied, written
from prosescan.llm.components import components

N, SIMILARITY, RECALL, ROWS = 5, 0.8, 0.999, 8
#: Members of a bucket whose pairs become rows; members and n-grams of a block; salts of a group of several blocks.
HOT, BLOCK, BLOCK_GRAMS, SALTS = 16, 512, 400_000, 64
#: Words whose hashes a worker remembers; bytes of text sketched at once.
REMEMBERED, SLICE_BYTES = 100_000, 4_000_000
#: A row of the input: its id and 128 bits of its text.
ROW = ["doc_id", "mark1", "mark2"]


def bands_for(similarity: float, recall: float, rows: int = ROWS) -> int:
    """The least number of bands that reaches the recall at this similarity."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Grams:
    """Hashed n-gram sets of texts; words are lower-cased and cut at white space."""

    def __init__(self, n: int = N):
        self.n, self.known = n, {}

    def words(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        try:
            return np.array([known[w] for w in words], np.uint64)
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))) for w in set(words) if w not in known)
            return np.array([known[w] for w in words], np.uint64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        size = min(self.n, len(w))
        if not size:
            return np.empty(0, np.uint64)
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
        return np.unique(h)

    def __call__(self, text: str) -> np.ndarray:
        return self.of_words(self.words(text))


class Bands:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20)
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)[:, None]
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        low = (grams >> np.uint64(32)).astype(np.uint32)[None, :]
        least = None
        for k in range(0, low.shape[1], 1024):
            part = (low[:, k : k + 1024] * self.a + self.b).min(axis=1)
            least = part if least is None else np.minimum(least, part)
        h = self.salt
        for column in least.reshape(self.bands, self.rows).T:
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        return h.view(np.int64)


def sketched(rows: DataFrame, n: int, bands: int, per_band: int) -> DataFrame:
    """The columns of ROW, key1 and key2 (hash of the words; null without words), n_grams, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, band = Grams(n), Bands(bands, per_band)
        half = lambda k, s: None if k is None else ((k >> s) & (2**64 - 1)) - 2**63
        for batch in batches:
            for some in slices(batch, 3, SLICE_BYTES):
                keys, sizes, hashes = [], [], []
                for text in some.column(3).to_pylist():
                    w = grams.words(text)
                    own = grams.of_words(w)
                    keys.append(xxhash.xxh3_128_intdigest(w.tobytes()) if len(w) else None)
                    sizes.append(len(own))
                    hashes.append(band(own) if len(own) else np.empty(0, np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(h) for h in hashes])]), pa.int32()), pa.array(np.concatenate([*hashes, np.empty(0, np.int64)]), pa.int64()))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array([half(k, 0) for k in keys], pa.int64()), pa.array([half(k, 64) for k in keys], pa.int64()), pa.array(sizes, pa.int64()), lists], [*ROW, "key1", "key2", "n_grams", "bands"])

    return rows.select(*ROW, "text").mapInArrow(tidied(run), "doc_id long, mark1 long, mark2 long, key1 long, key2 long, n_grams long, bands array<long>")


def similar(inter: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    return inter >= least * (a + b - inter) - 1e-9


def blockwise(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of intersections of all sets of a with all of b (of a, where b is None), through products of incidence matrices."""
    sets = a if b is None else a + b
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(a) if b is None else len(b)), np.float32)
    width = 2048
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [first, first + width])
        m = np.zeros((len(sets), width), np.float32)
        m[owner[lo:hi], column[lo:hi] - first] = 1
        out += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ROW and text."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark1"), F.xxhash64(F.lit(1), text).alias("mark2"), text.alias("text"))


def _same_row(a: str, b: str):
    return F.col(f"{a}doc_id").eqNullSafe(F.col(f"{b}doc_id")) & (F.col(f"{a}mark1") == F.col(f"{b}mark1")) & (F.col(f"{a}mark2") == F.col(f"{b}mark2"))


def _joined(docs: DataFrame, n: int, similarity: float, recall: float, rows: int, hot: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows' sketches (columns of ROW, key1, key2) and the nodes: key1, key2, first (row that stands for the node), copies, label (of the node's class), links."""
    spark = docs.sparkSession
    own = _rows(docs, id_col, text_col)
    sketches = written(sketched(own, n, bands_for(similarity, recall, rows), rows), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *ROW)
    by_key = sketches.where("key1 is not null").groupBy("key1", "key2").agg(F.min(row).alias("first"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    # Numbered once and for all by being written; ids couldn't number them, as different texts may share one.
    whole = written(by_key.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = whole.drop("bands")
    banded = whole.select("node", "n_grams", "copies", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.count("*").alias("members"), F.min("node").alias("leader")).where("members > 1")
    met = written(banded.join(buckets, "band"), "buckets")

    large = met.where(F.col("members") > hot)
    if large.isEmpty():
        group_of = spark.createDataFrame([], "node long, in_group long")
    else:
        group_of = components(large.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))).withColumnRenamed("label", "in_group")
    few = met.where(F.col("members") <= hot).join(group_of, "node", "left").select("band", "node", "n_grams", "copies", "in_group")
    left, right = (few.select("band", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n_grams", "copies", "in_group"))) for s in "ab")
    close = (F.col("n_grams_a") >= similarity * F.col("n_grams_b")) & (F.col("n_grams_b") >= similarity * F.col("n_grams_a"))
    apart = F.col("in_group_a").isNull() | F.col("in_group_b").isNull() | (F.col("in_group_a") != F.col("in_group_b"))
    pairs = written(left.join(right, "band").where((F.col("node_a") < F.col("node_b")) & close & apart).select("node_a", "node_b", "copies_a", "copies_b").distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("node_a", "node_b")).alias("node")).union(group_of.select("node")).distinct().join(nodes.select("node", "copies", "first.*").withColumnsRenamed({c: f"w_{c}" for c in ROW}), "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(n)
        for batch in batches:
            for some in slices(batch, 2, SLICE_BYTES // 2):
                own = [grams(t) for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([len(g) for g in own], pa.int64()), pa.array([g.tobytes() for g in own], pa.binary())], ["node", "copies", "n_grams", "grams"])

    texts = own.join(wanted, _same_row("", "w_")).select("node", "copies", "text")
    gram_sets = written(texts.mapInArrow(tidied(sets), "node long, copies long, n_grams long, grams binary").dropDuplicates(["node"]), "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(similar(np.intersect1d(a, b, assume_unique=True).size, len(a), len(b), similarity)))
            some = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([some.column(k) for k in range(4)], ["node_a", "node_b", "copies_a", "copies_b"])

    of = lambda s: gram_sets.select(F.col("node").alias(f"node_{s}"), F.col("grams").alias(f"grams_{s}"))
    linked = written(pairs.join(of("a"), "node_a").join(of("b"), "node_b").select("node_a", "node_b", "copies_a", "copies_b", "grams_a", "grams_b").mapInArrow(tidied(verify), "node_a long, node_b long, copies_a long, copies_b long"), "links")

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        """Within a pair of blocks: links of each member, and edges of a spanning forest."""
        one_thread()
        side, node = t.column("block").to_numpy(), t.column("node").to_numpy()
        i, j = key[1].as_py(), key[2].as_py()
        copies, size = t.column("copies").to_numpy(), t.column("n_grams").to_numpy().astype(np.float32)
        grams = [np.frombuffer(g, np.uint64) for g in t.column("grams").to_pylist()]
        at = np.flatnonzero(side == i)
        to = at if i == j else np.flatnonzero(side == j)
        inter = blockwise([grams[k] for k in at], None if i == j else [grams[k] for k in to]) if len(at) and len(to) else np.zeros((len(at), len(to)), np.float32)
        yes = similar(inter, size[at][:, None], size[to][None, :], similarity)
        if i == j:
            np.fill_diagonal(yes, False)
        links = np.zeros(len(node), np.int64)
        links[at] += yes @ copies[to]
        if i != j:
            links[to] += copies[at] @ yes
        parent = np.arange(len(node))
        for x, row in enumerate(yes):  # hook each node's component to those of its links
            hit = to[row]
            if len(hit):
                roots = np.unique(parent[np.append(hit, at[x])])
                parent[np.isin(parent, roots)] = roots[0]
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(node[parent])})

    members = group_of.join(gram_sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    sizes = members.groupBy("in_group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n_grams") / BLOCK_GRAMS)).cast("int").alias("blocks")).where("blocks > 1")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    grouped = members.join(salted, ["in_group", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = grouped.withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("in_group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "n_grams", "grams")
    # A partitioning by group alone would do for the grouping, and would put a hot group's blocks into one task.
    compared = written(dealt.repartition("in_group", "i", "j").groupBy("in_group", "i", "j").applyInArrow(compare, "node long, links long, root long"), "compared")

    edges = linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).union(compared.where("node <> root").select("node", "root"))
    label = components(edges)
    links = linked.select(F.col("node_a").alias("node"), F.col("copies_b").alias("links")).union(linked.select("node_b", "copies_a")).union(compared.select("node", "links"))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    out = nodes.join(label, "node", "left").join(degree, "node", "left")
    classed = out.select("key1", "key2", "first", "copies", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return sketches.drop("bands", "n_grams"), written(classed, "classed")


def classes(docs: DataFrame, *, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, hot: int = HOT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (least id of the class), n_links (rows at least that similar) and class_key (a value per class; null for rows without words) for every row."""
    sketches, nodes = _joined(docs, n, similarity, recall, rows, hot, block, id_col, text_col)
    hexed = lambda *c: F.concat(*(F.lpad(F.hex(x), 16, "0") for x in c))
    least = nodes.groupBy("label").agg(F.min("first.doc_id").alias("class_id"), F.min(hexed("key1", "key2")).alias("class_key"))
    of_key = nodes.join(least, "label").select("key1", "key2", "class_id", "class_key", F.col("links").alias("n_links"))
    alone = sketches.where("key1 is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("string").alias("class_key"))
    return sketches.where("key1 is not null").join(of_key, ["key1", "key2"]).select("doc_id", "class_id", "n_links", "class_key").union(alone)


def one_of_each(docs: DataFrame, *, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS, hot: int = HOT, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class: the first by id (nulls last), and by text where ids are equal. Rows without words all stay."""
    sketches, nodes = _joined(docs, n, similarity, recall, rows, hot, block, id_col, text_col)
    first = nodes.groupBy("label").agg(F.min(F.struct("first", "copies")).alias("x")).select(*(f"x.first.{c}" for c in ROW), F.col("x.copies").alias("rows"))
    wordless = sketches.where("key1 is null").groupBy(*ROW).agg(F.lit(1).cast("long").alias("rows"))
    kept = written(first.union(wordless).withColumnsRenamed({c: f"k_{c}" for c in ROW}), "kept")
    text = text_of("t")
    rows_ = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("t"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))
    marked = rows_.withColumn("mark1", F.xxhash64(text)).withColumn("mark2", F.xxhash64(F.lit(1), text)).drop("t")
    out = marked.join(kept, _same_row("", "k_"))
    once, often = out.where("rows = 1"), out.where("rows > 1").dropDuplicates(ROW)
    return once.select("whole.*").unionByName(often.select("whole.*"))
