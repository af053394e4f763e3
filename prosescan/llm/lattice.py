"""SentencePiece encoding and decoding over a relational lattice.

A text, with marks for its spaces and one in front, is cut into units wherever no piece of the model spans the cut. The
distinct units of a slice of documents are exploded into substrings of up to the longest piece's length (a substring that no
piece begins with isn't extended); an equi-join with the piece table, by 64-bit hashes, leaves the edges of each unit's
lattice; edges are grouped by unit and folded. Documents then look their units up in the result.

The fold: a path of greatest total score is not what the library returns for a BPE model, whose scores are merge ranks. So
edges are folded in the order of their ranks over the set of places that are still cuts: an edge whose ends are cuts, with
exactly one cut between them, removes that cut. As a piece's parts always have earlier ranks than the piece, one pass in rank
order makes the library's merges, and the result is its encoding.

The relations are numpy columns within an Arrow function, so nothing is shuffled and memory is that of a slice. The same
lattice as a DataFrame, folded with Spark's higher-order ``aggregate``, is ``cuts_of_units``; see the README for its figures.

Decoding joins the pieces of the ids, gathers byte pieces into characters and turns marks into spaces; it gives the text back
but for marks that were in it (they come back as spaces).

Defined cases: null texts count as empty; an empty text has no ids; characters outside the table become byte pieces; units
over LONG code points are merged on their own by the same rule; repeated rows are encoded alike; other columns aren't read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import text_of, tidied

MARK, LONG, AT_ONCE = "▁", 60, 250
#: Before a mark that follows another character; between a letter and a comma or full stop; around line feeds.
CUTS = rf"(?<=[^{MARK}])(?={MARK})|(?<=\p{{L}})(?=[,.])|(?=\n)|(?<=\n)"


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [k for k in range(m.get_piece_size()) if not (m.is_control(k) or m.is_unknown(k) or m.is_byte(k) or m.is_unused(k))]
        self.id = {m.id_to_piece(k): k for k in ordinary}
        self.rank = {p: r for r, (_, k, p) in enumerate(sorted((-m.get_score(k), k, m.id_to_piece(k)) for k in ordinary))}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.id))
        self.raw = [b""] * m.get_piece_size()
        for p, k in self.id.items():
            self.raw[k] = p.encode()
        for b, k in enumerate(self.bytes):
            self.raw[k] = bytes([b])
        spans = [p[k : k + 2] for p in self.id for k in range(len(p) - 1)]
        if any((a != MARK and b == MARK) or (a.isalpha() and b in ",.") or "\n" in a + b for a, b in spans):
            raise ValueError("pieces of this model span the cuts between units")
        self.lengths = np.array([len(r) for r in self.raw])
        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids_between(self, unit: str, cuts: list[int]) -> list[int]:
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            k = self.id.get(unit[a:b])
            out += [k] if k is not None else [self.bytes[x] for x in unit[a:b].encode("utf-8", "surrogatepass")]
        return out

    def merged(self, unit: str) -> list[int]:
        """Ids of a unit of any length: the merge of least rank, leftmost first, until none is left."""
        after, before = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        alive, heap = [True] * len(unit), []

        def offer(a: int) -> None:
            b = after[a]
            if b < len(unit) and (r := self.rank.get(unit[a : after[b]])) is not None:
                heapq.heappush(heap, (r, a, b, after[b]))

        for a in range(len(unit)):
            offer(a)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if not (alive[a] and alive[b]) or after[a] != b or after[b] != end:
                continue
            alive[b], after[a] = False, end
            if end < len(unit):
                before[end] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return self.ids_between(unit, [a for a in range(len(unit)) if alive[a]] + [len(unit)])


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def units(text: Column) -> Column:
    """The text's units in order; none for an empty text."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.filter(F.split(F.concat(F.lit(MARK), F.translate(text, " ", MARK)), CUTS, -1), lambda u: u != ""))


def cuts_of_units(words: DataFrame, model_path: str) -> DataFrame:
    """words: chunk long, unit string (distinct, 2 to LONG code points). Adds cuts: bit k is set where a piece starts or ends at
    code point k. Units without an edge are left out. Keeps the partitioning by chunk."""
    p, spark = pieces(model_path), words.sparkSession
    table = spark.createDataFrame([(x, r) for x, r in p.rank.items() if len(x) > 1], "piece string, rank long")
    starts = words.withColumn("n", F.length("unit")).select("chunk", "unit", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 2)).alias("s"))
    parts = starts.select("chunk", "unit", "s", F.explode(F.sequence(F.lit(2), F.least(F.lit(p.longest), F.col("n") - F.col("s")))).alias("l")).withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("l")))
    edges = parts.join(F.broadcast(table), "piece").select("chunk", "unit", F.expr("(rank << 16) | (s << 8) | l").alias("edge"))
    lattice = edges.groupBy("chunk", "unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    start, end = "cast((e >> 8) & 255 as int)", "cast(((e >> 8) & 255) + (e & 255) as int)"
    inside = f"(((1L << cast((e & 255) - 1 as int)) - 1L) << ({start} + 1))"
    fold = f"""aggregate(edges, (1L << (length(unit) + 1)) - 1L, (m, e) ->
        case when ((m >> {start}) & (m >> {end}) & 1L) = 1L and bit_count(m & {inside}) = 1 then m & ~{inside} else m end)"""
    return lattice.select("chunk", "unit", F.expr(fold).alias("cuts"))


def _gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Slices of values, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 2**31 else np.int64
    at = np.repeat((starts - ends + lengths).astype(kind), lengths)
    at += np.arange(total, dtype=kind)
    return values[at]


def decoded(ids: np.ndarray, model_path: str) -> str:
    """The text of these ids."""
    p = pieces(model_path)
    return b"".join([p.raw[k] for k in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")[1:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _extended(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Hashes of substrings that are longer by one code point."""
    return _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) + np.uint64(1))


class Lattice:
    """The piece table as sorted hashes of the pieces and their beginnings, by length, with the rank and id of those that are pieces."""

    def __init__(self, path: str):
        self.pieces = p = pieces(path)
        found: list[dict[str, int]] = [{} for _ in range(p.longest + 1)]
        for piece in p.id:
            for size in range(1, len(piece) + 1):
                found[size].setdefault(piece[:size], -1)
            found[len(piece)][piece] = p.rank[piece]
        self.of_rank = np.array([p.id[x] for x in sorted(p.rank, key=p.rank.get)])
        self.single = np.full(0x110000, -1, np.int64)
        for piece, k in p.id.items():
            if len(piece) == 1:
                self.single[ord(piece)] = k
        self.tables = []
        for size in range(p.longest + 1):
            names = list(found[size])
            codes = np.array([[ord(c) for c in x] for x in names], np.uint32).reshape(len(names), size)
            h = np.zeros(len(names), np.uint64)
            for c in codes.T:
                h = _extended(h, c)
            order = np.argsort(h)
            self.tables.append((h[order], np.array([found[size][names[k]] for k in order], np.int64)))

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, lengths and ranks of the substrings of two or more code points that are pieces; left: code points from a position to its unit's end."""
        at, h, out = np.arange(len(codes)), np.zeros(len(codes), np.uint64), []
        for size in range(1, self.pieces.longest + 1):
            inside = left[at] >= size
            at, h = at[inside], h[inside]
            h = _extended(h, codes[at + size - 1])
            hashes, ranks = self.tables[size]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            at, h, rank = at[hit], h[hit], ranks[place[hit]]
            if size > 1:
                is_piece = rank >= 0
                out.append((at[is_piece], np.full(int(is_piece.sum()), size), rank[is_piece]))
            if not len(at):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after the other, and their numbers; units of at most LONG code points."""
        lengths = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        of = np.repeat(np.arange(len(units)), lengths)
        at, size, rank = self.edges(codes, ends[of] - np.arange(len(codes)))
        order = np.argsort((of[at] << 24) | rank, kind="stable")  # positions are in order for each rank and length already
        unit, at, size, rank = of[at][order], at[order], size[order], rank[order]
        n_edges = np.bincount(unit, minlength=len(units))
        first = np.cumsum(n_edges) - n_edges
        most = np.argsort(-n_edges, kind="stable")
        cuts = (np.uint64(1) << (lengths + 1).astype(np.uint64)) - np.uint64(1)
        one, s = np.uint64(1), (at - starts[unit]).astype(np.uint64)
        width = size.astype(np.uint64)
        inside = ((one << (width - one)) - one) << (s + one)
        active = len(most)
        for k in range(int(n_edges.max(initial=0))):
            while active and n_edges[most[active - 1]] <= k:
                active = int(np.searchsorted(-n_edges[most], -k, side="left"))
            u = most[:active]
            e = first[u] + k
            m, between = cuts[u], cuts[u] & inside[e]
            good = ((m >> s[e]) & (m >> (s[e] + width[e])) & one).astype(bool) & (between != 0) & ((between & (between - one)) == 0)
            cuts[u] = np.where(good, m & ~inside[e], m)
        place = (np.arange(len(codes)) - starts[of]).astype(np.uint64)
        begins = np.flatnonzero((cuts[of] >> place) & one)
        stops = np.append(begins[1:], len(codes))
        token = self.single[codes[begins]]
        long = np.flatnonzero(stops - begins > 1)
        if len(long):
            key = (at << 8) | size
            order = np.argsort(key)
            token[long] = self.of_rank[rank[order[np.searchsorted(key[order], (begins[long] << 8) | (stops - begins)[long])]]]
        counts = np.bincount(of[begins], minlength=len(units))
        if (token < 0).any():  # characters that become bytes
            sizes = np.ones(len(token), np.int64)
            unknown = np.flatnonzero(token < 0)
            spelled = [[self.pieces.bytes[b] for b in chr(codes[begins[k]]).encode("utf-8", "surrogatepass")] for k in unknown]
            sizes[unknown] = [len(x) for x in spelled]
            out = np.repeat(token, sizes)
            to = np.cumsum(sizes) - sizes
            for k, x in zip(unknown, spelled, strict=True):
                out[to[k] : to[k] + len(x)] = x
            token, counts = out, np.bincount(of[begins], sizes, len(units)).astype(np.int64)
        return token, counts

    def lookup(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each unit start and how many they are."""
        short = np.array([len(u) <= LONG for u in units], bool)
        ids, n = self.encode([u for u, ok in zip(units, short, strict=True) if ok])
        own = [self.pieces.merged(u) for u, ok in zip(units, short, strict=True) if not ok]
        counts = np.zeros(len(units), np.int64)
        counts[short], counts[~short] = n, [len(x) for x in own]
        starts = np.zeros(len(units), np.int64)
        starts[short] = np.cumsum(n) - n
        starts[~short] = len(ids) + np.cumsum(counts[~short]) - counts[~short]
        return np.concatenate([ids, np.array([k for x in own for k in x], np.int64)]), starts, counts


@lru_cache(maxsize=1)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def encode(docs: DataFrame, model_path: str, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) and round_trip (whether decoding gives
    the text back, a mark of its own as a space) for every document; with_ids adds the ids."""
    names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, p = lattice(model_path), pieces(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(a, AT_ONCE)
                column = some.column(1)
                flat, bounds = column.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
                coded = pc.dictionary_encode(flat)
                place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                table, starts, counts = whole.lookup(coded.dictionary.to_pylist())
                sizes = counts[place]
                ids = _gathered(table, starts[place], sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)[bounds]
                text, back = _bytes(flat), _gathered(p.joined, p.starts[ids], p.lengths[ids])
                read = np.concatenate([[0], np.cumsum(p.lengths[ids])]).astype(np.int64)[ends]
                there = np.concatenate([[0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False))]).astype(np.int64)[bounds]
                raw = memoryview(ids.astype("<u4").tobytes())
                same = [bool(np.array_equal(back[r0:r1], text[t0:t1])) for r0, r1, t0, t1 in zip(read, read[1:], there, there[1:], strict=False)]
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
                columns = [some.column(0), pa.array(np.diff(ends)), pa.array(crcs, pa.int64()), pa.array(same, pa.bool_())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
                del some, column, flat, coded, place, ids, back, text, raw, columns
                pa.default_memory_pool().release_unused()

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, units(text_of(text_col)).alias("units")).mapInArrow(tidied(run), f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)


def _bytes(strings: pa.Array) -> np.ndarray:
    """The strings' UTF-8, one after the other."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32 if strings.type == pa.string() else np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8)[int(offsets[0]) : int(offsets[-1])] if len(strings) else np.empty(0, np.uint8)
