"""Token-id files: static range asymmetric numeral systems over interleaved blocks.

A container holds documents' token ids in order:

    magic | sizes of the parts | documents (id, number of tokens) | frequency table | block directory | blocks

One frequency table (summing to 2**PRECISION) is shared by all blocks of a container, 16 and more in a full one. A block codes
its ids in ``lanes`` interleaved states, so that a step handles one id per lane. It stands alone: it has its final states, its
words, a checkpoint of all states in its middle, and a CRC-32 of the ids of each half. Decoding may start at any block or
checkpoint; ``Container.blocks`` decodes any set of them side by side, all halves as lanes of one step, and a first half must
end in the states of the checkpoint. A wrong checksum raises, for halves read alone too.

As Spark carries bytes to any store that it can write, a file set is a Parquet table of containers with the number of
the range of documents each comes from and its start in that range; ranges ascend with the document id.

Scale: texts are shuffled once, into ranges of ids; a worker holds the ids of a container and of a slice of SLICE_BYTES of text,
and the ids of REMEMBERED pieces. Containers are read independently; the driver sees a row per range.

Defined cases: null texts count as empty; an empty text has the end id only; repeated ids stand next to each other,
ordered by text; null ids come first; an empty table gives no containers and no rows; other columns aren't read.
"""

from __future__ import annotations

import os
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import slices, text_of, written

MAGIC, HEAD = b"PSRA", struct.Struct("<4sQQQQQ")
#: Bits of the frequencies; least state; ids in a block at most; lanes at most; ids in a container at least, but for the last of a range.
PRECISION, LOW, BLOCK_IDS, LANES, CONTAINER_IDS = 18, np.uint64(1 << 31), 1 << 16, 256, 1 << 20
#: Distinct pieces of text whose ids a worker remembers; bytes of text encoded at once.
REMEMBERED, SLICE_BYTES = 900_000, 8_000_000
#: Pieces that the library is given as one text.
LINE = 1000
#: White space that runs on, or is neither a space nor a line feed (or is the mark of a cut): such texts aren't cut.
SPLIT_OTHERWISE = r"  | \n|\n |\n\n|[\x{0}\t\v\f\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts (all positive) scaled to sum to 2**PRECISION, each at least 1."""
    room = 1 << PRECISION
    if len(counts) > room:
        raise ValueError("more symbols than the table has room for")
    if not len(counts):
        return np.empty(0, np.int64)
    f = np.maximum(1, counts * room // counts.sum()).astype(np.int64)
    off = room - int(f.sum())
    if off > 0:
        f[np.argmax(f)] += off
    while off < 0:  # take from the largest what the least were given
        k = int(np.argmax(f))
        cut = min(-off, max(1, int(f[k]) // 2))
        f[k] -= cut
        off += cut
    return f


def _encode_blocks(index: np.ndarray, f: np.ndarray, cum: np.ndarray, blocks: int) -> list[tuple]:
    """Equal blocks, side by side. Of each: ids, lanes, words, words of the first half, and the bytes of final states, states in the middle and words."""
    n = len(index) // blocks
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    last = n - (steps - 1) * lanes  # lanes that have an id in the last step
    if blocks > 1:
        if last != lanes:
            raise ValueError("blocks side by side fill their steps")
        index = index.reshape(blocks, steps, lanes).transpose(1, 0, 2).ravel()
    width, shift, mask = blocks * lanes, np.uint64(PRECISION), np.uint64(0xFFFFFFFF)
    fs, cs = f[index], cum[index]
    limit = fs << np.uint64(63 - PRECISION)
    x, middle = np.full(width, LOW), steps // 2
    out, n_out, states = [], np.zeros((steps, blocks), np.int64), np.full(width, LOW)
    for t in range(steps - 1, -1, -1):
        k = last if t == steps - 1 and blocks == 1 else width
        at = slice(t * width, t * width + k)
        own = x[:k]
        over = own >= limit[at]
        out.append((own[over] & mask).astype(np.uint32))
        n_out[t] = np.add.reduceat(over, np.arange(0, k, lanes), dtype=np.int64)
        own = np.where(over, own >> np.uint64(32), own)
        div = own // fs[at]
        x[:k] = (div << shift) + (own - div * fs[at]) + cs[at]
        if t == middle:
            states = x.copy()
    words = np.concatenate(out[::-1])
    words = words[np.argsort(np.repeat(np.tile(np.arange(blocks, dtype=np.uint8), steps), n_out.ravel()), kind="stable")]
    ends, read = np.cumsum(n_out.sum(0)), n_out[:middle].sum(0)
    parts = zip(x.reshape(blocks, lanes), states.reshape(blocks, lanes), np.split(words, ends[:-1]), read.tolist(), strict=True)
    return [(n, lanes, len(w), r, b"".join((a.astype("<u8").tobytes(), m.astype("<u8").tobytes(), w.astype("<u4").tobytes()))) for a, m, w, r in parts]


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, last: int, slots: np.ndarray, f: np.ndarray, cum: np.ndarray) -> np.ndarray:
    """Symbols, a row per step, of as many runs of words (at: where each starts) as there are rows of states; x ends as the states after the
    last step, which only the first ``last`` lanes of a single run need have."""
    runs, lanes = x.shape
    shift, mask = np.uint64(PRECISION), np.uint64((1 << PRECISION) - 1)
    flat, at = x.reshape(-1), at.copy()
    out = np.empty((steps, runs * lanes), np.uint32)
    for t in range(steps):
        k = last if t == steps - 1 and runs == 1 else runs * lanes
        own = flat[:k]
        low = own & mask
        s = slots[low]
        out[t, :k] = s
        own = f[s] * (own >> shift) + low - cum[s]
        under = np.flatnonzero(own < LOW)
        n = np.bincount(under // lanes, minlength=runs)
        next_words = np.arange(len(under)) + np.repeat(at - np.cumsum(n) + n, n)
        if len(under) and next_words[-1] >= len(words):
            raise ValueError("the words of a block end too early")
        own[under] = (own[under] << np.uint64(32)) | words[next_words]
        at += n
        flat[:k] = own
    return out


def pack(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A container of these documents; ids: those of all of them, one after the other."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    f = frequencies(counts[symbols])
    place = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    place[symbols] = np.arange(len(symbols))
    index, f64 = place[ids], f.astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(f)[:-1]]).astype(np.uint64)
    entries, blocks, full = [], [], len(ids) // BLOCK_IDS
    parts = _encode_blocks(index[: full * BLOCK_IDS], f64, cum, full) if full else []
    if len(ids) % BLOCK_IDS:
        parts += _encode_blocks(index[full * BLOCK_IDS :], f64, cum, 1)
    raw = memoryview(ids.astype("<u4").tobytes())
    for k, (n, lanes, words, read, data) in enumerate(parts):
        a, half = k * BLOCK_IDS, k * BLOCK_IDS + -(-n // lanes) // 2 * lanes
        entries.append((n, lanes, words, read, zlib.crc32(raw[4 * a : 4 * half]), zlib.crc32(raw[4 * half : 4 * (a + n)])))
        blocks.append(data)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    table = zlib.compress(symbols.astype("<u4").tobytes() + f.astype("<u4").tobytes(), 1)
    directory = np.array(entries, "<u8").tobytes()
    return b"".join([HEAD.pack(MAGIC, len(doc_ids), len(docs), len(symbols), len(table), len(entries)), docs, table, directory, *blocks])


class Container:
    """Reads a container; any blocks, or the second half of one alone, can be read without the others."""

    def __init__(self, data: bytes):
        magic, n_docs, docs, n_symbols, table, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id container")
        at = HEAD.size
        raw = zlib.decompress(data[at : at + docs])
        at += docs
        self.doc_ids = [int(d) if k else None for k, d in zip(raw[:n_docs], np.frombuffer(raw, "<i8", n_docs, n_docs), strict=True)]
        self.lengths = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs)
        both = np.frombuffer(zlib.decompress(data[at : at + table]), "<u4")
        at += table
        self.symbols, f = both[:n_symbols], both[n_symbols:].astype(np.uint64)
        self.f, self.cum = f, (np.cumsum(f) - f).astype(np.uint64)
        self.slots = np.repeat(np.arange(n_symbols, dtype=np.uint32), f.astype(np.int64))
        self.directory = np.frombuffer(data, "<u8", 6 * n_blocks, at).reshape(n_blocks, 6).astype(np.int64)
        self.data, at, self.places = data, at + 48 * n_blocks, []
        for lanes, words in self.directory[:, 1:3].tolist():
            self.places.append(at)
            at += 16 * lanes + 4 * words

    def _parts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The states at the start and in the middle, and the words of a block."""
        _, lanes, words = self.directory[k, :3].tolist()
        states = np.frombuffer(self.data, "<u8", 2 * lanes, self.places[k]).astype(np.uint64).reshape(2, lanes)
        return states, np.frombuffer(self.data, "<u4", words, self.places[k] + 16 * lanes).astype(np.uint64)

    def _checked(self, k: int, half: int, ids: np.ndarray) -> np.ndarray:
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.directory[k, 4 + half]:
            raise ValueError(f"block {k} has a wrong checksum")
        return ids

    def half(self, k: int, h: int) -> np.ndarray:
        """Ids of a half of block k, read from its start or from the checkpoint on."""
        n, lanes, _, read = self.directory[k, :4].tolist()
        steps, (states, words) = -(-n // lanes), self._parts(k)
        first = steps // 2
        own = steps - first if h else first
        last = n - (steps - 1) * lanes if h else lanes
        x = states[h : h + 1].copy()
        out = _decode(x, words[read:] if h else words[:read], np.zeros(1, np.int64), own, last, self.slots, self.f, self.cum).ravel()
        if not h and (x != states[1]).any():
            raise ValueError(f"block {k} doesn't lead to its checkpoint")
        return self._checked(k, h, self.symbols[out[: n - first * lanes if h else first * lanes]])

    def blocks(self, ks: list[int]) -> list[np.ndarray]:
        """Ids of these blocks: full ones side by side, both halves of each at once."""
        whole = [k for k in ks if self.directory[k, 0] == BLOCK_IDS and self.directory[k, 1] == LANES]
        out = {}
        if whole:
            parts, read = [self._parts(k) for k in whole], self.directory[whole, 3]
            ends = np.cumsum([len(w) for _, w in parts])
            starts = np.concatenate([[0], ends[:-1]])
            at = np.stack([starts, starts + read], 1).ravel()
            x = np.concatenate([s for s, _ in parts])
            got = _decode(x, np.concatenate([w for _, w in parts]), at, BLOCK_IDS // LANES // 2, LANES, self.slots, self.f, self.cum)
            got = got.reshape(-1, len(whole), 2, LANES).transpose(1, 2, 0, 3).reshape(len(whole), 2, -1)
            for k, halves, end, (states, _) in zip(whole, got, x.reshape(len(whole), 2, LANES), parts, strict=True):
                if (end[0] != states[1]).any():
                    raise ValueError(f"block {k} doesn't lead to its checkpoint")
                out[k] = np.concatenate([self._checked(k, h, self.symbols[halves[h]]) for h in (0, 1)])
        return [out[k] if k in out else np.concatenate([self.half(k, 0), self.half(k, 1)]) for k in ks]

    def ids(self) -> np.ndarray:
        return np.concatenate(self.blocks(list(range(len(self.places))))) if self.places else np.empty(0, np.uint32)


if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are written as the machine's own 32-bit integers, which must be little-endian")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of whole texts under a byte-level BPE of the tokenizers library, which splits texts before it merges.

    A text without two white-space characters in a row and without special tokens splits the same way if it is cut
    before each space and on both sides of each line feed; such pieces recur, and their ids are kept. Any other text
    goes to the library as it is.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.special = special
        self.known: dict[str, bytes] = {}
        (self.feed,) = self.library.encode("\n", add_special_tokens=False).ids

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, read off lines of many: a line feed between two pieces that don't end in white space is an id of its own."""
        plain = [x for x in pieces if not x[-1:].isspace() and x]
        lines = [plain[a : a + LINE] for a in range(0, len(plain), LINE)]
        out: dict[str, bytes] = {}
        for line, e in zip(lines, self.library.encode_batch_fast(["\n".join(x) for x in lines], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(ids == self.feed)
            if len(at) != len(line) - 1:
                raise ValueError("pieces of this tokenizer span line feeds")
            raw, a = ids.tobytes(), 0
            for piece, b in zip(line, (*(4 * at).tolist(), len(raw)), strict=True):
                out[piece] = raw[a:b]
                a = b + 4
        rest = [x for x in pieces if x not in out]
        out.update(zip(rest, self._raw(rest), strict=True))
        return [out[x] for x in pieces]

    def whole(self, texts: pa.Array) -> pa.Array:
        """Whether the library must see a text as it is."""
        out = pc.match_substring_regex(texts, SPLIT_OTHERWISE)
        for m in self.special:
            out = pc.or_(out, pc.match_substring(texts, m))
        return out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of texts that may be cut; each distinct piece is looked up once."""
        column = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "), "\0")
        coded = pc.dictionary_encode(column.flatten())
        units, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        known = self.known
        fresh = [u for u in units if u not in known]
        if len(known) + len(fresh) > REMEMBERED:  # short pieces recur most
            short = {u: ids for u, ids in known.items() if len(u) < 8}
            known = self.known = short if 2 * len(short) < REMEMBERED else {}
            fresh = [u for u in units if u not in known]
        known.update(zip(fresh, self._pieces(fresh), strict=True))
        own = [known[u] for u in units]
        table, sizes = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4
        n = sizes[place]
        ends = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[place] - ends + n, n)
        at += np.arange(len(at))
        of = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
        return table[at], np.diff(np.concatenate([[0], ends])[of])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and their numbers."""
        whole = self.whole(texts)
        ids, counts = self._cut(texts.filter(pc.invert(whole)))
        if not pc.any(whole).as_py():
            return ids, counts
        parts = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
        rest = iter(self._raw(texts.filter(whole).to_pylist()))
        all_parts = [np.frombuffer(next(rest), "<u4") if w else next(parts) for w in whole.to_pylist()]
        return np.concatenate(all_parts), np.array([len(x) for x in all_parts], np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, so that pieces stay known."""
    return Encoder(path)


def write_files(docs: DataFrame, tokenizer_path: str, *, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Containers of the ids of all texts, written to the shared folder: part, seq, part_start, n_tokens, container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(tokenizer_path), TaskContext.get().partitionId()
        seq = start = 0
        doc_ids: list[int | None] = []
        ids, lengths = np.empty(0, np.uint32), np.empty(0, np.int64)

        def container(n_docs: int, n: int) -> pa.RecordBatch:
            data = pack(doc_ids[:n_docs], lengths[:n_docs], ids[:n])
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], ["part", "seq", "part_start", "n_tokens", "container"])

        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                fresh, counts = known.encode(some.column(1))
                if end_id is not None:
                    fresh, counts = np.insert(fresh, np.cumsum(counts), end_id), counts + 1
                doc_ids += some.column(0).to_pylist()
                ids, lengths = np.concatenate([ids, fresh.astype(np.uint32, copy=False)]), np.concatenate([lengths, counts])
                while len(ids) >= CONTAINER_IDS:
                    ends = np.cumsum(lengths)
                    n_docs = int(np.searchsorted(ends, CONTAINER_IDS)) + 1
                    n = int(ends[n_docs - 1])
                    yield container(n_docs, n)
                    seq, start = seq + 1, start + n
                    doc_ids, ids, lengths = doc_ids[n_docs:], ids[n:], lengths[n_docs:]
        if doc_ids:
            yield container(len(doc_ids), len(ids))

    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(dealt.mapInArrow(run, "part int, seq int, part_start long, n_tokens long, container binary"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the containers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                box = Container(data.as_py())
                ids, ends = box.ids().astype("<u4"), np.cumsum(box.lengths.astype(np.int64))
                raw = memoryview(ids.tobytes())
                starts = ends - box.lengths
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()] * len(crcs), pa.int32()), pa.array(box.doc_ids, pa.int64()), pa.array(starts + start.as_py()), pa.array(box.lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    spark = files.sparkSession
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    rows, before = [], 0
    for part, n in totals:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "part int, before long")
    read = files.select("part", "part_start", "container").mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return read.join(offsets, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
