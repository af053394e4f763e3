"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Texts are lower-cased (A-Z) and cut at ASCII white space; an end follows each. Outputs and contexts are all training tokens
that occur LEAST times, on large inputs sqrt(all training tokens) / ROOT times (and the VOCABULARY most frequent, on small
ones), so the vocabulary grows with the input, about as the square root of it, as every worker holds the vectors; and CLASSES
classes of all others (by ending, script and length), within which a token has probability (c + 0.5) / (sum of
c + 0.5, + 0.5 for unseen ones). Outputs are in groups of about the square root of their number. For the two tokens before,
u and v, a group g and an output w of it have the scores

    s(g | u, v) = (R1[u] + R2[v]) . T[g] + c[g]        s(w | g, u, v) = (R1[u] + R2[v]) . Q[w] + b[w]

where R1 and R2 are the word vectors with the matrices of their positions multiplied in. Training is noise-contrastive for
both: each training token's group, and its output within the group, is told from NOISE others drawn by frequency, once a
batch and shared by the tokens of the batch. Every task passes over all training tokens of its part from a common start,
and each row of the parameters is averaged over the tasks by the tokens it stood for. Both normalisers are summed in full,
so each token's log-probability is exact, in time that grows with the square root of the vocabulary.

Counts cover all training tokens and are joined back exactly for every token. Defined cases: null texts count as empty and
are an end only; no training text gives uniform scores of the unseen; repeated rows count as often as they occur; other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.chunks import dealt
from prosescan.llm.common import one_thread, slices, text_of, tidied, written

VOCABULARY, CLASSES, SIZE, NOISE, BATCH, RATE = 2000, 36, 24, 32, 4096, 0.15
#: Bytes of text that are numbered at once.
SLICE_BYTES = 6_000_000
#: Occurrences from which a token has vectors of its own, or the square root of all training tokens by ROOT, whichever is more;
#: the VOCABULARY most frequent have them anyway.
LEAST, ROOT = 50, 36
#: Where sums of squared gradients start: little, as a rare token's are small.
FIRST_SQUARE = 1e-6
#: Distinct words that a task of the count holds at most, about, before it passes sums on.
HELD_WORDS = 1_000_000
#: Rows of the parameters that are averaged together.
PART = 4096
#: Scores up to this size are exponentiated in single precision as they are; beyond it the greatest of a row is taken off first.
SAFE = 40.0
END = b""


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "surrogatepass").lower().split(), END]


def words_of(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The texts' parts between white space, one after the other (empty at either end of a text that starts or ends with it), and their numbers."""
    column = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    return column.flatten(), pc.list_value_length(column)


def distinct_words(texts: pa.Array) -> pa.Array:
    """Distinct words of texts as binary, with END."""
    return pc.unique(pa.concat_arrays([pa.array([END], pa.binary()), pc.unique(words_of(texts)[0]).cast(pa.binary())]))


def tallied(texts: pa.Array) -> pa.Table:
    """word binary, n long: of the words of texts and their ends."""
    flat, _ = words_of(texts)
    got = pc.value_counts(flat.filter(pc.greater(pc.binary_length(flat), 0)))
    return pa.table([pa.concat_arrays([got.field(0).cast(pa.binary()), pa.array([END], pa.binary())]), pa.concat_arrays([got.field(1), pa.array([len(texts)], pa.int64())])], ["word", "n"])


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of texts as binary (the first is END), the word of every token as a number into them, and the texts' numbers of tokens."""
    flat, parts = words_of(texts)
    of = np.repeat(np.arange(len(texts)), parts.to_numpy(zero_copy_only=False))
    filled = pc.greater(pc.binary_length(flat), 0)
    both = pc.dictionary_encode(flat.filter(filled))
    n_words = np.bincount(of[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))
    place = np.insert(both.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, np.cumsum(n_words), 0)
    return pa.concat_arrays([pa.array([END], pa.binary()), both.dictionary.cast(pa.binary())]), place, n_words + 1


def class_of(word: bytes) -> int:
    """By last byte (comma, full stop, other mark, letter), whether it is ASCII, and length."""
    last = word[-1:] or b" "
    ending = 0 if last == b"," else 1 if last == b"." else 3 if last.isalpha() or last[0] > 127 else 2
    size = len(word)
    return ending * 9 + (0 if word.isascii() else 3 if word[0] > 127 else 6) + (0 if size < 5 else 1 if size < 9 else 2)


def classes_of(words: pa.Array) -> np.ndarray:
    """class_of for an array of binary words."""
    if not len(words):
        return np.zeros(0, np.int64)
    starts = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[starts[0] : starts[-1]]
    size, ends = np.diff(starts), starts[1:] - starts[0]
    filled = size > 0
    last, first = np.full(len(size), ord(" "), np.uint8), np.zeros(len(size), np.uint8)
    last[filled], first[filled] = raw[ends[filled] - 1], raw[(ends - size)[filled]]
    high = np.concatenate([[0], np.cumsum(raw > 127)])
    ascii_ = high[ends] == high[ends - size]
    letter = (last > 127) | ((last | 32) - ord("a") < 26)
    ending = np.select([last == ord(","), last == ord("."), letter], [0, 1, 3], 2)
    return ending * 9 + np.where(ascii_, 0, np.where(first > 127, 3, 6)) + np.where(size < 5, 0, np.where(size < 9, 1, 2))


def numbered(top: dict[bytes, int]) -> tuple[dict[bytes, int], np.ndarray]:
    """Numbers of the vocabulary's words and of the classes of all others: by form, then count, so groups (runs of numbers) are of like words."""
    order = sorted([(class_of(w), -n, w) for w, n in top.items()] + [(k, 1, b"") for k in range(CLASSES)])
    return {w: k for k, (_, n, w) in enumerate(order) if n < 1}, np.array([k for k, x in enumerate(order) if x[1] == 1])


class Vocabulary:
    """Outputs of words: a number of its own, or that of its class."""

    def __init__(self, numbers: dict[bytes, int], rest: np.ndarray):
        self.words, self.numbers, self.rest = pa.array(list(numbers), pa.binary()), np.array(list(numbers.values()), np.int64), rest

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For an array of binary words their outputs, which of them have none of their own, and the classes of these."""
        at = pc.index_in(words, self.words)
        rare = np.asarray(at.is_null())
        out = np.empty(len(words), np.int64)
        out[~rare] = self.numbers[np.asarray(at.drop_null())]
        classes = classes_of(words.filter(pa.array(rare)))
        out[rare] = self.rest[classes]
        return out, rare, classes


def remainder(column: str, of: int):
    """crc32 of the id as text, modulo of."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def width_of(outputs: int) -> int:
    """Outputs in a group: output k is in group k // width."""
    return math.isqrt(max(0, outputs - 1)) + 1


class Parameters:
    """One matrix of rows (a vector and a bias): contexts at two positions (their biases stay 0), outputs within their groups, groups."""

    def __init__(self, outputs: int, unigram: np.ndarray, seed: int = 5):
        n, self.width = outputs, width_of(outputs)
        mass = np.add.reduceat(unigram, np.arange(0, n, self.width))
        self.at = np.cumsum([0, n + 1, n + 1, n, len(mass)])
        self.rows = np.zeros((self.at[-1], SIZE + 1), np.float32)
        self.rows[:, :SIZE] = np.random.default_rng(seed).normal(0, 0.1, (self.at[-1], SIZE))
        self.rows[self.at[2] : self.at[3], SIZE] = np.log(unigram / np.repeat(mass, self.width)[:n])
        self.rows[self.at[3] :, SIZE] = np.log(mass / mass.sum())

    def context(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The sums of two contexts' vectors, and a 1 that meets an output's bias in products of whole rows."""
        out = self.rows.take(u, 0)
        out += self.rows[self.at[1] : self.at[2]].take(v, 0)
        out[:, SIZE] = 1
        return out

    def group_rows(self) -> np.ndarray:
        return self.rows[self.at[3] :]

    def rows_within(self, group: int) -> np.ndarray:
        first = self.at[2] + group * self.width
        return self.rows[first : min(first + self.width, self.at[3])]

    def flat(self) -> np.ndarray:
        return self.rows.ravel().copy()

    def load(self, flat: np.ndarray) -> Parameters:
        self.rows[...] = flat.reshape(self.rows.shape)
        return self


class Trainer:
    def __init__(self, p: Parameters, unigram: np.ndarray, seed: int):
        self.p, self.rng, n = p, np.random.default_rng(seed), len(unigram)
        starts = range(0, n, p.width)
        mass = np.add.reduceat(unigram, np.array(starts))
        #: Where a table of outputs starts (first row, rows), and its noise: of the groups, and of each group's own outputs.
        self.groups = (p.at[3], p.group_rows(), *self._noise(mass))
        self.within = [(p.at[2] + a, p.rows_within(g), *self._noise(unigram[a : a + p.width])) for g, a in enumerate(starts)]
        self.squares = np.full((len(p.rows), 2), FIRST_SQUARE, np.float32)
        #: Training tokens that each row stood for.
        self.seen = np.zeros(len(p.rows), np.float32)

    @staticmethod
    def _noise(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(mass / mass.sum()), np.log(NOISE * mass / mass.sum()).astype(np.float32)

    def _move(self, first: int, at: np.ndarray, grads: np.ndarray, n: int) -> None:
        """Only rows that occur move, by their own sums of squares."""
        order = np.argsort(at.astype(np.uint16) if len(self.p.rows) < 1 << 16 or int(at.max()) < 1 << 16 else at, kind="stable")  # short keys sort by digits
        at = at.take(order)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        rows, g = first + at.take(starts), np.add.reduceat(grads.take(order, 0), starts, axis=0)
        g /= np.float32(n)
        own = self.squares.take(rows, 0)
        own[:, 0] += np.einsum("ij,ij->i", g[:, :SIZE], g[:, :SIZE]) * np.float32(BATCH / SIZE)
        own[:, 1] += g[:, SIZE] ** 2 * BATCH
        self.squares[rows] = own
        rate = np.float32(RATE * np.sqrt(n) / 16) / np.sqrt(own)
        g[:, :SIZE] *= rate[:, :1]
        g[:, SIZE] *= rate[:, 1]
        self.p.rows[rows] = self.p.rows.take(rows, 0) - g

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, table: tuple) -> None:
        """One pass over a batch: contexts u and v, outputs w of a table."""
        p, n = self.p, len(w)
        first, q, cumulative, ln_noise = table
        context, target = p.context(u, v), q.take(w, 0)
        noise = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE)), len(cumulative) - 1)
        q_noise = q.take(noise, 0)
        false = context @ q_noise.T
        false -= ln_noise[noise]
        np.negative(false, out=false)
        np.exp(false, out=false)
        false += 1
        np.reciprocal(false, out=false)
        d_real = 1 / (1 + np.exp(ln_noise.take(w) - np.einsum("ij,ij->i", context, target))) - 1
        target *= d_real[:, None]
        target += false @ q_noise
        target[:, SIZE] = 0
        d_noise = false.T @ context
        context *= d_real[:, None]
        self._move(0, u, target, n)
        self._move(p.at[1], v, target, n)
        self._move(first, np.concatenate([w, noise]), np.concatenate([context, d_noise]), n)

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        """Batches of tokens for the groups, then batches of each group's tokens for its outputs."""
        order, width, at = self.rng.permutation(len(w)), self.p.width, self.p.at
        u, v, w = u.take(order), v.take(order), w.take(order)
        group = w // width
        for first, x in ((0, u), (at[1], v), (at[2], w), (at[3], group)):
            n = np.bincount(x)
            self.seen[first : first + len(n)] += n
        for a in range(0, len(w), BATCH):
            k = slice(a, a + BATCH)
            self.step(u[k], v[k], group[k], self.groups)
        order, bounds = by_group(group, len(self.within))
        u, v, place = u.take(order), v.take(order), (w % width).take(order)
        for g in self.rng.permutation(len(self.within)):
            for a in range(bounds[g], bounds[g + 1], BATCH):
                k = slice(a, min(a + BATCH, bounds[g + 1]))
                self.step(u[k], v[k], place[k], self.within[g])


def by_group(group: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of tokens by group, and where each group starts and ends in it."""
    order = np.argsort(group.astype(np.uint16) if groups <= 1 << 16 else group, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(group, minlength=groups))])


class Scorer:
    """Log-probabilities of outputs under two contexts: of the group, and of the output in its group, each with its exact normaliser."""

    def __init__(self, flat: np.ndarray, outputs: int):
        self.p = Parameters(outputs, np.ones(outputs)).load(flat)
        longest = lambda q: float(np.sqrt(np.einsum("ij,ij->i", q, q, dtype=np.float64).max()))
        tables = [self.p.rows_within(g) for g in range(self.p.at[4] - self.p.at[3])]
        #: The transposed rows of the groups, and of each group's outputs, with the length of the longest row.
        self.groups, *self.within = [(np.ascontiguousarray(q.T), longest(q)) for q in (self.p.group_rows(), *tables)]

    @staticmethod
    def _of(context: np.ndarray, reach: float, table: tuple[np.ndarray, float], w: np.ndarray | int) -> np.ndarray:
        """Of outputs w of the table; no context is longer than reach, so no score is above SAFE in size unless the product is."""
        s = context @ table[0]
        if reach * table[1] > SAFE:
            s -= s.max(1)[:, None]
        own = s[np.arange(len(s)), w].astype(np.float64)
        np.exp(s, out=s)
        return own - np.log(s.sum(1))

    def __call__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        p, out = self.p, np.empty(len(w))
        group = w // p.width
        order, bounds = by_group(group, len(self.within))
        u, v, place = u.take(order), v.take(order), (w % p.width).take(order)
        for g in range(len(self.within)):
            for a in range(bounds[g], bounds[g + 1], BATCH):
                k = slice(a, min(a + BATCH, bounds[g + 1]))
                context = p.context(u[k], v[k])
                reach = float(np.sqrt(np.einsum("ij,ij->i", context, context).max()))
                out[order[k]] = self._of(context, reach, self.groups, g) + self._of(context, reach, self.within[g], place[k])
        return out


@lru_cache(maxsize=1)
def scorer(flat: bytes, outputs: int) -> Scorer:
    return Scorer(np.frombuffer(flat, np.float32), outputs)


def contexts(ids: np.ndarray, lengths: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids one and two places before each token, of texts one after the other; before a text's start stands none."""
    starts = np.cumsum(lengths) - lengths
    u, v = np.empty_like(ids), np.empty_like(ids)
    u[1:], v[2:] = ids[:-1], ids[:-2]
    u[starts] = v[starts] = none
    v[(starts + 1)[lengths > 1]] = none
    return u, v


def word_counts(docs: DataFrame) -> DataFrame:
    """word binary, n long: of all tokens of docs (text)."""

    def summed(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for some in slices(batch, 0, SLICE_BYTES):
                held.append(tallied(some.column(0)))
                rows += held[-1].num_rows
                if rows > HELD_WORDS:
                    held = [summed(held)]
                    rows = held[0].num_rows
                if rows > HELD_WORDS // 2 and len(held) == 1:
                    yield from held[0].to_batches(max_chunksize=100_000)
                    held, rows = [], 0
        if held:
            yield from summed(held).to_batches(max_chunksize=100_000)

    return docs.select("text").mapInArrow(tidied(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def trained(train: DataFrame, vocabulary: Vocabulary, unigram: np.ndarray) -> np.ndarray:
    """Parameters after a pass over all training tokens; each row averaged over the tasks by the tokens it stood for there."""
    outputs = len(unigram)
    start = Parameters(outputs, unigram)
    n_rows = len(start.rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        trainer, held, size = Trainer(Parameters(outputs, unigram), unigram, task), [], 0
        for batch in batches:
            for some in slices(batch, 0, SLICE_BYTES):
                words, place, n = coded(some.column(0))
                ids = vocabulary(words)[0][place]
                held.append((*contexts(ids, n, outputs), ids))
                size += len(ids)
                if size > 50 * BATCH:
                    trainer.learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            trainer.learn(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows = np.flatnonzero(trainer.seen)
        bounds = np.searchsorted(rows, np.arange(0, len(trainer.seen) + PART, PART))
        for part, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if a < b:
                at, seen = rows[a:b], trainer.seen[rows[a:b]]
                yield packed(part, task % 64, at, seen, trainer.p.rows[at] * seen[:, None])

    def packed(part: int, task: int, at: np.ndarray, seen: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([task], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype(np.int64), seen.astype(np.float64), sums.astype(np.float32)))], ["part", "task", "at", "seen", "sums"])

    def add(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        size = min(PART, n_rows - part * PART)
        seen, sums = np.zeros(size), np.zeros((size, SIZE + 1))
        for a, n, x in zip(*(t.column(c).to_pylist() for c in ("at", "seen", "sums")), strict=True):
            at = np.frombuffer(a, np.int64) - part * PART
            seen[at] += np.frombuffer(n, np.float64)
            sums[at] += np.frombuffer(x, np.float32).reshape(len(at), SIZE + 1)
        at = np.flatnonzero(seen)
        return pa.Table.from_batches([packed(part, 0, at + part * PART, seen[at], sums[at])])

    schema = "part int, task int, at binary, seen binary, sums binary"
    out = start.rows
    for r in train.select("text").mapInArrow(tidied(run), schema).groupBy("part", "task").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema).collect():
        at = np.frombuffer(bytes(r["at"]), np.int64)
        out[at] = np.frombuffer(bytes(r.sums), np.float32).reshape(len(at), SIZE + 1) / np.frombuffer(bytes(r.seen), np.float64)[:, None]
    return start.flat()


def score(docs: DataFrame, *, of: int = 5, held_out: int = 1, vocabulary_size: int = VOCABULARY, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every document."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    train = own.where(remainder("doc_id", of) != held_out)
    counts = written(word_counts(train), "word-counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    often = counts.where(F.col("n") >= max(least, math.isqrt(n_all) // ROOT))
    top = {bytes(r.word): r.n for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary_size).union(often).collect()}
    numbers, rest = numbered(top)
    vocabulary, outputs = Vocabulary(numbers, rest), len(numbers) + CLASSES

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rare, classes = vocabulary(batch.column(0))
            n = np.bincount(classes, batch.column(1).to_numpy()[rare], minlength=CLASSES).astype(np.float64)
            kinds = np.bincount(classes, minlength=CLASSES).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n), pa.array(kinds)], ["class", "n", "kinds"])

    mass, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.mapInArrow(classed, "class int, n double, kinds double").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        mass[r["class"]], kinds[r["class"]] = r.n, r.kinds
    unigram = np.empty(outputs)
    unigram[[numbers[w] for w in top]], unigram[rest] = list(top.values()), mass + 0.5
    unigram /= unigram.sum()
    flat = trained(train, vocabulary, unigram).tobytes()
    ln_class = np.log(mass + 0.5 * kinds + 0.5)
    base_of = n_all + 0.5 * (v_all + 1)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def distinct(key: tuple, t: pa.Table) -> pa.Table:
        words = pa.concat_arrays([pa.array([], pa.binary()), *(distinct_words(some.column(0)) for batch in t.select(["text"]).to_batches() for some in slices(batch, 0, SLICE_BYTES))]).unique()
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(words), pa.int64()), "word": words})

    def scores(t: pa.Table, dictionary: pa.Table) -> pa.Table:
        one_thread()
        words, c = dictionary.column("word").cast(pa.binary()).combine_chunks(), dictionary.column("n").to_numpy().astype(np.float64)
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        out, rare, form = vocabulary(words)
        within = np.zeros(len(words))
        within[rare] = np.log(c[rare] + 0.5) - ln_class[form]
        base = np.log10((c + 0.5) / base_of)
        model, rows = scorer(flat, outputs), []
        for batch in t.select(["text"]).to_batches():
            for some in slices(batch, 0, SLICE_BYTES):
                units, at, n = coded(some.column(0))
                at = np.asarray(pc.index_in(units, words))[at]
                ids, starts = out[at], np.cumsum(n) - n
                own = model(*contexts(ids, n, outputs), ids) + within[at]
                sums = (np.add.reduceat(x, starts) for x in ((c[at] > 0).astype(np.int64), base[at], own))
                rows += zip(n.tolist(), *(x.tolist() for x in sums), strict=True)
        n, known, b, s = zip(*rows, strict=True) if rows else ((), (), (), ())
        s = np.array(s, np.float64) / np.log(10)
        return pa.Table.from_arrays([t.column("doc_id"), t.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array([n_all] * len(rows), pa.int64()), pa.array(b, pa.float64()), pa.array(s, pa.float64())], names)

    chunked = dealt(own).withColumn("held_out", remainder("doc_id", of) == held_out)
    asked = chunked.groupBy("chunk").applyInArrow(distinct, "chunk long, word binary")
    dictionary = asked.join(counts, "word", "left").select("chunk", "word", F.coalesce("n", F.lit(0)).alias("n"))
    kind = dict(own.dtypes)["doc_id"]
    return chunked.groupBy("chunk").cogroup(dictionary.groupBy("chunk")).applyInArrow(scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
