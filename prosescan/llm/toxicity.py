"""Toxicity by gradient-boosted trees over dense features of a text, with isotonic calibration.

Features are densities of lexicon words, their closeness to second-person words, and rates of capitals, punctuation and
obfuscation (letters replaced by digits or signs, drawn-out letters, hits that only undoing such replacements gives).
Beside a short fixed lexicon there is one of words and word beginnings that labelled texts show to be much more frequent
in toxic ones. Learning uses labelled rows outside the held-out share only, at most FIT_ROWS of them, chosen by a hash of
the id, with one text each: the trees see each half of them with the lexicon that the other half gives; the calibration is fitted to margins
of trees that did not see the row (FOLDS folds); scoring uses the lexicon of both halves and trees of all rows. Labels, language, source and id are no features.

Defined cases: null texts count as empty; empty texts get the score that the trees give to zeros; rows without labels
are scored alike; of an id with several texts one is learned from; without labels of both kinds every score is the share of toxic labels smoothed; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.llm.boosting import Boosting, Isotonic
from prosescan.llm.common import slices, tidied

#: Labelled rows that are learned from at most.
FIT_ROWS = 20_000
REJECT = 0.7
#: Bytes of text scored at once.
SLICE_BYTES = 4_000_000
FOLDS = 3
INSULTS = frozenset("idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb ugly jerk fool imbecile freak creep garbage filth vermin pig coward liar hate kill die shut".split())
YOU = frozenset("you your yours yourself u ur ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split())
UNDO = str.maketrans("013457@$!*", "oieastasi_")
LENGTHS = (4, 5, 6)
NAMES = "words insults insult_rate learned learned_rate strongest kinds you_rate nearest near_share capitals shouted exclamations questions punctuation repeated digits mixed drawn_out undone odd".split()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Per code point under 0x3000: 0 other, 1 lower, 2 upper, 3 digit, 4 !, 5 ?, 6 punctuation, 7 space, 8 sign used for a letter."""
    out = np.zeros(0x3000, np.uint8)
    for k in range(0x3000):
        c = chr(k)
        out[k] = 7 if c.isspace() else 3 if c.isdigit() else 2 if c.isupper() else 1 if c.isalpha() else 4 if c == "!" else 5 if c == "?" else 8 if c in "@$*#" else 6 if not c.isalnum() and k > 32 else 0
    return out


@lru_cache(maxsize=1)
def to_space() -> dict[int, str]:
    return {k: " " for k in range(0x3000) if classes()[k] in (4, 5, 6, 7) and chr(k) not in "'’"}


def words_of(text: str) -> list[str]:
    """Lower-case words, cut at white space and punctuation; signs that stand for letters stay."""
    return text.lower().translate(to_space()).split()


def beginnings(word: str) -> list[str]:
    """What the learned lexicon looks up: the whole word, and its beginnings with a mark."""
    return [word, *(word[:k] + "-" for k in LENGTHS if len(word) > k)]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = words_of(text)
    n = len(words) or 1
    weights = {}
    for w in set(words):
        best = max([lexicon.get(b, 0.0) for b in beginnings(w)])
        if best:
            weights[w] = best
    odd = {w for w in set(words) if not w.isalpha() and any(c.isalpha() for c in w)}
    undone = {w for w in odd if (u := w.translate(UNDO)) != w and (u in INSULTS or any(b in lexicon for b in beginnings(u)))}
    hits = [k for k, w in enumerate(words) if w in INSULTS or w in weights or w in undone] if weights or undone or not INSULTS.isdisjoint(words) else []
    you = [k for k, w in enumerate(words) if w in YOU]
    gaps = [min((abs(h - y) for y in you[max(0, at - 1) : at + 1]), default=99) for h in hits for at in [int(np.searchsorted(you, h))]]
    learned = [weights[words[k]] for k in hits if words[k] in weights]
    insults = sum(words[k] in INSULTS for k in hits)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[np.minimum(codes, 0x2FFF)]
    count = np.bincount(kind, minlength=9)
    chars, letters = len(codes) or 1, count[1] + count[2] or 1
    letter, mark = (kind == 1) | (kind == 2), (kind >= 4) & (kind != 7)
    swapped = letter[:-2] & ((kind[1:-1] == 3) | (kind[1:-1] == 8)) & letter[2:]
    drawn = (codes[:-2] == codes[1:-1]) & (codes[1:-1] == codes[2:]) & letter[2:]
    shouted = (kind[:-2] == 2) & (kind[1:-1] == 2) & (kind[2:] == 2)
    return [
        math.log1p(len(words)), insults, insults / n, len(learned), sum(learned) / n, max(learned, default=0.0), len(weights), len(you) / n, min(gaps, default=99), sum(g <= 5 for g in gaps) / (len(hits) or 1),
        count[2] / letters, shouted.sum() / chars, count[4] / chars, count[5] / chars, (count[4] + count[5] + count[6] + count[8]) / chars, (mark[:-1] & mark[1:]).sum() / chars, count[3] / chars, swapped.sum() / n, drawn.sum() / n, len(undone), len(odd) / n,
    ]


def remainder(column: str, of: int) -> Column:
    """crc32 of the id as text, modulo of."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, fold: np.ndarray):
        self.lexicon, unseen = lexicon, np.zeros(len(y))
        for k in range(FOLDS) if len(set(y)) == 2 else ():
            unseen[fold == k] = Boosting(least=1.0).fit(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.trees = Boosting(least=1.0).fit(x, y)
        self.isotonic = Isotonic().fit(unseen, y) if len(set(y)) == 2 else Isotonic().fit(np.empty(0), np.empty(0))

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts], np.float64).reshape(len(texts), len(NAMES))
        return np.clip(self.isotonic(self.trees.margin(x)), 0.0, 1.0)


def learn(docs: DataFrame, labels: DataFrame, *, of: int = 3, held_out: int = 1, fit_rows: int = FIT_ROWS) -> Model:
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder("doc_id", of) != held_out))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .withColumn("key", F.md5(F.col("doc_id").cast("string")))
        .orderBy("key", "doc_id").limit(fit_rows)
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.conv(F.substring("key", -2, 2), 16, 10).cast("int").alias("part"))
    )
    # One text for each labelled id, the least by its hash, so that repeated ids don't pass the bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("toxic", "part", "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [Counter() for _ in range(4)]  # other and toxic of either half
            for is_toxic, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[2 * (part & 1) + bool(is_toxic)].update({"", *(b for w in set(words_of(text or "")) for b in beginnings(w))})
            keys = list(set().union(*seen))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in seen)], ["term", "n0", "n1", "n2", "n3"])

    sums = rows.mapInArrow(tidied(tally), "term string, n0 long, n1 long, n2 long, n3 long").groupBy("term").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
    found = {r.term: r[1:] for r in sums.where("term = '' or (n1 + n3 >= 3 and n1 + n3 >= n0 + n2)").collect()}
    totals = found.pop("", (0, 0, 0, 0))

    def lexicon_of(halves: tuple[int, ...]) -> dict[str, float]:
        count = lambda n, toxic: sum(n[2 * h + toxic] for h in halves)
        odds = {t: math.log((count(n, 1) + 0.5) / (count(totals, 1) + 1)) - math.log((count(n, 0) + 0.5) / (count(totals, 0) + 1)) for t, n in found.items() if count(n, 1) >= 3}
        return {t: v for t, v in odds.items() if v >= 2.5}

    other = {0: lexicon_of((1,)), 1: lexicon_of((0,))}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "", other[part & 1]) for part, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "part", "x"])

    seen = sorted(((r.part, r.toxic, *r.x) for r in rows.mapInArrow(tidied(look), "toxic int, part int, x array<double>").collect()))
    data = np.array(seen, np.float64).reshape(len(seen), 2 + len(NAMES))
    return Model(lexicon_of((0, 1)), data[:, 2:], data[:, 1] > 0, data[:, 0] // 2 % FOLDS)


def score(docs: DataFrame, labels: DataFrame, *, of: int = 3, held_out: int = 1, reject: float = REJECT) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = learn(docs, labels, of=of, held_out=held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                p = model.scores([t or "" for t in some.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(p), pa.array((p >= reject).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text", (remainder("doc_id", of) == held_out).alias("held_out")).mapInArrow(tidied(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def clean_documents(docs: DataFrame, labels: DataFrame, *, reject: float = REJECT, **options) -> DataFrame:
    """docs without those that are rejected: a score of reject or more."""
    model = learn(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for some in slices(batch, k, SLICE_BYTES):
                p = model.scores([t or "" for t in some.column(k).to_pylist()])
                yield some.filter(pa.array(p < reject))

    return docs.mapInArrow(tidied(run), docs.schema)
