"""Document fingerprints by consistent weighted sampling.

The terms of a text are its lower-cased words, weighted by their number of occurrences. For each of ``SAMPLES``
samples a term with weight w draws, from its own hash, r and c from Gamma(2, 1) and b from the unit interval, and

    t = floor(ln w / r + b),   ln a = ln c - r (t - b + 1)

The term with the least ``a`` is sampled together with t. Two texts agree in a sample with the probability that is
their generalised Jaccard similarity, sum of minima over sum of maxima of the weights. A fingerprint holds 16 bits of
each sample, in hexadecimal; the share of equal samples estimates the similarity.

Defined cases: null texts count as empty; a text without words has the fingerprint of zeros, and is like another such
text; equal texts have equal fingerprints; texts of any length are read whole; rows of one id (or of none,
which come last) are ordered by a hash of their text.

Scale: a document's terms are held by its task alone; see neighbours for how documents meet the next ones.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import text_of
from prosescan.llm.neighbours import in_descending_ranges

SAMPLES = 64
#: Terms whose draws a worker keeps, and documents that it works on at once.
REMEMBERED, AT_ONCE = 50_000, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(hashes: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term (row) and sample (column)."""
    step = np.arange(1, 3 * samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = _mix(hashes[:, None] + step[None, :])
    scale = np.float32(2.0**-32)
    high = ((bits >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * scale
    low = ((bits & np.uint64(0xFFFFFFFF)).astype(np.float32) + np.float32(0.5)) * scale
    k = samples
    r = -(np.log(high[:, :k]) + np.log(low[:, :k]))
    c = -(np.log(high[:, k : 2 * k]) + np.log(low[:, k : 2 * k]))
    tiny = np.float32(1e-30)
    return np.maximum(r, tiny), np.log(np.maximum(c, tiny)), np.minimum(high[:, 2 * k :], np.float32(1 - 2.0**-24))


class Sampler:
    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.rows: dict[str, int] = {}
        self._room(REMEMBERED + 20_000)

    def _room(self, n: int) -> None:
        old = getattr(self, "hash", np.empty(0, np.uint64))
        shape = (n, self.samples)
        new = [np.empty(n, np.uint64), *(np.empty(shape, np.float32) for _ in range(4))]
        if len(old):
            for a, b in zip(new, (self.hash, self.r, self.c, self.b, self.once), strict=True):
                a[: len(b)] = b
        self.hash, self.r, self.c, self.b, self.once = new

    def _place(self, bags: list[Counter]) -> dict[str, int]:
        """Rows of all terms of the bags; those in two bags at least stay for later calls while there is room."""
        seen = Counter(t for bag in bags for t in bag)
        fresh = [t for t in seen if t not in self.rows]
        fresh.sort(key=lambda t: seen[t] < 2)
        start = len(self.rows)
        keep = min(sum(seen[t] > 1 for t in fresh), max(0, REMEMBERED - start))
        if start + len(fresh) > len(self.hash):
            self._room(start + len(fresh) + 10_000)
        hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in fresh], np.uint64)
        for a in range(0, len(fresh), 2048):
            at = slice(start + a, start + min(len(fresh), a + 2048))
            h = hashes[a : a + 2048]
            r, c, b = draws(h, self.samples)
            self.hash[at], self.r[at], self.c[at], self.b[at], self.once[at] = h, r, c, b, c - r * (1 - b)
        self.rows.update((t, start + k) for k, t in enumerate(fresh[:keep]))
        return {t: start + keep + k for k, t in enumerate(fresh[keep:])}

    def fingerprints(self, bags: list[Counter]) -> list[np.ndarray]:
        more = self._place(bags)
        rows, out = self.rows, []
        columns = np.arange(self.samples)
        for bag in bags:
            if not bag:
                out.append(np.zeros(self.samples, np.uint16))
                continue
            at = np.array([rows[t] if t in rows else more[t] for t in bag])
            w = np.fromiter(bag.values(), np.float32, len(bag))
            ln_a = self.once[at]
            often = np.flatnonzero(w > 1)
            t = np.zeros((len(at), self.samples), np.float32) if len(often) else None
            if len(often):
                r, b = self.r[at[often]], self.b[at[often]]
                t_often = np.floor(np.log(w[often])[:, None] / r + b)
                ln_a[often] = self.c[at[often]] - r * (t_often - b + 1)
                t[often] = t_often
            best = ln_a.argmin(axis=0)
            picked = t[best, columns] if t is not None else np.zeros(self.samples, np.float32)
            mixed = _mix(self.hash[at[best]] + picked.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out.append((mixed >> np.uint64(48)).astype(np.uint16))
        return out


def terms(text: str) -> Counter:
    return Counter(text.lower().split())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def fingerprint_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, AT_ONCE):
                out += map(as_text, sampler.fingerprints([terms(t or "") for t in batch.column(1).slice(a, AT_ONCE).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, fingerprint string")


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last third comes from the start of the next document."""
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        last = None  # range, id, text and fingerprint of the row before, if what comes next isn't known yet

        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                some = [c.to_pylist() for c in batch.slice(a, AT_ONCE).columns]
                prints = sampler.fingerprints([terms(t) for t in some[3]])
                pairs = []
                for of, guest, doc, text, mark in zip(*some, prints, strict=True):
                    if last and last[0] == of:
                        pairs.append((*last[1:], text, mark))
                    last = None if guest else (of, doc, text, mark)
                    # Further guests of a range find no row before them.
                edited = []
                for _, text, _, after, _ in pairs:
                    cut = len(text) // 3
                    edited.append(text[: len(text) - cut] + after[:cut])
                marks = sampler.fingerprints([terms(t) for t in edited])
                rows = [(doc, len(text), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own), as_text(m), likeness(own, m), likeness(own, other)) for (doc, text, own, _, other), e, m in zip(pairs, edited, marks, strict=True)]
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return in_descending_ranges(own).mapInArrow(run, fields)
