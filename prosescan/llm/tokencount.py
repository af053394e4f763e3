"""Exact token counts at every prefix of a text, by dynamic programming over its words.

A SentencePiece BPE model turns a space into the word mark and merges neighbouring symbols only where the merged
piece is in its table. Where no piece of the table holds the mark anywhere but in a leading run, no merge crosses
the place before a mark, so counts add up over words:

    count(prefix) = sum of counts of its whole words + count(of the word begun)

``PrefixCounts.within`` fills the counts at each prefix of a word from those at shorter ones; words are taken in sorted
order, so the programme goes on from the beginning that a word shares with the one before, and the counts of words met
are kept. A text's table (the count at each of its prefixes) is then gathered from its words' tables and their running
sums. The whole text's count is its last entry; how much of the text a budget holds is a look-up in it; no text is encoded.

Scale: one pass, no shuffle; a worker holds the counts of REMEMBERED words at most and the tables of a slice of SLICE_BYTES
of text (or of one longer text).

Defined cases: null texts count as empty; empty texts have no tokens; equal texts have equal counts; very long texts and
words are handled whole; repeated rows are counted each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosescan.llm.common import slices

MARK = "▁"
#: Distinct words whose counts a worker remembers; bytes of text whose tables are made at once.
REMEMBERED, SLICE_BYTES = 800_000, 6_000_000


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def separable(path: str) -> bool:
    """Whether marks occur in pieces only as a leading run, and the text is otherwise taken as it is."""
    model = processor(path)
    ordinary = all(MARK not in model.id_to_piece(i).lstrip(MARK) for i in range(model.get_piece_size()))
    probe = "a  b\tＡ① \n c "
    return ordinary and model.decode(model.encode(probe)) == probe


class PrefixCounts:
    """Token counts of every code-point prefix of texts under one model."""

    def __init__(self, path: str):
        self.model = processor(path)
        if not separable(path):
            raise ValueError("pieces of this model cross word starts")
        self.pieces = {self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.unit = re.compile(f"{MARK}+[^{MARK}]*")
        self.pair = lru_cache(maxsize=1_000_000)(self._pair)
        #: Pieces that the model leaves whole.
        self.whole = {p for p in self.pieces if self._inside(p) == [p]}
        self.longest_piece = max(map(len, self.whole))
        self._forget()

    def _forget(self) -> None:
        #: Words by number, and their counts at each prefix (of one character and more), one word after the other.
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        self.starts, self.lengths = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)

    def _units(self, text: str) -> list[str]:
        return self.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def _learn(self, units: set[str]) -> None:
        """Fills the tables of words not met yet, each from the beginning that it shares with the one before in sorted order."""
        fresh = sorted(u for u in units if u not in self.known)
        if len(self.known) + len(fresh) > len(self.starts):
            if self.known:
                self._forget()
                fresh = sorted(units)
            if len(fresh) > len(self.starts):
                self.starts, self.lengths = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        room = self.used + sum(map(len, fresh))
        if room > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(room, 2 * len(self.flat)) - self.used, np.uint16)])
        first = len(self.known)
        lengths = np.fromiter(map(len, fresh), np.int64, len(fresh))
        self.lengths[first : first + len(fresh)] = lengths
        self.starts[first : first + len(fresh)] = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        counts, last, own = [0], [""], []
        for unit, same in zip(fresh, self._shared(fresh), strict=True):
            del counts[same + 1 :], last[same + 1 :]
            self._extend(unit, counts, last)
            own += counts[1:]
        if own and max(own) > 65535 and self.flat.dtype == np.uint16:
            self.flat = self.flat.astype(np.uint32)
        self.flat[self.used : room], self.used = own, room

    @staticmethod
    def _shared(words: list[str], look: int = 16) -> list[int]:
        """How many characters (of the first few) each word shares with the one before."""
        if not words:
            return []
        codes = np.array(words, f"U{look}").view(np.uint32).reshape(len(words), look)
        same = (codes[1:] == codes[:-1]) & (codes[1:] != 0)
        return [0, *np.where(same.all(1), look, same.argmin(1)).tolist()]

    def tables(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The counts at every prefix (of one code point and more) of all texts, one after the other, and the texts' lengths."""
        own = [self._units(t) for t in texts]
        self._learn({u for units in own for u in units})
        known = self.known
        place = np.array([known[u] for units in own for u in units], np.int64)
        n_units = np.array([len(units) for units in own], np.int64)
        sizes, first = self.lengths[place], self.starts[place]
        totals = self.flat[first + sizes - 1].astype(np.int64) if len(place) else sizes
        ends = np.cumsum(totals)
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n_units)])]
        base = ends - totals - np.repeat(stops[:-1], n_units)
        opening = (np.cumsum(n_units) - n_units)[n_units > 0]  # the mark put before a text is no character of it
        first[opening] += 1
        sizes[opening] -= 1
        upto = np.cumsum(sizes)
        at = np.repeat(first - upto + sizes, sizes)
        at += np.arange(len(at))
        table = self.flat[at] + np.repeat(base, sizes)
        return table, np.diff(np.concatenate([[0], upto])[np.concatenate([[0], np.cumsum(n_units)])])

    def _pieces_of(self, unit: str) -> list[str]:
        return self.model.encode(unit, out_type=str) if not unit.startswith(MARK) else [MARK] if unit == MARK else self.model.encode(unit[1:], out_type=str)

    def _inside(self, part: str) -> list[str]:
        """Pieces of a part of a unit that needn't begin with a mark: behind a line feed nothing merges with it."""
        if part.startswith(MARK):
            return self._pieces_of(part)
        return self.model.encode("\n" + part, out_type=str)[2:]

    def _pair(self, left: str, right: str) -> bool:
        return self._inside(left + right) == [left, right]

    def _extend(self, unit: str, counts: list[int], last: list[str]) -> None:
        """Goes on with the counts at prefixes of a unit and the last piece of each. That is the piece whose pair with the last
        piece of what is before it the model leaves as it is, so each prefix follows from shorter ones."""
        whole, pair, longest = self.whole, self.pair, self.longest_piece
        for end in range(len(counts), len(unit) + 1):
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if piece in whole and (not start or not (before := last[start]) or pair(before, piece)):
                    counts.append(counts[start] + 1)
                    last.append(piece)
                    break
            else:  # a character outside the table becomes its bytes, which nothing merges with
                counts.append(counts[-1] + len(unit[end - 1].encode("utf-8", "surrogatepass")))
                last.append("")

    def prefixes(self, text: str) -> list[int]:
        """The count of every prefix, from the empty one to the whole text."""
        return [0, *self.tables([text])[0].tolist()]

    def at(self, text: str, length: int) -> int:
        """Tokens of text[:length]."""
        return self.prefixes(text)[length]

    def longest(self, text: str, budget: int) -> int:
        """Code points of the longest prefix such that it and every shorter one has at most budget tokens."""
        return int(fitting(*self.tables([text]), budget)[0])


def fitting(table: np.ndarray, lengths: np.ndarray, budget: int) -> np.ndarray:
    """Code points of each text's longest prefix such that it and every shorter one has at most budget tokens."""
    ends = np.cumsum(lengths)
    over = np.append(np.flatnonzero(table > budget), len(table))
    first = over[np.searchsorted(over, ends - lengths)]
    return np.minimum(first - ends + lengths, lengths)


@lru_cache(maxsize=1)
def prefix_counts(path: str) -> PrefixCounts:
    """One for all tasks of a worker, so that words stay known."""
    return PrefixCounts(path)


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fits_chars (code points that limit tokens hold) of every text, read off its table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(model_path)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                texts = [t or "" for t in some.column(1).to_pylist()]
                table, lengths = counts.tables(texts)
                n_tokens = np.concatenate([[0], table])[np.cumsum(lengths)] * (lengths > 0)
                n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit), pa.array(fitting(table, lengths, limit), pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fits_chars long")


def prefix_tables(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts: the token count at every prefix of the text, from the empty one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = prefix_counts(model_path)
        for batch in batches:
            for some in slices(batch, 1, SLICE_BYTES):
                table, lengths = counts.tables([t or "" for t in some.column(1).to_pylist()])
                own = np.insert(table, np.cumsum(lengths) - lengths, 0)
                ends = np.concatenate([[0], np.cumsum(lengths + 1)])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32()))], ["doc_id", "counts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, counts array<int>")


def tokens_of_prefix(counts: Column, length: Column | int) -> Column:
    """From a table of prefix_tables: tokens of the text cut to that many code points."""
    return F.get(counts, F.least(F.lit(length), F.size(counts) - 1).cast("int"))


def chars_within(counts: Column, budget: int) -> Column:
    """From a table of prefix_tables: code points of the longest prefix with at most budget tokens, as shorter ones have."""
    over = F.array_position(F.transform(counts, lambda c: c > budget), True)
    return F.when(over > 0, over - 2).otherwise(F.size(counts) - 1).cast("long")
