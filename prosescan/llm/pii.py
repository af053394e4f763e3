"""Personal data: base patterns, and candidates that boosted trees accept.

Base spans (email, ip, card, phone) follow fixed patterns, leftmost and non-overlapping per kind; a match that fails its
test is dropped without a retry. Beyond them, high-recall generators propose spans of the same kinds in other forms
(spelled-out or bracketed separators, numbers without a plus sign, cards with other separators, IPv6). Proposals may
overlap each other. Boosted trees see format and context features of each; per kind, the least probability at which
held-out proposals are right often enough (PRECISION) is the threshold. Accepted proposals that overlap neither a base
span nor a likelier accepted one are added. No labelled personal data exists, so the trees are trained on proposals
from sentences made by a seeded generator, with hard negatives (dates, versions, order numbers, sums, hashes).

Defined cases: null texts count as empty; an empty text has no spans; equal texts have equal spans; texts of any
length are read whole in one pass per pattern; offsets are code points, ends exclusive; find reads no other columns, and
redacted_documents passes them untouched.

Scale: one pass over the texts, no shuffle; a task holds SLICE_BYTES of text at once, or one text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosescan.llm.boosting import Boosting, Isotonic
from prosescan.llm.common import slices, tidied

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
#: Bytes of text worked on at once.
SLICE_BYTES = 4_000_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that starts in the middle of another matches where and only where the whole run does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """A match holds one @; what stands before it, back to the end of the last match, decides where it starts."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                end = m.end()
                out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(small, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(only_digits(m.group())) <= 15]
    return out


AT, DOT = r"(?:@|[\[({<] ?(?:at|AT|@) ?[\])}>]| at | AT )", r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT )"
GENERATORS = (
    ("email", re.compile(rf"[^\W_][\w.%+-]{{0,63}} ?{AT} ?[^\W_][\w-]{{0,62}}(?:{DOT}[^\W_][\w-]{{0,62}}){{1,5}}")),
    ("ip", re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot ) ?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{3,6}(?:[ ._/-]{1,3}[0-9]{2,7}){2,5}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.])[0-9]{9,12}(?![0-9A-Za-z])")),
)
#: The rest of the first generator from its separator on: cheap to look for, and within each of its matches.
SPELLED = re.compile(rf"{AT} ?[^\W_][\w-]{{0,62}}{DOT}[^\W_]")
#: Words near a proposal, per kind and against all of them.
CONTEXT = {
    "email": frozenset("email mail e-mail contact write reach address correo courriel adresse".split()),
    "ip": frozenset("ip server host address node gateway dns ping network subnet".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte cc".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell dial whatsapp number telefon téléphone teléfono".split()),
    "none": frozenset("order invoice version release date isbn page id no ref serial build section figure chapter year total price usd eur sku item tracking batch commit hash".split()),
}
WORD = re.compile(r"[^\W\d_][\w-]*")


def proposals(text: str) -> list[tuple[str, int, int, int]]:
    """Kind, start, end and generator."""
    digits, spelled = bool(DIGIT.search(text)), bool(SPELLED.search(text))
    out = []
    for g, (kind, pattern) in enumerate(GENERATORS):
        if spelled if g == 0 else digits:
            out += [(kind, *m.span(), g) for m in pattern.finditer(text)]
    return out


def describe(text: str, kind: str, a: int, b: int, generator: int) -> list[float]:
    span, before, after = text[a:b], text[max(0, a - 60) : a], text[b : b + 40]
    digits = only_digits(span)
    groups = re.findall(r"[0-9]+", span)
    parts = re.split(r"[^0-9A-Za-z]+", span)
    near = [w.lower() for w in WORD.findall(before)[-4:]] + [w.lower() for w in WORD.findall(after)[:2]]
    marks = {c for c in span if not c.isalnum()}
    year = sum(len(g) == 4 and g[:2] in ("19", "20") for g in groups)
    numbers = [int(g[:9]) for g in groups]
    return [
        float(KINDS.index(kind)), float(generator), len(span), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), len(marks), year,
        float(luhn(digits)) if digits else 0.0, sum(n > 255 for n in numbers), float(len(groups) == 3 and len(groups[1]) <= 2 and len(groups[2]) <= 2 or len(groups) == 3 and len(groups[0]) <= 2 and len(groups[1]) <= 2),
        float(digits[:2] in ("34", "37", "51", "52", "53", "54", "55") or digits[:1] == "4"), float(len(groups) == 4 and {len(g) for g in groups} == {4}), float("@" in span), span.count("."), float(" " in span),
        len(parts[-1]) if parts else 0, float(parts[-1].isalpha()) if parts else 0.0, float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ("#", "$", "€", "/", "=", "v", "_")), float(after[:1] in ("%", "/", "=", "_", "-")),
        float("(" in span), float(span.startswith("00")), *(sum(w in words for w in near) for words in CONTEXT.values()), sum(c.isalpha() for c in span) / len(span),
    ]


def _sentences(n: int, seed: int) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """Made texts: the text, the kind and where that personal data is (nowhere in hard negatives)."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick(*"bcdfglmnprst") + pick(*"aeiou") for _ in range(rng.integers(1, 4)))
    num = lambda k: "".join(str(rng.integers(10)) for _ in range(k))

    def card() -> str:
        d = pick("4", "51", "37", "6011") + num(15)
        d = d[: pick(15, 16, 16, 16)]
        return next(d[:-1] + str(k) for k in range(10) if luhn(d[:-1] + str(k)))

    def item() -> tuple[str, str, bool]:
        dot, at = pick(" dot ", "[.]", " [dot] ", "(dot)", "."), pick(" at ", " [at] ", "(at)", " (at) ", "@", "[@]")
        octet = lambda: str(rng.integers(1, 255))
        sep = pick(" ", "-", ".", "/", " - ")
        c = card()
        made = (
            ("email", word() + pick("", ".", "_", "-") + word() + at + word() + dot + pick("com", "org", "net", "de", "fr"), True),
            ("ip", pick("[.]", "(.)", " dot ", "[dot]", " . ").join(octet() for _ in range(4)), True),
            ("ip", ":".join(f"{rng.integers(65536):x}" for _ in range(8)), True),
            ("card", sep.join(c[k : k + 4] for k in range(0, len(c), 4)) if len(c) == 16 else sep.join((c[:4], c[4:10], c[10:])), True),
            ("card", c, True),
            ("phone", f"({num(3)}) {num(3)}-{num(4)}", True),
            ("phone", pick("-", ".", " ").join((pick("2", "3", "5", "7") + num(2), num(3), num(4))), True),
            ("phone", "00" + num(2) + " " + num(3) + " " + num(3) + " " + num(3), True),
            ("phone", pick("0", "1") + num(10), True),
            ("none", f"{word()} at {word()} dot {word()}", False), ("none", f"{word()} at {word()}. {word().title()}", False),
            ("none", f"{rng.integers(1980, 2030)}-{rng.integers(1, 13):02}-{rng.integers(1, 29):02}", False), ("none", f"{rng.integers(1, 29):02}/{rng.integers(1, 13):02}/{rng.integers(1980, 2030)}", False),
            ("none", f"{rng.integers(10)}.{rng.integers(20)}.{rng.integers(300)}.{rng.integers(300, 9999)}", False), ("none", num(pick(9, 10, 12, 13, 16, 18)), False), ("none", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", False),
            ("none", f"{rng.integers(1, 23):02}:{num(2)}:{num(2)}", False), ("none", f"{num(2)} {num(3)} {num(3)}", False), ("none", f"{rng.integers(1980, 2010)}-{rng.integers(2010, 2030)}", False),
            ("none", " ".join(str(rng.integers(10, 99999)) for _ in range(pick(3, 4, 5))), False), ("none", "-".join((num(3), num(5), num(2), num(6))), False), ("none", ":".join(f"{rng.integers(256):02x}" for _ in range(pick(6, 4))), False),
            ("none", "-".join((num(4), num(4), num(4), num(4))), False), ("none", f"{num(2)}.{num(2)}.{num(2)}", False),
        )
        return made[rng.integers(9) if rng.random() < 0.5 else rng.integers(9, len(made))]

    for _ in range(n):
        kind, value, real = item()
        hints = CONTEXT[kind if real else "none" if rng.random() < 0.7 else pick(*KINDS)]
        lead = [word() for _ in range(rng.integers(2, 7))] + ([pick(*sorted(hints))] if rng.random() < 0.6 else [])
        text = " ".join(lead) + pick(" ", " ", ": ", " is ")
        start = len(text)
        text += value + pick(" ", ". ", ", ", "") + " ".join(word() for _ in range(rng.integers(0, 6)))
        yield text, kind, [(start, start + len(value))] if real else []


class Judge:
    """The trees, their calibration and the thresholds."""

    def __init__(self, sentences: int = 4000, seed: int = 7):
        x, y, kinds = [], [], []
        for text, kind, real in _sentences(sentences, seed):
            for k, a, b, g in proposals(text):
                x.append(describe(text, k, a, b, g))
                y.append(k == kind and (a, b) in real)
                kinds.append(k)
        x, y, kinds = np.array(x), np.array(y), np.array(kinds)
        part = np.arange(len(y)) % 4
        self.trees = Boosting(trees=60, depth=4).fit(x[part < 2], y[part < 2])
        self.isotonic = Isotonic().fit(self.trees.margin(x[part == 2]), y[part == 2].astype(float))
        p, right, of = self.isotonic(self.trees.margin(x[part == 3])), y[part == 3], kinds[part == 3]
        self.thresholds = {}
        for k in KINDS:
            order = np.argsort(-p[of == k], kind="stable")
            found, at = right[of == k][order], p[of == k][order]
            good = np.flatnonzero(np.cumsum(found) / np.arange(1, len(found) + 1) >= PRECISION)
            self.thresholds[k] = max(0.5, float(at[good[-1]])) if len(good) else 1.1

    def accepted(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans that the method adds to the base ones."""
        taken = [(a, b) for _, a, b in base]
        free = [c for c in proposals(text) if not any(c[1] < b and a < c[2] for a, b in taken)]
        if not free:
            return []
        p = self.isotonic(self.trees.margin(np.array([describe(text, *c) for c in free])))
        out = []
        for k in sorted(range(len(free)), key=lambda k: (-p[k], free[k][1], -free[k][2])):
            kind, a, b, _ = free[k]
            if p[k] >= self.thresholds[kind] and not any(a < e and s < b for _, s, e in out):
                out.append((kind, a, b))
        return out


@lru_cache(maxsize=1)
def judge() -> Judge:
    return Judge()


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes the name of its first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id, base counts, base_sha256 and spans; with redact also the redacted text."""
    model = judge()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *["redacted"] * redact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, 1, SLICE_BYTES)):
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                added = model.accepted(text, base)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added), *[redacted(text, base + added)] * redact))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] + [pa.string()] * redact
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = dict(docs.dtypes)[id_col]
    fields = [f"doc_id {kind}", *(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long", *["redacted string"] * redact]
    return docs.select(id_col, text_col).mapInArrow(tidied(run), ", ".join(fields))


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs with every found span replaced; n_chars, where there is one, follows the new text."""
    model = judge()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            for some in slices(batch, k, SLICE_BYTES):
                texts = [None if t is None else redacted(t, (base := base_spans(t)) + model.accepted(t, base)) for t in some.column(k).to_pylist()]
                columns = list(some.columns)
                columns[k] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, some.schema.names)

    out = docs.mapInArrow(tidied(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out
