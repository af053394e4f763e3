"""Token counts, token files, SentencePiece, fingerprints and personal data against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash

from prosescan.llm import fingerprints, lattice, neighbours, pii, tokencount, tokenfile

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def test_token_counts(docs, no_docs):
    library = tokencount.processor(PIECES)
    for r, t in zip(*(x.orderBy("doc_id", "n_bytes").collect() for x in [tokencount.count_tokens(docs, PIECES)]), docs.selectExpr("doc_id", "coalesce(text, '') as text", "octet_length(coalesce(text, '')) as n_bytes").orderBy("doc_id", "n_bytes").collect(), strict=True):
        n = len(library.encode(t.text))
        assert (r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) == (t.doc_id, len(t.text.encode()), n, n > 4096)
    assert tokencount.count_tokens(no_docs, PIECES).count() == 0


def test_prefix_counts_and_budgets():
    library, counts, rng = tokencount.processor(PIECES), tokencount.PrefixCounts(PIECES), random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice(["in", "the", " ", "  ", "\n", "é", "日", "▁", "<s>", ".", "token"]) for _ in range(rng.randint(0, 15)))
        want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert counts.prefixes(text) == want
        budget = rng.randint(0, 12)
        assert counts.longest(text, budget) == next((k - 1 for k, n in enumerate(want) if n > budget), len(text))


def test_prefix_tables_of_documents(docs, real, no_docs):
    """The table's entries at cuts of whole documents, its budgets and the query's columns against the library."""
    library, rng = tokencount.processor(PIECES), random.Random(6)
    texts = [t or "" for t, in docs.unionByName(real.limit(30), allowMissingColumns=True).select("text").collect()]
    table, lengths = tokencount.PrefixCounts(PIECES).tables(texts)
    assert lengths.tolist() == [len(t) for t in texts]
    ends = np.cumsum(lengths)
    for text, a, b in zip(texts, (ends - lengths).tolist(), ends.tolist(), strict=True):
        for k in {len(text), *(rng.randint(0, len(text)) for _ in range(5))} - {0}:
            assert table[a + k - 1] == len(library.encode(text[:k]))
    for budget in (0, 3, 50, 4096):
        want = [next((int(k) for k in np.flatnonzero(table[a:b] > budget)), b - a) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        assert tokencount.fitting(table, lengths, budget).tolist() == want
    rows = tokencount.prefix_tables(docs, PIECES).join(docs.select("doc_id", "text"), "doc_id")
    for r in rows.select("text", "counts", tokencount.tokens_of_prefix(rows["counts"], 7).alias("seven"), tokencount.chars_within(rows["counts"], 5).alias("five")).collect():
        if r.text and r.text.startswith("x" * 5000):
            continue  # two equal rows share this id
        want = [len(library.encode((r.text or "")[:k])) for k in range(min(40, len(r.text or "")) + 1)]
        assert r.counts[: len(want)] == want and r.seven == want[min(7, len(want) - 1)] and r.five == next((k - 1 for k, n in enumerate(r.counts) if n > 5), len(r.text or ""))
    got = tokencount.count_tokens(docs, PIECES, limit=40).collect()
    assert all(r.over_limit == (r.n_tokens > 40) for r in got) and any(r.over_limit for r in got)
    assert tokencount.prefix_tables(no_docs, PIECES).count() == 0


def test_token_files(docs, no_docs):
    library = tokenfile.tokenizer(BYTES)
    got = tokenfile.read_files(tokenfile.write_files(docs, BYTES)).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    start = 0
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert tokenfile.read_files(tokenfile.write_files(no_docs, BYTES)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 5000, 300_000, 1 << 20])
def test_containers(n):
    ids = (np.random.default_rng(n).zipf(1.4, n) % 50257).astype("<u4")
    data = tokenfile.pack([None, 5], np.array([n // 3, n - n // 3]), ids)
    box = tokenfile.Container(data)
    assert box.doc_ids == [None, 5] and box.lengths.tolist() == [n // 3, n - n // 3] and (box.ids() == ids).all()
    size = tokenfile.BLOCK_IDS
    assert len(box.places) == -(-n // size) and (n < 1 << 20 or len(box.places) >= 16)
    for k in {0, len(box.places) - 1} if n else ():  # one block, and each half of one, alone
        own = ids[k * size : (k + 1) * size]
        assert (box.blocks([k])[0] == own).all()
        first, second = box.half(k, 0), box.half(k, 1)
        assert (first == own[: len(first)]).all() and (second == own[len(first) :]).all()
    if n >= 5000:
        first, lanes = box.places[0], int(box.directory[0, 1])
        for at, h in ((first, 0), (first + 8 * lanes, 1)):  # states at the start and at the checkpoint
            broken = bytearray(data)
            broken[at] ^= 255
            for read in (lambda b: b.ids(), lambda b, h=h: b.half(0, h)):
                with pytest.raises(ValueError):
                    read(tokenfile.Container(bytes(broken)))
    with pytest.raises(ValueError):
        tokenfile.Container(b"\0" * 64)


def test_pipeline_keeps_the_ids(spark):
    texts = ["a b", "", " ", "日 \n<s> é\U0001f600", "  x  "]
    out = corpus_pipeline.encode(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect()
    assert len(out) == len(texts) and all(r.round_trip and lattice.decoded(np.array(r.ids, int), PIECES) == texts[r.doc_id] for r in out)


def test_sentencepiece(docs, no_docs, spark):
    library = tokencount.processor(PIECES)
    rng = random.Random(4)
    made = ["".join(rng.choice(["a", "B", " ", "\n", "é", "'s", "<s>", ".", ",", "  ", "日", "abcdefghij" * 9, "in", "the", ").", "x,"]) for _ in range(rng.randint(0, 20))) for _ in range(500)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(made)], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in lattice.encode(df, PIECES, with_ids=True).collect():
        ids = library.encode(texts[r.doc_id])
        assert r.ids == ids and r.n_pieces == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.round_trip
        assert lattice.decoded(np.array(ids), PIECES) == texts[r.doc_id].replace("▁", " ")
    assert lattice.encode(no_docs, PIECES).count() == 0


def test_the_lattice_as_a_dataframe(spark):
    library = tokencount.processor(PIECES)
    words = ["▁the", "▁Tokenization", "▁naïve", "▁thntblereandion", "▁in"]
    got = lattice.cuts_of_units(spark.createDataFrame([(0, w) for w in words], "chunk long, unit string"), PIECES).collect()
    for r in got:
        ends = [k for k in range(len(r.unit) + 1) if r.cuts >> k & 1]
        assert [r.unit[a:b] for a, b in zip(ends, ends[1:])] == library.encode(r.unit[1:], out_type=str)
    assert len(got) == len(words)


def jaccard(a, b):
    return sum(min(a[k], b[k]) for k in a | b) / max(1, sum(max(a[k], b[k]) for k in a | b))


def test_fingerprints(real, docs, no_docs):
    rows = sorted(((r.doc_id, r.text) for r in real.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(real).collect()}
    off = []
    for k, (doc, text) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = got[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own = fingerprints.terms(text)
        off += [r.near_edited - jaccard(own, fingerprints.terms(edited)), r.near_next - jaccard(own, fingerprints.terms(after))]
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.07
    out = fingerprints.compare_with_edits(docs).collect()
    assert len(out) == docs.count() and fingerprints.compare_with_edits(no_docs).count() == 0
    same = {r.fingerprint for r in out if r.doc_id in (1, 2)}
    assert len(same) == 1 and all(r.fingerprint == "0" * 256 for r in out if r.doc_id in (4, 5))


def test_the_next_document_where_ids_repeat(spark):
    """Frequent ids and nulls, equal rows, few and many ranges: every row meets the next by (id, hash of the text, text)."""
    rng = random.Random(8)
    rows = [(rng.choice([None, 5, 5, 5, 7, 9, *range(20)]), rng.choice(["", None, f"t{rng.randint(0, 900)} " * rng.randint(1, 30)])) for _ in range(900)]
    rows += [(7, "the same")] * 200 + [(2**63 - 1, "last"), (-(2**63), "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    hashed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), seed=42)) - ((h >> 63) << 64)
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashed(r[1]), r[1]), reverse=True)
    want = []
    for k, (i, t) in enumerate(order):
        cut, after = len(t) // 3, order[(k + 1) % len(order)][1]
        want.append((i, len(t), hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    before = neighbours.ROWS, neighbours.PART_BYTES
    try:
        for neighbours.ROWS, neighbours.PART_BYTES in ((1000, 10**9), (20, 2000)):
            got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.compare_with_edits(df).collect()]
            assert sorted(map(repr, got)) == sorted(map(repr, want))
    finally:
        neighbours.ROWS, neighbours.PART_BYTES = before


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = [int(c) for c in m.group() if c.isdigit()]
            total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d[::-1]))
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


def test_base_spans_by_brute_force():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("a.@-+ 01234567898(),é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(docs, no_docs):
    got = pii.find(docs, redact=True).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    digest = lambda t: hashlib.sha256(pii.joined(plain_spans(t)).encode()).hexdigest()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter((i, digest(t)) for i, t in texts)
    spans = {i: set(filter(None, pii.joined(plain_spans(t)).split(","))) for i, t in texts}
    assert all(spans[r.doc_id] <= set(filter(None, r.spans.split(","))) for r in got)
    six = pii.find(docs, redact=True).where("doc_id = 6").first()
    assert (six.n_email, six.n_ip, six.n_card, six.n_phone) == (1, 1, 1, 1) and "@" not in six.redacted and "4111" not in six.redacted
    assert pii.find(no_docs).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [("please mail me: john.doe [at] example [dot] org today", "email"), ("call my phone (523) 555-1055 now", "phone"), ("credit card 4111.1111.1111.1111 here", "card"), ("the server ip 10[.]20[.]30[.]40 went down", "ip")],
)
def test_added_spans(text, kind):
    assert [k for k, _, _ in pii.judge().accepted(text, pii.base_spans(text))] == [kind]


def test_recall_and_precision_of_added_spans():
    """On sentences of another seed than the trees learned from."""
    real = found = right = kept = 0
    for text, kind, spans in pii._sentences(1500, 99):
        base = pii.base_spans(text)
        want = {(kind, a, b) for a, b in spans} - set(base)
        added = set(pii.judge().accepted(text, base))
        assert not any(a < e and s < b for _, a, b in added for _, s, e in base)
        real, found, right, kept = real + len(want), found + len(added & want), right + len(added & want), kept + len(added)
    print(f"recall {found / real:.3f} precision {right / kept:.3f} of {real} spans")
    assert found >= 0.8 * real and right >= 0.95 * kept


@pytest.mark.parametrize("text", ["version 10.20.30.4000 of the build", "on 2024-05-17 at 10:20:30", "meet at noon. dots follow", "isbn 978-3-1614-8410-0", "page 12 34 56"])
def test_clean_texts_are_left_alone(text):
    assert pii.judge().accepted(text, pii.base_spans(text)) == []


@pytest.mark.parametrize("at", ["@", " @ ", " at ", " AT ", *(f"{a}{s}{w}{s}{b}" for a, b in ("[]", "()", "{}", "<>") for s in ("", " ") for w in ("at", "AT", "@"))])
def test_every_separator_of_addresses_is_proposed_without_other_cues(at):
    text = f"jane{at}example.com"
    assert (("email", 0, len(text), 0)) in pii.proposals(text)
    if at[0] in "[({<":
        spans = pii.base_spans(text) + pii.judge().accepted(text, pii.base_spans(text))
        assert pii.redacted(text, spans) == "[EMAIL]"
