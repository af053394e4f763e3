"""Mixing, the n-gram join, neighbours, toxicity, language-model scores and the pipeline."""

import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from prosescan.llm import components, forest, logbilinear, mixing, ngramjoin, pii, toxicity
from prosescan.llm.boosting import Boosting, Isotonic


def test_sainte_lague_by_hand():
    assert mixing.sainte_lague([53.0, 24.0, 23.0], 7, [9, 9, 9]) == [3, 2, 2]
    rng = np.random.default_rng(1)
    for _ in range(200):
        votes, caps = rng.integers(0, 50, 6).astype(float).tolist(), rng.integers(0, 9, 6).tolist()
        seats, got = int(rng.integers(0, 20)), [0] * 6
        for _ in range(min(seats, sum(c for v, c in zip(votes, caps) if v > 0))):
            k = max((k for k in range(6) if got[k] < caps[k] and votes[k] > 0), key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
            got[k] += 1
        assert mixing.sainte_lague(votes, seats, caps) == got


def test_targets_fill_up():
    assert mixing.targets([100, 100, 10], [3, 1, 2], 1.5, 2) == [200.0, 95.0, 20.0]
    assert mixing.targets([], [], 1.5, 2) == [] and mixing.targets([0], [3], 1.5, 2) == [0.0]


def test_targets_by_rounds():
    """Against rounds over all sources that are still open, as the contract words it."""
    rng = np.random.default_rng(6)
    for _ in range(300):
        sizes, weights = rng.integers(0, 300, 9).tolist(), [(3, 1, 2)[i % 3] for i in range(9)]
        open_, want = set(range(9)), [0.0] * 9
        while open_:
            unit = (1.5 * sum(sizes) - sum(2 * sizes[i] for i in range(9) if i not in open_)) / sum(weights[i] for i in open_)
            full = {i for i in open_ if weights[i] * unit > 2 * sizes[i]}
            if not full:
                want = [weights[i] * unit if i in open_ else 2.0 * sizes[i] for i in range(9)]
            open_ = open_ - full if full else set()
        assert mixing.targets(sizes, weights, 1.5, 2) == pytest.approx(want)


def test_mixing_of_rows_without_ids(spark, monkeypatch):
    """They are dealt to shards by their texts, and the targets hold."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    monkeypatch.setattr(mixing, "BLOCKS_OF_LEAST", 2000)  # a shard has over a hundred blocks, as in large tables
    docs = spark.createDataFrame([(None, f"w{k} " * (1 + k % 30), "ab"[k % 2]) for k in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).groupBy("source_ix").agg({"taken": "sum", "target": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in got) == 2000 and all(abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"] for r in got)


def test_mixing(real, docs, no_docs):
    for df, near in ((real, 0.05), (docs, 0.5)):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count() and all(0 <= r.taken <= 2 * r["size"] for r in rows)
        taken, of = defaultdict(int), {}
        for r in rows:
            taken[r.source_ix] += r.taken
            of[r.source_ix] = r
        assert all(abs(taken[k] - r.target) <= near * r.target + 2 for k, r in of.items())
        assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_whole_copies_of_long_documents_keep_the_targets(spark):
    rows = [(k, "w " * 5000, "a") for k in range(300)] + [(k, "w " * 500, "b") for k in range(300, 3300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"weights": (1, 9), "ratio": 0.8}
    target = {r.source_ix: r.target for r in mixing.mix(docs, **options).select("source_ix", "target").distinct().collect()}
    words = {r.source: 5000 * r["count"] if r.source == "a" else 500 * r["count"] for r in mixing.mixed_documents(docs, **options).groupBy("source").count().collect()}
    assert abs(words.get("a", 0) - target[0]) < 0.25 * target[0] and abs(words["b"] - target[1]) < 0.05 * target[1]


def classes_by_brute_force(rows):
    """(id, least id of the class or None, links) for each row, and the rows of each class; rows are told apart by place, not by id."""
    grams = ngramjoin.Grams()
    sets = [set(grams(t or "").tolist()) for _, t in rows]
    parent, degree = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a], sets[b]
            if s and t and len(s & t) >= 0.8 * len(s | t):
                degree[a] += 1
                degree[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    members = defaultdict(list)
    for k in range(len(rows)):
        members[find(k)].append(k)
    least = {root: min((rows[k][0] for k in of if rows[k][0] is not None), default=None) for root, of in members.items()}
    return [(rows[k][0], least[find(k)], degree[k]) for k in range(len(rows))], list(members.values())


def links_by_brute_force(rows):
    return {i: (c, n) for i, c, n in classes_by_brute_force(rows)[0]}


@pytest.mark.parametrize(("hot", "block"), [(16, 512), (2, 8)])
def test_ngram_join(spark, hot, block):
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for size in (30, 12, 5, 2, 1, 1):  # groups of near copies, some of them equal
        base = rng.choice(words, 150).tolist()
        for _ in range(size):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = "changed"
            rows.append((k, " ".join(text)))
            k += 1
    rows += [(k, "short one"), (k + 1, "Short  one"), (k + 2, ""), (k + 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngramjoin.classes(df, hot=hot, block=block).collect()}
    assert got == links_by_brute_force(rows)


def repeated_ids(seed):
    """Groups of near copies under few ids and nulls, so that different texts share ids and equal rows recur."""
    rng = np.random.default_rng(seed)
    words, rows = [f"w{k}" for k in range(4000)], []
    for size in (25, 10, 4, 1, 1):
        base = rng.choice(words, 120).tolist()
        for _ in range(size):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = f"c{rng.integers(3)}"
            rows.append((None if rng.random() < 0.2 else int(rng.integers(6)), " ".join(text)))
    return [*rows, *rows[:9], (3, ""), (3, None), (None, " "), (None, None)]


@pytest.mark.parametrize(("hot", "block"), [(16, 512), (2, 8)])
def test_ngram_join_of_repeated_ids(spark, hot, block):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    for rows in ([(1, a), (1, b), (2, b), (3, b + " more")], repeated_ids(1), repeated_ids(2)):
        df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, kept_id int").repartition(4)
        want, members = classes_by_brute_force(rows)
        found = ngramjoin.classes(df, hot=hot, block=block).collect()
        assert sorted(map(repr, ((r.doc_id, r.class_id, r.n_links) for r in found))) == sorted(map(repr, want))
        with_words = [of for of in members if (rows[of[0]][1] or "").split()]
        assert sorted(Counter(r.class_key for r in found if r.class_key).values()) == sorted(map(len, with_words))
        kept = ngramjoin.one_of_each(df, hot=hot, block=block).collect()
        of = {k: g for g, ks in enumerate(members) for k in ks}
        assert sorted(of[r.kept_id] for r in kept) == list(range(len(members)))
        firsts = {of[r.kept_id]: r.doc_id for r in kept}
        assert all(firsts[g] == min((rows[k][0] for k in ks if rows[k][0] is not None), default=None) for g, ks in enumerate(members))


def test_ngram_join_edges(docs, no_docs):
    got = ngramjoin.classes(docs).collect()
    assert len(got) == docs.count() and ngramjoin.classes(no_docs).count() == 0
    classes = {r.doc_id: r.class_id for r in got}
    assert classes[1] == classes[2] == classes[3] == 1 and classes[4] == 4 and classes[5] == 5 and classes[9] == 9
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 8, 9, 10, 11, None])
    assert ngramjoin.one_of_each(no_docs).count() == 0
    assert 1 - (1 - 0.8**8) ** ngramjoin.bands_for(0.8, 0.999) >= 0.999


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_neighbours(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    found, hit, total = defaultdict(list), 0, 0
    for r in forest.search(df, block=200, queries=4).orderBy("query_id", "rank").collect():  # several blocks and sets
        assert r.score == pytest.approx(float(unit[np.searchsorted(ids, r.vec_id)] @ unit[np.searchsorted(ids, r.query_id)]), abs=1e-12)
        found[r.query_id].append(r.vec_id)
        assert r.rank == len(found[r.query_id]) and r.vec_id != r.query_id
    for q in ids[ids % 50 == 0]:
        s = unit @ unit[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        hit += len(set(ids[np.argsort(-s)[:5]].tolist()) & set(found[q]))
        total += 5
    print(f"recall {hit / total:.3f}")
    assert hit >= 0.9 * total


def test_neighbours_of_repeated_ids(spark):
    """Against all pairs: the best row of each id counts, an id is found once, and its copies take no other's place."""
    rng = np.random.default_rng(4)
    near = [(50, [1.0, 0.0, 0.0]), *[(1, [1.0, 0.1, 0.0])] * 8, (2, [1.0, 0.2, 0.0]), (3, [1.0, 0.3, 0.0]), (4, [1.0, 0.4, 0.0]), (5, [1.0, 0.5, 0.0]), (6, [-1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])]
    got = forest.search(spark.createDataFrame(near, "vec_id long, embedding array<float>").repartition(3)).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5] and [r.rank for r in got] == [1, 2, 3, 4, 5]
    rows = [(int(rng.integers(0, 60)), rng.normal(size=4).tolist()) for _ in range(150)] + [(0, [1e200, 1e200, 0.0, 1e200]), (7, [1e-200, 1e-200, 0.0, 1e-200])]
    rows += rows[:20]
    x, ids = forest.scaled(np.array([v for _, v in rows])), np.array([i for i, _ in rows])
    unit = x / np.sqrt((x * x).sum(1))[:, None]
    want = []
    for q in sorted({i for i in ids.tolist() if i % 50 == 0}):
        best = {}
        for i, s in zip(np.tile(ids, (ids == q).sum()).tolist(), (unit[ids == q] @ unit.T).ravel().tolist(), strict=True):
            if i != q:
                best[i] = max(best.get(i, -2), s)
        want += [(q, i) for i in sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]]
    got = forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), block=16, queries=2)
    assert [(r.query_id, r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == want


def test_prefixes_of_any_length():
    """Longest-prefix matches and candidates against plain comparisons of strings."""
    rng = np.random.default_rng(5)
    rows = np.concatenate([rng.normal(size=(60, 6)), rng.normal(size=(1, 6)) + 1e-7 * rng.normal(size=(20, 6))])
    unit = rows / forest.norms(rows)[:, None]
    f, asked = forest.Forest(unit, trees=3), unit[[0, 5, 70]]
    bits = lambda x: [[format(int(c), "064b") for c in row] for row in f.strings(x)]
    shared = np.array([[[next((k for k in range(64) if a[t][k] != b[t][k]), 64) for t in range(3)] for b in bits(unit)] for a in bits(asked)])
    assert f.reached(f.strings(asked)).tolist() == shared.max((1, 2)).tolist()
    for enough in (1, 5, 40, 80, 81):
        for q, got in enumerate(f.candidates(asked, enough)):
            depth = next((d for d in range(64, 0, -1) if (hit := (shared[q] >= d).any(1)).any() and hit.sum() >= enough), 0)
            assert (got == (shared[q] >= depth).any(1)).all()


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 1.0]), (None, [1.0, 0.0]), (8, []), (9, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = forest.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 1), (50, 2, 2), (50, 3, 0)]
    assert forest.search(df.limit(0)).count() == 0


def test_neighbours_of_every_length(spark):
    rows = [(k, [1.0, k / 100, 0.0]) for k in range(30)] + [(k, [1.0, k / 100]) for k in range(50, 70)] + [(100, [2.0])]
    got = forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (50, 1, 51), (50, 2, 52)]


def test_trees_and_calibration():
    rng = np.random.default_rng(3)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    margin = Boosting(trees=40).fit(x[:1500], y[:1500]).margin(x[1500:])
    assert np.mean((margin > 0) == (y[1500:] > 0)) > 0.97
    p = Isotonic().fit(margin, y[1500:])(np.sort(margin))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() and p.max() <= 1


def test_toxicity(spark, docs, no_docs):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score(real, labels).collect()}
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert np.mean(pairs) > 0.9
    model_only = toxicity.score(docs, labels).collect()
    assert len(model_only) == docs.count() and all(0 <= r.score <= 1 for r in model_only)
    assert toxicity.score(no_docs, labels.limit(0)).count() == 0
    same = {r.score for r in toxicity.score(docs, labels.limit(0)).collect()}
    assert len(same) == 1 and 0 <= same.pop() <= 1
    assert toxicity.clean_documents(docs, labels.limit(0)).columns == docs.columns


def test_features_by_brute_force(real):
    """Dense features counted character by character and word by word."""
    lexicon = {"bad": 3.0, "clow-": 2.6}
    for text in ["", "YOU absolute idiot!! you clowns", "b4d w0rds, soooo bad... 1234 you?", *(r.text or "" for r in real.limit(25).collect())]:
        got = dict(zip(toxicity.NAMES, toxicity.features(text, lexicon), strict=True))
        words, n = toxicity.words_of(text), len(text) or 1
        weight = lambda w: max([lexicon.get(b, 0.0) for b in toxicity.beginnings(w)])
        undone = {w for w in words if not w.isalpha() and any(c.isalpha() for c in w) and (u := w.translate(toxicity.UNDO)) != w and (u in toxicity.INSULTS or weight(u))}
        hits = [k for k, w in enumerate(words) if w in toxicity.INSULTS or weight(w) or w in undone]
        you = [k for k, w in enumerate(words) if w in toxicity.YOU]
        assert got["insults"] == sum(w in toxicity.INSULTS for w in words) and got["learned"] == sum(weight(w) > 0 for w in words)
        assert got["nearest"] == min((abs(h - y) for h in hits for y in you), default=99) and got["undone"] == len(undone)
        assert got["you_rate"] == pytest.approx(len(you) / (len(words) or 1))
        assert got["exclamations"] == pytest.approx(text.count("!") / n) and got["questions"] == pytest.approx(text.count("?") / n)
        assert got["digits"] == pytest.approx(sum(c.isdigit() and ord(c) < 0x3000 for c in text) / n)


def test_scores_one_by_one(real, labels):
    """The query's scores are the model's of each text alone, and predictions follow them."""
    model, texts = toxicity.learn(real, labels), {r.doc_id: r.text or "" for r in real.collect()}
    for r in toxicity.score(real, labels).collect():
        assert r.score == pytest.approx(float(model.scores([texts[r.doc_id]])[0]), abs=1e-12) and r.predicted == int(r.score >= 0.7)


def test_repeated_ids_do_not_pass_the_bound_of_labelled_rows(real, labels, monkeypatch):
    learned = []
    monkeypatch.setattr(toxicity, "Model", lambda lexicon, x, y, fold: learned.append((x.tolist(), y.tolist())))
    many = real.unionByName(real).unionByName(real.selectExpr("doc_id", "concat(text, ' more') as text", "lang", "source", "n_chars"))
    for df in (many, many.repartition(7)):
        toxicity.learn(df, labels, fit_rows=40)
    assert learned[0] == learned[1] and 0 < len(learned[0][1]) <= 40


def test_language_model(spark, docs, no_docs):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in logbilinear.score(real).collect()}
    texts = {r.doc_id: r.text for r in real.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in logbilinear.tokens(t))
    n, v = sum(counts.values()), len(counts)
    for d, t in texts.items():
        words, r = logbilinear.tokens(t), got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words))
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert logbilinear.score(docs).count() == docs.count() and logbilinear.score(no_docs).count() == 0


def test_probabilities_sum_to_one():
    p = logbilinear.Parameters(20, np.ones(20) / 20)
    scores = logbilinear.Scorer(p.flat(), 20)
    for u, v in ((0, 3), (20, 20), (7, 20)):
        assert np.exp(scores(np.full(20, u), np.full(20, v), np.arange(20))).sum() == pytest.approx(1, abs=1e-4)


def test_words_beyond_the_most_frequent_have_contexts(spark):
    """Two topics of like words, all rarer than ten others: a model that knows them only as a class gives each 1 / 80 at best."""
    rng = np.random.default_rng(3)
    name = lambda k: "".join("bcdfghklmnprst"[k // 14**j % 14] for j in range(4))
    common, topics = [name(k) for k in range(10)], [[name(k) for k in range(a, a + 40)] for a in (10, 50)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(500) for words in topics] + [" ".join(rng.choice(common, 200)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    own = [r.score / r.n_tokens for r in logbilinear.score(docs, vocabulary_size=10).where("held_out and doc_id < 1000").collect()]
    assert len(own) > 100 and np.mean(own) > -math.log10(80) + 0.05


def test_pipeline(spark, real):
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    docs, of = real, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf).cache()
        assert after.columns == real.columns and 0 < after.count()
        of[name] = ([(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in after.collect()])
        docs = after
    clean = {r.doc_id for r in toxicity.score(real, spark.read.parquet(f"{sf}/labels.parquet")).where("score < 0.7").collect()}
    assert Counter(of["toxicity"][1]) == Counter(r for r in of["toxicity"][0] if r[0] in clean)
    redact = lambda t: pii.redacted(t, (base := pii.base_spans(t)) + pii.judge().accepted(t, base))
    assert Counter(of["pii"][1]) == Counter((i, redact(t)) for i, t in of["pii"][0])
    copies, taken = Counter(of["mixing"][1]), {r.doc_id: (r.taken, r["size"]) for r in mixing.mix(spark.createDataFrame(of["mixing"][0], "doc_id long, text string").join(real.select("doc_id", "source"), "doc_id")).collect()}
    assert set(copies) <= set(of["mixing"][0]) and all(copies[r] in (taken[r[0]][0] // taken[r[0]][1], taken[r[0]][0] // taken[r[0]][1] + 1) for r in of["mixing"][0] if taken[r[0]][1])
    ids = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
    out = stages["sentencepiece"](spark, docs, sf).collect()
    assert len(out) == docs.count() and {r.doc_id for r in out} == ids and all(r.round_trip for r in out)
    kept = stages["ngram_jaccard_join"](spark, real, sf)
    classes = links_by_brute_force([(r.doc_id, r.text) for r in real.collect()])
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {c for c, _ in classes.values()}
