import random
from collections import Counter

import numpy as np

from ticketlake.llm import nearup as N
from ticketlake.llm.graph import components

from .conftest import documents, words


def classes_by_definition(rows):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = N.WORD.findall((t or "").lower())
        sets.setdefault(i, set()).update(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)) if w)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= .8 * len(sets[a] | sets[b]) - 1e-12:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_edge_rows(spark, edge_rows, edge_docs, no_docs):
    rows = N.near_duplicates(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in edge_rows)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == classes_by_definition(edge_rows)
    assert all(r.class_id is None for r in rows if r.doc_id is None)
    assert N.near_duplicates(no_docs).collect() == []


def test_groups_chains_and_hot_copies(spark):
    rng = random.Random(11)
    rows, i = [], 0
    base = words(rng, 200)
    for _ in range(60):  # near copies of one text, also of each other
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(200)] = "changed%d" % rng.randrange(10 ** 6)
        rows.append((i := i + 1, " ".join(t)))
    chain = words(rng, 120)
    for step in range(8):  # neighbours alike, ends not
        rows.append((i := i + 1, " ".join(chain[step * 6:] + words(rng, step * 6))))
    rows += [(i + 1 + k, "the very same text of several words") for k in range(40)]
    rows += [(200 + k, " ".join(words(rng, 150))) for k in range(40)]
    rows += [(300 + k, " ".join(base[:100] + words(rng, 100))) for k in range(20)]  # share half
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, rows)).collect()}
    assert got == classes_by_definition(rows)


def test_dart_collisions_follow_weighted_jaccard():
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2 ** 63, 60).astype(np.uint64)
    wa, wb = rng.uniform(0.1, 9, 60), rng.uniform(0.1, 9, 60)
    wa[:10] = wb[50:] = 0
    k = 6000
    sets = [(e[w > 0], np.zeros((w > 0).sum(), int), w[w > 0]) for w in (wa, wb)]
    a, b = (N.dart_minhash(x, o, w, 1, k)[0] for x, o, w in sets)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((a == b).mean() - want) < 4 * np.sqrt(want * (1 - want) / k)
    one = N.dart_minhash(e[:1], np.zeros(1, int), np.ones(1), 2, 64)
    assert (one[0] != 0).all() and (one[1] == 0).all()


def test_sketch_counts_disagreement(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 63, (5, 96)).astype(np.uint64)
    b = a.copy()
    for n in range(5):
        b[n, :n * 20] ^= np.uint64(5)
    rows = [(n, x.tolist(), y.tolist()) for n, (x, y) in enumerate(zip(N.sketch(a), N.sketch(b), strict=True))]
    df = spark.createDataFrame(rows, "n int, a array<long>, b array<long>")
    assert {r.n: r.d for r in df.select("n", N.disagreeing("a", "b", 6).alias("d")).collect()} == {n: n * 20 for n in range(5)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (201, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}


def test_wide_sketch_keeps_pairs_of_the_similarity(spark):
    """Pairs at 0.8 and more pass; most at 0.7 do not."""
    rng = random.Random(8)
    rows, pairs = [], []
    for n in range(60):
        base = words(rng, 400)
        other = list(base)
        for at in rng.sample(range(0, 400, 6), (2, 7, 16)[n % 3]):
            other[at] = "other%d" % rng.randrange(10 ** 6)
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(other))]
        pairs.append((2 * n, 2 * n + 1))
    docs = documents(spark, rows)
    wide = {r.rep: r.wide for r in N.wide_sketches(docs, spark.range(200), False).collect()}
    texts = dict(rows)
    true = N.jaccard_of([texts[a] for a, _ in pairs], [texts[b] for _, b in pairs])
    df = spark.createDataFrame([(a, wide[a], wide[b]) for a, b in pairs], "a long, x array<long>, y array<long>")
    passed = {r.a for r in df.where(N.wide_enough("x", "y", 0.8)).collect()}
    assert all(a in passed for (a, _), j in zip(pairs, true) if j >= 0.8)
    low = [a for (a, _), j in zip(pairs, true) if j < 0.71]
    assert low and sum(a in passed for a in low) <= len(low) // 4


def test_dense_group_with_outliers(spark):
    """A large group around one text, with members apart from each other by more than the similarity."""
    rng = random.Random(21)
    base = words(rng, 150)
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(rng.randint(0, 14)):
            t[rng.randrange(150)] = "changed%d" % rng.randrange(10 ** 6)
        rows.append((i, " ".join(t)))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(documents(spark, rows)).collect()}
    want = classes_by_definition(rows)
    assert got == want and len(set(want.values())) > 5
