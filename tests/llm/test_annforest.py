
import numpy as np

from ticketlake.llm import annforest as A
from ticketlake.llm.queries import QUERIES

from .conftest import SF001


def exact(ids, x, q, k):
    out = []
    for i in q:
        s = (x * x[ids.index(i)]).sum(axis=1)
        out += [(i, r + 1, ids[j], s[j]) for r, j in enumerate([j for j in np.lexsort((ids, -s)) if ids[j] != i][:k])]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "id long, vec array<float>, key string, leaves string")


def test_whole_share_is_exact_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).round(1).astype(np.float32)
    x[50:150] = x[3]  # one vector many times
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows + rows[:5])
    got = A.nearest(df, df.where("id % 20 = 0"), k=7, trees=3, leaf=16, share=99.0, bin_rows=40, bin_queries=3).collect()
    want = exact(list(range(400)), x.astype(float), range(0, 400, 20), 7)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (40, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    df = frame(spark, rows)
    got = sorted(tuple(r) for r in A.nearest(df, df.where("id % 20 = 0"), k=20).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
    assert A.nearest(df.limit(0), df).collect() == []
    assert A.nearest(df, df.limit(0)).collect() == []


def test_shared_queue_takes_leaves_in_order_of_margin():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    trees = [A.Tree(x, 20, rng) for _ in range(3)]
    sizes = [np.bincount(t.leaf_of(x), minlength=t.leaves) for t in trees]
    assert all(s.max() <= 20 and s.sum() == 300 for s in sizes)
    q = rng.normal(size=5)
    first = {(i, int(t.leaf_of(q[None])[0])) for i, t in enumerate(trees)}
    got = A.search_leaves(trees, sizes, q, 1e9)
    assert set(got[:3]) == first and len(got) == len(set(got)) == sum(t.leaves for t in trees)
    half = A.search_leaves(trees, sizes, q, 300)
    assert half == got[:len(half)] and sum(sizes[i][f] for i, f in half[:-1]) < 300


def test_bins_are_bounded():
    first, parts, n = A.bins_of([np.array([5, 5, 100, 3, 0, 4]), np.array([10, 10])], 12)
    rows = {}
    for f, p, s in zip(first, parts, ([5, 5, 100, 3, 0, 4], [10, 10]), strict=True):
        for b, k, r in zip(f, p, s, strict=True):
            for j in range(k):
                rows[b + j] = rows.get(b + j, 0) + r / k
    assert max(rows.values()) <= 12 and max(rows) < n


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF001}/embeddings.parquet").toPandas()
    ids, x = df.vec_id.tolist(), np.array(df.embedding.tolist(), float)
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 20)
    got = {(r.query_id, r.vec_id) for r in QUERIES["op5_nearest_neighbours"](spark, SF001).collect()}
    assert len(got) == len(want)
    assert len(got & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
