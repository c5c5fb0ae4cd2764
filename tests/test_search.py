"""Exact top-k against numpy brute force; both execution paths."""

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketlake.operators import search

from .conftest import SF001


def r4(x):
    """Same rule as the library: via DECIMAL(20,6), then 4 places half-up."""
    d = Decimal(repr(float(x))).quantize(Decimal("1e-6"), ROUND_HALF_UP)
    return float(d.quantize(Decimal("1e-4"), ROUND_HALF_UP))


def brute(corpus, queries, k):
    ids = np.array([r[0] for r in corpus])
    c = np.array([r[1] for r in corpus], dtype=float)
    c = c / np.where(np.linalg.norm(c, axis=1, keepdims=True) > 0, np.linalg.norm(c, axis=1, keepdims=True), 1)
    out = {}
    for qid, v in queries:
        v = np.asarray(v, dtype=float)
        v = v / (np.linalg.norm(v) or 1.0)
        s = np.round(c @ v, 10)
        order = np.lexsort((ids, -s))[:k]
        out[qid] = [(int(ids[i]), r4(s[i])) for i in order]
    return out


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(7)
    corpus = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    corpus += [(300, corpus[5][1]), (301, [0.0] * 8)]          # exact tie with id 5, zero vector
    queries = [(q, [float(x) for x in rng.normal(size=8)]) for q in range(12)] + [(99, corpus[5][1])]
    cdf = spark.createDataFrame(corpus, "vec_id long, embedding array<double>").repartition(5)
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    return corpus, queries, cdf, qdf


PATHS = {
    "broadcast": {},
    "blocked": {"max_broadcast_queries": 5, "corpus_block_rows": 50},
    # Tiny score budget: every task scores its corpus rows in slices of 1-3 rows.
    "broadcast_sliced": {"max_score_cells": 40},
    "blocked_sliced": {"max_broadcast_queries": 5, "corpus_block_rows": 50, "max_score_cells": 7},
}


@pytest.mark.parametrize("path", list(PATHS))
def test_top_k_exact(small, path):
    corpus, queries, cdf, qdf = small
    kw = PATHS[path]
    res = search.top_k_similar(cdf, qdf, k=4, **kw).collect()
    got = {}
    for r in sorted(res, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute(corpus, queries, 4)
    assert got[99][:2] == [(5, 1.0), (300, 1.0)]


def test_k_larger_than_corpus(spark):
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(0, [1.0, 1.0])], "query_id long, embedding array<double>")
    assert search.top_k_similar(c, q, k=5).count() == 2


def test_normalize_and_status(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = {r["vec_id"]: r["embedding"] for r in search.normalize_vectors(df).collect()}
    assert rows[1] == [0.6, 0.8] and rows[2] == [0.0, 0.0]
    st = search.vector_status(df).first()
    assert st["exists"] and st["vector_count"] == 2 and st["dim"] == 2


def test_centroid_queries_on_driver_table(spark):
    from ticketlake.sources.fixtures import read_table
    emb = read_table(spark, SF001, "embeddings")
    cent = search.label_centroids(emb)
    res = search.top_k_similar(emb, cent.withColumnRenamed("label", "query_id"), k=5)
    assert res.groupBy("query_id").count().filter(F.col("count") != 5).count() == 0
    assert res.count() == 5 * cent.count()


def test_embed_text_and_custom_encoder(spark):
    df = spark.createDataFrame([("a", "brake pads worn"), ("b", None)], "id string, description string")
    out, _ = search.embed_text(df)
    vec = {r["id"]: r["embedding"] for r in out.collect()}
    assert abs(sum(x * x for x in vec["a"]) - 1.0) < 1e-9 and sum(vec["b"]) == 0.0
    enc, _ = search.embed_text(df, encoder=lambda s: np.array([[len(t), 1.0] for t in s]), dim=2)
    assert len(enc.first()["embedding"]) == 2


def test_approx_recall_and_candidates(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    x = centers[np.arange(2000) % 40] + 0.15 * rng.normal(size=(2000, 16))
    cdf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    qdf = cdf.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["vec_id"]) for r in search.top_k_similar(cdf, qdf, k=5).collect()}
    found = search.approx_top_k_similar(cdf, qdf, k=5).collect()
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in found}) >= 0.9 * len(exact)
    score = {(r["query_id"], r["vec_id"]): r["score"] for r in found}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert all(abs(s - unit[a] @ unit[b]) < 1e-4 for (a, b), s in score.items())


def test_normalising_takes_one_pass(spark):
    """The length of a vector is computed once, not once for every number of it."""
    import time

    from ticketlake.functions.vectors import l2_normalize
    df = spark.range(4).select("id", F.expr("transform(sequence(1, 20000), x -> cast(x as double))").alias("v"))
    began = time.monotonic()
    got = df.select(l2_normalize(F.col("v")).alias("u")).select(F.expr("aggregate(u, 0D, (a, x) -> a + x * x)").alias("n")).collect()
    assert time.monotonic() - began < 5 and all(abs(r["n"] - 1) < 1e-9 for r in got)
    odd = spark.createDataFrame([([0.0, 0.0],), (None,), ([],), ([3.0, None],)], "v array<double>").select(l2_normalize(F.col("v"))).collect()
    assert [r[0] for r in odd] == [[0.0, 0.0], None, [], [3.0, None]]
