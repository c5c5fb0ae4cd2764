"""Block-bounded text retrieval against brute force; candidates stay far under all pairs."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import textsearch as S

WORDS = [f"w{i}" for i in range(400)]


def texts(rng, n, size):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [" ".join(rng.choices(WORDS, weights, k=rng.randint(*size))) for _ in range(n)]


def by_definition(queries, corpus, k):
    tok = lambda t: re.findall(r"\b\w\w+\b", t.lower())
    df = Counter(w for t in corpus for w in set(tok(t)))
    idf = {w: math.log((1 + len(corpus)) / (1 + n)) + 1 for w, n in df.items()}

    def unit(t):
        v = {w: n * idf[w] for w, n in Counter(tok(t)).items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    held = [unit(t) for t in corpus]
    out = {}
    for i, q in enumerate(queries):
        v = unit(q)
        scored = sorted((-round(sum(x * d.get(w, 0.0) for w, x in v.items()), 10), j) for j, d in enumerate(held) if set(v) & set(d))
        out[i] = [(j, -s) for s, j in scored[:k]]
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    corpus = list(dict.fromkeys(texts(rng, 1500, (3, 80))))
    queries = ["w0 w1 w2", "w0", "w0 w1 w2 w3 w4 w5 w6 w7", "w390 w1", "nothing here", *texts(rng, 15, (2, 30))]
    c = spark.createDataFrame([(j, t, j) for j, t in enumerate(corpus)], "key long, text string, first_id long")
    q = spark.createDataFrame(list(enumerate(queries)), "key long, text string")
    return queries, corpus, q, c


@pytest.mark.parametrize("head", [1, 20, 1000])
def test_top_k_by_definition(data, head):
    queries, corpus, q, c = data
    got = {}
    for r in S.top_k_texts(q, c, S.smooth_idf(c, "text"), 4, head=head).collect():
        got.setdefault(r["query_key"], []).append((r["key"], r["score"]))
    want = {i: v for i, v in by_definition(queries, corpus, 4).items() if v}
    assert set(got) == set(want)
    for i, hits in want.items():
        assert [j for j, _ in hits] == [j for j, _ in sorted(got[i], key=lambda x: (-x[1], x[0]))], i
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(hits, sorted(got[i], key=lambda x: (-x[1], x[0]))))


def test_frequent_terms_do_not_bring_up_every_text(data):
    queries, corpus, q, c = data
    idf = S.smooth_idf(c, "text")
    weights = S.unit_weights(S.term_counts(q, "key", "text"), idf).withColumnsRenamed({"key": "q", "w": "wq"})
    blocked = S.posting_blocks(S.unit_weights(S.term_counts(c, "key", "text"), idf))
    n = {r["q"]: r["n"] for r in S.candidate_pairs(weights, blocked, 4, head=50).groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    holding = {r["q"]: r["n"] for r in weights.join(blocked, "term").groupBy("q").agg(F.count_distinct("key").alias("n")).collect()}
    # A query of the three most frequent words meets nearly every text, but few can win.
    assert holding[0] > 0.8 * len(corpus) and n[0] < 0.25 * holding[0]
    assert sum(n.values()) < 0.35 * sum(holding.values())


def test_postings_of_the_queries_terms_weigh_by_all_terms(spark, data, monkeypatch):
    """Lengths count common and rare terms and terms no query has; postings lie by key, and sums per text move nothing."""
    queries, corpus, q, c = data
    monkeypatch.setattr(S, "COMMON_TERMS", 50)
    idf = S.smooth_idf(c, "text")
    asked = S.reliable_checkpoint(S.unit_weights(S.term_counts(q.where("key < 4"), "key", "text"), idf).withColumnsRenamed({"key": "q", "w": "wq"}))
    kept = S.keep_postings(asked, c.repartition(3), idf)
    terms = {r["term"] for r in asked.select("term").distinct().collect()}
    want = {(r["key"], r["term"]): r["w"] for r in S.unit_weights(S.term_counts(c, "key", "text"), idf).collect() if r["term"] in terms}
    got = {(r["key"], r["term"]): r["w"] for r in kept.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    sums = kept.join(F.broadcast(asked), "term").groupBy("q", "key").agg(F.sum("w"))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "Exchange hashpartitioning" not in plan


def test_idf_counts_rows(spark):
    rows = spark.createDataFrame([("aa bb aa",), ("aa bb aa",), ("bb cc",), (None,)], "text string")
    got = {r["term"]: r["idf"] for r in S.smooth_idf(rows, "text").collect()}
    assert {t: round(x, 12) for t, x in got.items()} == {t: round(math.log(5 / (1 + n)) + 1, 12) for t, n in {"aa": 2, "bb": 3, "cc": 1}.items()}
