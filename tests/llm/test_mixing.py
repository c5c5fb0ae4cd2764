import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ticketlake.llm import mixing as X

from .conftest import documents, words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def by_definition(rows):
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(sources)}
    held = Counter()
    for _, s, t in rows:
        held[s] += size(t)
    target, capped = {}, set()
    while True:
        free = [s for s in sources if s not in capped]
        left = sum(held.values()) - sum(3 * held[s] for s in capped)
        target = {s: 3 * held[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in sources}
        over = [s for s in free if target[s] > 3 * held[s]]
        if not over:
            break
        capped.update(over)
    out, taken = [], defaultdict(int)
    for i, s, t in sorted(rows, key=lambda r: (hashlib.md5(f"mix:{'-' if r[0] is None else r[0]}".encode()).hexdigest(), size(r[2]))):
        whole, rest = divmod(int(target[s]), held[s]) if held[s] else (0, 0)
        mine = size(t) * whole + min(size(t), max(0, rest - taken[s]))
        taken[s] += size(t)
        out.append((i, size(t), held[s], target[s], mine))
    return out


def sourced(spark, rows):
    return documents(spark, [(i, t) for i, _, t in rows]).drop("source").join(
        spark.createDataFrame([(i, s) for i, s, _ in rows], "doc_id long, source string"), "doc_id")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, "hot" if i % 3 else rng.choice(["a", "b", "é", None, "tiny"]), " ".join(words(rng, rng.choice([0, 1, 5, 90]))))
           for i in range(300)]
    return [(i, s, "x" if s == "tiny" else t) for i, s, t in out] + [(900, "none", None), (901, "none", " \n\t"), (902, "a", "\x85 \xa0 x")]


def test_matches_the_definition(spark, rows):
    got = X.mix_sources(sourced(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    want = by_definition(rows)
    assert sorted((r.doc_id, r.size, r.source_size, r.taken) for r in got) == sorted((i, n, s, t) for i, n, s, _, t in want)
    targets = {i: t for i, _, _, t, _ in want}
    assert all(r.target == pytest.approx(targets[r.doc_id]) for r in got)


def test_budgets_are_met_to_the_word(spark, rows):
    plan = X.mix_sources(sourced(spark, rows))
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("budget").alias("budget"), F.first("target").alias("target"),
                                        F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect():
        assert r.taken == r.budget == int(r.target) and r.over <= 0


def test_texts_of_the_mix(spark, rows):
    docs = sourced(spark, rows)
    plan = X.mix_sources(docs)
    of = {i: t for i, _, t in rows}
    mixed = X.mixed_texts(docs, plan).collect()
    assert sum(r.words for r in mixed) == plan.agg(F.sum("taken")).first()[0]
    assert all(size(r.text) == r.words and (of[r.doc_id] or "").startswith(r.text) for r in mixed)
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += r.words
    assert taken == Counter({r.doc_id: r.taken for r in plan.collect() if r.taken})


def test_reruns_agree_and_seeds_differ(spark, rows):
    docs = sourced(spark, rows)
    key = lambda df: sorted((r.doc_id, r.taken) for r in df.collect())
    one = key(X.mix_sources(docs))
    assert one == key(X.mix_sources(docs.repartition(7))) != key(X.mix_sources(docs, seed="other"))


def test_named_weights(spark, rows):
    docs = sourced(spark, rows)
    weights = spark.createDataFrame([("hot", 9), (None, 2)], "source string, weight long")
    plan = {r.source: r for r in X.mix_sources(docs, weights).groupBy("source").agg(
        F.first("weight").alias("weight"), F.first("target").alias("target"), F.first("source_size").alias("held")).collect()}
    assert {s: r.weight for s, r in plan.items()} == {"hot": 9, None: 2, "a": 1, "b": 1, "é": 1, "tiny": 1, "none": 1}
    assert all(r.target <= 3 * r.held for r in plan.values())
    assert sum(r.target for r in plan.values()) == pytest.approx(sum(r.held for r in plan.values()))


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    got = X.mix_sources(edge_docs).collect()  # one source, null: all of it once
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((i or -1, size(t)) for i, t in edge_rows)
    assert X.mix_sources(no_docs).count() == 0
    assert X.mixed_texts(edge_docs, X.mix_sources(edge_docs)).agg(F.sum("words")).first()[0] == sum(size(t) for _, t in edge_rows)
