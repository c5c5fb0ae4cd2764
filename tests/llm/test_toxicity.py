import random
import zlib

from ticketlake.llm import toxicity as T
from ticketlake.llm.queries import QUERIES

from .conftest import SF001, documents, words


def test_edge_rows_and_labels(spark, edge_rows, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    none = labels.limit(0)
    for known in (labels, none):
        rows = T.score_toxicity(edge_docs, known).collect()
        assert len(rows) == len(edge_rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        for r in rows:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert T.score_toxicity(no_docs, labels).collect() == []


def test_insults_are_told_from_prose(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(600):
        text = words(rng, rng.randint(20, 300))
        bad = i % 8 == 0
        if bad:
            for _ in range(max(2, len(text) // 40)):
                text.insert(rng.randrange(len(text)), rng.choice(["vexling", "grubbert", "snidewort"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    got = T.score_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 80
    assert sum(r.predicted == (r.doc_id % 8 == 0) for r in held) / len(held) > 0.97


def test_weights_follow_the_formula(spark):
    counts = spark.createDataFrame([(1, 5, 1, 4), (2, 0, 9, 6), (3, 1, 0, 1), (4, 2, 1, 2), (5, 1, 2, 3)],
                                   "key long, toxic long, ordinary long, held_by long")
    weights, other = T.word_weights(counts)
    rows = {r.key: r for r in counts.collect()}
    import math

    def model(c):
        values = [r[c] for r in rows.values()]
        n1, n2 = values.count(1), values.count(2)
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
        back = d * sum(v > 0 for v in values) / sum(values)
        return (lambda r: max(r[c] - d, 0) / sum(values) + back * r.held_by / 16), back

    (pt, bt), (po, bo) = model("toxic"), model("ordinary")
    for r in weights.collect():
        assert abs(r.weight - math.log(1 - T.MIX + T.MIX * pt(rows[r.key]) / po(rows[r.key]))) < 1e-12
    assert abs(other - math.log(1 - T.MIX + T.MIX * bt / bo)) < 1e-12
    assert abs(sum(pt(r) for r in rows.values()) - 1) < 1e-12


def test_query_covers_every_document(spark):
    assert QUERIES["op2_toxicity"](spark, SF001).count() == spark.read.parquet(f"{SF001}/documents.parquet").count()


def test_backoff_is_normalised_over_all_stems(spark):
    import math
    fields = "key long, toxic long, ordinary long, held_by long"
    all_stems = [(1, 5, 1, 4), (2, 0, 9, 6), (3, 1, 0, 1), (4, 0, 0, 70), (5, 0, 0, 19)]
    weights, _ = T.word_weights(T.labelled_counts(spark.createDataFrame(all_stems, fields)))
    got = {r.key: r.weight for r in weights.collect()}
    assert set(got) == {1, 2, 3}

    def p(c, held, total, n1, t):
        d = min(max(n1 / n1, 0.1), 0.95)
        return max(c - d, 0) / total + d * t / total * held / 100

    assert abs(got[1] - math.log(1 - T.MIX + T.MIX * p(5, 4, 6, 1, 2) / p(1, 4, 10, 1, 2))) < 1e-12


def scores_by_definition(rows, labels):
    """(per_word, score) of every (doc_id, text) row, in plain Python."""
    import math
    import re
    from collections import Counter

    import numpy as np

    known = {}
    for i, t in labels:
        if i is not None and t in (0, 1):
            known[i] = max(t, known.get(i, 0))
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    stems = [[w[:7] for w in re.findall(r"[^\W\d_]+", (t or "").lower())] for _, t in rows]
    held_by = Counter(s for found in stems for s in set(found))
    of_class = [Counter(), Counter()]
    for (i, _), found in zip(rows, stems):
        if i in known and fold(i) in (1, 2, 3):
            of_class[known[i]].update(found)
    documents_of = sum(held_by.values())

    def model(c):
        total, d1, d2 = sum(c.values()), list(c.values()).count(1), list(c.values()).count(2)
        d = min(max(d1 / (d1 + 2 * d2) if d1 else 0.5, 0.1), 0.95)
        return lambda s: max(c[s] - d, 0) / total + d * len(c) / total * (held_by[s] / documents_of if s in seen else 1)

    seen = set(of_class[0]) | set(of_class[1])
    ordinary, toxic = map(model, of_class)
    weight = {s: math.log(0.99 + 0.01 * toxic(s) / ordinary(s)) for s in held_by}
    per_word = [sum(weight[s] for s in found) / max(len(found), 1) for found in stems]
    fit = [(p, math.sqrt(len(f)), known[i]) for (i, _), f, p in zip(rows, stems, per_word) if i in known and fold(i) == 4]
    x, root, y = (np.array(c, float) for c in zip(*fit))
    scale = x.std(ddof=1)
    a = np.column_stack([np.ones(len(x)), x / scale, x / scale * root / 16])
    w = np.zeros(3)
    for _ in range(200):  # Newton steps on the penalised loss, until its gradient is gone
        p = 1 / (1 + np.exp(-(a @ w)))
        g = a.T @ (y - p) - 1e-3 * w
        w = w + np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-3 * np.eye(3), g)
    assert np.abs(a.T @ (y - 1 / (1 + np.exp(-(a @ w)))) - 1e-3 * w).max() < 1e-8
    z = [w[0] + w[1] * p / scale + w[2] * p / scale * math.sqrt(len(f)) / 16 for p, f in zip(per_word, stems)]
    return [(p, 1 / (1 + math.exp(-v))) for p, v in zip(per_word, z)]


def test_scores_by_definition(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        text = words(rng, rng.randint(1, 120))
        bad = rng.random() < 0.2
        for _ in range(rng.randint(0, 3) if bad else rng.random() < 0.05):
            text.insert(rng.randrange(len(text)), rng.choice(["vexling", "grubberted", "snidewort"]))
        rows.append((i, " ".join(text)))
        if i % 6:
            labels.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (None, rows[0][1]), (7, rows[8][1])]
    want = sorted((-1 if i is None else i, p, s) for (i, _), (p, s) in zip(rows, scores_by_definition(rows, labels)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.per_word, r.score)
                 for r in T.score_toxicity(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect())
    assert [g[0] for g in got] == [w[0] for w in want]
    assert max(abs(a - b) for (_, a, _), (_, b, _) in zip(got, want)) < 1e-5
    assert max(abs(a - b) for (*_, a), (*_, b) in zip(got, want)) < 1e-3
