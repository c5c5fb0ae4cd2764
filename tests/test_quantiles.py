"""Exact quantiles against a brute-force sort, including a hot group."""

import math
import random

from pyspark.sql import functions as F

from ticketlake.operators.quantiles import exact_quantiles, join_on_keys, value_bucket

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


def brute(values, p):
    """Linear interpolation between the closest ranks of the sorted values."""
    s = sorted(values)
    pos = p * (len(s) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    if lo == hi or s[lo] == s[hi]:
        return s[lo]
    return (hi - pos) * s[lo] + (pos - lo) * s[hi]


def fixture():
    rnd = random.Random(7)
    rows = []
    for _ in range(6000):
        # 'hot' holds about half of all rows; NULL is a group of its own.
        g = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None])
        r = rnd.random()
        if r < 0.05:
            v = None
        elif r < 0.7:
            v = round(rnd.gauss(0, 50), rnd.choice([0, 2, 4]))
        else:
            v = rnd.choice([0.0, 7.5, -2.25, 1e7, 3e-8])
        rows.append((g, v))
    return rows


def test_matches_brute_force_per_group(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: [r[n] for n in NAMES] for r in exact_quantiles(df, ["g"], "v", PROBS, NAMES).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vals in groups.items():
        for p, x in zip(PROBS, got[g]):
            assert math.isclose(x, brute(vals, p), rel_tol=1e-12, abs_tol=1e-12), (g, p)


def test_global_and_equal_to_spark_percentile(spark):
    df = spark.createDataFrame(fixture(), "g string, v double")
    mine = exact_quantiles(df, [], "v", PROBS, NAMES).first()
    ref = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("a")).first()["a"]
    assert [mine[n] for n in NAMES] == ref


def test_group_without_values_is_absent_and_join_keeps_null_keys(spark):
    df = spark.createDataFrame([("x", None), ("y", 1.0), (None, 2.0), (None, 4.0)], "g string, v double")
    q = exact_quantiles(df, ["g"], "v", [0.5], ["m"])
    assert {(r["g"], r["m"]) for r in q.collect()} == {("y", 1.0), (None, 3.0)}
    n = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    out = {(r["g"], r["n"], r["m"]) for r in join_on_keys(n, q, ["g"]).collect()}
    assert out == {("x", 1, None), ("y", 1, 1.0), (None, 2, 3.0)}


def test_bucket_is_monotone(spark):
    vals = sorted({0.0, -0.0, 1e-300, -1e-300, 0.5, 1.0, 1.0000001, 2.0, 1e12, -1e12, -3.5, -3.4999999,
                   float("inf"), float("-inf")} | {random.Random(3).uniform(-1e6, 1e6) for _ in range(2000)})
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["b"] for r in df.select("v", value_bucket(F.col("v")).alias("b")).orderBy("v").collect()]
    assert all(a <= b for a, b in zip(got, got[1:]))


def test_unused_median_is_pruned_from_the_plan(spark):
    """A query that reads no median column plans no quantile branch; one that
    does keeps the left join (the mart tests and KPI sums rely on this)."""
    from ticketlake.operators import marts
    from ticketlake.registry import enriched

    from .conftest import SF001
    mart = marts.team_workload(enriched(spark, SF001))
    lean = mart.select("assigned_team", "total_tickets")._jdf.queryExecution().optimizedPlan().toString()
    full = mart._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in lean and "Window" not in lean
    assert "LeftOuter" in full and "Window" in full


def test_approx_marts_keep_schema_and_groups(spark):
    from ticketlake.operators import marts
    from ticketlake.registry import enriched

    from .conftest import SF001
    enr = enriched(spark, SF001)
    for fn, keys in [(marts.team_workload, marts.TEAM_KEYS), (marts.product_defects, marts.PRODUCT_KEYS)]:
        exact, approx = fn(enr), fn(enr, approx=True)
        assert exact.columns == approx.columns
        e = {tuple(r[k] for k in keys): r["median_resolution_hours"] for r in exact.collect()}
        a = {tuple(r[k] for k in keys): r["median_resolution_hours"] for r in approx.collect()}
        assert e.keys() == a.keys()
        assert all((v is None) == (a[k] is None) for k, v in e.items())
    # percentile_approx returns one of the group's values (no interpolation),
    # so it lies within the group's closed-ticket range.
    for r in marts.team_workload(enr, approx=True).collect():
        if r["median_resolution_hours"] is not None:
            assert r["min_resolution_hours"] <= r["median_resolution_hours"] <= r["max_resolution_hours"]
