"""Quality profile against pandas on small frames."""

import numpy as np
import pandas as pd

from ticketlake.operators import quality


def test_overview_and_nulls(spark):
    pdf = pd.DataFrame({"a": ["x", "x", None, None, "y"], "b": [1.0, 1.0, None, None, 2.0]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a string, b double")
    r = quality.overview(df).first()
    assert r["rows"] == 5 and r["columns"] == 2
    assert r["duplicate_rows"] == int(pdf.duplicated().sum()) == 2
    assert abs(r["overall_null_pct"] - pdf.isnull().mean().mean() * 100) < 1e-4
    nulls = {x["column"]: x["null_pct"] for x in quality.null_by_column(df).collect()}
    assert nulls == {"a": 40.0, "b": 40.0}
    prof = {x["column"]: x for x in quality.schema_profile(df).collect()}
    assert prof["a"]["unique_values"] == 2 and prof["b"]["type"] == "double" and prof["a"]["sample"] == "x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string")
    r = quality.overview(df).first()
    assert r["rows"] == 0 and r["duplicate_pct"] is None


def test_stats_and_histogram(spark):
    rng = np.random.default_rng(1)
    secs = list(rng.exponential(36000, size=2000)) + [None, "bad"]
    df = spark.createDataFrame([(str(x) if x is not None else None,) for x in secs], "time_to_close_seconds string")
    h = pd.Series([x for x in secs if isinstance(x, float)]) / 3600
    r = quality.resolution_stats(df).first()
    q1, q3 = h.quantile(0.25), h.quantile(0.75)
    assert r["n"] == 2000
    assert abs(r["median_hours"] - h.median()) < 1e-4 and abs(r["p95_hours"] - h.quantile(0.95)) < 1e-4
    assert r["outliers"] == int(((h < q1 - 1.5 * (q3 - q1)) | (h > q3 + 1.5 * (q3 - q1))).sum())
    hist = quality.histogram(df).collect()
    assert sum(x["count"] for x in hist) == 2000 and max(x["bin"] for x in hist) == 59


def test_stats_and_histogram_on_no_numeric_rows(spark):
    df = spark.createDataFrame([(None,), ("bad",)], "time_to_close_seconds string")
    r = quality.resolution_stats(df).first()
    assert r["n"] == 0 and r["median_hours"] is None and r["outliers"] == 0
    assert quality.histogram(df).collect() == []


def test_both_zeros_are_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "x double")
    assert quality.schema_profile(df).first()["unique_values"] == 2


def _typed(spark):
    cols = {"i": "int", "l": "bigint", "b": "boolean", "d": "date", "n": "timestamp_ntz", "t": "timestamp", "m": "decimal(12,3)", "w": "decimal(30,2)",
            "f": "float", "x": "double", "s": "string", "a": "array<int>"}
    rows = [("-5", "9007199254740993", "true", "1969-12-31", "1969-12-31 23:59:59.5", "2001-01-01 00:00:00", "-1.250", "3.10", "0.5", "NaN", "ž", 1),
            ("7", "9007199254740992", "false", "2001-08-02", "2001-08-02 12:00:00", "1999-01-01 00:00:00", "4.000", "2.50", "-0.0", "-Infinity", "B", 2),
            ("7", "-9007199254740993", None, "2001-08-02", None, None, None, None, "0.0", "0.0", "", 1), (None,) * 12]
    raw = spark.createDataFrame([tuple(None if v is None else str(v) for v in r) for r in rows], ", ".join(f"{c} string" for c in cols))
    return raw.selectExpr(*[f"CAST({c} AS {t}) AS {c}" if c != "a" else "IF(a IS NULL, NULL, array(CAST(a AS int))) AS a" for c, t in cols.items()])


def test_profile_of_every_type(spark):
    df = _typed(spark)
    got = {r["column"]: r for r in quality.schema_profile(df).collect()}
    assert list(got) == df.columns and {c: r["type"] for c, r in got.items()} == dict(df.dtypes)
    one = df.selectExpr(*[f"count(DISTINCT IF({c} = 0, abs({c}), {c})) AS {c}" if t in ("float", "double") else f"count(DISTINCT {c}) AS {c}"
                          for c, t in df.dtypes]).first()
    assert {c: r["unique_values"] for c, r in got.items()} == one.asDict()
    low = df.selectExpr(*[f"CAST(min({c}) AS string) AS {c}" for c in df.columns if c not in ("f", "w")]).first().asDict()
    assert {c: got[c]["sample"] for c in low} == low
    assert got["f"]["sample"] in ("0.0", "-0.0") and got["i"]["null_pct"] == 25.0


def test_profile_with_a_full_dictionary(spark, monkeypatch):
    """A task that forgets its dictionary emits keys again; the counts stay."""
    df = spark.range(0, 40_000, 1, 3).selectExpr("id % 9000 AS k", "concat('v', id % 9500) AS v", "id % 3 AS s")
    got = {r["column"]: r["unique_values"] for r in quality.schema_profile(df).collect()}
    assert got == {"k": 9000, "v": 9500, "s": 3}


def test_profile_is_one_pass_without_expansion(spark):
    plan = quality.schema_profile(_typed(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Generate" not in plan and plan.count("Scan ") == 1 and plan.count("MapInArrow") == 1


def test_duplicates_shuffle_hashes_only(spark):
    rows = [(i % 50, f"text {i % 50}", None if i % 7 else 1.5) for i in range(700)] + [(None, None, None)] * 3 + [(None, "x", None), ("1", None, None)]
    df = spark.createDataFrame([(None if a is None else int(a), b, c) for a, b, c in rows], "a int, b string, c double")
    pdf = pd.DataFrame([(a if a is None else int(a), b, c) for a, b, c in rows])
    r = quality.overview(df).first()
    assert r["duplicate_rows"] == int(pdf.duplicated().sum()) > 0
    assert {(x["a"], x["b"], x["c"]): x["n"] for x in quality.duplicate_groups(df).collect()}[(None, None, None)] == 3
    plan = quality.row_hashes(df)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "h1" in shuffled[0] and " b#" not in shuffled[0]


def test_nulls_in_different_columns_are_different_rows(spark):
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert quality.row_hashes(df).count() == 2 and quality.overview(df).first()["duplicate_rows"] == 0
