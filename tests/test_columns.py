"""Alias normalisation, selection and training-role mapping."""

import pytest

from ticketlake.functions.columns import sanitize_name, sanitize_name_value
from ticketlake.operators import columns as C
from ticketlake.operators.sqlrun import check_select, run_select


def test_alias_rename(spark):
    df = spark.createDataFrame([("x", "t")], "issue_description string, route_team string")
    assert C.normalize_columns(df).columns == ["description", "assigned_team"]


def test_merge_first_non_null(spark):
    df = spark.createDataFrame([(None, "2001-01-02"), ("2001-01-01", "2001-01-03"), (None, None)],
                               "created_date string, creation_date string")
    out = C.normalize_columns(df)
    assert out.columns == ["creation_date"]
    assert [r[0] for r in out.collect()] == ["2001-01-02", "2001-01-01", None]


def test_mapped_subset_order(spark):
    df = spark.createDataFrame([("u1", "text", "team", "High", "x")],
                               "ticket_uuid string, issue_description string, route_team string, "
                               "severity_level string, other string")
    out = C.prepare_training_columns(
        df, include_columns=["ticket_uuid", "issue_description", "route_team", "severity_level"])
    assert out.columns == ["ticket_id", "description", "assigned_team", "severity_level"]


def test_no_team_auto_id(spark):
    df = spark.createDataFrame([(f"text {i}", "High", "team") for i in range(5)],
                               "issue_description string, severity_level string, route_team string")
    out = C.prepare_training_columns(df, include_columns=["issue_description", "severity_level"],
                                     assigned_team_column="", ticket_id_column="")
    assert out.columns[0] == "ticket_id" and "assigned_team" not in out.columns
    rows = out.collect()
    assert sorted(r["ticket_id"] for r in rows) == [f"synthetic-{i}" for i in range(5)]
    assert {r["description"] for r in rows} == {f"text {i}" for i in range(5)}


def test_row_index_consecutive(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v")
    rows = C.with_row_index(df, "i").collect()
    assert sorted(r["i"] for r in rows) == list(range(1000))
    assert all(r["i"] == r["v"] for r in rows)


def test_resolve_errors():
    i2p = C.internal_to_public()
    with pytest.raises(ValueError):
        C.resolve_output_columns(["nope"], i2p)
    with pytest.raises(ValueError):
        C.resolve_output_columns([" ", ""], i2p)
    assert C.resolve_output_columns(["ticket_id", "ticket_uuid", " severity "], i2p) == ["ticket_uuid", "severity_level"]
    assert C.resolve_optional_column(None, "description", i2p) == "issue_description"
    assert C.resolve_optional_column("", "description", i2p) is None


def test_role_collision(spark):
    df = spark.createDataFrame([("a", "b")], "issue_description string, description string")
    with pytest.raises(ValueError):
        C.prepare_training_columns(df, description_column="issue_description", assigned_team_column="",
                                   ticket_id_column="")


def test_alias_config_fallbacks():
    p2i, req = C.load_alias_config({"internal_to_public": {"ticket_id": " ", "x": "y"},
                                    "required_internal_columns": ["", 3]})
    assert p2i == {"y": "x"} and req == C.DEFAULT_REQUIRED
    assert C.load_alias_config({"internal_to_public": []})[0] == C.DEFAULT_PUBLIC_TO_INTERNAL
    assert C.missing_required(["a"], ["b", "a", "c"]) == ["b", "c"]


def test_sanitizer(spark):
    cases = {"  My Data!!set  ": "My-Data-set", "...": "synthetic-dataset", "-a.b_c-": "a.b_c", "": "synthetic-dataset"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    got = {r["n"]: r["s"] for r in df.select("n", sanitize_name("n").alias("s")).collect()}
    assert got == cases
    assert all(sanitize_name_value(k) == v for k, v in cases.items())


def test_sql_guard(spark):
    with pytest.raises(ValueError):
        check_select("DROP TABLE tickets")
    with pytest.raises(ValueError):
        check_select("   ")
    with pytest.raises(ValueError):
        check_select("SELECT 1; DROP TABLE x")
    with pytest.raises(ValueError):
        check_select("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a")
    assert check_select("with a as (select 1 as x) select x from a") .startswith("with")
    with pytest.raises(ValueError):
        check_select("SELECT * FROM parquet.`/tmp/x.parquet`")
    with pytest.raises(ValueError):
        check_select("SELECT (SELECT max(a) FROM csv.`/tmp/x.csv`) AS m")
    assert check_select("WITH a AS (SELECT replace('a', 'a', 'b') AS x) SELECT x FROM a")
    for call in ("reflect", "JAVA_METHOD", "try_reflect", "`reflect`"):
        for sql in ("SELECT {}('java.lang.System', 'getProperty', 'user.home') AS x",
                    "SELECT 1 WHERE upper({}('java.lang.System', 'getProperty', 'user.home')) > 'a'",
                    "WITH a AS (SELECT {}('java.lang.System', 'lineSeparator') AS x) SELECT x FROM a",
                    "SELECT (SELECT max({}('java.lang.System', 'lineSeparator')) FROM range(2)) AS m",
                    "SELECT id FROM range(3) WHERE id IN (SELECT length({}('java.lang.System', 'lineSeparator')))",
                    "SELECT id FROM range(3) ORDER BY {}('java.lang.System', 'lineSeparator')",
                    "SELECT sum(id) OVER (ORDER BY {}('java.lang.System', 'lineSeparator')) FROM range(3)",
                    "SELECT * FROM range(3) r, LATERAL (SELECT {}('java.lang.System', 'lineSeparator')) l"):
            with pytest.raises(ValueError, match="JVM"):
                check_select(sql.format(call))
    assert check_select("SELECT 'reflect(x)' AS reflect")
    assert run_select(spark, "SELECT id FROM range(10000)").count() == 10000
    assert run_select(spark, "SELECT id FROM range(10000)", limit=7000).count() == 7000
    assert run_select(spark, "SELECT id FROM range(100) LIMIT 50", limit=70).count() == 50
    with pytest.raises(ValueError):
        run_select(spark, "SELECT 1", limit=0)
