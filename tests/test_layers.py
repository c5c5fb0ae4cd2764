"""Staging casts, enrichment edge rows (SLA, buckets, flags) and mart rates."""

import datetime as dt

import pytest
from pyspark.sql import Row

from ticketlake.operators import expectations as ex
from ticketlake.operators import marts
from ticketlake.operators.enrich import enrich_tickets
from ticketlake.operators.staging import stage_tickets
from ticketlake.sources import storage
from ticketlake.sources.fixtures import tickets_raw

from .conftest import SF001

BASE = {f.name: None for f in storage.RAW_CSV_SCHEMA.fields}


def raw_rows(spark, rows):
    full = [{**BASE, "ticket_id": f"E-{i}", "severity_level": "Critical", "ticket_status": "Closed",
             "created_timestamp": "2001-08-01 00:00:00", "created_date": "2001-08-01",
             "first_queue_seconds": 60, "odometer_reading": 10.0, "odometer_unit": "km", **r}
            for i, r in enumerate(rows)]
    return spark.createDataFrame([Row(**r) for r in full], storage.RAW_CSV_SCHEMA)


def enriched(spark, rows, as_of=dt.datetime(2001, 8, 2, 12)):
    return {r["ticket_id"]: r for r in enrich_tickets(stage_tickets(raw_rows(spark, rows)), as_of).collect()}


def test_csv_cast_path(spark, tmp_dir):
    path = f"{tmp_dir}/raw.csv"
    header = ",".join(f.name for f in storage.RAW_CSV_SCHEMA.fields)
    vals = {f.name: "" for f in storage.RAW_CSV_SCHEMA.fields}
    vals.update(ticket_id="T-1", created_timestamp="2001-01-02 03:04:05", created_date="2001-01-02",
                closed_timestamp="", closed_date="", odometer_reading="100", odometer_unit="Miles",
                first_queue_seconds="7", resolution_seconds="")
    with open(path, "w") as fh:
        fh.write(header + "\n" + ",".join(vals[f.name] for f in storage.RAW_CSV_SCHEMA.fields) + "\n")
    stg = stage_tickets(storage.read_csv(spark, path, storage.RAW_CSV_SCHEMA)).first()
    assert stg["created_at"] == dt.datetime(2001, 1, 2, 3, 4, 5)
    assert stg["closed_at"] is None and stg["closed_date"] is None
    assert abs(stg["odometer_km"] - 160.934) < 1e-9
    assert stg["first_queue_seconds"] == 7


def test_sla_edge_rows(spark):
    e = enriched(spark, [
        {"created_timestamp": None},                                             # E-0
        {"resolution_seconds": None},                                            # E-1 Closed, no resolution
        {"ticket_status": None},                                                 # E-2
        {"resolution_seconds": 86400.0},                                         # E-3 exactly 24h Critical
        {"resolution_seconds": -5.0},                                            # E-4 negative
        {"resolution_seconds": 86401.0},                                         # E-5 breach
        {"ticket_status": "Resolved", "resolution_seconds": 10.0,
         "created_timestamp": "2001-07-30 00:00:00"},                            # E-6 Resolved judged open
        {"ticket_status": "New", "severity_level": "Unknown",
         "created_timestamp": "1999-01-01 00:00:00"},                            # E-7 unknown severity
        {"ticket_status": "New", "created_timestamp": "2001-08-01 12:00:00"},    # E-8 exactly 24h elapsed
    ])
    assert e["E-0"]["is_sla_breach"] is None
    assert e["E-1"]["is_sla_breach"] is False
    assert e["E-2"]["is_closed"] is None and e["E-2"]["is_open"] is None and e["E-2"]["is_sla_breach"] is False
    assert e["E-3"]["is_sla_breach"] is False and e["E-3"]["resolution_bucket"] == "4–24h"
    assert e["E-4"]["resolution_bucket"] == "0–4h"
    assert e["E-5"]["is_sla_breach"] is True
    assert e["E-6"]["is_open"] is True and e["E-6"]["is_sla_breach"] is True
    assert e["E-7"]["is_sla_breach"] is False
    assert e["E-8"]["is_sla_breach"] is False
    assert e["E-1"]["resolution_bucket"] == "Open"
    assert e["E-3"]["created_day_of_week"] == 3  # 2001-08-01 was a Wednesday (0 = Sunday)
    assert e["E-3"]["days_open"] == 1


def test_negative_resolution_fails_singular_test(spark):
    stg = stage_tickets(raw_rows(spark, [{"resolution_seconds": -5.0}, {"resolution_seconds": 5.0}]))
    assert [r["ticket_id"] for r in ex.negative_resolution(stg).collect()] == ["E-0"]
    res = {r["test"]: r for r in ex.run_singular(stg).collect()}
    assert res["assert_no_negative_resolution"]["passed"] is False


def test_rates_null_without_closed(spark):
    enr = enrich_tickets(stage_tickets(raw_rows(spark, [{"ticket_status": "New", "assigned_team": "A"}] * 2)))
    r = marts.team_workload(enr).first()
    assert r["closed_tickets"] == 0 and r["sla_breach_rate_pct"] is None and r["avg_resolution_hours"] is None
    assert r["total_tickets"] == 2 and r["critical_pct"] == 100.0


def test_suite_passes_on_driver_tables(spark):
    from ticketlake.registry import all_models
    res = ex.run_suite(all_models(spark, SF001)).collect()
    assert len(res) == 41 and all(r["passed"] for r in res)


def test_suite_catches_duplicates(spark):
    raw = raw_rows(spark, [{"ticket_id": "X"}, {"ticket_id": "X"}, {"ticket_status": "Bogus"}])
    res = {(r["model"], r["test"], r["column"]): r["failures"]
           for r in ex.run_suite({"raw": raw}).collect()}
    assert res[("raw", "unique", "ticket_id")] == 1
    assert res[("raw", "accepted_values", "ticket_status")] == 1


def test_build_gates_and_writes(spark, tmp_dir):
    from ticketlake.plans.build import build_marts
    raw = tickets_raw(spark, SF001)
    res = build_marts(spark, raw, tmp_dir)
    assert spark.read.parquet(res.paths["ticket_kpis"]).count() == raw.count()
    assert spark.table("marts.team_workload").count() > 0
    bad = raw.unionByName(raw.limit(1))
    try:
        build_marts(spark, bad, tmp_dir + "/bad")
        raise AssertionError("duplicate ticket ids must stop the build")
    except ex.DataTestFailure as exc:
        assert "unique" in str(exc)


def test_upstream_one_pass_equals_separate(spark):
    from ticketlake.registry import all_models
    raw = tickets_raw(spark, SF001)
    one, _ = ex.upstream_suite(raw)
    m = all_models(spark, SF001)
    sep = ex.run_suite({k: m[k] for k in ("raw", "staging", "enriched")}).unionByName(
        ex.run_singular(stage_tickets(raw)))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, sep.collect()))


def test_failed_build_keeps_the_published_marts(spark, tmp_dir):
    from ticketlake.operators.expectations import DataTestFailure
    from ticketlake.plans.build import build_marts
    from ticketlake.sources.fixtures import tickets_raw
    raw = tickets_raw(spark, SF001).limit(200)
    res = build_marts(spark, raw, tmp_dir, register=False)
    assert res.tests.count() > 20
    before = spark.read.parquet(res.paths["ticket_kpis"]).count()
    with pytest.raises(DataTestFailure):
        build_marts(spark, raw.unionByName(raw.limit(3)), tmp_dir, register=False)
    assert spark.read.parquet(res.paths["ticket_kpis"]).count() == before


def test_size_check_sees_a_grown_table(spark, tmp_dir):
    from ticketlake.plans import session
    path = f"{tmp_dir}/grown"
    spark.range(5).write.parquet(path)
    old, session.MAX_BROADCAST_BYTES = session.MAX_BROADCAST_BYTES, 200
    try:
        hinted = lambda: "ResolvedHint" in session.sized_broadcast(
            spark.read.parquet(path), 10)._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in session.sized_broadcast(
            spark.read.parquet(path), 10)._jdf.queryExecution().logical().toString()
        assert hinted()
        spark.range(1000).write.mode("append").parquet(path)
        spark.catalog.refreshByPath(path)
        assert not hinted()
    finally:
        session.MAX_BROADCAST_BYTES = old


def test_several_rules_for_a_component_keep_one_row_per_ticket(spark):
    from ticketlake.operators import rules
    t = spark.createDataFrame([("1", "a"), ("2", "b")], "ticket_id string, component string")
    r = spark.createDataFrame([("a", "Z"), ("a", "Y")], "component string, rule_team string")
    assert sorted((x["ticket_id"], x["rule_team"]) for x in rules.apply_routing_rules(t, r).collect()) == [("1", "Y"), ("2", None)]
