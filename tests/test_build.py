"""Versions: readers see one set of marts, layers have qualified names, failed builds leave nothing."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import expectations as ex
from ticketlake.operators import marts, states
from ticketlake.operators.enrich import enrich_tickets
from ticketlake.operators.staging import stage_tickets
from ticketlake.plans import build
from ticketlake.sources.fixtures import tickets_raw

from .conftest import SF001


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def raw(spark):
    return tickets_raw(spark, SF001).cache()


@pytest.fixture(scope="module")
def built(spark, raw, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("marts"))
    first = build.build_marts(spark, raw, out, database="m1")
    return out, first


def test_layers_by_qualified_name(spark, raw, built):
    enriched = enrich_tickets(stage_tickets(raw))
    for name, df in (("raw.support_tickets", raw), ("staging.stg_support_tickets", stage_tickets(raw)),
                     ("intermediate.int_tickets_enriched", enriched), ("m1.ticket_kpis", marts.ticket_fact(enriched)),
                     ("m1.team_workload", marts.team_workload(enriched)), ("m1.dealer_performance", marts.dealer_performance(enriched)),
                     ("m1.product_defects", marts.product_defects(enriched))):
        got = spark.table(name)
        assert set(got.columns) == set(df.columns), name
        assert rows(got.select(df.columns)) == rows(df), name
        assert name.startswith("m1.") or spark.sql(f"SELECT count(*) AS n FROM {name}").first()["n"] == raw.count()


def test_readers_see_one_version_and_old_ones_go(spark, raw, built):
    out, first = built
    before = {n: spark.table(f"m1.{n}") for n in build.MART_NAMES}
    pinned = build.read_marts(spark, "m1")
    total = raw.count()
    half = raw.where("crc32(ticket_id) % 2 = 0")
    second = build.build_marts(spark, half, out, database="m1")
    # Planned before the switch: still the first version, in all marts alike.
    assert before["ticket_kpis"].count() == total
    for held in (before, pinned):
        assert {n: held[n].agg(F.sum("total_tickets")).first()[0] for n in build.MART_NAMES[1:]} == dict.fromkeys(build.MART_NAMES[1:], total)
    assert spark.table("m1.current").first()["version"] == second.version != first.version
    assert {spark.table(f"m1.{n}").agg(F.sum("total_tickets")).first()[0] for n in build.MART_NAMES[1:]} == {half.count()}
    assert build.read_marts(spark, "m1", first.version)["ticket_kpis"].count() == total
    # Codes of the first version stay what they were.
    one, two = (build.read_marts(spark, "m1", v)["vehicle_codes"] for v in (first.version, second.version))
    assert one.join(two.withColumnRenamed("code", "c2"), "value").where("code <> c2").count() == 0
    third = build.build_marts(spark, raw, out, database="m1")
    assert build.stored_versions(spark, out) == [second.version, third.version]
    assert not os.path.exists(first.paths["team_workload"])
    assert spark.table("m1.ticket_kpis_versions").select("version").distinct().count() == 2


def test_the_current_version_prunes_folders(spark, built):
    plan = spark.table("m1.ticket_kpis").where("created_month = DATE '1997-03-01'")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "version" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "created_month" in scan


def test_rollups_from_published_states(spark, raw, built):
    held = build.read_marts(spark, "m1")
    enriched = enrich_tickets(stage_tickets(raw))
    assert rows(states.distinct_counts(held["dealer_vehicles"], ["geo_region"], "n")) == rows(
        enriched.groupBy("geo_region").agg(F.count_distinct("vehicle_chassis_id").alias("n")))
    got = states.state_quantiles(held["team_values"], ["assigned_team"], [0.5], ["m"]).select("assigned_team", "closed_tickets")
    assert rows(got) == rows(enriched.where("is_closed").groupBy("assigned_team").count())


def test_a_failed_build_leaves_no_version(spark, raw, built):
    out, _ = built
    now = spark.table("m1.current").first()["version"]
    held = build.stored_versions(spark, out)
    with pytest.raises(ex.DataTestFailure):
        build.build_marts(spark, raw.unionByName(raw.limit(1)), out, database="m1")
    assert build.stored_versions(spark, out) == held and spark.table("m1.current").first()["version"] == now
    assert spark.table("m1.team_workload").count() > 0


def test_the_clock_is_part_of_a_build(spark, raw, tmp_path):
    early = dt.datetime(1996, 1, 1)
    build.build_marts(spark, raw, str(tmp_path), as_of=early, database="m2")
    want = enrich_tickets(stage_tickets(raw), early).where("is_sla_breach").count()
    assert spark.table("intermediate.int_tickets_enriched").where("is_sla_breach").count() == want
    assert spark.table("m2.ticket_kpis").where("is_sla_breach").count() == want


def test_approximate_build_has_no_states(spark, raw, tmp_path):
    res = build.build_marts(spark, raw, str(tmp_path), approx=True, database="m3")
    assert set(res.paths) == {build.RAW_NAME, *build.MART_NAMES}
    assert set(build.read_marts(spark, "m3")) == set(build.MART_NAMES)
