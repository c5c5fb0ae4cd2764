"""Mergeable mart states against direct aggregation, also when written in two batches."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from ticketlake.operators import kpi, marts, states
from ticketlake.operators.enrich import enrich_tickets
from ticketlake.operators.quantiles import exact_quantiles
from ticketlake.operators.staging import stage_tickets
from ticketlake.sources.fixtures import tickets_raw

from .conftest import SF001


@pytest.fixture(scope="module")
def enriched(spark):
    e = enrich_tickets(stage_tickets(tickets_raw(spark, SF001)))
    # NULL groups and values on the way.
    return e.withColumn("assigned_team", F.when(F.crc32("ticket_id") % 9 > 0, F.col("assigned_team"))).withColumn(
        "vehicle_chassis_id", F.when(F.crc32("ticket_id") % 11 > 0, F.col("vehicle_chassis_id"))).cache()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_marts_from_states_are_the_marts(enriched):
    assert rows(states.team_workload(states.value_state(enriched, marts.TEAM_KEYS))) == rows(marts.team_workload(enriched))
    codes = states.value_codes(enriched, "vehicle_chassis_id")
    vehicles = states.distinct_state(enriched, marts.DEALER_KEYS, "vehicle_chassis_id", codes)
    assert rows(states.dealer_performance(states.value_state(enriched, marts.DEALER_KEYS), vehicles)) == rows(marts.dealer_performance(enriched))


def test_states_of_batches_merge(enriched):
    """Two batches, the second with new vehicles: the merged states equal those of all tickets."""
    one, two = enriched.where("created_year < 1997"), enriched.where("created_year >= 1997")
    keys = ["assigned_team"]
    merged = states.merge_values(states.value_state(one, marts.TEAM_KEYS).unionByName(states.value_state(two, marts.TEAM_KEYS)), keys)
    probs, names = [0.25, 0.5, 0.9], ["p25", "p50", "p90"]
    got = {r["assigned_team"]: r for r in states.state_quantiles(merged, keys, probs, names).collect()}
    want = {r["assigned_team"]: r for r in exact_quantiles(enriched.where("is_closed"), keys, "resolution_hours", probs, names).collect()}
    assert set(got) >= set(want) and None in got
    assert all(abs(got[k][n] - want[k][n]) < 0.006 for k in want for n in names)

    first = states.value_codes(one, "vehicle_chassis_id")
    both = states.value_codes(two, "vehicle_chassis_id", first)
    held = {r["value"]: r["code"] for r in both.collect()}
    assert sorted(held.values()) == list(range(1, len(held) + 1))
    assert all(held[r["value"]] == r["code"] for r in first.collect())
    state = states.distinct_state(one, marts.DEALER_KEYS, "vehicle_chassis_id", first).unionByName(
        states.distinct_state(two, marts.DEALER_KEYS, "vehicle_chassis_id", both))
    assert rows(states.distinct_counts(state, ["geo_region"], "n")) == rows(
        enriched.groupBy("geo_region").agg(F.count_distinct("vehicle_chassis_id").alias("n")))


def test_codes_beyond_one_bitmap(spark):
    df = spark.range(70_000).select((F.col("id") % 3).alias("g"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    state = states.distinct_state(df, ["g"], "v", states.value_codes(df, "v"))
    assert state.select("code_range").distinct().count() == 3 and state.where("length(codes) > 4096").count() == 0
    assert rows(states.distinct_counts(state, ["g"], "n")) == [(0, 23334), (1, 23333), (2, 23333)]


def test_dealer_summary_counts_a_vehicle_once(enriched):
    codes = states.value_codes(enriched, "vehicle_chassis_id")
    vehicles = states.distinct_state(enriched, marts.DEALER_KEYS, "vehicle_chassis_id", codes)
    flt = kpi.KpiFilter(date_from="1995-01-01", date_to="1997-12-31")
    out = kpi.dealer_summary(marts.dealer_performance(enriched), flt, top=None, vehicles=vehicles).collect()
    want = {(r["dealer_label"], r["dealer_country"]): r["n"] for r in enriched.where("created_month BETWEEN '1995-01-01' AND '1997-12-31'").groupBy(
        "dealer_label", "dealer_country").agg(F.count_distinct("vehicle_chassis_id").alias("n")).collect()}
    assert {(r["Dealer"], r["Country"]): r["Distinct Vehicles"] for r in out} == want
    assert all(r["Distinct Vehicles"] <= r["Vehicles"] for r in out)


def test_sketches_are_close(enriched):
    state = states.sketch_state(enriched, marts.TEAM_KEYS, "vehicle_chassis_id")
    got = {r["assigned_team"]: r for r in states.sketch_estimates(state, ["assigned_team"]).collect()}
    for r in enriched.groupBy("assigned_team").agg(F.count_distinct("vehicle_chassis_id").alias("n"), F.expr(
            "percentile(resolution_hours, array(0.45, 0.55)) FILTER (WHERE is_closed)").alias("m")).collect():
        assert abs(got[r["assigned_team"]]["distinct_estimate"] - r["n"]) <= 0.05 * r["n"] + 1
        if r["m"]:
            assert r["m"][0] <= got[r["assigned_team"]]["median_estimate"] <= r["m"][1]


def test_empty_table(enriched):
    none = enriched.limit(0)
    state = states.value_state(none, marts.TEAM_KEYS)
    assert states.team_workload(state).count() == 0 and states.value_codes(none, "vehicle_chassis_id").count() == 0
    assert states.state_quantiles(state, ["assigned_team"], [0.5], ["m"]).count() == 0


def test_a_bucket_of_continuous_values_is_cut(spark):
    """All values fall in one bucket of 0.07 %: its pieces, not the bucket, are ranked by a window."""
    rng = random.Random(1)
    values = [1000.0 + rng.random() * 0.3 for _ in range(4001)] + [1000.1] * 500 + [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = exact_quantiles(df, [], "v", [0.0, 0.5, 1.0], ["a", "b", "c"]).first()
    assert (r["a"], r["b"], r["c"]) == (min(values), statistics.median(values), float("inf"))
    plan = exact_quantiles(df, [], "v", [0.5], ["b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [sum(_c" in plan and ", _p#" in plan


def test_weights(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1), ("b", None, 4), ("a", 9.0, 1)], "g string, v double, n long")
    assert [(r["g"], r["m"]) for r in exact_quantiles(df, ["g"], "v", [0.5], ["m"], weight="n").collect()] == [("a", 1.0)]
