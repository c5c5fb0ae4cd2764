"""Mergeable states of the marts: counts, value counts and distinct bitmaps.

A finished mart cannot be rolled up: monthly medians do not add to a yearly one,
monthly distinct vehicles count a vehicle once per month.  The states can, and
exactly, without reading the tickets again:

* *value state*: one row per (mart keys, closed resolution hours) with every
  count the marts show.  It is one partial aggregation over the fact, so a hot team
  spreads over its values, and grouping it by fewer keys gives the state of the
  coarser mart.  Averages, rates, extremes and all quantiles follow from it.
* *distinct state*: one row per (mart keys, code range) with a bitmap of the codes
  that occur.  Codes are dense whole numbers from a dictionary that is kept and
  only grows, so states written later still merge; bitmaps of a coarser mart
  are the OR of the finer ones.  A row is at most 4 kB whatever a group holds.

``sketch_state`` keeps the same two things in bounded bytes a row (HLL and KLL) where an
estimate will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_where, pct, round_half_up
from .marts import (DEALER_KEYS, MEDIAN, PRODUCT_KEYS, TEAM_KEYS, _closed, _counts, dealer_measures, product_measures,
                    team_measures)
from .quantiles import attach_quantiles, join_on_keys

COUNTS = ("total", "closed", "open", "critical", "high", "warranty", "breached")
VALUE = "resolution_hours"
# Ranges of the hash that number new dictionary values side by side.
CODE_RANGES = 4096


# --- value state -------------------------------------------------------------------------

def value_state(tickets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, resolution_hours of closed tickets or NULL, n_<count>.., n_queue, sum_queue)."""
    counts = _counts()
    return tickets.groupBy(*keys, _closed(VALUE).alias(VALUE)).agg(
        *[counts[c].alias(f"n_{c}") for c in COUNTS],
        count_where(F.col("is_closed") & F.col("is_sla_breach")).alias("n_closed_breached"),
        F.count("first_queue_hours").alias("n_queue"), F.sum("first_queue_hours").alias("sum_queue"))


def merge_values(state: DataFrame, keys: list[str]) -> DataFrame:
    """The value state by fewer (or derived) keys."""
    sums = [*[f"n_{c}" for c in COUNTS], "n_closed_breached", "n_queue", "sum_queue"]
    return state.groupBy(*keys, VALUE).agg(*[F.sum(c).alias(c) for c in sums])


def _state_counts() -> dict[str, Column]:
    return {c: F.sum(f"n_{c}") for c in COUNTS}


def _state_hours() -> dict[str, Column]:
    times = F.when(F.col(VALUE).isNotNull(), F.col("n_total"))
    return {"avg": F.sum(F.col(VALUE) * F.col("n_total")) / F.sum(times), "min": F.min(VALUE), "max": F.max(VALUE),
            "queue": F.sum("sum_queue") / F.nullif(F.sum("n_queue"), F.lit(0))}


def from_state(state: DataFrame, keys: list[str], measures: list[tuple[str, Column | object]],
               distinct: dict[str, DataFrame] | None = None) -> DataFrame:
    """One row per group with the measures in order; MEDIAN entries are the exact median, and a
    measure named in ``distinct`` is taken from that (keys, name) frame."""
    distinct = distinct or {}
    own = [(n, e) for n, e in measures if e is not MEDIAN and n not in distinct]
    out = state.groupBy(*keys).agg(*[e.alias(n) for n, e in own])
    out = attach_quantiles(out, state, keys, VALUE, [0.5], ["_median"], weight="n_total")
    for frame in distinct.values():
        out = join_on_keys(out, frame, keys)
    return out.select(*keys, *[round_half_up("_median", 2).alias(n) if e is MEDIAN else
                               F.coalesce(F.col(n), F.lit(0)).alias(n) if n in distinct else F.col(n) for n, e in measures])


def state_quantiles(state: DataFrame, keys: list[str], probs: list[float], names: list[str]) -> DataFrame:
    """(keys, total_tickets, closed_tickets, sla_breached_tickets, closed_sla_breach_pct, avg_resolution_hours,
    quantiles rounded at 2) of the groups of ``keys``; the rate counts breaches of closed tickets only."""
    n, h = _state_counts(), _state_hours()
    base = state.groupBy(*keys).agg(n["total"].alias("total_tickets"), n["closed"].alias("closed_tickets"),
                                    n["breached"].alias("sla_breached_tickets"),
                                    pct(F.sum("n_closed_breached"), n["closed"]).alias("closed_sla_breach_pct"),
                                    round_half_up(h["avg"], 2).alias("avg_resolution_hours"))
    out = attach_quantiles(base, state, keys, VALUE, probs, [f"_{x}" for x in names], weight="n_total")
    return out.select(*base.columns, *[round_half_up(f"_{x}", 2).alias(x) for x in names])


# --- distinct state ----------------------------------------------------------------------

def value_codes(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(value, code): the ``known`` dictionary, and codes after its largest for the new values of ``column``.

    New values are numbered within ranges of their hash side by side; the counts
    of the ranges (a fixed number) give each range its start.
    """
    values = df.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    start = 0
    if known is not None:
        values = values.join(known, "value", "left_anti")
        start = known.agg(F.max("code")).first()[0] or 0
    placed = values.withColumn("_r", F.pmod(F.xxhash64("value"), F.lit(CODE_RANGES)))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = (placed.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
              .select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    nth = F.row_number().over(Window.partitionBy("_r").orderBy("value"))
    fresh = placed.join(F.broadcast(starts), "_r").select(  # at most CODE_RANGES rows
        "value", (F.lit(start) + F.col("_before") + nth).cast("long").alias("code"))
    return fresh if known is None else known.select("value", F.col("code").cast("long").alias("code")).unionByName(fresh)


def distinct_state(tickets: DataFrame, keys: list[str], column: str, codes: DataFrame) -> DataFrame:
    """(keys, code_range, codes): a bitmap of the codes of ``column`` in the group, per range of codes."""
    pairs = tickets.select(*keys, F.col(column).cast("string").alias("value")).where("value IS NOT NULL").distinct()
    return (pairs.join(codes, "value").groupBy(*keys, F.bitmap_bucket_number("code").alias("code_range"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("codes")))


def merge_distinct(state: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct state by fewer (or derived) keys."""
    return state.groupBy(*keys, "code_range").agg(F.bitmap_or_agg("codes").alias("codes"))


def distinct_counts(state: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, name): exact distinct values of the groups of ``keys``."""
    return merge_distinct(state, keys).groupBy(*keys).agg(F.sum(F.bitmap_count("codes")).alias(name))


# --- bounded sketches --------------------------------------------------------------------

def sketch_state(tickets: DataFrame, keys: list[str], column: str, lg_k: int = 12, k: int = 200) -> DataFrame:
    """(keys, distinct_sketch of ``column``, hours_sketch of closed resolution hours)."""
    return tickets.groupBy(*keys).agg(F.hll_sketch_agg(F.col(column).cast("string"), F.lit(lg_k)).alias("distinct_sketch"),
                                      F.kll_sketch_agg_double(_closed(VALUE), F.lit(k)).alias("hours_sketch"))


def sketch_estimates(state: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, distinct_estimate, median_estimate) of the groups of ``keys``."""
    merged = state.groupBy(*keys).agg(F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("hours_sketch").alias("_h"))
    median = F.when(F.kll_sketch_get_n_double("_h") > 0, F.kll_sketch_get_quantile_double("_h", F.lit(0.5)))
    return merged.select(*keys, F.hll_sketch_estimate("_d").alias("distinct_estimate"), median.alias("median_estimate"))


# --- marts from their states ---------------------------------------------------------------

def team_workload(state: DataFrame) -> DataFrame:
    return from_state(state, TEAM_KEYS, team_measures(_state_counts(), _state_hours()))


def dealer_performance(state: DataFrame, vehicles: DataFrame) -> DataFrame:
    measures = dealer_measures(_state_counts(), _state_hours(), F.lit(None))
    return from_state(state, DEALER_KEYS, measures, {"distinct_vehicles": distinct_counts(vehicles, DEALER_KEYS, "distinct_vehicles")})


def product_defects(state: DataFrame, vehicles: DataFrame, dealers: DataFrame) -> DataFrame:
    measures = product_measures(_state_counts(), _state_hours(), F.lit(None), F.lit(None))
    return from_state(state, PRODUCT_KEYS, measures, {
        "affected_vehicles": distinct_counts(vehicles, PRODUCT_KEYS, "affected_vehicles"),
        "affected_dealers": distinct_counts(dealers, PRODUCT_KEYS, "affected_dealers")}).orderBy(F.desc("total_tickets"))
