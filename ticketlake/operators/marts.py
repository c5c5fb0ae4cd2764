"""Mart layer: wide ticket fact and the team / dealer / product rollups.

All rollups are plain hash aggregations: partial (map-side) aggregation runs
before the shuffle, so a hot team or dealer only costs one row per map task.
Exact medians come from :func:`quantiles.exact_quantiles` (no task holds a
whole group's values) and are joined to the other measures on the group key;
this also keeps the main aggregation a code-generated hash aggregation.
``approx=True`` switches medians to ``percentile_approx`` and distinct counts
to HyperLogLog++ inside the one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_where, pct, round_half_up
from .quantiles import attach_quantiles

FACT_COLUMNS = [
    "ticket_id", "vehicle_chassis_id", "vehicle_vin", "chassis_series",
    "product_family", "product_code", "component_name", "fault_code", "fault_mode",
    "severity_level", "ticket_status", "ticket_substatus", "service_request_type",
    "service_request_area", "assigned_team", "source_channel", "customer_segment", "geo_region",
    "dealer_code", "dealer_label", "dealer_city", "dealer_state", "dealer_country",
    "handler_country", "handler_department", "reporter_country", "reporter_department",
    "created_at", "created_date", "closed_at", "closed_date", "created_month", "created_year",
    "created_quarter",
    "first_queue_seconds", "first_queue_hours", "resolution_seconds", "resolution_hours",
    "resolution_days", "days_open", "odometer_km",
    "is_closed", "is_open", "is_warranty_claim", "is_critical", "is_high_severity",
    "is_sla_breach", "resolution_bucket",
]

TEAM_KEYS = ["assigned_team", "created_month", "created_year", "created_month_num", "created_quarter"]
DEALER_KEYS = ["dealer_code", "dealer_label", "dealer_city", "dealer_state", "dealer_country",
               "geo_region", "created_month", "created_year", "created_month_num"]
PRODUCT_KEYS = ["product_family", "product_code", "component_name", "fault_code", "fault_mode"]


def ticket_fact(enriched: DataFrame) -> DataFrame:
    """Wide one-row-per-ticket fact table (drops description and helper keys)."""
    return enriched.select(*FACT_COLUMNS)


def _closed(x: str) -> Column:
    return F.when(F.col("is_closed"), F.col(x))


# Placeholder for the median of closed resolution hours in a measure list.
MEDIAN = object()


def _rollup(tickets: DataFrame, keys: list[str], measures: list[tuple[str, Column | object]],
            approx: bool) -> DataFrame:
    """groupBy(keys) with the measures in order; the MEDIAN entry is exact
    (skew-safe, joined on the group key) unless ``approx``."""
    if approx:
        med = round_half_up(F.percentile_approx(_closed("resolution_hours"), 0.5, 10000), 2)
        return tickets.groupBy(*keys).agg(*[(med if e is MEDIAN else e).alias(n) for n, e in measures])
    base = tickets.groupBy(*keys).agg(*[e.alias(n) for n, e in measures if e is not MEDIAN])
    names = [n for n, e in measures if e is MEDIAN]
    if not names:
        return base
    closed = tickets.filter(F.col("is_closed"))
    joined = attach_quantiles(base, closed, keys, "resolution_hours", [0.5], ["_m"])
    return joined.select(*[F.col(k) for k in keys],
                         *[round_half_up("_m", 2).alias(n) if e is MEDIAN else F.col(n) for n, e in measures])


def _distinct(x: str, approx: bool) -> Column:
    return F.approx_count_distinct(x, 0.01) if approx else F.count_distinct(F.col(x))


def _counts() -> dict[str, Column]:
    return {
        "total": F.count(F.lit(1)),
        "closed": count_where(F.col("is_closed")),
        "open": count_where(F.col("is_open")),
        "critical": count_where(F.col("is_critical")),
        "high": count_where(F.col("is_high_severity")),
        "warranty": count_where(F.col("is_warranty_claim")),
        "breached": count_where(F.col("is_sla_breach") == F.lit(True)),
    }


def _hours() -> dict[str, Column]:
    closed = _closed("resolution_hours")
    return {"avg": F.avg(closed), "min": F.min(closed), "max": F.max(closed), "queue": F.avg("first_queue_hours")}


def team_measures(n: dict[str, Column], h: dict[str, Column]) -> list[tuple[str, Column | object]]:
    """Columns of the team mart from its counts and hours, in order."""
    return [
        ("total_tickets", n["total"]),
        ("closed_tickets", n["closed"]),
        ("open_tickets", n["open"]),
        ("critical_tickets", n["critical"]),
        ("high_severity_tickets", n["high"]),
        ("warranty_claims", n["warranty"]),
        ("sla_breached_tickets", n["breached"]),
        ("sla_breach_rate_pct", pct(n["breached"], n["closed"])),
        ("avg_resolution_hours", round_half_up(h["avg"], 2)),
        ("median_resolution_hours", MEDIAN),
        ("min_resolution_hours", round_half_up(h["min"], 2)),
        ("max_resolution_hours", round_half_up(h["max"], 2)),
        ("avg_first_queue_hours", round_half_up(h["queue"], 2)),
        ("warranty_pct", pct(n["warranty"], n["total"])),
        ("critical_pct", pct(n["critical"], n["total"])),
    ]


def dealer_measures(n: dict[str, Column], h: dict[str, Column], vehicles: Column) -> list[tuple[str, Column | object]]:
    return [
        ("total_tickets", n["total"]),
        ("closed_tickets", n["closed"]),
        ("open_tickets", n["open"]),
        ("critical_tickets", n["critical"]),
        ("warranty_claims", n["warranty"]),
        ("sla_breached_tickets", n["breached"]),
        ("distinct_vehicles", vehicles),
        ("sla_breach_rate_pct", pct(n["breached"], n["closed"])),
        ("avg_resolution_hours", round_half_up(h["avg"], 2)),
        ("median_resolution_hours", MEDIAN),
        ("max_resolution_hours", round_half_up(h["max"], 2)),
        ("avg_first_queue_hours", round_half_up(h["queue"], 2)),
        ("warranty_rate_pct", pct(n["warranty"], n["total"])),
    ]


def product_measures(n: dict[str, Column], h: dict[str, Column], vehicles: Column,
                     dealers: Column) -> list[tuple[str, Column | object]]:
    return [
        ("total_tickets", n["total"]),
        ("closed_tickets", n["closed"]),
        ("critical_tickets", n["critical"]),
        ("warranty_claims", n["warranty"]),
        ("sla_breached_tickets", n["breached"]),
        ("affected_vehicles", vehicles),
        ("affected_dealers", dealers),
        ("critical_rate_pct", pct(n["critical"], n["total"])),
        ("warranty_rate_pct", pct(n["warranty"], n["total"])),
        ("sla_breach_rate_pct", pct(n["breached"], n["closed"])),
        ("avg_resolution_hours", round_half_up(h["avg"], 2)),
        ("median_resolution_hours", MEDIAN),
    ]


def team_workload(tickets: DataFrame, approx: bool = False) -> DataFrame:
    """One row per team per month."""
    return _rollup(tickets, TEAM_KEYS, team_measures(_counts(), _hours()), approx)


def dealer_performance(tickets: DataFrame, approx: bool = False) -> DataFrame:
    """One row per dealer per month."""
    return _rollup(tickets, DEALER_KEYS, dealer_measures(_counts(), _hours(), _distinct("vehicle_chassis_id", approx)), approx)


def product_defects(tickets: DataFrame, approx: bool = False) -> DataFrame:
    """One row per product family / code / component / fault code / fault mode, by volume."""
    measures = product_measures(_counts(), _hours(), _distinct("vehicle_chassis_id", approx), _distinct("dealer_code", approx))
    return _rollup(tickets, PRODUCT_KEYS, measures, approx).orderBy(F.desc("total_tickets"))
