"""KPI questions over the marts: filters, overview, summaries, distributions, top-k.

Every function takes mart DataFrames (or the ticket fact) and returns a
DataFrame; nothing is collected.  Display names follow the dashboard's.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Window, Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket_rank, count_where, pct, round_half_up
from .quantiles import attach_quantiles, join_on_keys
from .states import distinct_counts

ALL = "All"


def _date(v):
    if v is None or isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v))


@dataclass(frozen=True)
class KpiFilter:
    """Team / severity equality (skipped when None or 'All') and an inclusive date range."""

    team: str | None = None
    severity: str | None = None
    date_from: _dt.date | str | None = None
    date_to: _dt.date | str | None = None

    def _range(self, col: str, floor_month: bool = False) -> list[Column]:
        lo, hi = _date(self.date_from), _date(self.date_to)
        if lo is None or hi is None:
            return []
        if floor_month:
            lo = lo.replace(day=1)
        return [F.col(col).between(F.lit(lo), F.lit(hi))]

    def ticket_conditions(self) -> list[Column]:
        conds = []
        if self.team not in (None, ALL):
            conds.append(F.col("assigned_team") == F.lit(self.team))
        if self.severity not in (None, ALL):
            conds.append(F.col("severity_level") == F.lit(self.severity))
        return conds + self._range("created_date")

    def month_conditions(self, floor_month: bool = False) -> list[Column]:
        """Month-grain variant for the monthly marts: no team, no severity (the
        monthly marts have no severity column), created_month BETWEEN the bounds.
        With ``floor_month`` the lower bound is floored to its month start so a
        partial first month is kept."""
        return self._range("created_month", floor_month)


def apply(df: DataFrame, conds: list[Column]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def filtered_fact(fact: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    """Apply the ticket filter.  When the fact carries ``created_month`` (the
    written fact is partitioned by it) the date range is repeated on the month
    so the scan skips whole partitions; rows kept are the same."""
    flt = flt or KpiFilter()
    conds = flt.ticket_conditions()
    if conds and "created_month" in fact.columns:
        conds += flt.month_conditions(floor_month=True)
    return apply(fact, conds)


# --- options and bounds --------------------------------------------------------

def filter_options(fact: DataFrame, column: str) -> DataFrame:
    return fact.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_bounds(fact: DataFrame) -> DataFrame:
    return fact.agg(F.min("created_date").alias("min_date"), F.max("created_date").alias("max_date"))


# --- overview ------------------------------------------------------------------

def overview(fact: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    """Total, open, closed, avg hours (1 dp), SLA breach % (1 dp), open share % (1 dp)."""
    t = filtered_fact(fact, flt)
    total = F.count(F.lit(1))
    open_ = count_where(F.col("is_open"))
    closed = count_where(F.col("is_closed"))
    breached = count_where(F.col("is_sla_breach") == F.lit(True))
    return t.agg(
        total.alias("total_tickets"),
        open_.alias("open_tickets"),
        closed.alias("closed_tickets"),
        round_half_up(F.avg(F.when(F.col("is_closed"), F.col("resolution_hours"))), 1).alias("avg_resolution_h"),
        pct(breached, closed, 1).alias("sla_breach_rate_pct"),
        pct(open_, total, 1).alias("open_share_pct"),
    )


# --- distributions ---------------------------------------------------------------

def severity_distribution(fact: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    return (filtered_fact(fact, flt).groupBy(F.col("severity_level").alias("severity"))
            .agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count")))


def bucket_distribution(fact: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    return (filtered_fact(fact, flt).groupBy("resolution_bucket")
            .agg(F.count(F.lit(1)).alias("count")).orderBy(bucket_rank("resolution_bucket")))


def weekly_volume(fact: DataFrame, flt: KpiFilter | None = None, by: list[str] | None = None) -> DataFrame:
    """Tickets per Monday-starting week (optionally per extra keys)."""
    week = F.date_trunc("week", F.col("created_date")).cast("date").alias("week")
    keys = [*(by or []), week]
    return (filtered_fact(fact, flt).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(*(by or []), "week"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Long-form value counts (column, value, count) of several category columns,
    nulls dropped, in one scan: unpivot then one aggregation."""
    present = [c for c in columns if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
                      for c in present])
    return (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
            .orderBy("column", F.desc("count"), "value"))


# --- summaries from the monthly marts -----------------------------------------------

def _weighted_hours(avg_col: str = "avg_resolution_hours", w: str = "closed_tickets") -> Column:
    return F.sum(F.col(avg_col) * F.col(w)) / F.nullif(F.sum(w), F.lit(0))


def team_summary(team_mart: DataFrame, flt: KpiFilter | None = None, floor_month: bool = False) -> DataFrame:
    t = apply(team_mart, (flt or KpiFilter()).month_conditions(floor_month))
    return t.groupBy(F.col("assigned_team").alias("Team")).agg(
        F.sum("total_tickets").alias("Total"),
        F.sum("open_tickets").alias("Open"),
        round_half_up(_weighted_hours(), 1).alias("Avg Resolution (h)"),
        pct(F.sum("sla_breached_tickets"), F.sum("closed_tickets"), 1).alias("SLA Breach %"),
        round_half_up(F.avg("critical_pct"), 1).alias("Critical %"),
        pct(F.sum("critical_tickets"), F.sum("total_tickets"), 1).alias("Critical % (weighted)"),
    ).orderBy(F.desc("Total"), "Team")


def rank_teams(team_summary_df: DataFrame, by: str, descending: bool) -> DataFrame:
    """The team summary with each team's place by one measure (teams without it last)."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    # One row per team: a bounded, single-partition window.
    return team_summary_df.withColumn("place", F.row_number().over(Window.orderBy(order, "Team")).cast("long")).orderBy("place")


def dealer_summary(dealer_mart: DataFrame, flt: KpiFilter | None = None, top: int | None = 20,
                   floor_month: bool = False, vehicles: DataFrame | None = None) -> DataFrame:
    """Dealer rollup; ``Vehicles`` sums monthly distinct vehicles (vehicle-months).  With the marts'
    distinct state of ``vehicles``, ``Distinct Vehicles`` counts each vehicle of the months once."""
    months = (flt or KpiFilter()).month_conditions(floor_month)
    t = apply(dealer_mart, months)
    out = t.groupBy(F.col("dealer_label").alias("Dealer"), F.col("dealer_country").alias("Country")).agg(
        F.sum("total_tickets").alias("Total Tickets"),
        F.sum("distinct_vehicles").alias("Vehicles"),
        pct(F.sum("sla_breached_tickets"), F.sum("closed_tickets"), 1).alias("SLA Breach %"),
        round_half_up(_weighted_hours(), 1).alias("Avg Resolution (h)"),
        round_half_up(F.avg("warranty_rate_pct"), 1).alias("Warranty %"),
    )
    if vehicles is not None:
        held = apply(vehicles, months).withColumnsRenamed({"dealer_label": "Dealer", "dealer_country": "Country"})
        out = join_on_keys(out, distinct_counts(held, ["Dealer", "Country"], "Distinct Vehicles"), ["Dealer", "Country"])
        out = out.na.fill(0, ["Distinct Vehicles"])
    out = out.orderBy(F.desc("Total Tickets"), "Dealer", "Country")
    return out.limit(top) if top else out


def top_dealers(dealer_summary_df: DataFrame, by: str = "Total Tickets", n: int = 10) -> DataFrame:
    return dealer_summary_df.orderBy(F.desc_nulls_last(by), "Dealer", "Country").limit(n)


def top_product_defects(prod_mart: DataFrame, n: int = 30) -> DataFrame:
    return prod_mart.orderBy(
        F.desc("total_tickets"), "product_family", "product_code", "component_name", "fault_code",
        F.asc_nulls_last("fault_mode"),
    ).limit(n).select(
        F.col("product_family").alias("Product Family"),
        F.col("component_name").alias("Component"),
        F.col("fault_mode").alias("Fault Mode"),
        F.col("total_tickets").alias("Tickets"),
        F.col("affected_vehicles").alias("Vehicles"),
        F.col("critical_rate_pct").alias("Critical %"),
        F.col("warranty_rate_pct").alias("Warranty %"),
        F.col("avg_resolution_hours").alias("Avg Resolution (h)"),
    )


def tickets_by(prod_mart: DataFrame, key: str, n: int = 8) -> DataFrame:
    """Tickets per product family / fault mode from the product mart, top ``n``."""
    return (prod_mart.filter(F.col(key).isNotNull()).groupBy(key)
            .agg(F.sum("total_tickets").alias("tickets"))
            .orderBy(F.desc("tickets"), key).limit(n))


# --- export projections -------------------------------------------------------------

def team_export(team_mart: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    t = apply(team_mart, (flt or KpiFilter()).month_conditions())
    return t.select(
        F.col("assigned_team").alias("Team"), F.col("created_month").alias("Month"),
        F.col("total_tickets").alias("Total Tickets"), F.col("open_tickets").alias("Open"),
        F.col("closed_tickets").alias("Closed"), F.col("sla_breached_tickets").alias("SLA Breached"),
        F.col("sla_breach_rate_pct").alias("SLA Breach %"),
        F.col("avg_resolution_hours").alias("Avg Resolution (h)"),
        F.col("median_resolution_hours").alias("Median Resolution (h)"),
        F.col("critical_tickets").alias("Critical"), F.col("high_severity_tickets").alias("High Severity"),
        F.col("warranty_claims").alias("Warranty Claims"), F.col("critical_pct").alias("Critical %"),
        F.col("warranty_pct").alias("Warranty %"),
    ).orderBy(F.desc("Month"), "Team")


def dealer_export(dealer_mart: DataFrame, flt: KpiFilter | None = None) -> DataFrame:
    t = apply(dealer_mart, (flt or KpiFilter()).month_conditions())
    return t.select(
        F.col("dealer_label").alias("Dealer"), F.col("dealer_country").alias("Country"),
        F.col("created_month").alias("Month"), F.col("total_tickets").alias("Total Tickets"),
        F.col("closed_tickets").alias("Closed"), F.col("distinct_vehicles").alias("Vehicles"),
        F.col("sla_breached_tickets").alias("SLA Breached"),
        F.col("sla_breach_rate_pct").alias("SLA Breach %"),
        F.col("avg_resolution_hours").alias("Avg Resolution (h)"),
        F.col("warranty_rate_pct").alias("Warranty %"),
    ).orderBy(F.desc("Month"), "Dealer")


def product_export(prod_mart: DataFrame) -> DataFrame:
    return prod_mart.select(
        F.col("product_family").alias("Product Family"), F.col("component_name").alias("Component"),
        F.col("fault_mode").alias("Fault Mode"), F.col("total_tickets").alias("Total Tickets"),
        F.col("affected_vehicles").alias("Vehicles"), F.col("critical_rate_pct").alias("Critical %"),
        F.col("warranty_rate_pct").alias("Warranty %"),
        F.col("avg_resolution_hours").alias("Avg Resolution (h)"),
        F.col("median_resolution_hours").alias("Median Resolution (h)"),
    ).orderBy(F.desc("Total Tickets"))


def summary_export(overview_df: DataFrame) -> DataFrame:
    """Summary sheet: (Metric, Value) rows from the one-row overview."""
    fmt_h = F.when(F.col("avg_resolution_h").isNull(), F.lit("—")).otherwise(
        F.format_string("%.1fh", "avg_resolution_h"))
    fmt_p = F.when(F.col("sla_breach_rate_pct").isNull(), F.lit("—")).otherwise(
        F.format_string("%.1f%%", "sla_breach_rate_pct"))
    items = [
        ("Total Tickets", F.col("total_tickets").cast("string")),
        ("Open Tickets", F.col("open_tickets").cast("string")),
        ("Closed Tickets", F.col("closed_tickets").cast("string")),
        ("Avg Resolution Time", fmt_h),
        ("SLA Breach Rate", fmt_p),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("Metric"), v.alias("Value"))
                     for i, (m, v) in enumerate(items, start=1)])
    return overview_df.select(F.inline(rows)).orderBy("i").drop("i")


# --- business questions -------------------------------------------------------------

def teams_by_sla_breaches(team_mart: DataFrame) -> DataFrame:
    return team_mart.select("assigned_team", "created_month", "sla_breached_tickets", "closed_tickets",
                            "sla_breach_rate_pct").orderBy(F.desc("sla_breached_tickets"), "assigned_team",
                                                           "created_month")


def slowest_dealers(dealer_mart: DataFrame) -> DataFrame:
    return dealer_mart.groupBy("dealer_code", "dealer_label").agg(
        F.sum("closed_tickets").alias("closed_tickets"),
        round_half_up(_weighted_hours(), 2).alias("avg_resolution_hours"),
    ).orderBy(F.desc_nulls_last("avg_resolution_hours"), "dealer_code")


def warranty_by_family(prod_mart: DataFrame) -> DataFrame:
    return prod_mart.groupBy("product_family").agg(
        F.sum("warranty_claims").alias("warranty_claims"),
        F.sum("total_tickets").alias("total_tickets"),
        pct(F.sum("warranty_claims"), F.sum("total_tickets")).alias("warranty_rate_pct"),
    ).orderBy(F.desc("warranty_claims"), "product_family")


def monthly_volume_by_severity(fact: DataFrame) -> DataFrame:
    return (fact.groupBy("created_month", "severity_level").agg(F.count(F.lit(1)).alias("tickets"))
            .orderBy("created_month", "severity_level"))


def resolution_spread_by_severity(fact: DataFrame, approx: bool = False) -> DataFrame:
    """Closed tickets and p25 / p50 / p75 / p90 resolution hours per severity
    (exact and skew-safe; ``approx`` uses percentile_approx)."""
    qs = [0.25, 0.5, 0.75, 0.9]
    names = [f"p{int(q * 100)}_hours" for q in qs]
    closed = count_where(F.col("is_closed")).alias("closed_tickets")
    if approx:
        h = F.when(F.col("is_closed"), F.col("resolution_hours"))
        out = fact.groupBy("severity_level").agg(closed, F.percentile_approx(h, qs, 10000).alias("_q")).select(
            "severity_level", "closed_tickets", *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    else:
        out = attach_quantiles(fact.groupBy("severity_level").agg(closed), fact.filter(F.col("is_closed")),
                               ["severity_level"], "resolution_hours", qs, names)
    return out.select("severity_level", "closed_tickets",
                      *[round_half_up(n, 2).alias(n) for n in names]).orderBy("severity_level")


def escalation_rate(fact: DataFrame, by: list[str] | None = None) -> DataFrame:
    total = F.count(F.lit(1))
    esc = count_where(F.col("ticket_status") == F.lit("Escalated"))
    keys = by or []
    g = fact.groupBy(*keys) if keys else fact.groupBy()
    out = g.agg(total.alias("total_tickets"), esc.alias("escalated_tickets"),
                pct(esc, total).alias("escalation_rate_pct"))
    return out.orderBy(*keys) if keys else out


def export_frames(fact: DataFrame, team_mart: DataFrame, dealer_mart: DataFrame, prod_mart: DataFrame,
                  flt: KpiFilter | None = None) -> dict[str, DataFrame]:
    """The five export tables under the current filters (summary, ticket detail,
    team, dealer, product), ready for ``storage.export_set``."""
    return {
        "summary": summary_export(overview(fact, flt)),
        "ticket_detail": filtered_fact(fact, flt),
        "team_workload": team_export(team_mart, flt),
        "dealer_performance": dealer_export(dealer_mart, flt),
        "product_defects": product_export(prod_mart),
    }
