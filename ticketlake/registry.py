"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by operator ID."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle_sql as O
from .operators import marts, routing
from .operators.enrich import enrich_tickets
from .operators.staging import stage_tickets
from .plans.session import ensure_checkpoint_dir
from .sources import lineage
from .sources.fixtures import raw_column_exprs, read_table, tickets_raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, layers: bool = True):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = O.with_layers(oracle) if layers else oracle
        return fn
    return deco


def scratch(spark: SparkSession, kind: str) -> tuple[str, str]:
    """A fresh table name, and a folder for it in the shared checkpoint folder."""
    tag = f"{kind}_{uuid.uuid4().hex}"
    return tag, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}"


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_tickets(tickets_raw(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_tickets(staged(spark, sf_dir))


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.ticket_fact(enriched(spark, sf_dir))


# --- layers -----------------------------------------------------------------

@register("p10_p13_staging", "SELECT * FROM stg")
def q_staging(spark, sf_dir):
    return staged(spark, sf_dir)


@register("e1_e6_enriched", "SELECT * FROM enr")
def q_enriched(spark, sf_dir):
    return enriched(spark, sf_dir)


@register("p14", "SELECT * FROM kpi")
def q_fact(spark, sf_dir):
    return fact(spark, sf_dir)


@register("a1", "SELECT * FROM team")
def q_team(spark, sf_dir):
    return marts.team_workload(enriched(spark, sf_dir))


@register("a2", "SELECT * FROM dealer")
def q_dealer(spark, sf_dir):
    return marts.dealer_performance(enriched(spark, sf_dir))


@register("a3", "SELECT * FROM prod ORDER BY total_tickets DESC")
def q_product(spark, sf_dir):
    return marts.product_defects(enriched(spark, sf_dir))


# --- KPI questions (F*, A9-A23, K*, P15, T*) ------------------------------------------

from .operators import forecast as fc  # noqa: E402
from .operators import kpi  # noqa: E402
from .oracle_sql import pct as _opct  # noqa: E402
from .oracle_sql import r2 as _or2  # noqa: E402

FLT = kpi.KpiFilter(team="Brake Systems", severity="High", date_from="1996-01-15", date_to="1999-06-30")
_W = ("WHERE assigned_team = 'Brake Systems' AND severity_level = 'High' "
      "AND created_date BETWEEN DATE '1996-01-15' AND DATE '1999-06-30'")
_MW = "WHERE created_month BETWEEN DATE '1996-01-15' AND DATE '1999-06-30'"


def team_mart(spark, sf_dir):
    return marts.team_workload(enriched(spark, sf_dir))


def dealer_mart(spark, sf_dir):
    return marts.dealer_performance(enriched(spark, sf_dir))


def prod_mart(spark, sf_dir):
    return marts.product_defects(enriched(spark, sf_dir))


@register("f1_f3_filtered_detail", f"SELECT * FROM kpi {_W}")
def q_filtered(spark, sf_dir):
    return kpi.filtered_fact(fact(spark, sf_dir), FLT)


def _overview_sql(where: str) -> str:
    return f"""SELECT count(*) AS total_tickets,
       count(*) FILTER (WHERE is_open) AS open_tickets,
       count(*) FILTER (WHERE is_closed) AS closed_tickets,
       {_or2("avg(resolution_hours) FILTER (WHERE is_closed)", 1)} AS avg_resolution_h,
       {_opct("count(*) FILTER (WHERE is_sla_breach = true)", "count(*) FILTER (WHERE is_closed)", 1)} AS sla_breach_rate_pct,
       {_opct("count(*) FILTER (WHERE is_open)", "count(*)", 1)} AS open_share_pct
FROM kpi {where}"""


@register("a9_a10_overview", _overview_sql(""))
def q_overview(spark, sf_dir):
    return kpi.overview(fact(spark, sf_dir))


@register("a9_overview_filtered", _overview_sql(_W))
def q_overview_f(spark, sf_dir):
    return kpi.overview(fact(spark, sf_dir), FLT)


@register("a13", f"SELECT severity_level AS severity, count(*) AS count FROM kpi {_W} GROUP BY 1 ORDER BY 2 DESC")
def q_sev(spark, sf_dir):
    return kpi.severity_distribution(fact(spark, sf_dir), FLT)


@register("a13_all", "SELECT severity_level AS severity, count(*) AS count FROM kpi GROUP BY 1 ORDER BY 2 DESC")
def q_sev_all(spark, sf_dir):
    return kpi.severity_distribution(fact(spark, sf_dir))


@register("a14_k3", """SELECT resolution_bucket, count(*) AS count FROM kpi GROUP BY 1
ORDER BY CASE resolution_bucket WHEN 'Open' THEN 0 WHEN '0–4h' THEN 1 WHEN '4–24h' THEN 2
 WHEN '24–72h' THEN 3 WHEN '3–7 days' THEN 4 ELSE 5 END""")
def q_bucket(spark, sf_dir):
    return kpi.bucket_distribution(fact(spark, sf_dir))


@register("a15", "SELECT CAST(date_trunc('week', created_date) AS DATE) AS week, count(*) AS count "
                 "FROM kpi GROUP BY 1 ORDER BY 1")
def q_weekly(spark, sf_dir):
    return kpi.weekly_volume(fact(spark, sf_dir))


_WEEKLY = "weekly AS (SELECT CAST(date_trunc('week', created_date) AS DATE) AS week, count(*) AS count FROM kpi GROUP BY 1)"
_XS = "xs AS (SELECT week, CAST(count AS DOUBLE) AS y, CAST(row_number() OVER (ORDER BY week) - 1 AS DOUBLE) AS x FROM weekly)"


@register("t1", f""", {_WEEKLY}, {_XS}
SELECT count(*) AS weeks, {_or2('regr_slope(y, x)', 6)} AS slope, {_or2('regr_intercept(y, x)', 6)} AS intercept
FROM xs HAVING count(*) >= 3""")
def q_trend(spark, sf_dir):
    return fc.trend(kpi.weekly_volume(fact(spark, sf_dir)))


@register("t2_u1", f""", {_WEEKLY}, {_XS},
fit AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, max(week) AS last_week
        FROM xs HAVING count(*) >= 3)
SELECT week, CAST(count AS DOUBLE) AS count, 'actual' AS kind FROM weekly
UNION ALL
SELECT CAST(last_week + CAST(7 * i AS INTEGER) AS DATE) AS week, {_or2('greatest(0.0, a + b * (n - 1 + i))', 4)} AS count,
       'forecast' AS kind
FROM fit, range(1, 5) t(i)""")
def q_forecast(spark, sf_dir):
    return fc.weekly_forecast(kpi.weekly_volume(fact(spark, sf_dir)))


@register("t2_by_team", f""", wk AS (SELECT assigned_team, CAST(date_trunc('week', created_date) AS DATE) AS week,
   count(*) AS count FROM kpi GROUP BY 1, 2),
xs AS (SELECT assigned_team, week, CAST(count AS DOUBLE) AS y,
   CAST(row_number() OVER (PARTITION BY assigned_team ORDER BY week) - 1 AS DOUBLE) AS x FROM wk),
fit AS (SELECT assigned_team, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, max(week) AS last_week
        FROM xs GROUP BY assigned_team HAVING count(*) >= 3)
SELECT assigned_team, week, CAST(count AS DOUBLE) AS count, 'actual' AS kind FROM wk
UNION ALL
SELECT assigned_team, CAST(last_week + CAST(7 * i AS INTEGER) AS DATE) AS week,
       {_or2('greatest(0.0, a + b * (n - 1 + i))', 4)} AS count, 'forecast' AS kind
FROM fit, range(1, 5) t(i)""")
def q_forecast_team(spark, sf_dir):
    return fc.weekly_forecast(kpi.weekly_volume(fact(spark, sf_dir), by=["assigned_team"]), by=["assigned_team"])


_TEAM_SUM = f"""SELECT assigned_team AS "Team", sum(total_tickets) AS "Total", sum(open_tickets) AS "Open",
  {_or2('sum(avg_resolution_hours * closed_tickets) / nullif(sum(closed_tickets), 0)', 1)} AS "Avg Resolution (h)",
  {_opct('sum(sla_breached_tickets)', 'sum(closed_tickets)', 1)} AS "SLA Breach %",
  {_or2('avg(critical_pct)', 1)} AS "Critical %",
  {_opct('sum(critical_tickets)', 'sum(total_tickets)', 1)} AS "Critical % (weighted)"
FROM team {{w}} GROUP BY 1 ORDER BY 2 DESC"""


@register("a11_k6", _TEAM_SUM.format(w=""))
def q_team_sum(spark, sf_dir):
    return kpi.team_summary(team_mart(spark, sf_dir))


def _by(column: str, desc: bool) -> str:
    return (f"SELECT row_number() OVER (ORDER BY \"{column}\" {'DESC' if desc else 'ASC'} NULLS LAST, \"Team\") AS place, *"
            f" FROM ({_TEAM_SUM.format(w='')}) s")


@register("k6_resolution", _by("Avg Resolution (h)", False))
def q_k6_resolution(spark, sf_dir):
    """Teams from the fastest resolution to the slowest."""
    return kpi.rank_teams(kpi.team_summary(team_mart(spark, sf_dir)), "Avg Resolution (h)", descending=False)


@register("k6_sla", _by("SLA Breach %", True))
def q_k6_sla(spark, sf_dir):
    """Teams from the largest share of breached tickets to the least."""
    return kpi.rank_teams(kpi.team_summary(team_mart(spark, sf_dir)), "SLA Breach %", descending=True)


@register("a11_f4_month_filter", _TEAM_SUM.format(w=_MW))
def q_team_sum_f(spark, sf_dir):
    return kpi.team_summary(team_mart(spark, sf_dir), FLT)


_DEALER_SUM = f"""SELECT dealer_label AS "Dealer", dealer_country AS "Country", sum(total_tickets) AS "Total Tickets",
  sum(distinct_vehicles) AS "Vehicles",
  {_opct('sum(sla_breached_tickets)', 'sum(closed_tickets)', 1)} AS "SLA Breach %",
  {_or2('sum(avg_resolution_hours * closed_tickets) / nullif(sum(closed_tickets), 0)', 1)} AS "Avg Resolution (h)",
  {_or2('avg(warranty_rate_pct)', 1)} AS "Warranty %"
FROM dealer {{w}} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2"""


@register("a12", _DEALER_SUM.format(w="") + " LIMIT 20")
def q_dealer_sum(spark, sf_dir):
    return kpi.dealer_summary(dealer_mart(spark, sf_dir))


@register("a12_month_filter", _DEALER_SUM.format(w=_MW) + " LIMIT 20")
def q_dealer_sum_f(spark, sf_dir):
    return kpi.dealer_summary(dealer_mart(spark, sf_dir), FLT)


# --- mergeable states: the marts and their roll-ups without the tickets (A1-A3, A5, A8, A12) ------

from .operators import states  # noqa: E402
from .plans.session import reliable_checkpoint  # noqa: E402


def value_state(spark, sf_dir, keys):
    """The state, written once: one scan of the tickets whatever is asked of it."""
    return reliable_checkpoint(states.value_state(enriched(spark, sf_dir), keys))


def distinct_state(spark, sf_dir, keys, column):
    e = reliable_checkpoint(enriched(spark, sf_dir).select(*keys, column).distinct())
    return reliable_checkpoint(states.distinct_state(e, keys, column, states.value_codes(e, column)))


@register("a1_state", "SELECT * FROM team")
def q_team_state(spark, sf_dir):
    return states.team_workload(value_state(spark, sf_dir, marts.TEAM_KEYS))


@register("a2_state", "SELECT * FROM dealer")
def q_dealer_state(spark, sf_dir):
    return states.dealer_performance(value_state(spark, sf_dir, marts.DEALER_KEYS),
                                     distinct_state(spark, sf_dir, marts.DEALER_KEYS, "vehicle_chassis_id"))


@register("a3_state", "SELECT * FROM prod")
def q_product_state(spark, sf_dir):
    return states.product_defects(value_state(spark, sf_dir, marts.PRODUCT_KEYS),
                                  distinct_state(spark, sf_dir, marts.PRODUCT_KEYS, "vehicle_chassis_id"),
                                  distinct_state(spark, sf_dir, marts.PRODUCT_KEYS, "dealer_code"))


_SPREAD = f"""count(*) AS total_tickets, count(*) FILTER (WHERE is_closed) AS closed_tickets,
  count(*) FILTER (WHERE is_sla_breach) AS sla_breached_tickets,
  {_opct('count(*) FILTER (WHERE is_closed AND is_sla_breach)', 'count(*) FILTER (WHERE is_closed)', 2)} AS closed_sla_breach_pct,
  {_or2('avg(resolution_hours) FILTER (WHERE is_closed)', 2)} AS avg_resolution_hours,
  {_or2('quantile_cont(resolution_hours, 0.5) FILTER (WHERE is_closed)', 2)} AS median_hours,
  {_or2('quantile_cont(resolution_hours, 0.9) FILTER (WHERE is_closed)', 2)} AS p90_hours"""


@register("a8_team_all_months", f"SELECT assigned_team, {_SPREAD} FROM kpi GROUP BY 1")
def q_a8_team(spark, sf_dir):
    """Teams over all months, medians and rates included, from the monthly state."""
    state = states.merge_values(value_state(spark, sf_dir, marts.TEAM_KEYS), ["assigned_team"])
    return states.state_quantiles(state, ["assigned_team"], [0.5, 0.9], ["median_hours", "p90_hours"])


@register("a8_region_year", f"SELECT geo_region, created_year, {_SPREAD} FROM kpi GROUP BY 1, 2")
def q_a8_region(spark, sf_dir):
    state = value_state(spark, sf_dir, marts.DEALER_KEYS)
    return states.state_quantiles(state, ["geo_region", "created_year"], [0.5, 0.9], ["median_hours", "p90_hours"])


_DEALER_DISTINCT = """SELECT s.*, v."Distinct Vehicles" FROM ({body}) s JOIN (SELECT dealer_label AS "Dealer", dealer_country AS "Country",
  count(DISTINCT vehicle_chassis_id) AS "Distinct Vehicles" FROM kpi {w} GROUP BY 1, 2) v USING ("Dealer", "Country")
ORDER BY "Total Tickets" DESC, 1, 2 LIMIT 20"""


def dealer_vehicles(spark, sf_dir):
    return distinct_state(spark, sf_dir, marts.DEALER_KEYS, "vehicle_chassis_id")


@register("a12_distinct_vehicles", _DEALER_DISTINCT.format(body=_DEALER_SUM.format(w=""), w=""))
def q_a12_distinct(spark, sf_dir):
    return kpi.dealer_summary(dealer_mart(spark, sf_dir), vehicles=dealer_vehicles(spark, sf_dir))


@register("a12_distinct_month_filter", _DEALER_DISTINCT.format(body=_DEALER_SUM.format(w=_MW), w=_MW))
def q_a12_distinct_f(spark, sf_dir):
    return kpi.dealer_summary(dealer_mart(spark, sf_dir), FLT, vehicles=dealer_vehicles(spark, sf_dir))


@register("a5_vehicles_by_region", "SELECT geo_region, count(DISTINCT vehicle_chassis_id) AS distinct_vehicles FROM kpi GROUP BY 1")
def q_a5_region(spark, sf_dir):
    return states.distinct_counts(dealer_vehicles(spark, sf_dir), ["geo_region"], "distinct_vehicles")


@register("k5_volume", f"""SELECT * FROM ({_DEALER_SUM.format(w='')}) s ORDER BY "Total Tickets" DESC, 1, 2 LIMIT 10""")
def q_k5v(spark, sf_dir):
    return kpi.top_dealers(kpi.dealer_summary(dealer_mart(spark, sf_dir), top=None), "Total Tickets")


@register("k5_sla", f"""SELECT * FROM ({_DEALER_SUM.format(w='')}) s ORDER BY "SLA Breach %" DESC NULLS LAST, 1, 2 LIMIT 10""")
def q_k5s(spark, sf_dir):
    return kpi.top_dealers(kpi.dealer_summary(dealer_mart(spark, sf_dir), top=None), "SLA Breach %")


@register("k4", """SELECT product_family AS "Product Family", component_name AS "Component", fault_mode AS "Fault Mode",
  total_tickets AS "Tickets", affected_vehicles AS "Vehicles", critical_rate_pct AS "Critical %",
  warranty_rate_pct AS "Warranty %", avg_resolution_hours AS "Avg Resolution (h)"
FROM prod ORDER BY total_tickets DESC, product_family, product_code, component_name, fault_code, fault_mode NULLS LAST
LIMIT 30""")
def q_k4(spark, sf_dir):
    return kpi.top_product_defects(prod_mart(spark, sf_dir))


@register("a16", "SELECT product_family, sum(total_tickets) AS tickets FROM prod WHERE product_family IS NOT NULL "
                 "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def q_a16(spark, sf_dir):
    return kpi.tickets_by(prod_mart(spark, sf_dir), "product_family")


@register("a17", "SELECT fault_mode, sum(total_tickets) AS tickets FROM prod WHERE fault_mode IS NOT NULL "
                 "GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def q_a17(spark, sf_dir):
    return kpi.tickets_by(prod_mart(spark, sf_dir), "fault_mode")


@register("a18_teams", "SELECT DISTINCT assigned_team FROM kpi WHERE assigned_team IS NOT NULL ORDER BY 1")
def q_a18t(spark, sf_dir):
    return kpi.filter_options(fact(spark, sf_dir), "assigned_team")


@register("a18_severities", "SELECT DISTINCT severity_level FROM kpi WHERE severity_level IS NOT NULL ORDER BY 1")
def q_a18s(spark, sf_dir):
    return kpi.filter_options(fact(spark, sf_dir), "severity_level")


@register("a19", "SELECT min(created_date) AS min_date, max(created_date) AS max_date FROM kpi")
def q_a19(spark, sf_dir):
    return kpi.date_bounds(fact(spark, sf_dir))


_TEAM_EXPORT = """SELECT assigned_team AS "Team", created_month AS "Month", total_tickets AS "Total Tickets",
  open_tickets AS "Open", closed_tickets AS "Closed", sla_breached_tickets AS "SLA Breached",
  sla_breach_rate_pct AS "SLA Breach %", avg_resolution_hours AS "Avg Resolution (h)",
  median_resolution_hours AS "Median Resolution (h)", critical_tickets AS "Critical",
  high_severity_tickets AS "High Severity", warranty_claims AS "Warranty Claims",
  critical_pct AS "Critical %", warranty_pct AS "Warranty %"
FROM team {w} ORDER BY 2 DESC, 1"""


@register("p15_team_k2", _TEAM_EXPORT.format(w=_MW))
def q_p15t(spark, sf_dir):
    return kpi.team_export(team_mart(spark, sf_dir), FLT)


@register("p15_dealer", """SELECT dealer_label AS "Dealer", dealer_country AS "Country", created_month AS "Month",
  total_tickets AS "Total Tickets", closed_tickets AS "Closed", distinct_vehicles AS "Vehicles",
  sla_breached_tickets AS "SLA Breached", sla_breach_rate_pct AS "SLA Breach %",
  avg_resolution_hours AS "Avg Resolution (h)", warranty_rate_pct AS "Warranty %"
FROM dealer ORDER BY 3 DESC, 1""")
def q_p15d(spark, sf_dir):
    return kpi.dealer_export(dealer_mart(spark, sf_dir))


@register("p15_product", """SELECT product_family AS "Product Family", component_name AS "Component",
  fault_mode AS "Fault Mode", total_tickets AS "Total Tickets", affected_vehicles AS "Vehicles",
  critical_rate_pct AS "Critical %", warranty_rate_pct AS "Warranty %",
  avg_resolution_hours AS "Avg Resolution (h)", median_resolution_hours AS "Median Resolution (h)"
FROM prod ORDER BY total_tickets DESC""")
def q_p15p(spark, sf_dir):
    return kpi.product_export(prod_mart(spark, sf_dir))


@register("s15_summary", f"""SELECT "Metric", "Value" FROM (
  SELECT 1 AS i, 'Total Tickets' AS "Metric", CAST(total_tickets AS VARCHAR) AS "Value" FROM o
  UNION ALL SELECT 2, 'Open Tickets', CAST(open_tickets AS VARCHAR) FROM o
  UNION ALL SELECT 3, 'Closed Tickets', CAST(closed_tickets AS VARCHAR) FROM o
  UNION ALL SELECT 4, 'Avg Resolution Time', CASE WHEN avg_resolution_h IS NULL THEN '—'
       ELSE printf('%.1fh', avg_resolution_h) END FROM o
  UNION ALL SELECT 5, 'SLA Breach Rate', CASE WHEN sla_breach_rate_pct IS NULL THEN '—'
       ELSE printf('%.1f%%', sla_breach_rate_pct) END FROM o) s ORDER BY i""".replace(
    "FROM o", f"FROM ({_overview_sql(_W)}) o"))
def q_summary(spark, sf_dir):
    return kpi.summary_export(kpi.overview(fact(spark, sf_dir), FLT))


@register("a22_sla_by_team_month", """SELECT assigned_team, created_month, sla_breached_tickets, closed_tickets,
  sla_breach_rate_pct FROM team ORDER BY 3 DESC, 1, 2""")
def q_a22a(spark, sf_dir):
    return kpi.teams_by_sla_breaches(team_mart(spark, sf_dir))


@register("a22_slowest_dealers", f"""SELECT dealer_code, dealer_label, sum(closed_tickets) AS closed_tickets,
  {_or2('sum(avg_resolution_hours * closed_tickets) / nullif(sum(closed_tickets), 0)')} AS avg_resolution_hours
FROM dealer GROUP BY 1, 2 ORDER BY 4 DESC NULLS LAST, 1""")
def q_a22b(spark, sf_dir):
    return kpi.slowest_dealers(dealer_mart(spark, sf_dir))


@register("a22_warranty_by_family", f"""SELECT product_family, sum(warranty_claims) AS warranty_claims,
  sum(total_tickets) AS total_tickets, {_opct('sum(warranty_claims)', 'sum(total_tickets)')} AS warranty_rate_pct
FROM prod GROUP BY 1 ORDER BY 2 DESC, 1""")
def q_a22c(spark, sf_dir):
    return kpi.warranty_by_family(prod_mart(spark, sf_dir))


@register("a22_monthly_by_severity", """SELECT created_month, severity_level, count(*) AS tickets FROM kpi
GROUP BY 1, 2 ORDER BY 1, 2""")
def q_a22d(spark, sf_dir):
    return kpi.monthly_volume_by_severity(fact(spark, sf_dir))


@register("a22_resolution_spread", f"""SELECT severity_level, count(*) FILTER (WHERE is_closed) AS closed_tickets,
  {_or2("quantile_cont(resolution_hours, 0.25) FILTER (WHERE is_closed)")} AS p25_hours,
  {_or2("quantile_cont(resolution_hours, 0.5) FILTER (WHERE is_closed)")} AS p50_hours,
  {_or2("quantile_cont(resolution_hours, 0.75) FILTER (WHERE is_closed)")} AS p75_hours,
  {_or2("quantile_cont(resolution_hours, 0.9) FILTER (WHERE is_closed)")} AS p90_hours
FROM kpi GROUP BY 1 ORDER BY 1""")
def q_a22e(spark, sf_dir):
    return kpi.resolution_spread_by_severity(fact(spark, sf_dir))


@register("a23_team", f"""SELECT assigned_team, count(*) AS total_tickets,
  count(*) FILTER (WHERE ticket_status = 'Escalated') AS escalated_tickets,
  {_opct("count(*) FILTER (WHERE ticket_status = 'Escalated')", 'count(*)')} AS escalation_rate_pct
FROM kpi GROUP BY 1 ORDER BY 1""")
def q_a23t(spark, sf_dir):
    return kpi.escalation_rate(fact(spark, sf_dir), ["assigned_team"])


@register("a23_overall", f"""SELECT count(*) AS total_tickets,
  count(*) FILTER (WHERE ticket_status = 'Escalated') AS escalated_tickets,
  {_opct("count(*) FILTER (WHERE ticket_status = 'Escalated')", 'count(*)')} AS escalation_rate_pct FROM kpi""")
def q_a23o(spark, sf_dir):
    return kpi.escalation_rate(fact(spark, sf_dir))


@register("a23_channel_status", """SELECT source_channel, ticket_status, count(*) AS tickets FROM kpi
GROUP BY 1, 2 ORDER BY 1, 2""")
def q_a23c(spark, sf_dir):
    return fact(spark, sf_dir).groupBy("source_channel", "ticket_status").agg(
        kpi.F.count(kpi.F.lit(1)).alias("tickets")).orderBy("source_channel", "ticket_status")


# --- columns, ad-hoc SQL, storage (P1-P9, N1, F9, A20, A21, S*) ----------------------

from pyspark.sql import functions as F  # noqa: E402

from .functions.columns import sanitize_name  # noqa: E402
from .operators import columns as cols  # noqa: E402
from .operators import sqlrun  # noqa: E402
from .sources import storage  # noqa: E402


def tickets_internal(spark, sf_dir):
    """Raw tickets with internal names, registered as view ``tickets``."""
    return storage.register_tickets(tickets_raw(spark, sf_dir))


@register("p1_s6", "SELECT * FROM tickets")
def q_normalize(spark, sf_dir):
    return tickets_internal(spark, sf_dir)


@register("p2", """SELECT ticket_id, coalesce(created_date, creation_date) AS creation_date, assigned_team
FROM (SELECT ticket_id, CASE WHEN ticket_status = 'Closed' THEN NULL ELSE created_date END AS created_date,
             closed_date AS creation_date, assigned_team FROM raw) s""")
def q_merge(spark, sf_dir):
    raw = tickets_raw(spark, sf_dir)
    both = raw.select(
        "ticket_id",
        F.when(F.col("ticket_status") == "Closed", F.lit(None)).otherwise(F.col("created_date")).alias("created_date"),
        F.col("closed_date").alias("creation_date"),
        "assigned_team",
    )
    return cols.normalize_columns(both)


@register("p4", """SELECT ticket_id AS ticket_uuid, product AS product_family, component AS component_name,
  failure_mode AS fault_mode, severity AS severity_level, severity_cur AS current_severity, region AS geo_region,
  customer_type AS customer_segment, ticket_channel AS source_channel, description AS issue_description,
  assigned_team AS route_team, status AS ticket_status, sub_status AS ticket_substatus, status_line AS status_state,
  creation_datetime AS created_timestamp, creation_date, close_datetime AS closed_timestamp,
  close_date AS closed_date, creator_country AS reporter_country, creator_department AS reporter_department,
  owner_country AS handler_country, owner_department AS handler_department, dealer_id AS dealer_code,
  dealer_name AS dealer_label, dealer_country AS dealer_country_code, dealer_state AS dealer_state_code,
  dealer_city AS dealer_city_name, time_to_close_seconds AS resolution_seconds,
  first_queued_seconds AS first_queue_seconds, vin_number AS vehicle_vin, chassis_number AS vehicle_chassis,
  mileage AS odometer_reading, mileage_unit AS odometer_unit, error_code AS fault_code, sr_type AS service_request_type,
  sr_area AS service_request_area, product_id AS product_code, chassis_serie AS chassis_series
FROM tickets""")
def q_public(spark, sf_dir):
    return cols.to_public(tickets_internal(spark, sf_dir))


@register("p6", "SELECT ticket_uuid, issue_description, severity_level FROM "
                "(SELECT ticket_id AS ticket_uuid, description AS issue_description, severity AS severity_level "
                "FROM tickets) s")
def q_select(spark, sf_dir):
    public = cols.to_public(tickets_internal(spark, sf_dir))
    return cols.select_columns(public, ["ticket_id", " ", "issue_description", "severity", "ticket_uuid"])


@register("p8", "SELECT ticket_id, description, assigned_team, severity_level FROM "
                "(SELECT ticket_id, description, assigned_team, severity AS severity_level FROM tickets) s")
def q_roles(spark, sf_dir):
    public = cols.to_public(tickets_internal(spark, sf_dir))
    return cols.prepare_training_columns(
        public, include_columns=["ticket_uuid", "issue_description", "route_team", "severity_level"])


@register("p9")
def q_auto_id(spark, sf_dir):
    public = cols.to_public(tickets_internal(spark, sf_dir))
    return cols.prepare_training_columns(
        public, include_columns=["issue_description", "severity_level", "route_team"],
        assigned_team_column="", ticket_id_column="")


@register("p9_index", """SELECT count(*) AS n, 0 AS least, count(*) - 1 AS most, count(*) AS different FROM tickets""")
def q_auto_id_range(spark, sf_dir):
    """The numbers of the automatic ids: each from 0 on, once."""
    nr = F.substring_index("ticket_id", "-", -1).cast("long")
    return q_auto_id(spark, sf_dir).agg(F.count(nr).alias("n"), F.min(nr).cast("int").alias("least"), F.max(nr).alias("most"),
                                        F.count_distinct(nr).alias("different"))


@register("s8", """SELECT name, row_count FROM (SELECT replace(status_line, ' ', '-') || '-tickets' AS name, count(*) AS row_count FROM tickets
  GROUP BY status_line UNION ALL SELECT '007', count(*) FROM tickets WHERE severity = 'Critical') s ORDER BY 1""")
def q_snapshots(spark, sf_dir):
    """Three named snapshots of the tickets, listed."""
    return storage.list_snapshots(spark, ticket_snapshots(spark, sf_dir))


def ticket_snapshots(spark, sf_dir):
    t = tickets_internal(spark, sf_dir)
    _, root = scratch(spark, "snapshots")
    for state in ("Open", "Closed"):
        storage.write_snapshot(t.where(F.col("status_line") == state), root, f" {state} tickets! ")
    storage.write_snapshot(t.where("severity = 'Critical'"), root, "007")
    return root


@register("s9", """SELECT ticket_id, status, severity, creation_datetime, time_to_close_seconds FROM tickets WHERE severity = 'Critical'""")
def q_load_snapshot(spark, sf_dir):
    got = storage.load_snapshot(spark, ticket_snapshots(spark, sf_dir), "007", view=None)
    return got.select("ticket_id", "status", "severity", "creation_datetime", "time_to_close_seconds")


@register("p17_p18", """SELECT ticket_id, ticket_status,
  CASE WHEN ticket_status IN ('Resolved', 'Closed') THEN 'Closed' ELSE 'Open' END AS status_line,
  CASE WHEN closed_at IS NULL THEN NULL ELSE epoch(closed_at - created_at) END AS resolution_seconds
FROM stg""")
def q_status_line(spark, sf_dir):
    from .functions.columns import seconds_between
    s = staged(spark, sf_dir)
    return s.select(
        "ticket_id", "ticket_status",
        F.when(F.col("ticket_status").isin("Resolved", "Closed"), F.lit("Closed")).otherwise(F.lit("Open"))
        .alias("status_line"),
        F.when(F.col("closed_at").isNotNull(), seconds_between("created_at", "closed_at")).alias("resolution_seconds"),
    )


@register("n1", """SELECT dealer_label,
  CASE WHEN s = '' THEN 'synthetic-dataset' ELSE s END AS dataset_name
FROM (SELECT dealer_label, regexp_replace(regexp_replace(trim(dealer_label), '[^A-Za-z0-9_.-]+', '-', 'g'),
        '^[-._]+|[-._]+$', '', 'g') AS s FROM (SELECT DISTINCT dealer_label FROM raw) d) x""")
def q_sanitize(spark, sf_dir):
    return tickets_raw(spark, sf_dir).select("dealer_label").distinct().select(
        "dealer_label", sanitize_name("dealer_label").alias("dataset_name"))


@register("s3_p16", "SELECT *, created_date AS creation_date FROM raw ORDER BY ticket_id LIMIT 5000")
def q_preview(spark, sf_dir):
    return storage.preview(tickets_raw(spark, sf_dir), 5_000)


@register("s4", """SELECT true AS "exists", count(*) AS row_count, 38 AS column_count, true AS routing_capable,
  'tickets' AS dataset_name, 'tables' AS dataset_source FROM raw""")
def q_status(spark, sf_dir):
    return storage.dataset_status(tickets_raw(spark, sf_dir), name="tickets", source="tables")


def _digest_sql(table: str, types: dict[str, str], part: str, where: str = "") -> str:
    """(part, rows, digest) of a table, as in ``lineage``."""
    def text(c: str) -> str:
        if types[c] == "double":
            return f"CAST(CAST({c} AS DECIMAL(38,9)) AS VARCHAR)"
        return f"CAST({c} AS VARCHAR)"
    row = " || ".join(f"coalesce(CAST(strlen({text(c)}) AS VARCHAR) || ':' || {text(c)}, '-')" for c in sorted(types))
    halves = ", ".join(f"CAST(sum(CAST('0x' || substr(d, {1 + i * lineage.HALF}, {lineage.HALF}) AS BIGINT)) AS VARCHAR)" for i in range(2))
    return (f"SELECT part, count(*) AS rows, md5(concat_ws(':', CAST(count(*) AS VARCHAR), {halves})) AS digest FROM "
            f"(SELECT coalesce(CAST({part} AS VARCHAR), '{lineage.NULL_PART}') AS part, md5({row}) AS d FROM {table} {where}) x GROUP BY part")


_RAW_DIGEST = {n: {"odometer_reading": "double", "resolution_seconds": "double"}.get(n, "string") for n, _ in raw_column_exprs()}
_MONTH = "substr(CAST(created_date AS VARCHAR), 1, 7)"


@register("s17", f""", parts AS ({_digest_sql('raw', _RAW_DIGEST, _MONTH)})
SELECT CAST(sum(rows) AS BIGINT) AS row_count, count(*) AS partitions, md5(string_agg(part || '=' || digest, ',' ORDER BY part)) AS digest FROM parts""")
def q_fingerprint(spark, sf_dir):
    raw = tickets_raw(spark, sf_dir)
    return lineage.table_digest(lineage.partition_digests(raw, routing.training_part(raw)))


@register("s17_partitions", _digest_sql("raw", _RAW_DIGEST, _MONTH))
def q_fingerprint_parts(spark, sf_dir):
    raw = tickets_raw(spark, sf_dir)
    return lineage.partition_digests(raw, routing.training_part(raw))


@register("s17_documents", _digest_sql("documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}, "source"))
def q_fingerprint_documents(spark, sf_dir):
    return lineage.partition_digests(read_table(spark, sf_dir, "documents"), "source")


# A later delivery: without the oldest year, and with the tickets of 1995 resolved by now closed.
_LATER = ("(SELECT * REPLACE (CASE WHEN ticket_status = 'Resolved' AND created_date >= DATE '1995-01-01' AND created_date < DATE '1996-01-01' "
          "THEN 'Closed' ELSE ticket_status END AS ticket_status) FROM raw WHERE created_date >= DATE '1993-01-01') later")


@register("s18", f""", b AS ({_digest_sql('raw', _RAW_DIGEST, _MONTH, "WHERE created_date < DATE '2001-01-01'")}),
a AS ({_digest_sql(_LATER, _RAW_DIGEST, _MONTH)})
SELECT coalesce(a.part, b.part) AS part, CASE WHEN b.part IS NULL THEN 'added' WHEN a.part IS NULL THEN 'removed' ELSE 'changed' END AS change,
  b.rows AS rows_before, a.rows AS rows_after
FROM a FULL JOIN b ON a.part = b.part WHERE a.digest IS DISTINCT FROM b.digest""")
def q_lineage(spark, sf_dir):
    """What changed in the tickets since a training that is on record, by month."""
    raw = tickets_raw(spark, sf_dir)
    month = routing.training_part(raw)
    _, root = scratch(spark, "lineage")
    lineage.record_training(spark, root, raw.where("created_date < DATE '2001-01-01'"), month, "2001-01-01T00:00:00", name="tickets",
                            source="orders", snapshot="first")
    in_1995 = (F.col("ticket_status") == "Resolved") & (F.year("created_date") == 1995)
    later = raw.where("created_date >= DATE '1993-01-01'").withColumn("ticket_status", F.when(in_1995, "Closed").otherwise(F.col("ticket_status")))
    return lineage.changes_since_training(spark, root, later, month)


@register("a20", """SELECT "column", value, count(*) AS count FROM (
  SELECT 'severity' AS "column", severity AS value FROM tickets UNION ALL
  SELECT 'status', status FROM tickets UNION ALL
  SELECT 'region', region FROM tickets UNION ALL
  SELECT 'ticket_channel', ticket_channel FROM tickets UNION ALL
  SELECT 'customer_type', customer_type FROM tickets) u
WHERE value IS NOT NULL GROUP BY 1, 2""")
def q_value_counts(spark, sf_dir):
    return kpi.value_counts(tickets_internal(spark, sf_dir),
                            ["severity", "status", "region", "ticket_channel", "customer_type"])


_STARTER_KEYS = {
    "a21_tickets_per_team": "Tickets per team",
    "a21_avg_resolution_by_severity": "Avg resolution by severity",
    "a21_open_by_region": "Open tickets by region",
    "a21_top_failure_modes": "Top failure modes",
    "a21_open_critical": "Open critical tickets",
}


def _starter(title):
    def run(spark, sf_dir):
        tickets_internal(spark, sf_dir)
        return sqlrun.run_select(spark, sqlrun.STARTER_QUERIES[title])
    return run


for _key, _title in _STARTER_KEYS.items():
    register(_key, sqlrun.STARTER_QUERIES[_title])(_starter(_title))


@register("f9_cte", """, t AS (SELECT assigned_team, status FROM tickets)
SELECT assigned_team, count(*) AS n FROM t WHERE status = 'Escalated' GROUP BY assigned_team""")
def q_cte(spark, sf_dir):
    tickets_internal(spark, sf_dir)
    return sqlrun.run_select(spark, """WITH t AS (SELECT assigned_team, status FROM tickets)
SELECT assigned_team, count(*) AS n FROM t WHERE status = :st GROUP BY assigned_team""", args={"st": "Escalated"})


@register("x8_open_by_status_line", """SELECT region, COUNT(*) AS open_tickets FROM tickets WHERE status_line = 'Open'
GROUP BY region ORDER BY open_tickets DESC""")
def q_x8(spark, sf_dir):
    tickets_internal(spark, sf_dir)
    return sqlrun.run_select(spark, "SELECT region, COUNT(*) AS open_tickets\nFROM tickets\nWHERE status_line = 'Open'\n"
                                    "GROUP BY region\nORDER BY open_tickets DESC")


# --- data quality (Q1-Q8) and data tests (X-*, F8) -------------------------------------

from .operators import expectations as ex  # noqa: E402
from .operators import quality  # noqa: E402
from .sources.fixtures import raw_column_exprs  # noqa: E402

# internal column names of `tickets` in order, with their Spark types
_INTERNAL_COLS = [cols.DEFAULT_PUBLIC_TO_INTERNAL.get(n, n) for n, _ in raw_column_exprs()]
_RAW_TYPES = {"odometer_reading": "double", "created_timestamp": "timestamp_ntz", "created_date": "date",
              "closed_timestamp": "timestamp_ntz", "closed_date": "date", "first_queue_seconds": "int",
              "resolution_seconds": "double"}
_TYPES = dict(zip(_INTERNAL_COLS, [_RAW_TYPES.get(n, "string") for n, _ in raw_column_exprs()]))


def _union(parts):
    return "\n UNION ALL ".join(parts)


@register("q1_q2_q3", f"""SELECT count(*) AS rows, 38 AS columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets) d) AS duplicate_rows,
  {_or2('100.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM tickets) d)) / nullif(count(*), 0)', 4)} AS duplicate_pct,
  {_or2('100.0 * (' + ' + '.join(f'count(*) FILTER (WHERE {c} IS NULL)' for c in _INTERNAL_COLS) + ') / (nullif(count(*), 0) * 38.0)', 4)} AS overall_null_pct
FROM tickets""")
def q_overview_quality(spark, sf_dir):
    return quality.overview(tickets_internal(spark, sf_dir))


def _overview_of(table: str, cols: list[str]) -> str:
    held = f"(SELECT DISTINCT {', '.join(cols)} FROM {table}) d"
    again = f"(count(*) - (SELECT count(*) FROM {held}))"
    nulls = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in cols)
    return f"""SELECT count(*) AS rows, {len(cols)} AS columns, {again} AS duplicate_rows,
  {_or2(f'100.0 * {again} / nullif(count(*), 0)', 4)} AS duplicate_pct,
  {_or2(f'100.0 * ({nulls}) / (nullif(count(*), 0) * {float(len(cols))})', 4)} AS overall_null_pct FROM {table}"""


# Tables with rows that do repeat: the copies among the documents, and the status columns of lineitem.
_COPIES = {"documents": ["text", "lang", "n_chars"], "lineitem": ["l_quantity", "l_returnflag", "l_linestatus", "l_shipdate"]}


@register("q3_documents", _overview_of("documents", _COPIES["documents"]))
def q_overview_documents(spark, sf_dir):
    return quality.overview(read_table(spark, sf_dir, "documents").select(*_COPIES["documents"]))


@register("q3_lineitem", _overview_of("lineitem", _COPIES["lineitem"]))
def q_overview_lineitem(spark, sf_dir):
    return quality.overview(read_table(spark, sf_dir, "lineitem").select(*_COPIES["lineitem"]))


@register("q3_groups", """SELECT lang, n_chars, md5(text) AS text_md5, count(*) AS n FROM documents
GROUP BY text, lang, n_chars HAVING count(*) > 1""")
def q_duplicate_groups(spark, sf_dir):
    """The documents that occur more than once, with how often."""
    groups = quality.duplicate_groups(read_table(spark, sf_dir, "documents").select(*_COPIES["documents"]))
    return groups.select("lang", "n_chars", F.md5("text").alias("text_md5"), "n")


def _profile_of(table: str, types: dict[str, str]) -> str:
    return "SELECT * FROM (" + _union(
        [f"SELECT '{c}' AS \"column\", '{t}' AS type, "
         f"{_or2(f'100.0 * count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0)', 1)} AS null_pct, "
         f"count(DISTINCT {c}) AS unique_values, coalesce(CAST(min({c}) AS VARCHAR), '—') AS sample FROM {table}"
         for c, t in types.items()]) + ") u"


@register("q5_documents", _profile_of("documents", {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}))
def q_schema_documents(spark, sf_dir):
    return quality.schema_profile(read_table(spark, sf_dir, "documents"))


@register("q4", "SELECT \"column\", null_pct FROM (" + _union(
    [f"SELECT '{c}' AS \"column\", {_or2(f'100.0 * count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0)', 4)} AS null_pct FROM tickets"
     for c in _INTERNAL_COLS]) + ") u WHERE null_pct > 0 ORDER BY null_pct DESC, 1")
def q_nulls(spark, sf_dir):
    return quality.null_by_column(tickets_internal(spark, sf_dir))


@register("q5", "SELECT * FROM (" + _union(
    [f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS type, "
     f"{_or2(f'100.0 * count(*) FILTER (WHERE {c} IS NULL) / nullif(count(*), 0)', 1)} AS null_pct, "
     f"count(DISTINCT {c}) AS unique_values, coalesce(CAST(min({c}) AS VARCHAR), '—') AS sample FROM tickets"
     for c in _INTERNAL_COLS]) + ") u")
def q_schema(spark, sf_dir):
    return quality.schema_profile(tickets_internal(spark, sf_dir))


_H = "h AS (SELECT try_cast(time_to_close_seconds AS DOUBLE) / 3600.0 AS h FROM tickets WHERE try_cast(time_to_close_seconds AS DOUBLE) IS NOT NULL)"


@register("q6_q7", f""", {_H},
q AS (SELECT quantile_cont(h, 0.25) AS q1, quantile_cont(h, 0.5) AS med, quantile_cont(h, 0.75) AS q3,
             quantile_cont(h, 0.95) AS p95 FROM h)
SELECT count(*) AS n, {_or2('any_value(med)', 4)} AS median_hours, {_or2('any_value(p95)', 4)} AS p95_hours,
  {_or2('any_value(q1)', 4)} AS q1_hours, {_or2('any_value(q3)', 4)} AS q3_hours,
  {_or2('any_value(q3 - q1)', 4)} AS iqr_hours,
  count(*) FILTER (WHERE h < q1 - 1.5 * (q3 - q1) OR h > q3 + 1.5 * (q3 - q1)) AS outliers,
  {_or2('100.0 * count(*) FILTER (WHERE h < q1 - 1.5 * (q3 - q1) OR h > q3 + 1.5 * (q3 - q1)) / nullif(count(*), 0)', 4)} AS outlier_pct
FROM h, q""")
def q_res_stats(spark, sf_dir):
    return quality.resolution_stats(tickets_internal(spark, sf_dir))


@register("q8", f""", {_H},
b AS (SELECT min(h) AS lo, quantile_cont(h, 0.99) AS hi FROM h),
x AS (SELECT least(59, CAST(floor((least(h, hi) - lo) / ((hi - lo) / 60)) AS INTEGER)) AS bin, lo, (hi - lo) / 60 AS w
      FROM h, b)
SELECT bin, {_or2('any_value(lo) + bin * any_value(w)', 4)} AS bin_start,
  {_or2('any_value(lo) + (bin + 1) * any_value(w)', 4)} AS bin_end, count(*) AS count
FROM x GROUP BY bin ORDER BY bin""")
def q_hist(spark, sf_dir):
    return quality.histogram(tickets_internal(spark, sf_dir))


_MODEL_CTE = {"raw": "raw", "staging": "stg", "enriched": "enr", "ticket_kpis": "kpi", "team_workload": "team",
              "dealer_performance": "dealer", "product_defects": "prod"}


def _suite_sql() -> str:
    parts = []
    for i, k in enumerate(ex.SUITE):
        t = _MODEL_CTE[k.model]
        if k.kind == "unique":
            f = f"(SELECT count(*) FROM (SELECT {k.column} FROM {t} WHERE {k.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1) u)"
        elif k.kind == "not_null":
            f = f"(SELECT count(*) FROM {t} WHERE {k.column} IS NULL)"
        elif k.kind == "accepted_values":
            vals = ", ".join(f"'{v}'" for v in k.values)
            f = f"(SELECT count(*) FROM {t} WHERE {k.column} IS NOT NULL AND {k.column} NOT IN ({vals}))"
        else:
            f = f"(SELECT count(*) FROM {t} WHERE {k.column} IS NOT NULL AND {k.column} < {k.minimum})"
        parts.append(f"SELECT {i} AS seq, '{k.model}' AS model, '{k.name}' AS test, '{k.column}' AS \"column\", "
                     f"{f} AS failures")
    return "SELECT model, test, \"column\", failures, failures = 0 AS passed FROM (" + _union(parts) + ") s ORDER BY seq"


def all_models(spark, sf_dir):
    raw = tickets_raw(spark, sf_dir)
    stg = stage_tickets(raw)
    enr = enrich_tickets(stg)
    return {"raw": raw, "staging": stg, "enriched": enr, "ticket_kpis": marts.ticket_fact(enr),
            "team_workload": marts.team_workload(enr), "dealer_performance": marts.dealer_performance(enr),
            "product_defects": marts.product_defects(enr)}


@register("x_suite", _suite_sql())
def q_suite(spark, sf_dir):
    # raw, staging, enriched and the fact are row-aligned: one wide frame
    # (enriched columns + the raw columns staging recasts) carries all four,
    # so their column tests are one aggregate and ticket_id uniqueness is one
    # grouped count; the rollups are built from the same frame.
    wide = enrich_tickets(stage_tickets(tickets_raw(spark, sf_dir), keep_raw=list(ex.RAW_ONLY)))
    models = {"raw": wide, "staging": wide, "enriched": wide, "ticket_kpis": wide,
              "team_workload": marts.team_workload(wide), "dealer_performance": marts.dealer_performance(wide),
              "product_defects": marts.product_defects(wide)}
    return ex.run_suite(models, columns={"raw": ex.RAW_ONLY})


# Tables that do break rules, so that failures other than zero are compared.
_BROKEN = [
    ex.Check("lineitem", "l_orderkey", "unique"), ex.Check("lineitem", "l_returnflag", "accepted_values", ("A", "N")),
    ex.Check("lineitem", "l_quantity", "min_value", minimum=25), ex.Check("lineitem", "l_shipdate", "not_null"),
    ex.Check("documents", "text", "unique"), ex.Check("documents", "lang", "accepted_values", ("en", "de")),
    ex.Check("documents", "n_chars", "min_value", minimum=400), ex.Check("labelled", "toxic", "not_null"),
]


@register("x_failures", """SELECT model, test, "column", failures, failures = 0 AS passed FROM (
  SELECT 0 AS seq, 'lineitem' AS model, 'unique' AS test, 'l_orderkey' AS "column",
    (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1) u) AS failures
  UNION ALL SELECT 1, 'lineitem', 'accepted_values', 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 2, 'lineitem', 'min_value', 'l_quantity', count(*) FROM lineitem WHERE l_quantity < 25
  UNION ALL SELECT 3, 'lineitem', 'not_null', 'l_shipdate', count(*) FROM lineitem WHERE l_shipdate IS NULL
  UNION ALL SELECT 4, 'documents', 'unique', 'text', (SELECT count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1) u)
  UNION ALL SELECT 5, 'documents', 'accepted_values', 'lang', count(*) FROM documents WHERE lang IN ('fr', 'es')
  UNION ALL SELECT 6, 'documents', 'min_value', 'n_chars', count(*) FROM documents WHERE n_chars < 400
  UNION ALL SELECT 7, 'labelled', 'not_null', 'toxic', count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL
) s ORDER BY seq""")
def q_failures(spark, sf_dir):
    docs, lab = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    models = {"lineitem": read_table(spark, sf_dir, "lineitem"), "documents": docs,
              "labelled": docs.select("doc_id").join(lab, "doc_id", "left").select("doc_id", "toxic")}
    return ex.run_suite(models, _BROKEN)


# Staged tickets with every 97th resolution negative and the close dates of 1996 lost.
_BROKEN_STG = """(SELECT * REPLACE (CASE WHEN first_queue_seconds % 97 = 0 THEN -resolution_seconds ELSE resolution_seconds END AS resolution_seconds,
  CASE WHEN year(closed_date) = 1996 THEN NULL ELSE closed_date END AS closed_date) FROM stg)"""


def broken_staging(spark, sf_dir):
    lost = F.when(F.year("closed_date") == 1996, F.lit(None)).otherwise(F.col("closed_date"))
    turned = F.when(F.col("first_queue_seconds") % 97 == 0, -F.col("resolution_seconds")).otherwise(F.col("resolution_seconds"))
    return staged(spark, sf_dir).withColumns({"closed_date": lost, "resolution_seconds": turned})


@register("x_r_failures", f"""SELECT 'staging' AS model, test, CAST(NULL AS VARCHAR) AS "column", failures, failures = 0 AS passed FROM (
  SELECT 'assert_no_negative_resolution' AS test, count(*) AS failures FROM {_BROKEN_STG} b
   WHERE ticket_status = 'Closed' AND resolution_seconds IS NOT NULL AND resolution_seconds < 0
  UNION ALL SELECT 'assert_closed_has_closed_date', count(*) FROM {_BROKEN_STG} b WHERE ticket_status = 'Closed' AND closed_date IS NULL) s""")
def q_singular_failures(spark, sf_dir):
    return ex.run_singular(broken_staging(spark, sf_dir))


@register("x_s_failures", f"""SELECT ticket_id, created_at, closed_at, resolution_seconds FROM {_BROKEN_STG} b
WHERE ticket_status = 'Closed' AND resolution_seconds IS NOT NULL AND resolution_seconds < 0""")
def q_negative_rows(spark, sf_dir):
    return ex.negative_resolution(broken_staging(spark, sf_dir))


@register("x_c_failures", f"""SELECT ticket_id, ticket_status, closed_at, closed_date FROM {_BROKEN_STG} b
WHERE ticket_status = 'Closed' AND closed_date IS NULL""")
def q_undated_rows(spark, sf_dir):
    return ex.closed_without_date(broken_staging(spark, sf_dir))


@register("f8_x_s", """SELECT ticket_id, created_at, closed_at, resolution_seconds FROM stg
WHERE ticket_status = 'Closed' AND resolution_seconds IS NOT NULL AND resolution_seconds < 0""")
def q_negative(spark, sf_dir):
    return ex.negative_resolution(staged(spark, sf_dir))


@register("x_c", """SELECT ticket_id, ticket_status, closed_at, closed_date FROM stg
WHERE ticket_status = 'Closed' AND closed_date IS NULL""")
def q_closed_date(spark, sf_dir):
    return ex.closed_without_date(staged(spark, sf_dir))


@register("x_r", """SELECT 'staging' AS model, test, CAST(NULL AS VARCHAR) AS "column", failures, failures = 0 AS passed FROM (
  SELECT 'assert_no_negative_resolution' AS test, count(*) AS failures FROM stg
   WHERE ticket_status = 'Closed' AND resolution_seconds IS NOT NULL AND resolution_seconds < 0
  UNION ALL SELECT 'assert_closed_has_closed_date', count(*) FROM stg WHERE ticket_status = 'Closed' AND closed_date IS NULL) s""")
def q_singular(spark, sf_dir):
    return ex.run_singular(staged(spark, sf_dir))


# --- vector search (V1-V5) ----------------------------------------------------------------

from .operators import search  # noqa: E402
from .sources.fixtures import read_table  # noqa: E402

_V_NORM = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))"
_V_CTES = f""", e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ex AS (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM e),
cm AS (SELECT label, i, avg(x) AS m FROM ex GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS v FROM cm GROUP BY label),
cn AS (SELECT label, {_V_NORM} AS v FROM c),
en AS (SELECT vec_id, label, {_V_NORM} AS v FROM e)"""


def embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


@register("v2", f""", e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, label, len(v) AS dim, {_or2('sqrt(list_sum(list_transform(v, lambda y: y * y)))', 6)} AS input_norm,
  {_or2(f'sqrt(list_sum(list_transform({_V_NORM}, lambda y: y * y)))', 6)} AS unit_norm FROM e""")
def q_v2(spark, sf_dir):
    n = search.norms(embeddings(spark, sf_dir))
    return n.select("vec_id", "label", F.size("embedding").alias("dim"),
                    search.round_half_up("_n0", 6).alias("input_norm"),
                    search.round_half_up("_n1", 6).alias("unit_norm"))


@register("v3_k8_j3_j4", f"""{_V_CTES},
s AS (SELECT cn.label AS query_label, en.vec_id, en.label, list_dot_product(cn.v, en.v) AS score FROM cn, en),
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_label, rank, vec_id, {_or2('score', 4)} AS score, label FROM r WHERE rank <= 5""")
def q_v3(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    queries = search.label_centroids(emb).withColumnRenamed("label", "query_label")
    return search.top_k_similar(emb, queries, k=5, query_id_col="query_label", carry=["label"])


@register("v3_blocked", f"""{_V_CTES},
s AS (SELECT cn.label AS query_label, en.vec_id, en.label, list_dot_product(cn.v, en.v) AS score FROM cn, en),
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_label, rank, vec_id, {_or2('score', 4)} AS score, label FROM r WHERE rank <= 5""")
def q_v3_blocked(spark, sf_dir):
    """Same answer through the large-batch path (chunks of queries past a mapped corpus)."""
    emb = embeddings(spark, sf_dir)
    queries = search.label_centroids(emb).withColumnRenamed("label", "query_label")
    return search.top_k_similar(emb, queries, k=5, query_id_col="query_label", carry=["label"],
                                max_broadcast_queries=4, corpus_block_rows=128)


@register("v4", "SELECT count(embedding) > 0 AS \"exists\", count(embedding) AS vector_count, "
                "max(len(embedding)) AS dim FROM embeddings")
def q_v4(spark, sf_dir):
    return search.vector_status(embeddings(spark, sf_dir))


@register("v5")
def q_v5(spark, sf_dir):
    emb = embeddings(spark, sf_dir)
    queries = search.label_centroids(emb).withColumnRenamed("label", "query_label")
    return search.approx_top_k_similar(emb, queries, k=5, query_id_col="query_label")


# --- persisted vector tables (V2, V3, V5, R11) ------------------------------------------------

from .operators import textvec, vectorstore  # noqa: E402


def embedding_table(spark, sf_dir, **sizes):
    """The embeddings as a persisted table, opened again by its path."""
    name, path = scratch(spark, "vectors")
    vectorstore.write_vectors(embeddings(spark, sf_dir), name, path, carry=["label"], **sizes)
    return vectorstore.open_vectors(spark, name, path)


@register("v2_table", f""", e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, label, len(v) AS dim, {_or2(f'sqrt(list_sum(list_transform({_V_NORM}, lambda y: y * y)))', 6)} AS unit_norm FROM e""")
def q_v2_table(spark, sf_dir):
    return embedding_table(spark, sf_dir).vectors.select(
        "vec_id", "label", F.size("embedding").alias("dim"), search.round_half_up(search.l2_norm(F.col("embedding")), 6).alias("unit_norm"))


@register("v3_table", f"""{_V_CTES},
s AS (SELECT cn.label AS query_label, en.vec_id, en.label, list_dot_product(cn.v, en.v) AS score FROM cn, en),
r AS (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_label, rank, vec_id, {_or2('score', 4)} AS score, label FROM r WHERE rank <= 5""")
def q_v3_table(spark, sf_dir):
    queries = search.label_centroids(embeddings(spark, sf_dir)).withColumnRenamed("label", "query_label")
    return vectorstore.search_vectors(embedding_table(spark, sf_dir), queries, k=5, query_id_col="query_label", carry=["label"]).rows


@register("v5_table")
def q_v5_table(spark, sf_dir):
    queries = search.label_centroids(embeddings(spark, sf_dir)).withColumnRenamed("label", "query_label")
    return vectorstore.probe_vectors(embedding_table(spark, sf_dir, cell_rows=64), queries, k=5, query_id_col="query_label", carry=["label"])


# Sign vectors of the tickets' texts: bit j of a term's md5 is the sign of its j-th number.
_TEXT_VECTORS = f""", tx AS (SELECT coalesce(description, '') AS description, count(*) AS tickets FROM tickets GROUP BY 1),
tt AS (SELECT description, term, count(*) AS tf FROM (SELECT description,
    unnest(regexp_extract_all(lower(description), '\\b\\w\\w+\\b')) AS term FROM tx) x GROUP BY 1, 2),
ti AS (SELECT term, ln((1 + (SELECT sum(tickets) FROM tx)) / (1 + sum(tickets))) + 1 AS idf, md5(term) AS h
    FROM tt JOIN tx USING (description) GROUP BY term),
tv AS (SELECT description, j, sum(tf * idf * (2 * (((instr('0123456789abcdef', substr(h, CAST(j // 4 + 1 AS INTEGER), 1)) - 1)
    >> CAST(3 - j % 4 AS INTEGER)) & 1) - 1)) AS x
    FROM tt JOIN ti USING (term), (SELECT range AS j FROM range({textvec.DIM})) GROUP BY 1, 2),
tn AS (SELECT description, list(x ORDER BY j) AS v FROM tv GROUP BY 1),
tu AS (SELECT description, {_V_NORM} AS v FROM tn)"""


def ticket_vectors(spark, sf_dir):
    name, path = scratch(spark, "ticket_vectors")
    return routing.index_tickets(tickets_internal(spark, sf_dir), name, path)


@register("v1_signs", f"""{_TEXT_VECTORS}
SELECT ticket_id, len(v) AS dim, {_or2('v[1]', 6)} AS first, {_or2('v[77]', 6)} AS middle, {_or2('v[128]', 6)} AS last,
  {_or2('sqrt(list_sum(list_transform(v, lambda y: y * y)))', 6)} AS norm
FROM tickets JOIN tu ON tu.description = coalesce(tickets.description, '')""")
def q_v1_signs(spark, sf_dir):
    def at(i):
        return search.round_half_up(F.element_at("embedding", i), 6)
    return ticket_vectors(spark, sf_dir).vectors.select(
        "ticket_id", F.size("embedding").alias("dim"), at(1).alias("first"), at(77).alias("middle"), at(128).alias("last"),
        search.round_half_up(search.l2_norm(F.col("embedding")), 6).alias("norm"))


@register("v3_tickets", f"""{_TEXT_VECTORS},
qx AS (SELECT assigned_team, j, avg(x) AS x FROM (SELECT assigned_team, unnest(generate_series(1, len(v))) AS j, unnest(v) AS x
    FROM tickets JOIN tu ON tu.description = coalesce(tickets.description, '')) y GROUP BY 1, 2),
qm AS (SELECT assigned_team, list(x ORDER BY j) AS v FROM qx GROUP BY 1),
qv AS (SELECT assigned_team, {_V_NORM} AS v FROM qm),
s AS (SELECT qv.assigned_team AS team, t.ticket_id, t.assigned_team, t.severity, round(list_dot_product(qv.v, tu.v), 10) AS score
    FROM qv, tickets t JOIN tu ON tu.description = coalesce(t.description, '')),
r AS (SELECT *, row_number() OVER (PARTITION BY team ORDER BY score DESC, ticket_id) AS rank FROM s)
SELECT team, rank, ticket_id, {_or2('score', 4)} AS score, assigned_team, severity FROM r WHERE rank <= 5""")
def q_v3_tickets(spark, sf_dir):
    """For each team, the tickets nearest to the mean of its texts, over the stored vectors."""
    table = ticket_vectors(spark, sf_dir)
    queries = search.label_centroids(table.vectors, label_col="assigned_team").withColumnRenamed("assigned_team", "team")
    return vectorstore.search_vectors(table, queries, k=5, query_id_col="team", carry=["assigned_team", "severity"]).rows


@register("r11_vectors", f"""{_TEXT_VECTORS}
SELECT count(*) AS row_count, true AS routing_trained, CAST(count(DISTINCT assigned_team) AS INTEGER) AS classes,
  count(v) AS vector_count, CAST(max(len(v)) AS INTEGER) AS dim
FROM tickets LEFT JOIN tu ON tu.description = coalesce(tickets.description, '')""")
def q_r11_vectors(spark, sf_dir):
    """The train job with its vector table: what the summary says next to what the table holds."""
    name, path = scratch(spark, "trained")
    got = routing.train_routing(spark, tickets_internal(spark, sf_dir), path, trained_at="2001-08-02T12:00:00", vectors_name=name)
    held = got.vectors.vectors.agg(F.max(F.size("embedding")).alias("dim"))
    return got.summary.select("row_count", "routing_trained", "classes", "vector_count").crossJoin(held)  # one row each


# --- routing (R1-R11) ------------------------------------------------------------------------

from .operators import routing  # noqa: E402


def routing_data(spark, sf_dir):
    return routing.training_frame(tickets_internal(spark, sf_dir))


@register("r1", "SELECT coalesce(assigned_team, 'Unassigned') AS assigned_team, count(*) AS n FROM tickets "
                "GROUP BY 1 ORDER BY 1")
def q_r1(spark, sf_dir):
    return routing.class_counts(routing_data(spark, sf_dir))


@register("r2", """SELECT ticket_id, assigned_team,
  row_number() OVER (PARTITION BY assigned_team ORDER BY md5('42:' || ticket_id), ticket_id)
    <= ceil(0.2 * count(*) OVER (PARTITION BY assigned_team)) AS is_test
FROM (SELECT ticket_id, coalesce(assigned_team, 'Unassigned') AS assigned_team FROM tickets) t""")
def q_r2(spark, sf_dir):
    return routing.stratified_split(routing_data(spark, sf_dir)).select("ticket_id", "assigned_team", "is_test")


_TOK = ("d AS (SELECT ticket_id, unnest(regexp_extract_all(lower(coalesce(description, '')), '\\b\\w\\w+\\b')) AS term "
        "FROM tickets)")


@register("r3", f""", {_TOK}
SELECT term, count(*) AS count, count(DISTINCT ticket_id) AS doc_freq FROM d GROUP BY term""")
def q_r3(spark, sf_dir):
    return routing.token_counts(routing_data(spark, sf_dir))


@register("r4", f""", {_TOK}, n AS (SELECT count(*) AS n FROM tickets)
SELECT term, count(DISTINCT ticket_id) AS doc_freq,
  {_or2('ln((1 + any_value(n)) / (1 + count(DISTINCT ticket_id))) + 1', 6)} AS idf
FROM d, n GROUP BY term ORDER BY count(*) DESC, term LIMIT {routing.MAX_FEATURES}""")
def q_r4(spark, sf_dir):
    data = routing_data(spark, sf_dir)
    _, cv, scaling = routing.fit_tfidf(data)
    tokens = routing.tokenizer().transform(data)
    df = (tokens.select(F.explode(F.array_distinct("tokens")).alias("term"))
          .groupBy("term").agg(F.count(F.lit(1)).alias("doc_freq")))
    weights = spark.createDataFrame([(t, float(w)) for t, w in zip(cv.vocabulary, scaling)], "term string, idf double")
    return weights.join(df, "term").select("term", "doc_freq", search.round_half_up("idf", 6).alias("idf"))


def _trained(spark, sf_dir, final=False):
    """Hold-out metrics; ``final`` also fits the production model.  The clock is fixed, so results compare."""
    return routing.train_routing(spark, tickets_internal(spark, sf_dir), fit_final=final, trained_at="2001-08-02T12:00:00")


@register("r5", f""", {_TOK}, t AS (SELECT term FROM d GROUP BY term ORDER BY count(*) DESC, term LIMIT {routing.MAX_FEATURES})
SELECT assigned_team AS team, (SELECT count(*) FROM t) AS n_terms, true AS optimal FROM tickets GROUP BY 1""")
def q_r5(spark, sf_dir):
    """The fitted coefficients are the optimum: no partial derivative of the loss is over 1e-4."""
    data = routing_data(spark, sf_dir)
    got = routing.certificate(routing.fit_routing(data), data)
    return got.select("team", "n_terms", (F.col("max_gradient") < 1e-4).alias("optimal"))


@register("r7_support", """SELECT assigned_team AS team, CAST(ceil(0.2 * count(*)) AS BIGINT) AS support
FROM (SELECT coalesce(assigned_team, 'Unassigned') AS assigned_team FROM tickets) t GROUP BY 1""")
def q_r7_support(spark, sf_dir):
    """Held-out tickets per team, as the confusion matrix has them."""
    return _trained(spark, sf_dir).confusion.groupBy(F.col("actual").alias("team")).agg(F.sum("n").alias("support"))


@register("r8_scores", """SELECT ticket_id, (SELECT string_agg(DISTINCT assigned_team, ',' ORDER BY assigned_team) FROM tickets) AS teams,
  1.0 AS total, true AS best_is_predicted FROM tickets""")
def q_r8_scores(spark, sf_dir):
    """Every prediction scores each team once, sums to one, and names the team of the largest score."""
    data = routing_data(spark, sf_dir)
    got = routing.predict(routing.fit_routing(data), data)
    total = F.aggregate(F.map_values("team_scores"), F.lit(0.0), lambda a, x: a + x)
    best = (F.col("team_scores")[F.col("predicted_team")] == F.col("confidence")) & (F.col("confidence") == F.array_max(F.map_values("team_scores")))
    return got.select("ticket_id", F.array_join(F.array_sort(F.map_keys("team_scores")), ",").alias("teams"),
                      search.round_half_up(total, 6).alias("total"), best.alias("best_is_predicted"))


@register("r6_k7")
def q_r6(spark, sf_dir):
    return _trained(spark, sf_dir).importance


@register("r7_accuracy")
def q_r7a(spark, sf_dir):
    return _trained(spark, sf_dir).accuracy


@register("r7_confusion")
def q_r7c(spark, sf_dir):
    return _trained(spark, sf_dir).confusion


@register("r7_recall")
def q_r7r(spark, sf_dir):
    """Share of each team's held-out tickets routed to it."""
    return _trained(spark, sf_dir).recall


@register("r7_matrix")
def q_r7m(spark, sf_dir):
    """The confusion matrix with a column per predicted team."""
    got = _trained(spark, sf_dir)
    return routing.confusion_matrix(got.confusion, got.labels)


@register("r8_j5_k9")
def q_r8(spark, sf_dir):
    data = routing_data(spark, sf_dir)
    model = routing.fit_routing(data)
    return routing.predict(model, data).select(
        "ticket_id", "assigned_team", "predicted_team", search.round_half_up("confidence", 4).alias("confidence"),
        routing.ranked_scores(F.col("team_scores")).alias("team_scores"))


@register("r11")
def q_r11(spark, sf_dir):
    return _trained(spark, sf_dir, final=True).summary


# --- reply drafts (G1-G5) ---------------------------------------------------------------------

from pyspark.sql import Window  # noqa: E402

from .operators import drafts, textsearch  # noqa: E402

_RX = "'\\b\\w\\w+\\b'"
_G_CTES = f""", cd AS (SELECT ticket_id, coalesce(description, '') AS description,
    coalesce(assigned_team, '') AS assigned_team FROM tickets WHERE status_line = 'Closed'),
qd AS (SELECT ticket_id, coalesce(description, '') AS description FROM tickets
    WHERE status_line = 'Open' AND length(trim(coalesce(description, ''))) > 0),
ctexts AS (SELECT DISTINCT description FROM cd),
ctf AS (SELECT description, term, count(*) AS tf FROM (SELECT description,
    unnest(regexp_extract_all(lower(description), {_RX})) AS term FROM ctexts) x GROUP BY 1, 2),
cdf AS (SELECT term, count(DISTINCT ticket_id) AS df FROM (SELECT ticket_id,
    unnest(regexp_extract_all(lower(description), {_RX})) AS term FROM cd) x GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM cd)) / (1 + df)) + 1 AS idf FROM cdf),
cw AS (SELECT description, term, tf * idf AS w FROM ctf JOIN idf USING (term)),
cn AS (SELECT description, sqrt(sum(w * w)) AS nrm FROM cw GROUP BY 1),
qtext AS (SELECT DISTINCT trim(description) AS qt FROM qd),
qtf AS (SELECT qt, term, count(*) AS tf FROM (SELECT qt, unnest(regexp_extract_all(lower(qt), {_RX})) AS term
    FROM qtext) x GROUP BY 1, 2),
qw AS (SELECT qt, term, tf * idf AS w FROM qtf JOIN idf USING (term)),
qn AS (SELECT qt, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY 1),
dp AS (SELECT qw.qt, cw.description, sum(qw.w * cw.w) AS d FROM qw JOIN cw USING (term) GROUP BY 1, 2),
sim AS (SELECT q.qt, c.description, coalesce(dp.d / (qn.nrm * cn.nrm), 0.0) AS score
    FROM qtext q CROSS JOIN ctexts c LEFT JOIN dp ON dp.qt = q.qt AND dp.description = c.description
    LEFT JOIN qn ON qn.qt = q.qt LEFT JOIN cn ON cn.description = c.description),
reps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY ticket_id) AS r FROM cd) x
    WHERE r <= 3),
ranked AS (SELECT sim.qt, reps.ticket_id, reps.assigned_team, reps.description, sim.score,
    row_number() OVER (PARTITION BY sim.qt ORDER BY round(sim.score, 10) DESC, reps.ticket_id) AS rank
    FROM sim JOIN reps ON reps.description = sim.description),
hits AS (SELECT qd.ticket_id, ranked.rank, ranked.ticket_id AS context_ticket_id,
    ranked.assigned_team AS context_team, {_or2('ranked.score', 4)} AS similarity_score,
    ranked.description AS context_description, qd.description
    FROM qd JOIN ranked ON ranked.qt = trim(qd.description) WHERE ranked.rank <= 3),
ctx AS (SELECT ticket_id, any_value(description) AS description, count(*) AS n,
    string_agg(printf('%d. ticket_id=%s; assigned_team=%s; similarity_score=%.4f; description=%s',
      rank, context_ticket_id, context_team, similarity_score, context_description), chr(10) ORDER BY rank) AS ctx_text,
    max(CASE WHEN rank = 1 THEN context_team END) AS team1,
    string_agg(CASE WHEN context_team <> '' THEN context_ticket_id || ' (' || context_team || ')'
               ELSE context_ticket_id END, ', ' ORDER BY rank) FILTER (WHERE rank <= 2) AS refs
    FROM hits GROUP BY ticket_id)"""


def draft_context(spark, sf_dir):
    t = tickets_internal(spark, sf_dir)
    queries = t.filter(F.col("status_line") == "Open").select("ticket_id", "description")
    corpus = t.filter(F.col("status_line") == "Closed").select("ticket_id", "description", "assigned_team")
    return drafts.retrieve_context(queries, corpus)


@register("g1", f"""{_G_CTES}
SELECT ticket_id, rank, context_ticket_id, context_team, similarity_score FROM hits""")
def q_g1(spark, sf_dir):
    c = draft_context(spark, sf_dir)
    hits = c.select(F.col("ticket_id").alias("query_ticket_id"), F.explode("context").alias("h"))
    return hits.select(F.col("query_ticket_id").alias("ticket_id"), F.col("h.rank").alias("rank"),
                       F.col("h.ticket_id").alias("context_ticket_id"), F.col("h.assigned_team").alias("context_team"),
                       F.col("h.similarity_score").alias("similarity_score"))


@register("g2", f"""{_G_CTES}
SELECT ticket_id, ctx_text AS context_text FROM ctx""")
def q_g2(spark, sf_dir):
    return draft_context(spark, sf_dir).select("ticket_id", drafts.format_context(F.col("context")).alias("context_text"))


@register("g3", f"""{_G_CTES}
SELECT ticket_id, replace(replace({"'" + drafts.PROMPT_TEMPLATE.replace("'", "''") + "'"}, '{{ticket_description}}', trim(description)),
  '{{context_tickets}}', ctx_text) AS prompt FROM ctx""")
def q_g3(spark, sf_dir):
    c = draft_context(spark, sf_dir)
    return c.select("ticket_id", drafts.build_prompt(F.col("description"),
                                                     drafts.format_context(F.col("context"))).alias("prompt"))


# Texts that are all different: the benchmark's items as queries over the documents.
_GD = f"""WITH docs AS (SELECT text, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY text),
dt AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
    FROM docs) x GROUP BY 1, 2, 3),
di AS (SELECT term, ln((1.0 + (SELECT sum(n) FROM docs)) / (1.0 + sum(n))) + 1 AS idf FROM dt GROUP BY term),
dn AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS nrm FROM dt JOIN di USING (term) GROUP BY 1),
qt AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
    FROM benchmark) x GROUP BY 1, 2),
qn AS (SELECT item_id, sqrt(sum(tf * idf * tf * idf)) AS nrm FROM qt JOIN di USING (term) GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum((qt.tf * idf / qn.nrm) * (dt.tf * idf / dn.nrm)), 10) AS score
    FROM qt JOIN di USING (term) JOIN dt USING (term) JOIN qn USING (item_id) JOIN dn USING (doc_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@register("g1_documents", _GD + f"SELECT item_id, rank, doc_id, {_or2('score', 4)} AS score FROM r WHERE rank <= 3", layers=False)
def q_g1_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    texts = docs.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), F.min("doc_id").alias("first_id"))
    items = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text")
    found = textsearch.top_k_texts(items, texts, textsearch.smooth_idf(docs, "text"), 3)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (found.join(texts.select("key", "first_id"), "key").select(F.col("query_key").alias("item_id"), F.col("first_id").alias("doc_id"), "score")
            .withColumn("rank", F.row_number().over(w).cast("long")).select("item_id", "rank", "doc_id", search.round_half_up("score", 4).alias("score")))


_DRAFT_SQL = f"""'Thanks for reporting this issue.' || chr(10) || chr(10) || 'Summary: ' ||
  CASE WHEN length(s) > 220 THEN rtrim(substr(s, 1, 217)) || '...' ELSE s END ||
  chr(10) || 'Recommended owner: ' || CASE WHEN trim(team1) <> '' THEN trim(team1) ELSE 'Support Team' END ||
  chr(10) || chr(10) || 'Proposed next steps:' || chr(10) ||
  '1. {drafts.NEXT_STEPS[0]}' || chr(10) || '2. {drafts.NEXT_STEPS[1]}' || chr(10) ||
  '3. {drafts.NEXT_STEPS[2]}' || chr(10) || chr(10) || 'Related ticket signals: ' || refs || '.'"""


@register("g4", f"""{_G_CTES}
SELECT ticket_id, {_DRAFT_SQL} AS suggested_response
FROM (SELECT *, replace(trim(description), chr(10), ' ') AS s FROM ctx) x""")
def q_g4(spark, sf_dir):
    c = draft_context(spark, sf_dir)
    return c.select("ticket_id", drafts.local_draft(F.col("description"), F.col("context")).alias("suggested_response"))


@register("g5", f"""{_G_CTES}
SELECT ticket_id, {_DRAFT_SQL} AS suggested_response, false AS llm_available,
  '{drafts.FALLBACK_REASON}' AS llm_error, n AS n_context
FROM (SELECT *, replace(trim(description), chr(10), ' ') AS s FROM ctx) x""")
def q_g5(spark, sf_dir):
    return drafts.draft_table(draft_context(spark, sf_dir)).select(
        "ticket_id", "suggested_response", "llm_available", "llm_error", F.size("context").cast("long").alias("n_context"))


# --- rule lookups (J1, J2) and text embedding (V1) ---------------------------------------

from . import config  # noqa: E402
from .operators import rules  # noqa: E402

_RULES_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(config.ROUTING_RULES.items())) + \
    ") r(rule_component, rule_team)"


@register("j1", f"""SELECT ticket_id, component, assigned_team, rule_team,
  coalesce(rule_team = assigned_team, false) AS rule_matches
FROM tickets LEFT JOIN {_RULES_SQL} ON component = rule_component""")
def q_j1(spark, sf_dir):
    t = tickets_internal(spark, sf_dir).select("ticket_id", "component", "assigned_team")
    out = rules.apply_routing_rules(t, rules.rules_frame(spark))
    return out.select("ticket_id", "component", "assigned_team", "rule_team",
                      F.coalesce(F.col("rule_team") == F.col("assigned_team"), F.lit(False)).alias("rule_matches"))


@register("j2", """SELECT severity_level, sla_hours, count(*) AS tickets,
  count(*) FILTER (WHERE is_sla_breach = true) AS sla_breached_tickets
FROM enr LEFT JOIN (VALUES ('Critical', 24), ('High', 48), ('Low', 96), ('Medium', 72)) s(severity, sla_hours)
  ON severity_level = severity GROUP BY 1, 2""")
def q_j2(spark, sf_dir):
    from .functions.columns import count_where
    e = enriched(spark, sf_dir)
    s = rules.sla_frame(spark)
    return (e.join(F.broadcast(s), e.severity_level == s.severity, "left")
            .groupBy("severity_level", "sla_hours")
            .agg(F.count(F.lit(1)).alias("tickets"),
                 count_where(F.col("is_sla_breach") == F.lit(True)).alias("sla_breached_tickets")))


@register("v1", """SELECT ticket_id, 4096 AS dim,
  CASE WHEN regexp_matches(lower(coalesce(description, '')), '\\w\\w') THEN 1.0 ELSE 0.0 END AS norm FROM tickets""")
def q_v1(spark, sf_dir):
    t = tickets_internal(spark, sf_dir).select("ticket_id", "description")
    out, _ = search.embed_text(t)
    return out.select("ticket_id", F.size("embedding").alias("dim"),
                      search.round_half_up(search.l2_norm(F.col("embedding")), 6).alias("norm"))
