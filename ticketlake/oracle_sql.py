"""DuckDB SQL for the correctness gate: the same results written as plain SQL.

``with_layers(body)`` prefixes a query with CTEs ``raw`` (public names),
``stg``, ``enr`` (enriched), ``kpi`` (fact), ``team``, ``dealer``, ``prod``
(marts) and ``tickets`` (raw with internal names), all over the driver's views.
Rounding goes through DECIMAL as on the Spark side.
"""

from __future__ import annotations

from .sources.fixtures import tickets_raw_sql

AS_OF = "TIMESTAMP '2001-08-02 12:00:00'"
AS_OF_DATE = "DATE '2001-08-02'"


def r2(x: str, d: int = 2) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(20,6)), {d}) AS DOUBLE)"


def pct(num: str, den: str, d: int = 2) -> str:
    return r2(f"100.0 * ({num}) / nullif({den}, 0)", d)


STG = """
SELECT ticket_id, vehicle_chassis AS vehicle_chassis_id, vehicle_vin, chassis_series,
       product_code, product_family, component_name, fault_code, fault_mode,
       ticket_status, ticket_substatus, status_state, severity_level, current_severity,
       customer_segment, source_channel, service_request_area, service_request_type,
       assigned_team, geo_region, dealer_code, dealer_label,
       dealer_city_name AS dealer_city, dealer_state_code AS dealer_state,
       dealer_country_code AS dealer_country,
       handler_country, handler_department, reporter_country, reporter_department, description,
       CASE WHEN lower(odometer_unit) = 'miles' THEN CAST(odometer_reading AS DOUBLE) * 1.60934
            ELSE CAST(odometer_reading AS DOUBLE) END AS odometer_km,
       CAST(created_timestamp AS TIMESTAMP) AS created_at,
       CAST(created_date AS DATE) AS created_date,
       CAST(closed_timestamp AS TIMESTAMP) AS closed_at,
       CAST(closed_date AS DATE) AS closed_date,
       CAST(first_queue_seconds AS INTEGER) AS first_queue_seconds,
       CAST(resolution_seconds AS DOUBLE) AS resolution_seconds
FROM raw
"""


def _sla_case(metric: str) -> str:
    return ("CASE WHEN severity_level = 'Critical' AND {m} > 24 * 3600 THEN true "
            "WHEN severity_level = 'High' AND {m} > 48 * 3600 THEN true "
            "WHEN severity_level = 'Medium' AND {m} > 72 * 3600 THEN true "
            "WHEN severity_level = 'Low' AND {m} > 96 * 3600 THEN true ELSE false END").format(m=metric)


ENR = f"""
SELECT *,
       ticket_status = 'Closed' AS is_closed,
       ticket_status != 'Closed' AS is_open,
       lower(service_request_type) = 'warranty claim' AS is_warranty_claim,
       severity_level = 'Critical' AS is_critical,
       severity_level IN ('Critical', 'High') AS is_high_severity,
       resolution_seconds / 3600.0 AS resolution_hours,
       resolution_seconds / 86400.0 AS resolution_days,
       first_queue_seconds / 3600.0 AS first_queue_hours,
       CASE WHEN created_at IS NULL THEN NULL
            WHEN ticket_status = 'Closed' AND resolution_seconds IS NOT NULL THEN {_sla_case('resolution_seconds')}
            WHEN ticket_status != 'Closed' THEN {_sla_case(f'epoch({AS_OF} - created_at)')}
            ELSE false END AS is_sla_breach,
       CASE WHEN resolution_seconds IS NULL THEN 'Open'
            WHEN resolution_seconds <= 4 * 3600 THEN '0–4h'
            WHEN resolution_seconds <= 24 * 3600 THEN '4–24h'
            WHEN resolution_seconds <= 72 * 3600 THEN '24–72h'
            WHEN resolution_seconds <= 168 * 3600 THEN '3–7 days'
            ELSE '7+ days' END AS resolution_bucket,
       CAST(date_trunc('month', created_date) AS DATE) AS created_month,
       CAST(date_part('year', created_date) AS INTEGER) AS created_year,
       CAST(date_part('month', created_date) AS INTEGER) AS created_month_num,
       CAST(date_part('quarter', created_date) AS INTEGER) AS created_quarter,
       CAST(date_part('dow', created_date) AS INTEGER) AS created_day_of_week,
       CAST(datediff('day', created_date, coalesce(closed_date, {AS_OF_DATE})) AS BIGINT) AS days_open
FROM stg
"""

KPI = """
SELECT ticket_id, vehicle_chassis_id, vehicle_vin, chassis_series,
       product_family, product_code, component_name, fault_code, fault_mode,
       severity_level, ticket_status, ticket_substatus, service_request_type,
       service_request_area, assigned_team, source_channel, customer_segment, geo_region,
       dealer_code, dealer_label, dealer_city, dealer_state, dealer_country,
       handler_country, handler_department, reporter_country, reporter_department,
       created_at, created_date, closed_at, closed_date, created_month, created_year, created_quarter,
       first_queue_seconds, first_queue_hours, resolution_seconds, resolution_hours,
       resolution_days, days_open, odometer_km,
       is_closed, is_open, is_warranty_claim, is_critical, is_high_severity, is_sla_breach, resolution_bucket
FROM enr
"""

TEAM = f"""
SELECT assigned_team, created_month, created_year, created_month_num, created_quarter,
       count(*) AS total_tickets,
       count(*) FILTER (WHERE is_closed) AS closed_tickets,
       count(*) FILTER (WHERE is_open) AS open_tickets,
       count(*) FILTER (WHERE is_critical) AS critical_tickets,
       count(*) FILTER (WHERE is_high_severity) AS high_severity_tickets,
       count(*) FILTER (WHERE is_warranty_claim) AS warranty_claims,
       count(*) FILTER (WHERE is_sla_breach = true) AS sla_breached_tickets,
       {pct("count(*) FILTER (WHERE is_sla_breach = true)", "count(*) FILTER (WHERE is_closed)")} AS sla_breach_rate_pct,
       {r2("avg(resolution_hours) FILTER (WHERE is_closed)")} AS avg_resolution_hours,
       {r2("median(resolution_hours) FILTER (WHERE is_closed)")} AS median_resolution_hours,
       {r2("min(resolution_hours) FILTER (WHERE is_closed)")} AS min_resolution_hours,
       {r2("max(resolution_hours) FILTER (WHERE is_closed)")} AS max_resolution_hours,
       {r2("avg(first_queue_hours)")} AS avg_first_queue_hours,
       {pct("count(*) FILTER (WHERE is_warranty_claim)", "count(*)")} AS warranty_pct,
       {pct("count(*) FILTER (WHERE is_critical)", "count(*)")} AS critical_pct
FROM enr
GROUP BY assigned_team, created_month, created_year, created_month_num, created_quarter
"""

DEALER = f"""
SELECT dealer_code, dealer_label, dealer_city, dealer_state, dealer_country, geo_region,
       created_month, created_year, created_month_num,
       count(*) AS total_tickets,
       count(*) FILTER (WHERE is_closed) AS closed_tickets,
       count(*) FILTER (WHERE is_open) AS open_tickets,
       count(*) FILTER (WHERE is_critical) AS critical_tickets,
       count(*) FILTER (WHERE is_warranty_claim) AS warranty_claims,
       count(*) FILTER (WHERE is_sla_breach = true) AS sla_breached_tickets,
       count(DISTINCT vehicle_chassis_id) AS distinct_vehicles,
       {pct("count(*) FILTER (WHERE is_sla_breach = true)", "count(*) FILTER (WHERE is_closed)")} AS sla_breach_rate_pct,
       {r2("avg(resolution_hours) FILTER (WHERE is_closed)")} AS avg_resolution_hours,
       {r2("median(resolution_hours) FILTER (WHERE is_closed)")} AS median_resolution_hours,
       {r2("max(resolution_hours) FILTER (WHERE is_closed)")} AS max_resolution_hours,
       {r2("avg(first_queue_hours)")} AS avg_first_queue_hours,
       {pct("count(*) FILTER (WHERE is_warranty_claim)", "count(*)")} AS warranty_rate_pct
FROM enr
GROUP BY dealer_code, dealer_label, dealer_city, dealer_state, dealer_country, geo_region,
         created_month, created_year, created_month_num
"""

PROD = f"""
SELECT product_family, product_code, component_name, fault_code, fault_mode,
       count(*) AS total_tickets,
       count(*) FILTER (WHERE is_closed) AS closed_tickets,
       count(*) FILTER (WHERE is_critical) AS critical_tickets,
       count(*) FILTER (WHERE is_warranty_claim) AS warranty_claims,
       count(*) FILTER (WHERE is_sla_breach = true) AS sla_breached_tickets,
       count(DISTINCT vehicle_chassis_id) AS affected_vehicles,
       count(DISTINCT dealer_code) AS affected_dealers,
       {pct("count(*) FILTER (WHERE is_critical)", "count(*)")} AS critical_rate_pct,
       {pct("count(*) FILTER (WHERE is_warranty_claim)", "count(*)")} AS warranty_rate_pct,
       {pct("count(*) FILTER (WHERE is_sla_breach = true)", "count(*) FILTER (WHERE is_closed)")} AS sla_breach_rate_pct,
       {r2("avg(resolution_hours) FILTER (WHERE is_closed)")} AS avg_resolution_hours,
       {r2("median(resolution_hours) FILTER (WHERE is_closed)")} AS median_resolution_hours
FROM enr
GROUP BY product_family, product_code, component_name, fault_code, fault_mode
"""

# Raw table with internal (API) column names: the ad-hoc SQL table `tickets`.
INTERNAL = """
SELECT ticket_id, vehicle_chassis AS chassis_number, vehicle_vin AS vin_number,
       chassis_series AS chassis_serie, product_code AS product_id, product_family AS product,
       component_name AS component, fault_code AS error_code, fault_mode AS failure_mode,
       ticket_status AS status, ticket_substatus AS sub_status, status_state AS status_line,
       severity_level AS severity, current_severity AS severity_cur, customer_segment AS customer_type,
       source_channel AS ticket_channel, service_request_area AS sr_area, service_request_type AS sr_type,
       assigned_team, geo_region AS region, dealer_code AS dealer_id, dealer_label AS dealer_name,
       dealer_city_name AS dealer_city, dealer_state_code AS dealer_state, dealer_country_code AS dealer_country,
       handler_country AS owner_country, handler_department AS owner_department,
       reporter_country AS creator_country, reporter_department AS creator_department, description,
       odometer_reading AS mileage, odometer_unit AS mileage_unit, created_timestamp AS creation_datetime,
       created_date AS creation_date, closed_timestamp AS close_datetime, closed_date AS close_date,
       first_queue_seconds AS first_queued_seconds, resolution_seconds AS time_to_close_seconds
FROM raw
"""


def with_layers(body: str) -> str:
    return (
        "WITH raw AS (" + tickets_raw_sql("duckdb") + "),\n"
        "stg AS (" + STG + "),\n"
        "enr AS (" + ENR + "),\n"
        "kpi AS (" + KPI + "),\n"
        "team AS (" + TEAM + "),\n"
        "dealer AS (" + DEALER + "),\n"
        "prod AS (" + PROD + "),\n"
        "tickets AS (" + INTERNAL + ")\n" + body
    )
