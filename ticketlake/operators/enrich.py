"""Enriched layer: flags, durations, SLA breach, buckets and calendar keys.

The clock (``as_of``) is a parameter so that results are reproducible; the
reference reads the wall clock.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import ntz, resolution_bucket, seconds_between, sla_seconds


def sla_breach(as_of: _dt.datetime, sla_hours: dict[str, int] | None = None):
    """NULL without created_at; Closed with a resolution -> resolution > SLA;
    not Closed -> elapsed(as_of - created_at) > SLA; otherwise false."""
    threshold = sla_seconds("severity_level", sla_hours)
    status = F.col("ticket_status")
    res = F.col("resolution_seconds")
    elapsed = seconds_between("created_at", ntz(as_of))
    return (
        F.when(F.col("created_at").isNull(), F.lit(None).cast("boolean"))
        .when((status == "Closed") & res.isNotNull(), F.coalesce(res > threshold, F.lit(False)))
        .when(status != "Closed", F.coalesce(elapsed > threshold, F.lit(False)))
        .otherwise(F.lit(False))
    )


def enrich_tickets(stg: DataFrame, as_of: _dt.datetime = config.DEFAULT_AS_OF,
                   sla_hours: dict[str, int] | None = None) -> DataFrame:
    status = F.col("ticket_status")
    sev = F.col("severity_level")
    d = F.col("created_date")
    return stg.select(
        "*",
        (status == "Closed").alias("is_closed"),
        (status != "Closed").alias("is_open"),
        (F.lower("service_request_type") == "warranty claim").alias("is_warranty_claim"),
        (sev == "Critical").alias("is_critical"),
        sev.isin("Critical", "High").alias("is_high_severity"),
        (F.col("resolution_seconds") / F.lit(3600.0)).alias("resolution_hours"),
        (F.col("resolution_seconds") / F.lit(86400.0)).alias("resolution_days"),
        (F.col("first_queue_seconds") / F.lit(3600.0)).alias("first_queue_hours"),
        sla_breach(as_of, sla_hours).alias("is_sla_breach"),
        resolution_bucket("resolution_seconds").alias("resolution_bucket"),
        F.trunc(d, "month").alias("created_month"),
        F.year(d).alias("created_year"),
        F.month(d).alias("created_month_num"),
        F.quarter(d).alias("created_quarter"),
        (F.dayofweek(d) - 1).alias("created_day_of_week"),
        F.datediff(F.coalesce(F.col("closed_date"), F.lit(as_of.date())), d).cast("bigint").alias("days_open"),
    )
