"""Staging layer: rename, cast and normalise raw ticket columns (no business logic)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config

# raw column -> staged column, in staged order; None = same name.
STAGING_COLUMNS: list[tuple[str, str | None]] = [
    ("ticket_id", None),
    ("vehicle_chassis", "vehicle_chassis_id"),
    ("vehicle_vin", None), ("chassis_series", None),
    ("product_code", None), ("product_family", None), ("component_name", None),
    ("fault_code", None), ("fault_mode", None),
    ("ticket_status", None), ("ticket_substatus", None), ("status_state", None),
    ("severity_level", None), ("current_severity", None), ("customer_segment", None),
    ("source_channel", None), ("service_request_area", None), ("service_request_type", None),
    ("assigned_team", None), ("geo_region", None),
    ("dealer_code", None), ("dealer_label", None),
    ("dealer_city_name", "dealer_city"), ("dealer_state_code", "dealer_state"),
    ("dealer_country_code", "dealer_country"),
    ("handler_country", None), ("handler_department", None),
    ("reporter_country", None), ("reporter_department", None),
    ("description", None),
]


def _typed(df: DataFrame, name: str, target: str) -> Column:
    """Cast a raw column to ``target``; blank strings become NULL instead of failing."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.expr(f"try_cast(nullif(trim(`{name}`), '') as {target})")
    return col.cast(target)


def odometer_km(reading: Column, unit: Column) -> Column:
    """Miles -> km; any other unit (or NULL unit) is taken as km."""
    return F.when(F.lower(unit) == F.lit("miles"), reading * F.lit(config.MILES_TO_KM)).otherwise(reading)


def stage_tickets(raw: DataFrame, keep_raw: list[str] | None = None) -> DataFrame:
    """Raw (public names, any of string/typed columns) -> staged, typed tickets.

    ``keep_raw`` carries extra raw columns under ``raw__<name>`` (used to test
    the raw, staging and enriched layers in one pass over row-aligned data).
    """
    cols = [F.col(src).alias(dst or src) for src, dst in STAGING_COLUMNS]
    cols += [F.col(c).alias(f"raw__{c}") for c in (keep_raw or [])]
    reading = _typed(raw, "odometer_reading", "double")
    cols += [
        odometer_km(reading, F.col("odometer_unit")).alias("odometer_km"),
        _typed(raw, "created_timestamp", "timestamp_ntz").alias("created_at"),
        _typed(raw, "created_date", "date").alias("created_date"),
        _typed(raw, "closed_timestamp", "timestamp_ntz").alias("closed_at"),
        _typed(raw, "closed_date", "date").alias("closed_date"),
        _typed(raw, "first_queue_seconds", "int").alias("first_queue_seconds"),
        _typed(raw, "resolution_seconds", "double").alias("resolution_seconds"),
    ]
    return raw.select(*cols)
