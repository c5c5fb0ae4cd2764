"""Reusable column expressions shared by the operators."""

from __future__ import annotations

import datetime as _dt
import re as _re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_half_up(x: str | Column, digits: int) -> Column:
    """Round through DECIMAL so ties round the same way in every engine.

    ``round(double, n)`` rounds differently between engines at binary ties;
    a DECIMAL(20,6) step makes the result engine-independent.
    """
    return F.round(c(x).cast("decimal(20,6)"), digits).cast("double")


def pct(num: Column, den: Column, digits: int = 2) -> Column:
    """round(100 * num / nullif(den, 0), digits) as double; NULL for den = 0."""
    return round_half_up(F.lit(100.0) * num / F.nullif(den, F.lit(0)), digits)


def count_where(cond: Column) -> Column:
    """count(*) FILTER (WHERE cond): NULL conditions are not counted."""
    return F.count_if(F.coalesce(cond, F.lit(False)))


def ntz(ts: _dt.datetime | str) -> Column:
    if isinstance(ts, _dt.datetime):
        ts = ts.strftime("%Y-%m-%d %H:%M:%S")
    return F.expr(f"TIMESTAMP_NTZ '{ts}'")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """end - start in seconds (double) for TIMESTAMP_NTZ values, zone-free."""
    iv = c(end) - c(start)
    return (
        F.date_part(F.lit("DAY"), iv).cast("double") * 86400.0
        + F.date_part(F.lit("HOUR"), iv).cast("double") * 3600.0
        + F.date_part(F.lit("MINUTE"), iv).cast("double") * 60.0
        + F.date_part(F.lit("SECOND"), iv).cast("double")
    )


def sla_seconds(severity: str | Column, sla_hours: dict[str, int] | None = None) -> Column:
    """Threshold in seconds for a severity; NULL for an unknown severity."""
    hours = sla_hours or config.SLA_HOURS
    pairs = []
    for k, v in hours.items():
        pairs += [F.lit(k), F.lit(float(v) * 3600.0)]
    return F.create_map(*pairs)[c(severity)]


def resolution_bucket(seconds: str | Column) -> Column:
    s = c(seconds)
    expr = F.when(s.isNull(), F.lit(config.OPEN_BUCKET))
    for label, upper in config.BUCKETS:
        if upper is None:
            return expr.otherwise(F.lit(label))
        expr = expr.when(s <= F.lit(upper * 3600), F.lit(label))
    return expr


def bucket_rank(bucket: str | Column) -> Column:
    """Sort key of a resolution bucket: Open first, then by duration."""
    b = c(bucket)
    expr = F.when(b == F.lit(config.OPEN_BUCKET), F.lit(0))
    for i, (label, _) in enumerate(config.BUCKETS[:-1], start=1):
        expr = expr.when(b == F.lit(label), F.lit(i))
    return expr.otherwise(F.lit(len(config.BUCKETS)))


def sanitize_name(name: str | Column, default: str = "synthetic-dataset") -> Column:
    """Dataset-name sanitiser: trim, runs of [^A-Za-z0-9_.-] -> '-', strip '-._'."""
    s = F.regexp_replace(c(name), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"[^A-Za-z0-9_.-]+", "-")
    s = F.regexp_replace(s, r"^[-._]+|[-._]+$", "")
    return F.when(F.length(s) > 0, s).otherwise(F.lit(default))


def sanitize_name_value(name: str, default: str = "synthetic-dataset") -> str:
    """Scalar form of :func:`sanitize_name` for a single name given by a caller."""
    s = _re.sub(r"[^A-Za-z0-9_.-]+", "-", (name or "").strip()).strip("-._")
    return s or default
