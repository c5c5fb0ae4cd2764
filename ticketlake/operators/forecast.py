"""Linear trend and forecast on a weekly series.

x is the ordinal of the weeks present (gaps are not filled), fitted with
``regr_slope`` / ``regr_intercept``; the forecast is clipped at 0 and dated
last week + 7*i days.  Needs at least 3 weeks.  The input is an aggregate
(one row per week and optional key), so its size is bounded by the calendar,
not by the ticket count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.columns import round_half_up


def weekly_forecast(weekly: DataFrame, horizon: int = config.FORECAST_WEEKS, by: list[str] | None = None,
                    week_col: str = "week", value_col: str = "count", digits: int = 4) -> DataFrame:
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(week_col) if keys else Window.orderBy(week_col)
    xs = weekly.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    fit = xs.groupBy(*keys).agg(
        F.regr_slope(F.col(value_col).cast("double"), "x").alias("slope"),
        F.regr_intercept(F.col(value_col).cast("double"), "x").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
        F.max(week_col).alias("last_week"),
    ).filter(F.col("n") >= 3)
    fc = fit.select(*keys, "slope", "intercept", "n", "last_week",
                    F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("i"))
    forecast = fc.select(
        *keys,
        F.date_add("last_week", F.col("i") * 7).alias(week_col),
        round_half_up(F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("i"))),
                      digits).alias(value_col),
        F.lit("forecast").alias("kind"),
    )
    actual = weekly.select(*keys, week_col, F.col(value_col).cast("double").alias(value_col),
                           F.lit("actual").alias("kind"))
    return actual.unionByName(forecast).orderBy(*keys, week_col)


def trend(weekly: DataFrame, by: list[str] | None = None, week_col: str = "week",
          value_col: str = "count", digits: int = 6) -> DataFrame:
    keys = by or []
    w = Window.partitionBy(*keys).orderBy(week_col) if keys else Window.orderBy(week_col)
    xs = weekly.withColumn("x", (F.row_number().over(w) - 1).cast("double"))
    return xs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("weeks"),
        round_half_up(F.regr_slope(F.col(value_col).cast("double"), "x"), digits).alias("slope"),
        round_half_up(F.regr_intercept(F.col(value_col).cast("double"), "x"), digits).alias("intercept"),
    ).filter(F.col("weeks") >= 3)
