"""Exact, skew-safe quantiles per group (median, quartiles, p95, p99).

Spark's exact ``percentile`` / ``median`` keeps a map of every distinct value
of a group and merges it in one final task, so one hot team or one global
quantile holds all its distinct values in one task's memory.  Here the same
numbers (linear interpolation between the closest ranks, the definition of
``percentile`` and of DuckDB's ``quantile_cont``) come from plain aggregations
and windows, none of which holds a whole group:

1. ``(group, value) -> count``: partial aggregation collapses repeated values
   before the shuffle, and the shuffle on (group, value) spreads a hot group
   over all reducers.
2. Each value falls in a bucket ``sign(v) * floor(log2(1 + |v|) * scale)``,
   which never decreases as ``v`` grows (``log1p`` is semi-monotonic in the
   JVM, products by a positive constant and ``floor`` keep the order).  Counts
   per (group, bucket) and their running sum give each bucket's rank range;
   a group has at most a fixed number of buckets (about ``scale`` per doubling
   of the value), whatever its row count.
3. Only the buckets that hold a target rank are joined back.  A bucket spans a
   relative width of ``2**(1/scale) - 1`` (0.07 % at the default), but continuous
   values may still fill it, so it is cut again, into ``PIECES`` equal ranges between
   its own least and largest value; counts and running sums per piece locate the
   ranks once more.
4. Inside the pieces that hold a target rank, a window ordered by value finds the
   exact values at the two ranks around ``p * (n - 1)``.

No driver round trip: the whole computation is one lazy plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SCALE = 1024
# Ranges a bucket with a target rank is cut into, by its own values.
PIECES = 1024


def value_bucket(v: Column, scale: int = DEFAULT_SCALE) -> Column:
    """Monotone non-decreasing bucket of a double (NaN, which Spark sorts last,
    gets the largest bucket)."""
    m = F.floor(F.log1p(F.abs(v)) * F.lit(scale / math.log(2.0)))
    # Declared non-null (values are non-null here): the join on it then infers
    # no IS NOT NULL filter, so both uses of the (group, value) counts keep the
    # same plan and Spark computes that shuffle once (reused exchange).
    return F.coalesce(F.when(F.isnan(v), F.lit(2 ** 62)).when(v < 0, -m).otherwise(m), F.lit(0))


def exact_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: list[float],
                    names: list[str], scale: int = DEFAULT_SCALE, keep_key: bool = False,
                    weight: str | None = None) -> DataFrame:
    """One row per group (``keys``; none = the whole table) that has a
    non-null value: the keys, then one double column per probability.
    ``weight`` names a column that says how often a row's value counts (the
    rows of a mart state); ``keep_key`` returns the struct group key ``_g`` instead of the key
    columns (see :func:`attach_quantiles`).

    Matches ``percentile(value, p)``: position ``p * (n - 1)`` over the sorted
    non-null values, linear interpolation between its floor and ceil ranks.
    """
    if len(probs) != len(names):
        raise ValueError("one name per probability")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    g = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)  # one null-safe key
    times = [F.col(weight).alias("_w")] if weight else []
    counts = (df.select(g.alias("_g"), v.alias("_v"), *times).filter(F.col("_v").isNotNull())
              .groupBy("_g", "_v").agg((F.coalesce(F.sum("_w"), F.lit(0)) if weight else F.count(F.lit(1))).alias("_c"))
              .withColumn("_b", value_bucket(F.col("_v"), scale)))

    # Rank range [before, before + count) of every (group, bucket).
    by_group = Window.partitionBy("_g")
    running = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = (counts.groupBy("_g", "_b").agg(F.sum("_c").alias("_bc"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
            .select("_g", "_b", "_bc", "_least", "_most", (F.sum("_bc").over(running) - F.col("_bc")).alias("_before"),
                    F.sum("_bc").over(by_group).alias("_n")))

    def ranks(n: Column) -> list[tuple[Column, Column, Column]]:
        out = []
        for p in probs:
            pos = F.lit(float(p)) * (n - F.lit(1)).cast("double")
            out.append((pos, F.floor(pos), F.ceil(pos)))
        return out

    def holds(start: Column, end: Column, r: Column) -> Column:
        return (start <= r) & (r < end)

    def wanted() -> Column:
        start, end = F.col("_before"), F.col("_before") + F.col("_bc")
        return _any([holds(start, end, r) for _, lo, hi in ranks(F.col("_n")) for r in (lo, hi)])

    targets = hist.filter(wanted()).drop("_bc")

    # The same once more inside the target buckets: pieces between the bucket's least and largest value.
    width = F.col("_most") - F.col("_least")
    piece = F.when(width > 0, F.floor((F.col("_v") - F.col("_least")) / width * F.lit(PIECES))).otherwise(F.lit(0))
    cut = counts.join(targets, ["_g", "_b"]).withColumn("_p", F.coalesce(piece, F.lit(0)))
    in_bucket = Window.partitionBy("_g", "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = (cut.groupBy("_g", "_b", "_p").agg(F.sum("_c").alias("_bc"), F.max("_n").alias("_n"), F.max("_before").alias("_start"))
              .select("_g", "_b", "_p", "_n", "_bc", (F.col("_start") + F.sum("_bc").over(in_bucket) - F.col("_bc")).alias("_before"))
              .filter(wanted()).drop("_bc"))

    # Exact ranks inside the target pieces only.
    inside = Window.partitionBy("_g", "_b", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (cut.drop("_n", "_before").join(pieces, ["_g", "_b", "_p"])
              .select("_g", "_v", "_n", (F.col("_before") + F.sum("_c").over(inside)).alias("_end"), "_c"))
    r_start, r_end = F.col("_end") - F.col("_c"), F.col("_end")
    aggs = [F.max("_n").alias("_n")]
    for i, (_, lo, hi) in enumerate(ranks(F.col("_n"))):
        aggs.append(F.max(F.when(holds(r_start, r_end, lo), F.col("_v"))).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(holds(r_start, r_end, hi), F.col("_v"))).alias(f"_hi{i}"))
    picked = ranked.groupBy("_g").agg(*aggs)

    outs = []
    for i, ((pos, lo, hi), name) in enumerate(zip(ranks(F.col("_n")), names)):
        vlo, vhi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append(F.when((lo == hi) | (vlo == vhi), vlo)
                    .otherwise((hi - pos) * vlo + (pos - lo) * vhi).alias(name))
    if keep_key:
        return picked.select("_g", *outs)
    key_cols = [F.col("_g").getField(k).alias(k) for k in keys]
    return picked.select(*key_cols, *outs)


def attach_quantiles(base: DataFrame, df: DataFrame, keys: list[str], value: str | Column,
                     probs: list[float], names: list[str], weight: str | None = None) -> DataFrame:
    """``base`` (one row per group of ``keys``) left-joined with the exact
    quantiles of ``value`` over ``df`` per group (NULL when a group has no
    value).  The join is on the quantile aggregation's own group key, so
    Catalyst knows that side is unique per key and drops the whole quantile
    plan when a query reads none of its columns."""
    q = exact_quantiles(df, keys, value, probs, names, keep_key=True, weight=weight)
    g = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    return (base.select(g.alias("_g"), *[F.col(f"`{c}`") for c in base.columns])
            .join(q, "_g", "left").drop("_g"))


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join two frames grouped by the same keys, NULL keys matching NULL keys
    (one struct key; both sides hold one row per group)."""
    g = F.struct(*[F.col(k) for k in keys]).alias("_g")
    rest = [c for c in right.columns if c not in keys]
    return (left.select(g, *[F.col(f"`{c}`") for c in left.columns])
            .join(right.select(g, *[F.col(f"`{c}`") for c in rest]), "_g", how).drop("_g"))


def _any(conds: list[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out
