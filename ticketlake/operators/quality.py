"""Data-quality profile of a whole table (not a preview sample).

Duplicate rows are found in two phases: rows go through the shuffle as a 128-bit
hash and their null pattern (from which the null counts follow in the same
pass), and only rows whose hash occurs twice are grouped by all columns.

The schema profile is one pass over the columns as Arrow batches: each task keeps
a bounded dictionary per column and emits a fixed-width key per value it
has not seen, so neither the rows are expanded by their columns nor the texts shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_half_up
from ..plans.session import ship_package
from .quantiles import exact_quantiles

# Keys of a column that a task remembers; when they are more it forgets them and may emit a key again.
DICTIONARY = 8_192
_HASH_KEYS = ("profile-of-a-one", "profile-of-a-two")


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def row_hash_columns(df: DataFrame) -> tuple[Column, Column, Column]:
    """Two 64-bit hashes of the row, and its null pattern (a bit per column, 63 to a long)."""
    cols = df.columns
    masks = []
    for lo in range(0, len(cols), 63):
        bits = [F.when(_q(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(cols[lo:lo + 63])]
        masks.append(sum(bits[1:], bits[0]))
    # A null leaves the hash as it is, so the pattern is hashed along.
    parts = [*masks, *[_q(c) for c in cols]]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts), F.array(*masks)


def row_hashes(df: DataFrame) -> DataFrame:
    """(h1, h2, nulls, n): how often each row hash and null pattern occurs."""
    h1, h2, nulls = row_hash_columns(df)
    return (df.select(h1.alias("h1"), h2.alias("h2"), nulls.alias("nulls"))
            .groupBy("h1", "h2", "nulls").agg(F.count(F.lit(1)).alias("n")))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """The rows that occur more than once (all columns equal, nulls equal), once each, with ``n``.

    Rows are first counted by hash; only those whose hash occurs again are compared in full.
    """
    cols = df.columns
    name = "_n_rows"
    suspects = row_hashes(df).where("n > 1").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    h1, h2, _ = row_hash_columns(df)
    held = df.select(*[_q(c) for c in cols], h1.alias("_r1"), h2.alias("_r2"))
    same = held.join(suspects, (F.col("_r1") == F.col("_h1")) & (F.col("_r2") == F.col("_h2")), "left_semi")
    return same.groupBy(*[_q(c) for c in cols]).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1).withColumnRenamed(name, "n")


def overview(df: DataFrame) -> DataFrame:
    """rows, columns, duplicate_rows (all columns equal, nulls equal, first kept),
    duplicate_pct (NULL for an empty table), overall_null_pct (mean of column null %)."""
    cols = df.columns
    hashed = row_hashes(df)
    nulls = [F.sum(F.when(F.col("nulls")[i // 63].bitwiseAND(F.lit(1 << (i % 63)).cast("long")) != 0, F.col("n")).otherwise(F.lit(0)))
             for i in range(len(cols))]
    rows = F.coalesce(F.sum("n"), F.lit(0))
    counted = hashed.agg(rows.alias("rows"), sum(nulls[1:], nulls[0]).alias("nulls"))
    repeated = duplicate_groups(df).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
    cells = F.nullif(F.col("rows"), F.lit(0)) * F.lit(float(len(cols)))
    return counted.crossJoin(repeated).select(  # one row each
        "rows", F.lit(len(cols)).alias("columns"), "duplicate_rows",
        round_half_up(F.lit(100.0) * F.col("duplicate_rows") / F.nullif(F.col("rows"), F.lit(0)), 4).alias("duplicate_pct"),
        round_half_up(F.lit(100.0) * F.col("nulls") / cells, 4).alias("overall_null_pct"))


def _unpivot_counts(df: DataFrame, exprs: dict[str, Column], value_type: str) -> DataFrame:
    """One aggregate row of named measures -> (column, value) rows."""
    row = df.agg(*[e.alias(k) for k, e in exprs.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("column"), F.col(f"`{k}`").cast(value_type).alias("value"))
                      for k in exprs])
    return row.select(F.inline(pairs))


def null_by_column(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """Null % per column (4 dp), descending; by default only columns with nulls."""
    n = F.count(F.lit(1))
    out = _unpivot_counts(df, {c: F.lit(100.0) * F.count_if(_q(c).isNull()) / F.nullif(n, F.lit(0))
                               for c in df.columns}, "double")
    out = out.select("column", round_half_up("value", 4).alias("null_pct"))
    if only_positive:
        out = out.filter(F.col("null_pct") > 0)
    return out.orderBy(F.desc("null_pct"), "column")


def _one_zero(df: DataFrame, c: str) -> Column:
    """The column, with -0.0 as 0.0 (equal values, different texts)."""
    if df.schema[c].dataType.typeName() not in ("double", "float"):
        return _q(c)
    return F.when(_q(c) == 0, F.lit(0.0)).otherwise(_q(c))


def _profile_value(df: DataFrame, c: str) -> tuple[Column, str, Column]:
    """The column as a long, double or string (its kind), and how its least value is written from ``least``."""
    kind, least = df.schema[c].dataType, F.col("least")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _q(c).cast("long"), "long", least.cast("long").cast("string")
    if isinstance(kind, T.BooleanType):
        return _q(c).cast("int").cast("long"), "long", least.cast("long").cast("boolean").cast("string")
    if isinstance(kind, T.DateType):
        return F.unix_date(_q(c)).cast("long"), "long", F.date_from_unix_date(least.cast("int")).cast("string")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(_q(c)), "long", F.timestamp_micros(least.cast("long")).cast("string")
    if isinstance(kind, T.TimestampNTZType):
        zero = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
        span = _q(c) - zero
        micros = (F.extract(F.lit("DAY"), span).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), span).cast("long") * 3_600_000_000
                  + F.extract(F.lit("MINUTE"), span).cast("long") * 60_000_000
                  + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long"))
        return micros, "long", (zero + F.make_dt_interval(secs=(least.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))).cast("string")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        whole = (_q(c) * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("long")
        return whole, "long", (least.cast("decimal(38,0)") / F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast(kind).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _one_zero(df, c).cast("double"), "double", least.cast("double").cast(kind).cast("string")
    return _q(c).cast("string"), "string", least


def _profile_batches(batches, kinds: list[str]):
    """Rows (pos, h1, h2) per value first seen here, and one row per column with its counts and least value."""
    n = len(kinds)
    seen: list[set] = [set() for _ in range(n)]
    rows, nulls, least = 0, [0] * n, [None] * n
    for b in batches:
        rows += b.num_rows
        for i, kind in enumerate(kinds):
            column = b.column(i)
            nulls[i] += column.null_count
            values = pc.drop_null(pc.unique(column))
            if not len(values):
                continue
            if kind == "double":
                numbers = values.to_numpy()
                real = numbers[~np.isnan(numbers)]
                low = float(real.min()) if len(real) else float("nan")
                # NaN is the largest value, and one value whatever its bits.
                bits = np.where(np.isnan(numbers), np.float64("nan"), numbers).view(np.int64)
                first, second = bits, np.zeros(len(bits), np.int64)
                better = least[i] is None or np.isnan(least[i]) or low < least[i]
            elif kind == "long":
                first = values.to_numpy().astype(np.int64)
                second, low = np.zeros(len(first), np.int64), int(first.min())
                better = least[i] is None or low < least[i]
            else:
                texts = values.to_numpy(zero_copy_only=False)
                first, second = (pd.util.hash_array(texts, hash_key=k, categorize=False).view(np.int64) for k in _HASH_KEYS)
                low = pc.min(values).as_py()
                better = least[i] is None or low.encode() < least[i].encode()
            if better:
                least[i] = low
            new = [j for j, key in enumerate(zip(first.tolist(), second.tolist(), strict=True)) if key not in seen[i]]
            if not new:
                continue
            if len(seen[i]) + len(new) > DICTIONARY:
                seen[i].clear()
            if len(new) <= DICTIONARY:
                seen[i].update(zip(first[new].tolist(), second[new].tolist(), strict=True))
            yield _profile_rows([i] * len(new), first[new], second[new])
    yield _profile_rows(range(n), None, None, rows, nulls, [str(x) if k == "long" and x is not None else x if k == "string" else
                                                            None if x is None else repr(x) for x, k in zip(least, kinds, strict=True)],
                        [float(x) if k != "string" and x is not None else None for x, k in zip(least, kinds, strict=True)])


def _profile_rows(pos, h1, h2, rows=0, nulls=None, least=None, number=None) -> pa.RecordBatch:
    n = len(pos)
    none = [None] * n
    return pa.RecordBatch.from_arrays(
        [pa.array(list(pos), pa.int32()), pa.array(none if h1 is None else h1, pa.int64()), pa.array(none if h2 is None else h2, pa.int64()),
         pa.array([rows] * n, pa.int64()), pa.array(nulls or [0] * n, pa.int64()), pa.array(least or none, pa.string()),
         pa.array(number or none, pa.float64())], ["pos", "h1", "h2", "rows", "nulls", "least", "number"])


def schema_profile(df: DataFrame) -> DataFrame:
    """Per column: type, null % (1 dp), distinct non-null values, sample (the
    smallest non-null value, as text, so the profile is deterministic).

    Numbers, dates and timestamps are told apart by their own bits, texts by two
    64-bit hashes.  Columns of other types count and sort by their text.
    """
    ship_package(df.sparkSession)
    plans = [_profile_value(df, c) for c in df.columns]
    kinds = [kind for _, kind, _ in plans]
    narrow = df.select(*[v.alias(f"c{i}") for i, (v, _, _) in enumerate(plans)])
    seen = narrow.mapInArrow(lambda batches: _profile_batches(batches, kinds),
                             "pos int, h1 long, h2 long, rows long, nulls long, least string, number double")
    # Numbers compare as numbers (exact where a double is; else the longer text of equal doubles decides), texts as texts.
    low = F.min(F.when(F.col("least").isNotNull(), F.struct(F.col("number"), _exact("least", "number").alias("exact"), F.col("least"))))
    once = seen.groupBy("pos", "h1", "h2").agg(F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), low.alias("low"))
    per = once.groupBy("pos").agg(F.count("h1").alias("unique_values"), F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"),
                                  F.min("low").getField("least").alias("least"))
    text = F.when(F.lit(False), F.lit(""))
    for i, (_, _, shown) in enumerate(plans):
        text = text.when(F.col("pos") == i, shown)
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("pos") + 1)
    kind = F.element_at(F.array(*[F.lit(f.dataType.simpleString()) for f in df.schema]), F.col("pos") + 1)
    return per.orderBy("pos").select(
        name.alias("column"), kind.alias("type"),
        round_half_up(F.lit(100.0) * F.col("nulls") / F.nullif(F.col("rows"), F.lit(0)), 1).alias("null_pct"),
        "unique_values", F.coalesce(text, F.lit("—")).alias("sample"))


def _exact(text: str, number: str) -> Column:
    """Whole numbers beyond the precision of a double, for ordering; NULL for all others."""
    return F.when(F.col(number).isNotNull(), F.expr(f"try_cast({text} as decimal(38,0))"))


def hours_column(df: DataFrame, seconds_col: str = "time_to_close_seconds") -> DataFrame:
    """Numeric hours of a seconds column; non-numeric and NULL values dropped."""
    h = F.expr(f"try_cast(`{seconds_col}` as double)") / F.lit(3600.0)
    return df.select(h.alias("h")).filter(F.col("h").isNotNull())


def resolution_stats(df: DataFrame, seconds_col: str = "time_to_close_seconds") -> DataFrame:
    """n, median and p95 hours (linear interpolation), quartiles and IQR outliers
    (strictly outside q1 - 1.5 iqr .. q3 + 1.5 iqr).

    The quartiles are exact and skew-safe (:func:`exact_quantiles`, no task
    holds the column); these four scalars come to the driver (one row), then
    the outlier count is a filtered aggregate.
    """
    h = hours_column(df, seconds_col)
    r = exact_quantiles(h, [], "h", [0.25, 0.5, 0.75, 0.95], ["q1", "med", "q3", "p95"]).first()
    q = None if r is None else (r["q1"], r["med"], r["q3"], r["p95"])
    if q is None:
        return h.agg(F.count(F.lit(1)).alias("n")).select(
            "n", *[F.lit(None).cast("double").alias(c) for c in
                   ("median_hours", "p95_hours", "q1_hours", "q3_hours", "iqr_hours")],
            F.lit(0).cast("bigint").alias("outliers"), F.lit(None).cast("double").alias("outlier_pct"))
    q1, med, q3, p95 = q
    iqr = q3 - q1
    lo, hi = q1 - 1.5 * iqr, q3 + 1.5 * iqr
    out = F.count_if((F.col("h") < F.lit(lo)) | (F.col("h") > F.lit(hi)))
    return h.agg(F.count(F.lit(1)).alias("n"), out.alias("outliers")).select(
        "n",
        round_half_up(F.lit(med), 4).alias("median_hours"),
        round_half_up(F.lit(p95), 4).alias("p95_hours"),
        round_half_up(F.lit(q1), 4).alias("q1_hours"),
        round_half_up(F.lit(q3), 4).alias("q3_hours"),
        round_half_up(F.lit(iqr), 4).alias("iqr_hours"),
        "outliers",
        round_half_up(F.lit(100.0) * F.col("outliers") / F.nullif(F.col("n"), F.lit(0)), 4).alias("outlier_pct"),
    )


def histogram(df: DataFrame, seconds_col: str = "time_to_close_seconds", bins: int = 60,
              clip_quantile: float = 0.99) -> DataFrame:
    """Equal-width histogram of hours clipped at the ``clip_quantile`` value:
    (bin, bin_start, bin_end, count), non-empty bins only."""
    h = hours_column(df, seconds_col)
    r = exact_quantiles(h, [], "h", [0.0, clip_quantile], ["lo", "hi"]).first()
    if r is None or r["lo"] is None:
        return h.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_start"), F.lit(0.0).alias("bin_end"),
                        F.lit(0).cast("bigint").alias("count")).limit(0)
    lo, hi = float(r["lo"]), float(max(r["hi"], r["lo"]))
    width = (hi - lo) / bins if hi > lo else 1.0
    v = F.least(F.col("h"), F.lit(hi))
    b = F.least(F.lit(bins - 1), F.floor((v - F.lit(lo)) / F.lit(width)).cast("int")) if hi > lo else F.lit(0)
    return (h.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", round_half_up(F.lit(lo) + F.col("bin") * F.lit(width), 4).alias("bin_start"),
                    round_half_up(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 4).alias("bin_end"), "count")
            .orderBy("bin"))
