"""Dataset storage: typed CSV reads, Parquet datasets, named snapshots,
metadata records, mart tables, exports and fingerprints."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import sanitize_name_value
from ..operators.columns import normalize_columns

PREVIEW_MAX = 5000

# Raw ticket file as delivered: dates and timestamps as text, typed numerics.
RAW_CSV_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in [
        "ticket_id", "vehicle_chassis", "vehicle_vin", "chassis_series", "product_code", "product_family",
        "component_name", "fault_code", "fault_mode", "ticket_status", "ticket_substatus", "status_state",
        "severity_level", "current_severity", "customer_segment", "source_channel", "service_request_area",
        "service_request_type", "assigned_team", "geo_region", "dealer_code", "dealer_label",
        "dealer_city_name", "dealer_state_code", "dealer_country_code", "handler_country",
        "handler_department", "reporter_country", "reporter_department", "description"]]
    + [T.StructField("odometer_reading", T.DoubleType()), T.StructField("odometer_unit", T.StringType()),
       T.StructField("created_timestamp", T.StringType()), T.StructField("created_date", T.StringType()),
       T.StructField("closed_timestamp", T.StringType()), T.StructField("closed_date", T.StringType()),
       T.StructField("first_queue_seconds", T.IntegerType()),
       T.StructField("resolution_seconds", T.DoubleType())])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header.  With a schema the read fails fast on malformed rows;
    without one the types are inferred (one extra pass over the file)."""
    r = spark.read.option("header", True)
    if schema is not None:
        return r.schema(schema).option("mode", "FAILFAST").csv(path)
    return r.option("inferSchema", True).csv(path)


def preview(df: DataFrame, limit: int = PREVIEW_MAX, order_by: str | None = "ticket_id") -> DataFrame:
    """First ``limit`` rows (1 to 5000, else an error) in key order; adds
    creation_date from created_date when only the latter exists."""
    if not 1 <= int(limit) <= PREVIEW_MAX:
        raise ValueError(f"a preview has 1 to {PREVIEW_MAX} rows, not {limit}")
    if "creation_date" not in df.columns and "created_date" in df.columns:
        df = df.withColumn("creation_date", F.col("created_date"))
    if order_by and order_by in df.columns:
        df = df.orderBy(order_by)
    return df.limit(int(limit))


def dataset_status(df: DataFrame | None, spark: SparkSession | None = None, name: str | None = None,
                   source: str | None = None) -> DataFrame:
    """One row: exists, row_count, column_count, routing_capable (assigned_team
    present after alias normalisation), dataset_name, dataset_source; ``df`` is
    None where there is no dataset."""
    label = [F.lit(name).cast("string").alias("dataset_name"), F.lit(source).cast("string").alias("dataset_source")]
    if df is None:
        return (spark or SparkSession.getActiveSession()).range(1).select(
            F.lit(False).alias("exists"), F.lit(0).cast("long").alias("row_count"), F.lit(0).alias("column_count"),
            F.lit(False).alias("routing_capable"), *label)
    cols = normalize_columns(df.limit(0)).columns
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(True).alias("exists"), "row_count", F.lit(len(df.columns)).alias("column_count"),
        F.lit("assigned_team" in cols).alias("routing_capable"), *label)


def save_dataset(df: DataFrame, path: str) -> DataFrame:
    """Normalise names and overwrite the active dataset (Parquet)."""
    out = normalize_columns(df)
    out.write.mode("overwrite").parquet(path)
    return out


def register_tickets(df: DataFrame, view: str = "tickets") -> DataFrame:
    """Expose the dataset (internal names) to SQL, replacing any previous one."""
    out = normalize_columns(df)
    out.createOrReplaceTempView(view)
    return out


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """Write a named copy under ``root`` partitioned by ``snapshot_name``;
    only that partition is replaced (dynamic partition overwrite)."""
    safe = sanitize_name_value(name)
    (df.withColumn("snapshot_name", F.lit(safe)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_name").parquet(root))
    return safe


def _snapshots(spark: SparkSession, root: str) -> DataFrame | None:
    """All snapshots with their names as text ("007" stays "007"); None where the root does not exist."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    found = spark.read.parquet(root)
    fields = [f for f in found.schema.fields if f.name != "snapshot_name"]
    schema = T.StructType([*fields, T.StructField("snapshot_name", T.StringType())])
    return spark.read.schema(schema).parquet(root)


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """(name, row_count) of every snapshot; none for a missing root."""
    held = _snapshots(spark, root)
    if held is None:
        return spark.createDataFrame([], "name string, row_count long")
    return (held.groupBy(F.col("snapshot_name").alias("name"))
            .agg(F.count(F.lit(1)).alias("row_count")).orderBy("name"))


def load_snapshot(spark: SparkSession, root: str, name: str, view: str | None = "tickets") -> DataFrame:
    """Partition-pruned read of one snapshot; raises when it does not exist."""
    safe = sanitize_name_value(name)
    held = _snapshots(spark, root)
    df = None if held is None else held.filter(F.col("snapshot_name") == safe).drop("snapshot_name")
    if df is None or df.limit(1).count() == 0:
        raise FileNotFoundError(f"No snapshot found for name '{safe}'")
    if view:
        register_tickets(df, view)
    return df


def metadata_record(spark: SparkSession, **fields) -> DataFrame:
    """One-row record with a UTC timestamp (``saved_at_utc``); a null field is a text column."""
    fields.setdefault("saved_at_utc", _dt.datetime.now(tz=_dt.timezone.utc).replace(tzinfo=None).isoformat())
    kinds = {bool: "boolean", int: "long", float: "double"}
    schema = ", ".join(f"`{k}` {kinds.get(type(v), 'string')}" for k, v in fields.items())
    return spark.createDataFrame([tuple(v if v is None or type(v) in kinds else str(v) for v in fields.values())], schema)


def append_metadata(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").json(path)


def latest_metadata(spark: SparkSession, path: str, ts: str = "saved_at_utc") -> DataFrame:
    m = spark.read.json(path)
    return m.agg(F.max_by(F.struct(*m.columns), F.col(ts)).alias("r")).select("r.*")


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: row count, xor and exact sum of
    per-row 64-bit hashes (the sum keeps duplicate rows visible)."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
    )


def read_mart(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.table(name) if spark.catalog.tableExists(name) else None


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_set(frames: dict[str, DataFrame], root: str) -> list[str]:
    """Write each named export frame as a CSV folder under ``root``."""
    out = []
    for name, frame in frames.items():
        p = f"{root.rstrip('/')}/{name}"
        export_csv(frame, p)
        out.append(p)
    return out
