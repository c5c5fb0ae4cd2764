"""Spark session settings and small planning helpers shared by all jobs."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings every job relies on; a cluster launcher may override any of them.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partial (map-side) WindowGroupLimit before the shuffle of top-k windows.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Mart groupings have hundreds to thousands of keys; the default (128)
    # sends median / distinct aggregations to the slower sort-based path.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.parquet.filterPushdown": "true",
    # The JVM does not JIT-compile methods over 8000 bytes of bytecode; wider
    # whole-stage methods (the 38-column ticket projection, the enrichment)
    # would run in the bytecode interpreter.  Above this size Spark splits the
    # stage instead: 2-3x faster on the raw, staged and fact layers.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ticketlake") -> SparkSession:
    """Session for tests and the local bench: local[n], UI off, AQE on."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TICKETLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.session.timeZone", "UTC")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the launcher (a shared file system);
    only a local session gets a fresh temporary folder when none is set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="ticketlake-ckpt-")
    sc.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application).

    Functions handed to pandas UDFs and ``mapInArrow`` are pickled by module
    name, so workers on other machines need the package itself.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ticketlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="ticketlake-pkg-")) / f"{root.name}.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))
    sc._ticketlake_shipped = True


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Eager checkpoint to the session's reliable checkpoint folder (never a
    local checkpoint): cuts lineage so lost executors recompute from files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# A side the planner itself estimates below this needs no row count; a counted
# side may not be larger either (rows times the width of its schema).
MAX_BROADCAST_BYTES = 32 << 20


def sized_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only where it is small now: by the planner's estimate in
    bytes, else by counting at most ``max_rows + 1`` rows.  Nothing is
    remembered, so a table that has grown is joined by shuffle next time."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) <= MAX_BROADCAST_BYTES:
        return F.broadcast(df)
    width = max(8, df._jdf.schema().defaultSize())
    most = min(max_rows, 8 * MAX_BROADCAST_BYTES // width)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
