"""Layered build: raw -> staging -> enriched -> marts, gated by data tests, published as a version.

Every build writes a version of its own: ``<out>/<table>/version=<id>``.  The raw
tickets and the wide fact are written once; the mergeable states (value counts and
distinct bitmaps) are aggregated from the written fact, and the three rollup
marts follow from the states, so no rollup reads the fact again.

A version is seen once its tests have passed.  The catalog holds one table per
mart with all its versions as partitions, a view per mart that filters on
``marts.current``, and that one-row view, whose replacement is the only change that
switches all marts at once.  A query keeps the version it was planned with, and
:func:`read_marts` pins one for several.  Staging and enriched tickets are permanent
views over the raw version, in databases of their own.

A failing test removes the version's folders; the published one stays.  Reruns
write other versions, so a retried job does no harm.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..operators import expectations as ex
from ..operators import marts, states
from ..operators.enrich import enrich_tickets
from ..operators.staging import stage_tickets

RAW_NAME = "support_tickets"
MART_NAMES = ("ticket_kpis", "team_workload", "dealer_performance", "product_defects")
# Mergeable states next to the marts they belong to, and the dictionaries of their codes.
STATE_NAMES = ("team_values", "dealer_values", "product_values", "dealer_vehicles", "product_vehicles", "product_dealers",
               "vehicle_codes", "dealer_codes")
CURRENT = "current"
KEEP_VERSIONS = 2


@dataclass
class BuildResult:
    paths: dict[str, str]
    tests: DataFrame | None
    version: str


def _write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a Parquet folder and read it again.  A partitioned write first rebalances on the
    partition keys (AQE splits hot keys and merges small ones), so each task
    writes few partition folders instead of every task writing every folder."""
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = _fs(spark, path)
    fs.delete(hadoop, True)


def stored_versions(spark: SparkSession, out_dir: str) -> list[str]:
    """Versions of the fact under ``out_dir``, oldest first (ids sort by time)."""
    fs, hadoop = _fs(spark, f"{out_dir.rstrip('/')}/ticket_kpis")
    if not fs.exists(hadoop):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(hadoop)]
    return sorted(n.removeprefix("version=") for n in names if n.startswith("version="))


def build_marts(spark: SparkSession, raw: DataFrame, out_dir: str, as_of: _dt.datetime = config.DEFAULT_AS_OF,
                approx: bool = False, run_tests: bool = True, register: bool = True, database: str = "marts",
                keep: int = KEEP_VERSIONS) -> BuildResult:
    """Builds a version under ``out_dir`` and, once its tests pass, publishes it in the catalog.

    ``approx`` takes medians and distinct counts by sketches from the fact and
    writes no states; ``keep`` versions stay, the published one among them.
    """
    out = out_dir.rstrip("/")
    older = stored_versions(spark, out)
    version = f"v{_dt.datetime.now(tz=_dt.timezone.utc):%Y%m%dT%H%M%S%f}_{uuid.uuid4().hex[:6]}"
    paths = {name: f"{out}/{name}/version={version}" for name in (RAW_NAME, *MART_NAMES, *(() if approx else STATE_NAMES))}
    try:
        tests = _build_version(spark, raw, paths, as_of, approx, run_tests, f"{out}/{{}}/version={older[-1]}" if older else None)
    except Exception:
        for path in paths.values():
            _remove(spark, path)
        raise
    if register:
        register_layers(spark, raw, as_of)
        publish(spark, out, version, as_of, database)
    for old in [v for v in older if v not in (older + [version])[-max(1, keep):]]:
        retire(spark, out, old, database if register else None)
    return BuildResult(paths, tests, version)


def _build_version(spark, raw, paths, as_of, approx, run_tests, previous: str | None) -> DataFrame | None:
    raw = _write(raw, paths[RAW_NAME])
    results = []
    if run_tests:
        upstream, _ = ex.upstream_suite(raw, as_of)
        results.append(ex.assert_passed(upstream))
    fact = _write(marts.ticket_fact(enrich_tickets(stage_tickets(raw), as_of)), paths["ticket_kpis"], ["created_month"])
    # The month number comes back from the month.
    fact = fact.withColumn("created_month_num", F.month("created_month"))
    if approx:
        rollups = {"team_workload": marts.team_workload(fact, True), "dealer_performance": marts.dealer_performance(fact, True),
                   "product_defects": marts.product_defects(fact, True)}
    else:
        rollups = _from_states(fact, paths, previous)
    built = {"ticket_kpis": fact.drop("created_month_num")}
    for name, df in rollups.items():
        built[name] = _write(df, paths[name])
    if run_tests:
        results.append(ex.assert_passed(ex.run_suite(built)))
    tests = results[0] if results else None
    for r in results[1:]:
        tests = tests.unionByName(r)
    return tests


def _from_states(fact: DataFrame, paths: dict[str, str], previous: str | None) -> dict[str, DataFrame]:
    """The rollup marts over states that are written first; dictionaries of codes go on from the previous version's."""
    spark = fact.sparkSession

    def known(name: str) -> DataFrame | None:
        if previous is None:
            return None
        fs, hadoop = _fs(spark, f"{previous.format(name)}/_SUCCESS")
        return spark.read.parquet(previous.format(name)) if fs.exists(hadoop) else None

    codes = {name: _write(states.value_codes(fact, column, known(name)), paths[name])
             for name, column in (("vehicle_codes", "vehicle_chassis_id"), ("dealer_codes", "dealer_code"))}
    values = {name: _write(states.value_state(fact, keys), paths[name]) for name, keys in (
        ("team_values", marts.TEAM_KEYS), ("dealer_values", marts.DEALER_KEYS), ("product_values", marts.PRODUCT_KEYS))}
    distinct = {name: _write(states.distinct_state(fact, keys, column, codes[of]), paths[name]) for name, keys, column, of in (
        ("dealer_vehicles", marts.DEALER_KEYS, "vehicle_chassis_id", "vehicle_codes"),
        ("product_vehicles", marts.PRODUCT_KEYS, "vehicle_chassis_id", "vehicle_codes"),
        ("product_dealers", marts.PRODUCT_KEYS, "dealer_code", "dealer_codes"))}
    return {"team_workload": states.team_workload(values["team_values"]),
            "dealer_performance": states.dealer_performance(values["dealer_values"], distinct["dealer_vehicles"]),
            "product_defects": states.product_defects(values["product_values"], distinct["product_vehicles"], distinct["product_dealers"])}


# --- catalog -------------------------------------------------------------------------------------

def _details(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}


def _versions_table(spark: SparkSession, table: str, path: str, version: str) -> list[str]:
    """The table over all versions under ``path``, with ``version`` among its partitions; returns its columns."""
    schema = spark.read.parquet(f"{path}/version={version}").schema
    months = ["created_month"] if path.endswith("/ticket_kpis") else []
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema]
    fs, hadoop = _fs(spark, path)
    location = fs.makeQualified(hadoop).toString()
    if spark.catalog.tableExists(table):
        same = [f"`{f.name}` {f.dataType.simpleString()}" for f in spark.table(table).schema if f.name != "version"] == cols
        if not same or _details(spark, table)["Location"].rstrip("/") != location.rstrip("/"):
            spark.sql(f"DROP TABLE {table}")
    if not spark.catalog.tableExists(table):
        spark.sql(f"CREATE TABLE {table} ({', '.join(cols)}, version string) USING parquet "
                  f"PARTITIONED BY (version{''.join(', ' + m for m in months)}) LOCATION '{path}'")
    if months:
        spark.catalog.recoverPartitions(table)
    else:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS PARTITION (version='{version}')")
    spark.catalog.refreshTable(table)
    return [f.name for f in schema]


def _view(spark: SparkSession, name: str, sql: str) -> None:
    if spark.catalog.tableExists(name) and _details(spark, name).get("Type") != "VIEW":
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS {sql}")


def _select_list(df: DataFrame) -> str:
    """The SQL of a frame's own select list, as its analyzed plan has it."""
    columns = df._jdf.queryExecution().analyzed().projectList()
    return ", ".join(columns.apply(i).sql() for i in range(columns.size()))


def publish(spark: SparkSession, out_dir: str, version: str, as_of: _dt.datetime = config.DEFAULT_AS_OF, database: str = "marts") -> None:
    """Registers a written version and switches to it: the last statement, one view, is what readers see."""
    out = out_dir.rstrip("/")
    for db in ("raw", "staging", "intermediate", database):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    current = f"{database}.{CURRENT}"
    switch = f"SELECT '{version}' AS version"
    if not spark.catalog.tableExists(current):
        _view(spark, current, switch)
    held = [("raw", RAW_NAME)] + [(database, n) for n in (*MART_NAMES, *STATE_NAMES)]
    for db, name in held:
        fs, hadoop = _fs(spark, f"{out}/{name}/version={version}")
        if not fs.exists(hadoop):
            continue
        table = f"{db}.{name}_versions"
        cols = _versions_table(spark, table, f"{out}/{name}", version)
        view = f"SELECT {', '.join(f'`{c}`' for c in cols)} FROM {table} WHERE version = (SELECT version FROM {current})"
        if not spark.catalog.tableExists(f"{db}.{name}") or _details(spark, f"{db}.{name}").get("View Text") != view:
            _view(spark, f"{db}.{name}", view)
    stg, enr = "staging.stg_support_tickets", "intermediate.int_tickets_enriched"
    _view(spark, stg, f"SELECT {_select_list(stage_tickets(spark.table(f'raw.{RAW_NAME}')))} FROM raw.{RAW_NAME}")
    _view(spark, enr, f"SELECT {_select_list(enrich_tickets(spark.table(stg), as_of))} FROM {stg}")
    _view(spark, current, switch)


def retire(spark: SparkSession, out_dir: str, version: str, database: str | None = "marts") -> None:
    """Drops a version that is no longer published, partitions first."""
    out = out_dir.rstrip("/")
    for db, name in [("raw", RAW_NAME)] + [(database, n) for n in (*MART_NAMES, *STATE_NAMES)]:
        if database and spark.catalog.tableExists(f"{db}.{name}_versions"):
            spark.sql(f"ALTER TABLE {db}.{name}_versions DROP IF EXISTS PARTITION (version='{version}')")
        _remove(spark, f"{out}/{name}/version={version}")


def read_marts(spark: SparkSession, database: str = "marts", version: str | None = None) -> dict[str, DataFrame]:
    """All marts and states of one version: the published one now, or a named one that is kept."""
    version = version or spark.table(f"{database}.{CURRENT}").first()["version"]
    names = [n for n in (*MART_NAMES, *STATE_NAMES) if spark.catalog.tableExists(f"{database}.{n}_versions")]
    return {n: spark.table(f"{database}.{n}_versions").where(F.col("version") == F.lit(version)).drop("version") for n in names}


def register_layers(spark: SparkSession, raw: DataFrame, as_of: _dt.datetime = config.DEFAULT_AS_OF) -> None:
    """The lazy layers as session views named after their models."""
    stg = stage_tickets(raw)
    raw.createOrReplaceTempView(RAW_NAME)
    stg.createOrReplaceTempView("stg_support_tickets")
    enrich_tickets(stg, as_of).createOrReplaceTempView("int_tickets_enriched")
