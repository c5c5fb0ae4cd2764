"""Declared data tests (unique, not_null, accepted_values, minimum) and
singular row tests, evaluated as Spark aggregates.

Per model, every column test is one ``count_if`` in a single aggregate (one
scan); each ``unique`` test is one grouped count.  The suite result is a
table (model, test, column, failures, passed).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    kind: str  # unique | not_null | accepted_values | min_value
    values: tuple = field(default_factory=tuple)
    minimum: float | None = None

    @property
    def name(self) -> str:
        return {"unique": "unique", "not_null": "not_null", "accepted_values": "accepted_values",
                "min_value": "min_value"}[self.kind]


def _nn(model, *columns):
    return [Check(model, c, "not_null") for c in columns]


STATUS = tuple(config.STATUSES)
SEVERITY = tuple(config.SEVERITIES)

# The declared suite (41 tests): seed -> staging -> intermediate -> marts.
SUITE: list[Check] = [
    Check("raw", "ticket_id", "unique"), *_nn("raw", "ticket_id", "created_timestamp"),
    Check("raw", "ticket_status", "accepted_values", STATUS),
    Check("raw", "severity_level", "accepted_values", SEVERITY),
    Check("raw", "customer_segment", "accepted_values", tuple(config.SEGMENTS)),
    Check("raw", "odometer_unit", "accepted_values", tuple(config.ODOMETER_UNITS)),

    Check("staging", "ticket_id", "unique"),
    *_nn("staging", "ticket_id", "vehicle_chassis_id", "product_family", "ticket_status"),
    Check("staging", "ticket_status", "accepted_values", STATUS),
    *_nn("staging", "severity_level"),
    Check("staging", "severity_level", "accepted_values", SEVERITY),
    *_nn("staging", "assigned_team", "created_at", "created_date"),

    Check("enriched", "ticket_id", "unique"), *_nn("enriched", "ticket_id", "is_closed", "is_open"),

    Check("ticket_kpis", "ticket_id", "unique"), *_nn("ticket_kpis", "ticket_id", "severity_level"),
    Check("ticket_kpis", "severity_level", "accepted_values", SEVERITY),
    *_nn("ticket_kpis", "ticket_status"),
    Check("ticket_kpis", "ticket_status", "accepted_values", STATUS),
    Check("ticket_kpis", "resolution_hours", "min_value", minimum=0),
    *_nn("ticket_kpis", "created_date", "assigned_team"),

    *_nn("team_workload", "assigned_team", "created_month", "total_tickets"),
    Check("team_workload", "total_tickets", "min_value", minimum=0),
    *_nn("dealer_performance", "dealer_code", "created_month", "total_tickets"),
    *_nn("product_defects", "product_family", "total_tickets"),
    Check("product_defects", "total_tickets", "min_value", minimum=1),
]


def _failure_expr(chk: Check):
    c = F.col(chk.column)
    if chk.kind == "not_null":
        return F.count_if(c.isNull())
    if chk.kind == "accepted_values":
        return F.count_if(c.isNotNull() & ~c.isin(*chk.values))
    if chk.kind == "min_value":
        return F.count_if(c.isNotNull() & (c < F.lit(chk.minimum)))
    raise ValueError(chk.kind)


def unique_failures(df: DataFrame, column: str) -> DataFrame:
    """Offending keys of a uniqueness test (NULL keys ignored)."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") > 1))


def _result(seq, model: str, test: str, column, failures):
    return F.struct(F.lit(seq).alias("seq"), F.lit(model).alias("model"), F.lit(test).alias("test"),
                    F.lit(column).cast("string").alias("column"), failures.cast("bigint").alias("failures"))


def run_suite(models: dict[str, DataFrame], suite: list[Check] | None = None,
              columns: dict[str, dict[str, str]] | None = None,
              singular: dict[str, tuple[str, object]] | None = None) -> DataFrame:
    """Evaluate the suite on the given models (missing models are skipped).

    Models given as the same DataFrame object (row-aligned layers carried in
    one frame) are tested in one aggregate, and a uniqueness test on the same
    frame and column runs once.  ``columns`` maps a model's column name to the
    frame's column name where they differ.  ``singular`` adds row tests
    (name -> (model, condition factory)) counted in the first model's aggregate.

    Per frame: one global aggregate (map-side partial counts, no shuffle of
    rows) for all column and singular tests, and one narrow grouped count per
    unique column (shuffle of the key only).
    """
    suite = suite or SUITE
    columns = columns or {}
    by_frame: dict[int, list[tuple[int, Check, str]]] = {}
    frames: dict[int, DataFrame] = {}
    for i, k in enumerate(suite):
        if k.model in models:
            df = models[k.model]
            frames[id(df)] = df
            col = columns.get(k.model, {}).get(k.column, k.column)
            by_frame.setdefault(id(df), []).append((i, k, col))
    first = next(iter(models.values()))
    if singular:
        frames.setdefault(id(first), first)
        by_frame.setdefault(id(first), [])
    parts = []
    for fid, items in by_frame.items():
        df = frames[fid]
        # (seq, model, test, column, failure count expression)
        rows = [(i, k.model, k.name, k.column, _failure_expr(Check(k.model, c, k.kind, k.values, k.minimum)))
                for i, k, c in items if k.kind != "unique"]
        if singular and fid == id(first):
            rows += [(len(suite) + j, model, name, None, F.count_if(F.coalesce(cond(), F.lit(False))))
                     for j, (name, (model, cond)) in enumerate(singular.items())]
        if rows:
            agg = df.agg(*[e.alias(f"f{j}") for j, (*_, e) in enumerate(rows)])
            parts.append(agg.select(F.inline(F.array(*[
                _result(seq, model, test, column, F.col(f"f{j}"))
                for j, (seq, model, test, column, _) in enumerate(rows)]))))
        uniq: dict[str, list[tuple[int, Check]]] = {}
        for i, k, c in items:
            if k.kind == "unique":
                uniq.setdefault(c, []).append((i, k))
        for c, checks in uniq.items():
            n = unique_failures(df, c).agg(F.count(F.lit(1)).alias("failures"))
            parts.append(n.select(F.inline(F.array(*[
                _result(i, k.model, "unique", k.column, F.col("failures")) for i, k in checks]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("passed", F.col("failures") == 0).orderBy("seq").drop("seq")


# Raw columns the raw-layer tests need that staging renames or recasts.
RAW_ONLY = {"created_timestamp": "raw__created_timestamp", "odometer_unit": "raw__odometer_unit"}


def upstream_suite(raw: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """raw + staging + enriched tests in one pass; returns (results, staged)."""
    from ..operators.enrich import enrich_tickets
    from ..operators.staging import stage_tickets
    wide_stg = stage_tickets(raw, keep_raw=list(RAW_ONLY))
    wide = enrich_tickets(wide_stg, as_of) if as_of else enrich_tickets(wide_stg)
    # Declared and singular tests of the three layers: one aggregate and one
    # narrow uniqueness count over the same row-aligned frame.
    res = run_suite({"raw": wide, "staging": wide, "enriched": wide}, columns={"raw": RAW_ONLY},
                    singular={name: ("staging", cond) for name, cond in SINGULAR_ROWS.items()})
    return res, wide


def _negative_resolution_rows():
    return ((F.col("ticket_status") == "Closed") & F.col("resolution_seconds").isNotNull()
            & (F.col("resolution_seconds") < 0))


def _closed_without_date_rows():
    return (F.col("ticket_status") == "Closed") & F.col("closed_date").isNull()


def negative_resolution(stg: DataFrame) -> DataFrame:
    """Singular test: closed tickets with a negative resolution time."""
    return stg.filter(_negative_resolution_rows()).select(
        "ticket_id", "created_at", "closed_at", "resolution_seconds")


def closed_without_date(stg: DataFrame) -> DataFrame:
    """Stated rule: a Closed ticket always has a closed_date."""
    return stg.filter(_closed_without_date_rows()).select(
        "ticket_id", "ticket_status", "closed_at", "closed_date")


SINGULAR = {"assert_no_negative_resolution": negative_resolution,
            "assert_closed_has_closed_date": closed_without_date}
# The row condition of each singular test, for counting them in one scan.
SINGULAR_ROWS = {"assert_no_negative_resolution": _negative_resolution_rows,
                 "assert_closed_has_closed_date": _closed_without_date_rows}


def run_singular(stg: DataFrame) -> DataFrame:
    """Failure counts of all singular tests from one aggregate (one scan)."""
    counts = stg.agg(*[F.count_if(F.coalesce(cond(), F.lit(False))).alias(f"s{i}")
                       for i, cond in enumerate(SINGULAR_ROWS.values())])
    out = counts.select(F.inline(F.array(*[
        F.struct(F.lit("staging").alias("model"), F.lit(name).alias("test"),
                 F.lit(None).cast("string").alias("column"), F.col(f"s{i}").alias("failures"))
        for i, name in enumerate(SINGULAR_ROWS)])))
    return out.withColumn("passed", F.col("failures") == 0)


class DataTestFailure(RuntimeError):
    pass


def assert_passed(results: DataFrame) -> DataFrame:
    """The results (one row per declared test, run once); raises when any test failed."""
    rows = results.collect()
    if failed := [r for r in rows if not r["passed"]]:
        raise DataTestFailure("; ".join(f"{r['model']}.{r['column']} {r['test']}: {r['failures']}" for r in failed))
    return results.sparkSession.createDataFrame(rows, results.schema)
