"""Ad-hoc read-only SQL over the registered ``tickets`` view."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Reading a file by its path goes past the registered views.
_FILE_FORMATS = {"parquet", "csv", "json", "orc", "text", "avro", "binaryfile", "xml", "delta"}
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_QUOTED = re.compile(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")

# The explorer's starter queries (SQL text as offered to users).
STARTER_QUERIES: dict[str, str] = {
    "Tickets per team":
        "SELECT assigned_team, COUNT(*) AS tickets\nFROM tickets\nGROUP BY assigned_team\nORDER BY tickets DESC",
    "Avg resolution by severity":
        "SELECT severity, ROUND(AVG(time_to_close_seconds) / 3600.0, 1) AS avg_hours\nFROM tickets\n"
        "WHERE time_to_close_seconds IS NOT NULL\nGROUP BY severity\nORDER BY avg_hours DESC",
    "Open tickets by region":
        "SELECT region, COUNT(*) AS open_tickets\nFROM tickets\nWHERE status = 'Open'\nGROUP BY region\n"
        "ORDER BY open_tickets DESC",
    "Top failure modes":
        "SELECT failure_mode, COUNT(*) AS count\nFROM tickets\nGROUP BY failure_mode\nORDER BY count DESC\nLIMIT 10",
    "Open critical tickets":
        "SELECT ticket_id, description, assigned_team, creation_date\nFROM tickets\n"
        "WHERE severity = 'Critical' AND status = 'Open'\nLIMIT 20",
}


# Functions that call any method of a class on the class path.
_JVM_CALLS = {"reflect", "try_reflect", "java_method"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _parts(plan) -> tuple[set[str], set[str]]:
    """Names of the nodes and of the functions of a parsed plan: children, CTEs and subqueries wherever they stand."""
    names, functions, plans, exprs = set(), set(), [plan], []
    while plans or exprs:
        if plans:
            node = plans.pop()
            names.add(node.nodeName())
            plans += _items(node.children())
            if node.nodeName() == "UnresolvedWith":
                plans += [pair._2() for pair in _items(node.cteRelations())]
            exprs += _items(node.expressions())
            continue
        e = exprs.pop()
        exprs += _items(e.children())
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction":
            functions.add(e.nameParts().last().lower())
        elif kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            plans.append(e.plan())
    return names, functions


def check_select(sql: str, spark: SparkSession | None = None) -> str:
    """The trimmed text if it is one read-only query over views, else an error.

    The parsed plan decides: commands and writes are refused wherever they stand
    (``replace()`` as a function is not one), and so are files read by path and
    functions that call methods of the JVM.
    """
    clean = (sql or "").strip().rstrip(";").strip()
    if not clean:
        raise ValueError("Please enter a query.")
    if clean.split(None, 1)[0].upper() not in ("SELECT", "WITH") or ";" in _QUOTED.sub("''", clean):
        raise ValueError("Only SELECT queries are allowed.")
    spark = spark or SparkSession.getActiveSession()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(clean)
    names, functions = _parts(plan)
    if found := sorted(functions & _JVM_CALLS):
        raise ValueError(f"Functions that run code of the JVM are not allowed: {', '.join(found)}.")
    if any(n.startswith(("Insert", "Create", "Delete", "Update", "Merge", "Drop", "Replace", "Set")) or n.endswith("Command")
           for n in names):
        raise ValueError("Only SELECT queries are allowed.")
    for found in _RELATION.findall(plan.treeString()):
        parts = [p.strip() for p in found.split(",")]
        if len(parts) > 1 and (parts[0].lower() in _FILE_FORMATS or any("/" in p for p in parts)):
            raise ValueError("Queries read registered views, not files.")
    return clean


def run_select(spark: SparkSession, sql: str, limit: int | None = None, args: dict | None = None) -> DataFrame:
    """Guard, then run with bound parameters; all rows, or the first ``limit`` (a positive number) if one is given."""
    clean = check_select(sql, spark)
    if limit is not None and int(limit) < 1:
        raise ValueError(f"limit must be positive, not {limit}")
    df = spark.sql(clean, args=args) if args else spark.sql(clean)
    return df if limit is None else df.limit(int(limit))
