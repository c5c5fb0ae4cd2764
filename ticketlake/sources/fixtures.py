"""Raw ticket table (38 public columns) derived from the driver's tables.

Grain: one ticket per order.  ``orders`` joins ``customer`` (a shuffle join at
scale, both sides grow with the data) and then the fixed-size ``nation`` and
``region`` dimensions, which are broadcast behind a row-count check.

Each column is one SQL expression over the joined row; the same text runs in
Spark (``F.expr``) and in the DuckDB oracle, except for adding seconds to a
timestamp, which is spelled per engine by :func:`add_seconds`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROUTING_RULES
from ..plans.session import sized_broadcast

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# nation / region are fixed-size dimensions (25 and 5 rows in TPC-H); broadcast
# only while they stay under this bound.
DIM_BROADCAST_ROWS = 10_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def add_seconds(ts: str, n: str, dialect: str) -> str:
    if dialect == "spark":
        return f"timestampadd(SECOND, {n}, {ts})"
    return f"({ts} + to_seconds({n}))"


def _case_mod(expr: str, values: list[str | None]) -> str:
    parts = " ".join(
        f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values[:-1])
    )
    last = values[-1]
    return f"case {expr} {parts} else {'null' if last is None else repr(last)} end"


# The category lists below are the public vocabulary of the columns.
def raw_column_exprs(dialect: str = "spark") -> list[tuple[str, str]]:
    """(public column name, SQL expression) in raw-table order.  ``k`` = o_orderkey."""
    fault_mode = _case_mod("k % 7", ["Leak", "Overheating", "Failure", "Noise", "Short Circuit", "Wear", None])
    component = _case_mod("k % 12", list(ROUTING_RULES))
    product = ("case when k % 12 < 3 then 'Engine Control Module' when k % 12 < 6 then 'Transmission System' "
               "when k % 12 < 9 then 'Electrical System' else 'Brake System' end")
    team = _case_mod("k % 12", list(ROUTING_RULES.values()))
    created = add_seconds("o_orderdate", "(k * 37) % 86400", dialect)
    closed = ("case when o_orderstatus in ('F', 'P') then "
              + add_seconds("o_orderdate", "(k * 37) % 86400 + (k * 7919) % 864000", dialect) + " end")
    status = ("case o_orderstatus when 'F' then 'Closed' when 'P' then 'Resolved' else "
              + _case_mod("k % 5", ["New", "Assigned", "In Progress", "Awaiting Parts", "Escalated"]) + " end")
    return [
        ("ticket_id", "concat('T-', k)"),
        ("vehicle_chassis", "concat('CH', k % 997)"),
        ("vehicle_vin", "concat('VIN', lpad(concat('', k % 997), 14, '0'))"),
        ("chassis_series", "concat('S-', 100 + k % 900)"),
        ("product_code", "concat('P-', 1000 + k % 12)"),
        ("product_family", product),
        ("component_name", component),
        ("fault_code", "concat('E-', 1001 + k % 6)"),
        ("fault_mode", fault_mode),
        ("ticket_status", status),
        ("ticket_substatus", _case_mod("k % 6", ["Investigation", "Waiting on Customer", "Parts Ordered",
                                                 "Action Required", "Completed", "Reopened"])),
        ("status_state", "case when o_orderstatus in ('F', 'P') then 'Closed' else 'Open' end"),
        ("severity_level", "case o_orderpriority when '1-URGENT' then 'Critical' when '2-HIGH' then 'High' "
                           "when '3-MEDIUM' then 'Medium' else 'Low' end"),
        ("current_severity", _case_mod("k % 4", ["Critical", "High", "Medium", "Low"])),
        ("customer_segment", "case c_mktsegment when 'MACHINERY' then 'Fleet Operator' when 'AUTOMOBILE' "
                             "then 'Dealer' when 'BUILDING' then 'Service Partner' else 'Independent Owner' end"),
        ("source_channel", _case_mod("k % 4", ["Dealer Portal", "Email", "Phone", "Monitoring System"])),
        ("service_request_area", _case_mod("k % 6", ["Engine", "Transmission", "Electrical", "Brakes",
                                                     "Suspension", "Body/Chassis"])),
        ("service_request_type", _case_mod("k % 11", ["Warranty Claim", "WARRANTY CLAIM", "Technical Issue",
                                                      "Maintenance Request", "Safety Concern", "Performance Issue",
                                                      "Recall Related"])),
        ("assigned_team", team),
        ("geo_region", "r_name"),
        ("dealer_code", "concat('D-', 1000 + n_nationkey)"),
        ("dealer_label", "concat(n_name, ' Dealer')"),
        ("dealer_city_name", "concat('City-', n_nationkey)"),
        ("dealer_state_code", "concat('S', n_nationkey)"),
        ("dealer_country_code", "n_name"),
        ("handler_country", _case_mod("k % 3", ["USA", "Germany", "Brazil"])),
        ("handler_department", _case_mod("k % 2", ["Engineering", "Quality"])),
        ("reporter_country", "n_name"),
        ("reporter_department", _case_mod("k % 3", ["Field Service", "Sales", "Operations"])),
        ("description", f"concat('Customer reports ', lower(coalesce({fault_mode}, 'issue')), ' at the ', "
                        f"lower({component}), ' of the ', lower({product}), '.')"),
        ("odometer_reading", "cast((k * 101) % 500001 as double)"),
        ("odometer_unit", "case when k % 3 = 0 then 'miles' else 'km' end"),
        ("created_timestamp", created),
        ("created_date", "cast(o_orderdate as date)"),
        ("closed_timestamp", closed),
        ("closed_date", f"cast({closed} as date)"),
        ("first_queue_seconds", "cast((k * 31) % 7201 as integer)"),
        ("resolution_seconds", "case when o_orderstatus in ('F', 'P') then cast((k * 7919) % 864000 as double) end"),
    ]


def tickets_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 38-column raw ticket table with public column names."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = nation.join(sized_broadcast(region, DIM_BROADCAST_ROWS), nation.n_regionkey == region.r_regionkey)
    cust = customer.join(sized_broadcast(geo, DIM_BROADCAST_ROWS), customer.c_nationkey == geo.n_nationkey)
    joined = orders.join(cust, orders.o_custkey == cust.c_custkey).withColumn("k", F.col("o_orderkey"))
    return joined.select(*[F.expr(e).alias(name) for name, e in raw_column_exprs("spark")])


def tickets_raw_sql(dialect: str = "duckdb") -> str:
    """SELECT text of the same raw table (used by the DuckDB oracle)."""
    cols = ",\n    ".join(f"{e} AS {name}" for name, e in raw_column_exprs(dialect))
    return (
        "SELECT\n    " + cols + "\nFROM (SELECT o.*, o.o_orderkey AS k, c.c_mktsegment, n.n_nationkey, n.n_name, r.r_name\n"
        "      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey\n"
        "      JOIN nation n ON c.c_nationkey = n.n_nationkey\n"
        "      JOIN region r ON n.n_regionkey = r.r_regionkey) j"
    )
