"""Rule lookups: component -> team routing rule, severity -> SLA hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..plans.session import sized_broadcast


def rules_frame(spark: SparkSession, rules: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((rules or config.ROUTING_RULES).items()), "component string, rule_team string")


def sla_frame(spark: SparkSession, sla_hours: dict[str, int] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((sla_hours or config.SLA_HOURS).items()), "severity string, sla_hours int")


MAX_RULES_BROADCAST = 10_000


def apply_routing_rules(tickets: DataFrame, rules: DataFrame, component_col: str = "component") -> DataFrame:
    """Left join of tickets with the rule table, one row per ticket: of several
    rules for a component the least team name counts.  The rules are broadcast
    while they are small."""
    r = rules.groupBy(F.col("component").alias("_rule_component")).agg(F.min("rule_team").alias("rule_team"))
    return (tickets.join(sized_broadcast(r, MAX_RULES_BROADCAST), tickets[component_col] == r["_rule_component"], "left")
            .drop("_rule_component"))
