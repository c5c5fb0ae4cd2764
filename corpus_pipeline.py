"""The corpus pipeline: stages over ``documents``, each by one of the operators.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  In order: documents predicted toxic
go; lines that recur across documents go; of each group of near duplicates the
least doc_id stays; documents that hold a benchmark item go; the rest is packed.

Every row is judged and removed for its own text, also where rows repeat or lack
a doc_id; line_dedup alone does not change rows without one.  Rows of equal
doc_id and text become one in the near-duplicate stage; of rows that are near
copies the one with the least doc_id stays, any before one without.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.llm.blocks import cut, fresh
from ticketlake.llm.decontam import drop_contaminated
from ticketlake.llm.linededup import drop_recurring_lines
from ticketlake.llm.nearup import near_duplicates
from ticketlake.llm.packing import pack_documents
from ticketlake.llm.toxicity import score_toxicity
from ticketlake.plans.session import sized_broadcast
from ticketlake.sources.fixtures import read_table

# Ids a stage removes are broadcast up to this many rows, beyond it joined by shuffle.
REMOVED_BROADCAST_ROWS = 2_000_000


def without(docs: DataFrame, gone: DataFrame, *keys: Column) -> DataFrame:
    """``docs`` without the rows whose ``keys`` (null-safe) are the columns of a row of ``gone``."""
    names = [fresh(docs.columns, f"_removed{i}") for i in range(len(keys))]
    gone = sized_broadcast(gone.toDF(*names).distinct(), REMOVED_BROADCAST_ROWS)
    same = [k.eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    return docs.join(gone, reduce(and_, same), "left_anti")


def text_id() -> list[Column]:
    """Two hashes of the row's text, null as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text), F.hash(text)]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = score_toxicity(docs, read_table(spark, sf_dir, "labels"), hashed=True)
    return without(docs, cut(scores.where("predicted = 1").select("doc_id", "h1", "h2")), docs["doc_id"].cast("long"), *text_id())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(docs)
    return cleaned.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
                            for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id")
    if not again.limit(1).count():
        classes = near_duplicates(docs)
        return without(docs, cut(classes.where("doc_id <> class_id").select("doc_id")), docs["doc_id"].cast("long"))
    # Ids that name no single row: the rows are numbered, equal rows of an id first become one.
    again = cut(again.where("doc_id is not null"))
    once = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(docs.columns)
    number, best = fresh(docs.columns, "_row"), fresh(docs.columns, "_best")
    rows = cut(without(docs, again, docs["doc_id"]).unionByName(once).withColumn(number, F.monotonically_increasing_id()))
    classes = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).toDF(number, "class_id")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(number).alias("row"))
    stays = (rows.select("doc_id", number).join(classes, number).groupBy("class_id").agg(F.min(order).alias("least"))
             .select(F.col("least.row").alias(best)))
    return rows.join(stays, F.col(number) == F.col(best), "left_semi").drop(number)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# A trained model and signatures: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows go through the checkpoint folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
