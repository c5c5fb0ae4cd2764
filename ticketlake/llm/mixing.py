"""Mixing of sources to target weights, to the word.

Sources share the words of all documents by weight, but no source gives more
than ``EPOCHS`` times what it holds; what it cannot give is shared anew among
the others by weight.  With sources sorted by (most words / weight) the ones at
their cap are a prefix, so prefix sums of caps and weights find the water level
in one pass instead of a loop.

Within a source, documents get hash-random keys (md5 of a seed and the doc_id)
and are range-sorted by them; distributed prefix sums of their sizes tell every
document which words of its source lie before it, and the source's budget cuts
there exactly: whole epochs take every document once each, the rest takes the
documents before the cut and the first words of the one on it.  A hot source is
many ranges; only (source, key, doc_id, size) rows are shuffled, never texts.

Edge rows: null texts and texts without words have size 0 and are taken 0 times;
the null source is a source of its own, last in order; rows that repeat a doc_id
are documents of their own; a null doc_id has the key of ``NO_ID``; extra
columns are not read; an empty table gives no rows.  Equal seeds give equal mixes.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.session import ship_package, sized_broadcast
from .blocks import cut
from .ordered import running_sums

CYCLE = (1, 2, 3)
EPOCHS = 3
SEED = "mix"
NO_ID = "-"
WORD = r"[^\x20\x09-\x0D]+"
# Sources are broadcast up to this many, beyond it joined by shuffle.
SOURCES_BROADCAST = 100_000


def by_source() -> list[Column]:
    return [F.col("source").asc_nulls_last()]


def weigh_by_cycle(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Adds ``weight``: the cycle's numbers over the sources by code point, null last."""
    ranked = running_sums(sources, by_source(), {"rank": "1"})
    return ranked.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in cycle]),
                                                    (F.col("rank") % len(cycle) + 1).cast("int")).cast("long")).drop("rank")


def source_targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight) with ``target`` (double) and ``budget`` (whole words)."""
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(int(epochs)))
    ranked = running_sums(capped, [(F.col("cap") / F.col("weight")).asc(), *by_source()],
                          {"cap_before": "cap", "weight_before": "weight"})
    total = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = total["words"] or 0, total["weight"] or 0
    # The first source in this order that stays under its cap sets the level.
    left, per = F.lit(words) - F.col("cap_before"), F.lit(weight) - F.col("weight_before")
    wide = "decimal(38,0)"
    under = (F.col("weight").cast("decimal(18,0)") * left.cast("decimal(19,0)")).cast(wide) <= (
        F.col("cap").cast("decimal(19,0)") * per.cast("decimal(18,0)")).cast(wide)
    level = ranked.where(under).agg(F.min(F.struct(F.col("weight_before").alias("b"), left.alias("left"), per.alias("per"))).alias("l")).first()["l"]
    if level is None:  # no sources
        return ranked.select("source", "source_size", "weight", F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("budget"))
    share = F.col("weight") * F.lit(level["left"])
    free = F.col("weight_before") >= level["b"]
    return ranked.select(
        "source", "source_size", "weight",
        F.when(free, share.cast("double") / F.lit(float(level["per"]))).otherwise(F.col("cap").cast("double")).alias("target"),
        F.when(free, F.floor(share / F.lit(level["per"])) if words >= 1 << 50 else F.expr(f"(weight * {level['left']}L) div {level['per']}L"))
        .otherwise(F.col("cap")).cast("long").alias("budget"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, text_hash, size, source, source_size, weight, target,
    budget, whole (times the document is taken whole), part (first words taken once more), taken.

    ``weights`` (source, weight; whole numbers of 1 or more) names each source's
    weight, else the sources' order gives them by ``CYCLE``; a source without a
    weight there has weight 1.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NO_ID))))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = weigh_by_cycle(sources)
    else:
        named = weights.select(F.col("source").cast("string").alias("named"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select(
            "source", "source_size", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    targets = running_sums(source_targets(sources, epochs), by_source(), {"words_before": "source_size"})
    targets = targets.withColumnRenamed("source", "of").select(
        "*", F.expr("if(source_size = 0, 0, budget div source_size)").alias("whole"),
        F.expr("if(source_size = 0, 0, budget % source_size)").alias("rest"))

    placed = running_sums(rows, [*by_source(), F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_hash")], {"before": "size"})
    both = placed.join(sized_broadcast(targets, SOURCES_BROADCAST), F.col("source").eqNullSafe(F.col("of")))
    room = F.col("rest") - (F.col("before") - F.col("words_before"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), room))
    return both.select("doc_id", "text_hash", "size", "source", "source_size", "weight", "target", "budget",
                       F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long").alias("whole"),
                       part.cast("long").alias("part"),
                       (F.col("size") * F.col("whole") + part).cast("long").alias("taken"))


@F.pandas_udf(T.StringType())
def first_words(texts: pd.Series, n: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word."""
    def head(text, n):
        end = 0
        for i, m in enumerate(re.finditer(WORD, text), 1):
            end = m.end()
            if i >= n:
                break
        return text[:end]
    return pd.Series([head(t, k) for t, k in zip(texts, n, strict=True)])


def mixed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: (doc_id, source, epoch, words, text), one row per copy, epochs from 0.

    A last, partial copy is the document's first words.  Texts are shuffled once,
    on (doc_id, text_hash); equal rows of a document are told apart by their copies only.
    """
    ship_package(docs.sparkSession)
    copies = plan.select("doc_id", "text_hash", "source", "size", F.posexplode(F.concat(
        F.array_repeat(F.col("size"), F.col("whole").cast("int")),
        F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))).alias("epoch", "words"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = (docs.select(F.col("doc_id").cast("long").alias("of"), F.xxhash64(text).alias("hash"), text.alias("text"))
             .groupBy("of", "hash").agg(F.first("text").alias("text")))
    both = copies.join(texts, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash")))
    whole = both.where("words = size").select("doc_id", "source", "epoch", "words", "text")
    cut_off = both.where("words < size").select("doc_id", "source", "epoch", "words", first_words("text", "words").alias("text"))
    return whole.unionByName(cut_off)


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of doc_id, size, source_size, target, taken."""
    return f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '{NO_ID}')) AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM {table}),
s AS (
  SELECT source, source_size, source_size * {EPOCHS} AS cap,
         [{', '.join(map(str, CYCLE))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(CYCLE)}] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
p AS (
  SELECT *, row_number() OVER o AS nth, sum(cap) OVER o - cap AS cap_before, sum(weight) OVER o - weight AS weight_before,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM s WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT nth AS from_nth, CAST(words - cap_before AS BIGINT) AS words_left, CAST(weights - weight_before AS BIGINT) AS per
  FROM p WHERE weight * (words - cap_before) <= cap * (weights - weight_before) ORDER BY nth LIMIT 1),
t AS (
  SELECT source, source_size,
    CASE WHEN nth >= from_nth THEN CAST(weight * words_left AS DOUBLE) / per ELSE CAST(cap AS DOUBLE) END AS target,
    CASE WHEN nth >= from_nth THEN (weight * words_left) // per ELSE cap END AS budget
  FROM p, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0 ELSE budget // t.source_size END AS whole,
    CASE WHEN t.source_size = 0 THEN 0 ELSE budget % t.source_size END AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * whole + least(size, greatest(0, rest - before)) AS BIGINT) AS taken FROM r"""
