"""Exact top-k text retrieval on sparse TF-IDF weights, as joins of term postings.

Scores are cosines of TF-IDF vectors over the whole vocabulary of the corpus;
no term is left out.  A term's postings lie in ``BLOCKS`` blocks by their share of
the term's largest weight.  Blocks keep frequent terms from pairing every query with
every text, and lose nothing:

1. Every term's heaviest blocks, about ``HEAD`` postings, are added up first, and the
   most promising texts scored in full: the k-th best is a lower bound t.
2. A term can add at most U = query weight x largest weight, and several no more than
   the length of the query's part.  Going from rare to frequent, terms that together
   stay under a share of t are left out; let R be what they can add.  Of
   the others, blocks are skipped while all that is unread stays under a share
   x of t, (x t - R) / sum(U) of each term's largest weight.  Which terms and what
   share, ``CHOICES``, is decided per query by the sizes of the blocks.
3. The postings of the remaining blocks are added up per text.  What its unread
   postings can add is bounded term by term, and by the lengths of what is left of
   query and text; texts that cannot reach t go, the others are scored in full.

Postings are kept of the queries' terms, one row a text in files bucketed by the text's
key (:func:`keep_postings`), so that what is added up per text is not shuffled.  The
lengths of the texts' vectors are over all their terms.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ensure_checkpoint_dir, reliable_checkpoint, sized_broadcast

WORDS = r"(?U)\b\w\w+\b"
BLOCKS = 64
HEAD = 1000
# Times k texts of the head that are scored in full for the lower bound.
TRIED = 10
# Ways to read: the share of the lower bound that terms left out altogether may add up to,
# and that everything unread may.
CHOICES = ((1.0, 1.0), (0.0, 1.0), (0.5, 0.5), (0.0, 0.5), (0.25, 0.25), (0.0, 0.25), (0.0, 0.0))
# Most terms whose idf every task holds; the texts' other terms meet theirs in a join by shuffle.
COMMON_TERMS = 65_536
# Rows of the queries' side up to which it is broadcast.
SMALL_SIDE = 1_000_000
# Bounds give way by more than rounding.
SLACK = 1e-9


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): lower-cased words of two or more characters."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0))
    return (texts.select(F.col(key).alias("key"), F.explode(words).alias("term"))
            .groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf")))


def unit_weights(counts: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, term, w): tf * idf over the length of the key's vector; terms without idf drop out."""
    raw = counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def smooth_idf(corpus: DataFrame, text: str) -> DataFrame:
    """(term, idf) with ln((1 + n) / (1 + df)) + 1 over all rows of the corpus, equal texts counted each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORDS), F.lit(0)))
    df = corpus.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = corpus.agg(F.count(F.lit(1)).alias("n_rows"))
    return df.crossJoin(F.broadcast(rows)).select(  # one row
        "term", (F.log((F.lit(1.0) + F.col("n_rows")) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))


def posting_blocks(postings: DataFrame) -> DataFrame:
    """(term, key, w) with the term's ``most`` weight and the posting's ``block``, BLOCKS for the heaviest."""
    most = sized_broadcast(reliable_checkpoint(postings.groupBy("term").agg(F.max("w").alias("most"))), SMALL_SIDE)
    return postings.join(most, "term").withColumn("block", F.floor(F.lit(float(BLOCKS)) * F.col("w") / F.col("most")).cast("int"))


def block_sizes(blocked: DataFrame) -> DataFrame:
    """(term, block, n, above, held, most): postings of the block, of heavier ones, and of the term."""
    by_weight = Window.partitionBy("term").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most"))
    return sizes.select("term", "block", "n", "most", F.coalesce(F.sum("n").over(by_weight), F.lit(0)).alias("above"),
                        F.sum("n").over(Window.partitionBy("term")).alias("held"))


def candidate_pairs(q: DataFrame, blocked: DataFrame, k: int, head: int = HEAD) -> DataFrame:
    """(q, key): every text that can be among a query's k best, by the bounds above.

    q: (q, term, wq); blocked: postings with blocks.
    """
    sizes = reliable_checkpoint(block_sizes(blocked))
    heavy = sized_broadcast(sizes.where(F.col("above") < head).select("term", "block"), SMALL_SIDE)
    partial = (blocked.join(heavy, ["term", "block"]).join(sized_broadcast(q, SMALL_SIDE), "term")
               .groupBy("q", "key").agg(F.sum(F.col("wq") * F.col("w")).alias("score")))
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    # The most promising of them are scored in full.
    tried = reliable_checkpoint(partial.withColumn("n", F.row_number().over(best)).where(F.col("n") <= TRIED * k).select("q", "key"))
    exact = (blocked.select("key", "term", "w").join(sized_broadcast(tried.join(q, "q"), SMALL_SIDE), ["key", "term"])
             .groupBy("q", "key").agg(F.sum(F.col("wq") * F.col("w")).alias("score")))
    at_least = (exact.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)
                .groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("t")).where(F.col("n") == k).select("q", "t"))

    def together(window, which):
        """The most that some terms can add to a score; a text's vector has length one, so no more than the length of the query's part."""
        return F.least(F.sum(F.when(which, F.col("u")).otherwise(0.0)).over(window),
                       F.sqrt(F.sum(F.when(which, F.col("wq") * F.col("wq")).otherwise(0.0)).over(window)))

    about = sizes.groupBy("term").agg(F.max("held").alias("held"), F.max("most").alias("most"))
    rare_first, all_terms = Window.partitionBy("q").orderBy("held", "term"), Window.partitionBy("q")
    u = (q.join(about, "term").withColumn("u", F.col("wq") * F.col("most")).join(at_least, "q", "left")
         .withColumn("t", F.coalesce("t", F.lit(0.0)) - SLACK)
         .withColumn("could", together(rare_first.rowsBetween(Window.currentRow, Window.unboundedFollowing), F.lit(True))))
    u = u.withColumn("n_terms", F.count(F.lit(1)).over(all_terms))
    # Per choice, the first block that is read of a term; NULL for a term that is not read at all.
    for i, (left_out, unread) in enumerate(CHOICES):
        needed = F.col("could") >= F.col("t") * left_out
        left = F.col("t") * unread - together(all_terms, ~needed)
        share = left / F.sum(F.when(needed, F.col("u"))).over(all_terms)
        first = F.greatest(F.lit(0), F.floor(F.lit(float(BLOCKS)) * (share - SLACK))).cast("int")
        u = u.withColumn(f"b{i}", F.when(needed, first))
    picked = reliable_checkpoint(u)

    # The cheapest choice by the sizes of its blocks: postings read, and texts scored in full for what stays unread.
    reads = [F.sum(F.when(F.col("block") >= F.col(f"b{i}"), F.col("n")).otherwise(0)) * (1 + F.max("n_terms") * unread * unread)
             for i, (_, unread) in enumerate(CHOICES)]
    cost = picked.join(sizes.select("term", "block", "n"), "term").groupBy("q").agg(
        F.array_position(F.array(*reads), F.array_min(F.array(*reads))).cast("int").alias("choice"))
    plan = picked.join(cost, "q").withColumn("from_block", F.element_at(F.array(*[F.col(f"b{i}") for i in range(len(CHOICES))]), F.col("choice")))
    # What a posting that is not read can still add: it lies below the first block that is.
    plan = plan.withColumn("unread", F.col("u") * F.least(F.lit(1.0), F.coalesce(F.col("from_block") / float(BLOCKS), F.lit(1.0))))
    totals = plan.groupBy("q").agg(F.sum("unread").alias("all_unread"), F.sum(F.col("wq") * F.col("wq")).alias("all_q2"), F.max("t").alias("t"))
    wanted = (plan.where("from_block IS NOT NULL").join(sizes.select("term", "block"), "term").where("block >= from_block")
              .select("q", "term", "block", "wq", "unread"))
    seen = (blocked.select("term", "block", "key", "w").join(sized_broadcast(wanted, SMALL_SIDE), ["term", "block"]).groupBy("q", "key").agg(
        F.sum(F.col("wq") * F.col("w")).alias("known"), F.sum("unread").alias("less"),
        F.sum(F.col("wq") * F.col("wq")).alias("q2"), F.sum(F.col("w") * F.col("w")).alias("w2")))
    rest = F.least(F.col("all_unread") - F.col("less"), F.sqrt(F.greatest(F.lit(0.0), F.col("all_q2") - F.col("q2")))
                   * F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("w2"))))
    return seen.join(sized_broadcast(totals, SMALL_SIDE), "q").where(F.col("known") + rest >= F.col("t") - SLACK).select("q", "key")


def written(df: DataFrame, kind: str, key: str | None = None) -> DataFrame:
    """df from columnar files in the shared checkpoint folder; with ``key`` in a bucket for each shuffle partition."""
    spark = df.sparkSession
    tag = f"{kind}_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}"
    if key is None:
        df.write.parquet(path)
        return spark.read.parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(tag)
    return spark.table(tag)


def keep_postings(q: DataFrame, corpus: DataFrame, idf: DataFrame) -> DataFrame:
    """(key, term, w) of the queries' terms, w as of :func:`unit_weights`, from a table of one row a text.

    idf: written.  One pass over the texts: the idf of the most frequent terms is at hand, so
    that only the rare ones are shuffled for the lengths.
    """
    common = F.broadcast(idf.orderBy("idf", "term").limit(COMMON_TERMS))  # bounded by COMMON_TERMS
    asked = sized_broadcast(q.select("term").distinct().withColumn("asked", F.lit(True)), SMALL_SIDE)
    counts = term_counts(corpus.repartition(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key"), "key", "text")
    one = F.struct("term", "tf")
    texts = written(counts.join(common, "term", "left").join(asked, "term", "left").groupBy("key").agg(
        F.coalesce(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")), F.lit(0.0)).alias("common2"),
        F.collect_list(F.when(F.col("asked"), one)).alias("held"),
        F.collect_list(F.when(F.col("idf").isNull(), one)).alias("rare")), "texts", "key")
    rare = (texts.select("key", F.inline("rare")).join(idf, "term").groupBy("key")
            .agg(F.sum(F.col("tf") * F.col("idf") * F.col("tf") * F.col("idf")).alias("rare2")))
    sized = texts.select("key", "common2", "held").where(F.size("held") > 0).join(rare, "key", "left").select(
        "key", F.sqrt(F.col("common2") + F.coalesce("rare2", F.lit(0.0))).alias("norm"), "held")
    kept = written(sized, "postings", "key").select("key", "norm", F.inline("held"))
    weight = sized_broadcast(reliable_checkpoint(idf.join(asked.select("term"), "term", "left_semi")), SMALL_SIDE)
    return kept.join(weight, "term").select("key", "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("w"))


def top_k_texts(queries: DataFrame, corpus: DataFrame, idf: DataFrame, k: int, head: int = HEAD) -> DataFrame:
    """(query_key, key, score): the k best texts of positive score per query, ties to the least ``first_id``.

    queries: (key, text); corpus: (key, text, first_id), one row per key.
    """
    idf = written(idf, "idf")
    q = reliable_checkpoint(unit_weights(term_counts(queries, "key", "text"), idf).withColumnsRenamed({"key": "q", "w": "wq"}))
    c = posting_blocks(keep_postings(q, corpus, idf))
    candidates = reliable_checkpoint(candidate_pairs(q, c, k, head))
    # Of the texts that are candidates, the postings are few.
    few = c.select("key", "term", "w").join(sized_broadcast(candidates.select("key").distinct(), SMALL_SIDE), "key", "left_semi")
    scored = (few.join(candidates, "key").join(sized_broadcast(q, SMALL_SIDE), ["q", "term"]).groupBy("q", "key")
              .agg(F.round(F.sum(F.col("wq") * F.col("w")), 10).alias("score")))
    ranked = scored.join(corpus.select("key", "first_id"), "key").withColumn(
        "n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "first_id")))
    return ranked.where(F.col("n") <= k).select(F.col("q").alias("query_key"), "key", "score")
