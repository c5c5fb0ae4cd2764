"""Vector similarity search: embed, normalise, exact top-k, approximate top-k.

Exact top-k (cosine = inner product of unit vectors), ties broken by id:

queries go in chunks of about ``max_broadcast_queries`` rows, each broadcast once,
past the corpus, which is only mapped: every Arrow batch of it is scored with
matrix products inside ``mapInPandas`` and gives an exact top-k per query, and a
``row_number() <= k`` window merges the lists (Catalyst adds a partial
WindowGroupLimit before its shuffle).  Neither side is exploded or shuffled; k rows
per query leave each batch.  Vectors that are searched more than once belong in
a persisted table (``vectorstore``), where bounds skip most cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_half_up
from ..functions.vectors import l2_norm, l2_normalize
from ..plans.session import reliable_checkpoint, ship_package

MAX_BROADCAST_QUERIES = 4096
CORPUS_BLOCK_ROWS = 200_000
# Most query x corpus scores held at once in one task (128 MB of float64).
MAX_SCORE_CELLS = 1 << 24
TOKEN_PATTERN = r"(?U)\b\w\w+\b"


# --- V1 / V2: embeddings ---------------------------------------------------------------

def text_embedder(num_features: int = 4096, input_col: str = "description") -> Pipeline:
    """Default encoder: lower-cased word tokens -> hashed TF -> IDF -> L2 norm."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=input_col, outputCol="_tokens", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit", p=2.0),
    ])


def embed_text(df: DataFrame, text_col: str = "description", out_col: str = "embedding",
               model=None, encoder=None, dim: int | None = None) -> tuple[DataFrame, object]:
    """Add a unit ``array<double>`` embedding of ``text_col`` (NULL text -> '').

    ``encoder`` (optional) is a function ``pd.Series[str] -> np.ndarray`` (e.g. a
    sentence-embedding model) applied batch-wise in a pandas UDF with output
    width ``dim``; otherwise the fitted (or given) ``text_embedder`` model is used.
    """
    src = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    if encoder is not None:
        if not dim:
            raise ValueError("dim is required with a custom encoder")

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def _enc(s: pd.Series) -> pd.Series:
            m = np.asarray(encoder(s), dtype=np.float64).reshape(len(s), dim)
            return pd.Series(list(m))

        return normalize_vectors(src.withColumn(out_col, _enc("_text")), out_col).drop("_text"), encoder
    if model is None:
        model = text_embedder(input_col="_text").fit(src)
    out = model.transform(src).withColumn(out_col, vector_to_array("_unit"))
    return out.drop("_text", "_tokens", "_tf", "_tfidf", "_unit"), model


def normalize_vectors(df: DataFrame, vec_col: str = "embedding", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or vec_col, l2_normalize(F.col(vec_col)))


def vector_status(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Index presence and vector count (and dimension)."""
    return df.agg(F.count(F.col(vec_col)).alias("vector_count"), F.max(F.size(vec_col)).alias("dim")).select(
        (F.col("vector_count") > 0).alias("exists"), "vector_count", "dim")


def label_centroids(df: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                    out_col: str = "embedding") -> DataFrame:
    """Unit mean vector per label (one aggregation, no explode)."""
    return (df.groupBy(label_col).agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
            .select(label_col, l2_normalize(vector_to_array("_m")).alias(out_col)))


# --- V3: exact top-k ---------------------------------------------------------------------

def _top_k_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(query row, corpus row) of the k best per query: score desc, id asc, ties exact."""
    out = []
    n = scores.shape[1]
    if ids.dtype == object:
        ids = ids.astype(str)
    for qi in range(scores.shape[0]):
        s = scores[qi]
        if n > k:
            kth = np.partition(s, n - k)[n - k]
            cand = np.nonzero(s >= kth)[0]
        else:
            cand = np.arange(n)
        order = np.lexsort((ids[cand], -s[cand]))[:k]
        out.extend((qi, int(c)) for c in cand[order])
    return out


def _score_frame(qids, qmat, pdf, k, id_col, vec_col, carry, qid_col, cells=MAX_SCORE_CELLS):
    """Exact local top-k of every query over the corpus rows in ``pdf``.

    The corpus rows are scored in slices so that at most ``MAX_SCORE_CELLS``
    scores exist at once (a 4 096-query chunk against a 200 000-row block would
    otherwise be a 6.5 GB matrix); the slices' lists are merged exactly.
    """
    if len(pdf) == 0 or len(qids) == 0:
        return None
    step = max(1, cells // len(qids))
    parts = [r for lo in range(0, len(pdf), step)
             if (r := _score_slice(qids, qmat, pdf.iloc[lo:lo + step], k, id_col, vec_col, carry, qid_col))
             is not None]
    if len(parts) <= 1:
        return parts[0] if parts else None
    res = pd.concat(parts, ignore_index=True)
    if res[id_col].dtype == object:
        res = res.assign(_sid=res[id_col].astype(str))
        order = ["_sid"]
    else:
        order = [id_col]
    res = res.sort_values([qid_col, "score", *order], ascending=[True, False, True], kind="mergesort")
    return res.groupby(qid_col, sort=False).head(k).drop(columns=["_sid"], errors="ignore")


def _score_slice(qids, qmat, pdf, k, id_col, vec_col, carry, qid_col):
    cmat = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
    # Scores are rounded at 1e-10 so equal vectors tie exactly whatever the
    # summation order of the matrix product; ties then go to the smaller id.
    scores = np.round(qmat @ cmat.T, 10)
    ids = pdf[id_col].to_numpy()
    pairs = _top_k_rows(scores, ids, k)
    if not pairs:
        return None
    qi = np.fromiter((p[0] for p in pairs), dtype=np.int64, count=len(pairs))
    ci = np.fromiter((p[1] for p in pairs), dtype=np.int64, count=len(pairs))
    res = pd.DataFrame({qid_col: np.asarray(qids)[qi], id_col: ids[ci], "score": scores[qi, ci]})
    for c in carry:
        res[c] = pdf[c].to_numpy()[ci]
    return res


def _scorer(queries, k, id_col, carry, cells, block_rows):
    """Scores the corpus batches of a task against one broadcast chunk of queries."""
    def score_partition(batches):
        ids, mat = queries.value
        for pdf in batches:
            res = _score_frame(ids, mat, pdf, k, id_col, "_cv", carry, "_qid", min(cells, block_rows * max(1, len(ids))))
            if res is not None:
                yield res
    return score_partition


def top_k_similar(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                  vec_col: str = "embedding", query_id_col: str = "query_id", query_vec_col: str = "embedding",
                  carry: list[str] | None = None, normalize: bool = True, score_digits: int | None = 4,
                  max_broadcast_queries: int = MAX_BROADCAST_QUERIES,
                  corpus_block_rows: int = CORPUS_BLOCK_ROWS, max_score_cells: int = MAX_SCORE_CELLS) -> DataFrame:
    """Exact top-k corpus rows per query by cosine similarity.

    Returns (query_id, rank, id, score, *carry); ``k`` is effectively capped by
    the corpus size (fewer rows when the corpus is smaller).
    """
    ship_package(corpus.sparkSession)
    carry = [c for c in (carry or []) if c != id_col]
    q = queries.select(F.col(query_id_col).alias("_qid"),
                       (l2_normalize(F.col(query_vec_col)) if normalize else F.col(query_vec_col)).alias("_qv"))
    c = corpus.select(id_col, *carry,
                      (l2_normalize(F.col(vec_col)) if normalize else F.col(vec_col)).alias("_cv"))
    schema = T.StructType([
        T.StructField("_qid", q.schema["_qid"].dataType),
        T.StructField(id_col, corpus.schema[id_col].dataType),
        T.StructField("score", T.DoubleType()),
        *[T.StructField(x, corpus.schema[x].dataType) for x in carry],
    ])
    # Computed once; counted and collected from the checkpoint.
    q = reliable_checkpoint(q.withColumn("_at", F.xxhash64("_qid")))
    chunks = max(1, -(-q.count() // max_broadcast_queries))
    partial = None
    for i in range(chunks):
        rows = q.where(F.pmod("_at", F.lit(chunks)) == i).collect()  # about max_broadcast_queries rows
        if not rows and partial is not None:
            continue
        bq = corpus.sparkSession.sparkContext.broadcast(
            ([r["_qid"] for r in rows], np.array([r["_qv"] for r in rows], dtype=np.float64)))
        part = c.mapInPandas(_scorer(bq, k, id_col, carry, max_score_cells, corpus_block_rows), schema)
        partial = part if partial is None else partial.unionByName(part)
    w = Window.partitionBy("_qid").orderBy(F.desc("score"), F.asc(id_col))
    ranked = partial.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
    score = round_half_up("score", score_digits) if score_digits is not None else F.col("score")
    return ranked.select(F.col("_qid").alias(query_id_col), "rank", id_col, score.alias("score"), *carry)


# --- V5: approximate top-k ------------------------------------------------------------------

def approx_top_k_similar(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                         vec_col: str = "embedding", query_id_col: str = "query_id",
                         query_vec_col: str = "embedding", tables: int = 16, bucket_rows: int = 32,
                         flips: int = 4, seed: int = 42) -> DataFrame:
    """Approximate top-k by random hyperplanes on unit vectors, exact cosines of the candidates.

    Each of ``tables`` tables codes a vector by the sides it lies on; the number
    of planes follows the corpus, so that a bucket holds about ``bucket_rows``
    vectors at any size.  A query looks into its own bucket and the ``flips``
    buckets behind its nearest planes.  Recall is below 1 by design (use
    :func:`top_k_similar` for exact answers).
    """
    ship_package(corpus.sparkSession)
    c = corpus.select(id_col, l2_normalize(F.col(vec_col)).alias("_cv")).where(F.size("_cv") > 0)
    q = queries.select(F.col(query_id_col).alias("_qid"), l2_normalize(F.col(query_vec_col)).alias("_qv"))
    size = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_cv")).alias("dim")).first()
    bits = max(1, min(30, round(np.log2(max(size["n"], 2) / bucket_rows))))
    planes = np.random.default_rng(seed).normal(size=(tables * bits, size["dim"] or 1))

    def codes(n_flips: int):
        @F.pandas_udf("array<long>")
        def of(vectors: pd.Series) -> pd.Series:
            side = np.stack(vectors.to_numpy()).astype(float) @ planes.T
            side = side.reshape(len(vectors), tables, bits)
            own = ((side >= 0) << np.arange(bits)).sum(axis=2)
            near = np.argsort(np.abs(side), axis=2)[:, :, :min(n_flips, bits)]
            every = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << near)], axis=2)
            return pd.Series(list((every + (np.arange(tables) << 32)[None, :, None]).reshape(len(vectors), -1)))
        return of

    held = c.select(id_col, F.explode(codes(0)("_cv")).alias("_bucket"))
    asked = q.select("_qid", F.explode(codes(flips)("_qv")).alias("_bucket"))
    pairs = asked.join(held, "_bucket").select("_qid", id_col).distinct()
    dot = F.aggregate(F.zip_with("_qv", "_cv", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    scored = pairs.join(q, "_qid").join(c, id_col).select("_qid", id_col, F.round(dot, 10).alias("score"))
    w = Window.partitionBy("_qid").orderBy(F.desc("score"), F.asc(id_col))
    return (scored.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
            .select(F.col("_qid").alias(query_id_col), "rank", id_col, round_half_up("score", 4).alias("score")))


def norms(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """Input norm and norm after normalisation (for checking V2)."""
    return df.select("*", l2_norm(F.col(vec_col)).alias("_n0"),
                     l2_norm(l2_normalize(F.col(vec_col))).alias("_n1"))
