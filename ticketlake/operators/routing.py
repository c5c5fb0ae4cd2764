"""Text routing: TF-IDF + multinomial logistic regression on Spark ML.

Steps: training frame (R1) -> stratified 80/20 split (R2) -> tokens (R3) ->
TF-IDF with sklearn-style smooth idf ``ln((1+n)/(1+df)) + 1`` and L2 norm (R4)
-> logistic regression (R5) -> metrics (R6, R7) -> predictions (R8).
"""

from __future__ import annotations

import datetime as _dt
import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.session import reliable_checkpoint, sized_broadcast
from .columns import normalize_columns

TOKEN_PATTERN = r"(?U)\b\w\w+\b"
MAX_FEATURES = 5000
SPLIT_BUCKET_HEX = 4          # 16^4 hash buckets per class for the split
MAX_TEAMS_BROADCAST = 100_000


class RoutingDataError(ValueError):
    pass


def training_frame(df: DataFrame, min_classes: int = 2) -> DataFrame:
    """description NULL -> '', assigned_team NULL -> 'Unassigned'; requires
    both columns and at least ``min_classes`` distinct teams."""
    df = normalize_columns(df)
    missing = sorted({"description", "assigned_team"} - set(df.columns))
    if missing:
        raise RoutingDataError(
            f"routing needs a text and a team column; not found: {', '.join(missing)}")
    keep = [c for c in ("ticket_id",) if c in df.columns]
    out = df.select(*keep, F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description"),
                    F.coalesce(F.col("assigned_team").cast("string"), F.lit("Unassigned")).alias("assigned_team"))
    n_classes = out.select("assigned_team").distinct().limit(min_classes).count()
    if n_classes < min_classes:
        raise RoutingDataError(f"routing needs tickets of at least {min_classes} teams, found {n_classes}")
    return out


def class_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("assigned_team").agg(F.count(F.lit(1)).alias("n")).orderBy("assigned_team")


def stratified_split(df: DataFrame, test_fraction: float = 0.2, seed: int = 42, id_col: str = "ticket_id",
                     label_col: str = "assigned_team") -> DataFrame:
    """Add ``is_test``: per class, the ceil(fraction * n) rows with the smallest
    md5('{seed}:' || id) (ties by id) are the test set.

    Skew-safe: rows are bucketed by the first hex digits of the hash; per
    (class, bucket) counts locate each class's boundary bucket, and only that
    bucket is ranked with a window, so no task holds a whole class.  The hash and id
    at the cut, one row per class, then decide every row in one pass.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    narrow = df.select(F.col(label_col).alias("_label"), F.col(id_col).cast("string").alias("_id"), h.alias("_h")).withColumn(
        "_b", F.substring("_h", 1, SPLIT_BUCKET_HEX))
    counts = narrow.groupBy("_label", "_b").agg(F.count(F.lit(1)).alias("_n"))
    cw = Window.partitionBy("_label").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = (counts.withColumn("_cum", F.sum("_n").over(cw))
           .withColumn("_k", F.ceil(F.sum("_n").over(Window.partitionBy("_label")) * F.lit(float(test_fraction))).cast("bigint"))
           .withColumn("_before", F.col("_cum") - F.col("_n")))
    # One row per class: the bucket its cut lies in, then the cut itself.
    boundary = reliable_checkpoint(cum.filter((F.col("_before") < F.col("_k")) & (F.col("_cum") >= F.col("_k"))).select(
        "_label", F.col("_b"), (F.col("_k") - F.col("_before")).alias("_need")))
    inside = narrow.join(sized_broadcast(boundary, MAX_TEAMS_BROADCAST), ["_label", "_b"])
    rw = Window.partitionBy("_label").orderBy("_h", "_id")
    cut = reliable_checkpoint(inside.withColumn("_r", F.row_number().over(rw)).filter(F.col("_r") == F.col("_need")).select(
        F.col("_label").alias("_of"), F.struct("_h", "_id").alias("_cut")))
    own = F.struct(h.alias("_h"), F.col(id_col).cast("string").alias("_id"))
    return (df.join(sized_broadcast(cut, MAX_TEAMS_BROADCAST), F.col(label_col).eqNullSafe(F.col("_of")), "left")
            .withColumn("is_test", F.coalesce(own <= F.col("_cut"), F.lit(False))).drop("_of", "_cut"))


def tokenizer(input_col: str = "description", output_col: str = "tokens") -> RegexTokenizer:
    return RegexTokenizer(inputCol=input_col, outputCol=output_col, pattern=TOKEN_PATTERN, gaps=False,
                          toLowercase=True)


@dataclass
class RoutingModel:
    pipeline: PipelineModel      # tokens -> tf -> tf-idf -> unit -> label index -> lr
    labels: list[str]
    vocabulary: list[str]
    idf: np.ndarray              # smooth idf (+1) per vocabulary term

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "RoutingModel":
        pm = PipelineModel.load(path)
        cv = pm.stages[1]
        ew = pm.stages[2]
        labels = list(pm.stages[4].labels)
        return RoutingModel(pm, labels, list(cv.vocabulary), np.asarray(ew.getScalingVec().toArray()))


def term_stats(train: DataFrame, text_col: str = "description", weight_col: str | None = None) -> DataFrame:
    """(term, total count, doc_freq) in one scan and one aggregation: each
    document emits (term, w, 0) per token and (term, 0, w) per distinct token,
    w = the row's weight (its multiplicity when rows were grouped) or 1."""
    w = F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint")
    toks = tokenizer(text_col, "_tok").transform(train.select(text_col, w.alias("_w")))

    def item(t, c, d):
        return F.struct(t.alias("term"), c.alias("c"), d.alias("d"))

    zero = F.lit(0).cast("bigint")
    items = F.concat(F.transform("_tok", lambda t: item(t, F.col("_w"), zero)),
                     F.transform(F.array_distinct("_tok"), lambda t: item(t, zero, F.col("_w"))))
    return (toks.select(F.inline(items)).groupBy("term")
            .agg(F.sum("c").alias("total"), F.sum("d").alias("doc_freq")))


def token_counts(train: DataFrame) -> DataFrame:
    """(term, count, doc_freq) over the training text."""
    return term_stats(train).select("term", F.col("total").alias("count"), "doc_freq")


def fit_tfidf(train: DataFrame, max_features: int = MAX_FEATURES, text_col: str = "description",
              weight_col: str | None = None):
    """Vocabulary = the ``max_features`` most frequent terms (ties by term) and
    smooth idf ``ln((1+n)/(1+df)) + 1``, from one aggregation; returns
    (tokenizer, CountVectorizerModel, idf vector).  With ``weight_col`` each row
    stands for that many identical documents."""
    stats = term_stats(train, text_col, weight_col)
    if weight_col:
        n_docs = train.agg(F.sum(weight_col)).first()[0] or 0
    else:
        n_docs = train.count()
    top = stats.orderBy(F.desc("total"), "term").limit(max_features).collect()  # bounded by max_features
    vocab = [r["term"] for r in top]
    scaling = np.array([math.log((1.0 + n_docs) / (1.0 + r["doc_freq"])) + 1.0 for r in top], dtype=np.float64)
    cv = CountVectorizerModel.from_vocabulary(vocab, inputCol="tokens", outputCol="tf")
    return tokenizer(text_col), cv, scaling


def fit_routing(train: DataFrame, c: float = 1.0, max_iter: int = 1000, max_features: int = MAX_FEATURES,
                tfidf_on: DataFrame | None = None) -> RoutingModel:
    """Fit the full pipeline on ``train``; the TF-IDF vocabulary/idf is fitted on
    ``tfidf_on`` when given (the reference fits it on all rows before the split).

    Equal (text, team) rows have equal features, so training runs on the
    distinct pairs weighted by their count (one shuffle, then small data).  The
    weighted loss divided by the weight sum is the objective on the repeated
    rows, and weighted term counts give the same vocabulary and idf.
    """
    # Reliable checkpoint: cuts lineage before the iterations.
    grouped = reliable_checkpoint(train.groupBy("description", "assigned_team")
                                  .agg(F.count(F.lit(1)).cast("double").alias("weight")))
    if tfidf_on is not None:
        tok, cv, scaling = fit_tfidf(tfidf_on, max_features)
    else:
        tok, cv, scaling = fit_tfidf(grouped, max_features, weight_col="weight")
    ew = ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense(scaling.tolist()))
    norm = Normalizer(inputCol="tfidf", outputCol="features", p=2.0)
    indexer = StringIndexer(inputCol="assigned_team", outputCol="label", stringOrderType="alphabetAsc",
                            handleInvalid="error")
    pre = PipelineModel(stages=[tok, cv, ew, norm]).transform(grouped)
    idx_model = indexer.fit(pre)
    feats = idx_model.transform(pre).select("features", "label", "weight").persist()
    n = grouped.agg(F.sum("weight")).first()[0] or 0.0
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", family="multinomial",
                            maxIter=max_iter, regParam=1.0 / (c * max(n, 1.0)), elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=1e-6)
    lr_model = lr.fit(feats)
    feats.unpersist()
    pm = PipelineModel(stages=[tok, cv, ew, norm, idx_model, lr_model])
    return RoutingModel(pm, list(idx_model.labels), list(cv.vocabulary), scaling)


def certificate(model: RoutingModel, train: DataFrame, c: float = 1.0) -> DataFrame:
    """(team, n_terms, max_gradient) of the penalised training loss at the model's coefficients.

    The loss is strictly convex, so a gradient of zero proves the optimum.  The
    features, probabilities and gradient are recomputed from the texts by joins
    and aggregations, apart from the pipeline that was fitted: with x the unit TF-IDF
    weights, d(loss)/d(b_kj) = sum w (p_k - [y = k]) x_j / sum w + b_kj / (c n),
    and without the penalty for an intercept (a term of weight one in every text).
    """
    spark = train.sparkSession
    lr = model.pipeline.stages[5]
    coef, bias = lr.coefficientMatrix.toArray(), lr.interceptVector.toArray()
    teams = model.labels
    # Model parameters: teams times the bounded vocabulary.
    betas = spark.createDataFrame([(team, term, float(coef[i, j])) for i, team in enumerate(teams) for j, term in enumerate(model.vocabulary)]
                                  + [(team, None, float(bias[i])) for i, team in enumerate(teams)], "team string, term string, beta double")
    idf = spark.createDataFrame([(t, float(w)) for t, w in zip(model.vocabulary, model.idf, strict=True)], "term string, idf double")
    docs = reliable_checkpoint(train.groupBy("description", "assigned_team").agg(F.count(F.lit(1)).cast("double").alias("w"))
                               .withColumn("doc", F.monotonically_increasing_id()))
    n = docs.agg(F.sum("w")).first()[0] or 0.0
    words = F.regexp_extract_all(F.lower("description"), F.lit(TOKEN_PATTERN), F.lit(0))
    tf = docs.select("doc", F.explode(words).alias("term")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = tf.join(F.broadcast(idf), "term").withColumn("x", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    x = raw.join(norms, "doc").select("doc", "term", (F.col("x") / F.col("norm")).alias("x"))
    x = reliable_checkpoint(x.unionByName(docs.select("doc", F.lit(None).cast("string").alias("term"), F.lit(1.0).alias("x"))))
    b = betas.withColumnRenamed("term", "of")
    z = x.join(F.broadcast(b), F.col("term").eqNullSafe(F.col("of"))).groupBy("doc", "team").agg(F.sum(F.col("x") * F.col("beta")).alias("z"))
    by_doc = Window.partitionBy("doc")
    p = z.withColumn("e", F.exp(F.col("z") - F.max("z").over(by_doc))).withColumn("p", F.col("e") / F.sum("e").over(by_doc))
    residual = p.join(docs, "doc").select("doc", "team", (F.col("w") * (F.col("p") - (F.col("team") == F.col("assigned_team")).cast("int"))).alias("r"))
    sums = x.join(residual, "doc").groupBy("team", "term").agg((F.sum(F.col("r") * F.col("x")) / F.lit(max(n, 1.0))).alias("g"))
    penalty = F.when(F.col("of").isNull(), F.lit(0.0)).otherwise(F.col("beta") / F.lit(c * max(n, 1.0)))
    sums = sums.withColumnsRenamed({"team": "at"})
    full = b.join(sums, (F.col("team") == F.col("at")) & F.col("of").eqNullSafe(F.col("term")), "left")
    return full.groupBy("team").agg(F.count("of").alias("n_terms"), F.max(F.abs(F.coalesce("g", F.lit(0.0)) + penalty)).alias("max_gradient"))


def predict(model: RoutingModel, df: DataFrame, text_col: str = "description") -> DataFrame:
    """Best team, its probability, and all team scores for every row."""
    src = df.withColumn("description", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    if "assigned_team" not in src.columns:
        src = src.withColumn("assigned_team", F.lit(None).cast("string"))
    pre = PipelineModel(stages=model.pipeline.stages[:4]).transform(src)
    lr = model.pipeline.stages[5]
    out = lr.transform(pre)
    probs = vector_to_array("probability")
    labels = F.array(*[F.lit(x) for x in model.labels])
    best = F.array_position(probs, F.array_max(probs)).cast("int")
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.element_at(labels, best).alias("predicted_team"),
        F.array_max(probs).alias("confidence"),
        F.map_from_arrays(labels, probs).alias("team_scores"),
    )


def ranked_scores(team_scores):
    """The entries of a team -> score map, best score first, ties by team."""
    entries = F.transform(F.map_entries(team_scores), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["k"].alias("key"), (-e["s"]).alias("value")))


def feature_importance(model: RoutingModel, spark: SparkSession, top: int = 30) -> DataFrame:
    """Sum over classes of |coefficient| per vocabulary term, top ``top``."""
    coef = model.pipeline.stages[5].coefficientMatrix.toArray()
    imp = np.abs(coef).sum(axis=0)
    rows = [(w, float(v)) for w, v in zip(model.vocabulary, imp)]
    return (spark.createDataFrame(rows, "word string, importance double")
            .orderBy(F.desc("importance"), "word").limit(top))


def evaluate(model: RoutingModel, test: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accuracy row, confusion long form (actual, predicted, n), recall per team)."""
    pred = predict(model, test).select(F.col("assigned_team").alias("actual"),
                                       F.col("predicted_team").alias("predicted"))
    acc = pred.agg(F.count(F.lit(1)).alias("n_test"),
                   F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    cm = pred.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")).orderBy("actual", "predicted")
    recall = pred.groupBy(F.col("actual").alias("team")).agg(
        F.count(F.lit(1)).alias("support"),
        (F.lit(100.0) * F.count_if(F.col("actual") == F.col("predicted"))
         / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall_pct")).orderBy("team")
    return acc, cm, recall


def confusion_matrix(cm_long: DataFrame, labels: list[str]) -> DataFrame:
    """Rows = actual, one column per predicted label (0 when absent)."""
    return (cm_long.groupBy("actual").pivot("predicted", labels).agg(F.first("n"))
            .na.fill(0, subset=labels).orderBy("actual"))


@dataclass
class TrainResult:
    model: RoutingModel | None
    summary: DataFrame
    accuracy: DataFrame | None = None
    confusion: DataFrame | None = None
    importance: DataFrame | None = None
    recall: DataFrame | None = None
    labels: list[str] | None = None
    vectors: object | None = None      # vectorstore.VectorTable of the tickets' texts


def train_routing(spark: SparkSession, dataset: DataFrame, out_dir: str | None = None,
                  fit_tfidf_on_all: bool = False, fit_final: bool = True, trained_at: str | None = None,
                  vectors_name: str | None = None, name: str | None = None, source: str | None = None,
                  snapshot: str | None = None) -> TrainResult:
    """Train job: routing model (when a team column exists) with hold-out
    metrics, then the production model on all rows; artifacts under out_dir.
    ``fit_final=False`` stops at the metrics.  With ``vectors_name`` and out_dir, the
    tickets' text vectors are stored as that table and the summary has their
    ``vector_count``; a dataset without a team column is still indexed."""
    result = _train(spark, dataset, out_dir, fit_tfidf_on_all, fit_final, trained_at, name, source, snapshot)
    if vectors_name and out_dir:
        result.vectors = index_tickets(normalize_columns(dataset), vectors_name, f"{out_dir.rstrip('/')}/vectors")
        result.summary = result.summary.withColumn("vector_count", F.lit(result.vectors.rows).cast("long"))
    return result


# Ticket columns that a search result shows beside the text.
VECTOR_COLUMNS = ("description", "assigned_team", "component", "severity", "status_line")


def index_tickets(tickets: DataFrame, table_name: str, path: str, id_col: str = "ticket_id"):
    """Text vectors of all tickets as a persisted table with the ticket columns."""
    from .textvec import encode_texts, fit_encoder
    from .vectorstore import write_vectors
    if id_col not in tickets.columns:
        from .columns import with_row_index
        tickets = with_row_index(tickets, id_col)
    carry = [c for c in VECTOR_COLUMNS if c in tickets.columns]
    texts = tickets.groupBy(F.coalesce(F.col("description").cast("string"), F.lit("")).alias("description")).agg(F.count(F.lit(1)).alias("weight"))
    encoder = fit_encoder(reliable_checkpoint(texts), weight_col="weight")
    return write_vectors(tickets.select(id_col, *carry), table_name, path, id_col=id_col, carry=carry,
                         encode=lambda rows: encode_texts(rows, encoder))


def _train(spark, dataset, out_dir, fit_tfidf_on_all, fit_final, trained_at, name, source, snapshot) -> TrainResult:
    norm = normalize_columns(dataset)
    trained_at = trained_at or _dt.datetime.now(tz=_dt.timezone.utc).replace(tzinfo=None).isoformat()
    if "assigned_team" not in norm.columns:
        summary = norm.agg(F.count(F.lit(1)).alias("row_count")).select(
            "row_count", F.lit(False).alias("routing_trained"), F.lit(None).cast("double").alias("accuracy"),
            F.lit(0).alias("classes"), F.lit(trained_at).alias("trained_at_utc"))
        return TrainResult(None, summary)
    data = training_frame(norm)
    if "ticket_id" not in data.columns:
        from .columns import with_row_index
        data = with_row_index(data, "ticket_id")
    split = reliable_checkpoint(stratified_split(data))
    train, test = split.filter(~F.col("is_test")), split.filter(F.col("is_test"))
    eval_model = fit_routing(train, tfidf_on=split if fit_tfidf_on_all else None)
    acc, cm, recall = evaluate(eval_model, test)
    imp = feature_importance(eval_model, spark)
    final = fit_routing(split) if fit_final else None
    if out_dir and final:
        save_artifacts(spark, final, out_dir, dataset, acc, cm, imp, trained_at, name, source, snapshot)
    summary = acc.select(
        F.lit(split.count()).alias("row_count"), F.lit(True).alias("routing_trained"),
        F.col("accuracy"), F.lit(len(eval_model.labels)).alias("classes"), F.lit(trained_at).alias("trained_at_utc"))
    return TrainResult(final, summary, acc, cm, imp, recall, eval_model.labels)


def training_part(dataset: DataFrame) -> Column:
    """What a training's lineage is told apart by: the month of creation, where the dataset has one."""
    for c in ("creation_date", "created_date"):
        if c in dataset.columns:
            return F.substring(F.col(c).cast("string"), 1, 7)
    return F.lit("all")


def save_artifacts(spark: SparkSession, model: RoutingModel, out_dir: str, dataset: DataFrame,
                   acc: DataFrame, cm: DataFrame, imp: DataFrame, trained_at: str, name: str | None = None,
                   source: str | None = None, snapshot: str | None = None) -> None:
    """Model folder, performance record (accuracy, classes, confusion, top
    features) and the training's lineage with the dataset's fingerprint."""
    from ..sources.lineage import record_training
    root = out_dir.rstrip("/")
    model.save(f"{root}/routing_model")
    # One record: a few teams squared and the top terms, so its arrays are bounded.
    confusion = cm.agg(F.sort_array(F.collect_list(F.struct("actual", "predicted", "n"))).alias("confusion"))
    features = imp.agg(F.sort_array(F.collect_list(F.struct("importance", "word")), asc=False).alias("top_features"))
    perf = acc.crossJoin(confusion).crossJoin(features).select(  # one row each
        "accuracy", F.array(*[F.lit(x) for x in model.labels]).alias("class_names"), "confusion", "top_features",
        F.lit(trained_at).alias("trained_at_utc"))
    perf.coalesce(1).write.mode("overwrite").json(f"{root}/model_performance")
    cm.coalesce(1).write.mode("overwrite").json(f"{root}/confusion")
    imp.coalesce(1).write.mode("overwrite").json(f"{root}/feature_importance")
    record_training(spark, root, dataset, training_part(dataset), trained_at, name, source, snapshot)


def load_performance(spark: SparkSession, out_dir: str) -> DataFrame:
    """Performance record of the last training; raises before any training."""
    path = f"{out_dir.rstrip('/')}/model_performance"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        raise FileNotFoundError(f"no trained routing model under {out_dir}")
    return spark.read.json(path)
