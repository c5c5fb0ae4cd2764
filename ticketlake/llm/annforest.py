"""Nearest neighbours by a forest of random-projection trees.

Largest inner product becomes nearest angle: each vector gets one more
component, sqrt(max |x|^2 - |x|^2), which a query has as 0.  The trees are built
on the driver from a bounded sample (``SAMPLE`` vectors): a node splits along
the direction between two random members at the median.  Every vector is
indexed: a scan sends it down all trees.  A query walks all trees through one
priority queue ordered by the distance to the nearest plane crossed, and takes
leaves until they hold ``SHARE`` of the index; the candidates of those leaves
are ranked by the exact inner product in double precision.

Leaves are grouped to bins of at most ``BIN_ROWS`` vectors (a larger leaf is
split over several bins by hash), and the queries of a bin to groups of at most
``BIN_QUERIES``, so a group is bounded whatever the data; each group keeps its
``k`` best per query.  Equal vectors are indexed once, with their ``k + 1`` least
ids (no query can return more of them), which keeps masses of copies out of a
leaf without losing any result.

Edge rows: vectors that are null, empty, zero, of another length than most, or
that hold null or non-finite components take no part; rows without id neither;
rows that repeat an id and vector count once; ties go to the smaller id; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import ship_package
from .blocks import bucket_count, cut

TREES = 16
LEAF = 64
SAMPLE = 65_536
# Rows that a query's leaves hold together over all trees, as a share of the
# index (a row can be in a leaf of every tree).  Vectors spread evenly over the
# sphere need this much for a recall of 0.9; clustered ones reach it with far less.
SHARE = 1.3
BIN_ROWS = 32_768
BIN_QUERIES = 4_096


# --- the forest ----------------------------------------------------------------

class Tree:
    """Planes (w, t) of inner nodes; a child >= 0 is a node, < 0 leaf ``-child - 1``."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator):
        self.w, self.t, self.kids, self.leaves = [], [], [], 0
        self.root = self.split(x, np.arange(len(x)), leaf, rng)
        self.w = np.array(self.w).reshape(len(self.t), x.shape[1])
        self.t, self.kids = np.array(self.t), np.array(self.kids, np.int64).reshape(-1, 2)

    def split(self, x, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            w = x[a] - x[b]
            size = np.linalg.norm(w)
            if size < 1e-9:
                w = rng.normal(size=x.shape[1])
                size = np.linalg.norm(w)
            w = w / size
            side = x[rows] @ w
            t = float(np.median(side))
            right = side >= t
            if right.any() and not right.all():
                me = len(self.t)
                self.w.append(w)
                self.t.append(t)
                self.kids.append([0, 0])
                self.kids[me][0] = self.split(x, rows[~right], leaf, rng)
                self.kids[me][1] = self.split(x, rows[right], leaf, rng)
                return me
        self.leaves += 1
        return -self.leaves

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            right = np.einsum("ij,ij->i", x[inner], self.w[node]) >= self.t[node]
            at[inner] = self.kids[node, right.astype(int)]
        return -at - 1


def search_leaves(trees: list[Tree], sizes: list[np.ndarray], q: np.ndarray, enough: float) -> list[tuple[int, int]]:
    """(tree, leaf) of the nearest leaves of all trees, through one priority queue, until they hold ``enough`` rows."""
    margin = [t.w @ q - t.t for t in trees]
    queue = [(0.0, i, t.root) for i, t in enumerate(trees)]
    out, held = [], 0
    while queue and held < enough:
        crossed, i, node = heapq.heappop(queue)
        tree, m = trees[i], margin[i]
        while node >= 0:
            near = 1 if m[node] >= 0 else 0
            heapq.heappush(queue, (max(crossed, abs(m[node])), i, int(tree.kids[node, 1 - near])))
            node = int(tree.kids[node, near])
        leaf = -node - 1
        out.append((i, leaf))
        held += int(sizes[i][leaf])
    return out


# --- bins ------------------------------------------------------------------------

def bins_of(sizes: list[np.ndarray], bin_rows: int) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Per tree: first bin and number of bins of each leaf; and the number of bins."""
    first, parts, n = [], [], 0
    for size in sizes:
        f, p, held = np.zeros(len(size), np.int64), np.ones(len(size), np.int64), 0
        for leaf, rows in enumerate(size.tolist()):
            if rows > bin_rows:
                n += 1 if held else 0
                held = 0
                p[leaf] = math.ceil(rows / bin_rows)
                f[leaf] = n
                n += int(p[leaf])
                continue
            if held and held + rows > bin_rows:
                n, held = n + 1, 0
            f[leaf] = n
            held += rows
        n += 1 if held else 0
        first.append(f)
        parts.append(p)
    return first, parts, n


def best_in_leaves(q: np.ndarray, x: np.ndarray, spans: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and exact scores of the k largest inner products within the spans (all ties of the last one stay).

    A fast product picks the rows (to more than its rounding), the same sum for
    every row, wherever it stands, gives the scores.
    """
    near = np.concatenate([x[a:b] @ q for a, b in spans])
    rows = np.concatenate([np.arange(a, b) for a, b in spans])
    if len(near) > k:
        least = np.partition(near, len(near) - k)[len(near) - k]
        rows = rows[near >= least - 1e-9 * max(1.0, abs(least))]
    score = (x[rows] * q).sum(axis=1)
    if len(score) > k:
        held = score >= np.partition(score, len(score) - k)[len(score) - k]
        rows, score = rows[held], score[held]
    return rows, score


def usable(df: DataFrame, vec: str) -> DataFrame:
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)
                    & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                    & F.exists(vec, lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = TREES, leaf: int = LEAF, share: float = SHARE,
            sample: int = SAMPLE, bin_rows: int = BIN_ROWS, bin_queries: int = BIN_QUERIES, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k found nearest rows of ``vectors`` (id, vec) per row of ``queries`` (id, vec).

    A row of ``vectors`` with the query's id is not its candidate.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, asked = (usable(df.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
                          .where("id is not null"), "vec").distinct() for df in (vectors, queries))
    width = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return empty
    dim = width["n"]
    of_vector = Window.partitionBy("vec").orderBy("id")
    index = cut(rows.where(F.size("vec") == dim).withColumn("nth", F.row_number().over(of_vector)).where(F.col("nth") <= k + 1)
                .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("row", F.xxhash64("vec")))
    # The queries are few bytes but much work: they go to as many tasks as a shuffle has.
    asked = asked.where(F.size("vec") == dim).repartition(bucket_count(spark), "id")
    top = index.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))).first()[0]

    def lift(x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))])

    picked = index.select("row", "vec").orderBy("row", "vec").limit(sample).select("vec").toArrow().column("vec")
    rng = np.random.default_rng(seed)
    built = lift(np.array(picked.to_pylist(), float).reshape(-1, dim))
    forest = spark.sparkContext.broadcast([Tree(built, leaf, rng) for _ in range(trees)])

    def vectors_in(batch, name="vec"):
        return np.array(batch.column(name).to_pylist(), float).reshape(-1, dim)

    def place(batches):
        for batch in batches:
            x = lift(vectors_in(batch))
            leaves = np.column_stack([t.leaf_of(x) for t in forest.value])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec"), batch.column("ids"),
                                              pa.array(list(leaves.astype(np.int32)), pa.list_(pa.int32()))],
                                             ["row", "vec", "ids", "leaves"])

    placed = cut(index.mapInArrow(place, "row long, vec array<double>, ids array<long>, leaves array<int>"))
    # At most trees x leaves rows, bounded by the sample.
    counts = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().toPandas()
    sizes = [np.zeros(t.leaves, np.int64) for t in forest.value]
    for t, g in counts.groupby("tree"):
        sizes[t][g["leaf"].to_numpy()] = g["count"].to_numpy()
    enough = share * float(sizes[0].sum())
    first, parts, n_bins = bins_of(sizes, bin_rows)
    plan = spark.sparkContext.broadcast((sizes, first, parts))

    def probe(batches):
        sizes, first, parts = plan.value
        for batch in batches:
            out = []
            for i, q in zip(batch.column("id").to_pylist(), vectors_in(batch), strict=True):
                by_bin: dict[int, list[int]] = {}
                for t, f in search_leaves(forest.value, sizes, np.append(q, 0.0), enough):
                    for b in range(first[t][f], first[t][f] + parts[t][f]):
                        by_bin.setdefault(int(b), []).append(f)
                out += [(b, i, q.tolist(), leaves) for b, leaves in by_bin.items()]
            cols = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["bin", "id", "vec", "leaves"])

    probes = cut(asked.mapInArrow(probe, "bin long, id long, vec array<double>, leaves array<int>"))
    # A row per bin: at most the leaves plus the index over BIN_ROWS.
    groups = {r["bin"]: math.ceil(r["n"] / bin_queries) for r in probes.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not groups:
        return empty
    groups_of = spark.sparkContext.broadcast(np.array([groups.get(b, 0) for b in range(n_bins)]))

    def to_bins(batches):
        """A row per tree and query group of its bin."""
        _, first, parts = plan.value
        for batch in batches:
            hashed = np.array(batch.column("row").to_pylist(), np.int64).view(np.uint64)
            leaves = np.array(batch.column("leaves").to_pylist(), np.int64).reshape(len(batch), -1)
            for t in range(leaves.shape[1]):
                at = leaves[:, t]
                b = first[t][at] + (hashed % parts[t][at].astype(np.uint64)).astype(np.int64)
                times = groups_of.value[b]
                rows = np.repeat(np.arange(len(b)), times)
                group = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b[rows]), pa.array(group, pa.int64()), pa.array(at[rows], pa.int32()), batch.column("vec").take(picked),
                     batch.column("ids").take(picked)], ["bin", "part", "leaf", "vec", "ids"])

    members = placed.mapInArrow(to_bins, "bin long, part long, leaf int, vec array<double>, ids array<long>")
    group_rows = spark.createDataFrame(list(groups.items()), "bin long, n_parts int")
    grouped = (probes.join(F.broadcast(group_rows), "bin")
               .withColumn("part", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("long")))

    def rank_bin(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            at = left.column("leaf").to_numpy()
            order = np.argsort(at, kind="stable")
            x, ids = vectors_in(left.combine_chunks())[order], [left.column("ids")[int(i)].as_py() for i in order]
            at = at[order]
            n = int(at.max()) + 1
            ends = np.searchsorted(at, np.arange(n + 1))
            for i, q, leaves in zip(right.column("id").to_pylist(), vectors_in(right.combine_chunks()),
                                    right.column("leaves").to_pylist(), strict=True):
                spans = [(ends[f], ends[f + 1]) for f in leaves if f < n and ends[f] < ends[f + 1]]
                if not spans:
                    continue
                rows, score = best_in_leaves(q, x, spans, k + 1)
                found = sorted((-s, v) for r, s in zip(rows, score, strict=True) for v in ids[r] if v != i)[:k]
                out_q += [i] * len(found)
                out_v += [v for _, v in found]
                out_s += [-s for s, _ in found]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()),
                         "score": pa.array(out_s, pa.float64())})

    found = members.groupBy("bin", "part").cogroup(grouped.groupBy("bin", "part")).applyInArrow(
        rank_bin, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
