"""Shared pieces of the operators: texts in Arrow tasks, and packed frequencies.

*Packed frequencies* carry "how often does each document hold each key" through
a shuffle without a row per (document, key), which would be more bytes than the
texts.  A task cuts its documents into blocks and emits, per block and bucket of
keys (by hash), one row that holds the bucket's keys with their (document,
count) lists by column.  A group per bucket then sees every occurrence of its
keys, weighs each distinct key once, and sums ``count * weight`` per document; a
last group per block adds up the buckets.  Buckets follow the number of shuffle
partitions, so a group is a task's share of the data; a key in every document is
one entry per block in one bucket.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import reliable_checkpoint, ship_package

BLOCK_DOCS = 16_384
BLOCK_CHARS = 10_000_000
# Rows of a block handed to the JVM at once.
ROWS_OUT = 20_000


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads: integer id, text (null: empty) and ``more``."""
    ship_package(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(c) for c in more])


def fresh(taken: Iterable[str], base: str) -> str:
    """A column name like ``base`` that is not in ``taken`` (names compare without case)."""
    low = {c.lower() for c in taken}
    name, n = base, 0
    while name.lower() in low:
        n += 1
        name = f"{base}_{n}"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files."""
    return reliable_checkpoint(df)


def blocks(batches: Iterable[pa.RecordBatch], docs: int = BLOCK_DOCS, chars: int = BLOCK_CHARS,
           text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of bounded rows and characters (a longer text stands alone).

    After the last one the worker gives back the memory that it holds unused.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start, room = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (room + n > chars or i - start >= docs):
                yield batch.slice(start, i - start)
                start, room = i, 0
            room += int(n)
        if start < len(batch):
            yield batch.slice(start)
    give_back()


# A Python worker serves the tasks of one stage after the other: what an operator
# remembers from task to task is forgotten when another one's tasks come.
_WORKER_CACHES: list = []


def worker_cache(cache):
    """Registers something with ``clear()`` that a worker keeps between tasks."""
    _WORKER_CACHES.append(cache)
    return cache


def claim(mine) -> None:
    """To be called by a task that uses the cache ``mine``: clears those of other operators."""
    for cache in _WORKER_CACHES:
        if cache is not mine:
            cache.clear()


def give_back() -> None:
    """Returns freed memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


class Numbered(dict):
    """Key -> 0, 1, 2, ... in order of first sight."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def counted_pairs(ids: np.ndarray, doc_of: np.ndarray, n_keys: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document indexes and counts (uint16) by key 0..n_keys-1, and where each key's pairs start."""
    codes, counts = np.unique((ids.astype(np.int64) << 16) | doc_of, return_counts=True)
    big = 0xFFFF  # a count beyond 16 bits becomes several pairs
    times = (counts - 1) // big + 1
    if len(times) and times.max() > 1:
        last = counts - (times - 1) * big
        counts = np.full(times.sum(), big)
        counts[np.cumsum(times) - 1] = last
        codes = np.repeat(codes, times)
    starts = np.zeros(n_keys + 1, np.int32)
    np.cumsum(np.bincount(codes >> 16, minlength=n_keys), out=starts[1:])
    return (codes & 0xFFFF).astype("<u2"), counts.astype("<u2"), starts


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.RecordBatch | pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


PACKED = "block long, bucket int, head binary, part binary"
SUMS = "block long, head binary, docs binary, sums binary"


def bucket_count(spark: SparkSession) -> int:
    return max(16, spark_conf_int(spark, "spark.sql.shuffle.partitions", 200))


def packed_frequencies(texts: DataFrame, describe: Callable[[pa.RecordBatch], tuple], buckets: int) -> DataFrame:
    """Rows (block, bucket, head, part) of all blocks.

    ``describe(slice)`` gives the head batch (what the documents carry of their
    own, a row each), the distinct keys, their buckets, and per occurrence the
    key's number and the document's.  ``texts`` must give the same rows in the
    same order when a lost task runs again, as a table scan or a checkpoint does.
    """
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("head", pa.binary()), ("part", pa.binary())])

    def row(block, bucket, head, part):
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket], pa.int32()), pa.array([head], pa.binary()),
                                           pa.array([part], pa.binary())], schema=schema)

    def pack(batches):
        base = TaskContext.get().partitionId() << 32
        for n, part in enumerate(blocks(batches)):
            head, keys, bucket_of, ids, doc_of = describe(part)
            yield row(base + n, n % buckets, to_bytes(head), None)
            docs, counts, starts = counted_pairs(ids, doc_of, len(keys))
            offsets = pa.array(starts, pa.int32())
            rows = pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(docs)),
                                               pa.ListArray.from_arrays(offsets, pa.array(counts))], ["key", "docs", "counts"])
            order = np.argsort(bucket_of, kind="stable")
            ends = np.searchsorted(bucket_of[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)):
                yield row(base + n, b, None, to_bytes(rows.take(pa.array(order[ends[b]:ends[b + 1]]))))

    return texts.mapInArrow(pack, PACKED)


def bucket_sums(table: pa.Table, weigh: Callable[[pa.Array], np.ndarray], kind: str) -> pa.Table:
    """Weighted sums per block and document of one bucket; ``weigh`` gets its distinct keys.  ``kind``: numpy type of the sums."""
    rows = table.select(["block", "head", "part"]).to_pylist()
    out = [(r["block"], r["head"], None, None) for r in rows if r["head"] is not None]
    parts = [(r["block"], from_bytes(r["part"])) for r in rows if r["part"] is not None]
    if parts:
        coded = pa.concat_arrays([c for _, p in parts for c in p.column("key").chunks]).dictionary_encode()
        weights, at = weigh(coded.dictionary)[coded.indices.to_numpy()], 0
        for block, p in parts:
            mine = weights[at:at + p.num_rows]
            at += p.num_rows
            lists = pa.concat_arrays(p.column("docs").chunks)
            counts = pa.concat_arrays(p.column("counts").chunks).flatten().to_numpy()
            sums = np.bincount(lists.flatten().to_numpy(), weights=counts * np.repeat(mine, lists.value_lengths().to_numpy()))
            held = np.flatnonzero(sums)
            out.append((block, None, held.astype("<u2").tobytes(), sums[held].astype(kind).tobytes()))
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, [pa.int64()] + [pa.binary()] * 3, strict=True)],
                    names=["block", "head", "docs", "sums"])


def add_blocks(sums: DataFrame, kind: str, fields: str, finish: Callable) -> DataFrame:
    """One group per block: ``finish(head, totals per document)`` gives the rows out."""
    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = from_bytes(next(r["head"] for r in rows if r["head"] is not None))
        total = np.zeros(head.num_rows)
        for r in sorted((r for r in rows if r["docs"] is not None), key=lambda r: r["sums"]):
            total[np.frombuffer(r["docs"], "<u2")] += np.frombuffer(r["sums"], kind)
        return finish(head, total)

    return sums.groupBy("block").applyInArrow(add_up, fields)


def spark_conf_int(spark: SparkSession, key: str, default: int) -> int:
    value = spark.conf.get(key, str(default))
    return int(value)
