"""Packing documents into training sequences by cutting-stock column generation.

A document of n ids is cut into pieces of the full capacity and one rest.  The
rests are packed by lengths, not by documents: their histogram (at most a row
per length up to the capacity) is the demand of a cutting-stock
linear program.  Its columns are patterns (multisets of classes that fit a
sequence), priced by a knapsack dynamic program over the duals; the LP optimum
is rounded down, the little that is left is filled largest-first.  Each pattern
then serves *ranks*: the k-th document of a class gets the k-th slot of that
class, so documents are assigned by one distributed rank and one small join.

``GRID`` neighbouring lengths form a class, planned at its upper bound in units
of ``GRID``, which keeps the program small; the room this leaves in a pattern,
counted by the longest length that the class really holds, is filled with more
documents where one fits.

Edge rows: null and empty texts are one id (the end id); repeated rows are
packed each; an empty table gives no rows; further columns are not read; a text
of any length is cut.  Ties in rank go to smaller doc_id, start, checksum.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocks, claim, cut, spark_conf_int, texts_of, worker_cache
from .tokencount import tokenizer

CAPACITY = 4096
GRID = 8
# Relative gap to the LP's lower bound at which column generation ends.
LP_GAP = 1e-4
# Cached encodings of a Python worker; the cache starts anew beyond it.
CACHE_ENTRIES = 800_000
# Characters below this code point stay below it in lower case.
PLAIN_BELOW = 0x180
# Pre-tokens encoded as one text.
LEARNED_AT_ONCE = 100
# Sub-groups of a class while ranking, so that a hot length is many groups.
RANK_BUCKETS = 64


# --- ids --------------------------------------------------------------------

def plain_words() -> re.Pattern:
    """The tokenizer's pre-token pattern for lower-case text of plain characters."""
    kinds = [[re.escape(chr(c)) for c in range(PLAIN_BELOW) if unicodedata.category(chr(c))[0] == k] for k in "LN"]
    let, num = map("".join, kinds)
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{let}]+|[{num}]|[^\s{let}{num}]+")


class WordIds(dict):
    """Pre-token -> its ids as little-endian uint32 bytes, encoded once per worker.

    A text of plain characters is cut to pre-tokens by the pattern.  In others
    the parts between blanks and line feeds are looked at one by one: no
    pre-token crosses white space, and the normalizer looks no further than a
    character and its marks; a part that is not plain is encoded as it is.

    Plain pre-tokens are learned many at once, as one text with blanks between:
    the last id of a pre-token is one that ends words, so the ids can be told apart.
    """

    ascii = bytes([9, 10, 13, *range(32, 127)])
    other = re.compile(f"[^\t\n\r -~\xa1-{chr(PLAIN_BELOW - 1)}]|<\\|")
    words = plain_words()

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer, normalizers, pre_tokenizers
        self.tok = tokenizer(path)
        # Plain pre-tokens need no normalizer, and blanks alone part them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tok.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith(self.tok.model.end_of_word_suffix)]] = True

    def plain(self, text: str) -> bool:
        if text.isascii():
            return not text.encode().translate(None, self.ascii) and "<|" not in text
        return self.other.search(text) is None

    def split(self, text: str) -> list[str]:
        if self.plain(text):
            return self.words.findall(text.lower())
        parts = text.replace("\n", " ").split(" ")
        return [w for p in parts for w in (self.words.findall(p.lower()) if self.plain(p) else [p])]

    def learn(self, words: set[str]) -> None:
        """Encodes what is missing in one call; a cache over its bound starts anew."""
        if len(self) > CACHE_ENTRIES:
            self.clear()
        missing = words.difference(self)
        alone = [w for w in missing if not self.plain(w)]
        for w, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            self[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        rest = list(missing.difference(alone))
        for at in range(0, len(rest), LEARNED_AT_ONCE):
            some = rest[at:at + LEARNED_AT_ONCE]
            [encoded] = self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4")
            data, start = ids.tobytes(), 0
            for w, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                self[w] = data[start:end]
                start = end


@cache
def word_ids(path: str) -> WordIds:
    return worker_cache(WordIds(path))


def id_bytes(texts: list[str], path: str, end_id: int) -> list[bytes]:
    """All ids of each text and the end id, little-endian uint32."""
    known = word_ids(path)
    claim(known)
    words = [known.split(t) for t in texts]
    known.learn(set().union(*words))
    end = end_id.to_bytes(4, "little")
    return [b"".join(map(known.__getitem__, ws)) + end for ws in words]


def pieces_of(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each document's pieces."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    names = [f.split()[0] for f in fields.split(", ")]

    def cut_up(batches):
        for batch in blocks(batches, docs=2048, chars=2_000_000):
            rows: list[list] = [[] for _ in names]
            every = id_bytes(batch.column("text").to_pylist(), path, end_id)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), every, strict=True):
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start:4 * (start + capacity)]
                    for col, v in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names)

    return texts_of(docs).mapInArrow(cut_up, fields)


# --- the cutting-stock program (bounded by the number of length classes) -------

def length_classes(histogram: dict[int, int], grid: int = GRID) -> dict[int, int]:
    """Length -> longest held length of its class of ``grid`` neighbouring lengths."""
    top: dict[int, int] = {}
    for n in histogram:
        top[-(-n // grid)] = max(n, top.get(-(-n // grid), 0))
    return {n: top[-(-n // grid)] for n in histogram}


def best_patterns(prices: np.ndarray, sizes: np.ndarray, room: int, several: int = 12) -> tuple[float, list[np.ndarray]]:
    """Unbounded knapsack: the most price within ``room``, and patterns of most price, each led by another size."""
    order = np.argsort(sizes)
    s, p = sizes[order], prices[order]
    fits = np.searchsorted(s, np.arange(room + 1), side="right")
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        if fits[r]:
            got = best[r - s[:fits[r]]] + p[:fits[r]]
            k = int(got.argmax())
            if got[k] > best[r] + 1e-12:
                best[r], last[r] = got[k], k
    patterns = []
    for lead in np.argsort(-(best[room - s] + p), kind="stable")[:several]:
        pattern, r = np.zeros(len(sizes)), room - int(s[lead])
        pattern[order[lead]] = 1
        while r > 0:
            if last[r] < 0:
                r -= 1
            else:
                pattern[order[last[r]]] += 1
                r -= int(s[last[r]])
        patterns.append(pattern)
    return float(best[room]), patterns


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = LP_GAP):
    """Patterns (rows) and amounts of a near-optimal LP solution; min sum x, A x = demand."""
    basis = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ demand
    low = sizes @ demand / room  # no packing is tighter than its material
    while True:
        value, columns = best_patterns(inverse.sum(axis=0), sizes, room)
        total = amounts.sum()
        low = max(low, total / max(value, 1.0))  # no solution is below total / value
        if value <= 1 + 1e-9 or total - low <= gap * total:
            return basis.T, np.maximum(amounts, 0)
        for col in columns:
            if inverse.sum(axis=0) @ col <= 1 + 1e-9:
                continue  # an earlier column of this round already took its gain
            step = inverse @ col
            ratio = np.where(step > 1e-9, amounts / np.where(step > 1e-9, step, 1), np.inf)
            out = int(ratio.argmin())
            amounts = amounts - ratio[out] * step
            amounts[out] = ratio[out]
            basis[:, out] = col
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row


def filled(pattern: dict[int, int], left: dict[int, int], room: int) -> dict[int, int]:
    """The pattern with further sizes of ``left`` while they fit, largest first."""
    free = room - sum(s * a for s, a in pattern.items())
    for s in sorted(left, reverse=True):
        if s <= free and (more := min(free // s, left[s] - pattern.get(s, 0))) > 0:
            pattern = pattern | {s: pattern.get(s, 0) + more}
            free -= more * s
    return pattern


def plan(sizes: list[int], demand: list[int], room: int, grid: int = 1) -> list[tuple[dict[int, int], int]]:
    """(pattern as size -> copies, times used) covering the demand exactly."""
    left = dict(zip(sizes, map(int, demand), strict=True))
    out = []

    def use(pattern: dict[int, int], most: int) -> int:
        times = min([most, *(left[s] // a for s, a in pattern.items())])
        if times > 0:
            out.append((pattern, times))
            for s, a in pattern.items():
                left[s] -= a * times
                if not left[s]:
                    del left[s]
        return times

    if sizes:
        units = np.array([-(-s // grid) for s in sizes])
        patterns, amounts = column_generation(units, np.array(demand, float), room // grid)
        for i in np.argsort(-amounts, kind="stable"):
            pattern, most = {s: int(a) for s, a in zip(sizes, patterns[i], strict=True) if a}, int(amounts[i] + 1e-9)
            while most > 0 and all(left.get(s, 0) >= a for s, a in pattern.items()):
                most -= use(filled(pattern, left, room), most)
    while left:  # a few per pattern at most
        use(filled({}, left, room), max(left.values()))
    return out


def slot_runs(patterns: list[tuple[dict[int, int], int]]) -> list[tuple]:
    """(class, first rank, last rank + 1, first sequence, copies, slot) of each pattern's classes."""
    used: dict[int, int] = {}
    runs, seq = [], 0
    for pattern, times in patterns:
        slot = 0
        for s in sorted(pattern, reverse=True):
            a, first = pattern[s], used.get(s, 0)
            runs.append((s, first, first + a * times, seq, a, slot))
            used[s] = first + a * times
            slot += a
        seq += times
    return runs


# --- the operator -----------------------------------------------------------------

def pack(pieces: DataFrame, capacity: int = CAPACITY, grid: int = GRID) -> DataFrame:
    """Adds sequence_id, offset and sequence_tokens to pieces of at most ``capacity``.

    ``pieces`` (with columns doc_id, start, length, ids_crc32) must be stable
    under recomputation: a table or a checkpoint.
    """
    spark = pieces.sparkSession
    buckets = max(RANK_BUCKETS, spark_conf_int(spark, "spark.sql.shuffle.partitions", 200))
    # At most a row per length up to the capacity.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    class_of = length_classes(histogram, grid)
    demand: dict[int, int] = {}
    for length, n in histogram.items():
        demand[class_of[length]] = demand.get(class_of[length], 0) + n
    tops = sorted(demand)
    runs = slot_runs(plan(tops, [demand[c] for c in tops], capacity, grid))
    lookup = spark.createDataFrame(list(class_of.items()), "length long, class int")
    held = pieces.join(F.broadcast(lookup), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = held.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))

    # The rank of a piece in its class: rank in its bucket plus the buckets before.
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (held.withColumn("in_bucket", F.row_number().over(in_bucket) - 1)
              .join(starts, ["class", "bucket"])
              .withColumn("rank", F.col("in_bucket") + F.col("before")))

    # At most (classes x classes) runs by the capacity, a few thousand in practice.
    run_rows = spark.createDataFrame(runs, "class int, first long, last long, seq long, copies long, slot long")
    by_class = run_rows.groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "seq", "copies", "slot"))).alias("runs"))
    placed = (ranked.join(F.broadcast(by_class), "class")
              .withColumn("run", F.filter("runs", lambda r: (r["first"] <= F.col("rank")) & (F.col("rank") < r["last"]))[0])
              .withColumn("k", F.col("rank") - F.col("run.first"))
              .withColumn("sequence_id", F.expr("run.seq + k div run.copies"))
              .withColumn("slot", F.col("run.slot") + F.col("k") % F.col("run.copies")))
    seq = Window.partitionBy("sequence_id")
    along = seq.orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (placed.withColumn("offset", F.sum("length").over(along) - F.col("length"))
            .withColumn("sequence_tokens", F.sum("length").over(seq))
            .select(*pieces.columns, "sequence_id", "offset", "sequence_tokens"))


def pack_documents(docs: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(cut(pieces_of(docs, path, end_id, capacity)), capacity).drop("sequence_tokens")
