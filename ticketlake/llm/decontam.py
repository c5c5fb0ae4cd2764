"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by up to ``n * RATE``
edits.  Cut into that many pieces and one more, at least one piece of a matching
passage is unchanged: an Aho-Corasick automaton over all pieces finds every
exact piece hit in one pass over a text, hits on neighbouring diagonals join to
one window, and Myers' bit-parallel distance decides each window.  Items and
texts are compared in lower case with white space runs as one blank.

Documents are only scanned, never moved.  The items are taken in blocks of at
most about ``BLOCK_CHARS`` characters, one scan of the documents per block.  With
more than one block, a block's matches are written and its broadcast destroyed
before the next, and a task keeps the pieces of one block, so neither the driver
nor a task holds more of the benchmark than that.

Edge rows: null and empty items match nothing; null and empty texts hold
nothing; repeated items and rows are each reported; an item shorter than
1 / RATE characters must occur exactly and as whole words, and alone drops only a
text of which it is at least half; further columns are not read (or passed
through by ``drop_contaminated``); empty tables give no matches.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import ship_package, sized_broadcast
from .blocks import blocks, cut, fresh, texts_of

RATE = 0.08
BLOCK_CHARS = 16_000_000
# Hashes of dropped texts that are broadcast; more are joined by shuffle.
DROPPED_BROADCAST = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): ``edits + 1`` pieces of nearly equal length."""
    n = len(item)
    cuts = [n * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        out[ch] = out.get(ch, 0) | 1 << i
    return out


def best_end(masks: dict[str, int], m: int, text: str, at_most: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to a substring of ``text`` and its first end.

    One column of the dynamic program is two bit vectors of vertical steps; a
    character of text costs a few operations on integers of m bits.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now = full, 0, m
    found = None
    for j, ch in enumerate(text):
        eq = masks.get(ch, 0)
        x_down = eq | down
        x = (((eq & up) + up) ^ up) | eq
        right_up = down | (full & ~(x | up))
        right_down = up & x
        if right_up & top:
            now += 1
        elif right_down & top:
            now -= 1
        right_up, right_down = (right_up << 1) & full, (right_down << 1) & full
        up = right_down | (full & ~(x_down | right_up))
        down = right_up & x_down
        if now <= at_most and (found is None or now < found[0]):
            found = (now, j + 1)
            if now == 0:
                break
    return found


class Matcher:
    """The pieces of a block of items, and the verification of their hits."""

    def __init__(self, items: tuple[tuple, ...], rate: float):
        import ahocorasick

        self.items, self.parts = [], ahocorasick.Automaton()
        self.budgeted = 1 / rate if rate > 0 else 0  # characters from which on an item may have an edit
        held: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = normal(text)
            if not item:
                continue
            edits = int(len(item) * rate)
            for offset, piece in pieces(item, edits):
                held.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((key, item, edits, masks_of(item)))
        for piece, where in held.items():
            self.parts.add_word(piece, (len(piece), where))
        self.parts.make_automaton()

    def diagonals(self, text: str) -> dict[int, set[int]]:
        out: dict[int, set[int]] = {}
        for end, (size, where) in self.parts.iter(text):
            start = end + 1 - size
            for item, offset in where:
                out.setdefault(item, set()).add(start - offset)
        return out

    def matches(self, text: str) -> list[tuple]:
        """(item key, distance, start, end) of the best passage of each matching item."""
        if not self.items or not text:
            return []
        out = []
        for i, found in self.diagonals(text).items():
            key, item, edits, masks = self.items[i]
            m = len(item)
            at = text.find(item)
            while edits == 0 and at >= 0 and (text[max(at - 1, 0):at].isalnum() or text[at + m:at + m + 1].isalnum()):
                at = text.find(item, at + 1)
            if at >= 0:
                out.append((key, 0, at, at + m))
                continue
            if edits == 0:
                continue
            best = None
            for a, b in self.windows(sorted(found), edits, m, len(text)):
                got = best_end(masks, m, text[a:b], edits if best is None else best[0] - 1)
                if got:
                    end = a + got[1]
                    low = max(0, end - m - edits)
                    back = best_end(masks_of(item[::-1]), m, text[low:end][::-1], got[0])
                    best = (got[0], end - back[1], end)
            if best:
                out.append((key, *best))
        return out

    def contaminates(self, text: str) -> bool:
        """Whether a match is reason to drop the text: that of an item with an error budget, or of one that is most of it."""
        return any(b - a >= self.budgeted or 2 * (b - a) >= len(text) for _, _, a, b in self.matches(text))

    @staticmethod
    def windows(diagonals: list[int], edits: int, m: int, size: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for d in diagonals:
            a, b = max(0, d - edits), min(size, d + m + edits)
            if out and a <= out[-1][1] - m:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out


@lru_cache(maxsize=1)
def matcher(items: tuple[tuple, ...], rate: float) -> Matcher:
    return Matcher(items, rate)


def block_count(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> int:
    total = benchmark.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return -(-total // chars)


def item_blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS):
    """The items (item_id, text) in lists of about ``chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")) \
        .where("length(text) > 0")
    n = block_count(benchmark, chars)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    for b in range(n):
        yield items.where(block == b).orderBy("item_id", "text").collect()


def shared_matcher(spark, rows, rate: float):
    """A function for tasks that gives the matcher of a block of items, and its broadcast."""
    sent = spark.sparkContext.broadcast(tuple((r["item_id"], r["text"]) for r in rows))
    return (lambda: matcher(sent.value, rate)), sent


def _by_block(spark, benchmark: DataFrame, rate: float, block_chars: int, found_by) -> list[DataFrame]:
    """``found_by(matcher)`` of every block; beyond one block each is written before the next is sent."""
    several, out = block_count(benchmark, block_chars) > 1, []
    for rows in item_blocks(benchmark, block_chars):
        get, sent = shared_matcher(spark, rows, rate)
        found = found_by(get)
        if several:
            found = cut(found)
            sent.destroy()
        out.append(found)
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normalised text) of every matching document and item."""
    fields = "doc_id long, item_id long, distance int, start long, end long"
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    texts = texts_of(docs)

    def found_by(get):
        def find(batches):
            m = get()
            for batch in batches:
                got = [(doc, *hit) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                       for hit in m.matches(normal(text.as_py()))]
                cols = list(zip(*got, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                                 [f.split()[0] for f in fields.split(", ")])
        return texts.mapInArrow(find, fields)

    out = docs.sparkSession.createDataFrame([], fields)
    for found in _by_block(docs.sparkSession, benchmark, rate, block_chars, found_by):
        out = out.unionByName(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no test item.

    With one block of items a scan without a shuffle; with more, the blocks' scans
    write two hashes of the texts that go, which are then taken out by them.
    """
    ship_package(docs.sparkSession)
    column = next(c for c in docs.columns if c.lower() == "text")
    if block_count(benchmark, block_chars) <= 1:
        for rows in item_blocks(benchmark, block_chars):
            get, _ = shared_matcher(docs.sparkSession, rows, rate)

            def keep(batches, get=get):
                m = get()
                for part in blocks(batches, text=column):
                    yield part.filter(pa.array([not m.contaminates(normal(t)) for t in part.column(column).to_pylist()], pa.bool_()))

            return docs.mapInArrow(keep, docs.schema)
        return docs

    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    hashes = F.xxhash64(text), F.hash(text)
    texts = docs.select(text.alias("text"), *[h.alias(n) for h, n in zip(hashes, ("h1", "h2"), strict=True)])

    def found_by(get):
        def find(batches):
            m = get()
            for part in blocks(batches):
                hit = pa.array([m.contaminates(normal(t)) for t in part.column("text").to_pylist()], pa.bool_())
                yield part.select(["h1", "h2"]).filter(hit)
        return texts.mapInArrow(find, "h1 long, h2 int")

    first, second = fresh(docs.columns, "_h1"), fresh(docs.columns, "_h2")
    gone = None
    for found in _by_block(docs.sparkSession, benchmark, rate, block_chars, found_by):
        gone = found if gone is None else gone.unionByName(found)
    gone = sized_broadcast(cut(gone.distinct()).toDF(first, second), DROPPED_BROADCAST)
    return docs.join(gone, (hashes[0] == F.col(first)) & (hashes[1] == F.col(second)), "left_anti")
