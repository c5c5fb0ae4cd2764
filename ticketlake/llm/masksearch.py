"""Exact top-k lexical search by presence masks.

One scan of the texts packs, per block of documents, the postings of the items'
terms and adds up N, L and the document frequencies; a second pass ranks the
blocks.  There, bitmap operations give every document of a block the mask of an
item's terms that it holds (64-bit words, one OR per posting), and documents are
grouped by mask.  A mask's best possible score is the sum of its terms' largest
contributions in the block.  Distinct masks are evaluated by descending best
score until the next one is below the k-th score found so far, which a task carries
from block to block; equal scores may still win by doc_id, so only a lower best
score ends the search.  A task gives k rows per item and a window merges them.

Items are taken in batches of at most ``ITEM_CHARS`` characters; a batch's terms are
broadcast, its results written, and the broadcasts destroyed before the next one.
Work grows with documents times items in blocks, as every document may hold a
frequent term of any item; rows shuffled grow with tasks times items times k.

Score: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document's
length factor m is 100 - B + (B n N div L); its score sums weight * ((10^9 tf) div
(1000 tf + K m)) over the item's terms, in 64-bit integers.

Edge rows: null and term-less texts are no documents and match nothing; rows that
repeat a doc_id are ranked on their own; a null doc_id comes last among equal
scores; rows of one item_id are one item that holds the terms of all; null and
empty items have no rows in the result; an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Numbered, blocks, cut, from_bytes, texts_of, to_bytes

TOP = 50
B_LENGTH = 50
K_TERM = 20
UNIT = 1_000_000_000
# Characters of item texts whose terms a broadcast holds.
ITEM_CHARS = 4_000_000
# Documents scored at once, masks permitting.
STEP = 512
NO_ID = 2 ** 63 - 1

#: Everything but ASCII letters and digits and what is not ASCII splits; A-Z become a-z.
TERM_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


def _pack(batches, terms: dict[bytes, int]):
    """Per block a row (kind 0) with its postings; per task a row (kind 1) with its totals."""
    docs = words = 0
    df = np.zeros(len(terms), np.int64)
    names = ["kind", "docs", "words", "data"]

    def row(kind, data):
        return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([docs], pa.int64()), pa.array([words], pa.int64()),
                                           pa.array([data], pa.binary())], names)

    for part in blocks(batches):
        ids, lengths, at, term, tf = [], [], [], [], []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
            found = terms_of(text)
            if not found:
                continue
            docs, words = docs + 1, words + len(found)
            held = [(terms[t], c) for t, c in Counter(found).items() if t in terms]
            if held:
                at.extend([len(ids)] * len(held))
                term.extend(t for t, _ in held)
                tf.extend(c for _, c in held)
                ids.append(NO_ID if doc is None else doc)
                lengths.append(len(found))
        if not ids:
            continue
        at, term, tf = np.array(at, np.int32), np.array(term, np.int32), np.array(tf, np.int64)
        df += np.bincount(term, minlength=len(terms))
        # Postings by term, documents in order.
        order = np.argsort(term, kind="stable")
        own, starts = np.unique(term[order], return_index=True)
        starts = pa.array(np.append(starts, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, pa.array(x[order])) for x in (at, tf)]
        head = pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)), pa.array(np.array(lengths, np.int64))], ["doc", "n"])
        yield row(0, to_bytes(pa.RecordBatch.from_arrays(
            [pa.array([to_bytes(head)], pa.binary()), pa.array([to_bytes(pa.RecordBatch.from_arrays([pa.array(own), *lists], ["term", "docs", "tf"]))],
                                                               pa.binary())], ["head", "postings"])))
    yield row(1, df.astype("<i8").tobytes())


class Best:
    """The k best (score, doc) of one item so far, equal scores by smaller doc."""

    def __init__(self, k: int):
        self.k, self.scores, self.docs = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        good = scores >= self.floor()
        scores, docs = np.concatenate([self.scores, scores[good]]), np.concatenate([self.docs, docs[good]])
        order = np.lexsort((docs, -scores))[:self.k]
        self.scores, self.docs = scores[order], docs[order]


def presence_masks(n_docs: int, postings: list[np.ndarray]) -> np.ndarray:
    """Per document, the words of 64 bits that say which postings it is in (documents x words)."""
    masks = np.zeros((n_docs, (len(postings) + 63) // 64), np.uint64)
    for j, docs in enumerate(postings):
        masks[docs, j // 64] |= np.uint64(1 << (j % 64))
    return masks


def mask_groups(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every document, and a document of every group; the groups have one mask each."""
    first, group = np.unique(masks[:, 0], return_index=True, return_inverse=True)[1:]
    for w in range(1, masks.shape[1]):
        word = np.unique(masks[:, w], return_inverse=True)[1]
        first, group = np.unique(group.astype(np.int64) * (word.max() + 1) + word, return_index=True, return_inverse=True)[1:]
    return group, first


def rank_block(best: Best, docs: np.ndarray, postings: list[np.ndarray], scores: list[np.ndarray]) -> int:
    """Adds a block to an item's best; ``postings`` and ``scores`` by the item's terms there.  Returns documents scored."""
    masks = presence_masks(len(docs), postings)
    tops = np.array([s.max() for s in scores], np.int64)
    group, first = mask_groups(masks)
    bits = np.unpackbits(masks[first].astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :len(postings)]
    bound = bits @ tops
    order = np.argsort(-bound, kind="stable")
    # Documents by their mask's place in the order.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = np.argsort(place[group], kind="stable")
    ends = np.cumsum(np.bincount(place[group], minlength=len(order)))
    bound, at, mask = bound[order], 0, 0
    while mask < len(bound) and bound[mask] >= best.floor():
        mask = min(max(mask + 1, int(np.searchsorted(ends, at + STEP, side="right"))), int(np.searchsorted(-bound, -best.floor(), side="right")))
        chosen = np.sort(by_mask[at:ends[mask - 1]])
        at = int(ends[mask - 1])
        total = np.zeros(len(chosen), np.int64)
        for held, score in zip(postings, scores, strict=True):
            i = np.searchsorted(held, chosen)
            i[i == len(held)] = 0
            hit = held[i] == chosen
            total[hit] += score[i[hit]]
        best.add(total, docs[chosen])
    return at


def _rank(batches, items: list[tuple], weights: np.ndarray, n_docs: int, n_words: int, k: int):
    """Rows (item, doc, score): the task's k best of every item."""
    best = [Best(k) for _ in items]
    for batch in batches:
        for data in batch.column("data").to_pylist():
            both = from_bytes(data)
            head, lists = from_bytes(both.column("head")[0].as_py()), from_bytes(both.column("postings")[0].as_py())
            docs, n = head.column("doc").to_numpy(), head.column("n").to_numpy()
            m = 100 - B_LENGTH + (B_LENGTH * n * n_docs) // n_words
            own = lists.column("term").to_numpy()
            column = lists.column("docs").combine_chunks()
            starts, flat = column.offsets.to_numpy(), column.flatten().to_numpy()
            tf = lists.column("tf").combine_chunks().flatten().to_numpy()
            score = (UNIT * tf) // (1000 * tf + K_TERM * m[flat]) * np.repeat(weights[own], np.diff(starts))
            for b, (_, terms) in zip(best, items, strict=True):
                there = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                there = there[own[there] == terms]
                if len(there):
                    spans = [slice(starts[t], starts[t + 1]) for t in there]
                    rank_block(b, docs, [flat[s] for s in spans], [score[s] for s in spans])
    rows = [(item, int(d), int(s)) for (item, _), b in zip(items, best, strict=True) for d, s in zip(b.docs, b.scores, strict=True)]
    for lo in range(0, len(rows), 20_000):
        part = rows[lo:lo + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([None if r[1] == NO_ID else r[1] for r in part], pa.int64()),
                                          pa.array([r[2] for r in part], pa.int64())], ["item_id", "doc_id", "score"])


def item_batches(items: DataFrame, chars: int):
    """Lists of (item_id, text) of at most ``chars`` characters (a longer item alone), in order of the id's hash;
    the driver holds one list at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held, room = {}, 0
    for r in rows.orderBy(F.xxhash64("item_id"), "item_id").toLocalIterator():
        if held and r["item_id"] not in held and room + len(r["text"]) > chars:
            yield held
            held, room = {}, 0
        held.setdefault(r["item_id"], []).append(r["text"])
        room += len(r["text"])
    if held:
        yield held


def _search_batch(texts: DataFrame, batch: dict, k: int) -> DataFrame:
    sc = texts.sparkSession.sparkContext
    number = Numbered()
    items = []
    for item, parts in batch.items():
        own = sorted({number[t] for p in parts for t in terms_of(p)})
        if own:
            items.append((item, np.array(own, np.int64)))
    terms = sc.broadcast(dict(number))
    packed = cut(texts.mapInArrow(lambda batches: _pack(batches, terms.value), "kind int, docs long, words long, data binary"))
    terms.destroy()
    totals = packed.where("kind = 1")
    of = totals.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n_docs, n_words = of["docs"] or 0, of["words"] or 0
    df = np.zeros(len(number), np.int64)  # one number per term of the batch
    for r in totals.mapInArrow(_add_counts, "data binary").toLocalIterator():
        df += np.frombuffer(r["data"], "<i8")
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    ranked = sc.broadcast((items, weights))
    rows = packed.where("kind = 0").select("data").mapInArrow(
        lambda batches: _rank(batches, *ranked.value, n_docs, max(n_words, 1), k), "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = cut(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    ranked.destroy()
    return top


def _add_counts(batches):
    """One row per task: the sum of its rows' arrays."""
    total = None
    for b in batches:
        for data in b.column("data").to_pylist():
            mine = np.frombuffer(data, "<i8")
            total = mine if total is None else total + mine
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(item_id, rank from 1, doc_id, score): each item's k best documents with a score above 0."""
    texts = texts_of(docs)
    out = None
    for batch in item_batches(items, item_chars):
        top = _search_batch(texts, batch, k)
        out = top if out is None else out.unionByName(top)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


def oracle(docs: str = "documents", items: str = "benchmark") -> str:
    """DuckDB SQL of ranked_search."""
    def terms(table: str, key: str) -> str:
        pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
        upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '{pattern}')) AS term FROM {table}"
    return f"""
WITH d AS (SELECT row_number() OVER () AS nr, doc_id, text FROM {docs}),
tok AS ({terms('d', 'nr')}),
tf AS (SELECT nr, term, count(*) AS tf FROM tok GROUP BY nr, term),
len AS (SELECT nr, count(*) AS n FROM tok GROUP BY nr),
tot AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM len),
df AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, tot GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, term FROM ({terms(items, 'item_id')})),
s AS (
  SELECT item_id, nr, CAST(sum(w * (({UNIT} * tf) // (1000 * tf + {K_TERM} * (100 - {B_LENGTH} + ({B_LENGTH} * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN len USING (nr), tot GROUP BY item_id, nr)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM s JOIN d USING (nr) WHERE score > 0) WHERE rank <= {TOP}"""
