"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is the set of its five-word shingles (lower case, word characters
only; a text of one to four words is one shingle).  DartMinHash throws hashed
darts at the region (weight, time) of each element: an element's darts arrive
as a Poisson process seeded by its hash, so a document sees the same dart of a
shared element as any other document, and only about k (ln k + 4) darts are
looked at for k coordinates, however long the text is.  Each dart falls on one
coordinate; the earliest dart per coordinate is the signature, and two
signatures agree at a coordinate with probability equal to the (weighted)
Jaccard similarity.  Weights go in power-of-two slices [0,1), [1,2), [2,4)...

Bands of ``ROWS`` coordinates are join keys.  At similarity 0.8 a pair shares
one of the 24 bands with probability 1 - 3e-6.  Within a bucket nothing is
paired with everything: each member is compared with the bucket's leaders, the
member that meets most others over all its buckets (the text that a group of
near copies was made from, if it is there) and ``DRAWN_LEADERS`` drawn by hash,
so that a large group meets many leaders; once components are known only
members of *different* components of a bucket are compared.  Four bits of every
coordinate ride along as a sketch: a pair whose sketches agree less than a pair
at the required similarity does (by ``SIGMAS`` standard deviations, 1e-6) is no
candidate.  Texts that are still apart in a bucket get a longer sketch, one bit of
each of ``WIDE`` coordinates, which tells 0.74 from 0.8.  Candidates are verified by the exact Jaccard similarity of their
shingle sets, at least ``SIMILARITY``.

Exact copies (the same words) collapse to one representative before that.

Edge rows: texts without words (null, empty, punctuation) are linked to none;
rows that repeat a doc_id are one document; rows without doc_id have no class;
an empty table gives no rows; further columns are not read.  The least doc_id
of a group names its class.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.session import sized_broadcast
from .blocks import blocks, claim, cut, texts_of, worker_cache
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
SIGMAS = 4.75
SKETCH_BITS = 4
DRAWN_LEADERS = 2
# Coordinates of the longer sketch, one bit each.
WIDE = 2048
# Ids that are looked up among all texts are broadcast up to this many, beyond it joined by shuffle.
IDS_BROADCAST = 2_000_000
WORD = re.compile(r"\w+")
CACHE_WORDS = 200_000


# --- elements -----------------------------------------------------------------

class WordHash(dict):
    """Word -> stable 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = worker_cache(WordHash())


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


MASK = 2 ** 64 - 1
GOLDEN = 0x9E3779B97F4A7C15
# Odd factors, one per place in a shingle.
_PLACE = [np.uint64((2 * k + 1) * GOLDEN & MASK) for k in range(SHINGLE)]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of all texts and the text each belongs to, with repeats."""
    claim(_HASH)
    lists = [WORD.findall(t.lower()) for t in texts]
    sizes = np.array([len(w) for w in lists], np.int64)
    total = int(sizes.sum())
    words = np.fromiter((h for w in lists for h in map(_HASH.__getitem__, w)), np.uint64, total)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    ends = np.cumsum(sizes)
    left = np.repeat(ends, sizes) - np.arange(total)  # words from here to the text's end
    h = np.zeros(total, np.uint64)
    for k in range(SHINGLE):
        h += np.where(left > k, mix(padded[k:k + total] * _PLACE[k]), np.uint64(0))
    start = np.arange(total) == np.repeat(ends - sizes, sizes)
    full = (left >= SHINGLE) | start  # a short text is one shingle
    return mix(h[full]), np.repeat(np.arange(len(texts)), sizes)[full]


def element_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, text, number of occurrences), each element once per text."""
    e, owner = shingles(texts)
    order = np.lexsort((e, owner))
    e, owner = e[order], owner[order]
    first = np.ones(len(e), bool)
    first[1:] = (e[1:] != e[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return e[at], owner[at], np.diff(np.append(at, len(e)))


# --- DartMinHash ----------------------------------------------------------------

def dart_minhash(e: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_sets: int, k: int) -> np.ndarray:
    """Signatures (n_sets x k, uint64) of weighted sets; empty sets stay 0."""
    best = np.full(n_sets * k, np.inf)
    sig = np.zeros(n_sets * k, np.uint64)
    total = np.bincount(owner, weights=weight, minlength=n_sets)
    until = np.divide(k * (np.log(k) + 4), total, out=np.zeros(n_sets), where=total > 0)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        throw_darts(e[mine], owner[mine], weight[mine], until, k, best, sig)
        todo = todo & np.isinf(best.reshape(n_sets, k)).any(axis=1)  # a coordinate without a dart yet
        until = until * 2
    return sig.reshape(n_sets, k)


def throw_darts(e, owner, weight, until, k, best, sig) -> None:
    """Darts of all elements before each set's time limit; keeps the earliest per coordinate."""
    n_slices = int(np.ceil(np.log2(max(1.0, weight.max())))) + 1 if len(weight) else 0
    for s in range(n_slices):
        low, wide = (0.0, 1.0) if s == 0 else (2.0 ** (s - 1), 2.0 ** (s - 1))
        at = np.flatnonzero(weight > low)
        seed = mix(e[at] + np.uint64((s + 1) * 0xD1B54A32D192ED03 & MASK))
        now, n = np.zeros(len(at)), 0
        while len(at):
            n += 1
            h = mix(seed + np.uint64(n * GOLDEN & MASK))
            now = now - np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)) / wide
            live = now < until[owner[at]]
            at, seed, now, h = at[live], seed[live], now[live], h[live]
            dart = mix(h ^ np.uint64(0xA0761D6478BD642F))
            height = low + wide * ((dart >> np.uint64(11)).astype(np.float64) * 2.0 ** -53)
            hit = height < weight[at]
            spot = owner[at][hit] * k + (mix(dart[hit]) % np.uint64(k)).astype(np.int64)
            t, d = now[hit], dart[hit]
            np.minimum.at(best, spot, t)
            won = best[spot] == t
            sig[spot[won]] = d[won]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band (n x bands)."""
    parts = sig.reshape(len(sig), bands, rows)
    key = np.zeros(parts.shape[:2], np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(GOLDEN) + parts[:, :, r])
    return mix(key + np.arange(bands, dtype=np.uint64)).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """The low ``SKETCH_BITS`` of every coordinate, packed to 64-bit words (n x words)."""
    per = 64 // SKETCH_BITS
    n, k = sig.shape
    low = np.zeros((n, -(-k // per) * per), np.uint64)
    low[:, :k] = sig & np.uint64(2 ** SKETCH_BITS - 1)
    shifts = (np.arange(per) * SKETCH_BITS).astype(np.uint64)
    return np.bitwise_or.reduce(low.reshape(n, -1, per) << shifts, axis=2).view(np.int64)


def least_agreement(k: int, at_least: float) -> int:
    """Sketch coordinates that a pair of the similarity agrees on, but for ``SIGMAS`` deviations."""
    p = at_least + (1 - at_least) / 2 ** SKETCH_BITS
    return int(np.floor(k * p - SIGMAS * np.sqrt(k * p * (1 - p))))


def disagreeing(a: str, b: str, words: int) -> Column:
    """Number of coordinates in which two sketches (arrays of words) differ."""
    mask = F.lit(sum(1 << i for i in range(0, 64, SKETCH_BITS)))  # the low bit of each coordinate
    out = F.lit(0)
    for w in range(words):
        x = F.col(a)[w].bitwiseXOR(F.col(b)[w])
        for step in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        out = out + F.bit_count(x.bitwiseAND(mask))
    return out


# --- distributed part -----------------------------------------------------------

def signatures(docs: DataFrame, bands: int, rows: int, by_count: bool) -> DataFrame:
    """(doc_id, h1, h2, n, bands, sketch): content hash, number of shingles, band keys and sketch of every text."""
    fields = "doc_id long, h1 long, h2 long, n int, bands array<long>, sketch array<long>"

    def sign(batches):
        for part in blocks(batches, docs=2048, chars=3_000_000):
            texts = part.column("text").to_pylist()
            e, owner, count = element_sets(texts)
            weight = count.astype(float) if by_count else np.ones(len(e))
            sig = dart_minhash(e, owner, weight, len(texts), bands * rows)
            keys, low = band_keys(sig, bands, rows), sketch(sig)
            n = np.bincount(owner, minlength=len(texts))
            ids = [xxhash.xxh3_128_digest(" ".join(WORD.findall(t.lower()))) for t in texts]
            both = np.frombuffer(b"".join(ids), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(n, pa.int32()),
                 *[pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64())) for x in (keys, low)]],
                [f.split()[0] for f in fields.split(", ")])

    return texts_of(docs).mapInArrow(sign, fields)


def jaccard_of(texts_a: list[str], texts_b: list[str]) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets, pair by pair."""
    n = len(texts_a)
    ea, oa, _ = element_sets(texts_a)
    eb, ob, _ = element_sets(texts_b)
    e, o = np.concatenate([ea, eb]), np.concatenate([oa, ob])
    order = np.lexsort((e, o))
    e, o = e[order], o[order]
    same = (e[1:] == e[:-1]) & (o[1:] == o[:-1])
    both = np.bincount(o[1:][same], minlength=n)
    either = np.bincount(o, minlength=n) - both
    return np.divide(both, either, out=np.zeros(n), where=either > 0)


def texts_with(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of the documents in ``ids`` (id), found before any text is shuffled."""
    return texts_of(docs).join(sized_broadcast(ids, IDS_BROADCAST), F.col("doc_id") == F.col("id"), "left_semi")


def wide_sketches(docs: DataFrame, ids: DataFrame, by_count: bool) -> DataFrame:
    """(rep, wide): one bit of each of ``WIDE`` coordinates of the texts in ``ids`` (id)."""
    def sign(batches):
        for part in blocks(batches, docs=256, chars=1_000_000):
            texts = part.column("text").to_pylist()
            e, owner, count = element_sets(texts)
            weight = count.astype(float) if by_count else np.ones(len(e))
            bits = (dart_minhash(e, owner, weight, len(texts), WIDE) & np.uint64(1)).astype(np.uint8)
            wide = np.packbits(bits, axis=1).view("<i8")
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(wide.ravel()), wide.shape[1]).cast(pa.list_(pa.int64()))],
                ["rep", "wide"])

    return texts_with(docs, ids).mapInArrow(sign, "rep long, wide array<long>")


def wide_enough(a: str, b: str, at_least: float) -> Column:
    """Whether two longer sketches agree as often as a pair of the similarity does."""
    p = at_least + (1 - at_least) / 2
    most = int(np.ceil(WIDE * (1 - p) + SIGMAS * np.sqrt(WIDE * p * (1 - p))))
    differ = [F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w])) for w in range(WIDE // 64)]
    return sum(differ[1:], differ[0]) <= most


def verified(pairs: DataFrame, docs: DataFrame, at_least: float) -> DataFrame:
    """Of the candidate pairs (a, b) those whose texts reach the similarity."""
    pairs = cut(pairs)
    texts = cut(texts_with(docs, cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def check(batches):
        for part in blocks(batches, docs=512, chars=2_000_000, text="ta"):
            j = jaccard_of(part.column("ta").to_pylist(), part.column("tb").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(j)],
                                             ["a", "b", "similarity"]).filter(pa.array(j >= at_least))

    return both.select("a", "b", "ta", "tb").mapInArrow(
        check, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, at_least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    by_count: bool = False) -> DataFrame:
    """doc_id and class_id (the least doc_id of its group) of every row of ``docs``.

    ``by_count`` weighs a shingle by its occurrences when signing; links are
    verified on shingle sets.
    """
    signed = cut(signatures(docs, bands, rows, by_count))
    k = bands * rows
    words = -(-k * SKETCH_BITS // 64)
    reps = (signed.where("doc_id is not null and n > 0").groupBy("h1", "h2")
            .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"),
                 F.first("sketch").alias("sketch")))
    alike = ((F.least("n", "na") >= F.lit(at_least - 1e-9) * F.greatest("n", "na"))
             & (disagreeing("sketch", "sa", words) <= k - least_agreement(k, at_least)))

    # Members of the buckets that hold more than one text.
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = cut(keyed.join(shared, "key"))
    met = buckets.groupBy("rep").agg(F.sum("members").alias("met"))
    about = cut(reps.select("rep", "n", "sketch", "bands").join(met, "rep"))

    # Round 1: every member of a bucket against the bucket's leaders: the member
    # that meets most others, and two that differ from bucket to bucket.
    drawn = [F.min_by("rep", F.xxhash64("rep", "key", F.lit(i))) for i in range(DRAWN_LEADERS)]
    leaders = (buckets.join(about.select("rep", "met"), "rep").groupBy("key")
               .agg(F.array_distinct(F.array(F.max_by("rep", F.struct("met", "rep")), *drawn)).alias("leaders")))
    led = (buckets.select("key", "rep").join(leaders, "key").select("rep", F.explode("leaders").alias("a"))
           .where("rep <> a").select("a", "rep").distinct())
    as_a = about.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    first = (led.join(about.select("rep", "n", "sketch"), "rep").join(as_a, "a").where(alike)
             .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct())
    links = cut(verified(first, docs, at_least))
    roots = components(links)

    # Round 2: members of one bucket that are still in different components.
    placed = (buckets.select("key", "rep").join(roots, F.col("rep") == F.col("id"), "left")
              .select("key", "rep", F.coalesce("root", "rep").alias("root")))
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    apart = cut(placed.join(mixed.join(leaders, "key"), "key").where(~F.array_contains("leaders", F.col("rep"))).drop("leaders"))
    wide = cut(wide_sketches(docs, cut(apart.select(F.col("rep").alias("id")).distinct()), by_count))
    left = apart.join(about.drop("met"), "rep").join(wide, "rep")
    right = left.select(F.col("key").alias("kb"), F.col("rep").alias("b"), F.col("n").alias("na"), F.col("sketch").alias("sa"),
                        F.col("root").alias("rb"), F.col("bands").alias("bb"), F.col("wide").alias("wb"))
    once = F.get(F.array_intersect("bands", "bb"), F.lit(0)) == F.col("key")  # a pair counts in its first common bucket
    apart_in = (F.col("key") == F.col("kb")) & (F.col("root") < F.col("rb"))
    rest = cut(left.join(right, apart_in & alike & wide_enough("wide", "wb", at_least) & once)
               .select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct())
    if rest.limit(1).count():
        more = cut(verified(rest, docs, at_least))
        roots = components(links.unionByName(more))

    of_text = (reps.select("h1", "h2", "rep").join(roots, F.col("rep") == F.col("id"), "left")
               .select("h1", "h2", F.coalesce("root", "rep").alias("class_id")))
    return signed.join(of_text, ["h1", "h2"], "left").select(
        "doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
