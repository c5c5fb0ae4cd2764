"""Token counts per document: pieces counted once per distinct pre-token.

One scan cuts the documents into blocks and gathers each block's pre-token
frequencies, split by a hash of the pre-token into buckets and packed by column
(a row per block and bucket, not per document and pre-token, which would shuffle
more bytes than the texts have).  A bucket holds every occurrence of its
pre-tokens: there the distinct ones are counted once, in one batch, joined to
the frequencies, and summed per document.  The sums of a block's buckets are
added in a last group per block.  Token ids are never kept.

The number of buckets follows ``spark.sql.shuffle.partitions``, so a bucket is
a fraction of a task's data.  A pre-token in every document is one short entry
per block.

Edge rows: null and empty texts have 0 bytes and 0 tokens; repeated rows (also
of one ``doc_id``, also null) each give a row; an empty table gives no rows;
further columns of ``docs`` are not read; a text of any length is one entry.
``docs`` must give the same rows in the same order when a lost task runs again,
as a table scan or a checkpoint does.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .blocks import SUMS, Numbered, add_blocks, bucket_count, bucket_sums, packed_frequencies, texts_of

OVER = 1024
# Texts below this code point take the pattern with spelled-out classes; for
# others the tokenizer's own pre-tokenizer decides.
PLAIN_BELOW = 0x250


@cache
def tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def special_strings(path: str) -> re.Pattern | None:
    """Pattern of the added tokens, longest first, or None."""
    added = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None


@cache
def plain_pattern() -> re.Pattern:
    """The byte-level pre-token pattern with classes listed below ``PLAIN_BELOW``."""
    def members(cls):
        return "".join(re.escape(chr(c)) for c in range(PLAIN_BELOW) if regex.fullmatch(cls, chr(c)))
    let, num, space = members(r"\p{L}"), members(r"\p{N}"), members(r"\s")
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{let}]+| ?[{num}]+| ?[^{space}{let}{num}]+"
                      rf"|[{space}]+(?![^{space}])|[{space}]+")


_HIGH = re.compile(f"[^\x00-{chr(PLAIN_BELOW - 1)}]")


def pretokens(text: str, path: str) -> tuple[list[str], int]:
    """Pre-tokens of a text and the number of special strings between them."""
    special = special_strings(path)
    parts = special.split(text) if special else [text]
    out: list[str] = []
    for part in parts:
        if not part:
            continue
        if _HIGH.search(part) is None:
            out += plain_pattern().findall(part)
        else:
            out += [part[a:b] for _, (a, b) in tokenizer(path).pre_tokenizer.pre_tokenize_str(part)]
    return out, len(parts) - 1


def token_counts(docs: DataFrame, path: str, over: int = OVER) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > ``over``) of every text.

    ``path`` names a byte-level BPE file of the tokenizers library.
    """
    buckets = bucket_count(docs.sparkSession)

    def describe(part):
        number, ids, lens, special, size = Numbered(), [], [], [], []
        for t in part.column("text").to_pylist():
            toks, extra = pretokens(t, path)
            ids.append(np.fromiter(map(number.__getitem__, toks), np.int32, len(toks)))
            lens.append(len(toks))
            special.append(extra)
            size.append(len(t.encode("utf-8", "surrogatepass")))
        head = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size, pa.int64()), pa.array(special, pa.int64())],
                                          ["doc_id", "n_bytes", "special"])
        of = np.fromiter((xxhash.xxh3_64_intdigest(k) % buckets for k in number), np.int32, len(number))
        return head, pa.array(list(number), pa.string()), of, np.concatenate(ids), np.repeat(np.arange(len(lens)), lens)

    def pieces(keys: pa.Array) -> np.ndarray:
        texts, out = keys.to_pylist(), []
        for a in range(0, len(texts), 50_000):
            out += [len(e) for e in tokenizer(path).encode_batch_fast(texts[a:a + 50_000], add_special_tokens=False)]
        return np.array(out, np.int64)

    def finish(head, total):
        total = total.astype(np.int64) + head.column("special").to_numpy()
        return pa.table({"doc_id": head.column("doc_id"), "n_bytes": head.column("n_bytes"),
                         "n_tokens": pa.array(total, pa.int64()), "over_limit": pa.array(total > over)})

    sums = packed_frequencies(texts_of(docs), describe, buckets).groupBy("bucket").applyInArrow(
        lambda table: bucket_sums(table, pieces, "<u4"), SUMS)
    return add_blocks(sums, "<u4", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", finish)
