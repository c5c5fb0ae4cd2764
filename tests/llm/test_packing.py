import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ticketlake.llm import packing
from ticketlake.llm.queries import QUERIES

from .conftest import SF001, documents

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]


def check(rows, texts, capacity=4096):
    """Every id in exactly one piece, checksums right, sequences gapless and within capacity; returns the padding share."""
    want = Counter()
    for i, text in texts:
        x = ids(text)
        for a in range(0, len(x), capacity):
            piece = x[a:a + capacity]
            want[(i, a, len(piece), zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)), len(x))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    used = padded = 0
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
        used += at
        padded += at if at & (at - 1) == 0 else capacity
    return 1 - used / padded if padded else 0.0


def test_id_bytes_equal_library(edge_rows):
    for _, t in edge_rows:
        assert packing.id_bytes([t or ""], PATH, 2) == [struct.pack(f"<{len(ids(t))}I", *ids(t))]
    for c in [*range(1, 0x260), 0x300, 0x301, 0x3a3, 0x212a, 0x2028, 0x3000]:
        for text in (chr(c), f"a{chr(c)}b", f"A{chr(c)} {chr(c)}e", f"'{chr(c)}'S 1{chr(c)}2", f"{chr(c)}<|endoftext|>"):
            assert packing.id_bytes([text], PATH, 2) == [struct.pack(f"<{len(ids(text))}I", *ids(text))], hex(c)


def test_edge_rows(edge_rows, edge_docs, no_docs):
    check(packing.pack_documents(edge_docs, PATH).collect(), edge_rows)
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_one_length_and_many_copies(spark):
    rows = [(i % 50, "th er " * 40) for i in range(400)]
    assert check(packing.pack_documents(documents(spark, rows), PATH).collect(), rows) < 0.03


def test_query_packs_tightly(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert check(QUERIES["op1_packing"](spark, SF001).collect(), texts) < 0.03


def test_column_generation_near_material_bound():
    rng = random.Random(3)
    sizes = sorted(rng.sample(range(5, 200), 40))
    demand = [rng.randint(50, 400) for _ in sizes]
    patterns, amounts = packing.column_generation(np.array(sizes), np.array(demand, float), 512)
    assert np.allclose(patterns.T @ amounts, demand)
    assert (patterns @ np.array(sizes) <= 512).all()
    bound = np.dot(sizes, demand) / 512
    assert bound - 1e-6 <= amounts.sum() <= bound * 1.01
    plan = packing.plan(sizes, demand, 512)
    made = Counter()
    for pattern, times in plan:
        assert sum(s * a for s, a in pattern.items()) <= 512
        for s, a in pattern.items():
            made[s] += a * times
    assert made == dict(zip(sizes, demand, strict=True))
    assert sum(t for _, t in plan) <= bound * 1.02 + 2


def test_knapsack_against_brute_force():
    sizes, prices = np.array([3, 5, 7]), np.array([0.31, 0.55, 0.7])
    value, patterns = packing.best_patterns(prices, sizes, 23)
    best = max(a * .31 + b * .55 + c * .7 for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= 23)
    assert abs(value - best) < 1e-9
    assert abs(max(p @ prices for p in patterns) - best) < 1e-9
