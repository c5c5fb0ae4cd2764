import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ticketlake.llm import masksearch as S

from .conftest import documents, words


def terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def by_definition(docs, items, k=50):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n_docs, n_words = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in wanted if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(spark, docs, items, **more):
    rows = S.ranked_search(docs, spark.createDataFrame(items, "item_id long, text string, block string, score string"), **more).collect()
    return sorted((tuple(r) for r in rows), key=str)


ITEMS = [(1, "The of AND read", "b", "s"), (2, None, "b", "s"), (3, "", "b", "s"), (4, "?!", "b", "s"), (5, "kůň žluťoučký 日本語 the", "b", "s"),
         (5, "x y z", "b", "s"), (None, "one don t stop", "b", "s"), (6, "İstanbul istanbul ω Ω", "b", "s"), (7, "nowheretobefound", "b", "s")]


@pytest.fixture(scope="module")
def some():
    rng = random.Random(11)
    docs = [(i, " ".join(words(rng, rng.choice([3, 40, 200])))) for i in range(400)]
    docs += [(i + 400, docs[0][1]) for i in range(70)]  # ties beyond the k-th place
    items = [(i, " ".join(words(rng, n)), "b", "s") for i, n in enumerate([1, 3, 30, 100, 400], 20)]
    return docs, items


@pytest.mark.parametrize("chars", [S.ITEM_CHARS, 50])
def test_edge_rows_match_the_definition(spark, edge_docs, edge_rows, chars):
    assert ranked(spark, edge_docs, ITEMS, item_chars=chars) == by_definition(edge_rows, [i[:2] for i in ITEMS])


@pytest.mark.parametrize("k", [1, 50])
def test_ranks_match_the_definition(spark, some, k, monkeypatch):
    docs, items = some
    assert ranked(spark, documents(spark, docs), items, k=k) == by_definition(docs, [i[:2] for i in items], k)


def test_empty_tables(spark, no_docs, edge_docs):
    assert ranked(spark, no_docs, ITEMS) == []
    assert ranked(spark, edge_docs, []) == []


def test_masks_of_many_terms():
    rng = np.random.default_rng(1)
    postings = [np.flatnonzero(rng.random(300) < 0.02) for _ in range(150)]
    masks = S.presence_masks(300, postings)
    group, first = S.mask_groups(masks)
    want = [tuple(j for j, p in enumerate(postings) if d in p) for d in range(300)]
    assert len(first) == len(set(want))
    assert all((group[a] == group[b]) == (want[a] == want[b]) for a in range(300) for b in range(a))
    assert all(want[first[group[d]]] == want[d] for d in range(300))


def test_search_ends_before_the_last_mask():
    """Rare terms give a few documents a score that no other mask reaches: the rest is not scored."""
    n = 5000
    common, rare = np.arange(n), np.arange(60)
    best = S.Best(50)
    scored = S.rank_block(best, np.arange(n), [common, rare], [np.full(n, 10), np.full(60, 1000)])
    assert scored < n and list(best.docs) == list(range(50)) and set(best.scores) == {1010}
    assert S.rank_block(best, np.arange(n, 2 * n), [common], [np.full(n, 10)]) == 0
