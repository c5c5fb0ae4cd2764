import re

from ticketlake.llm import licenses as L
from ticketlake.llm.queries import QUERIES

from .conftest import SF001, documents


def by_definition(rows, notices=L.NOTICES, share=L.CONTAINED):
    """(doc, template) whose shingles the whole text holds, best of each family."""
    found = {}
    sets = []
    for ti, (_, t) in enumerate(notices):
        w = L.words_of(t)
        k = min(L.SHINGLE, len(w))
        sets.append((ti, k, {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()))
    for doc, text in rows:
        w = L.words_of(text or "")
        for ti, k, grams in sets:
            if grams:
                c = len(grams & {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) / len(grams)
                if c >= share:
                    found[(doc, ti)] = max(c, found.get((doc, ti), 0))
    return found


def test_query_equals_whole_text_containment(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op7_licenses"](spark, SF001).collect()
    want = by_definition(docs)
    got = {(r.doc_id, r.template_id): r.containment for r in rows}
    assert got.items() <= want.items()
    assert {d for d, _ in got} == {d for d, _ in want}  # what is missing is a worse version of a reported license
    assert all(want[d, t] >= max(c for (x, _), c in want.items() if x == d) or c == 1 for (d, t), c in got.items())


def test_every_notice_is_found_alone_and_edited(spark):
    rows = []
    for i, (_, t) in enumerate(L.NOTICES):
        rows.append((i, f"some words before\n{t}\nand after"))
        w = t.split()
        if len(w) > 40:
            w[20] = "changed"
            rows.append((100 + i, "intro text here " + " ".join(w).upper()))
    got = {(r.doc_id, r.template_id) for r in L.scan_licenses(documents(spark, rows)).collect()}
    for i, _ in rows:
        assert (i, i % 100) in got, L.NOTICES[i % 100]


def test_edge_rows(spark, edge_rows, edge_docs, no_docs):
    assert L.scan_licenses(edge_docs).collect() == []
    assert L.scan_licenses(no_docs).collect() == []
    assert L.scan_licenses(edge_docs, []).collect() == []
    assert L.scan_licenses(edge_docs, [("x", ""), ("y", "!!")]).collect() == []
    text = "All rights reserved. " * 3
    rows = [(1, text), (1, text), (None, text), (2, "all rights" * 3)]
    got = sorted((str(r.doc_id), r.license, r.first_word) for r in L.scan_licenses(documents(spark, rows)).collect())
    assert got == [("1", "proprietary", 0), ("None", "proprietary", 0)]


def test_anchors_leave_too_little_of_every_notice():
    words = [L.words_of(t) for _, t in L.NOTICES]
    chosen = set(L.anchors(words, L.SHINGLE, L.CONTAINED))
    for w in words:
        k = min(L.SHINGLE, len(w))
        grams = [w[i:i + k] for i in range(len(w) - k + 1)]
        assert sum(not set(g) & chosen for g in grams) < L.CONTAINED * len(grams)


def test_native(spark):
    plan = QUERIES["op7_licenses"](spark, SF001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
