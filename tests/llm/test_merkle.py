import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from ticketlake.llm import merkle as M

from .conftest import documents


def h(data):
    return hashlib.sha256(data.encode()).hexdigest()


def leaf(r, more=0):
    n = None if r.n_chars is None else r.n_chars + more
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, n, r.text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def by_definition(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of every row."""
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, placed = [], []
    for lang in langs:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        placed.append(own)
        trees.append(levels([leaf(r) for r in own]))
    top = levels([t[-1][0] for t in trees]) if trees else []
    out = []
    for i, (own, tree) in enumerate(zip(placed, trees)):
        for j, r in enumerate(own):
            node = leaf(r, int(r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0))
            siblings = []
            for at, nodes in [*((j >> k, n) for k, n in enumerate(tree[:-1])), *((i >> k, n) for k, n in enumerate(top[:-1]))]:
                sib = nodes[at ^ 1] if at ^ 1 < len(nodes) else ""
                siblings.append(sib)
                node = h(sib + node if at % 2 else node + sib)
            root = top[-1][0]
            out.append((r.doc_id, leaf(r), tree[-1][0], root, h("".join(siblings)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [1, 2, 12])
def test_matches_the_definition(spark, edge_docs, span):
    rng = random.Random(span)
    many = documents(spark, [(i, f"text {i}") for i in rng.sample(range(1000), 77)])
    lang = F.element_at(F.array(*[F.lit(x) for x in ("de", "ž", "en", "A", None)]), (F.crc32("text") % 5 + 1).cast("int"))
    docs = edge_docs.unionByName(many).withColumn("lang", lang)
    got = sorted((tuple(r) for r in M.verify_manifest(docs, span).collect()), key=str)
    want = by_definition(docs.collect())
    assert got == want
    assert {v for *_, v in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_small_trees(spark, n):
    docs = documents(spark, [(i, "x") for i in range(n)])
    assert sorted((tuple(r) for r in M.verify_manifest(docs).collect()), key=str) == by_definition(docs.collect())


def test_witness_grows_by_appends():
    nodes = [h(str(i)) for i in range(11)]
    for n in range(1, 12):
        frontier = M.Frontier()
        for x in nodes[:n]:
            frontier.append(x)
        root = frontier.close(None)
        assert root == levels(nodes[:n])[-1][0]
        for i in range(n):
            node = nodes[i]
            for step in frontier.witness[i]:
                node = h(step[1:] + node if step[:1] == "L" else node + step[1:])
            assert node == root


def test_a_changed_document_does_not_verify(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    m = M.build_manifest(docs, {"other": M.leaf_digest(M.document_columns(docs) | {"text": F.concat(docs["text"], F.lit("!"))})})
    r = m.agg(F.count_if(M.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("good"),
              F.count_if(M.folded(F.col("other"), F.col("path")) == F.col("root")).alias("bad")).first()
    assert (r.good, r.bad) == (20, 0)


def test_no_documents(spark, no_docs):
    out = M.verify_manifest(no_docs)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and out.count() == 0
