from collections import Counter

import public_tokenizers
import pytest

from ticketlake.llm.queries import QUERIES
from ticketlake.llm.tokencount import PLAIN_BELOW, pretokens, token_counts, tokenizer

from .conftest import SF001

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return len(tokenizer(PATH).encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("shape", ["{}", "a{}b", " {} ", "{0}{0}1", "1{0}\n{0}", "'{}s", "{}  {}"])
def test_pretokens_of_every_plain_character(shape):
    for c in range(1, PLAIN_BELOW + 60):
        text = shape.replace("{0}", "{}").replace("{}", chr(c))
        want = [text[a:b] for _, (a, b) in tokenizer(PATH).pre_tokenizer.pre_tokenize_str(text)]
        assert pretokens(text, PATH)[0] == want


def test_edge_rows(spark, edge_rows, edge_docs, no_docs):
    got = Counter(tuple(r) for r in token_counts(edge_docs, PATH).collect())
    want = Counter((i, len((t or "").encode()), library(t), library(t) > 1024) for i, t in edge_rows)
    assert got == want
    assert token_counts(no_docs, PATH).collect() == []


def test_query_equals_library(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_token_counts"](spark, SF001).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library(t) for i, t in docs.items()}
