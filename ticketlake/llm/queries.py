"""The thin queries over the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import read_table
from . import linededup, masksearch, merkle, mixing
from .annforest import nearest
from .decontam import find_contamination
from .htmltext import extract_pages
from .licenses import scan_licenses
from .nearup import near_duplicates
from .packing import pack_documents
from .secretscan import scan_secrets
from .tokencount import token_counts
from .toxicity import score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@register("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op1_packing")
def op1(spark, sf_dir):
    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op4_secrets")
def op4(spark, sf_dir):
    return scan_secrets(read_table(spark, sf_dir, "documents"))


@register("op10_near_duplicates")
def op10(spark, sf_dir):
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@register("op2_toxicity")
def op2(spark, sf_dir):
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op3_decontamination")
def op3(spark, sf_dir):
    return find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op8_line_dedup", linededup.oracle())
def op8(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.drop_recurring_lines(docs)


@register("op9_html_extraction")
def op9(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))


@register("op5_nearest_neighbours")
def op5(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return nearest(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


@register("op7_licenses")
def op7(spark, sf_dir):
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@register("op11_merkle_manifest", merkle.oracle())
def op11(spark, sf_dir):
    return merkle.verify_manifest(read_table(spark, sf_dir, "documents"))


@register("op12_ranked_search", masksearch.oracle())
def op12(spark, sf_dir):
    return masksearch.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op13_mixing", mixing.oracle())
def op13(spark, sf_dir):
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
