"""Batch reply drafts: retrieve similar closed tickets, format context, build
a prompt and a local draft (or call a supplied generator per partition).

Retrieval works on distinct texts over the corpus's whole vocabulary (see
``textsearch``): tickets with the same text get the same
context, and since equal texts score equally, each distinct corpus text only
needs its k smallest ticket ids (ties go to the smaller id), so the search
runs over distinct query texts x (distinct corpus texts, <= k ids each) and
is still exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import round_half_up
from ..plans.session import reliable_checkpoint
from . import textsearch

CONTEXT_K = 3
SUMMARY_MAX = 220

# Fallback texts, draft steps and the prompt template.
NO_CONTEXT_TEXT = "No similar historical tickets were found."
NO_MATCH_TEXT = "No close historical matches were found"
DEFAULT_OWNER = "Support Team"
NEXT_STEPS = [
    "Confirm the exact symptoms, scope, and first observed timestamp.",
    "Collect logs/screenshots and any recent changes before the issue started.",
    "Apply standard diagnostics and provide an ETA for the next update.",
]
PROMPT_TEMPLATE = (
    "[INST]\n"
    "You are helping a support agent respond to a ticket.\n"
    "Use the ticket and similar cases to draft a concise, practical reply.\n"
    "Do not invent facts. If information is missing, say what should be confirmed.\n"
    "\n"
    "Ticket:\n"
    "{ticket_description}\n"
    "\n"
    "Similar cases:\n"
    "{context_tickets}\n"
    "\n"
    "Write only the suggested response with:\n"
    "1. Diagnosis summary\n"
    "2. Immediate steps\n"
    "3. Follow-up recommendation\n"
    "[/INST]\n"
)
EMPTY_REPLY = "No suggestion returned by the language model."
FALLBACK_REASON = "Using local fallback draft"


def _strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def retrieve_context(queries: DataFrame, corpus: DataFrame, k: int = CONTEXT_K) -> DataFrame:
    """Top-k similar corpus tickets per query ticket.

    queries: (ticket_id, description); corpus: (ticket_id, description, assigned_team).
    Returns (ticket_id, description, context): the stripped text and an
    array<struct<rank, ticket_id, assigned_team, similarity_score, description>>
    sorted by rank; ties go to the smaller id, and tickets that share no word
    with the query fill up by id.  Texts of white space only give no row.
    """
    # Several jobs run over these narrow text tables; a reliable checkpoint of
    # each cuts lineage so the upstream ticket pipeline runs once.
    q = reliable_checkpoint(
        queries.select("ticket_id", _strip(F.coalesce(F.col("description"), F.lit(""))).alias("description"))
        .filter(F.length("description") > 0).withColumn("query_key", F.md5("description")))
    c = reliable_checkpoint(
        corpus.select("ticket_id", F.coalesce(F.col("description"), F.lit("")).alias("description"),
                      F.coalesce(F.col("assigned_team"), F.lit("")).alias("assigned_team"))
        .withColumn("key", F.md5("description")))
    texts = c.groupBy("key").agg(F.first("description").alias("text"), F.min("ticket_id").alias("first_id"))
    asked = q.groupBy(F.col("query_key").alias("key")).agg(F.first("description").alias("text"))
    found = textsearch.top_k_texts(asked, texts, textsearch.smooth_idf(c, "description"), k)
    w = Window.partitionBy("key").orderBy("ticket_id")
    reps = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    positive = found.join(reps, "key").select("query_key", "ticket_id", "assigned_team", "description", "score")
    # Of tickets without a common word only the least 2k ids can be needed: at
    # most k of those ids score above zero.
    fill = c.orderBy("ticket_id").limit(2 * k).select("ticket_id", "assigned_team", "description", F.lit(0.0).alias("score"))
    zero = asked.select(F.col("key").alias("query_key")).crossJoin(F.broadcast(fill))
    best = Window.partitionBy("query_key").orderBy(F.desc("score"), "ticket_id")
    hits = (positive.unionByName(zero).groupBy("query_key", "ticket_id")
            .agg(F.max("score").alias("score"), F.first("assigned_team").alias("assigned_team"), F.first("description").alias("description"))
            .withColumn("rank", F.row_number().over(best).cast("bigint")).filter(F.col("rank") <= k))
    ctx = hits.groupBy("query_key").agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), F.col("ticket_id"), F.col("assigned_team"), round_half_up("score", 4).alias("similarity_score"),
        F.col("description")))).alias("context"))
    joined = q.join(ctx, "query_key", "left")
    return joined.select("ticket_id", "description",
                         F.coalesce("context", F.array().cast(joined.schema["context"].dataType)).alias("context"))


def format_context(context: Column) -> Column:
    """Numbered context lines (score with 4 decimals), newline-joined."""
    lines = F.transform(context, lambda t, i: F.format_string(
        "%d. ticket_id=%s; assigned_team=%s; similarity_score=%.4f; description=%s",
        i + 1, F.coalesce(t["ticket_id"], F.lit("-")), F.coalesce(t["assigned_team"], F.lit("-")),
        F.coalesce(t["similarity_score"], F.lit(0.0)), F.coalesce(t["description"], F.lit(""))))
    return F.when(F.size(context) > 0, F.array_join(lines, "\n")).otherwise(F.lit(NO_CONTEXT_TEXT))


def build_prompt(description: Column, context_text: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """The template with its two placeholders filled; a placeholder inside a ticket's text stays as it is."""
    values = {"{ticket_description}": _strip(description), "{context_tickets}": context_text}
    parts = re.split("(" + "|".join(map(re.escape, values)) + ")", template)
    return F.concat(*[values.get(p, F.lit(p)) for p in parts if p])


def local_draft(description: Column, context: Column) -> Column:
    """Deterministic draft: summary (newlines -> spaces; over 220 characters ->
    first 217, right-trimmed, '...'), owner = first context team or the default,
    up to two 'id (team)' references."""
    s = F.replace(_strip(F.coalesce(description, F.lit(""))), F.lit("\n"), F.lit(" "))
    summary = F.when(F.length(s) > SUMMARY_MAX,
                     F.concat(F.regexp_replace(F.substring(s, 1, SUMMARY_MAX - 3), r"\s+$", ""), F.lit("...")))\
        .otherwise(s)
    first_team = _strip(F.coalesce(context[0]["assigned_team"], F.lit("")))
    owner = F.when((F.size(context) > 0) & (F.length(first_team) > 0), first_team).otherwise(F.lit(DEFAULT_OWNER))

    def ref(t):
        tid, team = _strip(F.coalesce(t["ticket_id"], F.lit(""))), _strip(F.coalesce(t["assigned_team"], F.lit("")))
        return (F.when((F.length(tid) > 0) & (F.length(team) > 0), F.concat(tid, F.lit(" ("), team, F.lit(")")))
                .when(F.length(tid) > 0, tid))

    refs = F.array_join(F.transform(F.slice(context, 1, 2), ref), ", ")
    refs = F.when(F.size(context) > 0, refs).otherwise(F.lit(NO_MATCH_TEXT))
    return F.concat(
        F.lit("Thanks for reporting this issue.\n\nSummary: "), summary,
        F.lit("\nRecommended owner: "), owner,
        F.lit("\n\nProposed next steps:\n"),
        F.lit(f"1. {NEXT_STEPS[0]}\n2. {NEXT_STEPS[1]}\n3. {NEXT_STEPS[2]}\n\nRelated ticket signals: "),
        refs, F.lit("."))


def draft_table(with_context: DataFrame, generator: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(ticket_id, suggested_response, context, llm_available, llm_error).

    ``generator`` (optional) maps a list of prompts to a list of replies; it runs
    batch-wise inside ``mapInPandas``.  Empty replies get a fixed text; a failing
    batch is tried prompt by prompt, and a failing prompt falls back to its
    local draft with the error recorded.
    """
    base = with_context.select(
        "ticket_id", "description", "context",
        build_prompt(F.col("description"), format_context(F.col("context"))).alias("_prompt"),
        local_draft(F.col("description"), F.col("context")).alias("_local"))
    if generator is None:
        return base.select("ticket_id", F.col("_local").alias("suggested_response"), "context",
                           F.lit(False).alias("llm_available"), F.lit(FALLBACK_REASON).alias("llm_error"))
    schema = T.StructType([
        T.StructField("ticket_id", base.schema["ticket_id"].dataType),
        T.StructField("suggested_response", T.StringType()),
        T.StructField("context", base.schema["context"].dataType),
        T.StructField("llm_available", T.BooleanType()),
        T.StructField("llm_error", T.StringType()),
    ])

    def reply(prompts, locals_):
        """(text, available, error) per prompt; a failing batch is tried prompt by prompt."""
        try:
            out = list(generator(prompts))
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} replies to {len(prompts)} prompts")
            return [((str(x).strip() if x is not None else "") or EMPTY_REPLY, True, None) for x in out]
        except Exception as exc:  # noqa: BLE001 - any generator failure falls back
            if len(prompts) == 1:
                return [(locals_[0], False, f"External generator unavailable, using local fallback draft. Reason: {exc}")]
            return [r for p, x in zip(prompts, locals_, strict=True) for r in reply([p], [x])]

    def run(batches):
        for pdf in batches:
            got = reply(pdf["_prompt"].tolist(), pdf["_local"].tolist())
            yield pd.DataFrame({"ticket_id": pdf["ticket_id"], "suggested_response": [r[0] for r in got], "context": pdf["context"],
                                "llm_available": [r[1] for r in got], "llm_error": [r[2] for r in got]})

    return base.select("ticket_id", "_prompt", "_local", "context").mapInPandas(run, schema)
