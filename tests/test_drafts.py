"""Context formatting, prompt assembly and local drafts."""

from pyspark.sql import functions as F

from ticketlake.operators import drafts

CTX = "array<struct<rank:bigint,ticket_id:string,assigned_team:string,similarity_score:double,description:string>>"


def frame(spark, desc, ctx):
    return spark.createDataFrame([("q", desc, ctx)], f"ticket_id string, description string, context {CTX}")


def test_format_and_draft(spark):
    ctx = [(1, "T-1", "Brake Systems", 0.98765, "pads worn"), (2, "T-2", "", 0.5, "other"),
           (3, "T-3", "X", 0.1, "third")]
    r = frame(spark, "  Brakes squeal\nwhen cold  ", ctx).select(
        drafts.format_context(F.col("context")).alias("c"),
        drafts.local_draft(F.col("description"), F.col("context")).alias("d")).first()
    assert r["c"].split("\n")[0] == ("1. ticket_id=T-1; assigned_team=Brake Systems; similarity_score=0.9877; "
                                     "description=pads worn")
    assert "Summary: Brakes squeal when cold\n" in r["d"]
    assert "Recommended owner: Brake Systems" in r["d"]
    assert r["d"].endswith("Related ticket signals: T-1 (Brake Systems), T-2.")


def test_no_context_and_truncation(spark):
    long = "word " * 46 + "end"     # 233 characters
    r = frame(spark, long, []).select(
        drafts.format_context(F.col("context")).alias("c"),
        drafts.local_draft(F.col("description"), F.col("context")).alias("d")).first()
    assert r["c"] == drafts.NO_CONTEXT_TEXT
    summary = r["d"].split("Summary: ")[1].split("\n")[0]
    assert summary == long[:217].rstrip() + "..."
    assert "Recommended owner: Support Team" in r["d"]
    assert r["d"].endswith("Related ticket signals: No close historical matches were found.")


def test_prompt(spark):
    r = frame(spark, "x", []).select(drafts.build_prompt(F.col("description"), F.lit("CTX")).alias("p")).first()
    assert "Ticket:\nx\n" in r["p"] and "Similar cases:\nCTX\n" in r["p"]


def test_retrieval_and_generator_fallback(spark):
    corpus = spark.createDataFrame(
        [("c1", "brake pads worn", "Brakes"), ("c2", "brake pads worn", "Brakes"), ("c0", "brake pads worn", "B2"),
         ("c3", "battery dead", "Electrical"), ("c4", None, "Other")],
        "ticket_id string, description string, assigned_team string")
    queries = spark.createDataFrame([("q1", " brake pads worn "), ("q2", "   "), ("q3", None)],
                                    "ticket_id string, description string")
    ctx = drafts.retrieve_context(queries, corpus)
    got = {r["ticket_id"]: [c["ticket_id"] for c in r["context"]] for r in ctx.collect()}
    assert got == {"q1": ["c0", "c1", "c2"]}

    def broken(prompts):
        raise RuntimeError("offline")
    out = drafts.draft_table(ctx, broken).first()
    assert out["llm_available"] is False and "offline" in out["llm_error"]
    ok = drafts.draft_table(ctx, lambda ps: ["reply"] * len(ps)).first()
    assert ok["suggested_response"] == "reply" and ok["llm_available"] is True


def test_every_term_counts(spark):
    """More distinct words than any fixed vocabulary; each query must find its own word."""
    corpus = spark.createDataFrame([(f"c{i:05d}", f"common w{i:05d}", "T") for i in range(4200)],
                                   "ticket_id string, description string, assigned_team string")
    queries = spark.createDataFrame([("q1", "common w04199"), ("q2", "\n\t"), ("q3", "nothing shared here"), ("q4", "\tcommon\n")],
                                    "ticket_id string, description string")
    got = {r["ticket_id"]: [c["ticket_id"] for c in r["context"]] for r in drafts.retrieve_context(queries, corpus).collect()}
    assert got["q1"][0] == "c04199" and got["q1"][1:] == ["c00000", "c00001"]
    assert got["q3"] == got["q4"] == ["c00000", "c00001", "c00002"] and "q2" not in got


def test_retrieval_equals_brute_force(spark):
    import math
    import random
    from collections import Counter
    rng = random.Random(1)
    words = [f"w{int(rng.paretovariate(0.6)) % 300:03d}" for _ in range(4000)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 12))) for _ in range(300)]
    corpus = [(f"c{i:04d}", texts[i % 250], "T") for i in range(300)]
    queries = [(f"q{i}", " ".join(rng.sample(words, 5))) for i in range(30)]
    df = Counter(t for _, d, _ in corpus for t in set(d.split()))
    idf = {t: math.log((1 + len(corpus)) / (1 + n)) + 1 for t, n in df.items()}

    def vector(d):
        w = {t: n * idf[t] for t, n in Counter(d.split()).items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        return {t: x / norm for t, x in w.items()}

    vectors = {d: vector(d) for _, d, _ in corpus}
    want = {}
    for q, d in queries:
        v = vector(d)
        score = {d2: round(sum(x * w.get(t, 0) for t, x in v.items()), 10) for d2, w in vectors.items()}
        want[q] = [c for c, _, _ in sorted(corpus, key=lambda r: (-score[r[1]], r[0]))[:3]]
    c = spark.createDataFrame(corpus, "ticket_id string, description string, assigned_team string")
    q = spark.createDataFrame(queries, "ticket_id string, description string")
    got = {r["ticket_id"]: [x["ticket_id"] for x in r["context"]] for r in drafts.retrieve_context(q, c).collect()}
    assert got == want


def test_placeholder_inside_a_ticket_stays(spark):
    r = frame(spark, "  see {context_tickets} \n", []).select(drafts.build_prompt(F.col("description"), F.lit("CTX")).alias("p")).first()
    assert r["p"].count("CTX") == 1 and "Ticket:\nsee {context_tickets}\n" in r["p"]


def test_one_failing_prompt_falls_back_alone(spark):
    ctx = spark.createDataFrame([("a", "good", []), ("a", "good", []), ("b", "bad", [])],
                                f"ticket_id string, description string, context {CTX}").coalesce(1)

    def generator(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["fine"] * len(prompts)

    rows = drafts.draft_table(ctx, generator).collect()
    assert sorted((r["ticket_id"], r["llm_available"]) for r in rows) == [("a", True), ("a", True), ("b", False)]
