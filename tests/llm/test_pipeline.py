import random

import corpus_pipeline as P
from ticketlake.llm.queries import ORACLES, QUERIES

from .conftest import SF001, documents, words


def test_stages_keep_columns_and_take_effect(spark, tmp_path, edge_rows):
    rng = random.Random(3)
    item = " ".join(words(rng, 40))
    rows = [*[(i, t) for i, t in edge_rows], (100, "a leak " + item), (101, "line one of some text\nshared line of many words"),
            (102, "shared line of many words\nother things entirely")]
    for i in range(200, 500):
        text = words(rng, 60)
        if i % 6 == 0:
            text[::15] = ["vexling"] * len(text[::15])
        rows.append((i, " ".join(text)))
    docs = documents(spark, rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(200, 500)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    columns, now = docs.dtypes, docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            break
        assert now.dtypes == columns, name
        ids = {r.doc_id for r in now.collect()}
        if name == "toxicity":
            held = [i for i in range(200, 500)]
            assert sum((i in ids) == (i % 6 != 0) for i in held) >= 0.97 * len(held)
        if name == "line_dedup":
            texts = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
            assert texts[102] == ("other things entirely", 21) and texts[101][0].startswith("line one")
            assert now.count() == before.count()
        if name == "near_dedup":
            assert {4, 6, 100} <= ids and None in ids
            assert now.where("doc_id = 4").count() == 1
        if name == "decontamination":
            assert 100 not in ids and 101 in ids
    assert {r.doc_id for r in now.select("doc_id").distinct().collect()} == {r.doc_id for r in before.select("doc_id").distinct().collect()}


def test_registered():
    import __spark_entry__ as E
    assert E.queries()["pipeline"] is P.run
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_empty_table_passes_all_stages(spark, tmp_path):
    now = documents(spark, [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in P.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.collect() == []


def test_rows_are_judged_for_their_own_text(spark, tmp_path):
    rng = random.Random(11)
    one, two, three = (" ".join(words(rng, 80)) for _ in range(3))
    rows = [(1, one), (2, one), (2, two), (2, two), (3, None), (3, ""), (3, three), (None, one), (None, None), (None, "own words")]
    got = P.near_dedup(spark, documents(spark, rows), "").collect()
    want = [(1, one), (2, two), (3, None), (3, ""), (3, three), (None, None), (None, "own words")]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)

    rows = []
    for i in range(300):
        text = words(rng, 60)
        if i % 6 == 0:
            text[::15] = ["vexling"] * len(text[::15])
        rows.append((i, " ".join(text)))
    spark.createDataFrame([(i, 0, int(i % 6 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    bad = " ".join(["vexling"] * 8 + words(rng, 60))
    rows += [(900, bad), (900, one), (None, bad), (None, two)]
    left = {(r.doc_id, r.text) for r in P.toxicity(spark, documents(spark, rows), str(tmp_path)).collect()}
    assert {(900, one), (None, two)} <= left and not {(900, bad), (None, bad)} & left


def test_stages_by_definition(spark):
    """The chain on a whole small table, every stage recomputed from its own input in plain Python."""
    from ticketlake.llm import decontam as D

    from .test_linededup import by_definition as deduplicated
    from .test_neardup import classes_by_definition
    from .test_toxicity import scores_by_definition
    table = lambda name: spark.read.parquet(f"{SF001}/{name}.parquet")
    now = table("documents")
    text_of = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    stages = dict(P.STAGES)

    rows = text_of(now)
    labels = [(r.doc_id, r.toxic) for r in table("labels").collect()]
    now = stages["toxicity"](spark, now, SF001).checkpoint()
    scores = scores_by_definition(rows, labels)
    assert min(abs(s - 0.5) for _, s in scores) > 1e-3  # no score on the edge
    assert text_of(now) == [r for r, (_, s) in zip(rows, scores) if s < 0.5]

    rows = text_of(now)
    now = stages["line_dedup"](spark, now, SF001).checkpoint()
    assert text_of(now) == sorted(deduplicated(rows))

    rows = text_of(now)
    now = stages["near_dedup"](spark, now, SF001).checkpoint()
    classes = classes_by_definition(rows)
    assert text_of(now) == [(i, t) for i, t in rows if classes[i] == i]

    rows = text_of(now)
    items = [D.normal(r.text) for r in table("benchmark").collect()]

    def holds(text):
        for item in items:
            edits = int(len(item) * D.RATE)
            if item and D.best_end(D.masks_of(item), len(item), text, edits):
                return True
        return False

    now = stages["decontamination"](spark, now, SF001).checkpoint()
    assert min(map(len, items)) > 1 / D.RATE
    assert text_of(now) == [(i, t) for i, t in rows if not holds(D.normal(t))]

    packed = stages["packing"](spark, now, SF001)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}
