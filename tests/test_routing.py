"""Routing on the 30-row fixture (3 teams x 2 descriptions x 5 repeats)."""

import math

import pytest

from ticketlake.operators import routing

TEXTS = {
    "Network": ["VPN connection drops every hour", "Cannot reach the internal network share"],
    "Billing": ["Invoice amount is wrong this month", "Refund was not applied to my invoice"],
    "Hardware": ["Laptop screen flickers after update", "Keyboard keys stopped working on laptop"],
}


@pytest.fixture(scope="module")
def fixture_df(spark):
    rows, i = [], 0
    for team, texts in TEXTS.items():
        for t in texts:
            for _ in range(5):
                rows.append((f"t{i}", t, team))
                i += 1
    return spark.createDataFrame(rows, "ticket_id string, description string, assigned_team string")


@pytest.fixture(scope="module")
def trained(spark, fixture_df, tmp_path_factory):
    return routing.train_routing(spark, fixture_df, str(tmp_path_factory.mktemp("model")))


def test_train_outputs(trained):
    acc = trained.accuracy.first()["accuracy"]
    assert 0.0 <= acc <= 1.0
    assert trained.model.labels == ["Billing", "Hardware", "Network"]
    assert trained.importance.count() > 0
    assert trained.summary.first()["routing_trained"] is True
    assert sum(r["n"] for r in trained.confusion.collect()) == 6   # ceil(0.2 * 10) = 2 per team


def test_predict(spark, trained):
    q = spark.createDataFrame([("q1", "VPN keeps dropping"), ("q2", None)], "ticket_id string, description string")
    rows = {r["ticket_id"]: r for r in routing.predict(trained.model, q).collect()}
    assert rows["q1"]["predicted_team"] == "Network"
    assert 0.0 <= rows["q1"]["confidence"] <= 1.0
    assert set(rows["q1"]["team_scores"]) == set(TEXTS)
    assert abs(sum(rows["q1"]["team_scores"].values()) - 1.0) < 1e-9
    assert rows["q2"]["predicted_team"] in TEXTS


def test_model_roundtrip(spark, trained, tmp_path):
    p = str(tmp_path / "m")
    trained.model.save(p)
    m = routing.RoutingModel.load(p)
    assert m.labels == trained.model.labels and m.vocabulary == trained.model.vocabulary


def test_missing_team_rejected(spark):
    df = spark.createDataFrame([("a",)], "description string")
    with pytest.raises(routing.RoutingDataError):
        routing.training_frame(df)
    one = spark.createDataFrame([("a", "x"), ("b", "x")], "description string, assigned_team string")
    with pytest.raises(routing.RoutingDataError):
        routing.training_frame(one)
    res = routing.train_routing(spark, df)
    assert res.model is None and res.summary.first()["routing_trained"] is False


def test_split_matches_brute_force(spark):
    import hashlib
    rows = [(f"id{i}", ["A", "B", "C"][i % 3] if i % 7 else "A") for i in range(3000)]
    df = spark.createDataFrame(rows, "ticket_id string, assigned_team string")
    got = {r["ticket_id"] for r in routing.stratified_split(df).filter("is_test").collect()}
    want = set()
    for team in "ABC":
        ids = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for i, t in rows if t == team)
        want |= {i for _, i in ids[:math.ceil(0.2 * len(ids))]}
    assert got == want


def test_tfidf_matches_smooth_idf(spark, fixture_df):
    _, cv, scaling = routing.fit_tfidf(fixture_df)
    docs = [r["description"].lower().split() for r in fixture_df.collect()]
    for term, w in zip(cv.vocabulary, scaling):
        df_ = sum(1 for d in docs if term in d)
        assert abs(w - (math.log((1 + len(docs)) / (1 + df_)) + 1)) < 1e-12
    assert "vpn" in cv.vocabulary and "a" not in cv.vocabulary


def test_artifacts_and_performance(spark, trained, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty"))
    with pytest.raises(FileNotFoundError):
        routing.load_performance(spark, out + "/none")
    import os
    root = [p for p in os.listdir(str(tmp_path_factory.getbasetemp())) if p.startswith("model")][0]
    perf = routing.load_performance(spark, os.path.join(str(tmp_path_factory.getbasetemp()), root)).first()
    assert perf["class_names"] == ["Billing", "Hardware", "Network"] and 0.0 <= perf["accuracy"] <= 1.0


def test_certificate_tells_an_optimum(spark, fixture_df):
    """The gradient vanishes at the fitted coefficients, and not at those of a fit that was stopped early."""
    done = routing.certificate(routing.fit_routing(fixture_df), fixture_df).collect()
    assert {r["team"] for r in done} == set(TEXTS) and all(r["max_gradient"] < 1e-4 for r in done)
    early = routing.certificate(routing.fit_routing(fixture_df, max_iter=1), fixture_df).collect()
    assert max(r["max_gradient"] for r in early) > 1e-3


def test_split_is_one_pass(spark, fixture_df):
    out = routing.stratified_split(fixture_df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Window" not in plan
    assert out.where("is_test").count() == 6
    assert routing.stratified_split(fixture_df.limit(0)).count() == 0
