"""Snapshots, metadata, preview and fingerprints."""

import pytest
from pyspark.sql import functions as F

from ticketlake.sources import storage


def test_snapshots(spark, tmp_dir):
    root = f"{tmp_dir}/snaps"
    df = spark.range(10).select(F.col("id").cast("string").alias("ticket_id"),
                                F.lit("text").alias("issue_description"))
    assert storage.write_snapshot(df, root, "My Snap!") == "My-Snap"
    storage.write_snapshot(df.limit(3), root, "other")
    storage.write_snapshot(df.limit(4), root, "other")          # replaces only that partition
    listed = [(r["name"], r["row_count"]) for r in storage.list_snapshots(spark, root).collect()]
    assert listed == [("My-Snap", 10), ("other", 4)]
    loaded = storage.load_snapshot(spark, root, "My Snap!")
    assert loaded.count() == 10 and "description" in spark.table("tickets").columns
    with pytest.raises(FileNotFoundError):
        storage.load_snapshot(spark, root, "missing")


def test_metadata_latest(spark, tmp_dir):
    path = f"{tmp_dir}/meta"
    storage.append_metadata(storage.metadata_record(spark, dataset_name="a", row_count=1,
                                                    saved_at_utc="2001-01-01T00:00:00"), path)
    storage.append_metadata(storage.metadata_record(spark, dataset_name="b", row_count=2,
                                                    saved_at_utc="2001-01-02T00:00:00"), path)
    assert storage.latest_metadata(spark, path).first()["dataset_name"] == "b"


def test_preview_and_fingerprint(spark):
    df = spark.createDataFrame([(f"T-{i}", "2001-01-01") for i in range(20)], "ticket_id string, created_date string")
    p = storage.preview(df, 1)
    assert p.count() == 1 and "creation_date" in p.columns
    for limit in (0, 5001):
        with pytest.raises(ValueError):
            storage.preview(df, limit)
    a = storage.fingerprint(df).first()
    b = storage.fingerprint(df.orderBy(F.desc("ticket_id"))).first()
    assert a == b
    c = storage.fingerprint(df.unionByName(df.limit(2))).first()
    assert c["row_count"] == 22 and c["hash_sum"] != a["hash_sum"]


def test_status_routing_capable(spark):
    df = spark.createDataFrame([("x", "y")], "issue_description string, route_team string")
    r = storage.dataset_status(df).first()
    assert r["routing_capable"] is True and r["row_count"] == 1


def test_export_set(spark, tmp_dir):
    from ticketlake import registry as R
    from ticketlake.operators import kpi
    from tests.conftest import SF001
    enr = R.enriched(spark, SF001)
    from ticketlake.operators import marts
    frames = kpi.export_frames(marts.ticket_fact(enr), marts.team_workload(enr), marts.dealer_performance(enr),
                               marts.product_defects(enr), kpi.KpiFilter(team="Brake Systems"))
    paths = storage.export_set(frames, tmp_dir + "/export")
    assert len(paths) == 5
    summary = spark.read.option("header", True).csv(paths[0]).collect()
    assert [r["Metric"] for r in summary][0] == "Total Tickets"


def test_snapshot_names_are_text(spark, tmp_dir):
    root = f"{tmp_dir}/snaps"
    assert storage.list_snapshots(spark, root).collect() == []
    df = spark.createDataFrame([("T-1", "x")], "ticket_id string, issue_description string")
    storage.write_snapshot(df, root, "007")
    assert [r["name"] for r in storage.list_snapshots(spark, root).collect()] == ["007"]
    assert storage.load_snapshot(spark, root, "007").count() == 1
    with pytest.raises(FileNotFoundError):
        storage.load_snapshot(spark, root, "abc")


def test_metadata_with_null_fields(spark, tmp_dir):
    r = storage.metadata_record(spark, dataset_name="a", snapshot_path=None, n=3, ok=True).first()
    assert r["snapshot_path"] is None and r["n"] == 3 and r["ok"] is True


def test_status_names_and_absence(spark):
    df = spark.createDataFrame([("x", "y")], "issue_description string, route_team string")
    r = storage.dataset_status(df, name="n", source="upload").first()
    assert (r["exists"], r["dataset_name"], r["dataset_source"]) == (True, "n", "upload")
    assert storage.dataset_status(None, spark).first()["exists"] is False
