"""Scans, sinks, tasks and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loamgrid.plans import workflow
from loamgrid.sources import tables
from loamgrid.streaming import scoring


def test_header_json(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text(json.dumps([["name", "v"], ["x", "1"], ["y", None]]))
    assert [tuple(r) for r in tables.read_header_json(spark, str(f)).collect()] == [("x", "1"), ("y", None)]
    for bad in ([["a", "a"], ["1", "2"]], [["a", "b"], ["1"]], [["a"], [["1"]]]):
        f.write_text(json.dumps(bad))
        with pytest.raises(Exception):
            tables.read_header_json(spark, str(f)).collect()


def test_csv_keeps_leading_zeros(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("code,v\n007,1.5\n")
    assert tuple(tables.read_csv(spark, str(f), "code string, v double").first()) == ("007", 1.5)


def test_merge_and_link(spark):
    a, b = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int"), spark.createDataFrame([(1, 5), (2, 6)], "k int, b int")
    assert tables.merge_batches([a, b], ["k"]).count() == 2 and tables.link_one_to_one(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        tables.merge_batches([a, b.filter("k = 1")], ["k"])
    with pytest.raises(ValueError):
        tables.link_one_to_one(a, b.filter("k = 1"), ["k"])


def test_manifest_finds_changes(spark, tmp_path):
    p = str(tmp_path / "t")
    tables.write_new(spark.range(10).coalesce(1), p)
    m = spark.createDataFrame(tables.manifest(spark, p).collect(), "file string, bytes bigint, sha256 string")
    assert tables.verify(spark, p, m).isEmpty()
    spark.range(3).coalesce(1).write.mode("append").parquet(p)
    assert [r["status"] for r in tables.verify(spark, p, m).collect()] == ["extra"]
    with pytest.raises(Exception):
        tables.write_new(spark.range(1), p)


def test_tasks_resume(spark, tmp_path):
    plan = tables.task_plan(spark, {"n": [10.0, 20.0]}, 3, 7)
    assert plan.select("task_id").distinct().count() == 6 and plan.filter("task_id = 1").first()["seed"] == (7 + 104729) % 2147483646 + 1

    def work(frames):
        for f in frames:
            yield pd.DataFrame({"task_id": f["task_id"], "v": f["n"] * 2})

    p = str(tmp_path / "runs")
    assert tables.run_tasks(plan.filter("task_id <= 2"), p, work, "task_id bigint, v double", "s").count() == 2
    assert tables.run_tasks(plan, p, work, "task_id bigint, v double", "s").count() == 6
    with pytest.raises(ValueError):
        tables.run_tasks(plan, p, work, "task_id bigint, v double", "other")


def test_signature_ignores_order(spark):
    a = spark.range(50).withColumn("v", F.col("id") * 2)
    assert tables.signature(a, {"k": 1}) == tables.signature(a.repartition(5).select("v", "id"), {"k": 1}) != tables.signature(a.limit(49), {"k": 1})


def test_streams(spark, tmp_path):
    pts = spark.range(60).select("id", (F.col("id") % 8 / 8.0).alias("cx"), (F.floor(F.col("id") / 8) / 8.0).alias("cy"), F.sin(F.col("id") / 3.0).alias("x1"))
    pts = pts.withColumn("y", 1 + F.col("x1") * (1 + F.col("cx")))
    f = workflow.fit(pts, "y", ["x1"], ["cx", "cy"], 12)
    new = tmp_path / "in"
    pts.limit(5).write.parquet(str(new))
    stream = spark.readStream.schema(pts.schema).parquet(str(new))
    q = scoring.score_stream(f, stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    events = "/root/testdata/sf0.001/events.parquet"
    s = spark.readStream.schema(spark.read.parquet(events).schema).parquet("/root/testdata/sf0.001", pathGlobFilter="events.parquet")
    q = scoring.windowed(s).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == spark.read.parquet(events).count()
