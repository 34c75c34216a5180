import pytest
from pyspark.sql import functions as F

from lodestrata.operators import context, report
from lodestrata.streaming import churn


@pytest.fixture(scope="module")
def rel(spark):
    files = spark.createDataFrame([("src/a.ts", "source", "a"), ("src/b.ts", "source", "b"), ("src/b.test.ts", "test", "t")], "id string, role string, name string")
    edges = spark.createDataFrame([("src/a.ts", "src/b.ts", "imports", 2.0), ("src/b.test.ts", "src/b.ts", "imports", 1.0)], "src string, dst string, kind string, weight double")
    lines = spark.createDataFrame([("src/b.ts", 7)], "file_id string, churn long")
    pairs = spark.createDataFrame([("src/a.ts", "src/b.test.ts", 4)], "file_a string, file_b string, count long")
    return files, edges, lines, pairs


def test_read_api(rel):
    api = context.ReadApi(*rel, iterations=5, tolerance=0)
    d = api.context("b.ts").first()
    assert (d["id"], d["churn"], d["source_consumers"], d["test_consumers"], d["blast_radius"]) == ("src/b.ts", 7, ["src/a.ts"], ["src/b.test.ts"], 2)
    assert api.context("src/a.ts").first()["changes_with"] == ["src/b.test.ts"]
    assert {(r["way"], r["id"]) for r in api.neighbours("src/b.ts").collect()} == {("in", "src/a.ts"), ("in", "src/b.test.ts")}
    assert {(r["kind"], r["id"]) for r in api.bundle("a.ts").collect()} == {("dependency", "src/b.ts"), ("coupled", "src/b.test.ts")}
    assert [r["id"] for r in api.search("b").collect()] == ["src/b.ts"]
    with pytest.raises(ValueError, match="may be"):
        api.resolve("src")
    with pytest.raises(ValueError, match="nothing"):
        api.resolve("zzz")


def test_hidden_coupling_and_tasks(rel):
    files, edges, _, pairs = rel
    assert context.hidden_coupling(pairs, edges).count() == 1
    got = {(r["kind"], r["subject"]): r["answer"] for r in context.tasks(edges, files).collect()}
    assert got["production-consumers", "src/b.ts"] == ["src/a.ts"] and got["dependencies", "src/a.ts"] == ["src/b.ts"]


def test_metrics_pivot_keeps_absent_apart_from_zero(spark):
    m = spark.createDataFrame([("a", "loc", 0.0), ("b", "cx", 2.0), ("b", "loc", None)], "node_id string, name string, value double")
    assert {r["node_id"]: (r["loc"], r["cx"]) for r in report.wide(m, ["loc", "cx"]).collect()} == {"a": (0.0, None), "b": (None, 2.0)}


def test_stream_of_commits(spark, tmp_path):
    rows = [("c1", "f", "ann", 3, 1, "2024-01-01 10:00:00"), ("c2", "f", "ann", 2, 0, "2024-01-01 11:00:00"), ("c3", "f", "bob", 1, 0, "2024-02-01 00:00:00"), ("c4", "g", "bob", 1, 0, "2024-03-01 00:00:00")]
    df = spark.createDataFrame(rows, "commit_id string, file_id string, author string, added long, deleted long, t string").withColumn("ts", F.to_timestamp("t")).drop("t")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, out in (("windows", churn.sliding(stream, "1 day", "1 day")), ("bursts", churn.bursts(stream))):
        q = out.writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {(r["file_id"], r["churn"]) for r in spark.table("windows").collect()} >= {("f", 6), ("f", 1)}
    assert {(r["author"], r["entries"]) for r in spark.table("bursts").collect()} >= {("ann", 2), ("bob", 1)}
