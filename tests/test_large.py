"""Figures that pass what small tables reach."""

import itertools
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestrata import runtime
from lodestrata.operators import community, evaluate, nearest, symbols
from lodestrata.sources.projection import Relations


def most_partitions(df, *keys):
    """Of the exchanges by exactly these keys."""
    by = r"hashpartitioning\(" + ", ".join(rf"{k}#\d+L?" for k in keys) + r", (\d+)\)"
    return max(map(int, re.findall(by, df._jdf.queryExecution().executedPlan().toString())), default=0)


def test_spearman_of_many_items(spark):
    up = spark.range(100_000).select(F.col("id").alias("item"), F.col("id").alias("score"))
    assert tuple(evaluate.spearman(up, up.withColumn("score", -F.col("score"))).select("n", "rho").first()) == (100_000, -1.0)
    assert evaluate.spearman(up, up).first()["rho"] == 1.0




def test_edges_take_more_tasks_for_more_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    lines = [(c, rng.randrange(60)) for c in range(300) for _ in range(rng.randrange(9))] + [(None, 1), (None, 2), (None, 1), (7, None)]
    spark.createDataFrame([(c, f, 1) for c, f in lines], "l_orderkey long, l_partkey long, l_suppkey long").selectExpr(
        "*", "1 as l_linenumber", "1.0D as l_quantity", "timestamp'2024-01-01' as l_shipdate"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(60).selectExpr("id as p_partkey", "'b' as p_brand", "'t' as p_type", "'n' as p_name", "1 as p_size", "1.0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    files = {c: {f for o, f in lines if o == c and f is not None} for c, _ in lines if c is not None}
    pairs = Counter(p for fs in files.values() for p in itertools.combinations(sorted(fs), 2))
    edges = Relations(spark, str(tmp_path)).edges
    assert {(r["src"], r["dst"]): r["weight"] for r in edges.collect()} == {p: n for p, n in pairs.items() if n >= 2}
    assert most_partitions(edges, "src", "dst") >= sum(pairs.values()) / 100 > 20
    assert most_partitions(edges, "commit_id") >= 10


def test_communities_pass_over_files_without_edges():
    many = [f"n{i:06}" for i in range(100_000)]
    at = random.Random(3)
    pairs = [(a, b) for k in range(0, 900, 3) for a, b in itertools.combinations(at.sample(many[k : k + 3], 3), 2)]
    found = community.greedy(many, pairs)
    assert len(set(found.values())) == 100_000 - 600 and all(found[a] == found[b] for a, b in pairs)


def test_co_imports_take_more_tasks_for_more_pairs(spark, monkeypatch):
    rng = random.Random(9)
    refs = {(i, f"{'pq'[s % 2]}#{s}") for i in range(120) for s in rng.sample(range(40), rng.choice([1, 2, 5, 12, 13]))} | {(None, "p#0"), (None, "p#2"), (500, None), (500, "p#0")}
    own = {i: sorted(s for j, s in refs if j == i and s) for i, _ in refs if i is not None and sum(j == i for j, _ in refs) <= 12}
    pairs = Counter(p for ss in own.values() for p in itertools.combinations(ss, 2))
    monkeypatch.setattr(runtime, "TASK_ROWS", 100)
    found = symbols.co_imports(spark.createDataFrame([*refs, *refs], "importer long, symbol string"), guard=12)
    assert {(r["symbol_a"], r["symbol_b"]): (r["co_imports"], r["cross_file"]) for r in found.collect()} == {(a, b): (n, a[0] != b[0]) for (a, b), n in pairs.items() if n >= 2}
    assert most_partitions(found, "both") >= sum(pairs.values()) // 100 > 10


def test_rows_are_numbered_without_gaps(spark):
    at = runtime.numbered(spark.range(0, 1000, 1, 7).where("id % 3 = 0"), "n")
    assert sorted(r["n"] for r in at.collect()) == list(range(334))


def test_blocked_search_equals_every_pair(spark, monkeypatch):
    rng = random.Random(2)
    one = lambda: [float(rng.randint(-3, 3)) for _ in range(4)]
    rows = [(i, rng.choice([1, 2, 2, 3, None]), rng.choice([one(), one(), one(), one(), [1.0, 2.0, 0.0, 1.0], [0.0] * 4])) for i in range(300)]
    rows += [(300, 8, one()), (301, 8, None), (310, 9, one()), (320, 10, [1.0, None, 2.0, 1.0]), (321, 10, one()), (330, 11, [math.nan, 1.0, 1.0, 1.0]), (331, 11, one()), (340, 12, None), (341, 12, one())]
    items = spark.createDataFrame(rows, "item long, il int, v array<float>").repartition(3)

    def cosine(u, v):  # in order: NaN, numbers, nothing
        if u is None or v is None or None in u or None in v:
            return (0, 0.0)
        if any(map(math.isnan, u + v)):
            return (2, 0.0)
        d = math.hypot(*u) * math.hypot(*v)
        return (1, round(sum(a * b for a, b in zip(u, v)) / d, 9) + 0.0 if d else 0.0)

    want = {}
    for q, ql, u in rows:
        if q % 10 == 0 and ql is not None:
            order = sorted(((*cosine(u, v), -i, il) for i, il, v in rows if i != q), reverse=True)
            ranks = [k for k, x in enumerate(order, 1) if x[3] == ql]
            if ranks:
                want[q] = (sum(k <= 5 for k in ranks) / 5, sum(k <= 5 for k in ranks) / len(ranks), 1 / ranks[0])
    asked = items.where("item % 10 = 0").selectExpr("item as query", "il as ql", "v as u")
    monkeypatch.setattr(nearest, "KEPT", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    try:
        monkeypatch.setattr(nearest, "SLICE", 2000)  # some twenty queries
        got = nearest.scores(items, asked, 5)
        assert {r["query"]: tuple(r)[1:] for r in got.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert 310 not in want and {300, 320, 330, 340} <= set(want) and sum(x[0] == 0 for x in want.values()) > 3
    assert nearest.scores(items, asked.limit(0), 5).count() == 0
