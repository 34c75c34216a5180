"""Graders: sets, rankings, flaky test runs, admission funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def set_scores(predicted: DataFrame, expected: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, precision, recall, f1; an empty side scores 0, two empty ones have no row."""
    j = predicted.select(*by, item).distinct().withColumn("p", F.lit(1)).join(expected.select(*by, item).distinct().withColumn("e", F.lit(1)), [*by, item], "full_outer")
    c = j.groupBy(*by).agg(F.count("p").alias("np"), F.count("e").alias("ne"), F.count(F.when(F.col("p").isNotNull() & F.col("e").isNotNull(), 1)).alias("hit"))
    p = F.when(F.col("np") > 0, F.col("hit") / F.col("np")).otherwise(0.0)
    r = F.when(F.col("ne") > 0, F.col("hit") / F.col("ne")).otherwise(0.0)
    return c.select(*by, p.alias("precision"), r.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def macro_f1(labelled: DataFrame) -> DataFrame:
    """One row: accuracy and mean F1 over labels. labelled: expected, predicted."""
    labels = labelled.select(F.explode(F.array_distinct(F.array("expected", "predicted"))).alias("label"), "expected", "predicted")
    per = labels.groupBy("label").agg(
        F.count(F.when((F.col("expected") == F.col("label")) & (F.col("predicted") == F.col("label")), 1)).alias("tp"),
        F.count(F.when(F.col("expected") != F.col("label"), 1)).alias("fp"), F.count(F.when(F.col("predicted") != F.col("label"), 1)).alias("fn"),
    )
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return per.agg(F.avg(f1).alias("macro_f1")).crossJoin(labelled.agg(F.avg((F.col("expected") == F.col("predicted")).cast("double")).alias("accuracy")))


def ranking_scores(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query, p_at_k, r_at_k, rr. ranked: query, item, rank; an item counts at its
    best rank, and ranks close up after that (A38)."""
    first = ranked.groupBy("query", "item").agg(F.min("rank").alias("rank"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("rank", "item")))
    hits = first.join(relevant.select("query", "item").distinct(), ["query", "item"]).groupBy("query").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hit"), F.min("rank").alias("best"))
    total = relevant.select("query", "item").distinct().groupBy("query").agg(F.count("*").alias("n"))
    at = total.join(hits, "query", "left").na.fill(0, ["hit"])
    return at.select("query", (F.col("hit") / k).alias("p_at_k"), (F.col("hit") / F.col("n")).alias("r_at_k"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("rr"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """rho, n over shared items of two rankings (item, score); ties by item."""
    j = a.select("item", F.col("score").alias("x")).join(b.select("item", F.col("score").alias("y")), "item")
    r = j.withColumns({"rx": F.row_number().over(Window.orderBy(F.desc("x"), "item")), "ry": F.row_number().over(Window.orderBy(F.desc("y"), "item"))})
    # ranks are ints, whose squares, and their sum even as longs, may be too large
    gap = F.col("rx").cast("long") - F.col("ry")
    s = r.agg(F.count("*").alias("n"), F.sum((gap * gap).cast("decimal(19,0)")).cast("double").alias("d"))
    n = F.col("n").cast("double")
    return s.select("n", F.when(n > 1, 1 - 6.0 * F.col("d") / (n * (n * n - 1))).alias("rho"))


def top_k_jaccard(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """jaccard of the k best items of two rankings."""
    def top(df: DataFrame, name: str) -> DataFrame:
        return df.orderBy(F.desc("score"), "item").limit(k).select("item").withColumn(name, F.lit(1))

    j = top(a, "x").join(top(b, "y"), "item", "full_outer")
    return j.agg((F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)) / F.count("*")).alias("jaccard"))


def dominant(strata: DataFrame) -> DataFrame:
    """task, stratum that is most frequent; ties go to the harder.
    strata: task, stratum, hardness."""
    n = strata.groupBy("task", "stratum", "hardness").agg(F.count("*").alias("n"))
    return n.groupBy("task").agg(F.max_by("stratum", F.struct("n", "hardness")).alias("stratum"))


def flakes(runs: DataFrame, k: int) -> DataFrame:
    """test, stable, status: stable where all k runs agree (A36). runs: test, run, status."""
    return runs.groupBy("test").agg(((F.count("*") == k) & (F.countDistinct("status") == 1)).alias("stable"), F.min("status").alias("status"))


def transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """test, before, after, fixed (stable failure to stable pass), broken."""
    j = before.where("stable").select("test", F.col("status").alias("before")).join(after.where("stable").select("test", F.col("status").alias("after")), "test", "full_outer")
    both = F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit(""))
    return j.withColumns({"fixed": (both[0] == "failed") & (both[1] == "passed"), "broken": (both[0] == "passed") & (both[1] == "failed")})


def resolved(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """resolved: every wanted test is fixed and none is broken."""
    w = wanted.select("test").join(changes, "test", "left").agg((F.min(F.coalesce(F.col("fixed"), F.lit(False)).cast("int")) == 1).alias("all"))
    b = changes.agg(F.coalesce(F.max(F.col("broken").cast("int")), F.lit(0)).alias("any"))
    return w.crossJoin(b).select((F.coalesce(F.col("all"), F.lit(False)) & (F.col("any") == 0)).alias("resolved"))


def funnel(candidates: DataFrame, stages: list[str]) -> DataFrame:
    """stage, n: how many candidates pass each stage and all before it."""
    passed, cols = F.lit(True), [F.struct(F.lit("mined").alias("stage"), F.count("*").alias("n"))]
    for s in stages:
        passed = passed & F.coalesce(F.col(s), F.lit(False))
        cols.append(F.struct(F.lit(s).alias("stage"), F.count(F.when(passed, 1)).alias("n")))
    return candidates.agg(F.array(*cols).alias("x")).select(F.explode("x").alias("x")).select("x.stage", "x.n")
