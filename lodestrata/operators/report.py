"""Report sections: ranked tables over file metrics. Ties are resolved by id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.history import half_up


def wide(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """node_id and a column for each metric name, absent as null."""
    return metrics.where(F.col("name").isin(*names)).groupBy("node_id").pivot("name", list(names)).agg(F.first("value"))


def keep_files(nodes: DataFrame, exclude_roles: Sequence[str] = ("script",), patterns: Column | None = None) -> DataFrame:
    """Files that reports show: not generated, not of an excluded role."""
    kept = nodes.where(F.col("role").isNull() | ~F.col("role").isin("generated", *exclude_roles))
    return kept if patterns is None else kept.where(~patterns)


def ranked(df: DataFrame, by: Sequence[Column], k: int | None) -> DataFrame:
    """df in order with a rank from 1, cut at k."""
    top = df.orderBy(*by) if k is None else df.orderBy(*by).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by)).cast("long"))


def top_by_metric(values: DataFrame, k: int = 20) -> DataFrame:
    """id, value, most first; the filter comes before the cut."""
    return ranked(values.where("value is not null"), [F.desc("value"), F.asc("id")], k)


def hotspots(files: DataFrame, churn: DataFrame, recency: DataFrame, k: int | None = 10, complexity: str = "cognitive_max") -> DataFrame:
    """id, churn, complexity, recency, score: churn x complexity x recency, rounded
    half up; files without churn or complexity are left out (T2)."""
    base = files.select("id", F.col(complexity).alias("complexity")).join(churn.select(F.col("file_id").alias("id"), "churn"), "id")
    scored = base.join(recency.select(F.col("file_id").alias("id"), "recency"), "id", "left").withColumn("recency", F.coalesce("recency", F.lit(1.0)))
    scored = scored.where("churn > 0 and complexity > 0").withColumn("score", half_up(F.col("churn") * F.col("complexity") * F.col("recency")).cast("long"))
    return ranked(scored, [F.desc("score"), F.asc("id")], k)


def silos(files: DataFrame, churn: DataFrame, owners: DataFrame, k: int | None = 10) -> DataFrame:
    """id, churn, bus_factor: files that one author holds, most churn first."""
    at = files.select("id").join(churn.select(F.col("file_id").alias("id"), "churn"), "id").join(owners.select(F.col("file_id").alias("id"), "bus_factor", "top_author_share"), "id")
    return ranked(at.where("bus_factor <= 1"), [F.desc("churn"), F.asc("id")], k)


def test_silos(files: DataFrame, owners: DataFrame, tests: DataFrame, k: int | None = 10) -> DataFrame:
    """id, linked_test_count, bus_factor of tests that one author wrote (T4)."""
    at = files.select("id").join(owners.select(F.col("file_id").alias("id"), "bus_factor"), "id").join(tests.select(F.col("source_id").alias("id"), "linked_test_count"), "id")
    return ranked(at.where("bus_factor <= 1"), [F.desc("linked_test_count"), F.asc("id")], k)


def coupling_clusters(pairs: DataFrame, files: DataFrame, k: int | None = 10) -> DataFrame:
    """file_a, file_b, count where both ends are shown (T5)."""
    ids = files.select("id")
    both = pairs.join(ids.withColumnRenamed("id", "file_a"), "file_a", "left_semi").join(ids.withColumnRenamed("id", "file_b"), "file_b", "left_semi")
    return ranked(both.select("file_a", "file_b", "count"), [F.desc("count"), F.asc("file_a"), F.asc("file_b")], k)


def growth_risks(metrics: DataFrame, k: int | None = 10) -> DataFrame:
    """id, loop_depth, smells of files with nested loops, recursion or searches in loops."""
    smells = F.array_compact(F.array(F.when(F.col("loop_depth") >= 2, "nested-loops"), F.when(F.col("recursive_functions") > 0, "recursion"), F.when(F.col("search_in_loop") > 0, "search-in-loop")))
    at = metrics.withColumn("smells", smells).where(F.size("smells") > 0)
    return ranked(at, [F.desc("loop_depth"), F.desc(F.size("smells")), F.asc("id")], k)


def untested_risk(spots: DataFrame, coverage: DataFrame, k: int | None = 10) -> DataFrame:
    """id, score, coverage_pct, risk = score x share not covered, above 0."""
    at = spots.select("id", "score").join(coverage.select("id", "coverage_pct"), "id")
    risk = half_up(F.col("score") * (1 - F.col("coverage_pct") / 100)).cast("long")
    return ranked(at.withColumn("risk", risk).where("risk > 0"), [F.desc("risk"), F.asc("id")], k)


def blast_radius(files: DataFrame, utilization: DataFrame, churn: DataFrame, k: int | None = 15) -> DataFrame:
    """id, risk = utilization x complexity x churn, above 0."""
    at = files.select("id", "cognitive_max").join(utilization.select("id", "utilization"), "id").join(churn.select(F.col("file_id").alias("id"), "churn"), "id")
    return ranked(at.withColumn("risk", F.round(F.col("utilization") * F.col("cognitive_max") * F.col("churn"), 6)).where("risk > 0"), [F.desc("risk"), F.asc("id")], k)


def budget(rows: DataFrame, name: str, rank: str, tokens: int, overhead: int = 12, per_token: int = 4) -> DataFrame:
    """The prefix of ranked rows whose names fit into the tokens, one row at least."""
    upto = F.sum(F.length(F.col(name).cast("string")) + overhead).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    first = F.row_number().over(Window.orderBy(rank)) == 1
    return rows.withColumn("chars", upto).withColumn("first", first).where(F.col("first") | (F.col("chars") <= tokens * per_token)).drop("first")


def health(counts: DataFrame) -> DataFrame:
    """score = 100 less capped penalties for scary hotspots, violations, complexity
    and hidden coupling, 0 at least (A29)."""
    lost = (
        F.least(F.lit(30), F.col("scary") * 10) + F.least(F.lit(20), F.col("new_violations") * 8 + F.col("carried") * 3)
        + F.least(F.lit(15), F.greatest(F.lit(0), F.col("complexity") - 30)) + F.least(F.lit(10), F.col("hidden") * 2)
    )
    return counts.withColumn("score", F.greatest(F.lit(0), 100 - lost).cast("long"))


def drift(now: DataFrame, before: DataFrame, all_now: DataFrame, all_before: DataFrame) -> DataFrame:
    """id, status of two hotspot tables (id, score): new, worsened, improved,
    unchanged; gone ones are resolved if their score fell, else displaced (U5)."""
    a, b = now.select("id", F.col("score").alias("now")), before.select("id", F.col("score").alias("before"))
    every = a.join(b, "id", "full_outer").join(all_now.select("id", F.col("score").alias("any_now")), "id", "left").join(all_before.select("id", F.col("score").alias("any_before")), "id", "left")
    fell = F.coalesce("any_now", F.lit(0)) < F.col("before")
    status = (
        F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), F.when(fell, "resolved").otherwise("displaced"))
        .when(F.col("now") > F.col("before"), "worsened").when(F.col("now") < F.col("before"), "improved").otherwise("unchanged")
    )
    return every.select("id", "now", "before", status.alias("status"))
