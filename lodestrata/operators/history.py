"""Commit-history analytics: churn, recency, ownership, change coupling, test links.

All take a churn relation: commit_id, author, file_id, epoch, added, deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def within(churn: DataFrame, days: int | None, now: int) -> DataFrame:
    """Entries of the last days, the edge included; None is the lifetime."""
    return churn if days is None else churn.where(F.col("epoch") >= now - days * DAY)


def churn_metrics(churn: DataFrame, days: int | None, now: int) -> DataFrame:
    """file_id, churn, commits, authors (A4)."""
    return within(churn, days, now).groupBy("file_id").agg(
        F.sum(F.col("added") + F.col("deleted")).alias("churn"), F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors")
    )


def churn_windows(churn: DataFrame, windows: list[int | None], now: int) -> DataFrame:
    """file_id and churn_{w} for each window, from one pass."""
    def inside(d: int | None) -> Column:
        return F.lit(True) if d is None else F.col("epoch") >= now - d * DAY

    lines = F.col("added") + F.col("deleted")
    return churn.groupBy("file_id").agg(*(F.sum(F.when(inside(d), lines).otherwise(0)).alias(f"churn_{'lifetime' if d is None else f'{d}d'}") for d in windows))


def recency(churn: DataFrame, days: int | None, now: int) -> DataFrame:
    """file_id, age_days, recency = min(1, age / window); a lifetime window gives 1."""
    age = (F.lit(now) - F.min("epoch")) / DAY
    seen = churn.groupBy("file_id").agg(age.alias("age_days"))
    return seen.withColumn("recency", F.lit(1.0) if days is None else F.least(F.lit(1.0), F.col("age_days") / days))


def author_lines(churn: DataFrame) -> DataFrame:
    """file_id, author, lines without authors of no lines."""
    return churn.groupBy("file_id", "author").agg(F.sum(F.col("added") + F.col("deleted")).alias("lines")).where("lines > 0")


def ownership(lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """file_id, bus_factor, top_author_share: the fewest authors that reach the
    threshold of a file's lines, and the largest share, to 3 digits (A5, W1)."""
    ranked = Window.partitionBy("file_id").orderBy(F.desc("lines"), "author")
    shares = lines.withColumns({
        "total": F.sum("lines").over(Window.partitionBy("file_id")),
        "upto": F.sum("lines").over(ranked.rowsBetween(Window.unboundedPreceding, 0)),
        "rank": F.row_number().over(ranked),
    })
    return shares.groupBy("file_id").agg(
        F.min(F.when(F.col("upto") >= threshold * F.col("total"), F.col("rank"))).cast("long").alias("bus_factor"),
        half_up(F.max(F.col("lines") / F.col("total")), 3).alias("top_author_share"),
    )


def top_author(lines: DataFrame) -> DataFrame:
    """file_id, author with most lines; ties go to the least."""
    best = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("lines"), "author"))
    return lines.withColumn("r", best).where("r = 1").select("file_id", "author", "lines")


def coupling(churn: DataFrame, min_count: int = 2, guard: int = 50, samples: int = 10) -> DataFrame:
    """file_a, file_b, count, commits: pairs that change together. Commits of one
    file or of more than guard files are left out before the join (A8, J8)."""
    t = churn.select("commit_id", "file_id", "epoch").dropDuplicates(["commit_id", "file_id"])
    sized = t.withColumn("n", F.count("*").over(Window.partitionBy("commit_id"))).where(F.col("n").between(2, guard))
    # one epoch a commit: the latest of its rows
    when = churn.groupBy("commit_id").agg(F.max("epoch").alias("at"))
    a, b = (sized.select("commit_id", F.col("file_id").alias(x)) for x in ("file_a", "file_b"))
    pairs = a.join(b, "commit_id").where("file_a < file_b").join(when, "commit_id")
    newest = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("at")).alias("at"), "commit_id"))), 1, samples)
    return (
        pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("count"), newest.alias("s")).where(F.col("count") >= min_count)
        .select("file_a", "file_b", "count", F.col("s.commit_id").alias("commits"))
    )


def skipped_commits(churn: DataFrame, guard: int = 50) -> DataFrame:
    """One row: how many commits the guard left out."""
    sizes = churn.groupBy("commit_id").agg(F.countDistinct("file_id").alias("n"))
    return sizes.agg(F.count(F.when(F.col("n") > guard, 1)).alias("skipped"))


def coupled_to(pairs: DataFrame, seed: object) -> DataFrame:
    """partner, count of one file, most first (M1)."""
    partner = F.when(F.col("file_a") == F.lit(seed), F.col("file_b")).otherwise(F.col("file_a"))
    return pairs.where((F.col("file_a") == F.lit(seed)) | (F.col("file_b") == F.lit(seed))).select(partner.alias("partner"), "count").orderBy(F.desc("count"), "partner")


def link_tests(tests: DataFrame, sources: DataFrame, candidates: DataFrame, pairs: DataFrame, min_count: int = 2) -> DataFrame:
    """test_id, source_id, method: by path candidate (test_id, source_id), else by
    the partner that most often changes with the test (J6, J7)."""
    by_path = candidates.join(tests.select(F.col("id").alias("test_id")), "test_id", "left_semi").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    by_path = by_path.select("test_id", "source_id").distinct().withColumn("method", F.lit("path"))
    rest = tests.select(F.col("id").alias("test_id")).join(by_path, "test_id", "left_anti")
    both = pairs.select(F.col("file_a").alias("test_id"), F.col("file_b").alias("source_id"), "count").union(pairs.select("file_b", "file_a", "count")).where(F.col("count") >= min_count)
    ranked = both.join(rest, "test_id", "left_semi").join(sources.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    best = F.row_number().over(Window.partitionBy("test_id").orderBy(F.desc("count"), "source_id"))
    by_edit = ranked.withColumn("r", best).where("r = 1").select("test_id", "source_id", F.lit("coedit").alias("method"))
    return by_path.unionByName(by_edit)


def linked_test_count(links: DataFrame) -> DataFrame:
    """source_id, linked_test_count."""
    return links.groupBy("source_id").agg(F.countDistinct("test_id").alias("linked_test_count"))


def test_ownership(links: DataFrame, lines: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Ownership of a source's linked tests, their authors' lines added up."""
    merged = links.join(lines.withColumnRenamed("file_id", "test_id"), "test_id").groupBy(F.col("source_id").alias("file_id"), "author").agg(F.sum("lines").alias("lines"))
    return ownership(merged, threshold)


def author_count(churn: DataFrame, days: int | None, now: int) -> DataFrame:
    """One row: distinct authors of a window."""
    return within(churn, days, now).agg(F.countDistinct("author").alias("authors"))
