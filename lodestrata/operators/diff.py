"""Snapshot diffs: nodes, edges and metrics matched through id aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.patterns import healed


def resolved(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """df with a column's old ids replaced (J3). aliases: old_id, new_id."""
    a = aliases.groupBy(F.col("old_id").alias("_old")).agg(F.min("new_id").alias("_new"))
    return df.join(a, df[column] == a["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def nodes(before: DataFrame, after: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, old_id, status: added, removed, renamed, unchanged (U1). The aliases
    are those of the later snapshot."""
    a = resolved(before.select("id", F.col("id").alias("old_id")), "id", aliases).withColumn("was", F.lit(True))
    b = after.select("id").withColumn("is", F.lit(True))
    status = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("old_id") != F.col("id"), "renamed").otherwise("unchanged")
    return a.join(b, "id", "full_outer").select(F.when(F.col("is").isNull(), F.col("old_id")).otherwise(F.col("id")).alias("id"), "old_id", status.alias("status"))


def edges(before: DataFrame, after: DataFrame, aliases: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """src, dst, kind, status: added, or removed with the ids it had."""
    key = ["src", "dst", "kind"]
    old = before.select(*key, F.col("src").alias("src0"), F.col("dst").alias("dst0")).withColumn("kind", healed(F.col("kind"), kinds or {}))
    old = resolved(resolved(old, "src", aliases), "dst", aliases)
    new = after.select(*key).withColumn("kind", healed(F.col("kind"), kinds or {})).distinct()
    added = new.join(old, key, "left_anti").select(*key, F.lit("added").alias("status"))
    removed = old.join(new, key, "left_anti").select(F.col("src0").alias("src"), F.col("dst0").alias("dst"), "kind", F.lit("removed").alias("status")).distinct()
    return added.unionByName(removed)


def metrics(before: DataFrame, after: DataFrame, aliases: DataFrame) -> DataFrame:
    """node_id, name, before, after, delta of metrics that changed; null and
    absent values count as none (U1, J4). Names are healed; of several the
    greatest value stays."""
    def keyed(df: DataFrame, value: str) -> DataFrame:
        return df.withColumn("name", healed(F.col("name"))).groupBy("node_id", "name").agg(F.max("value").alias(value))

    a = keyed(resolved(before.select("node_id", "name", "value"), "node_id", aliases), "before")
    b = keyed(after.select("node_id", "name", "value"), "after")
    j = a.join(b, ["node_id", "name"], "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    return j.withColumn("delta", F.col("after") - F.col("before"))


def summary(changes: DataFrame) -> DataFrame:
    """status, count."""
    return changes.groupBy("status").agg(F.count("*").alias("count"))


def merged(*fragments: DataFrame, key: list[str]) -> DataFrame:
    """The first of each key over fragments in their order."""
    every = None
    for k, f in enumerate(fragments):
        f = f.withColumn("_at", F.lit(k))
        every = f if every is None else every.unionByName(f)
    rest = [c for c in every.columns if c not in (*key, "_at")]
    best = every.groupBy(*key).agg(F.min(F.struct("_at", *rest)).alias("x"))
    return best.select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))


def union_status(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """key, status: added, removed or kept, for a drawing of both."""
    a, b = before.select(*key).distinct().withColumn("was", F.lit(1)), after.select(*key).distinct().withColumn("is", F.lit(1))
    status: Column = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("kept")
    return a.join(b, key, "full_outer").select(*key, status.alias("status"))
