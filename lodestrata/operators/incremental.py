"""Incremental indexing: what can be reused, what must be read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENSIONS = ("", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def structural_hash(text: Column) -> Column:
    """Hash of the tokens without comments and white space."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)/\*.*?\*/", " "), r"(?m)(//|#).*$", " ")
    return F.sha2(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r" ?([^\w ]) ?", "$1"), 256)


def tiers(files: DataFrame, prior: DataFrame) -> DataFrame:
    """file_id, tier: none (same text), cosmetic (same structure), structural."""
    p = prior.select("file_id", F.col("content_hash").alias("c"), F.col("structural_hash").alias("s"))
    tier = F.when(F.col("content_hash") == F.col("c"), "none").when(F.col("structural_hash") == F.col("s"), "cosmetic").otherwise("structural")
    return files.join(p, "file_id", "left").select("file_id", tier.alias("tier"))


def reuse_basis(snapshots: DataFrame, fingerprints: DataFrame, version: str, last: int = 50) -> DataFrame:
    """The newest of the last snapshots of the same version with a fingerprint."""
    recent = snapshots.orderBy(F.desc("taken_at"), F.desc("id")).limit(last).where(F.col("index_version") == version)
    have = fingerprints.select(F.col("snapshot_id").alias("id")).distinct()
    return recent.join(have, "id", "left_semi").orderBy(F.desc("taken_at"), F.desc("id")).limit(1)


def carried(metrics: DataFrame, names: Sequence[str], unchanged: DataFrame, fresh: DataFrame) -> DataFrame:
    """Metrics of unchanged files by name, and the fresh ones."""
    old = metrics.where(F.col("name").isin(*names)).join(unchanged.select(F.col("file_id").alias("node_id")), "node_id", "left_semi")
    return old.unionByName(fresh)


def resolve(specifiers: DataFrame, files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """src, specifier, dst: the first existing candidate of a relative import in
    the order of the extensions; null if none (J17). specifiers: src, specifier,
    base (the joined, normalised path)."""
    ext = F.array(*map(F.lit, extensions))
    tried = specifiers.select("src", "specifier", "base", F.posexplode(ext).alias("pos", "ext")).withColumn("dst", F.concat("base", "ext"))
    hit = tried.join(files.select(F.col("id").alias("dst")).distinct(), "dst").groupBy("src", "specifier").agg(F.min_by("dst", "pos").alias("dst"))
    return specifiers.select("src", "specifier").distinct().join(hit, ["src", "specifier"], "left")


def affected(prior: DataFrame, specifiers: DataFrame, files: DataFrame) -> DataFrame:
    """src of edges whose target is gone or now resolves elsewhere.
    prior: src, specifier, dst."""
    now = resolve(specifiers, files).withColumnRenamed("dst", "now")
    return prior.join(now, ["src", "specifier"], "left").where(~F.col("dst").eqNullSafe(F.col("now"))).select("src").distinct()


def fallback_window(stored: DataFrame, wanted: int | None) -> DataFrame:
    """window, exact: the wanted window if stored, else the widest finite one (M2).
    stored: days (null is the lifetime)."""
    w = F.lit(wanted).cast("int")
    return stored.agg(F.max(F.col("days").eqNullSafe(w)).alias("exact"), F.max("days").alias("widest")).select(F.when(F.col("exact"), w).otherwise(F.col("widest")).alias("window"), "exact")
