"""Dossiers and the read API over a graph's relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators import graph, history, symbols, vectors

API_VERSION = "1.2.0"


def package_summary(files: DataFrame, churn: DataFrame, spots: DataFrame, silos: DataFrame) -> DataFrame:
    """package, files, churn, authors (the most of a file), hotspots, silos."""
    marks = lambda df, name: df.select("id").distinct().withColumn(name, F.lit(1))
    at = files.select("id", "package").join(churn.select(F.col("file_id").alias("id"), "churn", "authors"), "id", "left").join(marks(spots, "h"), "id", "left").join(marks(silos, "s"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return at.groupBy("package").agg(F.count("*").alias("files"), zero(F.sum("churn")).alias("churn"), zero(F.max("authors")).alias("authors"), F.count("h").alias("hotspots"), F.count("s").alias("silos"))


def dossiers(files: DataFrame, churn: DataFrame, ranks: DataFrame, edges: DataFrame, pairs: DataFrame, partners: int = 15) -> DataFrame:
    """A row for each file: its metrics, what it imports, who imports it by role,
    its blast radius, and the files that change with it (C1)."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("depends_on"))
    users = symbols.split_consumers(edges.select(F.col("dst").alias("target"), F.col("src").alias("importer")), files).withColumnRenamed("target", "id")
    both = pairs.select(F.col("file_a").alias("id"), F.col("file_b").alias("partner"), "count").union(pairs.select("file_b", "file_a", "count"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("count"), "partner"))
    mates = both.withColumn("r", best).where(F.col("r") <= partners).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "partner"))), lambda x: x["partner"]).alias("changes_with"))
    return (
        files.join(churn.withColumnRenamed("file_id", "id"), "id", "left").join(ranks.select("id", F.col("score").alias("centrality")), "id", "left")
        .join(out, "id", "left").join(users, "id", "left").join(mates, "id", "left")
        .withColumn("blast_radius", F.coalesce(F.size("source_consumers"), F.lit(0)) + F.coalesce(F.size("test_consumers"), F.lit(0)))
    )


def explained(edges: DataFrame, ranks: DataFrame, lines: DataFrame, kinds: dict[str, float] | None = None) -> DataFrame:
    """id, via (the importer that lends it most rank), author (of most lines)."""
    weight = F.coalesce(*(F.when(F.col("kind") == k, F.lit(w)) for k, w in (kinds or graph.KIND_WEIGHT).items()), F.lit(1.0))
    lent = edges.join(ranks.select(F.col("id").alias("src"), "score"), "src").withColumn("lent", F.col("score") * weight)
    first = F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("lent"), "src"))
    via = lent.withColumn("r", first).where("r = 1").select(F.col("dst").alias("id"), F.col("src").alias("via"))
    return via.join(history.top_author(lines).select(F.col("file_id").alias("id"), "author"), "id", "full_outer")


def bundle(seed: object, edges: DataFrame, pairs: DataFrame, ranks: DataFrame, k: int = 20) -> DataFrame:
    """kind (caller, dependency, coupled), id, relevance, weight: what to read with
    a file, most relevant first (C2)."""
    callers = edges.where(F.col("dst") == F.lit(seed)).select(F.lit("caller").alias("kind"), F.col("src").alias("id"), "weight")
    targets = edges.where(F.col("src") == F.lit(seed)).select(F.lit("dependency").alias("kind"), F.col("dst").alias("id"), "weight")
    mates = history.coupled_to(pairs, seed).select(F.lit("coupled").alias("kind"), F.col("partner").alias("id"), F.col("count").cast("double").alias("weight"))
    at = callers.unionByName(targets).unionByName(mates).join(ranks.select("id", F.round("score", 6).alias("relevance")), "id", "left")
    order = Window.partitionBy("kind").orderBy(F.desc("relevance"), F.desc("weight"), "id")
    return at.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("kind", "id", "relevance", "weight", "rank")


def tasks(edges: DataFrame, files: DataFrame, cap: int = 12) -> DataFrame:
    """kind, subject, answer: comprehension tasks with their truth: what a file
    imports, who imports it, and who of these is no test (Q1)."""
    deps = edges.groupBy(F.col("src").alias("subject")).agg(F.sort_array(F.collect_set("dst")).alias("answer")).withColumn("kind", F.lit("dependencies"))
    back = edges.groupBy(F.col("dst").alias("subject")).agg(F.sort_array(F.collect_set("src")).alias("answer")).withColumn("kind", F.lit("reverse-dependencies"))
    prod = edges.join(files.where("coalesce(role, '') not in ('test', 'fixture')").select(F.col("id").alias("src")), "src", "left_semi")
    prod = prod.groupBy(F.col("dst").alias("subject")).agg(F.sort_array(F.collect_set("src")).alias("answer")).withColumn("kind", F.lit("production-consumers"))
    order = Window.partitionBy("kind").orderBy(F.desc(F.size("answer")), "subject")
    every = deps.unionByName(back).unionByName(prod)
    return every.withColumn("r", F.row_number().over(order)).where(F.col("r") <= cap).select("kind", "subject", "answer")


def hidden_coupling(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """file_a, file_b, count of pairs that change together without an import either
    way (J19)."""
    e = edges.select(F.least("src", "dst").alias("file_a"), F.greatest("src", "dst").alias("file_b")).distinct()
    return pairs.join(e, ["file_a", "file_b"], "left_anti")


class ReadApi:
    """Pulls over one graph: context, neighbours, search, similar."""

    def __init__(self, files: DataFrame, edges: DataFrame, churn: DataFrame, pairs: DataFrame, **rank):
        self.version, self.files, self.edges, self.churn, self.pairs = API_VERSION, files, edges, churn, pairs
        self.ranks = graph.pagerank(files, edges, **rank)

    def resolve(self, target: object) -> object:
        """The file of that id, else the one whose id ends in or holds it."""
        ids = self.files.select("id")
        if ids.where(F.col("id") == F.lit(target)).count() == 1:
            return target
        for test in (F.col("id").cast("string").endswith(str(target)), F.col("id").cast("string").contains(str(target))):
            found = [r[0] for r in ids.where(test).limit(2).collect()]
            if len(found) == 1:
                return found[0]
            if found:
                raise ValueError(f"{target} may be {found[0]} or {found[1]}")
        raise ValueError(f"nothing matches {target}")

    def context(self, target: object) -> DataFrame:
        return dossiers(self.files, self.churn, self.ranks, self.edges, self.pairs).where(F.col("id") == F.lit(self.resolve(target)))

    def neighbours(self, target: object) -> DataFrame:
        at = F.lit(self.resolve(target))
        return self.edges.where(F.col("src") == at).select(F.lit("out").alias("way"), F.col("dst").alias("id"), "kind").union(self.edges.where(F.col("dst") == at).select(F.lit("in"), "src", "kind"))

    def bundle(self, target: object) -> DataFrame:
        return bundle(self.resolve(target), self.edges, self.pairs, self.ranks)

    def search(self, text: str, k: int = 20) -> DataFrame:
        items = self.files.select("id", "name", F.col("id").cast("string").alias("path"), F.col("name").alias("text"))
        return vectors.search(items, text, k)

    @staticmethod
    def similar(embedded: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
        return vectors.similar(embedded, query, "id", "vector", k)
