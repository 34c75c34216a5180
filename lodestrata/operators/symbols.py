"""Symbols: consumers, co-imports, coverage by span, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import cut, numbered, spread


def consumers(references: DataFrame) -> DataFrame:
    """symbol, consumers (distinct importing files, sorted), n."""
    return references.groupBy("symbol").agg(F.sort_array(F.collect_set("importer")).alias("consumers")).withColumn("n", F.size("consumers"))


def co_imports(references: DataFrame, min_count: int = 2, guard: int = 40) -> DataFrame:
    """symbol_a, symbol_b, co_imports, cross_file: symbols that files import
    together. Importers of one or of more than guard symbols are left out before
    the join (A10, J9).

    Pairs are counted as one number of two ids, in tasks of as many pairs whatever
    the input; only those that are kept get their names back."""
    r = references.select("importer", "symbol").where("importer is not null").distinct()
    sized = cut(r.withColumn("n", F.count("*").over(Window.partitionBy("importer"))).where(F.col("n").between(2, guard) & F.col("symbol").isNotNull()))
    rows, twice = sized.agg(F.count("*"), F.sum(F.col("n") - 1)).first()
    ids = numbered(sized.select("symbol").distinct(), "id")
    files = spread(sized.join(ids, "symbol").select("importer", "id"), rows, "importer").groupBy("importer").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    later = files.select(F.posexplode("ids").alias("at", "x"), "ids").select("x", F.explode(F.slice("ids", F.col("at") + 2, F.size("ids"))).alias("y"))
    both = later.select((F.shiftleft("x", 32) + F.col("y")).alias("both"))
    counted = spread(both, (twice or 0) // 2, "both").groupBy("both").agg(F.count("*").alias("co_imports")).where(F.col("co_imports") >= min_count)
    named = counted.select(F.shiftright("both", 32).alias("x"), F.col("both").bitwiseAND(0xFFFFFFFF).alias("y"), "co_imports")
    for c in ("x", "y"):
        named = named.join(ids.select(F.col("id").alias(c), F.col("symbol").alias(f"of_{c}")), c).drop(c)
    pairs = named.select(F.least("of_x", "of_y").alias("symbol_a"), F.greatest("of_x", "of_y").alias("symbol_b"), "co_imports")
    return pairs.withColumn("cross_file", F.substring_index("symbol_a", "#", 1) != F.substring_index("symbol_b", "#", 1))


def innermost(spans: DataFrame, points: DataFrame) -> DataFrame:
    """file_id, line, hits, id: the smallest span around each point; ties go to
    the first start, then the least id (J10). A point is given by file_id and
    line; spans by file_id, id, start_line, end_line."""
    p = points.withColumn("_p", F.monotonically_increasing_id())
    inside = p.join(spans, "file_id").where("start_line <= line and line <= end_line")
    order = Window.partitionBy("_p").orderBy(F.col("end_line") - F.col("start_line"), "start_line", "id")
    return inside.withColumn("r", F.row_number().over(order)).where("r = 1").select(*points.columns, "id")


def coverage(points: DataFrame, by: str) -> DataFrame:
    """by, coverage_pct: share of points that were hit, rounded half up."""
    pct = F.floor(100 * F.count(F.when(F.col("hits") > 0, 1)) / F.count("*") + 0.5)
    return points.groupBy(by).agg(pct.cast("long").alias("coverage_pct"))


def unused_exports(exports: DataFrame, utilization: DataFrame, public: DataFrame) -> DataFrame:
    """Exported symbols that nothing uses, with whether their file is public
    (J13, J14, T7). exports: id, file_id, cognitive; public: file_id."""
    p = public.select("file_id").distinct().withColumn("public", F.lit(True))
    at = exports.join(utilization, "id", "left").where(F.coalesce("utilization", F.lit(0.0)) == 0).drop("utilization").join(p, "file_id", "left")
    return at.withColumn("public", F.coalesce("public", F.lit(False)))


def public_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """file_id of what barrels re-export."""
    barrels = nodes.where("role = 'barrel'").select(F.col("id").alias("src"))
    return edges.where("kind = 're-exports'").join(barrels, "src", "left_semi").select(F.col("dst").alias("file_id")).distinct()


def exports_by_file(symbols: DataFrame, k: int = 8) -> DataFrame:
    """The k most used exports and internals of each file."""
    order = Window.partitionBy("file_id", "exported").orderBy(F.desc("utilization"), "id")
    return symbols.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def importance(symbols: DataFrame) -> DataFrame:
    """id, importance: a file's centrality shared out by use, to 6 digits."""
    total = F.sum("utilization").over(Window.partitionBy("file_id"))
    return symbols.select("id", F.when(total > 0, F.round(F.col("centrality") * F.col("utilization") / total, 6)).otherwise(0.0).alias("importance"))


def depends_on(references: DataFrame, imports: DataFrame) -> DataFrame:
    """file_id, target: files that a file refers to or imports, without itself."""
    a = references.select(F.col("importer").alias("file_id"), F.col("file_id").alias("target"))
    return a.union(imports.select("src", "dst")).where("file_id != target").distinct()


def split_consumers(consumers_: DataFrame, nodes: DataFrame) -> DataFrame:
    """target, source_consumers, test_consumers by the role of the importer (M5).
    consumers_: target, importer."""
    role = consumers_.join(nodes.select(F.col("id").alias("importer"), "role"), "importer", "left")
    test = F.col("role").isin("test", "fixture")
    return role.groupBy("target").agg(
        F.sort_array(F.collect_set(F.when(~F.coalesce(test, F.lit(False)), F.col("importer")))).alias("source_consumers"), F.sort_array(F.collect_set(F.when(test, F.col("importer")))).alias("test_consumers")
    )
