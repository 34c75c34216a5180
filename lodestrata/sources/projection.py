"""Code-graph relations derived from the trade tables.

No source repository comes with the tables, so each relation is a fixed
projection of them: orders stand for commits, suppliers for authors, parts for
files, brands for packages, part types for domains, customers for importing
files of symbols. ``CTE`` says the same in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.runtime import BROADCAST_BYTES, spread

ROLE = """case p_partkey % 10 when 0 then 'barrel' when 1 then 'test' when 2 then 'types' when 3 then 'entry'
when 4 then 'config' when 5 then 'fixture' when 6 then 'script' when 7 then 'generated' else 'source' end"""

CTE = f"""
churn as (select cast(l_orderkey as bigint) as commit_id, cast(l_suppkey as bigint) as author, cast(l_partkey as bigint) as file_id,
  cast(floor(epoch(l_shipdate)) as bigint) as epoch, cast(floor(l_quantity) as bigint) as added, cast(l_linenumber as bigint) as deleted from lineitem),
clock as (select max(epoch) as now from churn),
files as (select cast(p_partkey as bigint) as id, {ROLE} as role, p_brand as package, p_type as domain, p_name as name,
  cast(p_size as double) as cognitive_max, floor(p_retailprice) as loc from part),
touched as (select distinct commit_id, file_id from churn),
edges as (select e.src, e.dst, case when f.role = 'barrel' then 're-exports' else 'imports' end as kind, cast(e.weight as double) as weight from
  (select a.file_id as src, b.file_id as dst, count(*) as weight from touched a join touched b on a.commit_id = b.commit_id and a.file_id < b.file_id
   group by 1, 2 having count(*) >= 2) e join files f on f.id = e.src),
refs as (select distinct cast(o_custkey as bigint) as importer, p_brand || '#' || cast(p_partkey as varchar) as symbol, cast(p_partkey as bigint) as file_id
  from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey)
"""


class Relations:
    """The relations of one folder of tables, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def churn(self) -> DataFrame:
        """commit_id, author, file_id, epoch, added, deleted"""
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("long").alias("commit_id"),
            F.col("l_suppkey").cast("long").alias("author"),
            F.col("l_partkey").cast("long").alias("file_id"),
            F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("epoch"),
            F.floor("l_quantity").cast("long").alias("added"),
            F.col("l_linenumber").cast("long").alias("deleted"),
        )

    @cached_property
    def now(self) -> int:
        return self.churn.agg(F.max("epoch")).first()[0] or 0

    @property
    def files(self) -> DataFrame:
        """id, role, package, domain, name, cognitive_max, loc"""
        return self.table("part").select(
            F.col("p_partkey").cast("long").alias("id"),
            F.expr(ROLE).alias("role"),
            F.col("p_brand").alias("package"),
            F.col("p_type").alias("domain"),
            F.col("p_name").alias("name"),
            F.col("p_size").cast("double").alias("cognitive_max"),
            F.floor("p_retailprice").cast("double").alias("loc"),
        )

    @property
    def edges(self) -> DataFrame:
        """src, dst, kind, weight: parts of one order, where two orders agree"""
        lines = self.churn.select("commit_id", "file_id").where("commit_id is not null")
        n, most = lines.groupBy("commit_id").agg(F.count("*").alias("k")).agg(F.sum("k"), F.sum(F.expr("k * (k - 1) div 2"))).first()
        files = spread(lines, n or 0, "commit_id").groupBy("commit_id").agg(F.sort_array(F.collect_set("file_id")).alias("files"))
        later = files.select(F.posexplode("files").alias("at", "src"), "files").select("src", F.explode(F.slice("files", F.col("at") + 2, F.size("files"))).alias("dst"))
        counted = spread(later, most or 0, "src", "dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")).where("weight >= 2")
        kind = F.when(F.col("role") == "barrel", "re-exports").otherwise("imports")
        return counted.join(self.files.select(F.col("id").alias("src"), "role"), "src").select("src", "dst", kind.alias("kind"), "weight")

    @property
    def references(self) -> DataFrame:
        """importer, symbol, file_id"""
        lines, parts = self.table("lineitem"), self.table("part")
        n, few = lines.count(), parts.count() * 64 <= BROADCAST_BYTES
        bought = (
            spread(self.table("orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("importer")), n, "o_orderkey")
            .join(spread(lines.select("l_orderkey", "l_partkey"), n, "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("importer", "l_partkey")
        )
        named = parts.select("p_partkey", F.concat_ws("#", "p_brand", F.col("p_partkey").cast("string")).alias("symbol"), F.col("p_partkey").cast("long").alias("file_id"))
        bought, named = (bought, F.broadcast(named)) if few else (spread(bought, n, "l_partkey"), spread(named, n, "p_partkey"))
        every = bought.join(named, F.col("p_partkey") == F.col("l_partkey")).select("importer", "symbol", "file_id")
        return spread(every, n, "importer").distinct()
