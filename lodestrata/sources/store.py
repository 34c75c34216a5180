"""Snapshot store: Parquet folders partitioned by snapshot.

The row of `snapshot` is written last, so a snapshot is seen whole or not at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = {
    "snapshot": "id long, ref string, commit_hash string, taken_at timestamp, index_version string",
    "node": "snapshot_id long, id string, kind string, name string, parent_id string, language string, role string, attrs map<string,string>",
    "edge": "snapshot_id long, src string, dst string, kind string, specifier string, weight double",
    "metric": "snapshot_id long, node_id string, name string, value double, unit string",
    "id_alias": "snapshot_id long, old_id string, new_id string, reason string",
    "boundary": "snapshot_id long, algorithm string, community_id string, node_id string, modularity double",
    "entry_point": "snapshot_id long, node_id string, kind string, attrs map<string,string>",
    "file_fingerprint": "snapshot_id long, file_id string, content_hash string, structural_hash string",
    "embedding": "model string, text_hash string, dims int, vector array<float>",
}
KINDS = {"node": ("package", "module", "file", "symbol", "external"), "edge": ("imports", "re-exports", "calls", "extends", "implements", "references", "depends-on")}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _drop(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def read(self, table: str, snapshot: int | None = None, all_kinds: bool = False) -> DataFrame:
        """A table, of one snapshot by partition pruning. Symbols and references
        are left out of node and edge unless asked for (S18)."""
        schema, path = TABLES[table], self._path(table)
        out = self.spark.read.schema(schema).parquet(path) if self._exists(path) else self.spark.createDataFrame([], schema)
        if snapshot is not None:
            out = out.where(F.col("snapshot_id") == snapshot)
        if not all_kinds and table in ("node", "edge"):
            out = out.where(F.col("kind") != ("symbol" if table == "node" else "references"))
        return out

    def snapshots(self) -> DataFrame:
        """Newest first."""
        return self.read("snapshot").orderBy(F.desc("taken_at"), F.desc("id"))

    def latest(self, ref: str | None = None) -> int | None:
        s = self.snapshots() if ref is None else self.snapshots().where(F.col("ref") == ref)
        row = s.select("id").first()
        return row and row[0]

    def latest_per_ref(self) -> DataFrame:
        """The newest snapshot of each ref."""
        order = Window.partitionBy("ref").orderBy(F.desc("taken_at"), F.desc("id"))
        return self.read("snapshot").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")

    def find(self, spec: str, current: int | None = None) -> int | None:
        """By number, `previous` or ref."""
        if spec.isdigit():
            row = self.read("snapshot").where(F.col("id") == int(spec)).select("id").first()
        elif spec == "previous":
            row = self.snapshots().where(F.col("id") != (current if current is not None else self.latest())).select("id").first()
        else:
            return self.latest(spec)
        return row and row[0]

    def for_commit(self, ref: str, commit: str) -> tuple[int | None, bool]:
        """The ref's snapshot of a commit, else its newest, which is stale."""
        row = self.snapshots().where((F.col("ref") == ref) & (F.col("commit_hash") == commit)).select("id").first()
        return (row[0], False) if row else (self.latest(ref), True)

    def create(self, ref: str, commit: str | None, taken_at: str, version: str, **tables: DataFrame) -> int:
        """Writes the tables of a new snapshot, then its row."""
        new = (self.read("snapshot").agg(F.max("id")).first()[0] or 0) + 1
        for name, df in tables.items():
            self._append(name, df, new)
        row = self.spark.createDataFrame([(new, ref, commit, taken_at, version)], "id long, ref string, commit_hash string, t string, index_version string")
        row.select("id", "ref", "commit_hash", F.to_timestamp("t").alias("taken_at"), "index_version").write.mode("append").parquet(self._path("snapshot"))
        return new

    def _append(self, table: str, df: DataFrame, snapshot: int) -> None:
        names = [c.split()[0] for c in TABLES[table].replace("map<string,string>", "map").split(", ")]
        have = df.withColumn("snapshot_id", F.lit(snapshot).cast("long"))
        schema = {f.name: f.dataType for f in self.spark.createDataFrame([], TABLES[table]).schema}
        out = have.select(*((F.col(c) if c in have.columns else F.lit(None)).cast(schema[c]).alias(c) for c in names))
        if table in KINDS:
            bad = out.where(~F.col("kind").isin(*KINDS[table])).select("kind").first()
            if bad:
                raise ValueError(f"{table}: unknown kind {bad[0]}")
        self._drop(f"{self._path(table)}/snapshot_id={snapshot}")  # what a broken run left
        out.write.mode("append").partitionBy("snapshot_id").parquet(self._path(table))

    def replace_metrics(self, snapshot: int, name: str, rows: DataFrame) -> None:
        """One metric of a snapshot anew (S21). The new files are written beside
        the old ones before these go."""
        kept = self.read("metric", snapshot).where(F.col("name") != name).drop("snapshot_id")
        fresh = rows.select("node_id", F.lit(name).alias("name"), F.col("value").cast("double").alias("value"), (F.col("unit") if "unit" in rows.columns else F.lit(None).cast("string")).alias("unit"))
        side = f"{self.root}/.next-metric"
        kept.unionByName(fresh).write.mode("overwrite").parquet(side)
        self._append("metric", self.spark.read.parquet(side), snapshot)
        self._drop(side)

    def delete(self, snapshots: Sequence[int]) -> None:
        """Rows of the snapshots first, then their partitions."""
        side = f"{self.root}/.next-snapshot"
        self.read("snapshot").where(~F.col("id").isin(*snapshots)).write.mode("overwrite").parquet(side)
        self.spark.read.parquet(side).write.mode("overwrite").parquet(self._path("snapshot"))
        self._drop(side)
        for t, schema in TABLES.items():
            if schema.startswith("snapshot_id"):
                for s in snapshots:
                    self._drop(f"{self._path(t)}/snapshot_id={s}")

    def counts(self) -> DataFrame:
        """table, rows."""
        out = None
        for t in TABLES:
            c = self.read(t, all_kinds=True).agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows")
            out = c if out is None else out.unionByName(c)
        return out

    def prune_plan(self, keep: int = 10, keep_refs: Sequence[str] = ()) -> DataFrame:
        return prune_plan(self.read("snapshot"), keep, keep_refs)

    def prune(self, keep: int = 10, keep_refs: Sequence[str] = ()) -> list[int]:
        gone = [r[0] for r in self.prune_plan(keep, keep_refs).where("not keep").select("id").collect()]
        if gone:
            self.delete(gone)
        return gone


def prune_plan(snapshots: DataFrame, keep: int = 10, keep_refs: Sequence[str] = ()) -> DataFrame:
    """id, ref, keep: the newest `keep` snapshots and those of kept refs stay."""
    new = snapshots.orderBy(F.desc("taken_at"), F.desc("id")).limit(keep).select("id", F.lit(True).alias("new"))  # `keep` rows at most
    named = F.coalesce(F.col("ref").isin(*keep_refs), F.lit(False)) if keep_refs else F.lit(False)
    return snapshots.join(F.broadcast(new), "id", "left").select("id", "ref", (F.coalesce("new", F.lit(False)) | named).alias("keep"))
