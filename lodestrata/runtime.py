"""Session helpers: checkpoint folder, lineage cuts, size-checked broadcasts and memory of workers."""

from __future__ import annotations

import ctypes
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast, as rows times an assumed row width.
BROADCAST_BYTES = 32 << 20
#: Rows that one task sorts or counts at most, where the operator sets its number of tasks.
TASK_ROWS = 400_000


def session(app: str = "lodestrata", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators expect."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset a temporary folder is used on a local master only; a
    cluster without a shared folder is an error, since a machine-local folder
    would be lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.mkdtemp(prefix="lodestrata-"), "checkpoints")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def maybe_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the rows fit the limit; otherwise leave the
    choice of join to the planner. The count stops one row past the limit."""
    most = max(1, limit // max(1, row_bytes))
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by the hash of keys, in a partition for each TASK_ROWS of its rows, so that
    a task takes no more memory for a larger input. Such partitions aren't merged
    again, and aggregations and windows by the keys need no other exchange."""
    few = min(df.sparkSession.sparkContext.defaultParallelism, rows // 10_000 + 1)
    return df.repartition(max(few, -(-rows // TASK_ROWS)), *keys)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, materialised, with a number for each row from 0 without gaps, below 2^31."""
    at = cut(df.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted(tuple(r) for r in at.groupBy(part.alias("k")).agg(F.count("*").alias("n")).collect())
    starts = [(k, sum(n for _, n in sizes[:i])) for i, (k, _) in enumerate(sizes)]
    total = sum(n for _, n in sizes)
    if total >= 1 << 31:
        raise OverflowError(f"{total} rows have no number of 31 bits")
    first = df.sparkSession.createDataFrame(starts or [(0, 0)], "_k long, _first long")
    return at.withColumn("_k", part).join(F.broadcast(first), "_k").select(*df.columns, (F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def give_back() -> None:
    """Returns memory that this process has freed to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def lean(run: Callable) -> Callable:
    """run over batches; a worker that waits for its next task then holds no memory that it has freed."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return f
