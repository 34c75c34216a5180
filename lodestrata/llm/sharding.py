"""Sharding by Karmarkar-Karp differencing over indivisible groups.

A partial partition is a tuple of k bin sums. The two of largest spread (largest
less smallest sum) are combined again and again, the largest bin of one with the
smallest of the other, until one partition is left; smaller groups so balance
the differences that larger ones left.

Differencing is one sequence, so its input is bounded at any size: groups of less
than 1 / (k * FINE) of all bytes are first bundled, each whole, up to that
weight. At most 2 * k * FINE bundles and larger groups, and one bundle more for
every NODE groups, then go to one task. Bundles are so fine that the balance is
as tight as a bundle at worst.

Groups default to documents of equal text, so copies never part. A group's
weight is the UTF-8 bytes of its texts.

Defined results: null and empty texts weigh nothing; all null texts are one
group. Repeated rows count as often as they occur, and appear so in the result.
A null doc_id is as any other. Ties are resolved by group key. An empty table
gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import cut

SHARDS = 64
#: Bundles a shard, and groups that are bundled by one task.
FINE, NODE = 256, 1_000_000


def difference(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines n partial partitions (rows of k sums) into one.

    Returns the k sums and, for each row and column, the bin that it went to.
    """
    n, k = sums.shape
    heap = []
    #: chains of (row, column) cells: the first and last cell of each bin
    nxt = np.full(n * k, -1, np.int64)
    for r in range(n):
        order = np.argsort(-sums[r], kind="stable")
        s = sums[r][order]
        cells = r * k + order
        heap.append((-int(s[0] - s[-1]), r, s, cells, cells.copy()))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, ra, sa, ha, ta = heapq.heappop(heap)
        _, rb, sb, hb, tb = heapq.heappop(heap)
        s = sa + sb[::-1]
        nxt[ta] = hb[::-1]
        order = np.argsort(-s, kind="stable")
        s = s[order]
        heapq.heappush(heap, (-int(s[0] - s[-1]), min(ra, rb), s, ha[order], tb[::-1][order]))
    _, _, s, heads, _ = heap[0]
    to = np.empty(n * k, np.int64)
    at, live = heads.copy(), np.arange(k)
    while len(at):
        to[at] = live
        at = nxt[at]
        live, at = live[at >= 0], at[at >= 0]
    return s, to.reshape(n, k)


def single(weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and bins for single groups. Only the nonzero bin of a group matters,
    so groups are kept as (bin sums, members) with the same rule as difference."""
    sums = np.zeros((len(weights), k), np.int64)
    sums[:, 0] = weights
    s, to = difference(sums)
    return s, to[:, 0]


KEY = ["node", "part", "alone"]


def _difference(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", *KEY], ascending=[False, True, True, True], kind="stable")
        _, slot = single(pdf["w"].to_numpy(), k)
        return pdf[KEY].assign(shard=slot)

    return run


def balance(groups: DataFrame, k: int, fine: int = FINE, per_node: int = NODE) -> DataFrame:
    """g, w, shard for groups (g long, w long)."""
    n, total = groups.agg(F.count("*"), F.sum("w")).first()
    size = max(1, -(-(total or 0) // (k * fine)))
    small = F.col("w") < size
    node = F.pmod(F.xxhash64("g"), F.lit(max(1, -(-n // per_node))))
    before = F.sum(F.when(small, F.col("w")).otherwise(0)).over(Window.partitionBy("node").orderBy("g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    keyed = groups.withColumn("node", node).withColumns({"part": F.when(small, F.floor(before / size)).otherwise(-1).cast("long"), "alone": F.when(small, 0).otherwise(F.col("g"))})
    bundles = keyed.groupBy(*KEY).agg(F.sum("w").alias("w"))
    placed = bundles.groupBy(F.lit(0).alias("all")).applyInPandas(_difference(k), "node long, part long, alone long, shard int")
    return keyed.join(placed, KEY).select("g", "w", "shard")


def shards(docs: DataFrame, k: int = SHARDS, group: Column | None = None, **kw) -> DataFrame:
    """doc_id, group_key, group_bytes, shard for every row of docs."""
    key = F.xxhash64("text") if group is None else group
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(key, F.lit(0)).cast("long").alias("g"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("w"))
    rows = cut(rows)
    groups = cut(rows.groupBy("g").agg(F.sum("w").alias("w")))
    return rows.drop("w").join(balance(groups, k, **kw), "g").select("doc_id", F.col("g").alias("group_key"), F.col("w").alias("group_bytes"), "shard")
