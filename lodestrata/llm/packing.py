"""Best-fit packing by minimum bin slack.

Each bin starts with the longest piece that is left; a subset-sum programme over
bitsets, one bit for each reachable fill, then finds the fullest combination of
the lengths that are left, which is removed. Bins of one shard are filled by one
task; shards hold about `per_shard` pieces, so a task's memory doesn't grow with
the input, and every piece is packed.

Lengths are words: maximal runs of characters that are no white space, counted
as (white space after a word) + 1. A text of more than `capacity` words is cut
into full pieces, which fill bins of their own, and one last shorter piece.

Defined results: repeated rows are packed as often as they occur. Null, empty
and blank texts have no words and are in no bin. A null doc_id is packed like
any other. Bins of equal slack take the longer lengths first; equal lengths go
in the order (doc_id, content hash). Other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.text import chunks, raw
from lodestrata.runtime import cut, lean

CAPACITY = 2048
#: Pieces that one task packs.
PER_SHARD = 50_000
OUT = "doc_id long, piece int, n_words int, bin_id string, first_word int"


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each of the lengths (ascending) fill most of room; longer
    lengths come first."""
    steps: list[tuple[int, int, int]] = []  # length, copies, fills reachable before
    reach, mask, full = 1, (1 << room + 1) - 1, 1 << room
    for x in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[x]
        left, part = min(counts[length], room // length), 1
        while left:  # binary splitting of the copies
            n = min(part, left)
            steps.append((length, n, reach))
            reach |= reach << n * length & mask
            left -= n
            part *= 2
            if reach & full:
                break
        if reach & full:
            break
    at, take = reach.bit_length() - 1, defaultdict(int)
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            take[length] += n
            at -= n * length
    return take


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece of 1 to capacity words; pieces of equal
    length are used in their order."""
    queues: dict[int, list[int]] = defaultdict(list)
    for i in range(len(lengths) - 1, -1, -1):
        queues[int(lengths[i])].append(i)
    counts = {n: len(q) for n, q in queues.items()}
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left = sorted(counts)
    b = 0

    def take(n: int, c: int) -> None:
        counts[n] -= c
        if not counts[n]:
            del left[bisect_left(left, n)]

    while left:
        longest, at = left[-1], 0
        take(longest, 1)
        inside = [(longest, 1)]
        if capacity > longest:
            rest = fullest(left, counts, capacity - longest)
            for n, c in rest.items():
                take(n, c)
            inside += rest.items()
        for n, c in inside:
            for _ in range(c):
                i = queues[n].pop()
                bins[i], offsets[i] = b, at
                at += n
        b += 1
    return bins, offsets


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
COUNTED = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            data, offs = raw(part.column("text"))
            if not len(data):
                continue
            inside = ~SPACE[data]
            starts = inside.copy()
            starts[1:] &= ~inside[:-1]
            first = offs[:-1][np.diff(offs) > 0]
            starts[first] = inside[first]
            n = np.diff(np.concatenate([[0], np.cumsum(starts, dtype=np.int64)])[offs])
            out = pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(n)], schema=COUNTED)
            yield out.filter(pc.greater(out.column("n"), 0))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, h (content hash), n of every row that has words."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return texts.mapInArrow(lean(_count), "doc_id long, h long, n long")


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "h"], kind="stable", na_position="first")
        n = pdf["n"].to_numpy()
        rest = n % capacity
        some = rest > 0
        bins, offs = pack(rest[some], capacity)
        shard = str(pdf["shard"].iloc[0])
        last = pd.DataFrame({"doc_id": pdf["doc_id"][some], "piece": n[some] // capacity, "n_words": rest[some], "bin_id": [f"{shard}-{b}" for b in bins], "first_word": offs})
        whole = n // capacity
        row = np.repeat(np.arange(len(n)), whole)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(whole) - whole, whole)
        full = pd.DataFrame({"doc_id": pdf["doc_id"].iloc[row], "piece": piece, "n_words": capacity, "bin_id": [f"{shard}-f{x}" for x in range(len(row))], "first_word": 0})
        return pd.concat([last, full]) if len(full) else last

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, piece, n_words, bin_id, first_word (the piece's offset in its bin)."""
    counted = cut(word_counts(docs))
    shards = max(1, -(-counted.count() // per_shard))
    # a column with nulls would reach pandas as floating point, which can't hold every id
    keyed = counted.withColumns({"shard": F.pmod(F.xxhash64("doc_id", "h"), F.lit(shards)), "doc_id": F.coalesce("doc_id", F.lit(-(1 << 63)))})
    out = keyed.groupBy("shard").applyInPandas(_pack(capacity), OUT)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")))
