"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Words are compared. An item of n words leaks into a document where a run of its
words lies within edit distance floor(rate * n) of the item. The CGK random walk
maps a window to a bit string whose Hamming distance grows with the edit
distance; bit samples of it are hashed in several tables, each with its own
walk, and pairs that meet in a table are verified by exact edit distance.

The number of tables follows from a target recall. For each length of items,
windows at the largest distance that counts are made up and embedded; the share
of bits in which they agree gives the chance that a sample meets, and walks are
added until the target is met for those. Samples have so many bits that a window
meets about one item of its length by chance.

Embedding every window of every length costs hundreds of steps for each word of
the corpus, so windows that can't match aren't embedded: by the pigeonhole
principle a match leaves one of distance + 1 equal parts of the item intact, so
it holds a run of floor(n / (distance + 1)) of the item's words; windows are set
around such runs at every start that the distance allows. That loses nothing.

The benchmark is sent to the executors in slices of at most SLICE bytes, each
one pass over the documents.

Defined results: rows with null doc_id or text give nothing and are kept by
decontaminate; so give items without words or with a null id. Repeated rows and
items give one row. An empty table of documents or items gives no rows. Other
columns, of any name, are carried along by decontaminate and aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.columns import fresh, quoted
from lodestrata.llm.text import U, chunks, mix, word_hash, words
from lodestrata.runtime import cut, lean, maybe_broadcast

RATE, RECALL = 0.2, 0.95
#: Bit samples of each walk; walks at most, and pairs that are made up for each length.
TABLES, WALKS, PAIRS = 4, 64, 48
#: Bytes of the index that are sent to the executors at once.
SLICE = 32 << 20
OUT = "doc_id long, item_id long, first_word int, end_word int, distance int"
ITEM = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("distance", pa.int32())])
PAD = U(0x9D5C0FFEE)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    at = np.arange(len(b) + 1)
    row = at.copy()
    for i, x in enumerate(a, 1):
        sub = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[i], sub]) - at) + at
        if row.min() > most:
            return most + 1
    return int(min(row[-1], most + 1))


def cgk(windows: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """One bit per step for each row of word hashes (padded on the right)."""
    n, width = windows.shape
    at = np.zeros(n, np.int64)
    rows = np.arange(n)
    bits = np.empty((n, steps), bool)
    for j in range(steps):
        symbol = np.where(at < width, windows[rows, np.minimum(at, width - 1)], PAD)
        r = mix(symbol + U((walk * 1_000_003 + j) * 0x9E3779B97F4A7C15 % (1 << 64)))
        bits[:, j] = (r >> U(40)) & U(1)
        at += ((r >> U(17)) & U(1)).astype(np.int64)
    return bits


def altered(n: int, edits: int, r: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two padded rows of n words, the second with so many random edits."""
    new = lambda k: r.integers(1, 1 << 62, k, dtype=np.int64).astype(U)
    a = new(n)
    b = list(a)
    for _ in range(edits):
        p, kind = int(r.integers(0, max(1, len(b)))), int(r.integers(0, 3))
        b[p : p + (kind < 2)] = list(new(int(kind > 0)))
    row = np.full(n, PAD)
    row[: min(n, len(b))] = b[:n]
    return a, row


def plan(n: int, edits: int, items: int, recall: float) -> tuple[int, int]:
    """Walks and bits of a sample that reach the recall for windows of n words at
    so many edits, where items have this length."""
    if not edits:
        return 1, min(2 * n, 40)
    r = np.random.default_rng(n * 1009 + edits)
    a, b = map(np.stack, zip(*(altered(n, edits, r) for _ in range(PAIRS))))
    agree, missed = [], None
    for walks in range(1, WALKS + 1):
        agree.append((cgk(a, walks - 1, 2 * n) == cgk(b, walks - 1, 2 * n)).mean(axis=1))
        bits = int(min(2 * n, max(6, np.ceil(np.log2(walks * TABLES * items)))))
        missed = np.prod([(1 - q**bits) ** TABLES for q in agree], axis=0)
        if 1 - missed.mean() >= recall:
            break
    return walks, bits


class Index:
    """Items by length: their seeds of intact words and their LSH tables, as
    arrays sorted by key."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rate: float = RATE, recall: float = RECALL):
        self.rate = rate
        self.items = [(i, h) for i, h in items if len(h)]
        by_len: dict[int, list[int]] = {}
        seeds: dict[int, list[tuple[int, int, int]]] = {}
        for x, (_, h) in enumerate(self.items):
            by_len.setdefault(len(h), []).append(x)
            d = self.most(len(h))
            q = len(h) // (d + 1)
            seeds.setdefault(q, []).extend((int(gram(h[p * q : p * q + q])), x, p * q) for p in range(d + 1))  # the parts start where they start in the item
        self.seeds = {}
        for q, rows in seeds.items():
            key = np.array([k for k, _, _ in rows], U)
            order = np.argsort(key)
            self.seeds[q] = key[order], np.array([x for _, x, _ in rows], np.int32)[order], np.array([o for _, _, o in rows], np.int32)[order]
        self.plans = {n: plan(n, self.most(n), len(xs), recall) for n, xs in by_len.items()}
        self.lsh: dict[int, list[list[tuple[np.ndarray, np.ndarray]]]] = {}
        for n, xs in by_len.items():
            rows, own = np.stack([self.items[x][1] for x in xs]), np.array(xs, np.int32)
            self.lsh[n] = []
            for walk in range(self.plans[n][0]):
                keys = self.keys(rows, n, walk)
                orders = [np.argsort(k) for k in keys]
                self.lsh[n].append([(k[o], own[o]) for k, o in zip(keys, orders)])

    def most(self, n: int) -> int:
        return int(self.rate * n)

    def keys(self, rows: np.ndarray, n: int, walk: int) -> list[np.ndarray]:
        bits = cgk(rows, walk, 2 * n)
        rng = np.random.default_rng(walk * 7919 + n)
        size = self.plans[n][1]
        power = U(1) << np.arange(size, dtype=U)
        return [(bits[:, rng.choice(2 * n, size, replace=False)] * power).sum(axis=1, dtype=U) for _ in range(TABLES)]

    def windows(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """Starts, by item length, around each intact part of an item."""
        out: dict[int, list[np.ndarray]] = {}
        lens = np.array([len(w) for _, w in self.items])
        for q, (key, item, off) in self.seeds.items():
            if len(h) < q:
                continue
            g = grams(h, q)
            lo, hi = np.searchsorted(key, g), np.searchsorted(key, g, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            many = (hi - lo)[hit]
            p = np.repeat(hit, many)
            row = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            start, n = p - off[row], lens[item[row]]
            for size in np.unique(n).tolist():
                d = self.most(size)
                at = (np.unique(start[n == size])[:, None] + np.arange(-d, d + 1)).ravel()
                out.setdefault(size, []).append(np.clip(at, 0, len(h) - 1))
        return {n: np.unique(np.concatenate(parts)) for n, parts in out.items()}

    def search(self, docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
        """doc index, item_id, first word, end and distance of the best place of
        each item in each document. Windows of all documents are embedded together."""
        where: dict[int, list[tuple[int, np.ndarray]]] = {}
        for x, h in enumerate(docs):
            for n, starts in self.windows(h).items():
                where.setdefault(n, []).append((x, starts))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, spots in where.items():
            doc = np.repeat([x for x, _ in spots], [len(s) for _, s in spots])
            start = np.concatenate([s for _, s in spots])
            rows = np.full((len(start), n), PAD)
            at = 0
            for x, s in spots:
                padded = np.concatenate([docs[x], np.full(n, PAD)])
                rows[at : at + len(s)] = padded[s[:, None] + np.arange(n)]
                at += len(s)
            met: list[np.ndarray] = []
            for walk, tables in enumerate(self.lsh[n]):
                for own, (key, item) in zip(self.keys(rows, n, walk), tables):
                    lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, "right")
                    many = hi - lo
                    r = np.repeat(np.arange(len(own)), many)
                    found = item[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
                    met.append(np.unique(found.astype(np.int64) << 32 | r))
            pairs = np.unique(np.concatenate(met))
            item, r = pairs >> 32, pairs & 0xFFFFFFFF
            order = np.lexsort((start[r], doc[r], item))
            item, r = item[order], r[order]
            edge = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (doc[r][1:] != doc[r][:-1])])) if len(r) else np.zeros(0, np.int64)
            for a, b in zip(edge, np.append(edge[1:], len(r))):
                x, (i, words) = int(doc[r[a]]), self.items[item[a]]
                got = nearest(words, docs[x], start[r[a:b]], self.most(n))
                if got and ((x, i) not in best or got < best[x, i]):
                    best[x, i] = got
        return [(x, i, s, e, d) for (x, i), (d, s, e) in sorted(best.items())]


def nearest(item: np.ndarray, h: np.ndarray, starts: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """The least (distance, start, end) of item to the runs of h that begin at
    starts, if within most. One programme gives all starts and ends together."""
    width = len(item) + most
    at = starts[:, None] + np.arange(width)
    inside = at < len(h)
    text = h[np.minimum(at, len(h) - 1)]
    col = np.arange(width + 1)
    row = np.repeat(col[None, :], len(starts), 0)
    for n, word in enumerate(item, 1):
        new = np.empty_like(row)
        new[:, 0] = n
        new[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + ((text != word) | ~inside))
        row = np.minimum.accumulate(new - col, axis=1) + col
    row[:, 1:][~inside] = most + 1
    row[:, 0] = most + 1
    least = int(row.min())
    if least > most:
        return None
    r, c = np.argwhere(row == least)[0]
    return least, int(starts[r]), int(starts[r] + c)


def grams(h: np.ndarray, q: int) -> np.ndarray:
    g = np.zeros(len(h) - q + 1, U)
    for j in range(q):
        g = g * U(0x100000001B3) + h[j : len(h) - q + 1 + j]
    return mix(g)


def gram(h: np.ndarray) -> np.ndarray:
    return grams(h, len(h))[0]


#: Words of documents with hits that are searched together.
TOGETHER = 1 << 20


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            rows = [(held[x][0], *r) for x, *r in index.search([h for _, h in held])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], ITEM.field(c).type) for c in range(5)], schema=ITEM)

        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                ids = part.column("doc_id").to_pylist()
                hit = np.zeros(len(w.hash), bool)
                for q, (keys, _, _) in index.seeds.items():
                    if len(w.hash) >= q:
                        g = grams(w.hash, q)
                        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
                        hit[: len(g)] |= keys[at] == g
                for d in np.unique(np.searchsorted(w.offs, np.flatnonzero(hit), "right") - 1):
                    held.append((ids[d], w.hash[w.offs[d] : w.offs[d + 1]].copy()))
                if sum(len(h) for _, h in held) > TOGETHER:
                    yield flush()
        yield flush()

    return run


def sliced(items: Iterator, limit: int) -> Iterator[list]:
    """Items in slices whose index takes about `limit` bytes at most."""
    held, size = [], 0
    for r in items:
        own = word_hash(r.text)
        took = 8 * len(own) + 20 * (int(RATE * len(own)) + 1) + 12 * WALKS * TABLES
        if held and size + took > limit:
            yield held
            held, size = [], 0
        held.append((r.i, own))
        size += took
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, recall: float = RECALL, limit: int = SLICE) -> DataFrame:
    """doc_id, item_id, first_word, end_word, distance: the best place of each
    item in each document, at the least (distance, start, end)."""
    spark: SparkSession = docs.sparkSession
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), "text").distinct()
    found = spark.createDataFrame([], OUT)
    for rows in sliced(items.toLocalIterator(), limit):
        found = found.unionByName(texts.mapInArrow(lean(_scan(spark.sparkContext.broadcast(Index(rows, rate, recall)))), OUT))
    best = F.min(F.struct("distance", "first_word", "end_word")).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.first_word").alias("first_word"), F.col("b.end_word").alias("end_word"), F.col("b.distance").alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """docs without the documents that hold an item; rows with a null doc_id stay."""
    name = fresh(docs, "_dc_id")
    hit = cut(leaks(docs, benchmark, **kw).select(F.col("doc_id").alias(name)).distinct())
    return docs.withColumn(name, F.col("doc_id").cast("long")).join(maybe_broadcast(hit, 16), name, "left_anti").select(*map(quoted, docs.columns))
