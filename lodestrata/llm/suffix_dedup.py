"""Suffix-array deduplication of word runs by external induced sorting.

Every run of `least` words that occurs earlier in the corpus is found, exactly.
Earlier means by (doc_id, content hash, position).

The corpus is cut so that equal runs meet in one shard: a window of `least`
words belongs to its minimizer, the least hash of its runs of SEED words, and
consecutive windows with one minimizer make a segment. Segments whose minimizer
occurs once are done with. Of segments of equal content all but the first repeat
it whole. Where segments of one minimizer differ, the first of each content goes
to a shard, whose suffix array, with common prefixes, tells which of their
windows are equal (see suffix_sort). A minimizer with more than an eighth of a
shard is parted by the second least hash of its windows. A shard's text leaves
out what no window can share: positions whose run of SEED words is single in the
shard.

A shard is streamed to files in the shared checkpoint folder and sorted there,
so a task holds a few blocks of it, however large it is; its files go when it is
done. Where that folder isn't a path (an object store) a shard of about
`per_shard` words is held in memory.

Defined results: a document is a pair of doc_id and text; repeated rows are one
document. Null ids or texts, and texts of fewer than `least` words, give
nothing; an empty table gives no rows. Runs may repeat within a document. Other
columns, of any name, aren't read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.suffix_sort import BASE, HELD, Disk, Tape, ranked, remove, sort
from lodestrata.llm.text import U, Words, chunks, mix, powers, roll, words
from lodestrata.runtime import checkpoint_dir, cut

LEAST, SEED = 50, 8
#: Words of a shard's suffix array.
PER_SHARD = 250_000


def shared_folder(spark: SparkSession) -> str | None:
    """The checkpoint folder as a path that executors can open, if it is one."""
    url = urlparse(checkpoint_dir(spark))
    return os.path.join(url.path, "suffix-queues") if url.scheme in ("", "file") else None


def least_of_windows(g: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of width hashes inside a document and the place of
    its rightmost minimum."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # minima by doubling; places break ties to the right
    value, place, have = g.copy(), np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        a, b = value[:-step], value[step:]
        right = b <= a
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, b, a)
        have += step
    ok = np.ones(n, bool)
    for edge in offs[1:-1]:
        ok[max(0, edge - width + 1) : edge] = False
    start = np.flatnonzero(ok)
    return start, place[start]


SEGMENT = pa.schema([("fp", pa.int64()), ("ch", pa.int64()), ("i", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def segments_of(w: Words, least: int) -> tuple[np.ndarray, ...]:
    """document, first word (in the batch), number of windows, minimizer and
    content hash of each segment."""
    g, at = w.grams(SEED)
    offs = np.searchsorted(at, w.offs)
    start, pick = least_of_windows(g, offs, least - SEED + 1)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(U), z.astype(U)
    doc = np.searchsorted(offs, start, "right") - 1
    cut_at = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]))
    n = np.diff(np.append(cut_at, len(start)))
    first = at[start[cut_at]]
    end = first + n + least - 1
    pw, inv = powers(len(w.hash) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(w.hash * pw[: len(w.hash)], dtype=U)])
    content = mix((sums[end] - sums[first]) * inv[first] + n.astype(U))
    return doc[cut_at], first, n, g[pick[cut_at]], content


def _segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                doc, first, n, fp, content = segments_of(w, least)
                at = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(content.view(np.int64)), part.column("i").take(at), part.column("h").take(at), pa.array((first - w.offs[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], schema=SEGMENT)

    return run


def parted(g: np.ndarray, fp: U, n: int, least: int) -> Iterator[tuple[U, int, int]]:
    """Key, first window and number of windows of the parts of a segment of n
    windows with seeds g, by the second least hash."""
    rest = np.where(g == fp, U(0xFFFFFFFFFFFFFFFF), g)
    _, place = least_of_windows(rest, np.array([0, len(g)]), least - SEED + 1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    for a, b in zip(first, np.append(first[1:], n)):
        yield mix(np.array([fp ^ mix(rest[place[a] : place[a] + 1])[0]], U))[0], int(a), int(b - a)


def _slices(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                rows: list[list] = [[], [], [], [], []]

                def give(key, i, h, s, n, base):
                    a = base + s
                    for c, v in zip(rows, (int(key.view(np.int64)), i, h, s, w.hash[a : a + n + least - 1].tobytes())):
                        c.append(v)

                for d, (i, h, spots) in enumerate(zip(*(part.column(c).to_pylist() for c in ("i", "h", "spots")))):
                    base = w.offs[d]
                    for x in spots:
                        fp = np.array([x["fp"]], np.int64).view(U)[0]
                        if not x["hot"]:
                            give(fp, i, h, x["s"], x["n"], base)
                            continue
                        a = base + x["s"]
                        g, _ = roll(w.hash[a : a + x["n"] + least - 1], np.array([0, x["n"] + least - 1]), SEED)
                        for key, off, n in parted(g, fp, x["n"], least):
                            give(key, i, h, x["s"] + off, n, base)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["key", "i", "h", "s", "words"])

    return run


NONE = np.iinfo(np.int64).max


class Shard:
    """The parts of a shard, in order, and which of their windows occur earlier."""

    def __init__(self, disk: Disk, least: int, base: int = BASE):
        self.disk, self.least, self.base = disk, least, base
        self.words, self.meta = Tape(disk, 1), Tape(disk, 4)
        self.note: dict = {}

    def add(self, words: np.ndarray, meta: np.ndarray) -> None:
        """words of parts, and for each part doc_id, hash, first word and length."""
        self.words.append(words.view(np.int64)[:, None])
        self.meta.append(meta)

    def _parts(self, meta: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """Blocks of parts: their rows, where their words begin, their offsets from there."""
        step, at = max(1, self.disk.held // (2 * self.least)), 0
        for a in range(0, len(meta), step):
            own = np.asarray(meta[a : a + step])
            offs = np.concatenate([[0], np.cumsum(own[:, 3])])
            yield own, at, offs
            at += int(offs[-1])

    def later(self) -> Iterator[np.ndarray]:
        """Rows of doc_id, hash, first word and number of later windows."""
        disk, least, meta = self.disk, self.least, self.meta.rows()
        every = self.words.rows()[:, 0]
        n = len(every)
        seeds, places = Tape(disk, 1), Tape(disk, 1)
        for _, at, offs in self._parts(meta):
            g, p = roll(np.array(every[at : at + offs[-1]]).view(U), offs, SEED)
            seeds.append(g.view(np.int64)[:, None])
            places.append((p + at)[:, None])
        rank, _, again = ranked(disk, seeds.rows()[:, 0])
        spot = places.rows()[:, 0]
        flagged = disk.empty(n, bool)
        for a, b in disk.spans(len(spot)):
            flagged[spot[a:b]] = again[a:b]
        disk.drop(rank, again)
        del rank, again, spot
        seeds.free()
        places.free()
        # pieces of repeated seeds that are long enough for a window: the places
        # of their words and the words from there on; a place of -1 closes each
        pieces, inside = Tape(disk, 2), Tape(disk, 1)
        for _, at, offs in self._parts(meta):
            live = np.flatnonzero(flagged[at : at + offs[-1]])
            if not len(live):
                continue
            owner = np.searchsorted(offs, live, "right")
            first = np.flatnonzero(np.concatenate([[True], (np.diff(live) > 1) | (np.diff(owner) > 0)]))
            size = np.diff(np.append(first, len(live)))
            long = size >= least - SEED + 1
            begin, count = live[first[long]] + at, size[long] + SEED - 1
            if not len(begin):
                continue
            start = np.cumsum(count + 1) - (count + 1)
            k = np.arange(int((count + 1).sum())) - np.repeat(start, count + 1)
            room = np.repeat(count, count + 1) - k
            place = np.where(room > 0, np.repeat(begin, count + 1) + k, -1)
            pieces.append(np.column_stack([place, room]))
            inside.append(np.asarray(every[place[place >= 0]])[:, None])
        if not pieces.size:
            return
        pieces.append(np.array([[-1, 0]], np.int64))
        disk.drop(flagged)
        piece = pieces.rows()
        symbol, _, again = ranked(disk, inside.rows()[:, 0])
        text, done = disk.empty(len(piece)), 0
        for a, b in disk.spans(len(piece)):
            real = piece[a:b, 0] >= 0
            own = np.ones(b - a, np.int64)
            many = int(real.sum())
            own[real] = np.asarray(symbol[done : done + many]) + 2
            text[a:b] = own
            done += many
        text[len(piece) - 1] = 0
        inside.free()
        disk.drop(symbol, again)
        del symbol, again, flagged
        sa, common = sort(text, disk.folder, disk.held, self.base, self.note)
        disk.drop(text)
        del text

        def entries() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """In blocks of the suffix array: where a window begins, and whether
            it differs from the one before."""
            for a, b in disk.spans(len(piece)):
                own = np.asarray(piece[np.asarray(sa[a:b])])
                yield np.where(own[:, 1] >= least, own[:, 0], NONE), np.asarray(common[a:b]) < least

        least_of, held = Tape(disk, 1), None
        for place, new in entries():
            heads = np.flatnonzero(new)
            if held is not None:
                held = min(held, int(place[: heads[0] if len(heads) else None].min(initial=NONE)))
            if len(heads):
                low = np.minimum.reduceat(place, heads)
                least_of.append(np.concatenate([np.array([] if held is None else [held], np.int64), low[:-1]])[:, None])
                held = int(low[-1])
        least_of.append(np.array([[held]], np.int64))
        lows, group, late = least_of.rows()[:, 0], -1, disk.empty(n, bool)
        for place, new in entries():
            g = group + np.cumsum(new)
            late[place[(place != NONE) & (place != lows[g])]] = True
            group = int(g[-1])
        for own, at, offs in self._parts(meta):
            live = np.flatnonzero(late[at : at + offs[-1]])
            if len(live):
                owner = np.searchsorted(offs, live, "right") - 1
                first = np.flatnonzero(np.concatenate([[True], (np.diff(live) > 1) | (np.diff(owner) > 0)]))
                rows = own[owner[first]].copy()
                rows[:, 2] += live[first] - offs[owner[first]]
                rows[:, 3] = np.diff(np.append(first, len(live)))
                yield rows


LATER = pa.schema([("i", pa.int64()), ("h", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])


def _shard(least: int, folder: str | None, held: int, base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = folder and os.path.join(folder, uuid.uuid4().hex)
        if work:
            os.makedirs(work, exist_ok=True)
        try:
            shard = Shard(Disk(work, held), least, base)
            for batch in batches:
                if batch.num_rows:
                    data = batch.column("words")
                    size = pc.binary_length(data).to_numpy() // 8
                    every = b"".join(data.to_pylist())
                    shard.add(np.frombuffer(every, U), np.column_stack([*(batch.column(c).to_numpy().astype(np.int64) for c in ("i", "h", "s")), size]))
            if shard.meta.size:
                for rows in shard.later():
                    yield pa.RecordBatch.from_arrays([pa.array(rows[:, c], LATER.field(c).type) for c in range(4)], schema=LATER)
        finally:
            if work:
                remove(work)

    return run


def repeats(docs: DataFrame, least: int = LEAST, per_shard: int = PER_SHARD, held: int = HELD, base: int = BASE) -> DataFrame:
    """doc_id, first_word, end_word: the runs of each document that are made of
    windows of `least` words with an earlier occurrence."""
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"), "text")
    segments = texts.mapInArrow(_segments(least), "fp long, ch long, i long, h long, s int, n int")
    # what combines before it is shuffled, then joins that can be split where a minimizer is hot
    shared = segments.groupBy("fp").agg(F.count("*").alias("k"), (F.min("ch") != F.max("ch")).alias("mixed")).where("k > 1").drop("k")
    some = cut(segments.join(shared, "fp"))
    firsts = cut(some.groupBy("fp", "ch", "mixed").agg(F.min(F.struct("i", "h", "s", "n")).alias("first")))
    repeated = some.select("fp", "ch", "i", "h", "s", "n").join(firsts.select("fp", "ch", "first"), ["fp", "ch"])
    whole = repeated.where((F.col("i") != F.col("first.i")) | (F.col("h") != F.col("first.h")) | (F.col("s") != F.col("first.s"))).select("i", "h", "s", "n")

    leading = firsts.where("mixed").select("fp", "first.*")
    words_of = leading.groupBy("fp").agg(F.sum(F.col("n") + least - 1).alias("w"))
    total = words_of.agg(F.sum("w")).first()[0] or 0
    hot = words_of.where(F.col("w") > per_shard // 8).select("fp", F.lit(True).alias("hot"))
    spots = leading.join(hot, "fp", "left").groupBy("i", "h").agg(F.collect_list(F.struct("fp", "s", "n", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("spots"))
    slices = texts.join(spots, ["i", "h"]).select("i", "h", "text", "spots").dropDuplicates(["i", "h"]).mapInArrow(_slices(least), "key long, i long, h long, s int, words binary")
    shards = max(1, -(-total // per_shard))
    dealt = slices.repartitionById(shards, F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).sortWithinPartitions("i", "h", "s")
    sorted_ = dealt.mapInArrow(_shard(least, shared_folder(spark), held, base), "i long, h long, s int, n int")

    spans = whole.unionByName(sorted_).select("i", "h", F.col("s").alias("a"), (F.col("s") + F.col("n") + least - 1).alias("b")).distinct()
    order = Window.partitionBy("i", "h").orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce(F.col("a") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    return islands.groupBy("i", "h", "island").agg(F.min("a").alias("first_word"), F.max("b").alias("end_word")).select(F.col("i").alias("doc_id"), "first_word", "end_word")


ORACLE = """
with texts as (select distinct doc_id, regexp_extract_all(lower(text), '%(word)s') as w from documents where doc_id is not null and text is not null),
places as (select doc_id, w, unnest(range(0, len(w) - %(least)s + 1)) as p from texts where len(w) >= %(least)s),
windows as (select doc_id, p, md5(array_to_string(w[p + 1:p + %(least)s], ' ')) as g from places),
later as (select doc_id, p from windows qualify row_number() over (partition by g order by doc_id, p) > 1),
marked as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + %(least)s then 0 else 1 end as fresh from later),
islands as (select doc_id, p, sum(fresh) over (partition by doc_id order by p rows unbounded preceding) as island from marked)
select doc_id, min(p) as first_word, max(p) + %(least)s as end_word from islands group by doc_id, island
"""
