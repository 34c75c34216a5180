"""Quality rules: n-gram perplexity under a modified Kneser-Ney model.

The model is counted by Spark over every document: byte n-grams of order 5 per
language, with four zero bytes before each text. Counts are merged inside each
task before they are shuffled, lower orders count distinct left extensions, and
the three discounts come from each order's counts of counts. The model is held
as hash arrays sorted by hash, with a directory over the leading bits, in files
of about PER_FILE n-grams in the shared checkpoint folder: tasks map those into
memory that they look up, so neither the driver nor a task ever holds the model,
whatever its size. Where that folder isn't a path (an object store), texts are
joined to the model instead; both give the same rows.

Each language gets a band of log perplexity per byte around its median. The mean
over n bytes spreads as b / n, and documents differ by a besides, however long
they are; a and b follow from the distance of the quartiles among the shorter and
among the longer half of the language's documents. A text of n bytes may lie in
median +- width * sqrt(a + b / n), and never has less room than the longer half
itself spreads, as a isn't known beyond the lengths that are seen. The quartiles of
that are taken at the outer ends of their confidence limits, three standard errors
off, so that a handful of documents makes no narrow band. Texts outside are
rejected, with the reason "low" (degenerate repetition, boilerplate) or "high"
(junk).

Defined results: a null lang counts as "und". Null and empty texts have a null
perplexity and aren't rejected. Rows with a null doc_id are scored and judged as
any other. Repeated rows count as often as they occur, and each gets its row. An
empty table gives no rows. Other columns, of any name, are carried along by keep
and aren't read.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.columns import fresh
from lodestrata.llm.text import U, chunks, mix, raw
from lodestrata.runtime import checkpoint_dir, cut, lean

ORDER = 5
WIDTH = 2.25
BINS = 1000  # quantiles are exact to 1 / BINS
#: N-grams of a file of the model.
PER_FILE = 2_000_000
#: Distinct n-grams that a task holds before it passes them on.
HELD = 3_000_000
#: N-grams of a batch that it passes on.
PASSED = 1 << 16


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code of the n-gram that ends at each byte, and document offsets."""
    data, offs = raw(texts)
    lens = np.diff(offs)
    pad = ORDER - 1
    wide = np.zeros(len(data) + pad * len(lens), U)
    at = np.arange(len(data)) + np.repeat(pad * np.arange(1, len(lens) + 1), lens)
    wide[at] = data
    code = np.zeros(len(data), U)
    for j in range(ORDER):
        code |= wide[at - j] << U(8 * j)
    return code, offs


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    lang = batch.column("lang")
    for value in pc.unique(lang).to_pylist():
        yield value, batch.filter(pc.equal(lang, value))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merge(parts):
        if len(parts) == 1:
            return parts[0]
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def flush():
        for lang, parts in held.items():
            keys, n = merge(parts)
            for a in range(0, len(keys), PASSED):
                own = keys[a : a + PASSED].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(own), np.int32))), pa.array(own), pa.array(n[a : a + PASSED])], ["lang", "g", "c"])
        held.clear()

    for batch in batches:
        for part in chunks(batch):
            for lang, own in by_lang(part):
                code, _ = codes(own.column("text"))
                if len(code):
                    keys, n = np.unique(code, return_counts=True)
                    held.setdefault(lang, []).append((keys, n.astype(np.int64)))
                    if len(held[lang]) > 4:
                        held[lang] = [merge(held[lang])]
        if sum(len(k) for parts in held.values() for k, _ in parts) > HELD:
            yield from flush()
    yield from flush()


def prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def count(docs: DataFrame) -> DataFrame:
    """lang, g, c: how often each n-gram occurs in each language."""
    return prepared(docs).mapInArrow(lean(_count), "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))


def probabilities(counts: DataFrame) -> DataFrame:
    """lang, g, logp of every n-gram of the highest order that occurs."""
    tables = {ORDER: cut(counts)}
    for m in range(ORDER - 1, 0, -1):
        low = F.col("g").bitwiseAND(F.lit((1 << 8 * m) - 1))
        tables[m] = cut(tables[m + 1].groupBy("lang", low.alias("g")).agg(F.count("*").alias("c")))
    lower = None
    for m in range(1, ORDER + 1):
        t = tables[m]
        n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

        def discount(i: int, known: Column = known, y: Column = y) -> Column:
            d = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
            return F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(float(i)), d))).otherwise(F.lit(i / 2)).alias(f"d{i}")

        discounts = t.groupBy("lang").agg(*n).select("lang", discount(1), discount(2), discount(3))
        context = Window.partitionBy("lang", F.shiftright("g", 8))
        t = t.withColumns({
            "tot": F.sum("c").over(context),
            **{f"c{i}": F.sum(F.when(F.col("c") == i, 1).otherwise(0)).over(context) for i in (1, 2)},
            "c3": F.sum(F.when(F.col("c") >= 3, 1).otherwise(0)).over(context),
        }).join(discounts, "lang")
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        gamma = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("tot")
        own = (F.col("c") - d) / F.col("tot")
        if lower is None:
            lower = t.select("lang", "g", (own + gamma / F.lit(257.0)).alias("p"))
        else:
            below = lower.select("lang", F.col("g").alias("low"), F.col("p").alias("q"))
            t = t.withColumn("low", F.col("g").bitwiseAND(F.lit((1 << 8 * (m - 1)) - 1)))
            lower = t.join(below, ["lang", "low"]).select("lang", "g", (own + gamma * F.col("q")).alias("p"))
    return lower.select("lang", "g", F.log("p").alias("logp"))


def key(code: np.ndarray, lang: str) -> np.ndarray:
    """Hash of n-grams of a language."""
    salt = U(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    return mix(mix(code) + salt)


def slot_of(h: np.ndarray, slots: int) -> np.ndarray:
    """Which of the files, each a range of hashes, holds h."""
    return ((h >> U(32)) * U(slots) >> U(32)).astype(np.int64)


class Model:
    """A range of the sorted hash arrays."""

    def __init__(self, h: np.ndarray, logp: np.ndarray, low: int, width: float):
        order = np.argsort(h)
        self.hash, self.logp, self.low, self.width = h[order], logp[order], low, width
        # a directory over equal parts of the range, one for each n-gram
        self.first = np.searchsorted(self._part(self.hash), np.arange(len(h) + 1)).astype(np.int32)

    def _part(self, h: np.ndarray) -> np.ndarray:
        return np.minimum((h - U(self.low)).astype(np.float64) / self.width * len(self.hash), len(self.hash) - 1).astype(np.int64)

    def save(self, path: str) -> None:
        own = f"{path}.{uuid.uuid4().hex}"  # a task may be run twice
        with open(own, "wb") as f:
            for a in (np.array([len(self.hash), self.low], U), self.hash, self.logp.astype(np.float64), self.first):
                f.write(np.ascontiguousarray(a).tobytes())
        os.replace(own, path)

    @classmethod
    def open(cls, path: str, width: float) -> Model:
        self, every = cls.__new__(cls), np.memmap(path, np.uint8, "r")
        n, low = every[:16].view(U).tolist()
        self.hash, self.logp = every[16 : 16 + 8 * n].view(U), every[16 + 8 * n : 16 + 16 * n].view(np.float64)
        self.first, self.low, self.width = every[16 + 16 * n :].view(np.int32), low, width
        return self

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """logp of hashes that the model holds; nan of others."""
        at = self.first[self._part(h)].astype(np.int64)
        out = np.full(len(h), np.nan)
        todo = np.arange(len(h))
        while len(todo):
            got = np.minimum(at[todo], len(self.hash) - 1)
            have = self.hash[got]
            hit = have == h[todo]
            out[todo[hit]] = self.logp[got[hit]]
            todo = todo[~hit & (have < h[todo]) & (at[todo] < len(self.hash))]
            at[todo] += 1
        return out


def _keyed(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in by_lang(batch):
                h = key(own.column("g").to_numpy().view(U), lang)
                yield pa.RecordBatch.from_arrays([pa.array(slot_of(h, slots)), pa.array(h.view(np.int64)), own.column("logp")], ["slot", "h", "logp"])

    return run


def _write(folder: str, slots: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        os.makedirs(folder, exist_ok=True)
        low = -(-(slot << 32) // slots) << 32  # the least hash of the range
        Model(pdf["h"].to_numpy().view(U), pdf["logp"].to_numpy(), low, float(1 << 64) / slots).save(f"{folder}/{slot}")
        return pd.DataFrame({"slot": [slot]})

    return run


SCORE = pa.schema([("_q_row", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("total", pa.float64())])


def _score(folder: str, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, Model] = {}

        def look(h: np.ndarray) -> np.ndarray:
            slot = slot_of(h, slots)
            out = np.empty(len(h))
            order = np.argsort(slot, kind="stable") if slots > 1 else np.arange(len(h))
            cuts = np.flatnonzero(np.diff(slot[order])) + 1
            for part in np.split(order, cuts):
                s = int(slot[part[0]])
                if s not in files:
                    files[s] = Model.open(f"{folder}/{s}", float(1 << 64) / slots)
                out[part] = files[s].lookup(h[part])
            return out

        for batch in batches:
            for part in chunks(batch):
                for lang, own in by_lang(part):
                    code, offs = codes(own.column("text"))
                    total, full = np.zeros(len(offs) - 1), np.diff(offs) > 0
                    if len(code):  # each text by itself, so that copies get the same bits
                        total[full] = np.add.reduceat(look(key(code, lang)), offs[:-1][full])
                    yield pa.RecordBatch.from_arrays([own.column("_q_row"), own.column("lang"), pa.array(np.diff(offs)), pa.array(total)], schema=SCORE)

    return run


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct n-grams with their counts."""
    for batch in batches:
        for part in chunks(batch):
            code, offs = codes(part.column("text"))
            doc = np.repeat(np.arange(part.num_rows), np.diff(offs))
            order = np.lexsort((code, doc))
            code, doc = code[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])])) if len(code) else np.zeros(0, np.int64)
            at = pa.array(doc[first])
            yield pa.RecordBatch.from_arrays([part.column("_q_row").take(at), part.column("lang").take(at), pa.array(code[first].astype(np.int64)), pa.array(np.diff(np.append(first, len(code))))], ["_q_row", "lang", "g", "c"])


def score(docs: DataFrame, per_file: int = PER_FILE, files: bool = True) -> DataFrame:
    """_q_row (hash of lang and text), lang, n bytes, logppl; a row each time a
    text occurs. files: whether the model may be held in files."""
    spark = docs.sparkSession
    model = cut(probabilities(count(docs)))
    texts = prepared(docs).withColumn("_q_row", F.xxhash64("lang", "text"))
    url = urlparse(checkpoint_dir(spark))
    if files and url.scheme in ("", "file"):
        folder, slots = os.path.join(url.path, f"perplexity-{uuid.uuid4().hex}"), max(1, -(-model.count() // per_file))
        keyed = model.mapInArrow(lean(_keyed(slots)), "slot long, h long, logp double")
        keyed.groupBy("slot").applyInPandas(_write(folder, slots), "slot long").agg(F.count("*")).first()
        totals = texts.mapInArrow(lean(_score(folder, slots)), "_q_row long, lang string, n long, total double")
    else:
        folder = ""
        grams = texts.distinct().mapInArrow(lean(_profile), "_q_row long, lang string, g long, c long")
        once = grams.join(model, ["lang", "g"]).groupBy("_q_row", "lang").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("logp")).alias("total"))
        totals = texts.select("_q_row", "lang").join(once, ["_q_row", "lang"])  # a row each time a text occurs, as above
    out = cut(totals.where("n > 0").select("_q_row", "lang", "n", (-F.col("total") / F.col("n")).alias("logppl")))
    if folder:
        shutil.rmtree(folder, ignore_errors=True)
    return out


def _quantiles(values: DataFrame, by: list[str], column: str, **at: float | Column) -> DataFrame:
    """Quantiles of a column, from counts of its bins."""
    counted = values.groupBy(*by, F.floor(F.col(column) * BINS).alias("bin")).agg(F.count("*").alias("k"))
    upto = counted.withColumns({"upto": F.sum("k").over(Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("k").over(Window.partitionBy(*by))})
    return upto.groupBy(*by).agg(*(((F.min(F.when(F.col("upto") >= f * F.col("all"), F.col("bin"))) + 0.5) / BINS).alias(name) for name, f in at.items()))


def bands(scored: DataFrame) -> DataFrame:
    """lang, med, a, b, v: the median, the squared distance of the quartiles of
    texts of n bytes, a + b / n, and the most that it may be in the longer half."""
    own = scored.select("lang", F.col("logppl").alias("x"), F.log(F.col("n").cast("double")).alias("y"))
    mid = _quantiles(own, ["lang"], "x", med=0.5).join(_quantiles(own, ["lang"], "y", mid=0.5), "lang")
    halves = own.join(mid, "lang").withColumn("long", F.col("y") >= F.col("mid"))
    err = F.sqrt(9 * 0.1875 / F.col("all"))
    outer = {"o1": F.greatest(F.lit(0.0), 0.25 - err), "o3": F.least(F.lit(1.0), 0.75 + err)}
    each = _quantiles(halves, ["lang", "long"], "x", q1=0.25, q3=0.75, **outer).join(_quantiles(halves, ["lang", "long"], "y", y=0.5), ["lang", "long"])
    square = lambda lo, hi: F.pow(F.col(hi) - F.col(lo) + 1 / BINS, F.lit(2))
    kinds = {"v": square("q1", "q3"), "o": square("o1", "o3"), "m": F.exp(-F.col("y"))}
    two = each.groupBy("lang").agg(*(F.max(F.when(F.col("long") == long, v)).alias(n + i) for long, i in ((True, "l"), (False, "s")) for n, v in kinds.items()))
    slope = F.when(F.col("ms") > F.col("ml"), F.greatest(F.lit(0.0), (F.col("vs") - F.col("vl")) / (F.col("ms") - F.col("ml"))))
    two = two.withColumn("b", F.coalesce(slope, F.lit(0.0)))
    a = F.greatest(F.lit(0.0), F.coalesce("vl", "vs") - F.col("b") * F.coalesce("ml", F.lit(0.0)))
    return mid.select("lang", "med").join(two.select("lang", a.alias("a"), "b", F.coalesce("ol", "os").alias("v")), "lang")


def judge(docs: DataFrame, width: float = WIDTH, **kw) -> DataFrame:
    """_q_row, lang, n, logppl, lo, hi, reason (null, "low" or "high"); a row each time a text occurs."""
    scored = score(docs, **kw)
    half = width * F.sqrt(F.greatest(F.col("a") + F.col("b") / F.col("n"), "v"))
    reason = F.when(F.col("logppl") < F.col("lo"), "low").when(F.col("logppl") > F.col("hi"), "high")
    at = scored.join(bands(scored), "lang").withColumns({"lo": F.col("med") - half, "hi": F.col("med") + half})
    return at.drop("med", "a", "b", "v").withColumn("reason", reason)


def _row() -> Column:
    return F.xxhash64(F.coalesce(F.col("lang"), F.lit("und")).cast("string"), F.coalesce(F.col("text"), F.lit("")))


def report(docs: DataFrame, **kw) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, reason for every row of docs."""
    judged = judge(docs, **kw).select("_q_row", "n", "logppl", "reason").dropDuplicates(["_q_row"])
    rows = docs.select("doc_id", "lang", _row().alias("_q_row"))
    return rows.join(judged, "_q_row", "left").select("doc_id", "lang", F.coalesce("n", F.lit(0)).cast("long").alias("n_bytes"), F.round(F.exp("logppl"), 4).alias("perplexity"), "reason")


def keep(docs: DataFrame, **kw) -> DataFrame:
    """docs without the rejected texts."""
    name = fresh(docs, "_q_row")
    out = judge(docs, **kw).where("reason is not null").select(F.col("_q_row").alias(name)).distinct()
    return docs.withColumn(name, _row()).join(out, name, "left_anti").drop(name)
