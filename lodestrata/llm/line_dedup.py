"""Line deduplication by winnowing over line hashes.

A line is what lies between newlines, trimmed of blanks, tabs and carriage
returns; blank lines are left out of the sequence that is compared. Runs of k
lines are hashed, the minimum (rightmost on ties) of every w consecutive hashes
is a fingerprint, so each shared run of w + k - 1 lines has one; with w = 1 every
run of k lines is one, and none is missed. A fingerprint is joined to its first
position in the corpus, in the order (doc_id, content hash, line); the match is
extended both ways over equal lines, and the later run is deleted. A line of
`alone` words or more is a run of its own, wherever it stands.

Defined results: a document is a pair of doc_id and text. Repeated rows are one
document and get the same edits. Rows with a null doc_id or text, and empty
texts, are kept as they are. A document that loses every line goes. An empty
table gives no rows. Columns besides doc_id and text are carried along under any
name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.columns import fresh, quoted
from lodestrata.runtime import cut, lean, maybe_broadcast

K, W = 2, 1
#: Words of a line that is a run by itself.
ALONE = 50
BLANK = " \t\r"


def _line(line: str) -> str:
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).hexdigest()


def winnow(hashes: list[str], w: int) -> list[int]:
    """Positions of the rightmost minimum of each window; the only minimum of a
    sequence shorter than a window."""
    n = len(hashes)
    if not n:
        return []
    return sorted({max(range(i, min(i + w, n)), key=lambda j: (_neg(hashes[j]), j)) for i in range(max(1, n - w + 1))})


def _neg(h: str) -> int:
    return -int(h[:15], 16)


def _scan(k: int, w: int, alone: int):
    schema = pa.schema([("_ld_id", pa.int64()), ("_ld_h", pa.int64()), ("lines", pa.list_(pa.int64())), ("fps", pa.list_(pa.struct([("pos", pa.int32()), ("fp", pa.int64()), ("n", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = [s for s in (x.strip(BLANK) for x in text.split("\n")) if s]
                hexes = [_line(s) for s in own]
                long = [j for j, s in enumerate(own) if len(s) >= 2 * alone - 1 and len(s.split()) >= alone]
                if len(hexes) < k and not long:
                    continue
                grams = [_line("".join(hexes[j : j + k])) for j in range(len(hexes) - k + 1)]
                rows.append({
                    "_ld_id": i, "_ld_h": h, "lines": [int(x[:15], 16) for x in hexes],
                    "fps": [{"pos": p, "fp": int(grams[p][:15], 16), "n": k} for p in winnow(grams, w)] + [{"pos": p, "fp": int(hexes[p][:15], 16), "n": 1} for p in long],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def extend(b: np.ndarray, a: np.ndarray, at_b: int, at_a: int, k: int) -> tuple[int, int]:
    """First line and end of the longest equal run around a match of k lines."""
    lo, hi = at_b, at_b + k
    shift = at_a - at_b
    same = b is a
    while lo > 0 and lo + shift > 0 and b[lo - 1] == a[lo - 1 + shift]:
        lo -= 1
    while hi < len(b) and hi + shift < len(a) and b[hi] == a[hi + shift] and not (same and hi + shift >= len(b)):
        hi += 1
    return lo, hi


def _extend(k: int):
    schema = pa.schema([("_ld_id", pa.int64()), ("_ld_h", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("src_id", pa.int64()), ("src_lo", pa.int32()), ("alone", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(i) for i in range(3)]
            later, first, at_b = batch.column(4), batch.column(5), batch.column(6)
            shift = batch.column(3).to_pylist()
            ids, hs, src = (c.to_pylist() for c in cols)
            for r in range(batch.num_rows):
                b, a = later[r].values.to_numpy(), first[r].values.to_numpy()
                done = -1
                at = [(x["p"], x["n"]) for x in at_b[r].as_py()]
                for p in sorted(p for p, n in at if n == k):
                    if p + k <= done:
                        continue
                    lo, done = extend(b, a, p, p + shift[r], k)
                    out.append((ids[r], hs[r], lo, done, src[r], lo + shift[r], False))
                out += [(ids[r], hs[r], p, p + 1, src[r], p + shift[r], True) for p, n in sorted(at) if n != k]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], schema.field(c).type) for c in range(7)], schema=schema)

    return run


def repeated_runs(docs: DataFrame, k: int = K, w: int = W, alone: int = ALONE) -> DataFrame:
    """Later runs: _ld_id, _ld_h, lo, hi (non-blank lines), src_id, src_lo, alone
    (a long line by itself). k is 2 at least."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("_ld_id"), F.xxhash64("text").alias("_ld_h"), "text"
    )
    scanned = cut(
        texts.mapInArrow(lean(_scan(k, w, alone)), "_ld_id long, _ld_h long, lines array<long>, fps array<struct<pos:int,fp:long,n:int>>")
    )
    places = scanned.select("_ld_id", "_ld_h", F.explode("fps").alias("f")).select(
        F.struct(F.col("_ld_id").alias("i"), F.col("_ld_h").alias("h"), F.col("f.pos").alias("p")).alias("at"), F.col("f.fp").alias("fp"), F.col("f.n").alias("n")
    )
    # minima that combine before they are shuffled, then a join that can be split where a fingerprint is hot
    firsts = places.groupBy("fp", "n").agg(F.min("at").alias("first"), F.count("*").alias("many")).where("many > 1").drop("many")
    matched = (
        places.join(maybe_broadcast(firsts, 48), ["fp", "n"])
        .where("at != first")
        .groupBy(F.col("at.i").alias("_ld_id"), F.col("at.h").alias("_ld_h"), F.col("first.i").alias("src_id"), F.col("first.h").alias("src_h"), (F.col("first.p") - F.col("at.p")).alias("shift"))
        .agg(F.collect_set(F.struct("at.p", "n")).alias("at"))
    )
    lines = scanned.select("_ld_id", "_ld_h", "lines").dropDuplicates(["_ld_id", "_ld_h"])
    sources = lines.select(F.col("_ld_id").alias("src_id"), F.col("_ld_h").alias("src_h"), F.col("lines").alias("src_lines"))
    return (
        matched.join(lines, ["_ld_id", "_ld_h"])
        .join(sources, ["src_id", "src_h"])
        .select("_ld_id", "_ld_h", "src_id", "shift", "lines", "src_lines", "at")
        .mapInArrow(lean(_extend(k)), "_ld_id long, _ld_h long, lo int, hi int, src_id long, src_lo int, alone boolean")
    )


def strike(text: str, runs: list[tuple[int, int]]) -> tuple[str, int]:
    """text without the lines of the runs, which count non-blank lines; how many went."""
    gone: set[int] = set()
    for lo, hi in runs:
        gone.update(range(lo, hi))
    kept, at = [], 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            at += 1
            if at - 1 in gone:
                continue
        kept.append(line)
    return "\n".join(kept), len(gone)


def dedup_lines(docs: DataFrame, k: int = K, w: int = W, min_run: int = K, count_as: str | None = None, alone: int = ALONE) -> DataFrame:
    """docs with later repeated runs of min_run lines or more, and later repeated
    lines of `alone` words or more, deleted, in the columns of docs; count_as names a column for the number of deleted lines."""
    runs = (
        repeated_runs(docs, k, w, alone)
        .where((F.col("hi") - F.col("lo") >= min_run) | F.col("alone"))
        .groupBy("_ld_id", "_ld_h")
        .agg(F.collect_set(F.struct("lo", "hi")).alias("_ld_runs"))
    )

    @F.pandas_udf("struct<text:string,gone:int>")
    def edit(text, runs):
        import pandas as pd

        pairs = [(None, 0) if rs is None else strike(t, [(r["lo"], r["hi"]) for r in rs]) for t, rs in zip(text, runs)]
        return pd.DataFrame({"text": [p[0] for p in pairs], "gone": [p[1] for p in pairs]})

    i, h, at, new = (fresh(docs, c) for c in ("_ld_id", "_ld_h", "_ld_runs", "_ld_new"))
    runs = runs.toDF(i, h, at)
    joined = docs.withColumns({i: F.col("doc_id").cast("long"), h: F.xxhash64("text")}).join(runs, [i, h], "left")
    edited = joined.withColumn(new, edit(F.when(F.col(at).isNotNull(), F.col("text")), F.col(at)))
    text = F.when(F.col(at).isNotNull(), F.col(new)["text"]).otherwise(F.col("text"))
    kept = edited.where(F.col(at).isNull() | (F.length(F.translate(text, " \t\r\n", "")) > 0))
    out = [text.alias("text") if c == "text" else quoted(c) for c in docs.columns]
    return kept.select(*out, *([F.coalesce(F.col(new)["gone"], F.lit(0)).alias(count_as)] if count_as else []))


ORACLE = r"""
with recursive texts as (select distinct doc_id, text from documents where doc_id is not null and text is not null),
src as (select doc_id, string_split(text, chr(10)) as ls from texts),
raw as (select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as line from src),
lines as (select doc_id, i, line, md5(trim(line, ' ' || chr(9) || chr(13))) as h,
          row_number() over (partition by doc_id order by i) - 1 as pos from raw
          where trim(line, ' ' || chr(9) || chr(13)) <> ''),
grams as (select doc_id, pos, substr(md5(h || lead(h) over (partition by doc_id order by pos)), 1, 15) as g
          from lines qualify lead(h) over (partition by doc_id order by pos) is not null),
firsts as (select *, first_value(doc_id) over (partition by g order by doc_id, pos) as src_id,
           first_value(pos) over (partition by g order by doc_id, pos) as src_pos from grams),
pairs as (select doc_id, pos, src_id, src_pos - pos as shift from firsts where doc_id <> src_id or pos <> src_pos),
diag as (select distinct doc_id, src_id, shift from pairs),
same as (select d.doc_id, d.src_id, d.shift, b.pos, b.pos - row_number() over (partition by d.doc_id, d.src_id, d.shift order by b.pos) as island
         from diag d join lines b on b.doc_id = d.doc_id join lines a on a.doc_id = d.src_id and a.pos = b.pos + d.shift and substr(a.h, 1, 15) = substr(b.h, 1, 15)),
hit as (select distinct s.doc_id, s.src_id, s.shift, s.island from same s join pairs p on s.doc_id = p.doc_id and s.src_id = p.src_id and s.shift = p.shift and s.pos = p.pos),
alone as (select doc_id, pos from lines where len([x for x in regexp_split_to_array(line, '\s+') if x <> '']) >= %(alone)s
          qualify row_number() over (partition by h order by doc_id, pos) > 1),
gone as (select distinct s.doc_id, s.pos from same s join hit using (doc_id, src_id, shift, island) union select doc_id, pos from alone),
numbered as (select r.doc_id, r.i, r.line, g.pos is not null as dead from raw r left join lines l on l.doc_id = r.doc_id and l.i = r.i
             left join gone g on g.doc_id = l.doc_id and g.pos = l.pos),
done as (select doc_id, string_agg(line, chr(10) order by i) filter (where not dead) as text, count(*) filter (where dead) as lines_removed from numbered group by doc_id)
select doc_id, text, cast(lines_removed as bigint) as lines_removed from done
where lines_removed = 0 or length(translate(coalesce(text, ''), ' ' || chr(9) || chr(13) || chr(10), '')) > 0
"""
