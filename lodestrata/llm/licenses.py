"""License scans by diagonal voting.

All rolling hashes of k words of every text are joined by Spark to the positions
that templates hold them at. A hit at word i of a text and word j of a template
votes for the diagonal i - j, where the template would begin. Votes are summed
by diagonal, neighbouring diagonals (words put in or left out) are merged, and
spans with enough votes are verified by a fitting alignment of the template's
words to the text's. An edit breaks k runs at most, so n words with e edits keep
n - k + 1 - k * e votes: no more than that is asked, and with k = 2 no span of
0.8 or more is lost. What lies beside a match is searched as well. Of overlapping spans the one with most agreeing words
stays.

The templates are joined by broadcast if their size allows (checked), so a scan
moves only its hits. Passing another table of templates (template_id, license,
text) scans for those.

Defined results: null and empty texts, and templates without words, give
nothing. A row with a null doc_id is scanned as any other. Repeated rows are one
document. Texts and templates of fewer than k words give nothing. Of spans that
agree in as many words the first stays, then that of the least template_id.
Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.llm.text import U, chunks, roll, word_hash, words
from lodestrata.runtime import cut, maybe_broadcast

K, BAND, VOTES, LEAST = 2, 0.2, 0.3, 0.8
OUT = "doc_id long, template_id string, license string, first_word int, end_word int, agreement double, exact boolean"

#: Notices by which documents name their licence.
NOTICES: list[tuple[str, str, str]] = [
    ("apache-2.0/name", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0/terms", "Apache-2.0", "you may not use this file except in compliance with the License"),
    ("apache-2.0/basis", "Apache-2.0", 'distributed under the License is distributed on an "AS IS" BASIS'),
    ("bsd/forms", "BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd/name", "BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("cc-by-4.0/name", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0/name", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0/name", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc/work", "CC", "This work is licensed under a Creative Commons license"),
    ("cc0/name", "CC0-1.0", "To the extent possible under law, the author has waived all copyright"),
    ("gpl-3.0/name", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl/free", "GPL", "This program is free software: you can redistribute it and/or modify it"),
    ("gpl-2.0/name", "GPL-2.0", "under the terms of the GNU General Public License, version 2"),
    ("lgpl/name", "LGPL", "under the terms of the GNU Lesser General Public License"),
    ("agpl/name", "AGPL-3.0", "under the terms of the GNU Affero General Public License"),
    ("isc/grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("mit/name", "MIT", "Released under the MIT License."),
    ("mit/name-2", "MIT", "Licensed under the MIT License."),
    ("mit/grant", "MIT", "Permission is hereby granted, free of charge, to any person"),
    ("mpl-2.0/name", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("reserved", "proprietary", "All rights reserved."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain"),
]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "template_id string, license string, text string")


def _grams(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                w = words(part.column("text"))
                g, at = w.grams(k)
                offs = np.searchsorted(at, w.offs).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(g.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("i"), part.column("h"), lists], ["i", "h", "g"])

    return run


def fit(item: np.ndarray, span: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to a part of span, with the part's start and
    end (the first end, then the longest part)."""

    def rows(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        at = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else at.copy()
        for n, x in enumerate(a, 1):
            sub = np.minimum(row[1:] + 1, row[:-1] + (b != x))
            row = np.minimum.accumulate(np.concatenate([[n], sub]) - at) + at
        return row

    last = rows(item, span, True)
    end = int(np.argmin(last))
    back = rows(item[::-1], span[:end][::-1], False)
    start = end - int(len(back) - 1 - np.argmin(back[::-1]))
    return int(last[end]), start, end


def _verify(shared, k: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in batches:
            out = []
            for part in chunks(batch):
                w = words(part.column("text"))
                ids = part.column("i").to_pylist()
                for d, spots in enumerate(part.column("spots").to_pylist()):
                    own = w.hash[w.offs[d] : w.offs[d + 1]]
                    found = []
                    for s in spots:
                        licence, item = templates[s["t"]]
                        give = max(2, int(BAND * len(item)))
                        lo, hi = max(0, s["lo"] - give), min(len(own), s["hi"] + len(item) + give)
                        rest = [(lo, hi)]
                        while rest:
                            x, y = rest.pop()
                            gap, a, b = fit(item, own[x:y])
                            if gap <= (1 - least) * len(item) + 1e-9 and a < b:
                                found.append((-(len(item) - gap), x + a, s["t"], x + b, licence, 1 - gap / len(item), gap == 0))
                                rest += [(u, v) for u, v in ((x, x + a), (x + b, y)) if v - u >= least * len(item) - 1e-9]
                    taken: list[tuple[int, int]] = []
                    for _, a, t, b, licence, agree, exact in sorted(found):
                        if all(b <= x or y <= a for x, y in taken):
                            taken.append((a, b))
                            out.append((ids[d], t, licence, a, b, round(agree, 4), exact))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]
            names = ["doc_id", "template_id", "license", "first_word", "end_word", "agreement", "exact"]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names)

    return run


def scan(docs: DataFrame, templates: DataFrame | None = None, k: int = K, votes: float = VOTES, least: float = LEAST) -> DataFrame:
    """doc_id, template_id, license, first_word, end_word, agreement (share of
    the template's words), exact: the licences of each document."""
    spark = docs.sparkSession
    table = notices(spark) if templates is None else templates
    hashes = {r.t: (r.license, word_hash(r.text)) for r in table.where("template_id is not null and text is not null").select(F.col("template_id").cast("string").alias("t"), "license", "text").toLocalIterator()}
    places = []
    for t, (_, h) in hashes.items():
        g, at = roll(h, np.array([0, len(h)]), k)
        places += [(t, len(g), int(j), x) for x, j in zip(g.view(np.int64).tolist(), at)]
    positions = spark.createDataFrame(places, "t string, grams int, j int, x long")

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("h"), "text")
    grams = texts.mapInArrow(_grams(k), "i long, h long, g array<long>").select("i", "h", F.posexplode("g").alias("at", "x"))
    hits = grams.join(maybe_broadcast(positions, 64), "x").select("i", "h", "t", "grams", "at", (F.col("at") - F.col("j")).alias("diagonal")).distinct()
    lines = hits.groupBy("i", "h", "t", "grams", "diagonal").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("i", "h", "t").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.greatest(F.lit(2), F.floor(BAND * (F.col("grams") + k - 1)))
    merged = (
        lines.withColumn("part", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(order))
        .groupBy("i", "h", "t", "grams", "part")
        .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"))
        .where(F.col("votes") >= F.greatest(F.lit(1), F.least(votes * F.col("grams"), F.col("grams") - k * F.floor((1 - least) * (F.col("grams") + k - 1) + 1e-9))))
    )
    spots = cut(merged.groupBy("i", "h").agg(F.sort_array(F.collect_list(F.struct("t", "lo", "hi"))).alias("spots")))
    key = (texts["i"].eqNullSafe(F.col("ci"))) & (texts["h"] == F.col("ch"))
    small = maybe_broadcast(spots.select(F.col("i").alias("ci"), F.col("h").alias("ch"), "spots"), 256)
    bodies = texts.join(small, key).select("i", "h", "text", "spots").dropDuplicates(["i", "h"])
    return bodies.mapInArrow(_verify(spark.sparkContext.broadcast(hashes), k, least), OUT)
