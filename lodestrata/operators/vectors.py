"""Vector similarity, embedding upkeep and name search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.patterns import cosine, unit


def similar(vectors: DataFrame, query: Sequence[float], key: str, column: str, k: int = 10) -> DataFrame:
    """The k rows most like the query by cosine; other lengths are skipped."""
    q = F.array(*(F.lit(float(x)) for x in query))
    at = vectors.where(F.size(column) == len(query)).select(key, cosine(F.col(column), q).alias("similarity"))
    return at.orderBy(F.desc("similarity"), key).limit(k)


def embeddable(symbols: DataFrame) -> DataFrame:
    """Exported symbols with a signature, outside tests and generated files (V1)."""
    role = F.col("role").isNull() | ~F.col("role").isin("test", "generated")
    path = ~F.col("file_id").rlike(r"(^|/)(__tests__|__fixtures__|fixtures?|tests?)/|\.(test|spec)\.")
    text = F.concat_ws(" -- ", "signature", F.when(F.col("purpose") != "", F.col("purpose")))
    return symbols.where(F.col("exported") & F.col("signature").isNotNull() & role & path).withColumn("text", text).withColumn("text_hash", F.sha2("text", 256))


def missing(texts: DataFrame, held: DataFrame, model: str) -> DataFrame:
    """Texts by hash that a model has no vector of (V2)."""
    return texts.select("text_hash", "text").dropDuplicates(["text_hash"]).join(held.where(F.col("model") == model).select("text_hash"), "text_hash", "left_anti")


def embed(texts: DataFrame, model: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """model, text_hash, dims, vector of length 1; the embedder is called by batches (V2)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for a in range(0, len(pdf), batch):
                own = pdf.iloc[a : a + batch]
                yield pd.DataFrame({"text_hash": own["text_hash"], "vector": [list(map(float, v)) for v in embedder(own["text"].tolist())]})

    out = texts.select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<double>")
    return out.select(F.lit(model).alias("model"), "text_hash", F.size("vector").alias("dims"), unit(F.col("vector")).alias("vector"))


def search(items: DataFrame, text: str, k: int = 20) -> DataFrame:
    """id, score of items (id, name, path, text) by how well they match: the name
    whole 100, its start 80, within it 60, start of the path 40, the text 30 (T14)."""
    q = text.lower()
    name, path, body = (F.lower(c) for c in ("name", "path", "text"))
    score = F.when(name == q, 100).when(name.startswith(q), 80).when(name.contains(q), 60).when(path.startswith(q), 40).when(body.contains(q), 30)
    return items.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "id").limit(k)
