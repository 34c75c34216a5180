"""Communities by greedy modularity, per partition, and quality of the split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators import graph


def greedy(nodes: list, edges: list[tuple]) -> dict:
    """Community label of each node: the adjacent pair that raises modularity most
    is merged, the first in order on ties, until none does by more than 1e-12."""
    order = {n: i for i, n in enumerate(sorted(nodes))}
    near: list[dict[int, float]] = [{} for _ in order]
    total = 0.0
    for a, b in edges:
        if a in order and b in order and a != b:
            i, j = order[a], order[b]
            near[i][j] = near[i].get(j, 0) + 1
            near[j][i] = near[j].get(i, 0) + 1
            total += 1
    degree = [sum(x.values()) for x in near]
    member = list(range(len(order)))
    live = {i for i, x in enumerate(near) if x}  # the others stay alone
    held = {i: [i] for i in live}
    while total:
        best, pair = 1e-12, None
        for i in sorted(live):
            for j in sorted(x for x in near[i] if x > i):
                gain = near[i][j] / total - degree[i] * degree[j] / (2 * total * total)
                if gain > best + 1e-15:
                    best, pair = gain, (i, j)
        if pair is None:
            break
        i, j = pair
        for x, w in near[j].items():
            if x != i:
                near[i][x] = near[i].get(x, 0) + w
                near[x][i] = near[x].get(i, 0) + w
                near[x].pop(j, None)
        near[i].pop(j, None)
        near[j] = {}
        degree[i] += degree[j]
        live.remove(j)
        held[i] += held.pop(j)
    for i, ms in held.items():
        for m in ms:
            member[m] = i
    label = {m: f"c{k}" for k, m in enumerate(sorted(set(member)))}
    return {n: label[member[i]] for n, i in order.items()}


def communities(owner: DataFrame, edges: DataFrame) -> DataFrame:
    """id, part, cluster within each partition (id, part), one task a partition."""
    inside = graph.placed_edges(edges, owner).where("s = d").groupBy("s").agg(F.collect_list(F.struct(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"))).alias("edges"))
    at = owner.groupBy("part").agg(F.collect_list(F.col("id").cast("string")).alias("ids")).join(inside.withColumnRenamed("s", "part"), "part", "left")

    def run(batches):
        for pdf in batches:
            rows = []
            for part, ids, es in zip(pdf["part"], pdf["ids"], pdf["edges"]):
                found = greedy(list(ids), sorted((e["a"], e["b"]) for e in es) if es is not None else [])
                rows += [(n, part, c) for n, c in found.items()]
            yield pd.DataFrame(rows, columns=["id", "part", "cluster"])

    return at.mapInPandas(run, "id string, part string, cluster string")


def fit(domains: DataFrame, packages: DataFrame, edges: DataFrame) -> DataFrame:
    """q of the domains, of the packages and of detected communities, and how many
    these are (G7). Detection runs over everything as one partition."""
    every = packages.select("id", F.lit("all").alias("part"))
    found = communities(every, edges)
    detected = every.select("id", F.col("id").cast("string").alias("k")).join(found.select(F.col("id").alias("k"), "cluster"), "k").select("id", F.col("cluster").alias("part"))
    q = lambda owner, name: graph.modularity(owner, edges).withColumnRenamed("q", name)
    return q(domains, "domains_q").crossJoin(q(packages, "packages_q")).crossJoin(q(detected, "detected_q")).crossJoin(found.agg(F.countDistinct("cluster").alias("communities")))


def split(owner: DataFrame, edges: DataFrame, least: int = 15) -> DataFrame:
    """part, files, clusters, q of the communities in each partition of `least`
    files or more (G8)."""
    big = owner.groupBy("part").agg(F.count("*").alias("files")).where(F.col("files") >= least)
    own = owner.join(big.select("part"), "part", "left_semi")
    found = communities(own, edges)
    e = graph.placed_edges(edges, own).where("s = d").select(F.col("s").alias("part"), F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).where("src != dst")
    c = found.select("part", F.col("id").alias("src"), F.col("cluster").alias("x"))
    d = found.select("part", F.col("id").alias("dst"), F.col("cluster").alias("y"))
    j = e.join(c, ["part", "src"]).join(d, ["part", "dst"])
    total = j.groupBy("part").agg(F.count("*").alias("m"), F.sum((F.col("x") == F.col("y")).cast("int")).alias("i"))
    ends = j.select("part", F.explode(F.array("x", "y")).alias("cluster")).groupBy("part", "cluster").agg(F.count("*").alias("k")).groupBy("part").agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    q = F.col("i") / F.col("m") - F.col("kk") / (4 * F.col("m") * F.col("m"))
    sizes = found.groupBy("part").agg(F.countDistinct("cluster").alias("clusters"))
    return big.join(sizes, "part").join(total, "part", "left").join(ends, "part", "left").select("part", "files", "clusters", F.coalesce(q, F.lit(0.0)).alias("q"))


def lcom(members: DataFrame) -> DataFrame:
    """file_id, class, lcom4: components of a class's methods that share a field or
    call one another (A30, E9). members: file_id, class, method, uses (names)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        top: dict[str, str] = {}

        def find(x: str) -> str:
            while top.setdefault(x, x) != x:
                x = top[x]
            return x

        for m, uses in zip(pdf["method"], pdf["uses"]):
            find(f"m:{m}")
            for u in uses if uses is not None else ():
                kind = "m" if u in set(pdf["method"]) else "f"
                top[find(f"m:{m}")] = find(f"{kind}:{u}")
        n = len({find(f"m:{m}") for m in pdf["method"]})
        return pd.DataFrame({"file_id": [pdf["file_id"].iloc[0]], "class": [pdf["class"].iloc[0]], "lcom4": [n]})

    return members.groupBy("file_id", "class").applyInPandas(run, "file_id string, class string, lcom4 int")
