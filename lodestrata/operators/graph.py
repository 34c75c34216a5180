"""Operators on a property graph: degrees, barrels, ranks, reach, partitions.

Edges are src, dst, kind, weight; nodes id, kind or role, package.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.runtime import cut

STRUCTURAL = ("imports", "re-exports")
KIND_WEIGHT = {"imports": 1.0, "re-exports": 0.5, "calls": 1.5}
#: Iterations of a loop between two cuts of its lineage.
CUT_EVERY = 5


def edge_weight(w: str = "weight") -> Column:
    """A positive weight, else 1."""
    return F.when(F.col(w) > 0, F.col(w)).otherwise(F.lit(1.0))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, fan_in, fan_out, instability over structural edges between known
    nodes; instability is null for a node without edges (A1, A2)."""
    ids = nodes.select("id")
    e = edges.where(F.col("kind").isin(*STRUCTURAL)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    ends = e.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    counted = ends.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))
    out = ids.join(counted, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    both = F.col("fan_in") + F.col("fan_out")
    return out.withColumn("instability", F.when(both > 0, F.col("fan_out") / both))


def resolve_barrels(nodes: DataFrame, edges: DataFrame, depth: int = 20) -> DataFrame:
    """src, dst, kind, weight with each edge into a barrel split over the barrel's
    own edges in proportion to their weight, on and on. A barrel without edges
    stays; a path that meets a barrel again ends there; what leads back to the
    importer is dropped; barrels' own edges are dropped (G1)."""
    barrels = nodes.where("role = 'barrel'").select(F.col("id").alias("barrel"))
    e = edges.withColumn("weight", edge_weight())
    plain = e.where("kind != 'references'")
    out = plain.join(barrels, plain["src"] == barrels["barrel"], "left_semi").select(F.col("src").alias("barrel"), F.col("dst").alias("next"), "weight")
    share = out.groupBy("barrel", "next").agg(F.sum("weight").alias("w")).withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("barrel"))).drop("w")
    rest = e.join(barrels, (e["src"] == barrels["barrel"]) & (e["kind"] != "references"), "left_anti")
    into = rest.join(barrels, rest["dst"] == barrels["barrel"], "left_semi")
    done = rest.join(barrels, rest["dst"] == barrels["barrel"], "left_anti").select("src", "dst", "kind", "weight")
    front = into.select("src", "dst", "kind", "weight", F.array("dst").alias("path"))
    for step in range(depth):
        stepped = front.join(share, front["dst"] == share["barrel"], "left")
        ended = stepped.where("next is null").select("src", "dst", "kind", "weight")
        moved = stepped.where("next is not null and next != src and not array_contains(path, next)").select(
            "src", F.col("next").alias("dst"), "kind", (F.col("weight") * F.col("share")).alias("weight"), F.concat("path", F.array("next")).alias("path")
        )
        isbarrel = moved.join(barrels, moved["dst"] == barrels["barrel"], "left").withColumn("more", F.col("barrel").isNotNull()).drop("barrel")
        isbarrel = cut(isbarrel)
        done = done.unionByName(ended).unionByName(isbarrel.where("not more").select("src", "dst", "kind", "weight"))
        front = isbarrel.where("more").drop("more")
        if front.isEmpty():
            break
    else:
        done = done.unionByName(front.select("src", "dst", "kind", "weight"))
    return done.groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def utilization(resolved: DataFrame) -> DataFrame:
    """id, utilization: weight that reaches a node (A3)."""
    return resolved.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("utilization"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges with their reverses."""
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-6, iterations: int = 100, kinds: dict[str, float] | None = None) -> DataFrame:
    """id, score. Edges weigh by kind; parallel ones add up; unknown ends are
    left out. Mass of nodes without edges goes back by the personalization
    (seeds: id, weight; uniform without). Stops where the L1 change falls below
    the tolerance (G2)."""
    kinds = KIND_WEIGHT if kinds is None else kinds
    ids = nodes.select("id").distinct()
    per_kind = F.coalesce(*(F.when(F.col("kind") == k, F.lit(float(w))) for k, w in kinds.items()), F.lit(1.0))
    w = edges.select("src", "dst", per_kind.alias("w")).where("w > 0")
    w = w.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy("src", "dst").agg(F.sum("w").alias("w"))
    w = cut(w.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"))
    total = ids.count()
    if not total:
        return ids.withColumn("score", F.lit(0.0))
    start = ids.withColumn("p", F.lit(1.0 / total))
    if seeds is not None:
        s = ids.join(seeds.where("weight > 0").groupBy("id").agg(F.sum("weight").alias("weight")), "id", "left").na.fill(0.0, ["weight"])
        mass = s.agg(F.sum("weight")).first()[0] or 0.0
        if mass:
            start = s.select("id", (F.col("weight") / mass).alias("p"))
    ends = w.select(F.col("src").alias("id")).distinct().withColumn("leads", F.lit(True))
    base = cut(start.join(ends, "id", "left").select("id", "p", F.coalesce("leads", F.lit(False)).alias("leads")))
    rank = base.select("id", F.col("p").alias("r"), "p", "leads")
    for step in range(1, iterations + 1):
        stuck = rank.where("not leads").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("stuck"))
        sent = rank.select(F.col("id").alias("src"), "r").join(w, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        new = (F.lit(1 - damping) + damping * F.col("stuck")) * F.col("p") + damping * F.coalesce("got", F.lit(0.0))
        nxt = rank.join(sent, "id", "left").crossJoin(F.broadcast(stuck)).select("id", new.alias("n"), "r", "p", "leads")
        if tolerance > 0 or step % CUT_EVERY == 0:
            nxt = cut(nxt)
        change = nxt.agg(F.sum(F.abs(F.col("n") - F.col("r")))).first()[0] if tolerance > 0 else None
        rank = nxt.select("id", F.col("n").alias("r"), "p", "leads")
        if change is not None and change < tolerance:
            break
    return rank.select("id", F.col("r").alias("score"))


def relevance(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, **kw) -> DataFrame:
    """Personalised rank around seeds (id) on symmetric edges; empty for no seeds."""
    s = seeds.select("id").distinct().withColumn("weight", F.lit(1.0))
    if s.isEmpty():
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    return pagerank(nodes, symmetric(edges), s, **kw)


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """id, depth of all nodes that structural edges reach from the roots."""
    e = edges.where(F.col("kind").isin(*STRUCTURAL)).select("src", "dst").distinct()
    seen = front = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while True:
        depth += 1
        new = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        front = cut(new)
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front)) if depth % CUT_EVERY == 0 else seen.unionByName(front)


def dead_modules(files: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that no root reaches."""
    return files.join(reachable(roots, edges), "id", "left_anti")


def subgraph(roots: DataFrame, edges: DataFrame, depth: int, kinds: Sequence[str] = STRUCTURAL) -> DataFrame:
    """id, depth within a number of hops."""
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    seen = roots.select("id").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(d))
        seen = cut(seen.unionByName(front))
        front = seen.where(F.col("depth") == d)
    return seen


def shortest_path(src: object, dst: object, edges: DataFrame, max_hops: int = 12, kinds: Sequence[str] = STRUCTURAL) -> DataFrame:
    """path (ids) of the fewest hops, the least in order of ids; empty if none."""
    e = edges.where(F.col("kind").isin(*kinds)).select("src", "dst").distinct()
    front = e.select("src").limit(1).select(F.lit(src).cast(dict(e.dtypes)["src"]).alias("at")).withColumn("path", F.array("at"))
    seen = front.select("at")
    for _ in range(max_hops):
        hit = front.where(F.col("at") == F.lit(dst))
        if not hit.isEmpty():
            return hit.select("path").orderBy("path").limit(1)
        step = front.join(e, front["at"] == e["src"]).select(F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")).groupBy("at").agg(F.min("path").alias("path"))
        front = cut(step.join(seen, "at", "left_anti"))
        seen = seen.union(front.select("at"))
    return front.where(F.col("at") == F.lit(dst)).select("path").limit(1)


def placed_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges with the partition of both ends (id, part): s, d."""
    return edges.join(owner.select(F.col("id").alias("src"), F.col("part").alias("s")), "src").join(owner.select(F.col("id").alias("dst"), F.col("part").alias("d")), "dst")


def partition_stats(owner: DataFrame, edges: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """part, files, internal, outgoing, incoming, cohesion, instability, layer,
    weak, and abstractness where type counts (id) are given (A11)."""
    e = placed_edges(edges, owner)
    ends = e.select(F.explode(F.array(F.struct(F.col("s").alias("part"), F.lit("s").alias("end")), F.struct(F.col("d").alias("part"), F.lit("d").alias("end")))).alias("x"), (F.col("s") == F.col("d")).alias("same"))
    counts = ends.groupBy(F.col("x.part").alias("part")).agg(
        F.count(F.when(F.col("same") & (F.col("x.end") == "s"), 1)).alias("internal"),
        F.count(F.when(~F.col("same") & (F.col("x.end") == "s"), 1)).alias("outgoing"),
        F.count(F.when(~F.col("same") & (F.col("x.end") == "d"), 1)).alias("incoming"),
    )
    sizes = owner.groupBy("part").agg(F.count("*").alias("files"))
    out = sizes.join(counts, "part", "left").na.fill(0, ["internal", "outgoing", "incoming"])
    flow, held = F.col("outgoing") + F.col("incoming"), F.col("internal") + F.col("outgoing")
    out = out.withColumn("cohesion", F.when(held > 0, F.col("internal") / held).otherwise(0.0)).withColumn("instability", F.when(flow > 0, F.col("outgoing") / flow).otherwise(0.0))
    layer = F.when(F.col("instability") <= 0.3, "foundation").when(F.col("instability") >= 0.9, "top").otherwise("middle")
    out = out.withColumn("layer", layer).withColumn("weak", (F.col("layer") != "top") & (F.col("cohesion") < 0.5) & (held > 0))
    if types is not None:
        abstract = types.join(owner, "id").groupBy("part").agg(F.count("*").alias("abstract"))
        out = out.join(abstract, "part", "left").withColumn("abstractness", F.coalesce("abstract", F.lit(0)) / F.col("files")).drop("abstract")
    return out


def pair_coupling(owner: DataFrame, edges: DataFrame) -> DataFrame:
    """s, d, edges, intensity (edges for a file of s), level."""
    sizes = owner.groupBy(F.col("part").alias("s")).agg(F.count("*").alias("files"))
    pairs = placed_edges(edges, owner).where("s != d").groupBy("s", "d").agg(F.count("*").alias("edges")).join(sizes, "s")
    x = F.col("edges") / F.col("files")
    return pairs.select("s", "d", "edges", x.alias("intensity"), F.when(x >= 0.6, "tight").when(x >= 0.3, "moderate").otherwise("none").alias("level"))


def modularity(owner: DataFrame, edges: DataFrame) -> DataFrame:
    """q of a partition; edges with an end outside it don't count; 0 without edges."""
    e = placed_edges(edges, owner)
    total = e.agg(F.count("*").alias("m"))
    ends = e.select(F.explode(F.array("s", "d")).alias("part"), F.when(F.col("s") == F.col("d"), 0.5).otherwise(0.0).alias("inside"))
    per = ends.groupBy("part").agg(F.count("*").alias("k"), F.sum("inside").alias("inside")).crossJoin(F.broadcast(total))
    q = F.sum(F.col("inside") / F.col("m") - F.pow(F.col("k") / (2 * F.col("m")), 2))
    return per.agg(F.coalesce(q, F.lit(0.0)).alias("q"))


def rollup(edges: DataFrame, owner: DataFrame, min_edges: int = 1, outside: str | None = None) -> DataFrame:
    """s, d, edges, weight between partitions; ends without one fall into the
    bucket `outside`, if named (A14, A16)."""
    def end(c: str, p: str) -> DataFrame:
        return owner.select(F.col("id").alias(c), F.col("part").alias(p))

    how = "inner" if outside is None else "left"
    e = edges.join(end("src", "s"), "src", how).join(end("dst", "d"), "dst", how)
    if outside is not None:
        e = e.withColumns({p: F.coalesce(p, F.lit(outside)) for p in ("s", "d")})
    return e.where("s != d").groupBy("s", "d").agg(F.count("*").alias("edges"), F.sum(edge_weight()).alias("weight")).where(F.col("edges") >= min_edges)


def focus(edges: DataFrame, owner: DataFrame, part: object) -> DataFrame:
    """Edges around one partition: its files are shown, others as one stub each."""
    e = placed_edges(edges, owner).where((F.col("s") == F.lit(part)) | (F.col("d") == F.lit(part)))
    a = F.when(F.col("s") == F.lit(part), F.col("src").cast("string")).otherwise(F.concat(F.lit("pkg:"), "s"))
    b = F.when(F.col("d") == F.lit(part), F.col("dst").cast("string")).otherwise(F.concat(F.lit("pkg:"), "d"))
    return e.select(a.alias("a"), b.alias("b"), edge_weight().alias("w")).where("a != b").groupBy("a", "b").agg(F.sum("w").alias("weight"))


def cross_package(edges: DataFrame, owner: DataFrame, examples: int = 3) -> DataFrame:
    """s, d, edges, examples (the first src->dst pairs in order)."""
    pair = F.struct("src", "dst")
    return (
        placed_edges(edges, owner).where("s != d").groupBy("s", "d").agg(F.count("*").alias("edges"), F.slice(F.sort_array(F.collect_list(pair)), 1, examples).alias("x"))
        .select("s", "d", "edges", F.transform("x", lambda p: F.concat_ws("->", p["src"].cast("string"), p["dst"].cast("string"))).alias("examples"))
    )


def alignment(clusters: DataFrame) -> DataFrame:
    """purity: files in their cluster's largest directory, over all (id, cluster, dir)."""
    per = clusters.groupBy("cluster", "dir").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.agg((F.sum("top") / F.sum("all")).alias("purity"))


def coedit_density(clusters: DataFrame, pairs: DataFrame) -> DataFrame:
    """within, across: pairs that change together over possible pairs."""
    c = clusters.select("id", "cluster")
    hit = pairs.join(c.select(F.col("id").alias("file_a"), F.col("cluster").alias("x")), "file_a").join(c.select(F.col("id").alias("file_b"), F.col("cluster").alias("y")), "file_b")
    counts = hit.agg(F.count(F.when(F.col("x") == F.col("y"), 1)).alias("i"), F.count(F.when(F.col("x") != F.col("y"), 1)).alias("o"))
    size = c.groupBy("cluster").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pi"), F.sum("n").alias("n"))
    every = F.col("n") * (F.col("n") - 1) / 2
    return counts.crossJoin(F.broadcast(size)).select(
        F.when(F.col("pi") > 0, F.col("i") / F.col("pi")).otherwise(0.0).alias("within"),
        F.when(every - F.col("pi") > 0, F.col("o") / (every - F.col("pi"))).otherwise(0.0).alias("across"),
    )


def external_cosine(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """x, y, cosine of the clusters' vectors of targets outside them."""
    e = edges.join(clusters.select(F.col("id").alias("src"), F.col("cluster").alias("x")), "src").join(clusters.select(F.col("id").alias("dst"), F.col("cluster").alias("own")), "dst", "left").where("own is null")
    v = e.groupBy("x", "dst").agg(F.count("*").cast("double").alias("v"))
    norm = v.groupBy("x").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    dot = v.join(v.select(F.col("x").alias("y"), "dst", F.col("v").alias("u")), "dst").where("x < y").groupBy("x", "y").agg(F.sum(F.col("v") * F.col("u")).alias("dot"))
    return dot.join(norm, "x").join(norm.select(F.col("x").alias("y"), F.col("norm").alias("m")), "y").select("x", "y", (F.col("dot") / (F.col("norm") * F.col("m"))).alias("cosine"))


def bridges(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, count of edges that join two clusters."""
    owner = clusters.select("id", F.col("cluster").alias("part"))
    return placed_edges(edges, owner).where("s != d").groupBy("src", "dst").agg(F.count("*").alias("count"))


def fragmented(clusters: DataFrame, share: float = 0.9) -> DataFrame:
    """fragmented: whether that share of the clusters hold one file."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg((F.avg((F.col("n") == 1).cast("double")) >= share).alias("fragmented"))
