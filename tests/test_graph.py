import itertools
import random

import pytest

from lodestrata.operators import community, components, graph

E = "src string, dst string, kind string, weight double"


def nodes(spark, *spec):
    return spark.createDataFrame([tuple(s.split(":")) if ":" in s else (s, "source") for s in spec], "id string, role string")


def edges(spark, *spec):
    out = []
    for s in spec:
        a, b, *rest = s.split(">")
        out.append((a, b, rest[1] if len(rest) > 1 else "imports", float(rest[0]) if rest else 1.0))
    return spark.createDataFrame(out, E)


def as_map(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def resolved(spark, n, e):
    return {(r["src"], r["dst"]): round(r["weight"], 6) for r in graph.resolve_barrels(n, e).collect()}


def test_degrees_leave_out_unknown_ends(spark):
    d = {r["id"]: (r["fan_in"], r["fan_out"], r["instability"]) for r in graph.degrees(nodes(spark, "a", "b", "c"), edges(spark, "a>b", "a>x", "b>a>1>references")).collect()}
    assert d == {"a": (0, 1, 1.0), "b": (1, 0, 0.0), "c": (0, 0, None)}


def test_barrel_splits_by_weight(spark):
    n = nodes(spark, "a", "i:barrel", "x", "y")
    assert resolved(spark, n, edges(spark, "a>i>8", "i>x>3", "i>y>1")) == {("a", "x"): 6.0, ("a", "y"): 2.0}


def test_barrels_in_a_row_and_dead_ends(spark):
    n = nodes(spark, "a", "i:barrel", "j:barrel", "k:barrel", "x")
    assert resolved(spark, n, edges(spark, "a>i>4", "i>j>1", "i>k>1", "j>x>1")) == {("a", "x"): 2.0, ("a", "k"): 2.0}


def test_barrel_cycle_and_way_back(spark):
    n = nodes(spark, "a", "i:barrel", "j:barrel", "x")
    got = resolved(spark, n, edges(spark, "a>i>2", "i>j>1", "i>a>1", "j>i>1", "j>x>1"))
    assert got == {("a", "x"): 0.5}


def brute_rank(ids, es, p, steps=200, d=0.85):
    rank = dict(p)
    out = {i: sum(w for s, _, w in es if s == i) for i in ids}
    for _ in range(steps):
        stuck = sum(rank[i] for i in ids if not out[i])
        rank = {i: (1 - d + d * stuck) * p[i] + d * sum(rank[s] * w / out[s] for s, t, w in es if t == i) for i in ids}
    return rank


@pytest.mark.parametrize("seed", range(2))
def test_pagerank_against_its_definition(spark, seed):
    r = random.Random(seed)
    ids = [f"n{k}" for k in range(12)]
    es = [(*r.sample(ids, 2), r.choice(["imports", "re-exports", "calls"])) for _ in range(25)]
    e = spark.createDataFrame([(a, b, k, 1.0) for a, b, k in es], E)
    n = spark.createDataFrame([(i,) for i in ids], "id string")
    want = brute_rank(ids, [(a, b, graph.KIND_WEIGHT[k]) for a, b, k in es], dict.fromkeys(ids, 1 / 12))
    got = as_map(graph.pagerank(n, e, tolerance=1e-9), "id", "score")
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(want, abs=1e-6)


def test_relevance_without_seeds_is_empty(spark):
    n = nodes(spark, "a", "b")
    assert graph.relevance(n, edges(spark, "a>b"), n.where("id = 'zzz'")).count() == 0


def test_reach_subgraph_and_path(spark):
    e = edges(spark, "a>b", "b>c", "c>a", "d>e", "b>d>1>references")
    n = nodes(spark, *"abcde")
    assert as_map(graph.reachable(n.where("id = 'a'"), e), "id", "depth") == {"a": 0, "b": 1, "c": 2}
    assert as_map(graph.dead_modules(n, e, n.where("id = 'a'")), "id", "role").keys() == {"d", "e"}
    assert as_map(graph.subgraph(n.where("id = 'a'"), e, 1), "id", "depth") == {"a": 0, "b": 1}
    assert graph.shortest_path("a", "c", e).first()[0] == ["a", "b", "c"]
    assert graph.shortest_path("a", "e", e).count() == 0


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    es = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in es:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    got = as_map(components.connected_components(spark.createDataFrame(es, "a long, b long")), "node", "component")
    assert got == {x: find(x) for x in {*itertools.chain(*es)}}


def owner(spark, **parts):
    return spark.createDataFrame([(i, p) for p, ids in parts.items() for i in ids], "id string, part string")


def test_partition_quality(spark):
    o, e = owner(spark, p="ab", q="cd"), edges(spark, "a>b", "b>c", "c>d", "d>c", "a>zz")
    s = {r["part"]: (r["files"], r["internal"], r["outgoing"], r["incoming"], r["layer"], r["weak"]) for r in graph.partition_stats(o, e).collect()}
    assert s == {"p": (2, 1, 1, 0, "top", False), "q": (2, 2, 0, 1, "foundation", False)}
    assert graph.modularity(o, e).first()[0] == pytest.approx(0.25 - (3 / 8) ** 2 + 0.5 - (5 / 8) ** 2)
    assert graph.modularity(o, edges(spark, "x>y")).first()[0] == 0
    assert [(r["s"], r["d"], r["edges"], r["level"]) for r in graph.pair_coupling(o, e).collect()] == [("p", "q", 1, "moderate")]
    out = sorted((r["s"], r["d"], r["edges"]) for r in graph.rollup(e, o, outside="other").collect())
    assert out == [("p", "other", 1), ("p", "q", 1)]


def test_communities_split_two_cliques(spark):
    ids = "abcdefgh"
    es = [f"{a}>{b}" for group in ("abcd", "efgh") for a, b in itertools.combinations(group, 2)] + ["d>e"]
    o = owner(spark, all=ids)
    got = as_map(community.communities(o, edges(spark, *es)), "id", "cluster")
    assert [got[i] for i in ids] == ["c0"] * 4 + ["c1"] * 4
    s = community.split(o, edges(spark, *es), least=5).first()
    assert (s["files"], s["clusters"]) == (8, 2) and s["q"] == pytest.approx(12 / 13 - 2 * 0.25)
    f = community.fit(o, o, edges(spark, *es)).first()
    assert f["domains_q"] == 0 and f["detected_q"] == pytest.approx(s["q"]) and f["communities"] == 2


def test_lcom_counts_method_groups(spark):
    rows = [("f", "C", "a", ["x"]), ("f", "C", "b", ["x", "c"]), ("f", "C", "c", []), ("f", "C", "d", ["y"])]
    m = spark.createDataFrame(rows, "file_id string, class string, method string, uses array<string>")
    assert community.lcom(m).first()["lcom4"] == 2
