import pytest

from lodestrata.operators import diff, rules
from lodestrata.operators.rules import Rule


@pytest.fixture(scope="module")
def graph_(spark):
    n = spark.createDataFrame([("pkg/a.ts", "file", "source"), ("pkg/b.ts", "file", "test"), ("core/index.ts", "file", "barrel"), ("app/x.ts", "file", None), ("pkg/a.ts#f", "symbol", None)], "id string, kind string, role string")
    e = spark.createDataFrame([("core/index.ts", "app/x.ts", "imports"), ("app/x.ts", "core/index.ts", "imports"), ("pkg/a.ts", "core/index.ts", "references"), ("core/u.ts", "core/index.ts", "imports")], "src string, dst string, kind string")
    m = spark.createDataFrame([("pkg/a.ts", "loc", 400.0), ("pkg/b.ts", "loc", 500.0), ("app/x.ts", "loc", None), ("pkg/a.ts", "cx", 3.5), ("pkg/a.ts#f", "loc", 900.0)], "node_id string, name string, value double")
    return n, e, m


def found(rule, graph_):
    return sorted((r["node"], r["dst"], r["value"], r["message"]) for r in rules.violations(rule, *graph_).collect())


def test_metric_rules(graph_):
    assert [x[0] for x in found(Rule("r", "metric-max", metric="loc", limit=350), graph_)] == ["pkg/a.ts", "pkg/a.ts#f", "pkg/b.ts"]
    got = found(Rule("r", "metric-max", metric="loc", limit=350, kind="file", exclude_roles=("test",)), graph_)
    assert got == [("pkg/a.ts", None, 400.0, "loc 400 > 350")]
    assert found(Rule("r", "metric-max", metric="loc", limit=350, exclude=("pkg/**",)), graph_) == []
    assert [x[0] for x in found(Rule("r", "metric-min", metric="cx", limit=4), graph_)] == ["pkg/a.ts"]
    assert found(Rule("r", "metric-product-max", metrics=("loc", "cx"), limit=1000), graph_) == [("pkg/a.ts", None, 1400.0, "loc x cx = 1400")]


def test_edge_rules(graph_):
    assert [x[:2] for x in found(Rule("r", "layered-deps", layers=("core", "app")), graph_)] == [("core/index.ts", "app/x.ts")]
    assert [x[:2] for x in found(Rule("r", "forbid-import", source=("app/*",), target=("index",)), graph_)] == [("app/x.ts", "core/index.ts")]
    assert found(Rule("r", "no-internal-only-barrels", packages=("core", "app")), graph_) == []
    assert [x[0] for x in found(Rule("r", "no-internal-only-barrels", packages=("core", "app", "")), (graph_[0], graph_[1].where("src != 'app/x.ts'"), graph_[2]))] == ["core/index.ts"]


def test_baseline_ignores_the_value(spark, graph_):
    rs, _ = rules.validate([dict(id="r", type="metric-max", metric="loc", max=350)])
    first = rules.run(rs, *graph_)
    worse = graph_[2].withColumn("value", graph_[2]["value"] * 2)
    again = rules.run(rs, graph_[0], graph_[1], worse, first.where("node != 'pkg/b.ts'"))
    assert {(r["node"], r["origin"]) for r in again.collect()} == {("pkg/a.ts", "carryover"), ("pkg/a.ts#f", "carryover"), ("pkg/b.ts", "new")}
    s = rules.summary(again).first()
    assert (s["new_errors"], s["carryover_errors"], s["passed"]) == (1, 2, False)
    c = {r["node"]: r["status"] for r in rules.compare(again.where("node != 'pkg/a.ts#f'"), first.where("node != 'pkg/b.ts'")).collect()}
    assert c == {"pkg/a.ts": "worsened", "pkg/a.ts#f": "resolved", "pkg/b.ts": "new"}
    assert {r["node"]: r["trend"] for r in rules.trend(rules.compare(again, first)).collect()}["pkg/a.ts"] == "worsened"


def test_validation():
    ok, warned = rules.validate(rules.DEFAULT_RULES + [dict(id="x", type="metric-max", metric="lines", max=1)], {"lines": "loc"})
    assert ok[-1].metric == "loc" and len(warned) == 1
    high = dict(id="x", type="metric-max")
    for bad in (dict(id="x", type="nope"), high | dict(metric="m"), dict(type="metric-max"), high | dict(metric="m", max=1, excludeRoles=["king"]), dict(id="x", type="metric-product-max", metrics=["m"], max=1)):
        with pytest.raises(rules.RuleError):
            rules.validate([bad])


def test_diff(spark):
    n = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    alias = spark.createDataFrame([("old", "new")], "old_id string, new_id string")
    got = {r["id"]: r["status"] for r in diff.nodes(n("a", "old", "gone"), n("a", "new", "fresh"), alias).collect()}
    assert got == {"a": "unchanged", "new": "renamed", "gone": "removed", "fresh": "added"}
    e = lambda *es: spark.createDataFrame([(*x, "imports") for x in es], "src string, dst string, kind string")
    changes = sorted(tuple(r) for r in diff.edges(e(("a", "old"), ("old", "gone")), e(("a", "new"), ("a", "fresh")), alias).collect())
    assert changes == [("a", "fresh", "imports", "added"), ("old", "gone", "imports", "removed")]
    m = lambda *ms: spark.createDataFrame(list(ms), "node_id string, name string, value double")
    got = sorted((r["node_id"], r["name"], r["before"], r["after"], r["delta"]) for r in diff.metrics(m(("old", "lines", 5.0), ("a", "loc", 1.0), ("z", "loc", None)), m(("new", "loc", 7.0), ("a", "loc", 1.0), ("z", "loc", 2.0)), alias).collect())
    assert got == [("new", "loc", 5.0, 7.0, 2.0), ("z", "loc", None, 2.0, None)]


def test_first_fragment_wins(spark):
    f = lambda *r: spark.createDataFrame(list(r), "id string, v int")
    assert sorted(tuple(r) for r in diff.merged(f(("a", 9)), f(("a", 1), ("b", 2)), key=["id"]).collect()) == [("a", 9), ("b", 2)]
    assert {r["id"]: r["status"] for r in diff.union_status(f(("a", 1), ("b", 1)), f(("b", 2), ("c", 3)), ["id"]).collect()} == {"a": "removed", "b": "kept", "c": "added"}
