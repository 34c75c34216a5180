import json

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import patterns as P
from lodestrata.operators import community, evaluate, extract, incremental, observe, symbols, vectors
from lodestrata.sources import logs
from lodestrata.sources.store import Store, prune_plan


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


def lines(spark, text):
    return logs.lines_of(spark.createDataFrame([("l", text)], "log string, text string"))


def test_churn_log(spark):
    text = "aaaaaaa\tann@x\t100\n\n3\t1\tsrc/{old => new}/a.ts\n-\t-\timg.png\nbbbbbbb\tbob@x\t90\n1\t1\tx.ts => y.ts\n2\t0\tlib/{ => in}/z.ts"
    got = sorted(tuple(r) for r in logs.parse_churn(lines(spark, text)).collect())
    assert got == [("aaaaaaa", "ann@x", 100, "img.png", 0, 0), ("aaaaaaa", "ann@x", 100, "src/new/a.ts", 3, 1), ("bbbbbbb", "bob@x", 90, "lib/in/z.ts", 2, 0), ("bbbbbbb", "bob@x", 90, "y.ts", 1, 1)]


def test_first_seen_follows_the_log(spark):
    assert {r["file_id"]: r["epoch"] for r in logs.first_seen(lines(spark, "@50\na\n@40\na\nb\n")).collect()} == {"a": 50, "b": 40}


def test_renames(spark):
    got = [tuple(r) for r in logs.parse_renames(lines(spark, "R092\ta.ts\tb.ts\nM\tc.ts\nA\td.ts")).collect()]
    assert got == [("a.ts", "b.ts", 92)]


def test_coverage_by_innermost_span(spark):
    fn = lambda n: {"name": "f", "loc": {"start": {"line": n}, "end": {"line": n + 1}}}
    report = {"a.ts": {"path": "a.ts", "fnMap": {n: fn(at) for n, at in zip("xyz", (2, 5, 50))}, "f": dict(x=3, y=0, z=1)}}
    points = logs.coverage_points(spark.createDataFrame([(json.dumps(report),)], "text string"))
    spans = spark.createDataFrame([("a.ts", "outer", 1, 20), ("a.ts", "inner", 4, 8)], "file_id string, id string, start_line int, end_line int")
    at = symbols.innermost(spans, points)
    assert {(r["line"], r["id"]) for r in at.collect()} == {(2, "outer"), (5, "inner")}
    assert {r["id"]: r["coverage_pct"] for r in symbols.coverage(at, "id").collect()} == {"outer": 100, "inner": 0}
    assert symbols.coverage(points, "file_id").first()["coverage_pct"] == 67


def test_diagnostics_and_test_runs(spark):
    text = lambda x: spark.createDataFrame([(json.dumps(x),)], "text string")
    es = logs.eslint_diagnostics(text([{"filePath": "a", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 1}, {"ruleId": "s", "severity": 1, "message": "m", "line": 2}]}]))
    ru = logs.ruff_diagnostics(text([{"filename": "b", "code": "E1", "message": "m", "location": {"row": 3}}]))
    s = logs.diagnostics_summary(es.unionByName(ru)).first()
    assert (s["errors"], s["warnings"], s["exit_code"]) == (2, 1, 1)
    runs = logs.run_tests(text({"testResults": [{"name": "t", "assertionResults": [{"fullName": "x", "status": "passed"}, {"fullName": "y", "status": "failed"}]}]}))
    assert {r["test"]: r["status"] for r in runs.collect()} == {"t::x": "passed", "t::y": "failed"}


def test_packages_buckets_domains_configs(spark):
    p = spark.createDataFrame([("package.json",), ("a/package.json",), ("a/b/package.json",), ("c/x.ts",)], "path string")
    assert [r[0] for r in logs.packages(p).collect()] == ["a"]
    assert sorted(r[0] for r in logs.packages(p.where("path = 'c/x.ts' or path = 'package.json'")).collect()) == ["c"]
    f = spark.createDataFrame([("a/b/x.ts",), ("a/bc/x.ts",), ("z.ts",)], "id string")
    pre = spark.createDataFrame([("a",), ("a/b",)], "package string")
    assert {r["id"]: r["package"] for r in logs.bucket(f, pre).collect()} == {"a/b/x.ts": "a/b", "a/bc/x.ts": "a", "z.ts": None}
    assert {r["id"]: (r["domain"], r["overlaps"]) for r in logs.assign_domains(f, [("one", ["a/b/**"]), ("two", ["a/"])]).collect()} == {"a/b/x.ts": ("one", 2), "a/bc/x.ts": ("two", 1), "z.ts": (None, 0)}
    c = spark.createDataFrame([("x/.prettierrc", '{"semi": "false"}'), (".editorconfig", "[*]\nindent_style = tab\nfoo = 1")], "path string, text string")
    assert sorted((r["type"], r["value"]) for r in logs.config_observations(c).collect()) == [("formatting.indent-style", "tab"), ("formatting.semicolons", "false")]


ROLE_OF = dict(x.split("=") for x in "lib/q.test.ts=test k/__tests__/q.ts=test x/fixtures/q.ts=fixture scripts/q.ts=script lib/index.ts=barrel lib/types.ts=types lib/api.types.ts=types vite.config.ts=config lib/q.ts=source".split())


@pytest.mark.parametrize("path", ROLE_OF)
def test_roles(spark, path):
    assert one(spark, path, P.classify_role) == ROLE_OF[path]
    assert one(spark, path, lambda c: P.classify_role(c, generated=F.lit(True))) == "generated"
    shebang = one(spark, path, lambda c: P.classify_role(c, F.lit(True)))
    assert shebang == (ROLE_OF[path] if ROLE_OF[path] in ("test", "fixture", "script") else "entry")


def test_names_and_paths(spark):
    for name, want in (("fooBar", "camelCase"), ("FooBar", "PascalCase"), ("foo_bar", "snake_case"), ("FOO_BAR", "SCREAMING_SNAKE"), ("foo-bar", "kebab-case"), ("Foo_bar", None), ("FOO", "PascalCase")):
        assert one(spark, name, P.convention) == want
    assert one(spark, "a/./b/../c", P.normalise) == "a/c"
    assert one(spark, "../x", P.normalise) == "../x"
    assert one(spark, "@s/p/deep", P.package_of_specifier) == "npm:@s/p"
    assert one(spark, "getHTMLPage_now", P.name_tokens) == ["get", "htmlpage", "now"]
    assert one(spark, "a/b.ts", lambda c: P.matches_any(c, ["a/*.ts"])) and not one(spark, "a/b/c.ts", lambda c: P.matches_any(c, ["a/*.ts"]))
    assert one(spark, "a/b/c.ts", lambda c: P.matches_any(c, ["a/**"])) and one(spark, "xa.b", lambda c: P.matches_any(c, ["a.b"])) and not one(spark, "xaab", lambda c: P.matches_any(c, ["a.b"]))
    assert one(spark, "lines", P.healed) == "loc"


SOURCES = [
    ("src/a.ts", "typescript", "import { b } from './b';\nimport fs from 'node:fs';\nexport function a(x: number) {\n  if (x) { return b(x) + b(1); }\n  return a(x);\n}\n"),
    ("src/b.ts", "typescript", "export const LIMIT = 3;\nexport function b(y, z) {\n  for (const k of y) { while (k) { y.find(k); } }\n  return 1;\n}\nclass Both { one() { return this.q; } two() { return this.q; } three() { return this.r; } }\n"),
    ("src/c.py", "python", "import os\n\ndef f(a, b):\n    '''Does f.'''\n    for x in a:\n        if x and b:\n            return os.sep\n    return f(a, b)\n    print(1)\n"),
    ("src/d.ts", "typescript", None), ("src/e.py", "python", "def broken(:\n"),
]


def test_extraction(spark):
    src = spark.createDataFrame(SOURCES, "path string, language string, text string")
    facts = extract.facts(src)
    assert {(r["src"], r["dst"], r["kind"], r["weight"]) for r in extract.edges(src, facts).collect()} == {("src/a.ts", "src/b.ts", "imports", 2.0), ("src/a.ts", "node:fs", "imports", 1.0), ("src/c.py", "npm:os", "imports", 1.0)}
    kinds = {r["id"]: r["kind"] for r in extract.nodes(src, facts).collect()}
    assert kinds["src/a.ts"] == "file" and kinds["src/b"] == "module" and kinds["src/a.ts#a"] == "symbol" and kinds["node:fs"] == "external"
    m = {(r["node_id"], r["name"]): r["value"] for r in extract.metrics(facts).collect()}
    assert m["src/b.ts", "loop_depth"] == 2 and m["src/b.ts", "search_in_loop"] == 1 and m["src/b.ts", "unused_params"] == 1
    assert m["src/a.ts", "recursive_functions"] == 1 and m["src/a.ts", "cyclomatic_max"] == 2
    assert m["src/c.py", "cyclomatic_max"] == 4 and m["src/c.py", "cognitive_max"] == 4 and m["src/c.py", "unreachable_statements"] == 1 and m["src/c.py#f", "symbol_cyclomatic"] == 4
    assert community.lcom(extract.members(facts)).first()["lcom4"] == 2
    assert {(r["importer"], r["symbol"]) for r in extract.references(src, facts).collect()} == {("src/a.ts", "src/b.ts#b")}
    obs = {(r["type"], r["value"]) for r in extract.observations(facts).collect()}
    assert ("naming.type", "PascalCase") in obs and ("control-flow.loops", "while") in obs and ("naming.constant", "PascalCase") in obs


def test_origin_through_reexports(spark):
    ex = spark.createDataFrame([("i", "x", "j", "y"), ("j", "*", "k", "*"), ("p", "a", "q", "a"), ("q", "a", "p", "a")], "file string, name string, to_file string, to_name string")
    got = {(r["file"], r["name"]): (r["to_file"], r["to_name"]) for r in extract.origin(ex).collect()}
    assert got["i", "x"] == ("k", "y") and ("p", "a") in got


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    n = spark.createDataFrame([("a.ts", "file", "a"), ("a.ts#f", "symbol", "f")], "id string, kind string, name string")
    m = spark.createDataFrame([("a.ts", "loc", 5.0), ("a.ts", "cx", 1.0)], "node_id string, name string, value double")
    ids = [s.create(ref, f"c{k}", f"2024-01-0{k + 1} 00:00:00", "1", node=n, metric=m) for k, ref in enumerate(["main", "dev", "main"])]
    assert ids == [1, 2, 3] and s.latest("main") == 3 and s.find("previous") == 2 and s.find("dev") == 2 and s.find("1") == 1 and s.find("9") is None
    assert s.for_commit("main", "c0") == (1, False) and s.for_commit("main", "zz") == (3, True)
    assert s.read("node", 1).count() == 1 and s.read("node", 1, all_kinds=True).count() == 2
    s.replace_metrics(1, "loc", spark.createDataFrame([("a.ts", 7.0)], "node_id string, value double"))
    assert sorted((r["name"], r["value"]) for r in s.read("metric", 1).collect()) == [("cx", 1.0), ("loc", 7.0)] and s.read("metric", 3).count() == 2
    assert s.prune(1, ["dev"]) == [1] and sorted(r["id"] for r in s.snapshots().collect()) == [2, 3] and s.read("node", 1).count() == 0
    assert {r["table"]: r["rows"] for r in s.counts().collect()}["metric"] == 4
    with pytest.raises(ValueError, match="unknown kind"):
        s.create("main", None, "2024-02-01 00:00:00", "1", node=n.withColumn("kind", F.lit("thing")))
    assert prune_plan(s.read("snapshot"), 5).where("not keep").count() == 0


def test_incremental(spark):
    f = spark.createDataFrame([("a", "1", "s1"), ("b", "2x", "s2"), ("c", "3x", "s3x"), ("d", "4", "s4")], "file_id string, content_hash string, structural_hash string")
    prior = spark.createDataFrame([("a", "1", "s1"), ("b", "2", "s2"), ("c", "3", "s3")], f.schema)
    assert {r["file_id"]: r["tier"] for r in incremental.tiers(f, prior).collect()} == {"a": "none", "b": "cosmetic", "c": "structural", "d": "structural"}
    h = lambda t: one(spark, t, incremental.structural_hash)
    assert h("a = 1; // x\n") == h("a  =\n1 ;") != h("a = 2;")
    spec = spark.createDataFrame([("m.ts", "./x", "x"), ("m.ts", "./gone", "gone")], "src string, specifier string, base string")
    files = spark.createDataFrame([("x/index.ts",), ("x.tsx",)], "id string")
    assert {r["specifier"]: r["dst"] for r in incremental.resolve(spec, files).collect()} == {"./x": "x.tsx", "./gone": None}
    before = spark.createDataFrame([("m.ts", "./x", "x/index.ts"), ("k.ts", "./y", None)], "src string, specifier string, dst string")
    assert [r["src"] for r in incremental.affected(before, spec, files).collect()] == ["m.ts"]
    w = spark.createDataFrame([(30,), (90,), (None,)], "days int")
    assert tuple(incremental.fallback_window(w, 60).first()) == (90, False) and tuple(incremental.fallback_window(w, None).first()) == (None, True)


def test_observations(spark):
    o = spark.createDataFrame([("t", "c", v, "f", k) for k, v in enumerate("bbaac")], "type string, category string, value string, file string, seq long")
    d = observe.distribution(o).first()
    assert (d["dominant"], d["total"], d["consistency"], d["counts"]) == ("b", 5, 0.4, {"a": 2, "b": 2, "c": 1})
    f = observe.features(observe.distribution(o)).first()
    assert (f["stability"], round(f["confidence"], 4), f["severity"]) == ("medium", 0.34, "off")
    assert observe.review_queue(observe.features(observe.distribution(o))).count() == 1
    many = spark.createDataFrame([("t", "c", "v", "f", k) for k in range(23)], o.schema)
    assert [r["seq"] for r in observe.examples(many).orderBy("seq").collect()] == [0, 4, 8, 12, 16]
    src = spark.createDataFrame([("a", "x = 1\ny  = 2\nz = 3"), ("b", "q\nx = 1\n y = 2\nz = 3")], "file string, text string")
    assert [(r["fragment"], r["frequency"], r["files"]) for r in observe.clones(src).collect()] == [("x = 1 y = 2 z = 3", 2, 2)]
    c = spark.createDataFrame([("1", "Please add tests and a test"), ("2", "naming is off"), ("3", "ok")], "id string, body string")
    got = {r["topic"]: (r["comments"], round(r["share"], 3)) for r in observe.topics(c, {"testing": ["tests?"], "naming": ["naming", "rename"]}).collect()}
    assert got == {"testing": (1, 0.333), "naming": (1, 0.333)}
    p = lambda *r: spark.createDataFrame(list(r), "type string, convention string, confidence double")
    a, b = p(("x", "1", 0.5), ("y", "1", 0.5), ("z", "1", 0.5)), p(("x", "2", 0.5), ("y", "2", 0.9), ("w", "1", 0.1))
    assert {r["type"]: r["convention"] for r in observe.merge(a, b).collect()} == {"x": "1", "y": "2", "z": "1", "w": "1"}
    assert {r["type"]: r["status"] for r in observe.compare(a, b).collect()} == {"x": "changed", "y": "changed", "z": "removed", "w": "added"}
    fmt = observe.formatting(spark.createDataFrame([("a", "if (x) {\n  a = 'b';\n  c = [\n    1,\n  ];\n}")], "file string, text string")).first()
    assert (fmt["indent_style"], fmt["indent_size"], fmt["semicolons"], fmt["quotes"]) == ("spaces", 2, True, "single") or fmt["semicolons"] is False


def test_vectors_and_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, [0.0, 0.0]), (5, [1.0])], "id int, e array<double>")
    got = [(r["id"], round(r["similarity"], 4)) for r in vectors.similar(v, [1.0, 1.0], "id", "e", 3).collect()]
    assert got == [(3, 1.0), (1, 0.7071), (2, 0.7071)]
    t = spark.createDataFrame([("h1", "ab"), ("h1", "ab"), ("h2", "abcd")], "text_hash string, text string")
    held = spark.createDataFrame([("m", "h2")], "model string, text_hash string")
    need = vectors.missing(t, held, "m")
    out = vectors.embed(need, "m", lambda xs: [[3.0, 4.0] for _ in xs]).first()
    assert (out["text_hash"], out["dims"], out["vector"]) == ("h1", 2, [0.6, 0.8])


def test_graders(spark):
    s = lambda *r: spark.createDataFrame(list(r), "q string, item string")
    r = evaluate.set_scores(s(("q", "a"), ("q", "b")), s(("q", "b"), ("q", "c"), ("q", "d")), ["q"], "item").first()
    assert (r["precision"], round(r["recall"], 4), round(r["f1"], 4)) == (0.5, 0.3333, 0.4)
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "x", 2), ("q", "b", 3)], "query string, item string, rank int")
    rel = spark.createDataFrame([("q", "b"), ("q", "z"), ("p", "k")], "query string, item string")
    got = {r["query"]: (r["p_at_k"], r["r_at_k"], r["rr"]) for r in evaluate.ranking_scores(ranked, rel, 2).collect()}
    assert got == {"q": (0.5, 0.5, 0.5), "p": (0.0, 0.0, 0.0)}
    runs = lambda *r: spark.createDataFrame(list(r), "test string, run int, status string")
    before = evaluate.flakes(runs(("a", 1, "failed"), ("a", 2, "failed"), ("b", 1, "passed"), ("b", 2, "failed"), ("c", 1, "passed"), ("c", 2, "passed")), 2)
    after = evaluate.flakes(runs(("a", 1, "passed"), ("a", 2, "passed"), ("c", 1, "passed"), ("c", 2, "passed")), 2)
    ch = evaluate.transitions(before, after)
    assert {r["test"]: (r["fixed"], r["broken"]) for r in ch.collect()} == {"a": (True, False), "c": (False, False)}
    assert evaluate.resolved(ch, spark.createDataFrame([("a",)], "test string")).first()[0] is True
    f = evaluate.funnel(spark.createDataFrame([(True, True), (True, False), (False, True)], "gated boolean, admitted boolean"), ["gated", "admitted"])
    assert [(r["stage"], r["n"]) for r in f.collect()] == [("mined", 3), ("gated", 2), ("admitted", 1)]
    d = spark.createDataFrame([("t", "easy", 1), ("t", "hard", 3)], "task string, stratum string, hardness int")
    assert evaluate.dominant(d).first()["stratum"] == "hard"
