"""The registered queries over the projected relations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import patterns as P
from lodestrata.operators import community, components, context, diff, evaluate, extract, graph, history, incremental, nearest, observe, report, rules, symbols, vectors
from lodestrata.sources.projection import CTE, Relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WINDOWS = f"""
w90 as (select churn.* from churn, clock where epoch >= now - 90 * 86400),
ch90 as (select file_id, sum(added + deleted) as churn, count(distinct commit_id) as commits, count(distinct author) as authors from w90 group by 1),
rec90 as (select file_id, least(1.0, (max(now) - min(epoch)) / 86400.0 / 90) as recency, (max(now) - min(epoch)) / 86400.0 as age_days from churn, clock group by 1),
lines90 as (select file_id, author, sum(added + deleted) as lines from w90 group by 1, 2 having sum(added + deleted) > 0),
cum90 as (select *, sum(lines) over (partition by file_id order by lines desc, author rows unbounded preceding) as upto, sum(lines) over (partition by file_id) as total,
  row_number() over (partition by file_id order by lines desc, author) as rn from lines90),
own90 as (select file_id, min(case when upto >= 0.5 * total then rn end) as bus_factor, floor(max(lines / total) * 1000 + 0.5) / 1000 as top_author_share from cum90 group by 1),
pairs as (select a.file_id as file_a, b.file_id as file_b, count(*) as n from
  (select *, count(*) over (partition by commit_id) as k from touched) a join (select * from touched) b on a.commit_id = b.commit_id and a.file_id < b.file_id
  where k between 2 and 50 group by 1, 2 having count(*) >= 2),
shown as (select * from files where role not in ('generated', 'script')),
hot as (select id, churn, cognitive_max as complexity, recency, cast(floor(churn * cognitive_max * recency + 0.5) as bigint) as score
  from shown join ch90 on ch90.file_id = id join rec90 on rec90.file_id = id where churn > 0 and cognitive_max > 0)
"""


def query(sql: str | None = None, windows: bool = True, recursive: bool = False):
    """Registers a query of Relations under its name with its SQL."""

    def register(f: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"with {'recursive ' if recursive else ''}{CTE}{',' + WINDOWS if windows else ''}{sql if sql.lstrip().startswith(',') else ' ' + sql}"
        return f

    return register


def _shown(r: Relations) -> DataFrame:
    return report.keep_files(r.files)


def _churn90(r: Relations) -> DataFrame:
    return history.churn_metrics(r.churn, 90, r.now)


def _lines90(r: Relations) -> DataFrame:
    return history.author_lines(history.within(r.churn, 90, r.now))


def _pairs(r: Relations) -> DataFrame:
    return history.coupling(r.churn, 2, 50)


def _hot(r: Relations, k: int | None = None) -> DataFrame:
    return report.hotspots(_shown(r), _churn90(r), history.recency(r.churn, 90, r.now), k)


@query("select file_id, churn, commits, authors from ch90")
def churn_90d(r):
    return _churn90(r)


@query("""select file_id, sum(added + deleted) as churn, count(distinct commit_id) as commits, count(distinct author) as authors from churn group by 1""", windows=False)
def churn_lifetime(r):
    return history.churn_metrics(r.churn, None, 0)


@query("""select file_id, sum(case when epoch >= now - 30 * 86400 then added + deleted else 0 end) as churn_30d, sum(case when epoch >= now - 90 * 86400 then added + deleted else 0 end) as churn_90d,
sum(case when epoch >= now - 180 * 86400 then added + deleted else 0 end) as churn_180d, sum(added + deleted) as churn_lifetime from churn, clock group by 1""", windows=False)
def churn_windows(r):
    return history.churn_windows(r.churn, [30, 90, 180, None], r.now)


@query("select file_id, round(age_days, 6) as age_days, round(recency, 6) as recency from rec90")
def recency_90d(r):
    return history.recency(r.churn, 90, r.now).select("file_id", F.round("age_days", 6).alias("age_days"), F.round("recency", 6).alias("recency"))


@query("select file_id, cast(bus_factor as bigint) as bus_factor, top_author_share from own90")
def ownership_90d(r):
    return history.ownership(_lines90(r))


@query("select file_id, author, lines from cum90 where rn = 1")
def top_author_90d(r):
    return history.top_author(_lines90(r))


@query("select file_a, file_b, n as count from pairs")
def change_coupling(r):
    return _pairs(r).select("file_a", "file_b", "count")


@query("select count(*) as skipped from (select commit_id from touched group by 1 having count(*) > 50)")
def skipped_commits(r):
    return history.skipped_commits(r.churn, 50)


@query("""select case when file_a = 10 then file_b else file_a end as partner, n as count from pairs where file_a = 10 or file_b = 10""")
def coupled_to(r):
    return history.coupled_to(_pairs(r), 10)


TESTS = """, links as (select test_id, source_id from (select t.id as test_id, s.id as source_id, n,
  row_number() over (partition by t.id order by n desc, s.id) as rn from (select file_a as x, file_b as y, n from pairs union all select file_b, file_a, n from pairs)
  join files t on t.id = x and t.role = 'test' join files s on s.id = y and s.role not in ('test', 'fixture')) where rn = 1
  and test_id not in (select id from files where role = 'test' and id % 20 = 1)
  union all select t.id, t.id + 7 from files t join files s on s.id = t.id + 7 where t.role = 'test' and t.id % 20 = 1 and s.role not in ('test', 'fixture'))"""


def _links(r: Relations) -> DataFrame:
    tests, sources = r.files.where("role = 'test'"), r.files.where("role not in ('test', 'fixture')")
    candidates = tests.where("id % 20 = 1").select(F.col("id").alias("test_id"), (F.col("id") + 7).alias("source_id"))
    linked = history.link_tests(tests, sources, candidates, _pairs(r))
    return linked.where("method = 'path' or test_id % 20 != 1")


@query(TESTS + " select test_id, source_id from links")
def test_links(r):
    return _links(r).select("test_id", "source_id")


@query(TESTS + " select source_id, count(distinct test_id) as linked_test_count from links group by 1")
def linked_test_count(r):
    return history.linked_test_count(_links(r))


@query(TESTS + """, tl as (select source_id as file_id, author, sum(lines) as lines from links join (select file_id, author, sum(added + deleted) as lines from churn group by 1, 2) l on l.file_id = test_id group by 1, 2),
c as (select *, sum(lines) over (partition by file_id order by lines desc, author rows unbounded preceding) as upto, sum(lines) over (partition by file_id) as total, row_number() over (partition by file_id order by lines desc, author) as rn from tl)
select file_id, cast(min(case when upto >= 0.5 * total then rn end) as bigint) as bus_factor, floor(max(lines / total) * 1000 + 0.5) / 1000 as top_author_share from c group by 1""")
def test_ownership(r):
    return history.test_ownership(_links(r), history.author_lines(r.churn))


@query(TESTS + """, tl as (select source_id as file_id, author, sum(lines) as lines from links join (select file_id, author, sum(added + deleted) as lines from churn group by 1, 2) l on l.file_id = test_id group by 1, 2),
c as (select *, sum(lines) over (partition by file_id order by lines desc, author rows unbounded preceding) as upto, sum(lines) over (partition by file_id) as total, row_number() over (partition by file_id order by lines desc, author) as rn from tl),
o as (select file_id, cast(min(case when upto >= 0.5 * total then rn end) as bigint) as bus_factor from c group by 1), n as (select source_id, count(distinct test_id) as linked_test_count from links group by 1)
select id, linked_test_count, bus_factor, row_number() over (order by linked_test_count desc, id) as rank from shown join o on file_id = id join n on source_id = id where bus_factor <= 1 order by linked_test_count desc, id limit 10""")
def test_coverage_silos(r):
    links = _links(r)
    return report.test_silos(_shown(r), history.test_ownership(links, history.author_lines(r.churn)), history.linked_test_count(links)).select("id", "linked_test_count", "bus_factor", "rank")


@query("select count(distinct author) as authors from w90")
def author_count(r):
    return history.author_count(r.churn, 90, r.now)


@query("select id, churn, complexity, round(recency, 6) as recency, score, row_number() over (order by score desc, id) as rank from hot order by score desc, id limit 10")
def hotspots(r):
    return _hot(r, 10).select("id", "churn", "complexity", F.round("recency", 6).alias("recency"), "score", "rank")


@query("""select id, churn, cast(bus_factor as bigint) as bus_factor, row_number() over (order by churn desc, id) as rank from shown join ch90 on ch90.file_id = id join own90 on own90.file_id = id
where bus_factor <= 1 order by churn desc, id limit 10""")
def knowledge_silos(r):
    return report.silos(_shown(r), _churn90(r), history.ownership(_lines90(r))).select("id", "churn", "bus_factor", "rank")


@query("""select file_a, file_b, n as count, row_number() over (order by n desc, file_a, file_b) as rank from pairs where file_a in (select id from shown) and file_b in (select id from shown)
order by n desc, file_a, file_b limit 10""")
def coupling_clusters(r):
    return report.coupling_clusters(_pairs(r), _shown(r))


@query("select id, churn as value, row_number() over (order by churn desc, id) as rank from shown join ch90 on file_id = id order by 2 desc, 1 limit 20")
def top_churn(r):
    at = _shown(r).select("id").join(_churn90(r).select(F.col("file_id").alias("id"), F.col("churn").alias("value")), "id")
    return report.top_by_metric(at, 20)


@query(""", r as (select id, row_number() over (order by score desc, id) as rank from hot), s as (select *, sum(length(cast(id as varchar)) + 12) over (order by rank rows unbounded preceding) as chars from r)
select id, rank, chars from s where rank = 1 or chars <= 400""")
def budget_slice(r):
    return report.budget(_hot(r), "id", "rank", 100).select("id", "rank", "chars")


def _old(r: Relations) -> DataFrame:
    return r.churn.where(F.col("epoch") < r.now - 90 * 86_400)


@query(""", older as (select * from churn, clock where epoch < now - 90 * 86400), ck as (select max(epoch) as n2 from older),
c2 as (select file_id, sum(added + deleted) as churn from older, ck where epoch >= n2 - 90 * 86400 group by 1), r2 as (select file_id, least(1.0, (max(n2) - min(epoch)) / 86400.0 / 90) as recency from older, ck group by 1),
hot2 as (select id, cast(floor(churn * cognitive_max * recency + 0.5) as bigint) as score from shown join c2 on c2.file_id = id join r2 on r2.file_id = id where churn > 0 and cognitive_max > 0),
a as (select id, score as now_ from hot order by score desc, id limit 50), b as (select id, score as before_ from hot2 order by score desc, id limit 50)
select id, now_ as now, before_ as before, case when before_ is null then 'new' when now_ is null then case when coalesce(h.score, 0) < before_ then 'resolved' else 'displaced' end
when now_ > before_ then 'worsened' when now_ < before_ then 'improved' else 'unchanged' end as status from a full join b using (id) left join hot h using (id)""")
def hotspot_drift(r):
    old = _old(r)
    past = old.agg(F.max("epoch")).first()[0] or 0
    before = report.hotspots(_shown(r), history.churn_metrics(old, 90, past), history.recency(old, 90, past), None)
    now = _hot(r)
    return report.drift(now.where("rank <= 50"), before.where("rank <= 50"), now, before)


# graph

@query("""select id, coalesce(i, 0) as fan_in, coalesce(o, 0) as fan_out, case when coalesce(i, 0) + coalesce(o, 0) > 0 then round(coalesce(o, 0) / (coalesce(i, 0) + coalesce(o, 0)), 6) end as instability
from files left join (select dst as id, count(*) as i from edges group by 1) using (id) left join (select src as id, count(*) as o from edges group by 1) using (id)""", windows=False)
def degrees(r):
    return graph.degrees(r.files, r.edges).withColumn("instability", F.round("instability", 6))


BARREL = """, shares as (select src as barrel, dst as nxt, weight / sum(weight) over (partition by src) as share from edges where src in (select id from files where role = 'barrel')),
walk as (select src, dst, kind, weight, [dst] as path from edges where src not in (select id from files where role = 'barrel')
 union all select src, nxt, kind, weight * share, list_append(path, nxt) from walk join shares on barrel = dst where nxt <> src and not list_contains(path, nxt)),
resolved as (select src, dst, kind, sum(weight) as weight from walk where dst not in (select barrel from shares) group by 1, 2, 3)"""


@query(BARREL + " select src, dst, kind, round(weight, 6) as weight from resolved", windows=False, recursive=True)
def barrel_resolved(r):
    return graph.resolve_barrels(r.files, r.edges).withColumn("weight", F.round("weight", 6))


@query(BARREL + " select dst as id, round(sum(weight), 6) as utilization from resolved group by 1", windows=False, recursive=True)
def utilization(r):
    return graph.utilization(graph.resolve_barrels(r.files, r.edges)).withColumn("utilization", F.round("utilization", 6))


def _rank_sql(steps: int, start: str, symmetric: bool) -> str:
    e = "(select src, dst, kind from edges union all select dst, src, kind from edges)" if symmetric else "edges"
    sql = f""", w as (select src, dst, sum(case kind when 're-exports' then 0.5 else 1.0 end) as w from {e} e group by 1, 2), sh as (select src, dst, w / sum(w) over (partition by src) as s from w),
p0 as ({start}), r0 as (select id, p as r from p0)"""
    for k in range(1, steps + 1):
        sql += f""", r{k} as (select p0.id, (1 - 0.85 + 0.85 * (select coalesce(sum(r), 0) from r{k - 1} where id not in (select src from sh))) * p + 0.85 * coalesce(g, 0) as r
 from p0 left join (select dst as id, sum(r * s) as g from r{k - 1} join sh on src = id group by 1) x using (id))"""
    return sql


@query(_rank_sql(4, "select id, 1.0 / (select count(*) from files) as p from files", False) + " select id, round(r, 8) as score from r4", windows=False)
def pagerank(r):
    return graph.pagerank(r.files, r.edges, iterations=4, tolerance=0).withColumn("score", F.round("score", 8))


@query(_rank_sql(4, "select id, case when id in (1, 10, 20) then 1.0 / 3 else 0.0 end as p from files", True) + " select id, round(r, 8) as score from r4", windows=False)
def relevance(r):
    return graph.relevance(r.files, r.edges, r.files.where("id in (1, 10, 20)"), iterations=4, tolerance=0).withColumn("score", F.round("score", 8))


REACH = """, reach as (select id from files where role in ('entry', 'barrel', 'test', 'script', 'config', 'fixture') union select dst from reach join edges on src = id)"""


@query(REACH + " select id, loc from files where id not in (select id from reach)", windows=False, recursive=True)
def dead_modules(r):
    roots = r.files.where("role in ('entry', 'barrel', 'test', 'script', 'config', 'fixture')")
    return graph.dead_modules(r.files, r.edges, roots).select("id", "loc")


@query(""", hops as (select 13 as id, 0 as depth union select dst, depth + 1 from hops join edges on src = id where depth < 3)
select cast(id as bigint) as id, min(depth) as depth from hops group by 1""", windows=False, recursive=True)
def subgraph(r):
    return graph.subgraph(r.files.where("id = 13"), r.edges, 3)


@query(""", links as (select src as a, dst as b from edges where weight >= 3 union select dst, src from edges where weight >= 3),
reach as (select a as node, a as other from links union select node, b from reach join links on a = other) select node, min(other) as component from reach group by 1""", windows=False, recursive=True)
def connected_components(r):
    return components.connected_components(r.edges.where("weight >= 3"), "src", "dst")


def _owner(r: Relations) -> DataFrame:
    return r.files.select("id", F.col("package").alias("part"))


PART = """, pe as (select s.package as s, d.package as d, e.* from edges e join files s on s.id = src join files d on d.id = dst)"""


@query(PART + """, c as (select part, sum(i) as internal, sum(o) as outgoing, sum(n) as incoming from (select s as part, case when s = d then 1 else 0 end as i, case when s <> d then 1 else 0 end as o, 0 as n from pe
 union all select d, 0, 0, case when s <> d then 1 else 0 end from pe) group by 1),
x as (select f.package as part, f.n as files, coalesce(internal, 0) as internal, coalesce(outgoing, 0) as outgoing, coalesce(incoming, 0) as incoming from (select package, count(*) as n from files group by 1) f left join c on part = package),
y as (select *, case when internal + outgoing > 0 then internal / (internal + outgoing) else 0 end as cohesion, case when outgoing + incoming > 0 then outgoing / (outgoing + incoming) else 0 end as instability from x),
z as (select *, case when instability <= 0.3 then 'foundation' when instability >= 0.9 then 'top' else 'middle' end as layer from y)
select part, files, cast(internal as bigint) as internal, cast(outgoing as bigint) as outgoing, cast(incoming as bigint) as incoming, round(cohesion, 6) as cohesion, round(instability, 6) as instability, layer,
layer <> 'top' and cohesion < 0.5 and internal + outgoing > 0 as weak, round(coalesce(t, 0) / files, 6) as abstractness from z left join (select package, count(*) as t from files where role = 'types' group by 1) on package = part""", windows=False)
def partition_stats(r):
    out = graph.partition_stats(_owner(r), r.edges, r.files.where("role = 'types'").select("id"))
    return out.withColumns({c: F.round(c, 6) for c in ("cohesion", "instability", "abstractness")})


@query(PART + """ select s, d, n as edges, round(n / f, 6) as intensity, case when n / f >= 0.6 then 'tight' when n / f >= 0.3 then 'moderate' else 'none' end as level
from (select s, d, count(*) as n from pe where s <> d group by 1, 2) join (select package, count(*) as f from files group by 1) on package = s""", windows=False)
def pair_coupling(r):
    return graph.pair_coupling(_owner(r), r.edges).withColumn("intensity", F.round("intensity", 6))


@query(PART + """, m as (select count(*) as m from pe), k as (select part, sum(i) as i, sum(k) as k from (select s as part, case when s = d then 1 else 0 end as i, 1 as k from pe union all select d, 0, 1 from pe) group by 1)
select round(coalesce(sum(i / m - (k / (2 * m)) * (k / (2 * m))), 0), 6) as q from k, m""", windows=False)
def modularity(r):
    return graph.modularity(_owner(r), r.edges).withColumn("q", F.round("q", 6))


@query(PART + " select s, d, count(*) as edges, sum(weight) as weight from pe where s <> d group by 1, 2 having count(*) >= 2", windows=False)
def package_rollup(r):
    return graph.rollup(r.edges, _owner(r), 2)


@query(PART + """ select a, b, sum(weight) as weight from (select case when s = 'Brand#11' then cast(src as varchar) else 'pkg:' || s end as a, case when d = 'Brand#11' then cast(dst as varchar) else 'pkg:' || d end as b, weight
from pe where s = 'Brand#11' or d = 'Brand#11') where a <> b group by 1, 2""", windows=False)
def package_focus(r):
    return graph.focus(r.edges, _owner(r), "Brand#11")


@query(PART + """ select s, d, count(*) as edges, array_to_string(list(cast(src as varchar) || '->' || cast(dst as varchar) order by src, dst)[1:3], ' ') as examples from pe where s <> d group by 1, 2""", windows=False)
def cross_package(r):
    return graph.cross_package(r.edges, _owner(r)).withColumn("examples", F.array_join("examples", " "))


@query(""", p as (select cluster, dir, count(*) as n from (select package as cluster, domain as dir from files) group by 1, 2) select round(sum(t) / sum(a), 6) as purity from (select max(n) as t, sum(n) as a from p group by cluster)""", windows=False)
def directory_alignment(r):
    return graph.alignment(r.files.select("id", F.col("package").alias("cluster"), F.col("domain").alias("dir"))).withColumn("purity", F.round("purity", 6))


@query(""", c as (select file_a, file_b, x.package = y.package as same from pairs join files x on x.id = file_a join files y on y.id = file_b), s as (select package, count(*) as n from files group by 1),
t as (select sum(n * (n - 1) / 2) as pi, sum(n) * (sum(n) - 1) / 2 as every from s) select round(count(*) filter (same) / max(pi), 8) as within, round(count(*) filter (not same) / max(every - pi), 8) as across from c, t""")
def coedit_density(r):
    out = graph.coedit_density(r.files.select("id", F.col("package").alias("cluster")), _pairs(r))
    return out.select(F.round("within", 8).alias("within"), F.round("across", 8).alias("across"))


@query(""", v as (select s.package as x, dst, cast(count(*) as double) as v from edges join (select * from files where role in ('source', 'entry', 'barrel')) s on s.id = src where dst not in (select id from files where role in ('source', 'entry', 'barrel')) group by 1, 2),
n as (select x, sqrt(sum(v * v)) as n from v group by 1), d as (select a.x, b.x as y, sum(a.v * b.v) as d from v a join v b on a.dst = b.dst and a.x < b.x group by 1, 2)
select d.x, d.y, round(d / (n1.n * n2.n), 6) as cosine from d join n n1 on n1.x = d.x join n n2 on n2.x = d.y""", windows=False)
def external_cosine(r):
    return graph.external_cosine(r.files.where("role in ('source', 'entry', 'barrel')").select("id", F.col("package").alias("cluster")), r.edges).withColumn("cosine", F.round("cosine", 6))


@query(PART + " select src, dst, count(*) as count from pe where s <> d group by 1, 2", windows=False)
def package_bridges(r):
    return graph.bridges(r.files.select("id", F.col("package").alias("cluster")), r.edges)


@query(""" select avg(case when n = 1 then 1.0 else 0.0 end) >= 0.9 as fragmented from (select package, count(*) as n from files group by 1)""", windows=False)
def package_fragmentation(r):
    return graph.fragmented(r.files.select("id", F.col("package").alias("cluster")))


# rules

RULES = [
    dict(id="size", type=rules.TYPES[0], metric="loc", max=1900, excludeRoles=["test", "fixture"]),
    dict(id="small", type=rules.TYPES[1], metric="cognitive_max", min=2, severity="warning"),
    dict(id="product", type=rules.TYPES[2], metrics=["loc", "cognitive_max"], max=85000),
]


def _metrics(r: Relations) -> DataFrame:
    return r.files.select(F.col("id").alias("node_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("loc", "cognitive_max")))).alias("m")).select("node_id", "m.name", "m.value")


VIOLATIONS = """, found as (select 'size' as rule, 'error' as severity, id, cast(loc as double) as value from files where loc > 1900 and role not in ('test', 'fixture') union all select 'small', 'warning', id, cognitive_max from files where cognitive_max < 2
union all select 'product', 'error', id, loc * cognitive_max from files where loc * cognitive_max > 85000), flagged as (select *, case when id % 2 = 0 then 'carryover' else 'new' end as origin from found)"""


def _checked(r: Relations) -> DataFrame:
    parsed, _ = rules.validate(RULES)
    nodes = r.files.withColumn("kind", F.lit("file"))
    base = rules.run(parsed, nodes.where("id % 2 = 0"), r.edges, _metrics(r))
    return rules.run(parsed, nodes, r.edges, _metrics(r), base)


@query(VIOLATIONS + " select rule, severity, cast(id as varchar) as node, value, origin from flagged", windows=False)
def rule_violations(r):
    return _checked(r).select("rule", "severity", "node", "value", "origin")


@query(VIOLATIONS + """ select count(*) filter (origin = 'new' and severity = 'error') as new_errors, count(*) filter (origin = 'new' and severity = 'warning') as new_warnings,
count(*) filter (origin = 'carryover' and severity = 'error') as carryover_errors, count(*) filter (origin = 'carryover' and severity = 'warning') as carryover_warnings, count(*) filter (origin = 'new' and severity = 'error') = 0 as passed from flagged""", windows=False)
def rule_summary(r):
    return rules.summary(_checked(r))


@query(VIOLATIONS + " select cast(id as varchar) as node, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings, bool_and(origin = 'carryover') as all_carried from flagged group by 1", windows=False)
def violations_by_node(r):
    return rules.by_node(_checked(r))


@query("select src, dst from edges join files s on s.id = src join files d on d.id = dst where s.package < d.package and s.package in ('Brand#11', 'Brand#12', 'Brand#13') and d.package in ('Brand#11', 'Brand#12', 'Brand#13')", windows=False)
def layered_dependencies(r):
    path = lambda i: F.concat_ws("/", "package", F.col(i).cast("string"))
    e = r.edges.join(r.files.select(F.col("id").alias("src"), path("id").alias("a")), "src").join(r.files.select(F.col("id").alias("dst"), path("id").alias("b")), "dst")
    rule = rules.Rule(id="layers", type="layered-deps", layers=("Brand#11", "Brand#12", "Brand#13"))
    found = rules.violations(rule, r.files, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind"), _metrics(r))
    return found.select(*(F.substring_index(c, "/", -1).cast("long").alias(n) for c, n in (("node", "src"), ("dst", "dst"))))


@query("select src, dst from edges where cast(src as varchar) like '1%' and cast(dst as varchar) like '%7'", windows=False)
def forbidden_imports(r):
    rule = rules.Rule(id="ban", type="forbid-import", source=("1*",), target=("*7",))
    return rules.violations(rule, r.files, r.edges, _metrics(r)).select(F.col("node").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(VIOLATIONS + """, b as (select rule, id, value + (id % 3) - 1 as before from found where id % 5 <> 0), j as (select rule, id, value, before from (select * from found where id % 7 <> 0) full join b using (rule, id))
select rule, count(*) filter (before is null) as new, count(*) filter (value is null) as resolved, count(*) filter (case when rule = 'small' then value < before else value > before end) as worsened,
count(*) filter (case when rule = 'small' then value > before else value < before end) as improved, count(*) filter (value = before) as unchanged from j group by 1""", windows=False)
def check_diff(r):
    found = _checked(r)
    i = F.col("node").cast("long")
    before = found.where(i % 5 != 0).withColumn("value", F.col("value") + i % 3 - 1)
    return rules.compared_by_rule(rules.compare(found.where(i % 7 != 0), before))


# snapshots

SNAP = """, cut as (select min(epoch) + (max(epoch) - min(epoch)) // 2 as mid from churn), al as (select id as old_id, id + 100000 as new_id from files where id % 97 = 0),
n1 as (select distinct file_id as id from churn, cut where epoch < mid), n2 as (select distinct coalesce(new_id, file_id) as id from churn join cut on epoch >= mid left join al on old_id = file_id),
m1 as (select file_id as id, sum(added) as v from churn, cut where epoch < mid group by 1), m2 as (select coalesce(new_id, file_id) as id, sum(added) as v from churn join cut on epoch >= mid left join al on old_id = file_id group by 1)"""


def _snapshots(r: Relations) -> tuple[DataFrame, DataFrame, DataFrame]:
    low, high = r.churn.agg(F.min("epoch"), F.max("epoch")).first()
    at = low + (high - low) // 2
    aliases = r.files.where("id % 97 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 100_000).alias("new_id"))
    after = diff.resolved(r.churn.where(F.col("epoch") >= at), "file_id", aliases)
    return r.churn.where(F.col("epoch") < at), after, aliases


@query(SNAP + """, a as (select coalesce(new_id, id) as id, id as old_id from n1 left join al on old_id = id)
select case when n2.id is null then a.old_id else n2.id end as id, a.old_id, case when a.id is null then 'added' when n2.id is null then 'removed' when a.old_id <> a.id then 'renamed' else 'unchanged' end as status from a full join n2 on a.id = n2.id""", windows=False)
def diff_nodes(r):
    before, after, aliases = _snapshots(r)
    ids = lambda d: d.select(F.col("file_id").alias("id")).distinct()
    return diff.nodes(ids(before), ids(after), aliases)


@query(SNAP + """, a as (select coalesce(new_id, id) as id, v from m1 left join al on old_id = id) select id as node_id, cast(a.v as double) as before, cast(m2.v as double) as after, cast(m2.v - a.v as double) as delta
from a full join m2 using (id) where a.v is distinct from m2.v""", windows=False)
def diff_metrics(r):
    before, after, aliases = _snapshots(r)
    m = lambda d: d.groupBy(F.col("file_id").alias("node_id")).agg(F.sum("added").cast("double").alias("value")).withColumn("name", F.lit("added"))
    return diff.metrics(m(before), m(after), aliases).drop("name")


# symbols

@query("select symbol, count(distinct importer) as n, array_to_string(list(distinct importer order by importer), ',') as consumers from refs group by 1", windows=False)
def symbol_consumers(r):
    return symbols.consumers(r.references).select("symbol", F.col("n").cast("long").alias("n"), F.array_join(F.transform("consumers", lambda x: x.cast("string")), ",").alias("consumers"))


@query(""", s as (select importer, symbol, count(*) over (partition by importer) as k from refs) select a.symbol as symbol_a, b.symbol as symbol_b, count(*) as co_imports,
split_part(a.symbol, '#', 1) || '#' <> split_part(b.symbol, '#', 1) || '#' as cross_file from s a join s b on a.importer = b.importer and a.symbol < b.symbol where a.k between 2 and 40 group by all having count(*) >= 2""", windows=False)
def co_imports(r):
    return symbols.co_imports(r.references)


SPANS = """, spans as (select user_id as file_id, event_id as id, cast(floor(epoch(ts) / 60) as bigint) as start_line, cast(floor(epoch(ts) / 60) as bigint) + 600 + event_id % 1200 as end_line from events where event_type = 'click'),
points as (select user_id as file_id, event_id as p, cast(floor(epoch(ts) / 60) as bigint) as line, case when value > 50 then 1 else 0 end as hits from events where event_type = 'purchase'),
best as (select p, points.file_id, line, hits, id, row_number() over (partition by p order by end_line - start_line, start_line, id) as rn from points join spans on spans.file_id = points.file_id and start_line <= line and line <= end_line)"""


def _points(r: Relations) -> tuple[DataFrame, DataFrame]:
    e = r.table("events").withColumn("at", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 60).cast("long"))
    spans = e.where("event_type = 'click'").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("id"), F.col("at").alias("start_line"), (F.col("at") + 600 + F.col("event_id") % 1200).alias("end_line"))
    points = e.where("event_type = 'purchase'").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("p"), F.col("at").alias("line"), F.when(F.col("value") > 50, 1).otherwise(0).alias("hits"))
    return spans, points


@query(SPANS + " select p, id from best where rn = 1", windows=False)
def innermost_span(r):
    return symbols.innermost(*_points(r)).select("p", "id")


@query(SPANS + " select id, cast(floor(100 * count(*) filter (hits > 0) / count(*) + 0.5) as bigint) as coverage_pct from best where rn = 1 group by 1", windows=False)
def symbol_coverage(r):
    return symbols.coverage(symbols.innermost(*_points(r)), "id")


@query(SPANS + " select file_id, cast(floor(100 * count(*) filter (hits > 0) / count(*) + 0.5) as bigint) as coverage_pct from points group by 1", windows=False)
def file_coverage(r):
    return symbols.coverage(_points(r)[1], "file_id")


@query("select distinct dst as file_id from edges where kind = 're-exports'", windows=False)
def public_files(r):
    return symbols.public_files(r.files, r.edges)


# style

OBS = """, obs as (select event_type as type, cast(cast(json_extract(props, '$.k') as bigint) % 5 as varchar) as value, event_id as seq, user_id as file from events),
per as (select type, value, count(*) as n, min(seq) as f from obs group by 1, 2), dist as (select type, sum(n) as total, max(n) as top from per group by 1),
dom as (select type, value, row_number() over (partition by type order by n desc, f) as rn from per)"""


def _observations(r: Relations) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long") % 5
    return r.table("events").select(F.col("event_type").alias("type"), k.cast("string").alias("value"), F.col("event_id").alias("seq"), F.col("user_id").alias("file"))


@query(OBS + " select type, cast(total as bigint) as total, value as dominant, round(top / total, 6) as consistency, round(least(1.0, top / total * 0.85), 6) as confidence from dist join dom using (type) where rn = 1", windows=False)
def style_features(r):
    f = observe.features(observe.distribution(_observations(r)))
    return f.select("type", "total", "dominant", F.round("consistency", 6).alias("consistency"), F.round("confidence", 6).alias("confidence"))


@query(OBS + """, x as (select *, count(*) over (partition by type) as n, row_number() over (partition by type order by seq) - 1 as pos from obs) select type, value, seq from x where pos % greatest(1, n // 5) = 0 and pos // greatest(1, n // 5) < 5""", windows=False)
def style_examples(r):
    return observe.examples(_observations(r)).select("type", "value", "seq")


@query(OBS + ", p as (select type, value as convention from dom where rn = 1) select type, count(*) as seen, count(*) filter (value = convention) as agreeing from obs join p using (type) group by 1", windows=False)
def profile_agreement(r):
    p = observe.features(observe.distribution(_observations(r))).select("type", F.col("dominant").alias("convention"), "confidence")
    return observe.against(_observations(r), p).groupBy("type").agg(F.count("*").alias("seen"), F.count(F.when(F.col("agrees"), 1)).alias("agreeing"))


PROFILES = OBS + """, obs2 as (select event_type as type, cast(cast(json_extract(props, '$.k') as bigint) % 3 as varchar) as value, event_id as seq from events),
per2 as (select type, value, count(*) as n, min(seq) as f from obs2 group by 1, 2), dist2 as (select type, sum(n) as total, max(n) as top from per2 group by 1), dom2 as (select type, value, row_number() over (partition by type order by n desc, f) as rn from per2),
pa as (select type, value as convention, least(1.0, top / total * 0.85) as confidence from dist join dom using (type) where rn = 1), pb as (select type, value as convention, least(1.0, top / total * 0.85) as confidence from dist2 join dom2 using (type) where rn = 1)"""


def _profile(r: Relations, classes: int) -> DataFrame:
    o = _observations(r) if classes == 5 else r.table("events").select(F.col("event_type").alias("type"), (F.get_json_object("props", "$.k").cast("long") % classes).cast("string").alias("value"), F.col("event_id").alias("seq"), F.col("user_id").alias("file"))
    return observe.features(observe.distribution(o)).select("type", F.col("dominant").alias("convention"), "confidence")


@query(PROFILES + """ select type, pa.convention as before, pb.convention as after, case when pa.confidence is null then 'added' when pb.confidence is null then 'removed' when pa.convention = pb.convention and pa.confidence = pb.confidence then 'unchanged' else 'changed' end as status
from pa full join pb using (type)""", windows=False)
def profile_changes(r):
    return observe.compare(_profile(r, 5), _profile(r, 3))


@query(PROFILES + """ select type, case when pa.confidence is null or pb.confidence > pa.confidence then pb.convention else pa.convention end as convention, round(greatest(pa.confidence, pb.confidence), 6) as confidence from pa full join pb using (type)""", windows=False)
def profile_merged(r):
    return observe.merge(_profile(r, 5), _profile(r, 3)).withColumn("confidence", F.round("confidence", 6))


@query(PROFILES + f" select type, round(confidence, 6) as confidence from pa where confidence < {observe.REVIEW}", windows=False)
def profile_review(r):
    f = observe.features(observe.distribution(_observations(r)))
    return observe.review_queue(f).select("type", F.round("confidence", 6).alias("confidence"))


@query("""select doc_id as file, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) as loc from documents""", windows=False)
def code_lines(r):
    return r.table("documents").select(F.col("doc_id").alias("file"), P.code_lines(F.col("text")).cast("long").alias("loc"))


@query("""select word, count(*) as comments from (select unnest(['the', 'que', 'und', 'de', 'of']) as word) join conversations on regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])' || word || '([^\\p{L}\\p{N}_]|$)') group by 1""".replace("\\\\", "\\"), windows=False)
def review_keywords(r):
    c = r.table("conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.regexp_replace("text", r"[^\p{L}\p{N}_]", " ").alias("body"))
    words = F.split(F.lower("body"), " ")
    return c.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, ("the", "que", "und", "de", "of"))))).alias("word")).groupBy("word").agg(F.count("*").alias("comments"))


# vectors, search, graders

@query("""select vec_id, round(sim, 5) as similarity from (select vec_id, list_cosine_similarity(cast(embedding as double[]), (select cast(embedding as double[]) from embeddings where vec_id = 7)) as sim from embeddings where vec_id <> 7) order by sim desc, vec_id limit 10""", windows=False)
def similar_vectors(r):
    e = r.table("embeddings")
    q = [float(x) for x in e.where("vec_id = 7").select("embedding").first()[0]]
    return vectors.similar(e.where("vec_id != 7"), q, "vec_id", "embedding", 10).withColumn("similarity", F.round("similarity", 5))


@query("""select id, score from (select p_partkey as id, case when lower(p_name) = 'red bolt' then 100 when starts_with(lower(p_name), 'red bolt') then 80 when contains(lower(p_name), 'red bolt') then 60 when starts_with(lower(p_brand), 'red bolt') then 40 when contains(lower(p_type), 'red bolt') then 30 end as score from part) where score is not null order by score desc, id limit 20""", windows=False)
def search(r):
    p = r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("path"), F.col("p_type").alias("text"))
    return vectors.search(p, "Red Bolt", 20).select("id", "score")


@query("""select round(avg(case when quality = toxic then 1.0 else 0.0 end), 6) as accuracy, (select round(avg(2.0 * tp / (2 * tp + fp + fn)), 6) from (select l, count(*) filter (quality = l and toxic = l) as tp, count(*) filter (quality <> l and toxic = l) as fp,
count(*) filter (quality = l and toxic <> l) as fn from labels, (select unnest([0, 1]) as l) group by 1)) as macro_f1 from labels""", windows=False)
def macro_f1(r):
    out = evaluate.macro_f1(r.table("labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("predicted")))
    return out.select(F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


@query(""", a as (select id as item, churn as x, score as y from hot), r as (select *, row_number() over (order by x desc, item) as rx, row_number() over (order by y desc, item) as ry from a)
select count(*) as n, round(1 - 6.0 * sum((rx - ry) * (rx - ry)) / (count(*) * (count(*) * count(*) - 1.0)), 6) as rho from r""")
def rank_correlation(r):
    h = _hot(r)
    out = evaluate.spearman(h.select(F.col("id").alias("item"), F.col("churn").alias("score")), h.select(F.col("id").alias("item"), "score"))
    return out.withColumn("rho", F.round("rho", 6))


# more sections

@query(""", p as (select id, package, churn, authors from files left join ch90 on file_id = id), h as (select id from hot order by score desc, hot.id limit 50),
s as (select id from shown join ch90 on ch90.file_id = id join own90 on own90.file_id = id where bus_factor <= 1)
select package, count(*) as files, coalesce(sum(churn), 0) as churn, coalesce(max(authors), 0) as authors, count(*) filter (id in (select id from h)) as hotspots, count(*) filter (id in (select id from s)) as silos from p group by 1""")
def package_summary(r):
    silos = report.silos(_shown(r), _churn90(r), history.ownership(_lines90(r)), None)
    return context.package_summary(r.files, _churn90(r), _hot(r, 50), silos)


@query(""" select file_a, file_b, n as count from pairs where not exists (select 1 from edges where src = file_a and dst = file_b and weight >= 3)""")
def hidden_coupling(r):
    return context.hidden_coupling(_pairs(r), r.edges.where("weight >= 3")).select("file_a", "file_b", "count")


@query(BARREL + """, u as (select dst as id, sum(weight) as u from resolved group by 1), b as (select id, round(u * cognitive_max * churn, 6) as risk from files join u using (id) join ch90 on file_id = id)
select id, risk, row_number() over (order by risk desc, id) as rank from b where risk > 0 order by risk desc, id limit 15""", recursive=True)
def blast_radius(r):
    used = graph.utilization(graph.resolve_barrels(r.files, r.edges))
    return report.blast_radius(r.files, used, _churn90(r)).select("id", "risk", "rank")


@query(""", c as (select id, id % 101 as pct from files), k as (select id, score, cast(floor(score * (1 - pct / 100.0) + 0.5) as bigint) as risk from hot join c using (id))
select id, risk, row_number() over (order by risk desc, id) as rank from k where risk > 0 order by risk desc, id limit 10""")
def untested_risk(r):
    return report.untested_risk(_hot(r), r.files.select("id", (F.col("id") % 101).alias("coverage_pct"))).select("id", "risk", "rank")


@query("""select kind, subject, array_to_string(list_sort(answer), ',') as answer from (select *, row_number() over (partition by kind order by len(answer) desc, subject) as rn from (
select 'dependencies' as kind, src as subject, list(distinct dst) as answer from edges group by 2 union all select 'reverse-dependencies', dst, list(distinct src) from edges group by 2
union all select 'production-consumers', dst, list(distinct src) from edges where src not in (select id from files where role in ('test', 'fixture')) group by 2)) where rn <= 12""", windows=False)
def comprehension_tasks(r):
    return context.tasks(r.edges, r.files).select("kind", "subject", F.array_join(F.transform("answer", lambda x: x.cast("string")), ",").alias("answer"))


@query("""select target, array_to_string(list_sort(list(distinct src) filter (role not in ('test', 'fixture'))), ',') as source_consumers, array_to_string(list_sort(list(distinct src) filter (role in ('test', 'fixture'))), ',') as test_consumers
from (select dst as target, src, role from edges join files on id = src) group by 1""", windows=False)
def consumers_by_role(r):
    out = symbols.split_consumers(r.edges.select(F.col("dst").alias("target"), F.col("src").alias("importer")), r.files)
    text = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return out.select("target", text("source_consumers"), text("test_consumers"))


@query(""", u as (select dst as id, sum(weight) as u from edges group by 1), s as (select files.id, package, role = 'entry' as exported, coalesce(u, 0) as u from files left join u using (id))
select id, rank from (select *, row_number() over (partition by package, exported order by u desc, id) as rank from s) where rank <= 8""", windows=False)
def exports_by_file(r):
    used = r.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("utilization"))
    s = r.files.join(used, "id", "left").select("id", F.col("package").alias("file_id"), (F.col("role") == "entry").alias("exported"), F.coalesce("utilization", F.lit(0.0)).alias("utilization"))
    return symbols.exports_by_file(s).select("id", "rank")


@query(""", u as (select dst as id, sum(weight) as u from edges group by 1), s as (select id, package, u, loc / 1000 as c from files join u using (id))
select id, case when sum(u) over (partition by package) > 0 then round(c * u / sum(u) over (partition by package), 6) else 0 end as importance from s""", windows=False)
def symbol_importance(r):
    used = r.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("utilization"))
    return symbols.importance(r.files.join(used, "id").select("id", F.col("package").alias("file_id"), "utilization", (F.col("loc") / 1000).alias("centrality")))


@query("""select importer as file_id, file_id as target from refs where importer <> file_id union select src, dst from edges""", windows=False)
def depends_on(r):
    return symbols.depends_on(r.references, r.edges)


@query("""select p_partkey as id, case when p_partkey % 10 = 0 then true else false end as public from part where p_partkey not in (select dst from edges)""", windows=False)
def unused_exports(r):
    used = r.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("weight").alias("utilization"))
    exports = r.files.select("id", F.col("id").alias("file_id"))
    return symbols.unused_exports(exports, used, r.files.where("role = 'barrel'").select(F.col("id").alias("file_id"))).select("id", "public")


# incremental, vectors, graders

@query(""", f as (select doc_id as file_id, sha256(text) as h, case when doc_id % 4 = 0 then text || 'x' when doc_id % 4 = 1 then text || ' ' else text end as t from documents)
select doc_id as file_id, case when doc_id % 7 = 0 then 'structural' when doc_id % 4 in (2, 3) then 'none' when doc_id % 4 = 1 or regexp_matches(string_split(text, chr(10))[-1], '//|#') then 'cosmetic' else 'structural' end as tier from documents""", windows=False)
def reuse_tiers(r):
    d = r.table("documents").select(F.col("doc_id").alias("file_id"), "text")
    new = F.when(F.col("file_id") % 4 == 0, F.concat("text", F.lit("x"))).when(F.col("file_id") % 4 == 1, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    prints = lambda df, t: df.select("file_id", F.sha2(t, 256).alias("content_hash"), incremental.structural_hash(t).alias("structural_hash"))
    return incremental.tiers(prints(d, new), prints(d.where("file_id % 7 != 0"), F.col("text")))


@query(""", e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), q as (select * from e where vec_id % 100 = 0),
s as (select q.vec_id as query, q.label as ql, e.vec_id as item, e.label as il, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.v, e.v), 9) desc, e.vec_id) as rn from q join e on e.vec_id <> q.vec_id),
h as (select query, count(*) filter (rn <= 10 and ql = il) as hit, min(case when ql = il then rn end) as best, count(*) filter (ql = il) as n from s group by 1)
select query, round(hit / 10, 6) as p_at_k, round(hit / n, 6) as r_at_k, round(coalesce(1.0 / best, 0), 6) as rr from h where n > 0""", windows=False)
def retrieval_scores(r):
    e = r.table("embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("il"), F.col("embedding").alias("v"))
    q = e.where("item % 100 = 0").select(F.col("item").alias("query"), F.col("il").alias("ql"), F.col("v").alias("u"))
    # a stated set of queries, one row in a hundred, each held against every vector
    out = nearest.scores(e, q, 10)
    return out.select("query", *(F.round(c, 6).alias(c) for c in ("p_at_k", "r_at_k", "rr")))


@query(""", a as (select id as item from hot order by churn desc, id limit 20), b as (select id as item from hot order by score desc, id limit 20)
select round(count(*) filter (a.item is not null and b.item is not null) / count(*), 6) as jaccard from a full join b on a.item = b.item""")
def top_k_jaccard(r):
    h = _hot(r)
    out = evaluate.top_k_jaccard(h.select(F.col("id").alias("item"), F.col("churn").alias("score")), h.select(F.col("id").alias("item"), "score"), 20)
    return out.select(F.round("jaccard", 6).alias("jaccard"))


@query("""select l_partkey as test, count(*) = 20 and count(distinct l_returnflag) = 1 as stable, min(l_returnflag) as status from lineitem group by 1""", windows=False)
def flaky_tests(r):
    return evaluate.flakes(r.table("lineitem").select(F.col("l_partkey").alias("test"), F.col("l_returnflag").alias("status")), 20)


@query("""select 'mined' as stage, count(*) as n from part union all select 'large', count(*) from part where p_size > 10 union all select 'dear', count(*) from part where p_size > 10 and p_retailprice > 1000""", windows=False)
def admission_funnel(r):
    return evaluate.funnel(r.table("part").select((F.col("p_size") > 10).alias("large"), (F.col("p_retailprice") > 1000).alias("dear")), ["large", "dear"])


@query("""select o_orderkey as id, cast(o_orderpriority as varchar) as ref, row_number() over (order by o_orderdate desc, o_orderkey desc) <= 10 or o_orderpriority = '1-URGENT' as keep from orders""", windows=False)
def prune_plan(r):
    from lodestrata.sources.store import prune_plan as plan

    return plan(r.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ref"), F.col("o_orderdate").alias("taken_at")), 10, ["1-URGENT"])


@query(""", l as (select doc_id, string_split(text, chr(10)) as ls from documents), a as (select doc_id, ls, unnest(range(1, len(ls) - 1)) as i from l where len(ls) >= 3),
f as (select distinct doc_id, i, substr(trim(regexp_replace(array_to_string(ls[i:i + 2], ' '), '\\s+', ' ', 'g')), 1, 200) as fragment from a)
select md5(fragment) as fragment, count(*) as frequency, count(distinct doc_id) as files from f where fragment <> '' group by fragment having count(*) >= 2""", windows=False)
def line_clones(r):
    out = observe.clones(r.table("documents").select(F.col("doc_id").alias("file"), "text"))
    return out.select(F.md5("fragment").alias("fragment"), "frequency", "files")


@query()
def package_communities(r):
    return community.communities(_owner(r), r.edges)


@query()
def package_split(r):
    return community.split(_owner(r), r.edges)


@query()
def text_formatting(r):
    return observe.formatting(r.table("documents").select(F.col("doc_id").alias("file"), "text"))


@query()
def extracted_facts(r):
    pages = r.table("pages").select(F.col("url").alias("path"), F.lit("typescript").alias("language"), F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return extract.metrics(extract.facts(pages))


@query()
def file_dossiers(r):
    ranks = graph.pagerank(r.files, r.edges, iterations=10, tolerance=0)
    return context.dossiers(r.files, _churn90(r), ranks, r.edges, _pairs(r))
