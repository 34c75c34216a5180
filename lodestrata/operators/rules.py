"""Fitness rules over a graph: each rule gives violations, which a run compares
with a baseline. A violation is rule, severity, node, dst, value, limit, message.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.patterns import matches_any
from lodestrata.operators.graph import STRUCTURAL

TYPES = ("metric-max", "metric-min", "metric-product-max", "layered-deps", "forbid-import", "no-internal-only-barrels")
ROLES = tuple("source entry script config types barrel fixture test generated".split())


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    severity: str = "error"
    metric: str | None = None
    metrics: tuple[str, ...] = ()
    limit: float | None = None
    kind: str | None = None
    exclude: tuple[str, ...] = ()
    exclude_roles: tuple[str, ...] = ()
    layers: tuple[str, ...] = ()
    source: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    packages: tuple[str, ...] = field(default=())


class RuleError(ValueError):
    """A rule that isn't valid."""


def validate(raw: Sequence[dict[str, Any]], aliases: dict[str, str] | None = None) -> tuple[list[Rule], list[str]]:
    """Rules and warnings; old metric names are healed with a warning (F8)."""
    aliases, rules, warnings, seen = aliases or {}, [], [], set()
    for k, r in enumerate(raw):
        def need(key: str, kind: type | tuple[type, ...], r=r, k=k):
            if not isinstance(r.get(key), kind) or isinstance(r.get(key), bool):
                raise RuleError(f"rule {k}: {key} must be {kind}")
            return r[key]

        def heal(name: str, k=k) -> str:
            if name in aliases:
                warnings.append(f"rule {k}: {name} is now {aliases[name]}")
            return aliases.get(name, name)

        name, kind = need("id", str), need("type", str)
        if kind not in TYPES:
            raise RuleError(f"rule {name}: unknown type {kind}")
        if name in seen:
            raise RuleError(f"rule {name}: given twice")
        seen.add(name)
        severity = r.get("severity", "error")
        if severity not in ("error", "warning"):
            raise RuleError(f"rule {name}: severity {severity}")
        roles = tuple(r.get("excludeRoles", ()))
        if bad := [x for x in roles if x not in ROLES]:
            raise RuleError(f"rule {name}: unknown roles {bad}")
        common = {"id": name, "type": kind, "severity": severity, "exclude": tuple(r.get("exclude", ())), "exclude_roles": roles, "kind": r.get("kind")}
        if kind in ("metric-max", "metric-min"):
            rules.append(Rule(**common, metric=heal(need("metric", str)), limit=float(need("max" if kind == "metric-max" else "min", (int, float)))))
        elif kind == "metric-product-max":
            names = need("metrics", (list, tuple))
            if len(names) < 2:
                raise RuleError(f"rule {name}: a product needs two metrics")
            rules.append(Rule(**common, metrics=tuple(map(heal, names)), limit=float(need("max", (int, float)))))
        elif kind == "layered-deps":
            rules.append(Rule(**common, layers=tuple(need("layers", (list, tuple)))))
        elif kind == "forbid-import":
            one = lambda x: (x,) if isinstance(x, str) else tuple(x)
            rules.append(Rule(**common, source=one(need("from", (str, list, tuple))), target=one(need("to", (str, list, tuple)))))
        else:
            rules.append(Rule(**common, packages=tuple(r.get("packages", ()))))
    return rules, warnings


def number(x: Column) -> Column:
    """An integer, or at most 3 decimals without trailing zeros."""
    return F.when(x == F.floor(x), F.format_string("%d", F.floor(x).cast("long"))).otherwise(F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", ""))


def _out(df: DataFrame, rule: Rule, node: Column, dst: Column, value: Column, limit: Column, message: Column) -> DataFrame:
    return df.select(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), node.cast("string").alias("node"), dst.cast("string").alias("dst"), value.cast("double").alias("value"), limit.cast("double").alias("limit"), message.alias("message"))


def _shown(rule: Rule, nodes: DataFrame) -> DataFrame:
    out = nodes if rule.kind is None else nodes.where(F.col("kind") == rule.kind)
    if rule.exclude_roles:
        out = out.where(F.col("role").isNull() | ~F.col("role").isin(*rule.exclude_roles))
    return out.where(~matches_any(F.col("id"), rule.exclude)) if rule.exclude else out


def owner_of(names: Column, prefixes: Sequence[str]) -> Column:
    """Index of the longest prefix that a path lies under; null if none."""
    order = sorted(range(len(prefixes)), key=lambda x: -len(prefixes[x]))
    out = F.lit(None).cast("int")
    for x in reversed(order):
        p = prefixes[x]
        out = F.when((names == p) | names.startswith(p + "/"), F.lit(x)).otherwise(out)
    return out


def violations(rule: Rule, nodes: DataFrame, edges: DataFrame, metrics: DataFrame) -> DataFrame:
    """The violations of one rule (F1 to F6). metrics: node_id, name, value."""
    if rule.type in ("metric-max", "metric-min"):
        at = metrics.where((F.col("name") == rule.metric) & F.col("value").isNotNull()).join(_shown(rule, nodes), F.col("node_id") == F.col("id"))
        over = F.col("value") > rule.limit if rule.type == "metric-max" else F.col("value") < rule.limit
        sign = " > " if rule.type == "metric-max" else " < "
        return _out(at.where(over), rule, F.col("id"), F.lit(None), F.col("value"), F.lit(rule.limit), F.concat(F.lit(f"{rule.metric} "), number(F.col("value")), F.lit(sign), number(F.lit(rule.limit))))
    if rule.type == "metric-product-max":
        factors = metrics.where(F.col("name").isin(*rule.metrics) & F.col("value").isNotNull()).groupBy("node_id").pivot("name", list(rule.metrics)).agg(F.first("value"))
        product = functools.reduce(lambda a, b: a * b, [F.col(f"`{m}`") for m in rule.metrics])
        at = factors.withColumn("value", product).where("value is not null").join(_shown(rule, nodes), F.col("node_id") == F.col("id"))
        return _out(at.where(F.col("value") > rule.limit), rule, F.col("id"), F.lit(None), F.col("value"), F.lit(rule.limit), F.concat(F.lit(" x ".join(rule.metrics) + " = "), number(F.col("value"))))
    structural = edges.where(F.col("kind").isin(*STRUCTURAL))
    src, dst = F.col("src").cast("string"), F.col("dst").cast("string")
    if rule.type == "layered-deps":
        a, b = owner_of(src, rule.layers), owner_of(dst, rule.layers)
        return _out(structural.where(a < b), rule, F.col("src"), F.col("dst"), F.lit(None), F.lit(None), F.concat(src, F.lit(" may not import the higher "), dst))
    if rule.type == "forbid-import":
        hit = matches_any(src, rule.source) & matches_any(dst, rule.target)
        return _out(structural.where(hit), rule, F.col("src"), F.col("dst"), F.lit(None), F.lit(None), F.concat(src, F.lit(" may not import "), dst))
    barrels = _shown(rule, nodes).where("role = 'barrel'").select("id", owner_of(F.col("id").cast("string"), rule.packages).alias("own"))
    ins = structural.select(F.col("dst").alias("id"), owner_of(src, rule.packages).alias("from"))
    outside = F.col("own").isNull() | F.col("from").isNull() | (F.col("own") != F.col("from"))
    lone = barrels.join(ins.withColumn("hit", F.lit(1)), "id", "left").groupBy("id").agg(F.sum(F.when(F.col("hit").isNotNull() & outside, 1).otherwise(0)).alias("n")).where("n = 0")
    return _out(lone, rule, F.col("id"), F.lit(None), F.lit(None), F.lit(None), F.lit("no importer outside its package"))


KEY = ["rule", "node", "dst"]


def run(rules: Sequence[Rule], nodes: DataFrame, edges: DataFrame, metrics: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Violations of all rules with origin new or carryover: the same key, whatever
    its value, is in the baseline (F7, J5)."""
    found = functools.reduce(DataFrame.unionByName, [violations(r, nodes, edges, metrics) for r in rules])
    if baseline is None:
        return found.withColumn("origin", F.lit("new"))
    known = baseline.select(F.col("rule").alias("r"), F.col("node").alias("n"), F.col("dst").alias("d")).distinct().withColumn("known", F.lit(True))
    at = found.join(known, (found["rule"] == known["r"]) & found["node"].eqNullSafe(known["n"]) & found["dst"].eqNullSafe(known["d"]), "left")
    return at.withColumn("origin", F.when(F.col("known"), "carryover").otherwise("new")).drop("r", "n", "d", "known")


def summary(found: DataFrame) -> DataFrame:
    """errors and warnings by origin, and whether the run passed."""
    def count(origin: str, severity: str) -> Column:
        return F.count(F.when((F.col("origin") == origin) & (F.col("severity") == severity), 1))

    out = found.agg(*(count(o, s).alias(f"{o}_{s}s") for o in ("new", "carryover") for s in ("error", "warning")))
    return out.withColumn("passed", F.col("new_errors") == 0)


def compare(now: DataFrame, before: DataFrame) -> DataFrame:
    """rule, node, dst, now, before, status: new, resolved, worsened, improved,
    unchanged by the change of value (U4). metric-min rules worsen downwards."""
    a = now.select(*KEY, F.col("value").alias("now"), F.col("limit").alias("l1"), F.lit(1).alias("in_now"))
    b = before.select(*(F.col(k).alias(f"b_{k}") for k in KEY), F.col("value").alias("before"), F.col("limit").alias("l2"), F.lit(1).alias("in_before"))
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in KEY])
    j = a.join(b, same, "full_outer")
    down = F.col("now") < F.col("l1")
    step = F.when(down, F.col("before") - F.col("now")).otherwise(F.col("now") - F.col("before"))
    status = F.when(F.col("in_before").isNull(), "new").when(F.col("in_now").isNull(), "resolved").when(step > 0, "worsened").when(step < 0, "improved").otherwise("unchanged")
    return j.select(*(F.coalesce(F.col(k), F.col(f"b_{k}")).alias(k) for k in KEY), "now", "before", status.alias("status"))


def compared_by_rule(compared: DataFrame) -> DataFrame:
    """Counts of each status by rule."""
    names = ["new", "resolved", "worsened", "improved", "unchanged"]
    return compared.groupBy("rule").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(s) for s in names))


def by_node(found: DataFrame) -> DataFrame:
    """node, errors, warnings, all_carried (M9)."""
    return found.groupBy("node").agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings"), F.min((F.col("origin") == "carryover").cast("int")).cast("boolean").alias("all_carried")
    )


def trend(compared: DataFrame) -> DataFrame:
    """node, trend: worsened beats improved."""
    rank = F.when(F.col("status") == "worsened", 2).when(F.col("status") == "improved", 1).otherwise(0)
    return compared.groupBy("node").agg(F.max(rank).alias("r")).select("node", F.when(F.col("r") == 2, "worsened").when(F.col("r") == 1, "improved").otherwise("steady").alias("trend"))


#: Rules for a repository without any.
DEFAULT_RULES: list[dict[str, Any]] = [
    dict(id=name, type=kind, excludeRoles=["fixture", "test"], max=most, **what)
    for name, kind, most, what in (
        ("file-size", TYPES[0], 350, {"metric": "loc"}), ("complexity", TYPES[0], 30, {"metric": "cyclomatic_max"}), ("nesting", TYPES[0], 5, {"metric": "max_nesting_depth"}),
        ("hot-and-complex", TYPES[2], 3000, {"metrics": ["cognitive_max", "churn_30d", "recency_30d"]}),
    )
]
