"""Style observations and profiles: distributions, confidence, clones, review voice.

Observations are type, category, value, file, seq (their order).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT = {"high": 1.0, "medium": 0.85, "low": 0.7}
ERROR, WARNING, INFO, REVIEW = 0.85, 0.6, 0.4, 0.6
_LEVELS = {
    "high": """naming(variables functions types constants files enums privateMembers) structure(import-group import-order export-style functionLength nestingDepth)
        controlFlow(guardClauses earlyReturn arrayMethods asyncAwait) errorHandling(tryCatchFrequency resultType exhaustiveSwitch assertNever) documentation(jsdocPresence)
        typeSystem(annotationDensity explicitReturn) formatting(indentStyle indentSize semicolons quoteStyle trailingCommas braceStyle trailingNewline) patterns(classVsFunctional)
        idiom(clone) complexity(functionLength nestingDepth cyclomatic)""",
    "low": """structure(moduleTopology fileOrganization) controlFlow(nullishCoalescing) errorHandling(errorBoundary) documentation(sectionComments voice whyVsWhat redundancy)
        typeSystem(genericUsage utilityTypes) formatting(defaultParams) patterns(pureFunctions) reviewVoice(tone themes values)""",
}
#: Stability by type; types that aren't listed are medium.
STABILITY = {f"{group}.{name}": level for level, spec in _LEVELS.items() for group, names in re.findall(r"([\w]+)\(([^)]*)\)", spec) for name in names.split()}


def stability(type_: Column, table: Mapping[str, str] | None = None) -> Column:
    """high, medium or low: the type's entry, else its category's, else medium."""
    t = F.create_map(*[F.lit(x) for kv in (table or STABILITY).items() for x in kv])
    return F.coalesce(t[type_], t[F.substring_index(type_, ".", 1)], F.lit("medium"))


def distribution(observations: DataFrame) -> DataFrame:
    """type, total, dominant (ties: first seen), consistency, counts."""
    per = observations.groupBy("type", "value").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return per.groupBy("type").agg(
        F.sum("n").alias("total"), F.max_by("value", F.struct("n", (-F.col("first")).alias("f"))).alias("dominant"), F.max("n").alias("top"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("value", "n")))).alias("counts"),
    ).withColumn("consistency", F.col("top") / F.col("total")).drop("top")


def features(distributions: DataFrame, table: Mapping[str, str] | None = None) -> DataFrame:
    """confidence = min(1, consistency x stability's weight) and severity."""
    weight = F.create_map(*[F.lit(x) for kv in WEIGHT.items() for x in kv])
    out = distributions.withColumn("stability", stability(F.col("type"), table)).withColumn("confidence", F.least(F.lit(1.0), F.col("consistency") * weight[F.col("stability")]))
    c = F.col("confidence")
    return out.withColumn("severity", F.when(c >= ERROR, "error").when(c >= WARNING, "warning").when(c >= INFO, "info").otherwise("off"))


def review_queue(features_: DataFrame) -> DataFrame:
    """Features to look at, least sure first."""
    return features_.where(F.col("confidence") < REVIEW).orderBy("confidence", "type")


def examples(observations: DataFrame, most: int = 5) -> DataFrame:
    """Every step-th observation of a type, step = floor(n / most), most at most."""
    w = Window.partitionBy("type")
    at = observations.withColumns({"n": F.count("*").over(w), "at": F.row_number().over(w.orderBy("seq")) - 1})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return at.where((F.col("at") % step == 0) & (F.col("at") / step < most)).drop("n", "at")


def clones(sources: DataFrame, lines: int = 3, clip: int = 200, least: int = 2) -> DataFrame:
    """fragment, frequency, files: runs of lines, white space collapsed, that begin
    at two places or more (A25, E19). sources: file, text."""
    rows = sources.select("file", F.split("text", "\n").alias("ls"))
    at = rows.where(F.size("ls") >= lines).select("file", F.explode(F.sequence(F.lit(1), F.size("ls") - lines + 1)).alias("line"), "ls")
    flat = F.trim(F.regexp_replace(F.array_join(F.slice("ls", F.col("line"), lines), " "), r"\s+", " "))
    fragments = at.select("file", "line", F.substring(flat, 1, clip).alias("fragment")).where("fragment != ''").distinct()
    return fragments.groupBy("fragment").agg(F.count("*").alias("frequency"), F.countDistinct("file").alias("files")).where(F.col("frequency") >= least)


def topics(comments: DataFrame, words: Mapping[str, Sequence[str]], examples_: int = 3) -> DataFrame:
    """topic, comments, share, examples: a comment counts once a topic.
    comments: id, body."""
    low = F.lower("body")
    hits = F.array_compact(F.array(*(F.when(low.rlike(r"\b(" + "|".join(ws) + r")\b"), F.lit(t)) for t, ws in words.items())))
    total = comments.agg(F.count("*").alias("all"))
    per = comments.select("id", F.explode(hits).alias("topic")).groupBy("topic").agg(F.count("*").alias("comments"), F.slice(F.sort_array(F.collect_list("id")), 1, examples_).alias("examples"))
    return per.crossJoin(F.broadcast(total)).select("topic", "comments", (F.col("comments") / F.col("all")).alias("share"), "examples")


def keywords(comments: DataFrame, words: Sequence[str]) -> DataFrame:
    """word, comments that use it."""
    low = F.lower("body")
    hits = F.array_compact(F.array(*(F.when(low.rlike(rf"\b{w}\b"), F.lit(w)) for w in words)))
    return comments.select(F.explode(hits).alias("word")).groupBy("word").agg(F.count("*").alias("comments"))


def against(observations: DataFrame, profile: DataFrame) -> DataFrame:
    """Observations beside the profile's rule of their type, and whether they agree."""
    return observations.join(profile.select("type", "convention", "confidence"), "type").withColumn("agrees", F.col("value") == F.col("convention"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """type, before, after, status of two profiles."""
    j = a.select("type", F.col("convention").alias("before"), F.col("confidence").alias("c1")).join(b.select("type", F.col("convention").alias("after"), F.col("confidence").alias("c2")), "type", "full_outer")
    same = F.col("before").eqNullSafe(F.col("after")) & F.col("c1").eqNullSafe(F.col("c2"))
    status = F.when(F.col("c1").isNull(), "added").when(F.col("c2").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return j.select("type", "before", "after", status.alias("status"))


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The rule of higher confidence; ties keep the existing one."""
    a = existing.select("type", F.struct("convention", "confidence").alias("a"))
    b = incoming.select("type", F.struct("convention", "confidence").alias("b"))
    better = F.col("a").isNull() | (F.col("b.confidence") > F.col("a.confidence"))
    x = F.when(better, F.col("b")).otherwise(F.col("a"))
    return a.join(b, "type", "full_outer").select("type", x["convention"].alias("convention"), x["confidence"].alias("confidence"))


def tier(confidence: Column) -> Column:
    """critical, strong, preferred (M6)."""
    return F.when(confidence >= ERROR, "critical").when(confidence >= WARNING, "strong").otherwise("preferred")


def top_rules(profile: DataFrame, k: int = 8) -> DataFrame:
    return profile.where(F.col("confidence") >= ERROR).orderBy(F.desc("confidence"), "type").limit(k)


def formatting(sources: DataFrame) -> DataFrame:
    """file, indent_style, indent_size, semicolons, quotes, trailing_commas,
    max_line from text alone (E17)."""
    ls = F.split("text", "\n")
    lead = F.filter(ls, lambda x: x.rlike(r"^[ \t]+\S"))
    tabs, spaces = F.size(F.filter(lead, lambda x: x.startswith("\t"))), F.filter(lead, lambda x: x.startswith(" "))
    widths = F.transform(spaces, lambda x: F.length(x) - F.length(F.ltrim(x)))
    size = F.when(F.size(F.filter(widths, lambda w: w % 4 != 0)) == 0, 4).when(F.size(F.filter(widths, lambda w: w % 2 != 0)) == 0, 2).otherwise(1)
    ends = F.size(F.filter(ls, lambda x: x.rlike(r";\s*$")))
    code = F.size(F.filter(ls, lambda x: x.rlike(r"[\w)\]'\"`;]\s*$")))
    single, double = F.regexp_count("text", F.lit("'[^'\n]*'")), F.regexp_count("text", F.lit('"[^"\n]*"'))
    commas, open_ends = F.regexp_count("text", F.lit(r",\s*\n\s*[\]})]")), F.regexp_count("text", F.lit(r"[^,\s]\s*\n\s*[\]})]"))
    return sources.select(
        "file",
        F.when(tabs + F.size(spaces) == 0, "none").when(tabs > F.size(spaces), "tabs").otherwise("spaces").alias("indent_style"),
        F.when(F.size(spaces) > 0, size).alias("indent_size"),
        F.when(code == 0, None).otherwise(ends / code >= 0.5).alias("semicolons"),
        F.when(single + double == 0, None).when(single > double, "single").otherwise("double").alias("quotes"),
        F.when(commas + open_ends == 0, None).otherwise(commas >= open_ends).alias("trailing_commas"),
        F.array_max(F.transform(ls, F.length)).alias("max_line"),
    )
