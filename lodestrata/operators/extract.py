"""Code facts of source files as relations.

One pass of the scanner gives facts; the relations are views of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import patterns as P
from lodestrata.functions.scanner import facts as scan

FACT = pa.schema([("path", pa.string()), ("fact", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("value", pa.float64()), ("extra", pa.string()), ("seq", pa.int64())])
DDL = "path string, fact string, name string, kind string, line int, end_line int, value double, extra string, seq long"


def facts(sources: DataFrame, scanner: Callable[[str | None, str | None], list[tuple]] = scan) -> DataFrame:
    """All facts of sources (path, language, text); another scanner may be given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, language, text in zip(*(b.column(c).to_pylist() for c in ("path", "language", "text"))):
                rows += [(path, *f, k) for k, f in enumerate(scanner(text, language))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], FACT.field(c).type) for c in range(len(FACT))], schema=FACT)

    return sources.select("path", "language", "text").mapInArrow(run, DDL)


def nodes(sources: DataFrame, facts_: DataFrame) -> DataFrame:
    """File, module, external and symbol nodes."""
    path = F.col("path")
    empty = F.lit(None).cast("string")
    files = sources.select(path.alias("id"), F.lit("file").alias("kind"), path.alias("name"), P.module_of(path).alias("parent_id"), P.classify_role(path).alias("role"), empty.alias("signature"), empty.alias("purpose"))
    modules = sources.select(P.module_of(path).alias("id"), F.lit("module").alias("kind"), P.module_of(path).alias("name"), P.directory_of(path).alias("parent_id"), P.classify_role(path).alias("role"), empty.alias("signature"), empty.alias("purpose")).dropDuplicates(["id"])
    part = F.split("extra", "\x1f")
    syms = facts_.where("fact = 'symbol'").select(F.concat_ws("#", "path", "name").alias("id"), F.lit("symbol").alias("kind"), "name", path.alias("parent_id"), empty.alias("role"), P.one_line(part[0]).alias("signature"), F.get(part, F.lit(1)).alias("purpose")).dropDuplicates(["id"])
    ext = facts_.where("fact = 'edge' and not startswith(name, '.')").select(P.package_of_specifier(F.col("name")).alias("id"), F.lit("external").alias("kind"), F.col("name"), empty.alias("parent_id"), empty.alias("role"), empty.alias("signature"), empty.alias("purpose")).dropDuplicates(["id"])
    return files.unionByName(modules).unionByName(syms).unionByName(ext)


def edges(sources: DataFrame, facts_: DataFrame) -> DataFrame:
    """src, dst, kind, specifier, weight: relative specifiers resolved to files,
    others to externals; what doesn't resolve is dropped (E1, E2, E4, J17)."""
    from lodestrata.operators.incremental import resolve

    e = facts_.where("fact = 'edge'").select(F.col("path").alias("src"), F.col("name").alias("specifier"), "kind", F.col("value").alias("weight"))
    base = P.normalise(F.concat_ws("/", P.directory_of(F.col("src")), F.regexp_replace("specifier", r"\.[cm]?js$", "")))
    hit = resolve(e.where("startswith(specifier, '.')").select("src", "specifier", F.when(F.col("src").startswith("/"), F.concat(F.lit("/"), base)).otherwise(base).alias("base")).distinct(), sources.select(F.col("path").alias("id")))
    own = e.join(hit, ["src", "specifier"]).where("dst is not null")
    ext = e.where("not startswith(specifier, '.')").withColumn("dst", P.package_of_specifier(F.col("specifier")))
    return own.unionByName(ext).groupBy("src", "dst", "kind").agg(F.min("specifier").alias("specifier"), F.sum("weight").alias("weight"))


def references(sources: DataFrame, facts_: DataFrame) -> DataFrame:
    """importer, symbol: names that a file imports and their file declares."""
    e = facts_.where("fact = 'edge' and kind = 'imports' and startswith(name, '.')").select(F.col("path").alias("src"), F.col("name").alias("specifier"), F.explode(F.split("extra", ",")).alias("bound"))
    to = edges(sources, facts_).select("src", "specifier", "dst")
    declared = facts_.where("fact = 'symbol'").select(F.concat_ws("#", "path", "name").alias("symbol")).distinct()
    return e.join(to, ["src", "specifier"]).select(F.col("src").alias("importer"), F.concat_ws("#", "dst", "bound").alias("symbol")).join(declared, "symbol", "left_semi").distinct()


def origin(exports: DataFrame, hops: int = 20) -> DataFrame:
    """file, name, to_file, to_name: where a name comes from through re-exports
    (file, name, to_file, to_name; name * passes all names on); a cycle ends (G10)."""
    at = exports.where("name != '*'").select("file", "name", "to_file", "to_name", F.array(F.concat_ws("#", "file", "name")).alias("path"))
    step = exports.select(F.col("file").alias("to_file"), F.col("name").alias("n2"), F.col("to_file").alias("f3"), F.col("to_name").alias("n3"))
    for _ in range(hops):
        key = F.concat_ws("#", "to_file", "to_name")
        j = at.join(step, "to_file", "left").where(F.col("n2").isNull() | (F.col("n2") == F.col("to_name")) | (F.col("n2") == "*"))
        gone = at.join(j.select("file", "name").distinct(), ["file", "name"], "left_anti")
        more = F.col("f3").isNotNull() & ~F.array_contains("path", key)
        at = j.select("file", "name", F.when(more, F.col("f3")).otherwise(F.col("to_file")).alias("to_file"), F.when(more & (F.col("n2") != "*"), F.col("n3")).otherwise(F.col("to_name")).alias("to_name"), F.when(more, F.concat("path", F.array(key))).otherwise(F.col("path")).alias("path")).unionByName(gone)
        if j.where(more).isEmpty():
            break
    return at.select("file", "name", "to_file", "to_name").distinct()


def metrics(facts_: DataFrame) -> DataFrame:
    """node_id, name, value, unit of files and symbols."""
    f = facts_.where("fact = 'metric'").select(F.col("path").alias("node_id"), "name", "value", F.col("kind").alias("unit"))
    s = facts_.where("fact = 'symbol_metric'").groupBy(F.concat_ws("#", "path", "name").alias("node_id"), F.col("kind").alias("name")).agg(F.max("value").alias("value")).withColumn("unit", F.lit("count"))
    return f.unionByName(s)


def members(facts_: DataFrame) -> DataFrame:
    """file_id, class, method, uses for LCOM4."""
    return facts_.where("fact = 'member'").select(F.col("path").alias("file_id"), F.col("kind").alias("class"), F.col("name").alias("method"), F.filter(F.split("extra", ","), lambda x: x != "").alias("uses"))


def observations(facts_: DataFrame) -> DataFrame:
    """type, category, value, file, line, seq; names become their convention."""
    o = facts_.where("fact = 'observation'")
    value = F.when(F.col("name").startswith("naming."), P.convention(F.col("extra"))).otherwise(F.col("extra"))
    return o.select(F.col("name").alias("type"), F.col("kind").alias("category"), value.alias("value"), F.col("path").alias("file"), "line", "seq")
