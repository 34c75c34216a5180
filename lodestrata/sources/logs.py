"""Text and JSON sources: commit logs, renames, coverage, diagnostics, test runs.

Logs are read as lines in order; the order is the line's number in its file.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.functions.patterns import is_source, language_of


def lines_of(texts: DataFrame, text: str = "text", key: str = "log") -> DataFrame:
    """key, n, line of each text."""
    return texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "line"))


def renamed_to(path: Column) -> Column:
    """The new path of `a/{old => new}/b` or `old => new`."""
    braces = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    plain = F.regexp_replace(braces, r"^.* => ", "")
    return F.regexp_replace(plain, "//+", "/")


def parse_churn(lines: DataFrame, key: str = "log") -> DataFrame:
    """commit_id, author, epoch, file_id, added, deleted of numstat logs whose
    headers are `hash TAB email TAB epoch`; binary files count 0 (S6). A line that
    could be a row and a header is a row."""
    part = F.split("line", "\t")
    row = F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+")
    head = ~row & F.col("line").rlike(r"^[0-9a-f]{7,64}\t[^\t]*\t\d+$")
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.withColumns({"row": row, "h": F.last(F.when(head, F.col("line")), ignorenulls=True).over(order)})
    h = F.split("h", "\t")
    count = lambda i: F.when(part[i] == "-", 0).otherwise(part[i].cast("long")).cast("long")
    return at.where("row and h is not null").select(h[0].alias("commit_id"), h[1].alias("author"), h[2].cast("long").alias("epoch"), renamed_to(part[2]).alias("file_id"), count(0).alias("added"), count(1).alias("deleted"))


def first_seen(lines: DataFrame, key: str = "log") -> DataFrame:
    """file_id, epoch of the first commit in log order that names a path.
    Headers are `@epoch`."""
    order = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    epoch = F.when(F.col("line").rlike(r"^@\d+$"), F.substring("line", 2, 30).cast("long"))
    at = lines.withColumn("epoch", F.last(epoch, ignorenulls=True).over(order)).where(~F.col("line").rlike(r"^@\d+$") & (F.col("line") != "") & F.col("epoch").isNotNull())
    return at.groupBy(F.col("line").alias("file_id")).agg(F.min_by("epoch", "n").alias("epoch"))


def parse_renames(lines: DataFrame) -> DataFrame:
    """old_id, new_id, similarity of R lines of a name-status diff."""
    part = F.split("line", "\t")
    return lines.where(F.col("line").rlike(r"^R\d*\t[^\t]+\t[^\t]+$")).select(part[1].alias("old_id"), part[2].alias("new_id"), F.regexp_extract("line", r"^R(\d+)", 1).cast("int").alias("similarity"))


def git(repo: str, *args: str) -> str:
    """Output of git, without settings of an outer run."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True, env=env).stdout


def churn_of(spark: SparkSession, repo: str, days: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """The churn relation of a repository's history."""
    since = [] if days is None else [f"--since={days}.days.ago"]
    log = git(repo, "log", *since, *"-M --numstat --no-merges --pretty=%H%x09%ae%x09%ct".split())
    out = parse_churn(lines_of(spark.createDataFrame([(repo, log)], "log string, text string")))
    return out if known is None else out.join(known.select(F.col("id").alias("file_id")), "file_id", "left_semi")


def rename_aliases(spark: SparkSession, repo: str, before: str, after: str, similarity: int = 80) -> DataFrame:
    """old_id, new_id, reason between two commits."""
    out = git(repo, "diff", "--name-status", f"-M{similarity}%", before, after)
    return parse_renames(lines_of(spark.createDataFrame([(repo, out)], "log string, text string"))).select("old_id", "new_id", F.lit("rename").alias("reason"))


def source_files(spark: SparkSession, roots: Sequence[str], languages: Sequence[str] = ("javascript", "python", "typescript")) -> DataFrame:
    """path, language, text, content_hash of the source files under the roots,
    each once (S1, S2, S3)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    path = F.regexp_replace("path", "^file:/*", "/")
    text = F.col("content").cast("string")
    return raw.where(is_source(path, languages)).select(path.alias("path"), language_of(path).alias("language"), text.alias("text"), F.sha2(text, 256).alias("content_hash")).dropDuplicates(["path"])


FUNCTIONS = "map<string,struct<path:string,fnMap:map<string,struct<name:string,loc:struct<start:struct<line:int>,`end`:struct<line:int>>>>,f:map<string,long>>>"


def coverage_points(reports: DataFrame, text: str = "text") -> DataFrame:
    """file_id, line, hits of every function of a coverage report."""
    files = reports.select(F.explode(F.from_json(text, FUNCTIONS)).alias("file_id", "r"))
    fns = files.select("file_id", F.explode("r.fnMap").alias("fn", "at"), F.col("r.f").alias("f"))
    return fns.select("file_id", F.col("at.loc.start.line").alias("line"), F.coalesce(F.col("f")[F.col("fn")], F.lit(0)).alias("hits"))


def eslint_diagnostics(reports: DataFrame, text: str = "text") -> DataFrame:
    """file, line, rule, severity, message in one schema."""
    schema = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int>>>>"
    m = reports.select(F.explode(F.from_json(text, schema)).alias("r")).select(F.col("r.filePath").alias("file"), F.explode("r.messages").alias("m"))
    return m.select("file", "m.line", F.col("m.ruleId").alias("rule"), F.when(F.col("m.severity") == 2, "error").otherwise("warning").alias("severity"), "m.message")


def ruff_diagnostics(reports: DataFrame, text: str = "text") -> DataFrame:
    schema = "array<struct<filename:string,code:string,message:string,location:struct<row:int>>>"
    m = reports.select(F.explode(F.from_json(text, schema)).alias("m"))
    return m.select(F.col("m.filename").alias("file"), F.col("m.location.row").alias("line"), F.col("m.code").alias("rule"), F.lit("error").alias("severity"), "m.message")


def diagnostics_summary(found: DataFrame) -> DataFrame:
    """errors, warnings, exit_code (M8)."""
    return found.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warnings")).withColumn("exit_code", (F.col("errors") > 0).cast("int"))


def run_tests(reports: DataFrame, text: str = "text") -> DataFrame:
    """test, status of a test-run report; repeated names take the worst."""
    schema = "struct<testResults:array<struct<name:string,assertionResults:array<struct<fullName:string,status:string>>>>>"
    t = reports.select(F.explode(F.from_json(text, schema)["testResults"]).alias("f")).select(F.col("f.name").alias("file"), F.explode("f.assertionResults").alias("a"))
    return t.groupBy(F.concat_ws("::", "file", "a.fullName").alias("test")).agg(F.min("a.status").alias("status"))


CONFIG_KEYS = {"indent_style": "formatting.indent-style", "indent_size": "formatting.indent-size", "tabWidth": "formatting.indent-size", "useTabs": "formatting.use-tabs", "semi": "formatting.semicolons", "singleQuote": "formatting.single-quote", "trailingComma": "formatting.trailing-commas", "printWidth": "formatting.line-length", "max_line_length": "formatting.line-length"}


def config_observations(files: DataFrame) -> DataFrame:
    """type, value, file from .editorconfig and .prettierrc files: path, text."""
    table = F.create_map(*[F.lit(x) for kv in CONFIG_KEYS.items() for x in kv])
    json = files.where(F.col("path").endswith(".prettierrc")).select("path", F.explode(F.from_json("text", "map<string,string>")).alias("k", "value"))
    ini = files.where(F.col("path").endswith(".editorconfig")).select("path", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"^\s*[a-z_]+\s*=")).select("path", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.substring_index("line", "=", -1)).alias("value"))
    return json.unionByName(ini).withColumn("type", table[F.col("k")]).where("type is not null").select("type", "value", F.col("path").alias("file"))


def packages(paths: DataFrame, manifest: str = "package.json") -> DataFrame:
    """package: outermost folders with a manifest, the root's aside; without any,
    the top folders (S17)."""
    folders = paths.where(F.col("path").endswith("/" + manifest)).select(F.regexp_replace("path", f"/{re.escape(manifest)}$", "").alias("package")).distinct()
    inner = folders.alias("a").join(folders.alias("b"), F.col("a.package").startswith(F.concat(F.col("b.package"), F.lit("/"))), "left_anti")
    tops = paths.where(F.col("path").contains("/")).select(F.substring_index("path", "/", 1).alias("package")).distinct()
    none = inner.agg(F.count("*").alias("n"))
    return inner.select("package").unionByName(tops.crossJoin(F.broadcast(none)).where("n = 0").select("package"))


def bucket(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """id, package: the longest prefix that a path lies under (P14). Every prefix of
    a path is tried by an equality join, so no pair of file and package is formed
    that doesn't match."""
    parts = F.split(F.col("id").cast("string"), "/")
    tried = files.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("package"))
    hit = tried.join(prefixes.select("package").distinct(), "package").groupBy("id").agg(F.max_by("package", F.length("package")).alias("package"))
    return files.select("id").join(hit, "id", "left")


def assign_domains(files: DataFrame, domains: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """id, domain (the first that matches), overlaps (how many match)."""
    from lodestrata.functions.patterns import matches_any

    hits = F.array_compact(F.array(*(F.when(matches_any(F.col("id"), ps), F.lit(d)) for d, ps in domains)))
    return files.select("id", F.get(hits, F.lit(0)).alias("domain"), F.size(hits).alias("overlaps"))


def text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, str]]:
    for b in batches:
        yield from zip(b.column("path").to_pylist(), b.column("language").to_pylist(), b.column("text").to_pylist())
