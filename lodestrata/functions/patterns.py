"""Path patterns, roles, identities and names as Column expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_regex(pattern: str) -> str:
    """A glob as an anchored regex (** spans folders, * doesn't); text without
    a star is looked for anywhere (P1)."""
    if "*" not in pattern:
        return re.escape(pattern)
    return "^" + "".join({"**": ".*", "*": "[^/]*"}.get(p, re.escape(p)) for p in re.split(r"(\*\*|\*)", pattern)) + "$"


def matches_any(value: Column, patterns: Sequence[str]) -> Column:
    """Whether any of the patterns matches (P2); false without patterns."""
    value = value.cast("string")
    tests = [value.rlike(to_regex(p)) if "*" in p else value.contains(p) for p in patterns]
    return functools.reduce(lambda a, b: a | b, tests, F.lit(False))


#: Role by first match (P6); generated files and shebangs are told by hints.
ROLE_TESTS: dict[str, str] = {
    "test": r"(^|/)(tests?|__tests__)/|\.(spec|test)(\.[a-z]+)?$",
    "fixture": r"(^|/)fixtures(/|$)",
    "script": r"(^|/)(archive|scripts)(/|$)",
    "entry": "",
    "barrel": r"(^|/)index(\.[a-z]+)?$",
    "types": r"(?i)(^|/)([a-z][-\w]*[.])?types([.][a-z]+)?$",
    "config": r"\.config(\.[a-z]+)?$",
}


def classify_role(path: Column, shebang: Column | None = None, generated: Column | None = None) -> Column:
    """Generated beats all; a shebang comes after test, fixture and script."""
    out = F.lit("source")
    for role, rx in reversed(ROLE_TESTS.items()):
        hint = path.rlike(rx) if rx else shebang
        if hint is not None:
            out = F.when(hint, role).otherwise(out)
    return out if generated is None else F.when(generated, "generated").otherwise(out)


def annotate_role(kind: Column, role: Column, path: Column) -> Column:
    """The role of files and modules that have none yet."""
    return F.when(kind.isin("file", "module") & role.isNull(), classify_role(path)).otherwise(role)


EXCLUDED_DIRS = tuple(".claude .git .next __generated__ build coverage dist node_modules vendor".split())
EXCLUDED_SUFFIXES = (r"\.d\.ts$", r"\.map$", r"\.min\.[jt]sx?$", r"lock\.(yaml|json)$", r"yarn\.lock$")
LANGUAGES = dict(x.split(":") for x in "py:python js:javascript jsx:javascript ts:typescript tsx:typescript".split())


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ext]


def is_source(path: Column, languages: Sequence[str] = ("javascript", "python", "typescript")) -> Column:
    """Whether a walk takes the file in."""
    folder = r"(^|/)(" + "|".join(map(re.escape, EXCLUDED_DIRS)) + ")/"
    return ~path.rlike(folder) & ~path.rlike("|".join(EXCLUDED_SUFFIXES)) & F.coalesce(language_of(path).isin(*languages), F.lit(False))


def module_of(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[cm]?[jt]sx?$|\.py$", "")


def directory_of(path: Column) -> Column:
    """The folder of a path, "." at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def symbol_parts(symbol: Column) -> tuple[Column, Column]:
    """File and name of a symbol, split at the first #."""
    parts = F.split(symbol, "#", 2)
    return parts[0], parts[1]


def package_of_specifier(specifier: Column) -> Column:
    """npm:name or npm:@scope/name of an import; node: ones as they are."""
    name = F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    return F.when(specifier.startswith("node:"), specifier).otherwise(F.concat(F.lit("npm:"), name))


BUILTINS = ("assert", "buffer", "child_process", "crypto", "events", "fs", "http", "https", "net", "os", "path", "process", "stream", "url", "util", "worker_threads", "zlib")


def import_class(specifier: Column) -> Column:
    """builtin, relative, internal or external."""
    head = F.substring_index(specifier, "/", 1)
    return F.when(specifier.startswith("node:") | head.isin(*BUILTINS), "builtin").when(specifier.startswith("."), "relative").when(specifier.rlike(r"^(@/|~/|#)"), "internal").otherwise("external")


def normalise(path: Column) -> Column:
    """A path without . and .. parts."""
    def step(acc: Column, x: Column) -> Column:
        up = (x == "..") & (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when((x == ".") | (x == ""), acc).when(up, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


#: In the order they are tried; a word of capitals alone is PascalCase.
CONVENTIONS = {"camelCase": "[a-z][a-zA-Z0-9]*", "PascalCase": "[A-Z][a-zA-Z0-9]*", "snake_case": r"[a-z][a-z\d]*(_[a-z\d]+)+", "SCREAMING_SNAKE": r"[A-Z][A-Z\d]*(_[A-Z\d]+)+", "kebab-case": r"[a-z][a-z\d]*(-[a-z\d]+)+"}


def convention(name: Column) -> Column:
    """The naming convention of an identifier, null for none."""
    return F.coalesce(*(F.when(name.rlike(f"^{rx}$"), c) for c, rx in CONVENTIONS.items()))


def boolean_prefix(name: Column, python: bool = False) -> Column:
    return F.regexp_extract(name, "^(can|did|has|is|should|was|will)" + ("_" if python else "[A-Z_]"), 1)


def name_tokens(name: Column, least: int = 3) -> Column:
    """Distinct lower-case words of an identifier."""
    parts = F.split(F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(F.transform(parts, F.lower), lambda x: F.length(x) >= least))


def code_lines(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""))


def line_slice(text: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(F.split(text, "\n"), first, last - first + 1), "\n")


def one_line(text: Column, most: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def _old(spec: str) -> dict[str, str]:
    return {old: new for new, olds in (x.split("=") for x in spec.split()) for old in olds.split(",")}


#: Old spellings and what they are now (P10).
METRIC_ALIASES = _old("loc=lines,lines_of_code fan_in=fanin,fan-in fan_out=fanout,fan-out max_nesting_depth=max-nesting-depth,nesting_depth lcom4_max=lcom4")
ROLE_ALIASES = _old("test=spec,specs,tests barrel=barrels fixture=fixtures")
EDGE_ALIASES = _old("calls=call imports=import references=reference re-exports=re-export,reexports,re_exports depends-on=dependson,depends_on")


def healed(name: Column, aliases: dict[str, str] | None = None) -> Column:
    table = METRIC_ALIASES if aliases is None else aliases
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[name], name) if table else name


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """A vector of length 1; one of length 0 stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x / n))


def cosine(a: Column, b: Column) -> Column:
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(0.0)).otherwise(dot(a, b) / d)
