"""A token scanner of TypeScript and Python sources for code facts.

It knows tokens, brackets and blocks, not types; what needs a type checker isn't
attempted. Python sources go through the ast module.

A fact is (fact, name, kind, line, end_line, value, extra).
"""

from __future__ import annotations

import ast
import re
from collections import Counter
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<tpl>`(?:\\.|[^`\\])*`)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<num>\b\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*|\#[A-Za-z_$][\w$]*)
    |(?P<op>=>|\?\?=?|\?\.|&&=?|\|\|=?|\.\.\.|[=!]==?|[<>]=|[{}()\[\];,.<>:?=+\-*/%&|^!~@])""",
    re.S | re.X,
)
CONTROL = {"if", "for", "while", "switch", "catch", "with"}
LOOPS = {"for", "while", "do"}
SEARCH = {"find", "findIndex", "indexOf", "includes", "filter", "some", "every"}
LOOP_CALLS = {"forEach", "map", "filter", "reduce", "some", "every", "flatMap", "find"}
KEYWORDS = CONTROL | LOOPS | {"else", "return", "const", "let", "var", "function", "class", "new", "typeof", "import", "export", "from", "as", "default", "async", "await", "case", "break", "continue", "throw", "try", "finally", "in", "of", "this", "null", "undefined", "true", "false", "extends", "implements", "interface", "type", "enum", "static", "public", "private", "protected", "readonly", "super", "instanceof", "void", "delete", "yield", "get", "set", "declare", "abstract", "is", "keyof"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


@dataclass
class Block:
    kind: str
    name: str
    line: int
    start: int
    end: int = -1
    end_line: int = -1
    up: "Block | None" = None
    inner: list["Block"] = field(default_factory=list)
    params: list[str] = field(default_factory=list)


def tokens(text: str) -> tuple[list[Token], list[Token]]:
    """Tokens, and comments apart."""
    out, comments, line, at = [], [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", at, m.start())
        at = m.start()
        (comments if m.lastgroup == "comment" else out).append(Token(m.lastgroup, m.group(), line))
    return out, comments


def pairs(ts: list[Token]) -> dict[int, int]:
    """Matching brackets both ways; what isn't closed is left out."""
    out, stack = {}, []
    shut = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(ts):
        if t.kind != "op":
            continue
        if t.text in "([{":
            stack.append(i)
        elif t.text in shut:
            while stack and ts[stack[-1]].text != shut[t.text]:
                stack.pop()
            if stack:
                out[i] = stack.pop()
                out[out[i]] = i
    return out


def names_in(ts: list[Token], a: int, b: int) -> list[str]:
    """Parameter names between brackets at depth one."""
    out, depth, fresh = [], 0, True
    for t in ts[a + 1 : b]:
        if t.text in "([{<" and t.kind == "op":
            depth += 1
        elif t.text in ")]}>" and t.kind == "op":
            depth -= 1
        elif t.text == "," and depth <= 0:
            fresh = True
        elif t.kind == "id" and fresh and depth <= 0 and t.text not in {"public", "private", "protected", "readonly"}:
            out.append(t.text)
            fresh = False
    return out


def blocks(ts: list[Token]) -> list[Block]:
    """All blocks in order of their opening; the first is the file."""
    match = pairs(ts)
    top = Block("file", "", 1, -1, len(ts), ts[-1].line if ts else 1)
    every, stack = [top], [top]
    for i, t in enumerate(ts):
        if t.kind != "op":
            continue
        if t.text == "{" and i in match:
            b = opened(ts, match, i)
            b.up, b.end, b.end_line = stack[-1], match[i], ts[match[i]].line
            if b.kind == "method" and stack[-1].kind not in ("class", "object"):
                b.kind = "block"
            stack[-1].inner.append(b)
            every.append(b)
            stack.append(b)
        elif t.text == "}" and i in match and len(stack) > 1 and stack[-1].end == i:
            stack.pop()
    return every


def opened(ts: list[Token], match: dict[int, int], i: int) -> Block:
    p = i - 1
    line = ts[i].line
    prev = ts[p] if p >= 0 else None
    if prev is None:
        return Block("block", "", line, i)
    if prev.text == "=>":
        q = p - 1
        if q >= 0 and ts[q].text == ")" and q in match:
            a = match[q]
            params, start = names_in(ts, a, q), a
        else:
            params, start = [ts[q].text] if q >= 0 and ts[q].kind == "id" else [], q
        name = ""
        k = start - 1
        if k >= 0 and ts[k].text == "async":
            k -= 1
        if k >= 1 and ts[k].text in ("=", ":") and ts[k - 1].kind == "id":
            name = ts[k - 1].text
        return Block("function", name, ts[max(0, start)].line, i, params=params)
    # a return type stands between the brackets and the block
    q = p
    while q >= 0 and (ts[q].kind in ("id", "str", "num") or ts[q].text in (".", "<", ">", "[", "]", "|", "&", ",")) and ts[q].text not in KEYWORDS - {"void", "null", "undefined", "is", "typeof", "true", "false", "keyof"}:
        q -= 1
    if q >= 1 and ts[q].text == ":" and ts[q - 1].text == ")":
        p = q - 1
        prev = ts[p]
    if prev.text == ")" and p in match:
        a = match[p]
        k = a - 1
        while k >= 0 and ts[k].text == ">" :  # generics
            depth = 0
            while k >= 0:
                depth += ts[k].text == ">"
                depth -= ts[k].text == "<"
                k -= 1
                if not depth:
                    break
        head = ts[k] if k >= 0 else None
        if head is None:
            return Block("block", "", line, i)
        if head.text in CONTROL or (head.text == "await" and k and ts[k - 1].text == "for"):
            return Block("for" if head.text == "await" else head.text, "", head.line, i)
        if head.text == "function" or (k >= 1 and ts[k - 1].text in ("function", "*")):
            name = "" if head.text == "function" else head.text
            return Block("function", name, head.line, i, params=names_in(ts, a, p))
        if head.kind == "id" and head.text not in KEYWORDS - {"get", "set", "delete", "of", "from", "as", "is"}:
            return Block("method", head.text, head.line, i, params=names_in(ts, a, p))
        return Block("block", "", line, i)
    if prev.text in ("else", "try", "finally", "do", "catch"):
        return Block(prev.text, "", prev.line, i)
    k = p
    while k >= 0 and ts[k].text not in ("{", "}", ";", "(", ")", "="):
        if ts[k].text in ("class", "interface", "enum") and ts[k].kind == "id":
            named = k + 1 < len(ts) and ts[k + 1].kind == "id" and ts[k + 1].text not in ("extends", "implements")
            return Block(ts[k].text, ts[k + 1].text if named else "", ts[k].line, i)
        k -= 1
    return Block("object" if prev.text in ("=", "(", ",", ":", "[", "return", "?", "=>") else "block", "", line, i)


def of_function(b: Block) -> bool:
    return b.kind in ("function", "method")


def own_tokens(ts: list[Token], b: Block) -> list[tuple[int, Token]]:
    """Tokens of a function without those of functions in it."""
    skip = []
    todo = list(b.inner)
    while todo:
        x = todo.pop()
        if of_function(x):
            skip.append((x.start, x.end))
        else:
            todo += x.inner
    return [(i, ts[i]) for i in range(b.start + 1, b.end) if not any(s <= i <= e for s, e in skip)]


def depth_of(b: Block, stop: Block, kinds: set[str]) -> int:
    n = 0
    while b is not stop and b is not None:
        n += b.kind in kinds
        b = b.up
    return n


NESTING = {"if", "else", "for", "while", "do", "switch", "catch", "try"}


def complexity(ts: list[Token], b: Block) -> dict[str, int]:
    """cyclomatic, cognitive, nesting, loop_depth, recursive, search_in_loop,
    unreachable of one function."""
    own = own_tokens(ts, b)
    cyclo = 1 + sum(t.text in ("if", "for", "while", "case", "catch") and t.kind == "id" or t.text in ("&&", "||", "??") or (t.text == "?" and not (i + 1 < len(ts) and ts[i + 1].text in (":", ")", ","))) for i, t in own)
    under = []
    todo = [(x, 0) for x in b.inner]
    cognitive = 0
    while todo:
        x, level = todo.pop()
        if of_function(x):
            continue
        counted = x.kind in ("if", "for", "while", "do", "switch", "catch")
        chained = x.kind == "if" and x.start and _after_else(ts, x)
        if counted:
            cognitive += 1 if chained else 1 + level
        elif x.kind == "else":
            cognitive += 1
        under.append(x)
        todo += [(y, level + (counted and not chained) + (x.kind == "else")) for y in x.inner]
    last = None
    for _, t in own:  # a run of one logical operator counts once
        if t.text in ("&&", "||", "??"):
            cognitive += t.text != last
            last = t.text
        elif t.text in (";", "{", "}", ","):
            last = None
        elif t.text == "?" :
            cognitive += 1
    loops = [x for x in under if x.kind in LOOPS]
    body = set()
    for x in loops:
        body |= set(range(x.start, x.end))
    searched = sum(t.text in SEARCH and i in body and ts[i - 1].text in (".", "?.") and i + 1 < len(ts) and ts[i + 1].text == "(" for i, t in own)
    calls = sum(t.text == b.name and i + 1 < len(ts) and ts[i + 1].text == "(" and ts[i - 1].text not in (".", "function") for i, t in own) if b.name else 0
    dead = 0
    for i, t in own:
        if t.text in ("return", "throw", "break", "continue") and t.kind == "id":
            k, level = i + 1, 0
            while k < b.end and not (level == 0 and ts[k].text in (";", "}")):
                level += ts[k].text in "([{" and ts[k].kind == "op"
                level -= ts[k].text in ")]}" and ts[k].kind == "op"
                k += 1
            if k < b.end and ts[k].text == ";" and k + 1 <= b.end and ts[k + 1].text not in ("}", "case", "default", "function", "else") and _in_braces(ts, i):
                dead += 1
    return {
        "cyclomatic": cyclo, "cognitive": cognitive, "nesting": max((depth_of(x, b, NESTING) for x in under), default=0),
        "loop_depth": max((depth_of(x, b, LOOPS) for x in loops), default=0), "recursive": int(calls > 0), "search_in_loop": searched, "unreachable": dead,
    }


def _after_else(ts: list[Token], x: Block) -> bool:
    k = x.start
    while k >= 0 and ts[k].text != "if":
        k -= 1
    return k >= 1 and ts[k - 1].text == "else"


def _in_braces(ts: list[Token], i: int) -> bool:
    """Whether a statement begins its line of a block, not the body of a bare if."""
    return i > 0 and ts[i - 1].text in ("{", "}", ";", ":")


IMPORT = re.compile(r"""(?:^|[;\n])\s*(import|export)\s+(?:type\s+)?((?:[\w$*{},\s]|\bas\b)*?)\s*from\s*['"]([^'"]+)['"]|(?:^|[;\n])\s*import\s*['"]([^'"]+)['"]""")
DYNAMIC = re.compile(r"""(?:(?:const|let|var)\s*\{([^}]*)\}\s*=\s*(?:await\s+)?)?\b(?:import|require)\(\s*['"]([^'"]+)['"]\s*\)""")


def bindings(clause: str) -> list[str]:
    """Local names of an import or export clause."""
    out = [x.split(" as ")[-1].strip().removeprefix("type ") for x in re.sub(r"[^{]*\{|\}.*", "", clause, flags=re.S).split(",")] if "{" in clause else []
    head = clause.split("{")[0].rstrip(", \n")
    out += [x.split(" as ")[-1].strip() for x in head.split(",") if x.strip()]
    return [x for x in out if re.fullmatch(r"[\w$*]+", x or "")]


def typescript(text: str) -> list[tuple]:
    ts, comments = tokens(text)
    every = blocks(ts)
    facts: list[tuple] = []
    add = lambda fact, name, kind="", line=0, end=0, value=0.0, extra="": facts.append((fact, name, kind, line, end, float(value), extra))
    uses = Counter(t.text for t in ts if t.kind == "id")
    for m in IMPORT.finditer(text):
        line = text.count("\n", 0, m.start(3) if m.group(3) else m.start(4)) + 1
        names = bindings(m.group(2) or "")
        if m.group(1) == "export":
            add("edge", m.group(3), "re-exports", line, line, max(1, len(names)), ",".join(names))
        else:
            add("edge", m.group(3) or m.group(4), "imports", line, line, max(1, sum(uses[n] - 1 for n in names)), ",".join(names))
    for m in DYNAMIC.finditer(text):
        line = text.count("\n", 0, m.start()) + 1
        names = [x.split(":")[-1].strip() for x in (m.group(1) or "").split(",") if x.strip()]
        add("edge", m.group(2), "imports", line, line, max(1, sum(uses[n] - 1 for n in names)), ",".join(names))
    notes = {c.line + c.text.count("\n"): c.text for c in comments if c.text.startswith("/**")}
    source = text.split("\n")

    def symbol(name: str, kind: str, line: int, end: int) -> None:
        head = source[line - 1].strip() if line <= len(source) else ""
        note = notes.get(line - 1, "")
        purpose = re.sub(r"\s+", " ", re.sub(r"^/\*\*|\*/$|^\s*\*", "", note, flags=re.M)).strip()
        add("symbol", name, kind, line, end, head.startswith("export"), re.sub(r"\s*\{\s*$", "", head)[:200] + ("\x1f" + purpose if purpose else ""))

    totals: Counter[str] = Counter()
    most: Counter[str] = Counter()
    for b in every:
        if of_function(b) or b.kind in ("class", "interface", "enum"):
            top = b.up is not None and b.up.kind == "file"
            if top and b.name:
                symbol(b.name, b.kind, b.line, b.end_line)
        if b.kind == "class":
            totals["class_count"] += 1
            for x in b.inner:
                if x.kind == "method" and x.name != "constructor":
                    own = [ts[i + 2].text for i in range(x.start, x.end - 2) if ts[i].text == "this" and ts[i + 1].text == "."]
                    add("member", x.name, b.name, x.line, x.end_line, 0, ",".join(sorted(set(own))))
        if of_function(b):
            c = complexity(ts, b)
            totals["function_count"] += 1
            for k in ("cyclomatic", "cognitive"):
                totals[f"{k}_sum"] += c[k]
                most[f"{k}_max"] = max(most[f"{k}_max"], c[k])
                if b.name:
                    add("symbol_metric", b.name, f"symbol_{k}", b.line, b.end_line, c[k])
            most["max_nesting_depth"] = max(most["max_nesting_depth"], c["nesting"])
            most["loop_depth"] = max(most["loop_depth"], c["loop_depth"])
            totals["recursive_functions"] += c["recursive"]
            totals["search_in_loop"] += c["search_in_loop"]
            totals["unreachable_statements"] += c["unreachable"]
            local = Counter(t.text for t in ts[b.start : b.end] if t.kind == "id")
            spare = 0
            for p in reversed(b.params):  # only trailing ones can go
                if local[p] or p.startswith("_"):
                    break
                spare += 1
            totals["unused_params"] += spare
            for i, t in own_tokens(ts, b):
                if t.text in ("const", "let", "var") and i + 1 < len(ts) and ts[i + 1].kind == "id" and local[ts[i + 1].text] == 1 and not ts[i + 1].text.startswith("_"):
                    totals["unused_locals"] += 1
            name = "naming.private-member" if b.name.startswith(("_", "#")) and b.kind == "method" else "naming.function"
            if b.name and b.name != "constructor":
                add("observation", name, "naming", b.line, b.end_line, 0, b.name)
            for p in b.params:
                add("observation", "naming.parameter", "naming", b.line, b.line, 0, p)
            add("observation", "complexity.functionLength", "complexity", b.line, b.end_line, 0, str(b.end_line - b.line + 1))
            add("observation", "complexity.cyclomatic", "complexity", b.line, b.end_line, 0, str(c["cyclomatic"]))
            add("observation", "documentation.presence", "documentation", b.line, b.line, 0, str(b.line - 1 in notes).lower())
        elif b.kind in ("class", "interface", "enum") and b.name:
            add("observation", "naming.enum" if b.kind == "enum" else "naming.type", "naming", b.line, b.end_line, 0, b.name)
        elif b.kind in ("for", "while", "do"):
            add("observation", "control-flow.loops", "control-flow", b.line, b.end_line, 0, "for-of" if any(t.text == "of" for t in ts[b.start - 8 if b.start > 8 else 0 : b.start]) and b.kind == "for" else b.kind)
        elif b.kind == "if":
            body = [t.text for t in ts[b.start + 1 : b.end]]
            add("observation", "control-flow.branch", "control-flow", b.line, b.end_line, 0, "guard-clause" if body[:1] in (["return"], ["throw"], ["continue"]) else "if-else")
            if "return" in body[:1] and b.end + 1 < len(ts) and ts[b.end + 1].text == "else":
                add("observation", "control-flow.else-after-return", "control-flow", b.line, b.end_line, 0, "true")
        elif b.kind == "catch":
            add("observation", "error-handling.try-catch", "error-handling", b.line, b.end_line, 0, "empty" if b.end == b.start + 1 else "handled")
    for i, t in enumerate(ts[:-1]):
        n = ts[i + 1]
        if t.text in ("const", "let", "var") and t.kind == "id" and n.kind == "id":
            flag = i + 3 < len(ts) and ts[i + 3].text in ("true", "false")
            add("observation", "naming.boolean" if flag else "naming.constant" if t.text == "const" and n.text.upper() == n.text else "naming.variable", "naming", n.line, n.line, 0, n.text)
        elif t.text == "type" and n.kind == "id" and i + 2 < len(ts) and ts[i + 2].text in ("=", "<"):
            add("observation", "naming.type", "naming", n.line, n.line, 0, n.text)
            symbol(n.text, "type", n.line, n.line)
        elif t.text in (".", "?.") and n.text in ("then", "catch"):
            add("observation", "control-flow.async", "control-flow", n.line, n.line, 0, "promise-then")
        elif t.text == "await" and t.kind == "id":
            add("observation", "control-flow.async", "control-flow", t.line, t.line, 0, "async-await")
        elif t.text in (".", "?.") and n.text in LOOP_CALLS and i + 2 < len(ts) and ts[i + 2].text == "(":
            add("observation", "control-flow.loops", "control-flow", n.line, n.line, 0, "array-method")
        elif t.text == "throw" and n.text == "new" and i + 2 < len(ts):
            add("observation", "error-handling.custom-class", "error-handling", t.line, t.line, 0, "generic" if ts[i + 2].text == "Error" else "custom")
        elif t.text == "export":
            add("observation", "structure.export-style", "structure", t.line, t.line, 0, "default" if n.text == "default" else "named")
    flat = [t for t in ts if t.text == "?"]
    for t in flat:
        add("observation", "control-flow.ternary", "control-flow", t.line, t.line, 0, "ternary")
    for c in comments:
        if c.text.startswith("/**"):
            for tag in sorted(set(re.findall(r"@(\w+)", c.text))):
                add("observation", "documentation.tags", "documentation", c.line, c.line, 0, {"return": "returns", "arg": "param", "exception": "throws"}.get(tag, tag))
        elif c.text.startswith("//"):
            inline = source[c.line - 1].split("//")[0].strip() != ""
            add("observation", "documentation.comment-placement", "documentation", c.line, c.line, 0, "inline" if inline else "above")
    order = [("builtin" if f[1].startswith("node:") else "relative" if f[1].startswith(".") else "external") for f in facts if f[0] == "edge" and f[2] == "imports"]
    if len(order) > 1:
        rank = {"builtin": 0, "external": 1, "relative": 2}
        add("observation", "structure.import-order", "structure", 1, 1, 0, "grouped" if [rank[x] for x in order] == sorted(rank[x] for x in order) else "mixed")
    if ts:
        barrel = all(b.kind in ("file", "block", "object") for b in every) and any(f[2] == "re-exports" for f in facts)
        add("observation", "structure.barrel-file", "structure", 1, 1, 0, str(barrel).lower())
    _metrics(add, text, totals, most)
    return facts


def _metrics(add, text: str, totals: Counter, most: Counter) -> None:
    add("metric", "loc", "lines", value=sum(bool(x.strip()) for x in text.split("\n")))
    for k in ("function_count", "cyclomatic_sum", "cognitive_sum", "class_count"):
        add("metric", k, "count", value=totals[k])
    for k in ("cyclomatic_max", "cognitive_max", "max_nesting_depth"):
        add("metric", k, "count", value=most[k])
    for k in ("unreachable_statements", "unused_locals", "unused_params", "recursive_functions", "search_in_loop"):
        if totals[k]:
            add("metric", k, "count", value=totals[k])
    if most["loop_depth"] >= 2:
        add("metric", "loop_depth", "count", value=most["loop_depth"])


class _Python(ast.NodeVisitor):
    """Complexity of one Python function, without functions in it."""

    def __init__(self, fn: ast.AST):
        self.fn, self.cyclo, self.cognitive, self.nesting, self.loops, self.recursive, self.searched, self.dead = fn, 1, 0, 0, 0, 0, 0, 0
        self._body(fn.body, 0, 0)

    def _body(self, body: list[ast.stmt], level: int, loops: int) -> None:
        for k, s in enumerate(body):
            self._stmt(s, level, loops)
            if isinstance(s, ast.Return | ast.Raise | ast.Break | ast.Continue) and k + 1 < len(body):
                self.dead += 1
                for rest in body[k + 1 :]:
                    self._stmt(rest, level, loops)
                break

    def _stmt(self, s: ast.stmt, level: int, loops: int, chained: bool = False) -> None:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            return
        self.nesting, self.loops = max(self.nesting, level), max(self.loops, loops)
        bodies = [b for b in ("body", "orelse", "finalbody") if isinstance(getattr(s, b, None), list)]
        for child in ast.iter_child_nodes(s):
            if not isinstance(child, ast.stmt | ast.ExceptHandler | ast.match_case):
                self._expr(child, loops)
        loop = isinstance(s, ast.For | ast.AsyncFor | ast.While)
        if isinstance(s, ast.If) or loop:
            self.cyclo += 1
            self.cognitive += 1 if chained else 1 + level
        for h in getattr(s, "handlers", ()):
            self.cyclo += 1
            self.cognitive += 1 + level
            self.nesting = max(self.nesting, level + 1)
            self._body(h.body, level + 1, loops)
        for c in getattr(s, "cases", ()):
            self.cyclo += 1
            self._body(c.body, level + 1, loops)
        inside = level + (0 if isinstance(s, ast.With | ast.AsyncWith) else 1)
        for b in bodies:
            part = getattr(s, b)
            if b == "orelse" and isinstance(s, ast.If) and part:
                if len(part) == 1 and isinstance(part[0], ast.If):
                    self._stmt(part[0], level, loops, True)
                    continue
                self.cognitive += 1
            if part:
                self.nesting, self.loops = max(self.nesting, inside), max(self.loops, loops + loop)
                self._body(part, inside, loops + (loop and b == "body"))

    def _expr(self, e: ast.AST, loops: int) -> None:
        for x in ast.walk(e):
            if isinstance(x, ast.BoolOp):
                self.cyclo += len(x.values) - 1
                self.cognitive += 1
            elif isinstance(x, ast.IfExp | ast.comprehension):
                self.cyclo += 1
                self.cognitive += isinstance(x, ast.IfExp)
            elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id == self.fn.name:
                self.recursive = 1
            elif loops and isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("index", "count"):
                self.searched += 1


def python(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        tree = ast.Module([], [])
    facts: list[tuple] = []
    add = lambda fact, name, kind="", line=0, end=0, value=0.0, extra="": facts.append((fact, name, kind, line, end, float(value), extra))
    uses = Counter(x.id for x in ast.walk(tree) if isinstance(x, ast.Name))
    totals, most = Counter(), Counter()
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            for a in x.names:
                add("edge", a.name, "imports", x.lineno, x.end_lineno, max(1, uses[(a.asname or a.name).split(".")[0]]), a.asname or a.name)
        elif isinstance(x, ast.ImportFrom):
            names = [a.asname or a.name for a in x.names]
            add("edge", "." * x.level + (x.module or ""), "imports", x.lineno, x.end_lineno, max(1, sum(uses[n] for n in names)), ",".join(names))
        elif isinstance(x, functions):
            c = _Python(x)
            totals.update({"function_count": 1, "cyclomatic_sum": c.cyclo, "cognitive_sum": c.cognitive, "recursive_functions": c.recursive, "search_in_loop": c.searched, "unreachable_statements": c.dead})
            for k, v in (("cyclomatic_max", c.cyclo), ("cognitive_max", c.cognitive), ("max_nesting_depth", c.nesting), ("loop_depth", c.loops)):
                most[k] = max(most[k], v)
            add("symbol_metric", x.name, "symbol_cyclomatic", x.lineno, x.end_lineno, c.cyclo)
            add("symbol_metric", x.name, "symbol_cognitive", x.lineno, x.end_lineno, c.cognitive)
            inside = Counter(n.id for n in ast.walk(x) if isinstance(n, ast.Name))
            params = [a.arg for a in (*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs) if a.arg not in ("self", "cls")]
            for p in reversed(params):
                if inside[p] or p.startswith("_"):
                    break
                totals["unused_params"] += 1
            stored = Counter(n.id for n in ast.walk(x) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store))
            totals["unused_locals"] += sum(inside[n] == k and not n.startswith("_") for n, k in stored.items())
            add("observation", "naming.private-member" if x.name.startswith("_") else "naming.function", "naming", x.lineno, x.end_lineno, 0, x.name)
            for p in params:
                add("observation", "naming.parameter", "naming", x.lineno, x.lineno, 0, p)
            add("observation", "documentation.presence", "documentation", x.lineno, x.lineno, 0, str(bool(ast.get_docstring(x))).lower())
            add("observation", "complexity.functionLength", "complexity", x.lineno, x.end_lineno, 0, str(x.end_lineno - x.lineno + 1))
        elif isinstance(x, ast.ClassDef):
            totals["class_count"] += 1
            add("observation", "naming.type", "naming", x.lineno, x.end_lineno, 0, x.name)
            for m in x.body:
                if isinstance(m, functions) and m.name != "__init__":
                    own = {n.attr for n in ast.walk(m) if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self"}
                    add("member", m.name, x.name, m.lineno, m.end_lineno, 0, ",".join(sorted(own)))
        elif isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name):
            flag = isinstance(x.value, ast.Constant) and isinstance(x.value.value, bool)
            name = x.targets[0].id
            add("observation", "naming.boolean" if flag else "naming.constant" if name.upper() == name else "naming.variable", "naming", x.lineno, x.lineno, 0, name)
        elif isinstance(x, ast.ExceptHandler):
            add("observation", "error-handling.specificity", "error-handling", x.lineno, x.end_lineno, 0, "bare" if x.type is None else "specific")
        elif isinstance(x, ast.For | ast.While):
            add("observation", "control-flow.loops", "control-flow", x.lineno, x.end_lineno, 0, type(x).__name__.lower())
        elif isinstance(x, ast.IfExp):
            add("observation", "control-flow.ternary", "control-flow", x.lineno, x.lineno, 0, "ternary")
    for x in tree.body:
        if isinstance(x, (*functions, ast.ClassDef)):
            head = text.split("\n")[x.lineno - 1].strip().rstrip(":")
            doc = ast.get_docstring(x) or ""
            add("symbol", x.name, "class" if isinstance(x, ast.ClassDef) else "function", x.lineno, x.end_lineno, not x.name.startswith("_"), head[:200] + ("\x1f" + re.sub(r"\s+", " ", doc) if doc else ""))
    _metrics(add, text, totals, most)
    return facts


def facts(text: str | None, language: str | None) -> list[tuple]:
    if not text:
        return []
    return python(text) if language == "python" else typescript(text)
