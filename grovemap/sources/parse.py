"""Parsers from source text to typed nodes and relationships, run as one pass over a table of files.

Python goes through the standard `ast`; JavaScript, TypeScript and C through a
tokenizer with matched brackets, which sees structure but not every detail of
the grammars.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemap.sources.languages import BY_EXTENSION

NODE = "struct<id:string,node_type:string,name:string,start_line:bigint,end_line:bigint>"
LINK = "struct<source:string,target:string,edge_type:string>"
SCHEMA = f"path string, language string, nodes array<{NODE}>, links array<{LINK}>, lines_of_code long, complexity long, functions long, classes long, imports long, exports long, error string"


@dataclass
class Parsed:
    """What a parser found in one file. Targets of imports are `import:<text>`, of calls `call:<name>`, until they are resolved."""

    path: str
    text: str
    nodes: list[tuple[str, str, str, int, int]] = field(default_factory=list)
    links: list[tuple[str, str, str]] = field(default_factory=list)
    lines: int = 0
    complexity: int = 0
    seen: dict[str, int] = field(default_factory=dict)

    def node(self, kind: str, name: str, start: int, end: int, parent: str | None, scope: str = "") -> str:
        """A node below its parent, with an id made unique by a number where one name occurs again."""
        base = f"{kind}:{self.path}" + (f":{scope}{name}" if kind != "file" else "")
        n = self.seen[base] = self.seen.get(base, 0) + 1
        key = base if n == 1 else f"{base}#{n}"
        self.nodes.append((key, kind, name, start, end))
        if parent:
            self.links.append((parent, key, "contains"))
        return key

    def count(self, *kinds: str) -> int:
        return sum(n[1] in kinds for n in self.nodes)


def file_node(out: Parsed) -> str:
    out.lines = len(out.text.splitlines())
    return out.node("file", out.path.rsplit("/", 1)[-1], 0, out.lines, None)


# --- Python


class _Python(ast.NodeVisitor):
    def __init__(self, out: Parsed, top: str):
        self.out, self.stack, self.top, self.names = out, [(top, "file", "")], top, {}

    def visit_ClassDef(self, n: ast.ClassDef) -> None:
        parent, _, scope = self.stack[-1]
        key = self.out.node("class", n.name, n.lineno, n.end_lineno or n.lineno, parent, scope)
        self.names[n.name] = key
        for b in n.bases:
            self.out.links.append((key, f"base:{ast.unparse(b)}", "extends"))
        self._inside(n.body, key, "class", f"{scope}{n.name}.")

    def _function(self, n: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        parent, kind, scope = self.stack[-1]
        own = "method" if kind == "class" or n.name == "__init__" else "function"
        key = self.out.node(own, n.name, n.lineno, n.end_lineno or n.lineno, parent, scope)
        calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(n) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
        self.out.links += [(key, f"call:{c}", "calls") for c in calls]
        self._inside(n.body, key, own, f"{scope}{n.name}.")

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _inside(self, body: list[ast.stmt], key: str, kind: str, scope: str) -> None:
        self.stack.append((key, kind, scope))
        for s in body:
            self.visit(s)
        self.stack.pop()

    def visit_Import(self, n: ast.Import) -> None:
        self.out.links += [(self.top, "import:" + a.name.replace(".", "/"), "imports") for a in n.names]

    def visit_ImportFrom(self, n: ast.ImportFrom) -> None:
        self.out.links.append((self.top, "import:" + "." * n.level + (n.module or "").replace(".", "/"), "imports"))

    def generic_visit(self, n: ast.AST) -> None:
        if isinstance(n, ast.If | ast.While | ast.For | ast.AsyncFor | ast.Try | ast.ExceptHandler):
            self.out.complexity += 1
        super().generic_visit(n)


def parse_python(out: Parsed) -> None:
    top = file_node(out)
    walk = _Python(out, top)
    for s in ast.parse(out.text).body:
        walk.visit(s)
    own = walk.names
    out.links = [(a, own[b[5:]], k) if b.startswith("base:") and b[5:] in own else (a, b, k) for a, b, k in out.links]


# --- JavaScript and TypeScript

_JS = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<id>[A-Za-z_$][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|[{}()\[\];,.:?=<>!&|+\-*/%@#~^])""", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%<>~^") | {"return", "typeof", "case", "in", "of", "=>", None}
_BRANCH = {"if", "while", "for", "do", "catch", "try", "case"}


@dataclass
class Token:
    text: str
    kind: str
    line: int


def tokens(text: str, regexes: bool) -> list[Token]:
    out, at, line = [], 0, 1
    while at < len(text):
        m = None
        if regexes and text[at] == "/" and text[at : at + 2] not in ("//", "/*") and (out[-1].text if out else None) in _BEFORE_REGEX:
            m = _REGEX.match(text, at)
        kind = "str" if m else ""
        m = m or _JS.match(text, at)
        if not m:
            line += text[at] == "\n"
            at += 1
            continue
        kind = kind or m.lastgroup
        if kind != "skip":
            out.append(Token(m.group(), kind, line))
        line += m.group().count("\n")
        at = m.end()
    return out


def brackets(ts: list[Token]) -> dict[int, int]:
    """Closing token of each opening one, and the other way round; unmatched ones end with the text."""
    out, stack = {}, []
    for i, t in enumerate(ts):
        if t.kind == "op" and t.text in "({[":
            stack.append(i)
        elif t.kind == "op" and t.text in ")}]" and stack:
            j = stack.pop()
            out[j], out[i] = i, j
    for j in stack:
        out[j] = len(ts) - 1
    return out


class _Script:
    def __init__(self, out: Parsed, typed: bool):
        self.out, self.typed = out, typed
        self.ts = tokens(out.text, True)
        self.pair = brackets(self.ts)
        self.top = file_node(out)
        self.names: dict[str, str] = {}
        self.bases: list[tuple[str, str, str]] = []
        self.calls: dict[str, set[str]] = {}
        self.walk(0, len(self.ts), self.top, False)
        for a, b, kind in self.bases:
            out.links.append((a, self.names.get(b, f"base:{b}"), kind))
        out.links += [(a, f"call:{c}", "calls") for a, cs in self.calls.items() for c in sorted(cs)]

    def text(self, i: int) -> str:
        return self.ts[i].text if 0 <= i < len(self.ts) else ""

    def line(self, i: int) -> int:
        return self.ts[max(0, min(i, len(self.ts) - 1))].line

    def until(self, i: int, stops: str) -> int:
        """The first token from i on among stops, outside brackets."""
        while i < len(self.ts):
            t = self.ts[i]
            if t.kind == "op" and t.text in stops:
                return i
            if t.kind == "op" and t.text in "({[":
                i = self.pair[i]
            elif t.kind == "op" and t.text in ")}]":
                return i
            i += 1
        return i

    def before(self, i: int) -> str:
        """Name of an anonymous function whose first token is i, by what stands before it."""
        p = i - 1
        if self.text(p) == "async":
            p -= 1
        t = self.text(p)
        if t == "=" and p > 0:
            q = p - 1
            parts = [self.text(q)]
            while self.text(q - 1) == ".":
                parts.insert(0, self.text(q - 2))
                q -= 2
            if parts[0].isidentifier() or len(parts) > 1:
                return ".".join(parts)
            back = q
            while back > 0 and self.text(back) not in ("const", "let", "var", ";", "{", "}"):
                back -= 1
            if self.text(back) in ("const", "let", "var"):
                return self.text(back + 1)
        if t == ":" and p > 0:
            return self.text(p - 1).strip("\"'`")
        if t == "default":
            return "default_export"
        if t == "return":
            return "returned"
        if t in ("(", ","):
            open_ = p
            while open_ >= 0 and not (self.text(open_) == "(" and self.pair.get(open_, -1) > i):
                open_ -= 1
            callee = self.text(open_ - 1)
            first = self.ts[open_ + 1] if open_ + 1 < len(self.ts) else None
            if callee in ("addEventListener", "on") and first is not None and first.kind == "str":
                return first.text.strip("\"'`") + "_handler"
            if callee and (callee.isidentifier()):
                return f"{callee}_callback"
        if t == "{" and self.text(p - 1) == "=":
            return f"{self.text(p - 2)}_handler"
        return f"anonymous_line_{self.line(i)}"

    def function(self, kind: str, name: str, first: int, params: int, parent: str, is_class: bool = False) -> int:
        """Node of a function whose parameter list opens at params; the token after its body."""
        i = self.pair.get(params, params) + 1
        if self.text(i) == ":":
            i = self.until(i + 1, "{;=,") if kind != "arrow" else i
        if self.text(i) == "=>":
            i += 1
        if self.text(i) == "{":
            last = self.pair.get(i, len(self.ts) - 1)
            body = (i + 1, last)
        else:
            last = self.until(i, ",;") - 1
            body = (i, last + 1)
        key = self.out.node("method" if kind == "method" else "function", name, self.line(first), self.line(last), parent)
        self.names.setdefault(name, key)
        self.walk(*body, key, False)
        return max(last + 1, params + 1)

    def walk(self, i: int, end: int, parent: str, in_class: bool) -> None:
        while i < end:
            t = self.ts[i]
            nxt = self.text(i + 1)
            if t.kind == "id" and self.text(i - 1) != ".":
                if t.text in _BRANCH:
                    self.out.complexity += 1
                if t.text == "import" and nxt not in ("(", "."):
                    stop = self.until(i + 1, ";")
                    j = next((k for k in range(i + 1, min(stop + 1, end)) if self.ts[k].kind == "str"), None)
                    if j is not None:
                        spec = self.ts[j].text.strip("\"'`")
                        self.out.node("import", spec, t.line, self.line(j), self.top)
                        self.out.links.append((self.top, f"import:{spec}", "imports"))
                        i = j + 1
                        continue
                if t.text == "export":
                    again = next((k for k in range(i + 1, min(i + 5, end)) if self.ts[k].kind == "id" and self.text(k) not in ("default", "async", "abstract", "const", "let", "var", "function", "class", "interface", "type", "enum", "declare")), None)
                    name = "default" if nxt == "default" else self.text(again) if again is not None else "*"
                    self.out.node("export", name, t.line, t.line, self.top)
                    if nxt in ("{", "*"):
                        j = self.pair[i + 1] + 1 if nxt == "{" else i + 2
                        if self.text(j) == "from" and j + 1 < end:
                            self.out.links.append((self.top, "import:" + self.text(j + 1).strip("\"'`"), "imports"))
                        i = max(j, i + 2)
                        continue
                    i += 1
                    continue
                if t.text == "class" and (nxt == "{" or (i + 1 < end and self.ts[i + 1].kind == "id")):
                    i = self.type_body("class", i, parent)
                    continue
                if self.typed and t.text in ("interface", "enum") and i + 1 < end and self.ts[i + 1].kind == "id":
                    i = self.type_body(t.text, i, parent)
                    continue
                if self.typed and t.text == "type" and i + 2 < end and self.ts[i + 1].kind == "id" and self.text(i + 2) in ("=", "<"):
                    stop = self.until(i + 2, ";")
                    self.names[nxt] = self.out.node("type", nxt, t.line, self.line(stop), parent)
                    i = stop + 1
                    continue
                if t.text == "function":
                    j = i + 1 + (nxt == "*")
                    name = self.text(j) if self.ts[min(j, len(self.ts) - 1)].kind == "id" and self.text(j) != "(" else self.before(i)
                    params = self.until(j, "(")
                    i = self.function("function", name, i, params, parent)
                    continue
                if t.text in ("const", "let", "var") and i + 1 < end and self.ts[i + 1].kind == "id":
                    k = self.until(i + 2, "=;,")
                    if self.text(k) != "=" or not self.is_function(k + 1):
                        self.out.node("variable", nxt, t.line, self.line(self.until(i + 1, ";") - 1), parent)
                    i += 2
                    continue
                if in_class and nxt in ("(", "<") and t.text not in ("if", "for", "while", "switch", "catch", "return"):
                    params = self.until(i + 1, "(")
                    after = self.pair.get(params, params) + 1
                    if self.text(after) == ":":
                        after = self.until(after + 1, "{;=")
                    if self.text(after) == "{":
                        i = self.function("method", t.text, i, params, parent)
                        continue
                if nxt == "(" and not in_class and t.text not in _BRANCH | {"switch", "return", "function", "super"}:
                    self.calls.setdefault(parent, set()).add(t.text)
                if nxt == "=>" or (t.text == "async" and nxt == "("):
                    first = i
                    if nxt == "=>":
                        i = self.arrow(first, i + 1, parent)
                        continue
            if t.kind == "op" and t.text == "(":
                sign = self.arrow_after(i)
                if sign:
                    i = self.arrow(i, sign, parent)
                    continue
            i += 1

    def arrow_after(self, i: int) -> int:
        """The arrow that follows the parameter list opened at i, perhaps after a result type; 0 without one."""
        after = self.pair.get(i, i) + 1
        if self.text(after) == "=>":
            return after
        if self.typed and self.text(after) == ":" and self.text(i - 1) != "?":
            for k in range(after + 1, min(after + 24, len(self.ts))):
                if self.text(k) == "=>":
                    return k
                if self.text(k) in ("{", ";", ",", "=", ")"):
                    return 0
        return 0

    def is_function(self, i: int) -> bool:
        if self.text(i) == "async":
            i += 1
        if self.text(i) == "function" or self.text(i + 1) == "=>":
            return True
        return self.text(i) == "(" and self.arrow_after(i) > 0

    def arrow(self, first: int, sign: int, parent: str) -> int:
        i = sign + 1
        if self.text(i) == "{":
            last = self.pair.get(i, len(self.ts) - 1)
            body = (i + 1, last)
        else:
            last = self.until(i, ",;") - 1
            body = (i, last + 1)
        name = self.before(first)
        key = self.out.node("function", name, self.line(first), self.line(last), parent)
        self.names.setdefault(name, key)
        self.walk(*body, key, False)
        return max(last + 1, sign + 1)

    def type_body(self, kind: str, i: int, parent: str) -> int:
        named = self.text(i + 1) not in ("{", "extends")
        name = self.text(i + 1) if named else "AnonymousClass"
        open_ = self.until(i + 1 + named, "{")
        close = self.pair.get(open_, len(self.ts) - 1)
        key = self.out.node(kind, name, self.line(i), self.line(close), parent)
        self.names[name] = key
        mode = None
        for k in range(i + 1, min(open_, len(self.ts))):
            t = self.ts[k]
            if t.text in ("extends", "implements"):
                mode = t.text
            elif mode and t.kind == "id" and self.text(k - 1) in ("extends", "implements", ","):
                self.bases.append((key, t.text, mode))
        if kind == "class":
            self.walk(open_ + 1, close, key, True)
        return close + 1


# --- C

_C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "do", "else", "case", "defined"}


def parse_c(out: Parsed) -> None:
    top = file_node(out)
    bare = re.sub(r"/\*.*?\*/", lambda m: "\n" * m.group().count("\n"), out.text, flags=re.S)
    bare = re.sub(r"//[^\n]*", "", bare)
    out.lines = sum(1 for x in bare.splitlines() if x.strip())
    for n, row in enumerate(bare.splitlines(), 1):
        if m := re.match(r'\s*#\s*include\s*([<"])([^>"]+)[>"]', row):
            out.node("import", m.group(2), n, n, top)
            out.links.append((top, f"import:{m.group(2)}", "imports"))
        elif m := re.match(r"\s*#\s*define\s+(\w+)", row):
            out.node("variable", m.group(1), n, n, top)
    code = re.sub(r"^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: "\n" * m.group().count("\n"), bare, flags=re.M)
    ts = tokens(code, False)
    pair = brackets(ts)
    text = lambda k: ts[k].text if 0 <= k < len(ts) else ""
    i, start = 0, 0
    while i < len(ts):
        t = ts[i]
        if t.text == ";":
            if text(start) == "typedef" and ts[i - 1].kind == "id":
                out.node("class", text(i - 1), ts[start].line, t.line, top)
            elif i > start + 1 and text(start) not in ("struct", "enum", "union", "typedef", "extern") or (i > start + 2 and text(start) in ("struct", "static") and ts[i - 1].kind == "id"):
                name = next((text(k) for k in range(start + 1, i) if ts[k].kind == "id" and text(k + 1) in ("=", ";", "[", ",")), None)
                if name:
                    out.node("variable", name, ts[start].line, t.line, top)
            start = i + 1
        elif t.text in ("struct", "enum", "union") and ts[i + 1 : i + 2] and ts[i + 1].kind == "id" and text(i + 2) == "{":
            close = pair[i + 2]
            out.node("module" if t.text == "enum" else "class", text(i + 1), t.line, ts[close].line, top)
            i = close
        elif t.text in ("struct", "enum", "union") and text(i + 1) == "{":
            i = pair[i + 1]
        elif t.kind == "id" and text(i + 1) == "(" and i > start and t.text not in _C_WORDS:
            close = pair[i + 1]
            if text(close + 1) == "{":
                last = pair[close + 1]
                key = out.node("function", t.text, ts[start].line, ts[last].line, top)
                body = range(close + 2, last)
                out.links += [(key, f"call:{c}", "calls") for c in sorted({text(k) for k in body if ts[k].kind == "id" and text(k + 1) == "(" and text(k) not in _C_WORDS})]
                out.complexity += sum(text(k) in ("if", "for", "while", "case") for k in body)
                i, start = last, last + 1
            elif text(close + 1) == ";":
                out.node("function", f"{t.text} (declaration)", ts[start].line, ts[close].line, top)
                i, start = close + 1, close + 2
            else:
                i = close
        elif t.text == "{":
            i = pair[i]
        i += 1


PARSERS = {"python": parse_python, "javascript": lambda out: _Script(out, False), "typescript": lambda out: _Script(out, True), "c": parse_c}


def parse(path: str, text: str) -> Parsed:
    """Nodes and links of one file; a ValueError for other languages, a SyntaxError for Python that doesn't compile."""
    language = BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower())
    if language is None:
        raise ValueError(f"no parser for {path}")
    out = Parsed(path, text)
    PARSERS[language](out)
    return out


def parse_files(sources: DataFrame) -> DataFrame:
    """One row (SCHEMA) for each of sources (path, content); files that can't be read or parsed have an error, and no node."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text in zip(batch["path"], batch["content"]):
                try:
                    if text is None:
                        raise ValueError("not UTF-8 text")
                    p = parse(path, text)
                    imports = sum(k == "imports" for _, _, k in p.links)
                    rows.append((path, BY_EXTENSION.get(path.rsplit(".", 1)[-1].lower()), [dict(zip(("id", "node_type", "name", "start_line", "end_line"), n)) for n in p.nodes], [dict(zip(("source", "target", "edge_type"), x)) for x in p.links], p.lines, p.complexity, p.count("function", "method"), p.count("class"), imports, p.count("export"), None))
                except (ValueError, SyntaxError, RecursionError, IndexError, KeyError) as e:
                    rows.append((path, None, [], [], 0, 0, 0, 0, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "language", "nodes", "links", "lines_of_code", "complexity", "functions", "classes", "imports", "exports", "error"])

    return sources.select("path", F.col("content")).mapInPandas(run, SCHEMA)
