from collections import Counter

import pytest
from grovemap.operators import filetree, graph
from grovemap.plans import queries
from grovemap.sources import files
from grovemap.sources.parse import parse, parse_files
from grovemap.streaming.degree import running_degrees

PY = '''
import os.path as p
from .util import helper

class Base:
    def __init__(self):
        self.x = 1

class Child(Base):
    async def run(self):
        if self.x:
            helper()

def outer():
    def inner():
        return 1
    return inner()
'''
TS = '''
import { help } from "./util/helper";
import React from 'react';
export interface Shape extends Base { area(): number; }
type Id = string | number;
enum Color { Red, Green }
export class Box extends Base implements Shape {
  private size = 1; // "{"
  area(): number { return this.size; }
}
const twice = (x: number): number => x * 2;
button.addEventListener("click", () => { help(1); });
items.map(function (i) { return /[{"]/.test(i); });
'''
C = '''#include <stdio.h>
#include "my.h"
#define LIMIT 3
/* struct Not { int x; }; */
struct Point { int x; };
enum Color { RED };
int count = 3;
int add(int a, int b);
static int add(int a, int b) {
    if (a) return b;
    return twice(a) + b;
}
int main() { printf("{"); return add(1, 2); }
'''


def kinds(p):
    return {k: sorted(n[2] for n in p.nodes if n[1] == k) for k in {n[1] for n in p.nodes}}


def test_python():
    p = parse("pkg/a.py", PY)
    assert kinds(p) == {"file": ["a.py"], "class": ["Base", "Child"], "method": ["__init__", "run"], "function": ["inner", "outer"]}
    assert Counter(k for *_, k in p.links)["contains"] == 6
    assert ("class:pkg/a.py:Child", "class:pkg/a.py:Base", "extends") in p.links
    assert {b for _, b, k in p.links if k == "imports"} == {"import:os/path", "import:.util"}
    assert p.complexity == 1
    with pytest.raises(SyntaxError):
        parse("a.py", "def (")


def test_typescript():
    p = parse("src/a.ts", TS)
    k = kinds(p)
    assert (k["interface"], k["type"], k["enum"], k["class"], k["method"]) == (["Shape"], ["Id"], ["Color"], ["Box"], ["area"])
    assert k["function"] == ["click_handler", "map_callback", "twice"]
    assert {b for _, b, t in p.links if t == "imports"} == {"import:./util/helper", "import:react"}
    box = next(n[0] for n in p.nodes if n[2] == "Box" and n[1] == "class")
    assert {(b, t) for a, b, t in p.links if a == box and t in ("extends", "implements")} == {("base:Base", "extends"), (next(n[0] for n in p.nodes if n[2] == "Shape" and n[1] == "interface"), "implements")}


def test_c():
    p = parse("a.c", C)
    k = kinds(p)
    assert (k["import"], k["class"], k["module"]) == (["my.h", "stdio.h"], ["Point"], ["Color"])
    assert k["function"] == ["add", "add (declaration)", "main"] and k["variable"] == ["LIMIT", "count"]
    assert {b for a, b, t in p.links if t == "calls" and a == "function:a.c:main"} == {"call:add", "call:printf"}
    assert p.lines == 12


@pytest.mark.parametrize("text", ["", "{", "}", "((((", "'", "`", "/*", "class", "import", "export default", "const", "x =>", "function", "a ? b : (c) => d", "\x00�", "type X ="])
def test_parsers_survive_scraps(text):
    for name in ("a.js", "a.ts", "a.c"):
        assert parse(name, text).nodes[0][1] == "file"


@pytest.fixture()
def tree(tmp_path):
    for path, text in {
        "src/main.ts": 'import { h } from "./utils/helper";\nimport { B } from "./components/Button";\nimport c from "./config";\nimport axios from "axios";\nimport m from "./pack";\nexport function start() { h(); }\n',
        "src/utils/helper.ts": "export function h() { return 1; }\n", "src/components/Button.tsx": "export const B = () => null;\n", "src/config/index.ts": "export default {};\n", "src/pack/lib/entry.js": "export const m = 1;\n",
        "src/pack/package.json": '{"main": "./lib/entry"}', "py/a.py": "from pkg.b import f\n\ndef g():\n    return f()\n", "py/pkg/b.py": "def f():\n    return 2\n", "c/a.c": '#include "inc/x.h"\nint main() { return 0; }\n', "c/inc/x.h": "int y;\n", "bad.py": "def (", "node_modules/x.js": "var a = 1;\n", "notes.md": "# no\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "latin.py").write_bytes(b"x = '\xff'\n")
    return tmp_path


def test_scan_and_graph(spark, tree):
    sources = files.scan(spark, str(tree), ["node_modules/", "# note", "*.tmp"])
    assert {r["path"] for r in sources.collect()} == {"src/main.ts", "src/utils/helper.ts", "src/components/Button.tsx", "src/config/index.ts", "src/pack/lib/entry.js", "py/a.py", "py/pkg/b.py", "c/a.c", "c/inc/x.h", "bad.py", "latin.py"}
    parsed = parse_files(sources)
    assert {r["path"] for r in parsed.filter("error IS NOT NULL").collect()} == {"bad.py", "latin.py"}
    mains = files.package_mains(spark.createDataFrame([("src/pack/package.json", '{"main": "./lib/entry"}')], "path string, content string"))
    g = files.to_graph(parsed, mains)
    links = {(r["src_id"], r["dst_id"]) for r in graph.triplets(g).filter("edge_type = 'imports'").collect()}
    assert links == {("file:src/main.ts", f"file:src/{t}") for t in ("utils/helper.ts", "components/Button.tsx", "config/index.ts", "pack/lib/entry.js")} | {("file:py/a.py", "file:py/pkg/b.py"), ("file:c/a.c", "file:c/inc/x.h")}
    calls = {(r["src_id"], r["dst_id"]) for r in graph.triplets(g).filter("edge_type = 'calls'").collect()}
    assert calls == {("function:src/main.ts:start", "function:src/utils/helper.ts:h"), ("function:py/a.py:g", "function:py/pkg/b.py:f")}
    assert g.nodes.select("ix").distinct().count() == g.nodes.count()


def test_ignore_patterns():
    import re

    hit = lambda line, path: bool(re.match(files.ignore_pattern(line)[0], path))
    assert hit("*.js", "a/b.js") and not hit("*.js", "a/b.ts") and hit("build/", "x/build/") and not hit("build/", "x/build.js") and not hit("build/", "build")
    assert hit("/a/*.js", "a/b.js") and not hit("/a/*.js", "c/a/b.js") and hit("a/**/z.js", "a/b/c/z.js") and hit("a/**/z.js", "a/z.js")
    assert hit("x[0-9].c", "x3.c") and hit("x[!0-9].c", "xa.c") and not hit("x[!0-9].c", "x3.c") and hit(r"\#a.c", "#a.c") and hit("gen?", "gen1/")
    assert files.ignore_pattern("!x")[1] and not files.ignore_pattern("x")[1] and files.ignore_pattern("# x") is None and files.ignore_pattern("  ") is None


def test_ignore_files_of_the_tree(tmp_path):
    for path, text in {
        ".gitignore": "*.gen.py\n/out/\nnode_modules\n!keep.gen.py\n", "a.py": "", "x.gen.py": "", "keep.gen.py": "", "out/b.py": "", "sub/out/c.py": "", "node_modules/d.js": "", "pkg/__init__.py": "", "pkg/.hidden.js": "",
        "sub/.gitignore": "*.c\n!x.gen.py\n/only.ts", "sub/e.c": "", "sub/deep/f.c": "", "f.c": "", "sub/x.gen.py": "", "sub/only.ts": "", "sub/deep/only.ts": "", ".git/g.py": "", "README": "", "c": "",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    want = {"a.py", "keep.gen.py", "sub/out/c.py", "pkg/__init__.py", "pkg/.hidden.js", "f.c", "sub/x.gen.py", "sub/deep/only.ts"}
    assert set(files.listed(str(tmp_path))) == want
    assert set(files.listed(f"file://{tmp_path}", ["pkg/"])) == want - {"pkg/__init__.py", "pkg/.hidden.js"}


def test_file_tree(spark):
    paths = spark.createDataFrame([("src/b/x.ts",), ("src/a.ts",), ("src/B.ts",), ("top.ts",), ("src/a.ts",)], "path string")
    rows = filetree.tree(paths)
    assert [r["path"] for r in filetree.ordered(rows).collect()] == ["src", "top.ts", "src/b", "src/a.ts", "src/B.ts", "src/b/x.ts"]
    assert {r["path"] for r in filetree.search(rows, "X.T").collect()} == {"src", "src/b", "src/b/x.ts"}
    assert filetree.common_base(paths.filter("path like 'src%'")).first()[0] == "src"
    assert filetree.common_base(spark.createDataFrame([("a/b.ts",)], "path string")).first()[0] == "a"
    assert filetree.common_base(paths).first()[0] == "" and filetree.common_base(paths.limit(0)).first()[0] == ""


def test_running_degrees(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, 10), (1, 3, 20), (2, 2, 30)], "src long, dst long, t int").selectExpr("src", "dst", "timestamp_seconds(t) AS ts")
    edges.write.parquet(f"{tmp_path}/in")
    stream = running_degrees(spark.readStream.schema(edges.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("running").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r) for r in spark.table("running").collect()) == [(1, 0, 2), (2, 2, 1), (3, 1, 0)]


def test_palette(spark):
    rows = spark.createDataFrame([("Open file", "File", "ctrl+o"), ("Zoom in", "View", None)], "label string, category string, shortcut string")
    assert [r["label"] for r in graph.palette_filter(rows, "VIEW").collect()] == ["Zoom in"]


def test_queries_have_sql_for_known_names():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
