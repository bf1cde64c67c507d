"""A small source tree as a table, the queries of scan, parsers and import resolution over it, and their SQL."""

from __future__ import annotations

from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.cluster import scratch
from grovemap.operators import graph
from grovemap.sources import files
from grovemap.sources.parse import parse_files

TREE = {
    ".gitignore": "build/\n*.min.js\n!kept.min.js\n",
    "app/main.ts": "import { load } from './lib/load';\nimport { Panel } from \"./views/Panel\";\nimport cfg from '../config';\nimport axios from 'axios';\n\nexport function start(n: number): void {\n  if (n > 1) {\n    load(n);\n  }\n}\n",
    "app/lib/load.ts": "export function load(n: number) {\n  return retry(() => n);\n}\nconst retry = (f: () => number) => f();\n",
    "app/views/Panel.tsx": "import { load } from '../lib/load';\nexport class Panel extends Base implements View {\n  draw(): void {\n    load(1);\n  }\n}\nexport class Base {}\ninterface View { draw(): void; }\n",
    "config/index.js": "const mode = process.env.MODE ? 'a' : 'b';\nmodule.exports = { mode };\n",
    "build/out.js": "var generated = 1;\n",
    "lib.min.js": "var a = 1;\n",
    "kept.min.js": "function kept() { return 1; }\n",
    "py/shape.py": "from . import util\nfrom .util import area\n\n\nclass Shape:\n    def __init__(self, w):\n        self.w = w\n\n\nclass Square(Shape):\n    def size(self):\n        for _ in range(2):\n            if self.w:\n                return area(self.w)\n        return 0\n",
    "py/util.py": "import os\n\n\ndef area(w):\n    try:\n        return w * w\n    except TypeError:\n        return 0\n",
    "py/__init__.py": "",
    "c/main.c": "#include <stdio.h>\n#include \"geo/point.h\"\n\n#define SCALE 2\n\nint twice(int x) {\n    return SCALE * x;\n}\n\nint main(void) {\n    while (0) { }\n    return twice(3) + norm(1);\n}\n",
    "c/geo/point.h": "struct Point { int x; int y; };\nenum Axis { X, Y };\nint norm(int v);\n",
    "notes/read.txt": "no code\n",
}
CODE = sorted(set(TREE) - {".gitignore", "build/out.js", "lib.min.js", "notes/read.txt"})


def tree(spark: SparkSession) -> DataFrame:
    """(path, content) of TREE's files with code."""
    return spark.createDataFrame([(p, TREE[p]) for p in CODE], "path string, content string")


def scan_tree(spark: SparkSession, _: str) -> DataFrame:
    """The tree written to the shared folder and scanned from there."""
    root = scratch(spark, "tree")
    system, base = FileSystem.from_uri(root)
    for path, text in TREE.items():
        system.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
        with system.open_output_stream(f"{base}/{path}") as f:
            f.write(text.encode())
    return files.scan(spark, root)


def _parsed(spark: SparkSession) -> DataFrame:
    return parse_files(tree(spark))


def parse_metrics(spark: SparkSession, _: str) -> DataFrame:
    return _parsed(spark).select("path", "language", "lines_of_code", "complexity", "functions", "classes", "imports", "exports")


def parse_nodes(spark: SparkSession, _: str) -> DataFrame:
    return _parsed(spark).select("path", F.explode("nodes").alias("n")).select("path", "n.node_type", "n.name", "n.start_line", "n.end_line")


def parse_calls(spark: SparkSession, _: str) -> DataFrame:
    return _parsed(spark).select("path", F.explode("links").alias("l")).filter("l.edge_type = 'calls'").select("path", F.regexp_replace("l.source", "^.*:", "").alias("caller"), F.regexp_replace("l.target", "^call:", "").alias("callee"))


def parse_imports(spark: SparkSession, _: str) -> DataFrame:
    return _parsed(spark).select("path", F.explode("links").alias("l")).filter("l.edge_type = 'imports'").select("path", F.regexp_replace("l.target", "^import:", "").alias("spec"))


def resolved_imports(spark: SparkSession, _: str) -> DataFrame:
    rows = parse_imports(spark, _).filter("path LIKE 'app/%'").withColumnRenamed("path", "source")
    return files.resolve_imports(rows, tree(spark).select("path"))


def _triplets(spark: SparkSession) -> DataFrame:
    return graph.triplets(files.to_graph(_parsed(spark)))


def source_imports(spark: SparkSession, _: str) -> DataFrame:
    return _triplets(spark).filter("edge_type = 'imports'").select(F.col("src_path").alias("source"), F.col("dst_path").alias("target"))


def source_links(spark: SparkSession, _: str) -> DataFrame:
    return _triplets(spark).filter("edge_type IN ('calls', 'extends', 'implements')").select("src_id", "dst_id", "edge_type")


def source_nodes(spark: SparkSession, _: str) -> DataFrame:
    return files.to_graph(_parsed(spark)).nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("size"))


def _values(rows: list[tuple], names: str) -> str:
    text = ", ".join("(" + ", ".join("NULL" if v is None else str(v) + "::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"(VALUES {text}) AS t({names})"


_T = "WITH t AS (SELECT * FROM " + _values([(p, TREE[p]) for p in CODE], "path, content") + "), l AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM t)"
_IMPORTS = r"""i AS (SELECT path, regexp_extract(line, 'from [''"]([^''"]+)', 1) AS spec FROM l WHERE path LIKE 'app/%' AND line LIKE 'import %'
 UNION ALL SELECT path, regexp_extract(line, '^#include [<"]([^>"]+)', 1) FROM l WHERE line LIKE '#include %'
 UNION ALL SELECT path, regexp_extract(line, '^import (\w+)', 1) FROM l WHERE path LIKE '%.py' AND line LIKE 'import %'
 UNION ALL SELECT path, regexp_extract(line, '^from ([.]*\w*)', 1) FROM l WHERE path LIKE '%.py' AND line LIKE 'from %')"""
_RESOLVED = """r AS (SELECT path AS source, spec, CASE WHEN spec LIKE '../%' THEN regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/?[^/]*$', '') || '/' || substr(spec, 4) ELSE regexp_replace(path, '/[^/]*$', '') || '/' || substr(spec, 3) END AS base FROM i WHERE path LIKE 'app/%' AND spec LIKE '.%'),
f AS (SELECT source, spec, min_by(path, k) AS target FROM r JOIN (SELECT unnest(['', '.ts', '.tsx', '.js', '/index.ts', '/index.tsx', '/index.js']) AS e, unnest(range(7)) AS k) ON true JOIN t ON t.path = ltrim(base, '/') || e GROUP BY source, spec)"""
#: path: type name first-last line, read off the texts; a file starts at 0.
_NODES = {
    "app/lib/load.ts": "file load.ts 0-4, export load 1-1, function load 1-3, function retry_callback 2-2, function retry 4-4",
    "app/main.ts": "file main.ts 0-10, import ./lib/load 1-1, import ./views/Panel 2-2, import ../config 3-3, import axios 4-4, export start 6-6, function start 6-10",
    "app/views/Panel.tsx": "file Panel.tsx 0-8, import ../lib/load 1-1, export Panel 2-2, class Panel 2-6, method draw 3-5, export Base 7-7, class Base 7-7, interface View 8-8",
    "c/geo/point.h": "file point.h 0-3, class Point 1-1, module Axis 2-2, function norm_(declaration) 3-3",
    "c/main.c": "file main.c 0-13, import stdio.h 1-1, import geo/point.h 2-2, variable SCALE 4-4, function twice 6-8, function main 10-13",
    "config/index.js": "file index.js 0-2, variable mode 1-1",
    "kept.min.js": "file kept.min.js 0-1, function kept 1-1",
    "py/__init__.py": "file __init__.py 0-0",
    "py/shape.py": "file shape.py 0-15, class Shape 5-7, method __init__ 6-7, class Square 10-15, method size 11-15",
    "py/util.py": "file util.py 0-8, function area 4-8",
}
#: Branches in each file.
_BRANCHES = {"app/main.ts": 1, "c/main.c": 1, "py/shape.py": 2, "py/util.py": 2}
_CALLS = "app/main.ts start load, app/lib/load.ts load retry, app/lib/load.ts retry f, app/views/Panel.tsx draw load, c/main.c main twice, c/main.c main norm, py/shape.py Square.size area, py/shape.py Square.size range"
_LINKS = "function:app/main.ts:start function:app/lib/load.ts:load calls, function:app/lib/load.ts:load function:app/lib/load.ts:retry calls, method:app/views/Panel.tsx:draw function:app/lib/load.ts:load calls, function:c/main.c:main function:c/main.c:twice calls, method:py/shape.py:Square.size function:py/util.py:area calls, class:py/shape.py:Square class:py/shape.py:Shape extends, class:app/views/Panel.tsx:Panel class:app/views/Panel.tsx:Base extends, class:app/views/Panel.tsx:Panel interface:app/views/Panel.tsx:View implements"


def _nodes() -> list[tuple]:
    out = []
    for path, text in _NODES.items():
        for kind, name, lines in (x.split(" ") for x in text.split(", ")):
            a, b = map(int, lines.split("-"))
            out.append((path, kind, name.replace("_(", " ("), a, b))
    return out


_split = lambda text: [tuple(x.split(" ")) for x in text.split(", ")]
_N = "n AS (SELECT * FROM " + _values(_nodes(), "path, node_type, name, start_line, end_line") + ")"
_LINES = "s AS (SELECT path, count(*) FILTER (CASE WHEN path LIKE 'c/%' THEN trim(line) != '' ELSE true END)::BIGINT - (path NOT LIKE 'c/%')::BIGINT AS lines FROM l GROUP BY path)"
_ADDED = "SELECT path AS source, 'c/' || spec AS target FROM i WHERE path = 'c/main.c' AND spec LIKE 'geo/%' UNION ALL SELECT path, CASE spec WHEN '.' THEN 'py/__init__.py' ELSE 'py/util.py' END FROM i WHERE path = 'py/shape.py'"
ORACLE_SQL = {
    "scan_tree": f"{_T} SELECT path, content FROM t",
    "parse_metrics": f"{_T}, {_N}, {_LINES}, b AS (SELECT * FROM {_values(list(_BRANCHES.items()), 'path, complexity')}) SELECT path, CASE regexp_extract(path, '[^.]*$') WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'py' THEN 'python' ELSE 'c' END AS language, any_value(lines) AS lines_of_code, coalesce(any_value(complexity), 0) AS complexity, count(*) FILTER (node_type IN ('function', 'method')) AS functions, count(*) FILTER (node_type = 'class') AS classes, (SELECT count(*) FROM l WHERE l.path = n.path AND regexp_matches(line, '^(import |from |#include )')) AS imports, count(*) FILTER (node_type = 'export') AS exports FROM n JOIN s USING (path) LEFT JOIN b USING (path) GROUP BY path",
    "parse_nodes": f"WITH {_N} SELECT * FROM n",
    "parse_calls": f"SELECT * FROM {_values(_split(_CALLS), 'path, caller, callee')}",
    "parse_imports": f"{_T}, {_IMPORTS} SELECT path, spec FROM i",
    "resolved_imports": f"{_T}, {_IMPORTS}, {_RESOLVED} SELECT source, spec, target FROM f",
    "source_imports": f"{_T}, {_IMPORTS}, {_RESOLVED} SELECT source, target FROM f UNION ALL {_ADDED}",
    "source_links": f"SELECT * FROM {_values(_split(_LINKS), 'src_id, dst_id, edge_type')}",
    "source_nodes": f"WITH {_N} SELECT path AS file_path, count(*) AS nodes, round(sum(CASE WHEN node_type IN ('file', 'module') THEN 20 WHEN node_type IN ('class', 'interface') THEN 15 WHEN node_type IN ('function', 'method') THEN 10 ELSE 5 END + least((end_line - start_line + 1) / 10, 10)), 6)::DOUBLE AS size FROM n GROUP BY path",
}
QUERIES = {f.__name__: f for f in (scan_tree, parse_metrics, parse_nodes, parse_calls, parse_imports, resolved_imports, source_imports, source_links, source_nodes)}
