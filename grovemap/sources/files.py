"""Source trees as tables, and graphs from them."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemap.operators.graph import Graph, build, builder_size, color_of, edge_weight
from grovemap.sources.languages import BY_EXTENSION, language_of
from grovemap.sources.parse import parse_files

TRY = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """Regular expression of a .gitignore line for paths relative to its folder, which for folders end with a slash, and whether the line is an exception (`!`); None for blank lines and comments."""
    line = re.sub(r"(?<!\\)\s+$", "", line)
    if not line or line[0] == "#":
        return None
    keep = line[0] == "!"
    line = line[1:] if keep else line[1:] if line[:2] in (r"\#", r"\!") else line
    anchored = "/" in line.rstrip("/")
    body = ""
    for part in re.findall(r"\*\*/|\*\*|\*|\?|\[!?[^\]]+\]|\\.|.", line.strip("/")):
        body += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or ("[" + re.sub("^!", "^", part[1:-1]).replace("\\", r"\\") + "]" if len(part) > 2 else re.escape(part[-1]))
    return ("^" if anchored else "(?:^|.*/)") + body + ("/$" if line.endswith("/") else "/?$"), keep


def _ignored(path: str, rules: list[tuple[str, re.Pattern, bool]]) -> bool:
    """Whether the last rule (folder, pattern, exception) that the path meets leaves it out."""
    for folder, pattern, keep in reversed(rules):
        if path.startswith(folder) and pattern.match(path[len(folder) :]):
            return not keep
    return False


def _rules(folder: str, lines: Iterable[str]) -> list[tuple[str, re.Pattern, bool]]:
    return [(folder, re.compile(p[0]), p[1]) for p in map(ignore_pattern, lines) if p]


def listed(root: str, ignore: Iterable[str] = ()) -> Iterator[str]:
    """Paths, relative to root, of the files with a known extension that neither `ignore` (.gitignore lines) nor a .gitignore file of the tree leaves out. Hidden files count; folders that are left out, and .git, aren't entered."""
    system, base = FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    waiting = [("", _rules("", ignore))]
    while waiting:
        folder, rules = waiting.pop()
        found = system.get_file_info(FileSelector(f"{base}/{folder}"))
        if any(x.base_name == ".gitignore" and x.type == FileType.File for x in found):
            with system.open_input_stream(f"{base}/{folder}.gitignore") as f:
                rules = rules + _rules(folder, f.read().decode("utf-8", "replace").splitlines())
        for x in sorted(found, key=lambda x: x.base_name):
            path = folder + x.base_name
            if x.type == FileType.Directory:
                if x.base_name != ".git" and not _ignored(path + "/", rules):
                    waiting.append((path + "/", rules))
            elif x.base_name.rpartition(".")[2].lower() in BY_EXTENSION and "." in x.base_name and not _ignored(path, rules):
                yield path


def scan(spark: SparkSession, root: str, ignore: Iterable[str] = ()) -> DataFrame:
    """(path, content) of the files that listed() finds below root (a path, or a URI of a file system that all executors reach); content is null for files that aren't UTF-8. Names are listed by the driver, files are read by executors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([data], pa.binary())], ["path", "content"])

    names = spark.createDataFrame(pa.table({"path": pa.array(list(listed(root, ignore)), pa.string())}))
    cores = spark.sparkContext.defaultParallelism
    text = F.col("content").cast("string")
    return names.repartition(4 * cores).mapInArrow(read, "path string, content binary").select("path", F.when(F.is_valid_utf8(text), text).alias("content"))


def normal(path: Column) -> Column:
    """Path without `.` segments and with each `..` taking back the segment before it."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    step = lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, package_main: DataFrame | None = None) -> DataFrame:
    """(source, spec, target): the file that each relative or rooted import (source, spec) means: the path itself, with an extension, an index file in it, or its package's main file (package_main: dir, main). External names have none."""
    inside = imports.filter(F.col("spec").rlike("^[./~]"))
    folder = F.regexp_replace("source", "/?[^/]*$", "")
    base = normal(F.when(F.col("spec").startswith("/"), F.col("spec")).otherwise(F.concat_ws("/", folder, "spec")))
    rows = inside.select("source", "spec", base.alias("base"))
    tries = [F.col("base"), *[F.concat("base", F.lit(e)) for e in TRY], *[F.concat("base", F.lit(f"/index{e}")) for e in TRY]]
    options = rows.select("source", "spec", F.posexplode(F.array(*tries)).alias("rank", "target"))
    if package_main is not None:
        main = rows.join(package_main, F.col("base") == F.col("dir")).select("source", "spec", F.posexplode(F.array(*[F.concat(normal(F.concat_ws("/", "base", "main")), F.lit(e)) for e in ["", *TRY]])).alias("rank", "target"))
        options = options.unionByName(main.withColumn("rank", F.col("rank") + len(tries)))
    found = options.join(files.select(F.col("path").alias("target")), "target", "left_semi")
    return found.groupBy("source", "spec").agg(F.min_by("target", "rank").alias("target"))


def package_mains(packages: DataFrame) -> DataFrame:
    """(dir, main) of package.json files (path, content)."""
    return packages.select(F.regexp_replace("path", "/?package[.]json$", "").alias("dir"), F.get_json_object("content", "$.main").alias("main")).filter("main IS NOT NULL")


def _python_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Python modules by the longest end of a path that they name: `a/b` is a/b.py or a/b/__init__.py."""
    py = files.filter(F.col("path").endswith(".py")).select(F.col("path").alias("target"), F.regexp_replace(F.regexp_replace("path", "[.]py$", ""), "/__init__$", "").alias("module"))
    dots = F.length(F.regexp_extract("spec", "^[.]+", 0))
    up = F.concat_ws("/", F.regexp_replace("source", "/?[^/]*$", ""), F.array_join(F.array_repeat(F.lit(".."), (dots - 1).cast("int")), "/"), F.regexp_replace("spec", "^[.]+", ""))
    named = imports.select("source", "spec", F.when(dots > 0, normal(up)).otherwise(F.col("spec")).alias("module"))
    whole = named.join(py, "module").select("source", "spec", "target")
    tails = py.select("target", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("module", "/"))), lambda i: F.array_join(F.slice(F.split("module", "/"), i, F.size(F.split("module", "/"))), "/"))).alias("module"))
    loose = named.filter(~F.col("spec").startswith(".")).join(tails, "module").select("source", "spec", "target")
    return whole.unionByName(loose).groupBy("source", "spec").agg(F.min_by("target", F.struct(F.length("target"), F.col("target"))).alias("target"))


def to_graph(parsed: DataFrame, package_main: DataFrame | None = None) -> Graph:
    """The typed graph of parsed files. Imports lead to files, calls to the function of that name in the same file or else to the only one of that name; base classes to the class of that name likewise. What can't be resolved is dropped."""
    ok = parsed.filter("error IS NULL")
    rows = ok.select("path", F.posexplode("nodes").alias("pos", "n")).select("path", "pos", "n.*")
    # numbers that no other file can have, without a sort of all files
    ix = F.xxhash64("id").alias("ix")
    nodes = rows.select(ix, "id", "name", F.col("node_type").alias("node_type"), builder_size(F.col("node_type"), F.col("start_line"), F.col("end_line")).alias("size"), color_of(F.col("node_type")).alias("color"), F.col("path").alias("file_path"))
    links = ok.select("path", F.explode("links").alias("l")).select("path", "l.*")
    plain = links.filter(~F.col("target").rlike("^(import|call|base):")).select("source", "target", "edge_type")
    files = ok.select("path", language_of(F.col("path")).alias("language"))
    wanted = links.filter(F.col("target").startswith("import:")).select(F.col("path").alias("source"), F.expr("substring(target, 8)").alias("spec"), language_of(F.col("path")).alias("language"))
    local = wanted.withColumn("spec", F.when((F.col("language") == "c") & ~F.col("spec").rlike("^[./]"), F.concat(F.lit("./"), "spec")).otherwise(F.col("spec")))
    found = resolve_imports(local.filter("language != 'python'").select("source", "spec").distinct(), files, package_main).unionByName(_python_imports(local.filter("language = 'python'").select("source", "spec").distinct(), files))
    to_file = lambda c: F.concat(F.lit("file:"), c)
    imports = found.select(to_file(F.col("source")).alias("source"), to_file(F.col("target")).alias("target"), F.lit("imports").alias("edge_type")).distinct()
    names = rows.select("path", "id", "name", "node_type")

    def by_name(prefix: str, kinds: list[str]) -> DataFrame:
        ask = links.filter(F.col("target").startswith(prefix)).select("path", "source", F.expr(f"substring(target, {len(prefix) + 1})").alias("name"), "edge_type")
        own = names.filter(F.col("node_type").isin(kinds)).groupBy("path", "name").agg(F.min("id").alias("own"))
        only = names.filter(F.col("node_type").isin(kinds)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only")).filter("n = 1").drop("n")
        return ask.join(own, ["path", "name"], "left").join(only, "name", "left").select("source", F.coalesce("own", "only").alias("target"), "edge_type").filter("target IS NOT NULL")

    every = plain.unionByName(imports).unionByName(by_name("call:", ["function", "method"])).unionByName(by_name("base:", ["class", "interface"]))
    return build(nodes, every.select(F.xxhash64("source", "target", "edge_type").alias("eix"), "source", "target", "edge_type", edge_weight(F.col("edge_type")).alias("weight")))


def analyze_tree(spark: SparkSession, root: str, ignore: Iterable[str] = ()) -> tuple[Graph, DataFrame]:
    """Graph of the source tree at root, and (path, error) of the files left out."""
    parsed = parse_files(scan(spark, root, ignore))
    return to_graph(parsed), parsed.filter("error IS NOT NULL").select("path", "error")


def file_ordinals(files: DataFrame) -> DataFrame:
    """(path, file_ord): places in path order, for the one-pass builder."""
    return files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("file_ord"))
