"""Levels of detail: packages, files, functions, and deltas between views."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemap.functions.exprs import package_of
from grovemap.operators.graph import Graph

FUNCTIONS = ["function", "class", "method"]
NODE = ["id", "label", "kind", "parent"]
EDGE = ["id", "source", "target", "kind", "weight"]


@dataclass
class Snapshot:
    """files (ix, id, label, package), functions (ix, id, label, file), imports (source, target) between file ids, calls between function ids."""

    files: DataFrame
    functions: DataFrame
    imports: DataFrame
    calls: DataFrame


def snapshot(g: Graph) -> Snapshot:
    """The three levels of a graph. A function's file is the source of its first `contains` edge from a file; functions without one are left out. An import names a file by id, or by the last part of its target's name."""
    files = g.nodes.filter("node_type = 'file'").select("ix", "id", F.col("name").alias("label"), package_of(F.col("file_path")).alias("package"))
    is_file = g.nodes.select(F.col("ix").alias("src"), F.col("id").alias("file"), ((F.col("node_type") == "file") | F.col("id").contains("file")).alias("ok")).filter("ok")
    parent = g.edges.filter("edge_type = 'contains'").join(is_file, "src").groupBy("dst").agg(F.min_by("file", "eix").alias("file"))
    functions = g.nodes.filter(F.col("node_type").isin(FUNCTIONS)).join(parent, F.col("ix") == F.col("dst")).select("ix", "id", F.col("name").alias("label"), "file")
    links = g.edges.filter(F.col("edge_type").isin("imports", "includes")).select("eix", "src", "dst")
    source = files.select(F.col("ix").alias("src"), F.col("id").alias("source"))
    direct = files.select(F.col("ix").alias("dst"), F.col("id").alias("by_id"))
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index("target_id", "/", -1), "^file_", ""), "_h$", ".h"), "_c$", ".c")
    named = files.groupBy("label").agg(F.min_by("id", "ix").alias("by_label"))
    found = links.join(source, "src").join(direct, "dst", "left").join(g.nodes.select(F.col("ix").alias("dst"), F.col("id").alias("target_id")), "dst").withColumn("label", tail).join(named, "label", "left")
    imports = found.select("source", F.coalesce("by_id", "by_label").alias("target")).filter("target IS NOT NULL")
    fn = lambda a, b: functions.select(F.col("ix").alias(a), F.col("id").alias(b))
    calls = g.edges.filter("edge_type = 'calls'").join(fn("src", "source"), "src").join(fn("dst", "target"), "dst").select("source", "target")
    return Snapshot(files, functions, imports, calls)


def packages(s: Snapshot) -> DataFrame:
    return s.files.groupBy("package").agg(F.count(F.lit(1)).alias("n_files")).select(F.col("package").alias("id"), F.regexp_replace("package", "^pkg[.]", "").alias("label"), "n_files")


def package_edges(s: Snapshot) -> DataFrame:
    """(source, target, weight): imports between files of different packages."""
    p = lambda a, b: s.files.select(F.col("id").alias(a), F.col("package").alias(b))
    return s.imports.join(p("source", "from"), "source").join(p("target", "to"), "target").filter("`from` != `to`").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


def file_edges(s: Snapshot) -> DataFrame:
    return s.imports.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def _edges(pairs: DataFrame, kind: str) -> DataFrame:
    """Edges with an id; repeated ones are one with their number as weight."""
    rows = pairs if "weight" in pairs.columns else pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    return rows.select(F.concat_ws("->", "source", "target").alias("id"), "source", "target", F.lit(kind).alias("kind"), "weight")


def _file_nodes(s: Snapshot) -> DataFrame:
    return s.files.select("id", "label", F.lit("file").alias("kind"), F.col("package").alias("parent"))


def _function_nodes(s: Snapshot) -> DataFrame:
    return s.functions.select("id", "label", F.lit("function").alias("kind"), F.col("file").alias("parent"))


def view(s: Snapshot, level: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a level: 1 packages, 2 and 3 files, 4 functions; others are empty."""
    if level == 1:
        return packages(s).select("id", "label", F.lit("package").alias("kind"), F.lit(None).cast("string").alias("parent")), _edges(package_edges(s), "bundled")
    if level in (2, 3):
        return _file_nodes(s), _edges(s.imports, "imports")
    if level == 4:
        return _function_nodes(s), _edges(s.calls, "calls")
    return _file_nodes(s).limit(0), _edges(s.imports, "imports").limit(0)


def expand(s: Snapshot, node_id: str, level: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that opening a node adds: a package's files with their imports from level 2, a file's functions with their calls from level 4."""
    if node_id.startswith("pkg.") and level >= 2:
        nodes = _file_nodes(s).filter(F.col("parent") == node_id)
        return nodes, _edges(s.imports.join(nodes.select(F.col("id").alias("source")), "source", "left_semi"), "imports")
    if level >= 4 and not node_id.startswith("pkg."):
        nodes = _function_nodes(s).filter(F.col("parent") == node_id)
        return nodes, _edges(s.calls.join(nodes.select(F.col("id").alias("source")), "source", "left_semi"), "calls")
    return view(s, 0)


def collapse(s: Snapshot, node_id: str) -> tuple[DataFrame, DataFrame]:
    """(id) of nodes and of edges that closing a node removes: its files and functions, and every edge at one of them."""
    files = s.files.filter(F.col("package") == node_id).select("id")
    owners = files.unionByName(s.files.filter(F.col("id") == node_id).select("id"))
    functions = s.functions.join(owners.select(F.col("id").alias("file")), "file", "left_semi").select("id")
    gone = files.unionByName(functions).distinct()
    edges = _edges(s.imports, "imports").unionByName(_edges(s.calls, "calls"))
    hit = [edges.join(gone.select(F.col("id").alias(end)), end, "left_semi").select("id") for end in ("source", "target")]
    return gone, reduce(DataFrame.union, hit).distinct()


def bundles_of(s: Snapshot, node_id: str) -> DataFrame:
    """The bundled edges that closing a package brings back: those between it and other packages. None for other nodes."""
    return _edges(package_edges(s).filter((F.col("source") == node_id) | (F.col("target") == node_id)), "bundled")


def apply_delta(rows: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, restore: DataFrame | None = None) -> DataFrame:
    """rows (id, ...) without the ids of remove, and with those of add, then of restore, that aren't there yet, each once."""
    if remove is not None:
        rows = rows.join(remove.select("id"), "id", "left_anti")
    for more in (add, restore):
        if more is not None:
            new = more.select(*rows.columns).dropDuplicates(["id"]).join(rows.select("id"), "id", "left_anti")
            rows = rows.unionByName(new)
    return rows
