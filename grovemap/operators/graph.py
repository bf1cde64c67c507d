"""Typed property graphs: construction, projections, payloads, display rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemap.functions.exprs import clamp, mapped

NODES = "ix long, id string, name string, node_type string, size double, color string, file_path string"
EDGES = "eix long, src long, dst long, edge_type string, weight double"
NODE_TYPES = ["file", "module", "class", "interface", "function", "method", "variable", "property", "import", "export", "type", "enum"]
EDGE_WEIGHTS = {"contains": 1.0, "references": 1.0, "calls": 1.5, "imports": 2.0, "exports": 2.0, "extends": 3.0, "implements": 3.0}
BASE_SIZES = {"file": 20.0, "module": 20.0, "class": 15.0, "interface": 15.0, "function": 10.0, "method": 10.0}
#: Colours by node type: of the graph builder, of payloads and the 3-D view, and of level-of-detail views. "" is any other type.
PALETTES: dict[str, dict[str, str]] = {
    "builder": {"class": "#ff9800", "enum": "#ff5722", "file": "#4a9eff", "function": "#4caf50", "interface": "#9c27b0", "method": "#8bc34a", "module": "#4a9eff", "property": "#795548", "type": "#e91e63", "variable": "#607d8b", "": "#cccccc"},
    "payload": {"class": "#50C878", "enum": "#85C1E2", "export": "#F0E68C", "file": "#4A90E2", "function": "#FFB347", "import": "#DDA0DD", "interface": "#98D8C8", "method": "#FFA07A", "module": "#7B68EE", "property": "#F7DC6F", "type": "#BB8FCE", "type_alias": "#BB8FCE", "variable": "#87CEEB", "": "#7ED321"},
    "lod": {"class": "#96ceb4", "file": "#4ecdc4", "function": "#45b7d1", "package": "#ff6b6b", "": "#95a5a6"},
}
#: Node types by the size that a 3-D view gives them before it grows; others have DISPLAY.
DISPLAY_TYPES = {8.0: ["file"], 7.0: ["module"], 6.0: ["class"], 5.0: ["interface"], 4.0: ["enum", "function"], 3.0: ["method", "type", "type_alias"], 2.0: ["export", "import", "property"]}
DISPLAY = 3.0
BASE_DISPLAY = {t: size for size, types in DISPLAY_TYPES.items() for t in types}


@dataclass
class Graph:
    """nodes (NODES) with one row for each ix, edges (EDGES) that refer to ix; parallel edges and loops are legal."""

    nodes: DataFrame
    edges: DataFrame


def builder_size(node_type: Column, start_line: Column, end_line: Column) -> Column:
    return mapped(node_type, BASE_SIZES, 5.0) + F.least((end_line - start_line + 1) / F.lit(10.0), F.lit(10.0))


def edge_weight(edge_type: Column) -> Column:
    return mapped(edge_type, EDGE_WEIGHTS, 1.0)


def color_of(node_type: Column, palette: str = "builder") -> Column:
    colors = PALETTES[palette]
    return mapped(node_type, colors, colors[""])


def build(nodes: DataFrame, links: DataFrame) -> Graph:
    """Graph of nodes (ix, id, ...) and links (eix, source, target, edge_type, weight) by id, in two passes: links to ids not found are dropped, also empty ids. Of nodes with one id the last by ix takes all links, and the others stay without."""
    named = nodes.filter("id IS NOT NULL AND id != ''")
    last = named.groupBy("id").agg(F.max("ix").alias("at"))
    ends = links.filter("source != '' AND target != ''")
    found = ends.join(last.select(F.col("id").alias("source"), F.col("at").alias("src")), "source").join(last.select(F.col("id").alias("target"), F.col("at").alias("dst")), "target")
    return Graph(named, found.select("eix", "src", "dst", "edge_type", F.col("weight").cast("double").alias("weight")))


def build_one_pass(nodes: DataFrame, links: DataFrame) -> Graph:
    """As build(), but file by file: nodes and links have file_ord, and a link counts only if both its ends occur in its own or an earlier file."""
    first = nodes.groupBy("id").agg(F.min("file_ord").alias("first"))
    for end in ("source", "target"):
        seen = first.select(F.col("id").alias(end), F.col("first").alias(f"first_{end}"))
        links = links.join(seen, end).filter(F.col(f"first_{end}") <= F.col("file_ord")).drop(f"first_{end}")
    return build(nodes, links)


def triplets(g: Graph) -> DataFrame:
    """Edges with the type and path of both ends."""
    end = lambda side: g.nodes.select(F.col("ix").alias(side), F.col("id").alias(f"{side}_id"), F.col("node_type").alias(f"{side}_type"), F.col("file_path").alias(f"{side}_path"))
    return g.edges.join(end("src"), "src").join(end("dst"), "dst")


def degrees(g: Graph) -> DataFrame:
    """(ix, d_in, d_out): edges with their multiplicity, a loop in both. One aggregation over both ends of all edges."""
    ends = g.edges.select(F.explode(F.array(F.struct(F.col("src").alias("ix"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("ix"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("ix").agg(F.sum("i").alias("d_in"), F.sum("o").alias("d_out"))
    return g.nodes.select("ix").join(sums, "ix", "left").select("ix", F.coalesce("d_in", F.lit(0)).alias("d_in"), F.coalesce("d_out", F.lit(0)).alias("d_out"))


def with_degrees(g: Graph) -> DataFrame:
    return g.nodes.join(degrees(g), "ix")


def payload_nodes(g: Graph) -> DataFrame:
    """Nodes as a client shows them: size is ten for each connection, ten at least."""
    return with_degrees(g).withColumn("connections", F.col("d_in") + F.col("d_out")).withColumn("size", F.greatest(F.col("connections") * 10.0, F.lit(10.0))).select("ix", "id", "name", "node_type", "size", "color", "file_path", "connections")


def payload_stats(g: Graph) -> DataFrame:
    kinds = [F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("file", "function", "variable")] + [F.count_if(F.col("node_type") == "class").alias("classes")]
    return g.nodes.agg(F.count(F.lit(1)).alias("total_nodes"), *kinds).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("total_edges")))


def payload_json(g: Graph) -> DataFrame:
    """One JSON document for each node and each link: (kind, json)."""
    name = lambda side: g.nodes.select(F.col("ix").alias(side), F.col("id").alias(f"{side}_id"))
    links = g.edges.join(name("src"), "src").join(name("dst"), "dst").select(F.lit("link").alias("kind"), F.to_json(F.struct(F.col("src_id").alias("source"), F.col("dst_id").alias("target"), F.col("edge_type").alias("type"), F.col("weight").alias("value"))).alias("json"))
    nodes = payload_nodes(g).select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "name", F.col("node_type").alias("type"), "size", "color", F.col("file_path").alias("filePath"))).alias("json"))
    return nodes.unionByName(links)


def loops(g: Graph) -> DataFrame:
    return g.edges.filter("src = dst")


def match_metrics(metrics: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, ix, id) of the node of each of the metrics (path, ...): the id equals the path or one ends with the other; of several nodes the first by ix.

    Where both have a slash they share their last segment if one ends with the
    other, and that is the key of a hash join. A text without a slash may be
    the end of a longer segment: its ends are no more than its characters, so
    that the other side is exploded into the ends of its last segment that are
    as long as some such text, and both meet in a hash join as well.
    """
    last = lambda c: F.substring_index(c, "/", -1)
    paths, ids = metrics.select("path").filter("path IS NOT NULL").distinct(), nodes.select("ix", "id").filter("id IS NOT NULL")
    fits = F.expr("endswith(path, id) OR endswith(id, path)")
    whole = paths.withColumn("k", last("path")).join(ids.withColumn("k", last("id")), "k").filter(fits).select("path", "ix", "id")

    def ends(bare: DataFrame, b: str, other: DataFrame, o: str) -> DataFrame:
        bare = bare.filter(F.instr(b, "/") == 0)
        lengths = F.broadcast(bare.agg(F.collect_set(F.length(b)).alias("lengths")))  # as many as there are lengths of file names
        tails = other.crossJoin(lengths).select(*other.columns, F.explode(F.filter("lengths", lambda n: n < F.length(last(o)))).alias("n"))
        return tails.withColumn("k", F.when(F.col("n") > 0, F.right(F.col(o), F.col("n"))).otherwise("")).join(bare.withColumn("k", F.col(b)), "k").select("path", "ix", "id")

    return whole.unionByName(ends(ids, "id", paths, "path")).unionByName(ends(paths, "path", ids, "id")).groupBy("path").agg(F.min_by(F.struct("ix", "id"), "ix").alias("n")).select("path", "n.ix", "n.id")


def display(metrics: DataFrame) -> DataFrame:
    """Marks and measures that a client draws: metrics (id, risk, chokepoint, importance, community)."""
    return metrics.select("id", (F.col("risk") > 0.7).alias("is_risky"), (F.col("chokepoint") > 0.7).alias("is_chokepoint"), (0.5 + 1.5 * F.col("importance")).alias("scale"), F.pmod("community", F.lit(10)).alias("color_index"))


def highlighted(nodes: DataFrame, path_ids: DataFrame) -> DataFrame:
    """Nodes with in_path: whether their id is among path_ids (id)."""
    marked = path_ids.select("id").distinct().withColumn("in_path", F.lit(True))
    return nodes.join(marked, "id", "left").withColumn("in_path", F.coalesce("in_path", F.lit(False)))


def display_size(g: Graph) -> DataFrame:
    """(ix, display_size): a base by type times the root of a tenth of the size, or what its connections give it if that is more, within 2 and 20. Nodes without a size, or with neither, keep their base."""
    ends = (F.col("d_in") + F.col("d_out")).cast("double")
    by_size = F.when(F.col("size") > 0, F.sqrt(F.col("size") / 10.0)).otherwise(1.0)
    grow = F.when(ends > 0, F.greatest(by_size, 1.0 + 0.3 * F.log1p(ends))).otherwise(by_size)
    return with_degrees(g).select("ix", clamp(mapped(F.col("node_type"), BASE_DISPLAY, DISPLAY) * grow, 2.0, 20.0).alias("display_size"))


def palette_filter(commands: DataFrame, text: str) -> DataFrame:
    """commands (label, category, shortcut) that hold the text in any of the three."""
    low = text.lower()
    return commands.filter(F.lower("label").contains(low) | F.lower("category").contains(low) | F.lower(F.coalesce("shortcut", F.lit(""))).contains(low))
