"""Coupling, cohesion, complexity, maintainability and code smells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemap.functions.exprs import clamp, log_or_low, ratio, same_module
from grovemap.operators.centrality import neighbours
from grovemap.operators.graph import Graph, triplets, with_degrees
from grovemap.operators.primitives import level_sizes

UNITS = ["file", "module", "class"]


def coupling_v1(g: Graph) -> DataFrame:
    """(ix, afferent, efferent, instability) of files, modules and classes: distinct neighbours among themselves."""
    both = triplets(g).filter(F.col("src_type").isin(UNITS) & F.col("dst_type").isin(UNITS)).select("src", "dst").distinct()
    ends = both.selectExpr("explode(array(struct(dst AS ix, 1 AS ca, 0 AS ce), struct(src AS ix, 0 AS ca, 1 AS ce))) AS e").select("e.*").groupBy("ix").agg(F.sum("ca").alias("ca"), F.sum("ce").alias("ce"))
    out = g.nodes.filter(F.col("node_type").isin(UNITS)).select("ix").join(ends, "ix", "left").select("ix", F.coalesce("ca", F.lit(0)).alias("afferent"), F.coalesce("ce", F.lit(0)).alias("efferent"))
    return out.withColumn("instability", ratio(F.col("efferent"), F.col("afferent") + F.col("efferent")))


def coupling_v2(g: Graph) -> DataFrame:
    """(ix, afferent, efferent, instability, score) of all nodes by edge counts."""
    d = with_degrees(g)
    total = F.col("d_in") + F.col("d_out")
    return d.select("ix", F.col("d_in").alias("afferent"), F.col("d_out").alias("efferent"), ratio(F.col("d_out"), total).alias("instability"), F.least(total / F.lit(20.0), F.lit(1.0)).alias("score"))


def cohesion_v1(g: Graph) -> DataFrame:
    """(ix, cohesion) of classes and modules: ordered pairs of their functions and methods that are linked, over all; 1 below two."""
    t = triplets(g)
    members = t.filter(F.col("src_type").isin("class", "module") & F.col("dst_type").isin("function", "method")).select("src", "dst", "eix")
    k = members.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    links = g.edges.select(F.col("src").alias("la"), F.col("dst").alias("lb")).distinct()
    # from the members' own edges, not from all pairs of members
    out = members.selectExpr("src AS u", "dst AS x", "eix AS ex").join(links, F.col("x") == F.col("la")).join(members.selectExpr("src AS u2", "dst AS y", "eix AS ey"), (F.col("u") == F.col("u2")) & (F.col("lb") == F.col("y")) & (F.col("ex") != F.col("ey")))
    linked = out.groupBy("u").agg(F.count(F.lit(1)).alias("linked"))
    units = g.nodes.filter(F.col("node_type").isin("class", "module")).select("ix").join(k, F.col("ix") == F.col("src"), "left").join(linked, F.col("ix") == F.col("u"), "left")
    return units.select("ix", F.when(F.coalesce("k", F.lit(0)) < 2, 1.0).otherwise(F.coalesce("linked", F.lit(0)) / (F.col("k") * (F.col("k") - 1))).alias("cohesion"))


def cohesion_v2(g: Graph) -> DataFrame:
    """(ix, cohesion, lcom): share of distinct neighbours in the node's directory, 1 without neighbours; lcom of classes is the share outside."""
    path = g.nodes.select(F.col("ix").alias("p"), F.col("file_path").alias("path"))
    near = neighbours(g).join(path.withColumnsRenamed({"p": "a", "path": "pa"}), "a").join(path.withColumnsRenamed({"p": "b", "path": "pb"}), "b")
    sums = near.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.count_if(same_module(F.col("pa"), F.col("pb"))).alias("inside"))
    out = g.nodes.select("ix", "node_type").join(sums, F.col("ix") == F.col("a"), "left")
    lcom = F.when(F.col("node_type") == "class", (F.coalesce("k", F.lit(0)) - F.coalesce("inside", F.lit(0))) / F.greatest(F.coalesce("k", F.lit(0)), F.lit(1)))
    return out.select("ix", F.when(F.col("k") > 0, F.col("inside") / F.col("k")).otherwise(1.0).alias("cohesion"), lcom.alias("lcom"))


def depth_v1(g: Graph) -> DataFrame:
    """(ix, depth): steps to the farthest node that reaches it. (Breadth-first, where the original takes depths in the order of a stack.)"""
    far = level_sizes(g.nodes, g.edges, backward=True).groupBy("s").agg(F.max("d").alias("depth"))
    return far.select(F.col("s").alias("ix"), F.col("depth").cast("long").alias("depth"))


def cyclomatic_v1(g: Graph) -> DataFrame:
    """(ix, cyclomatic): functions and methods out + 1; classes 2 for each method and 1 for each edge out; files and modules 5 for each function, 10 for each class, 1 for each other target; else 1."""
    t = triplets(g).groupBy("src").agg(F.count(F.lit(1)).alias("outs"), F.count_if(F.col("dst_type") == "method").alias("methods"), F.sum(F.when(F.col("dst_type") == "function", 5).when(F.col("dst_type") == "class", 10).otherwise(1)).alias("parts"))
    out = g.nodes.select("ix", "node_type").join(t, F.col("ix") == F.col("src"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = F.when(F.col("node_type").isin("function", "method"), n("outs") + 1).when(F.col("node_type") == "class", 2 * n("methods") + n("outs")).when(F.col("node_type").isin("file", "module"), n("parts")).otherwise(1)
    return out.select("ix", value.cast("double").alias("cyclomatic"))


def complexity_v1(g: Graph) -> DataFrame:
    """(ix, cyclomatic, cognitive): cognitive grows by a tenth for each step of depth."""
    return cyclomatic_v1(g).join(depth_v1(g), "ix").select("ix", "cyclomatic", (F.col("cyclomatic") * (1 + 0.1 * F.col("depth"))).alias("cognitive"))


def maintainability_v1(g: Graph) -> DataFrame:
    """(ix, maintainability) from volume and cyclomatic complexity; (171 - 5.2 ln V - 0.23 C - 16.2 ln 10 C) / 100 within 0 and 1."""
    deps = with_degrees(g).select("ix", F.col("d_out").cast("double").alias("dep"))
    volume = F.col("dep") * F.ln(F.col("dep") + 2)
    c = F.col("cyclomatic")
    raw = 171 - 5.2 * F.greatest(log_or_low(volume), F.lit(0.0)) - 0.23 * c - 16.2 * F.greatest(log_or_low(c * 10), F.lit(0.0))
    return deps.join(cyclomatic_v1(g), "ix").select("ix", clamp(raw / 100).alias("maintainability"))


def complexity_v2(g: Graph) -> DataFrame:
    """(ix, cyclomatic, cognitive, loc, inheritance_depth) from degrees and size."""
    i, o = F.col("d_in").cast("double"), F.col("d_out").cast("double")
    kind = F.col("node_type")
    value = F.when(kind.isin("function", "method"), F.least(1 + o, F.lit(50.0))).when(kind == "class", F.least((i + o) / 2, F.lit(100.0))).when(kind.isin("file", "module"), F.least((i + o) / 3, F.lit(50.0))).otherwise(F.lit(1.0))
    return with_degrees(g).select("ix", value.alias("cyclomatic"), (value * 1.2).alias("cognitive"), F.least(F.coalesce("size", F.lit(0.0)), F.lit(10000.0)).alias("loc"), F.least(F.sqrt(i), F.lit(10.0)).alias("inheritance_depth"))


def smells(g: Graph) -> DataFrame:
    """(ix, smell, severity), a row for each smell of a node."""
    i, o, total = F.col("d_in"), F.col("d_out"), F.col("d_in") + F.col("d_out")
    smell = lambda name, level: F.struct(F.lit(name).alias("smell"), level.alias("severity"))
    level = lambda test: F.when(test, "High").otherwise("Medium")
    found = F.array(
        F.when(total > 30, smell("God Object", level(total > 50))),
        F.when(F.col("size") > 500, smell("Large File", level(F.col("size") > 1000))),
        F.when(o > 15, smell("Feature Envy", F.lit("Medium"))),
        F.when(i > 20, smell("Shotgun Surgery", F.lit("High"))),
    )
    return with_degrees(g).select("ix", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("s")).select("ix", "s.*")


def maintainability_v2(g: Graph) -> DataFrame:
    def part(share: float, x: Column, unit: float) -> Column:
        return F.lit(share) / (1 + x / F.lit(unit))

    return with_degrees(g).select("ix", (100 * (part(0.4, F.col("d_out"), 10.0) + part(0.3, F.coalesce("size", F.lit(0.0)), 500.0) + part(0.3, F.col("d_in"), 10.0))).alias("maintainability"))
