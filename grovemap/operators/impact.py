"""What a change to a node touches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.operators.centrality import size_of
from grovemap.operators.graph import Graph
from grovemap.operators.primitives import distances, is_small, level_sizes, per_source, reached


def impact_probability(g: Graph) -> DataFrame:
    """(ix, probability): 0.7 ** distance over the nodes that reach the node within 4 steps, itself included, over n; 1 at most."""
    near = level_sizes(g.nodes, g.edges, most=4, backward=True)
    return near.groupBy("s").agg(F.sum(F.pow(F.lit(0.7), F.col("d")) * F.col("n")).alias("w")).crossJoin(F.broadcast(size_of(g))).select(F.col("s").alias("ix"), F.least(F.col("w") / F.col("n"), F.lit(1.0)).alias("probability"))


def direct(g: Graph) -> DataFrame:
    """(ix, other): sources of in-edges, with their multiplicity."""
    return g.edges.select(F.col("dst").alias("ix"), F.col("src").alias("other"))


def _two_or_three(first: np.ndarray, to: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    one = reached(first, to, np.array([at]))
    two = reached(first, to, one)
    found = np.setdiff1d(np.union1d(two, reached(first, to, two)), one, assume_unique=True)
    return found, np.zeros(len(found), np.int32)


def indirect(g: Graph) -> DataFrame:
    """(ix, other): nodes with a walk of 2 or 3 edges to the node, that aren't among the direct ones; the node itself if it lies on such a cycle."""
    e = cut(g.edges.select("src", "dst").distinct(), "steps")
    if is_small(e):
        return per_source(e.selectExpr("dst AS ea", "src AS eb"), e.selectExpr("dst AS s"), _two_or_three).selectExpr("s AS ix", "t AS other")
    one = e.selectExpr("dst AS v", "src AS w1")
    two = one.join(e.selectExpr("dst AS b2", "src AS w2"), F.col("w1") == F.col("b2")).select("v", "w2").distinct()
    three = two.join(e.selectExpr("dst AS b3", "src AS w3"), F.col("w2") == F.col("b3")).select("v", F.col("w3").alias("w2")).distinct()
    return two.union(three).distinct().join(one.selectExpr("v AS dv", "w1 AS dw"), (F.col("v") == F.col("dv")) & (F.col("w2") == F.col("dw")), "left_anti").select(F.col("v").alias("ix"), F.col("w2").alias("other"))


def severity_of(direct_count: Column, indirect_count: Column, n: Column) -> Column:
    x = (direct_count + 0.5 * indirect_count) / n
    return F.when(x < 0.1, 2 * x).when(x < 0.3, 0.2 + 3 * (x - 0.1)).otherwise(F.least(0.8 + 0.5 * (x - 0.3), F.lit(1.0)))


def blast_radius(g: Graph, lists: bool = False) -> DataFrame:
    """(ix, n_direct, n_indirect, n_total, severity), and the sorted ids direct and indirect if lists."""
    name = g.nodes.select(F.col("ix").alias("o"), F.col("id").alias("oid"))
    sides = []
    for side, pairs in (("direct", direct(g)), ("indirect", indirect(g))):
        aggs = [F.count(F.lit(1)).alias(f"n_{side}")]
        if lists:
            pairs = pairs.join(name, F.col("other") == F.col("o"))
            aggs.append(F.array_sort(F.collect_list("oid")).alias(side))
        sides.append(pairs.groupBy("ix").agg(*aggs))
    out = g.nodes.select("ix").join(sides[0], "ix", "left").join(sides[1], "ix", "left").crossJoin(F.broadcast(size_of(g)))
    d, i = F.coalesce("n_direct", F.lit(0)), F.coalesce("n_indirect", F.lit(0))
    return out.select("ix", d.alias("n_direct"), i.alias("n_indirect"), (d + i).alias("n_total"), severity_of(d, i, F.col("n")).alias("severity"), *(["direct", "indirect"] if lists else []))


def dependency_depth(g: Graph) -> DataFrame:
    """(ix, depth): steps to the nearest node without out-edges; 0 if none can be reached."""
    sinks = g.nodes.select("ix").join(g.edges.select(F.col("src").alias("ix")).distinct(), "ix", "left_anti")
    # one search from all sinks together: a source of its own would keep a row for each pair
    marked = g.edges.select("src", "dst").union(sinks.select(F.col("ix").alias("src"), F.lit(-1).cast("long").alias("dst")))
    near = distances(marked, g.nodes.sparkSession.range(1).selectExpr("-1L AS s"), backward=True).filter("t >= 0")
    return g.nodes.select("ix").join(near.select(F.col("t"), (F.col("d") - 1).alias("k")), F.col("ix") == F.col("t"), "left").select("ix", F.coalesce("k", F.lit(0)).cast("long").alias("depth"))


def high_impact(g: Graph, most: int = 10) -> DataFrame:
    """The `most` nodes of greatest severity, ties by ix."""
    return blast_radius(g).orderBy(F.desc("severity"), "ix").limit(most)


def deep_dependencies(g: Graph, least: int) -> DataFrame:
    return dependency_depth(g).filter(F.col("depth") >= least)


