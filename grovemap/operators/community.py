"""Communities: local moving by modularity gain, and measures of a partition."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemap.functions.exprs import clamp, finite, ratio
from grovemap.operators.graph import Graph
from grovemap.operators.primitives import components


def weight_v1(w: Column) -> Column:
    return F.when(finite(w) & (w > 0), w).otherwise(1.0)


def weight_v2(w: Column) -> Column:
    return F.when(finite(w) & (w >= 0), w).otherwise(1.0)


def _move_v1(nodes: list[int], edges: list[tuple[int, int, float]], m: float, gamma: float, sweeps: int, compat: bool) -> dict[int, int]:
    """Sequential moves in ix order; of equal gains the least community. compat: a move pays if joining pays, whatever the node leaves; else it must pay more than staying does."""
    near: dict[int, list[tuple[int, float]]] = {v: [] for v in nodes}
    loops = dict.fromkeys(nodes, 0.0)
    for a, b, w in edges:
        if a == b:
            loops[a] += w
            continue
        near[a].append((b, w))
        near[b].append((a, w))
    own = {v: sum(max(w, 0.0) for _, w in near[v]) + 2 * max(loops[v], 0.0) for v in nodes}
    home = {v: v for v in nodes}
    # weight of the edges that touch each community
    touch = {v: sum(w for _, w in near[v]) + loops[v] for v in nodes}
    for _ in range(sweeps):
        moved = False
        for v in nodes:
            here = home[v]
            inside: dict[int, float] = {}
            raw: dict[int, float] = {}
            for u, w in near[v]:
                inside[home[u]] = inside.get(home[u], 0.0) + max(w, 0.0)
                raw[home[u]] = raw.get(home[u], 0.0) + w
            every = sum(raw.values()) + loops[v]
            rest = touch[here] - (every - raw.get(here, 0.0))
            gain = lambda c, t: inside.get(c, 0.0) / m - gamma * t * own[v] / (m * m)
            best, top = here, 0.0 if compat else max(0.0, gain(here, rest))
            for c in sorted(inside):
                if c != here and gain(c, touch[c]) > top:
                    best, top = c, gain(c, touch[c])
            if best != here:
                home[v] = best
                touch[here] = rest
                touch[best] += every - raw.get(best, 0.0)
                moved = True
        if not moved:
            break
    return home


def _move_v2(nodes: list[int], edges: list[tuple[int, int, float]], m: float, gamma: float, sweeps: int, compat: bool) -> dict[int, int]:
    near: dict[int, list[tuple[int, float]]] = {v: [] for v in nodes}
    for a, b, w in edges:
        near[a].append((b, abs(w)))
        near[b].append((a, abs(w)))
    own = {v: sum(w for _, w in near[v]) for v in nodes}
    home, touch = {v: v for v in nodes}, dict(own)
    for _ in range(sweeps):
        moved = False
        for v in nodes:
            here = home[v]
            best, gain = here, 1e-6
            for c in sorted({home[u] for u, _ in near[v] if home[u] != here}):
                to, out = touch.get(c, 0.0), touch.get(here, 0.0)
                g = max(-1.0, min(1.0, (to - out) / m + gamma * own[v] * (out - to) / (m * m)))
                if g > gain:
                    best, gain = c, g
            if best != here:
                home[v] = best
                touch[here] -= own[v]
                touch[best] = touch.get(best, 0.0) + own[v]
                moved = True
        if not moved:
            break
    return home


def louvain(g: Graph, version: int = 1, resolution: float = 1.0, sweeps: int = 100, compat: bool = False) -> DataFrame:
    """(ix, community): one level of local moving, communities numbered from 0 by their least ix.

    Moves are sequential by nature. No move crosses a weakly connected
    component, so that each of them is one group; the total weight alone is
    shared. A graph without weight leaves each node on its own. compat: version
    1 compares a move with nothing instead of with staying, as it first did.
    """
    fixed = (weight_v1 if version == 1 else weight_v2)(F.coalesce("weight", F.lit(1.0)))
    total = g.edges.agg(F.sum(fixed)).first()[0] or 0.0
    if total <= 0:
        return singletons(g)
    gamma = resolution if version == 1 else min(10.0, max(0.1, resolution))
    part = components(g.nodes, g.edges)
    rows = part.select("component", "ix", F.lit(None).cast("long").alias("dst"), F.lit(0.0).alias("w")).unionByName(g.edges.select(F.col("src").alias("ix"), "dst", F.when(finite(F.col("weight")), F.col("weight")).otherwise(0.0).alias("w")).join(part, "ix").select("component", "ix", "dst", "w"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted(group.loc[group["dst"].isna(), "ix"].tolist())
        real = group[group["dst"].notna()]
        edges = list(zip(real["ix"].tolist(), real["dst"].astype("int64").tolist(), real["w"].tolist()))
        home = (_move_v1 if version == 1 else _move_v2)(nodes, edges, float(total), gamma, sweeps, compat)
        first: dict[int, int] = {}
        for v in nodes:
            first.setdefault(home[v], v)
        return pd.DataFrame({"ix": nodes, "c": [first[home[v]] for v in nodes]})

    return renumber(rows.groupBy("component").applyInPandas(run, "ix long, c long"))


def renumber(parts: DataFrame) -> DataFrame:
    """(ix, community) of (ix, c) with contiguous numbers from 0 in the order of c."""
    order = parts.select("c").distinct().withColumn("community", (F.row_number().over(Window.orderBy("c")) - 1).cast("long"))
    return parts.join(order, "c").select("ix", "community")


def singletons(g: Graph) -> DataFrame:
    return renumber(g.nodes.select("ix", F.col("ix").alias("c")))


def _ends(g: Graph, parts: DataFrame) -> DataFrame:
    c = lambda side: parts.select(F.col("ix").alias(side), F.col("community").alias(f"{side}_c"))
    return g.edges.join(c("src"), "src").join(c("dst"), "dst")


def modularity_v1(g: Graph, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(modularity): weight inside communities over m, less resolution times the squared weighted degrees over m squared."""
    e = _ends(g, parts).withColumn("w", weight_v1(F.col("weight")))
    inside = e.agg(F.sum(F.when(F.col("src_c") == F.col("dst_c"), F.col("w"))).alias("inside"), F.sum("w").alias("m"))
    deg = e.selectExpr("explode(array(struct(src AS v, w), struct(dst AS v, w))) AS e").groupBy("e.v").agg(F.sum("e.w").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    return inside.crossJoin(deg).select((ratio(F.coalesce("inside", F.lit(0.0)), F.coalesce("m", F.lit(0.0))) - resolution * ratio(F.coalesce("k2", F.lit(0.0)), F.coalesce(F.col("m") * F.col("m"), F.lit(0.0)))).alias("modularity"))


def modularity_v2(g: Graph, parts: DataFrame) -> DataFrame:
    e = _ends(g, parts).withColumn("w", weight_v2(F.col("weight")))
    return e.agg(F.sum(F.when(F.col("src_c") == F.col("dst_c"), F.abs("weight"))).alias("inside"), F.sum("w").alias("m")).select(clamp(2 * ratio(F.coalesce("inside", F.lit(0.0)), F.coalesce("m", F.lit(0.0)))).alias("modularity"))


def clusters(g: Graph, parts: DataFrame) -> DataFrame:
    """(community, n, members) by falling size, then number."""
    return parts.join(g.nodes.select("ix", "id"), "ix").groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("id")).alias("members")).orderBy(F.desc("n"), "community")


def boundary(g: Graph, parts: DataFrame) -> DataFrame:
    """(ix, boundary): share of the node's edge ends that lead out of its community."""
    e = _ends(g, parts).select("src", "dst", (F.col("src_c") != F.col("dst_c")).alias("out"))
    ends = e.selectExpr("explode(array(struct(src AS v, out), struct(dst AS v, out))) AS e").groupBy("e.v").agg(F.count_if("e.out").alias("x"), F.count(F.lit(1)).alias("k"))
    return g.nodes.select("ix").join(ends, F.col("ix") == F.col("v"), "left").select("ix", F.coalesce(F.col("x") / F.col("k"), F.lit(0.0)).alias("boundary"))
