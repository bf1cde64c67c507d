"""Composites over robustly scaled measures, cut points and bridges, and lookups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.operators import centrality, quality
from grovemap.operators.graph import Graph, with_degrees
from grovemap.operators.primitives import components
from grovemap.operators.report import robust_units


def _low_links(nodes: list[int], near: dict[int, list[tuple[int, int]]]) -> tuple[set[int], set[int]]:
    """Cut points, and numbers of bridge edges, by depth-first search with a stack of its own."""
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    cuts, bridges = set(), set()
    for root in nodes:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack, children = [(root, -1, iter(near[root]))], 0
        while stack:
            v, came, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] > order[p]:
                        bridges.add(came)
                    if p == root:
                        children += 1
                    elif low[v] >= order[p]:
                        cuts.add(p)
                continue
            u, e = step
            if e == came:
                continue
            if u in order:
                low[v] = min(low[v], order[u])
            else:
                order[u] = low[u] = len(order)
                stack.append((u, e, iter(near[u])))
        if children > 1:
            cuts.add(root)
    return cuts, bridges


def _searched_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cut_points() of rows (component, ix, dst, eix) in the order of components; those that end in a batch are searched together."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts)
        node = held["dst"].is_null().to_numpy()
        ix = held["ix"].to_numpy()
        nodes, near = np.sort(ix[node]).tolist(), {}
        for v in nodes:
            near[v] = []
        ends = {}
        for a, b, e in zip(ix[~node].tolist(), held["dst"].drop_null().to_pylist(), held["eix"].drop_null().to_pylist()):
            near[a].append((b, e))
            near[b].append((a, e))
            ends[e] = (a, b)
        cuts, bridges = _low_links(nodes, near)
        on = {v for e in bridges for v in ends[e]}
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([v in cuts for v in nodes], pa.bool_()), pa.array([v in on for v in nodes], pa.bool_())], ["ix", "articulation", "bridge"])

    parts: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        component = batch["component"].to_numpy()
        if parts and parts[-1]["component"][-1].as_py() != component[0]:
            yield found(parts)
            parts = []
        # the last component may go on in the next batch
        whole = int(np.searchsorted(component, component[-1]))
        if whole:
            yield found([*parts, batch.slice(0, whole)])
            parts = []
        parts.append(batch.slice(whole))
    if parts:
        yield found(parts)


def cut_points(g: Graph) -> DataFrame:
    """(ix, articulation, bridge): whether taking the node, or one of its edges, would split its weakly connected component. Parallel edges are no bridges. A component is searched in one task, which takes those of a batch of rows together, so that very many small ones cost no more than their rows."""
    part = components(g.nodes, g.edges)
    links = g.edges.filter("src != dst").select(F.col("src").alias("ix"), "dst", "eix").join(part, "ix")
    rows = part.select("component", "ix", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("eix")).unionByName(links.select("component", "ix", "dst", "eix"))
    return rows.repartition("component").sortWithinPartitions("component").mapInArrow(_searched_whole, "ix long, articulation boolean, bridge boolean")


def planned_composites(g: Graph, extra: DataFrame | None = None) -> DataFrame:
    """(ix, importance, chokepoint, risk, payoff) from measures scaled between their 1 % and 99 % quantiles; payoff is risk times importance. extra: (ix, churn, owners, coverage), 0 where missing."""
    calls = Graph(g.nodes, g.edges.filter("edge_type = 'calls'"))
    imports = Graph(g.nodes, g.edges.filter("edge_type = 'imports'"))
    values = {
        "pri": centrality.pagerank(imports).withColumnRenamed("pagerank", "value"), "prc": centrality.pagerank(calls).withColumnRenamed("pagerank", "value"), "kcore": centrality.core_numbers(g).select("ix", F.col("k_core").cast("double").alias("value")), "indeg": with_degrees(imports).select("ix", F.col("d_in").cast("double").alias("value")),
        "clustering": centrality.clustering(g).withColumnRenamed("clustering", "value"), "btwn": centrality.betweenness_v2(g).withColumnRenamed("betweenness", "value"), "complexity": quality.cyclomatic_v1(g).withColumnRenamed("cyclomatic", "value"),
    }
    given = g.nodes.select("ix") if extra is None else g.nodes.select("ix").join(extra, "ix", "left")
    for c in ("churn", "owners", "coverage"):
        values[c] = given.select("ix", (F.coalesce(c, F.lit(0.0)) if extra is not None and c in extra.columns else F.lit(0.0)).alias("value"))
    rows = g.nodes.select("ix").join(cut_points(g), "ix")
    for name, df in values.items():
        rows = rows.join(df.withColumnRenamed("value", name), "ix")
    # written once, so that no measure is computed for its quantiles and again for its rows
    rows = robust_units(cut(rows, "measures"), list(values))
    flag = lambda c: F.col(c).cast("double")
    c = F.col
    out = rows.withColumn("importance", 0.35 * c("pri") + 0.25 * c("prc") + 0.15 * c("kcore") + 0.10 * c("indeg") + 0.15 * c("clustering")).withColumn("chokepoint", 0.6 * c("btwn") + 0.2 * flag("articulation") + 0.2 * flag("bridge"))
    out = out.withColumn("risk", 0.30 * c("churn") + 0.25 * c("complexity") + 0.20 * c("owners") + 0.15 * c("chokepoint") + 0.10 * (1 - c("coverage")))
    return out.select("ix", "importance", "chokepoint", "risk", (c("risk") * c("importance")).alias("payoff"))


def node_metrics(scores: DataFrame, path: str) -> DataFrame:
    """The row of scores (path, ...) at a path."""
    return scores.filter(F.col("path") == path)


def top_by(scores: DataFrame, metric: str, k: int) -> DataFrame:
    """The k rows of the greatest value of a measure, ties by path."""
    return scores.orderBy(F.desc(metric), "path").limit(k)
