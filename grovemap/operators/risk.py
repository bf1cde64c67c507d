"""Risk scores, chokepoints, cycles, debt and change propagation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.functions.exprs import clamp, finite
from grovemap.operators.centrality import size_of
from grovemap.operators.graph import Graph, triplets, with_degrees
from grovemap.operators.primitives import SEARCHED, Searches, all_distances, distances, is_small, searched, strong_components, walked

COMPLEX, BOTTLENECK, COUPLED, CYCLES = 15.0, 5, 10, 100
#: Depth from which on debt grows no more.
DEEP = 10
#: Places that a task visits for each node, and besides, before the rest of its nodes is left to searches from the roots.
_SPENT, _SPARE = 1 << 12, 1 << 26


def _estimate(node_type: Column, outs: Column, caps: bool) -> Column:
    cap = lambda x, top: F.least(x, F.lit(top)) if caps else x
    return F.when(node_type.isin("function", "method"), cap(outs + 1.0, 50.0)).when(node_type == "class", cap(outs * 2.0, 100.0)).when(node_type.isin("file", "module"), cap(F.sqrt(outs) * 5.0, 50.0)).otherwise(F.lit(1.0))


def _parts(g: Graph, caps: bool) -> DataFrame:
    d = with_degrees(g).crossJoin(F.broadcast(size_of(g)))
    total = F.col("d_in") + F.col("d_out")
    return d.select(
        "ix", "d_in", "d_out", total.alias("total"), "n",
        F.least(_estimate(F.col("node_type"), F.col("d_out").cast("double"), caps) / COMPLEX, F.lit(1.0)).alias("complexity"),
        F.least(total / F.greatest("n", F.lit(1)), F.lit(1.0)).alias("centrality"),
        F.when((F.col("d_in") > BOTTLENECK) & (F.col("d_out") > BOTTLENECK), 0.5).otherwise(0.0).alias("bottleneck"),
    )


def risk_v1(g: Graph) -> DataFrame:
    return _parts(g, False).select("ix", clamp(0.4 * F.col("complexity") + 0.4 * F.col("centrality") + 0.2 * F.col("bottleneck")).alias("risk"), "complexity", "centrality", "bottleneck")


def risk_v2(g: Graph) -> DataFrame:
    coupling = F.when(F.col("total") > COUPLED, F.least((F.col("total") - COUPLED) / F.lit(10.0), F.lit(1.0))).otherwise(0.0)
    p = _parts(g, True).withColumn("coupling", coupling)
    return p.select("ix", clamp(0.3 * F.col("complexity") + 0.3 * F.col("centrality") + 0.2 * F.col("bottleneck") + 0.2 * F.col("coupling")).alias("risk"), "complexity", "centrality", "bottleneck", "coupling")


def chokepoint_v1(g: Graph) -> DataFrame:
    """(ix, chokepoint): balance of in and out times connections over n."""
    i, o = F.col("d_in"), F.col("d_out")
    score = F.least(F.least(i, o) / F.greatest(i, o, F.lit(1)) * ((i + o) / F.col("n")), F.lit(1.0))
    return with_degrees(g).crossJoin(F.broadcast(size_of(g))).select("ix", F.when((i > 0) & (o > 0), score).otherwise(0.0).alias("chokepoint"))


def chokepoint_v2(g: Graph) -> DataFrame:
    """(ix, chokepoint) of nodes with many edges in or out, above 0.1."""
    part = lambda c: F.least(F.col(c) / F.lit(2.0 * BOTTLENECK), F.lit(1.0))
    return with_degrees(g).filter((F.col("d_in") > BOTTLENECK) | (F.col("d_out") > BOTTLENECK)).select("ix", F.sqrt(part("d_in") * part("d_out")).alias("chokepoint")).filter("chokepoint > 0.1")


def cycles(g: Graph, most: int | None = CYCLES) -> DataFrame:
    """(scc, members, n): strongly connected components of two or more nodes with their sorted ids, the first `most` by scc."""
    named = strong_components(g.nodes, g.edges).join(g.nodes.select("ix", "id"), "ix").groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("n"))
    return named if most is None else named.orderBy("scc").limit(most)


def _nested(up: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(at, size) of the places of trees, given level after level by where each hangs: b hangs below a if at[a] <= at[b] < at[a] + size[a]."""
    bounds = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    levels = [slice(a, b) for a, b in zip(bounds, bounds[1:])]
    size = np.ones(len(up), np.int64)
    for level in levels[:0:-1]:
        np.add.at(size, up[level], size[level])
    at = np.zeros(len(up), np.int64)
    for level in levels:
        above, before = up[level], np.cumsum(size[level]) - size[level]
        if level.start:
            # those that hang on one place stand side by side
            head = np.maximum.accumulate(np.where(np.concatenate([[True], above[1:] != above[:-1]]), np.arange(len(above)), 0))
            before += at[above] + 1 - before[head]
        at[level] = before
    return at, size


def _deepest(search: Searches, starts: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    """(ix, depth): for each node the greatest distance, plus 1, from one of starts to a predecessor of the node, in the graph without the node.

    A path of the search's tree passes through the node only if the
    predecessor hangs below it. Only for such nodes the search is made again
    without them; for all others the distances in the whole graph serve.
    """
    best, n = np.zeros(len(names), np.int64), search.n
    for piece, (slot, node, up, sizes, _) in search.each(starts):
        d = np.repeat(np.arange(len(sizes)), sizes)
        at, size = _nested(up, sizes)
        place = slot * n + node
        search.marks[place] = np.arange(len(place), dtype=np.int32)
        again = []
        for owner, v in search.follow(node):
            key = slot[owner] * n + v
            top = search.marks[key]
            below = (d[top] < d[owner]) & (at[top] <= at[owner]) & (at[owner] < at[top] + size[top])
            np.maximum.at(best, v[~below], d[owner[~below]] + 1)
            again.append(np.unique(key[below]))
        search.marks[place] = 0
        again = np.unique(np.concatenate(again)) if again else np.zeros(0, np.int32)
        for part, (*_, last) in search.each(starts[piece][again // n], again % n):
            np.maximum.at(best, again[part] % n, last)
    yield names[best > 0], best[best > 0]


def _witnessed(down: Searches, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, at, size) of all nodes: the distance from the first of roots that reaches the node, or -1, and its place in a tree of that root's shortest paths, as in _nested(). In linear time but for the nodes that are labelled again, few if roots are in random order.

    All nodes on a path from that root to the node have the same first root,
    so that one search from all roots at once, within labels, gives distances
    in the whole graph.
    """
    n = down.n
    label = np.full(n, len(roots), np.int64)
    label[roots] = np.arange(len(roots))
    front = roots
    while len(front):
        moved = []
        for owner, v in down.follow(front):
            new = label[front[owner]]
            less = new < label[v]
            np.minimum.at(label, v[less], new[less])
            moved.append(v[less])
        front = np.unique(np.concatenate(moved))
    level, node, up = np.full(n, -1, np.int64), roots, np.full(len(roots), -1, np.int64)
    level[roots] = 0
    parts, sizes, total = [], [], 0
    while len(node):
        parts.append((node, up))
        sizes.append(len(node))
        found = [(node[:0], up[:0])]
        for owner, v in down.follow(node):
            new = np.flatnonzero((level[v] < 0) & (label[v] == label[node[owner]]))
            # of several edges to one node the first, in the order of the level
            new = new[np.sort(np.unique(v[new], return_index=True)[1])]
            level[v[new]] = len(sizes)
            found.append((v[new], owner[new] + total))
        total += len(node)
        node, up = (np.concatenate(x) for x in zip(*found))
    node, up = (np.concatenate(x) for x in zip(*parts))
    at, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at[node], size[node] = _nested(up, np.array(sizes))
    return level, at, size


def _deep_or_not(search: Searches, starts: np.ndarray, names: np.ndarray, top: int, each: int, spare: int) -> Iterator[tuple]:
    """(ix, depth): as _deepest() for the nodes starts, where depths of top and more are top; search runs against the edges, loops included. -1 for what is left once so many places for each node, and spare ones, are visited.

    One root at a distance of top - 1 or more from a predecessor, by a path
    that doesn't pass through the node, is enough. For most deep nodes the
    trees of _witnessed() have one. For others the roots are searched for
    from each predecessor, without the node, until one is far enough.
    """
    n, p = search.n, search.to
    v = np.repeat(np.arange(n, dtype=np.int32), np.diff(search.first))
    root = np.diff(search.first) == 0
    if not root.any():
        return
    down = Searches(np.concatenate([[0], np.cumsum(np.bincount(p, minlength=n))]), v[np.argsort(p, kind="stable")])
    roots, best = np.random.default_rng(0).permutation(np.flatnonzero(root)), np.zeros(n, np.int64)
    for order in (roots, roots[::-1]):
        level, at, size = _witnessed(down, order)
        below = (at[v] <= at[p]) & (at[p] < at[v] + size[v])
        best[v[(level[p] >= top - 1) & ~below & (p != v)]] = top
    # what no root reaches leads to none
    kept = level[p] >= 0
    back = Searches(np.concatenate([[0], np.cumsum(np.bincount(v[kept], minlength=n))]), p[kept])
    back.goal, back.least = root, top - 1
    some = starts[best[starts] < top]
    lanes = [(u, some[owner]) for owner, u in back.follow(some)]
    source, barred = (np.concatenate(x) for x in zip(*lanes)) if lanes else (some, some)
    source, barred = source[source != barred], barred[source != barred]
    done, spent, most = 0, 0, each * len(starts) + spare
    for piece, (slot, node, _, sizes, _) in back.each(source, barred) if most else ():
        met = root[node]
        np.maximum.at(best, barred[piece][slot[met]], np.minimum(np.repeat(np.arange(len(sizes)), sizes)[met] + 1, top))
        done, spent = piece.stop, spent + len(node)
        if spent > most:
            break
    left = barred[done:]
    best[left[best[left] < top]] = -1
    starts = starts[best[starts] != 0]
    yield names[starts], best[starts]


def max_root_depth(g: Graph, top: int | None = None) -> DataFrame:
    """(ix, depth): the longest of the shortest paths from nodes without in-edges to the node, by way of each of its predecessors, none of which may pass through the node itself; 0 without such a root. With top, depths beyond it may be any that are no less.

    For a node on no cycle no path to a predecessor can pass through it, so
    that distances in the whole graph serve.
    """
    ins = g.edges.select(F.col("dst").alias("ix")).distinct()
    roots = cut(g.nodes.select("ix").join(ins, "ix", "left_anti").selectExpr("ix AS s"), "roots")
    if roots.isEmpty():
        return g.nodes.selectExpr("ix", "0L AS depth")
    # with loops, as a root has no in-edge at all
    against = cut(g.edges.selectExpr("dst AS ea", "src AS eb").distinct(), "against")
    steps = against.filter("ea != eb").selectExpr("eb AS ea", "ea AS eb")
    if is_small(steps, times=SEARCHED):
        deepest, budget = None, (_SPENT, _SPARE)
        if top is not None:
            deepest = cut(searched(against, against.selectExpr("ea AS s"), lambda *x: _deep_or_not(*x, top, *budget), "v long, depth long"), "deep")
        if deepest is None or not (left := deepest.filter("depth < 0")).isEmpty():
            full = searched(steps, roots, _deepest, "v long, depth long").groupBy("v").agg(F.max("depth").alias("depth"))
            deepest = full if deepest is None else full.join(left.select("v"), "v", "left_semi").unionByName(deepest.filter("depth > 0"))
    else:
        far = cut(distances(g.edges, roots), "far")
        deepest = steps.join(far.groupBy("t").agg(F.max("d").alias("far")), F.col("ea") == F.col("t")).groupBy("eb").agg((F.max("far") + 1).cast("long").alias("depth")).withColumnRenamed("eb", "v")
        knots = cut(strong_components(g.nodes, g.edges).selectExpr("ix AS v"), "knots")
        # each knot with each root that reaches it, and never into the knot
        start = knots.join(far, F.col("v") == F.col("t")).selectExpr("v AS barred", "s", "s AS t")
        exact = walked(steps, start, None, True).join(steps, (F.col("t") == F.col("ea")) & (F.col("barred") == F.col("eb"))).groupBy("barred").agg((F.max("d") + 1).cast("long").alias("depth"))
        deepest = deepest.join(knots, "v", "left_anti").unionByName(exact.withColumnRenamed("barred", "v"))
    return g.nodes.select("ix").join(deepest, F.col("ix") == F.col("v"), "left").select("ix", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def technical_debt(g: Graph) -> DataFrame:
    """(ix, debt): mean of coupling, depth and size debt."""
    methods = triplets(g).filter("dst_type = 'method'").groupBy("src").agg(F.count(F.lit(1)).alias("methods"))
    d = with_degrees(g).join(max_root_depth(g, DEEP), "ix").join(methods, F.col("ix") == F.col("src"), "left")
    tenth = lambda c, unit: F.least(c / F.lit(unit), F.lit(1.0))
    size = F.when(F.col("node_type").isin("file", "module"), tenth(F.col("d_out"), 20.0)).when(F.col("node_type") == "class", tenth(F.coalesce("methods", F.lit(0)), 15.0)).otherwise(0.0)
    return d.select("ix", ((tenth(F.col("d_out"), 10.0) + tenth(F.col("depth"), float(DEEP)) + size) / 3).alias("debt"))


def change_propagation(g: Graph) -> DataFrame:
    """(ix, propagation): (in-edges + half the pushes of a search against the edges, rounded down) over n.

    The search visits nodes by distance, then ix; a push is an in-edge of a
    visited node whose source comes later in that order. So pushes are counted
    from distances, without a search for each node.
    """
    pairs = cut(all_distances(g.nodes, g.edges, backward=True), "pairs")
    seen = pairs.select(F.col("s").alias("v"), F.col("t").alias("c"), F.col("d").alias("dc"))
    hop = seen.join(g.edges.select("src", "dst"), F.col("c") == F.col("dst")).join(pairs.select(F.col("s").alias("v2"), F.col("t").alias("u"), F.col("d").alias("du")), (F.col("v") == F.col("v2")) & (F.col("src") == F.col("u")))
    pushes = hop.filter((F.col("du") > F.col("dc")) | ((F.col("du") == F.col("dc")) & (F.col("u") > F.col("c")))).groupBy("v").agg(F.count(F.lit(1)).alias("pushes"))
    d = with_degrees(g).join(pushes, F.col("ix") == F.col("v"), "left").crossJoin(F.broadcast(size_of(g)))
    return d.select("ix", clamp((F.col("d_in") + F.floor(F.coalesce("pushes", F.lit(0)) / 2)) / F.col("n")).alias("propagation"))


def percentile_rank(values: DataFrame) -> DataFrame:
    """(ix, rank) of values (ix, value): smaller finite values over all finite ones; 0 for others."""
    ok = values.filter(finite(F.col("value")))
    counts = ok.groupBy("value").agg(F.count(F.lit(1)).alias("c"))
    # one row for each distinct value

    below = counts.select("value", F.coalesce(F.sum("c").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("c").over(Window.partitionBy()).alias("n"))
    ranks = ok.join(below, "value").select(F.col("ix").alias("rx"), (F.col("below") / F.col("n")).alias("rank"))
    return values.join(ranks, F.col("ix") == F.col("rx"), "left").select("ix", F.coalesce("rank", F.lit(0.0)).alias("rank"))
