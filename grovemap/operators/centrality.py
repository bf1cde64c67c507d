"""Centrality of nodes in a directed multigraph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.functions.exprs import clamp, ratio
from grovemap.operators.graph import Graph, degrees
from grovemap.operators.primitives import SEARCHED, Searches, distances, in_one_task, is_small, level_runs, level_sizes, place_of, searched

#: Rounds of a loop between two cuts of its lineage.
CUT_EVERY = 6


def size_of(g: Graph) -> DataFrame:
    return g.nodes.agg(F.count(F.lit(1)).alias("n"))


def degree_v1(g: Graph) -> DataFrame:
    """(ix, in_degree, out_degree, degree) over n - 1, not clamped; no row if n <= 1."""
    out = degrees(g).crossJoin(F.broadcast(size_of(g))).filter("n > 1").withColumn("m", (F.col("n") - 1).cast("double"))
    return out.select("ix", (F.col("d_in") / F.col("m")).alias("in_degree"), (F.col("d_out") / F.col("m")).alias("out_degree"), ((F.col("d_in") / F.col("m") + F.col("d_out") / F.col("m")) / 2).alias("degree"))


def degree_v2(g: Graph) -> DataFrame:
    """As degree_v1, each clamped to 0..1, the total over 2 (n - 1)."""
    out = degrees(g).crossJoin(F.broadcast(size_of(g))).filter("n > 1").withColumn("m", (F.col("n") - 1).cast("double"))
    total = (F.col("d_in") + F.col("d_out")) / (2 * F.col("m"))
    return out.select("ix", clamp(F.col("d_in") / F.col("m")).alias("in_degree"), clamp(F.col("d_out") / F.col("m")).alias("out_degree"), clamp(total).alias("degree"))


def pagerank(g: Graph, rounds: int = 30, damping: float = 0.85, tolerance: float | None = None) -> DataFrame:
    """(ix, pagerank): rounds of (1 - d) / n + d * sum of rank / out-degree over in-edges; rank of nodes without out-edges isn't passed on.

    tolerance: clamp to 0..1 and stop once no rank moves by as much; without
    it all rounds are made. Edges carry their share, so that a round is one
    join and one aggregation, both on the same key.
    """
    outs = g.edges.groupBy("src").agg(F.count(F.lit(1)).alias("outs"))
    # parallel edges fold into one with their number
    shares = cut(g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("many")).join(outs, "src").select("src", "dst", (F.col("many") / F.col("outs")).alias("share")), "shares")
    rank = cut(g.nodes.select("ix"), "rank")
    n = rank.count()
    if not n:
        return g.nodes.selectExpr("ix", "0d AS pagerank").limit(0)
    base = (1 - damping) / n
    if is_small(shares, rank):

        def solve(ix, src, dst, share):
            r = np.full(len(ix), 1.0 / len(ix))
            for _ in range(rounds):
                new = base + damping * np.bincount(dst, r[src] * share, len(ix))
                new = new if tolerance is None else np.clip(new, 0.0, 1.0)
                moved, r = np.abs(new - r).max(), new
                if tolerance is not None and moved < tolerance:
                    break
            return {"ix": ix, "pagerank": r}

        return in_one_task(rank, shares.withColumnRenamed("share", "w"), solve, "ix long, pagerank double")
    every, rank, last = rank, rank.withColumn("r", F.lit(1.0 / n)), None
    for i in range(1, rounds + 1):
        got = rank.selectExpr("ix AS rx", "r AS rr").join(shares, F.col("rx") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rr") * F.col("share")).alias("got"))
        new = F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        if tolerance is None:
            # the list of nodes stands on the left, not the rank before, so that a round names it once
            rank = every.join(got, F.col("ix") == F.col("dst"), "left").select("ix", new.alias("r"))
            if i % CUT_EVERY == 0 or i == rounds:
                rank = last = cut(rank, "rank", last)
            continue
        step = rank.join(got, F.col("ix") == F.col("dst"), "left")
        last = cut(step.select("ix", clamp(new).alias("r"), F.abs(clamp(new) - F.col("r")).alias("moved")), "rank", last)
        rank = last.select("ix", "r")
        if last.agg(F.max("moved")).first()[0] < tolerance:
            break
    return rank.select("ix", F.col("r").alias("pagerank"))


def _sampled(g: Graph, count: int, above: int) -> tuple[DataFrame, int, int]:
    """Sources (s), their number and n: all nodes up to `above`, beyond that `count` of them at equal steps of ix order."""
    n = g.nodes.count()
    if n <= above:
        return g.nodes.selectExpr("ix AS s"), n, n
    step = max(1, n // count)
    order = place_of(g.nodes.select("ix"), "ix")
    return order.filter((F.col("at") % step == 0) & (F.col("at") / step < count)).selectExpr("ix AS s"), count, n


def betweenness_v1(g: Graph, samples: int = 50, above: int = 100) -> DataFrame:
    """(ix, betweenness): reach-based. Up to `above` nodes: the sum over other nodes s that reach the node of (reach of s - 1); beyond: the number of sampled sources that reach it, itself included. Over (n - 1)(n - 2); 0 if n <= 2."""
    sources, count, n = _sampled(g, samples, above)
    if n <= 2:
        return g.nodes.selectExpr("ix", "0d AS betweenness")
    pairs = distances(g.edges, sources)
    if n <= above:
        pairs = cut(pairs, "pairs")
        reach = pairs.filter("s != t").groupBy("s").agg((F.count(F.lit(1)) - 1).alias("w"))
        score = pairs.filter("s != t").join(reach, "s").groupBy("t").agg(F.sum("w").alias("b"))
    else:
        score = pairs.groupBy("t").agg(F.count(F.lit(1)).alias("b"))
    return g.nodes.select("ix").join(score, F.col("ix") == F.col("t"), "left").select("ix", (F.coalesce("b", F.lit(0)) / F.lit(float((n - 1) * (n - 2)))).alias("betweenness"))


def _farther(search: Searches, starts: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    """(t, b): for each node the number of nodes farther from a start than the node, summed over starts; in one array, without a row for each pair."""
    b = np.zeros(len(names))
    for _, (slot, node, _, sizes, _) in search.each(starts):
        s, d, n = level_runs(slot, sizes)
        order = np.argsort(s, kind="stable")
        far = np.zeros(len(n), np.int64)
        far[order] = np.bincount(slot).cumsum()[s[order]] - n[order].cumsum()
        far[d == 0] = 0
        b += np.bincount(node, np.repeat(far, n), len(names))
    yield names[b > 0], b[b > 0].astype(np.int64)


def betweenness_v2(g: Graph, samples: int = 1000, use_sampling: bool = False) -> DataFrame:
    """(ix, betweenness): for each source the number of nodes farther from it than the node, summed and divided by the largest sum. use_sampling: over `samples` sources of a graph that has more nodes, instead of over all."""
    sources = _sampled(g, samples, samples)[0] if use_sampling else g.nodes.selectExpr("ix AS s")
    steps = cut(g.edges.selectExpr("src AS ea", "dst AS eb").distinct(), "steps")
    if is_small(steps, times=SEARCHED):
        score = searched(steps, sources, _farther, "t long, b long")
    else:
        pairs = cut(distances(g.edges, sources), "pairs")
        # per source and distance first, so that the window sees a row for each level
        levels = pairs.groupBy("s", "d").agg(F.count(F.lit(1)).alias("c"))
        farther = levels.select("s", "d", F.coalesce(F.sum("c").over(Window.partitionBy("s").orderBy("d").rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("w"))
        score = pairs.filter("s != t").join(farther, ["s", "d"]).selectExpr("t", "w AS b")
    score = cut(score.groupBy("t").agg(F.sum("b").alias("b")), "between")
    top = score.agg(F.max("b").alias("top"))
    return g.nodes.select("ix").join(score, F.col("ix") == F.col("t"), "left").crossJoin(F.broadcast(top)).select("ix", ratio(F.coalesce("b", F.lit(0)), F.coalesce("top", F.lit(0))).alias("betweenness"))


def closeness(g: Graph, normalised: bool = False) -> DataFrame:
    """(ix, closeness): nodes reached over the sum of their distances; 0 if none, 1 if the graph has one node. normalised: clamped and divided by the largest."""
    sizes = level_sizes(g.nodes, g.edges).filter("d > 0").withColumnRenamed("n", "many")
    sums = sizes.groupBy("s").agg(F.sum("many").alias("k"), F.sum(F.col("d") * F.col("many")).alias("total"))
    out = g.nodes.select("ix").join(sums, F.col("ix") == F.col("s"), "left").crossJoin(F.broadcast(size_of(g)))
    value = F.when(F.col("n") <= 1, F.lit(1.0)).otherwise(ratio(F.coalesce("k", F.lit(0)), F.coalesce("total", F.lit(0))))
    plain = out.select("ix", value.alias("closeness"))
    if not normalised:
        return plain
    one = plain.select("ix", clamp(F.col("closeness")).alias("c"))
    return one.crossJoin(F.broadcast(one.agg(F.max("c").alias("top")))).select("ix", ratio(F.col("c"), F.col("top")).alias("closeness"))


def eigenvector(g: Graph, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(ix, eigenvector): power iteration over out-neighbours with the weight of the last of parallel edges; without edges between two nodes 1/n, and if the iteration breaks down half of the normalised degrees."""
    links = cut(g.edges.groupBy("src", "dst").agg(F.max_by("weight", "eix").alias("w")), "links")
    every = cut(g.nodes.select("ix"), "nodes")
    n = every.count()
    if n <= 1:
        return every.selectExpr("ix", "1d AS eigenvector")
    if links.filter("src != dst").isEmpty():
        return every.select("ix", F.lit(1.0 / n).alias("eigenvector"))
    if is_small(links, every):

        def solve(ix, src, dst, w):
            x, before = np.full(len(ix), 1.0 / len(ix)), 0.0
            for _ in range(rounds):
                raw = np.bincount(src, w * x[dst], len(ix))
                norm = float(np.sqrt((raw * raw).sum()))
                if norm != norm or norm <= 1e-10:
                    return {"ix": ix, "eigenvector": np.full(len(ix), np.nan)}
                x = raw / norm
                if abs(norm - before) < tolerance:
                    break
                before = norm
            return {"ix": ix, "eigenvector": np.abs(x)}

        found = cut(in_one_task(every, links, solve, "ix long, eigenvector double"), "vector")
        return degree_v1(g).select("ix", F.col("degree").alias("eigenvector")) if found.filter("isnan(eigenvector)").head(1) else found
    x, raw, before = every.select("ix", F.lit(1.0 / n).alias("x")), None, 0.0
    for _ in range(rounds):
        got = x.selectExpr("ix AS vx", "x AS vv").join(links, F.col("vx") == F.col("dst")).groupBy("src").agg(F.sum(F.col("w") * F.col("vv")).alias("got"))
        raw = cut(x.join(got, F.col("ix") == F.col("src"), "left").select("ix", F.coalesce("got", F.lit(0.0)).alias("x")), "vector", raw)
        norm = raw.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0]
        if norm is None or norm != norm or norm <= 1e-10:
            return degree_v1(g).select("ix", F.col("degree").alias("eigenvector"))
        x = raw.select("ix", (F.col("x") / F.lit(norm)).alias("x"))
        if abs(norm - before) < tolerance:
            break
        before = norm
    return x.select("ix", F.abs("x").alias("eigenvector"))


def core_numbers(g: Graph) -> DataFrame:
    """(ix, k_core): the greatest k such that the node is in a part of the multigraph where each node has k edge ends or more."""
    left = cut(g.edges.filter("src != dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), "left")
    nodes = cut(g.nodes.select("ix"), "rest")
    k, done = 0, []
    loops = g.edges.filter("src = dst").groupBy("src").agg((2 * F.count(F.lit(1))).alias("own")).select(F.col("src").alias("lx"), "own")
    own = cut(loops, "own")
    if is_small(left, nodes):

        def solve(ix, a, b, w):
            # loops have their own ends as weight of an edge to itself
            deg = np.bincount(a, np.where(a == b, w, 1.0), len(ix)).astype(np.int64) + np.bincount(b[a != b], minlength=len(ix))
            a, b = a[a != b], b[a != b]
            core, rest, k = np.zeros(len(ix), np.int64), np.ones(len(ix), bool), 0
            while rest.any():
                k = max(k, int(deg[rest].min()))
                gone = rest & (deg <= k)
                core[gone] = k
                rest &= ~gone
                hit = gone[a] | gone[b]
                deg -= np.bincount(a[hit], minlength=len(ix)) + np.bincount(b[hit], minlength=len(ix))
                a, b = a[~hit], b[~hit]
            return {"ix": ix, "k_core": core}

        ends = left.selectExpr("a AS src", "b AS dst", "1D AS w").unionByName(own.selectExpr("lx AS src", "lx AS dst", "CAST(own AS DOUBLE) AS w"))
        return in_one_task(nodes, ends, solve, "ix long, k_core long").select("ix", F.col("k_core").cast("int").alias("k_core"))
    while not nodes.isEmpty():
        ends = left.selectExpr("explode(array(a, b)) AS e").groupBy("e").agg(F.count(F.lit(1)).alias("c"))
        deg = cut(nodes.join(ends, F.col("ix") == F.col("e"), "left").join(own, F.col("ix") == F.col("lx"), "left").select("ix", (F.coalesce("c", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("deg")), "deg")
        k = max(k, deg.agg(F.min("deg")).first()[0])
        gone = cut(deg.filter(F.col("deg") <= k).select("ix"), "gone")
        done.append(gone.select("ix", F.lit(k).alias("k_core")))
        nodes = cut(deg.filter(F.col("deg") > k).select("ix"), "rest")
        keys = gone.selectExpr("ix AS g")
        left = cut(left.join(keys, F.col("a") == F.col("g"), "left_anti").join(keys, F.col("b") == F.col("g"), "left_anti"), "left")
    out = g.nodes.selectExpr("ix", "0 AS k_core").limit(0)
    for d in done:
        out = out.unionByName(d)
    return out


def neighbours(g: Graph) -> DataFrame:
    """(a, b): distinct undirected neighbours, a node its own with a loop."""
    return g.edges.selectExpr("explode(array(struct(src AS a, dst AS b), struct(dst AS a, src AS b))) AS e").select("e.*").distinct()


def clustering(g: Graph) -> DataFrame:
    """(ix, clustering): linked pairs of distinct neighbours over all pairs; 0 below two neighbours.

    A node with a loop is its own neighbour, linked with all others. Triangles
    are found once each, from their node of the least degree, so that no node
    sees more pairs than there are edges, whatever its degree.
    """
    near = cut(neighbours(g), "near")
    k = near.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("a") == F.col("b")).alias("own"))
    size = k.select(F.col("a").alias("v"), F.struct("k", "a").alias("rank"))
    ranked = near.filter("a != b").join(size.selectExpr("v AS a", "rank AS ra"), "a").join(size.selectExpr("v AS b", "rank AS rb"), "b")
    up = cut(ranked.filter("ra < rb").select("a", "b"), "up")
    wedges = up.selectExpr("a AS m", "b AS x").join(up.selectExpr("a AS m2", "b AS y"), (F.col("m") == F.col("m2")) & (F.col("x") < F.col("y")))
    links = up.select(F.least("a", "b").alias("na"), F.greatest("a", "b").alias("nb"))
    closed = wedges.join(links, (F.col("x") == F.col("na")) & (F.col("y") == F.col("nb")), "left_semi").select(F.explode(F.array("m", "x", "y")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("links"))
    out = g.nodes.select("ix").join(k, F.col("ix") == F.col("a"), "left").join(closed, F.col("ix") == F.col("m"), "left")
    linked = F.coalesce("links", F.lit(0)) + F.when(F.col("own") > 0, F.col("k") - 1).otherwise(0)
    return out.select("ix", F.when(F.col("k") >= 2, linked / (F.col("k") * (F.col("k") - 1) / 2)).otherwise(0.0).alias("clustering"))
