"""Distances, reachability and components.

A graph of up to SENT_EDGES edges is sent to the tasks as arrays, or held by
one task where the algorithm can't be split. Larger graphs go through loops of
DataFrames, each round cut in the shared folder. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovemap.cluster import cut

#: Distinct edges up to which a graph is held as arrays, of 16 to 40 bytes an edge.
SENT_EDGES = 2_000_000
#: Searches hold 4 bytes an edge and 16 a node, so that they may be sent graphs of so many times SENT_EDGES.
SEARCHED = 5
_ROWS = 200_000
#: Of the searches that a task makes at once: marks, of 4 bytes; out-edges followed in one go; places visited.
_MARKS, _FOLLOWED, _HELD = 1 << 26, 1 << 16, 1 << 20


def is_small(*tables: DataFrame, times: int = 1) -> bool:
    """Whether tables, which are written out so that counting them is cheap, together have few enough rows to be held as arrays."""
    return sum(t.count() for t in tables) <= times * SENT_EDGES


def sent(steps: DataFrame) -> Broadcast:
    """steps (ea, eb) as adjacency lists: names of nodes in order, where each one's list starts, and the lists."""
    held = steps.select("ea", "eb").toArrow()
    a, b = held["ea"].to_numpy(), held["eb"].to_numpy()
    names = np.unique(np.concatenate([a, b]))
    src, dst = np.searchsorted(names, a).astype(np.int32), np.searchsorted(names, b).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(names)))])
    return steps.sparkSession.sparkContext.broadcast((names, first, dst[np.argsort(src, kind="stable")]))


def reached(first: np.ndarray, to: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Distinct nodes one step from those of front."""
    many = first[front + 1] - first[front]
    ends = np.cumsum(many)
    return np.unique(to[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[front] - ends + many, many)])


class Searches:
    """Breadth-first searches from many places of one graph (first, to) at once, each in a slot with marks of its own. A level of all slots is a few calls of numpy, so that the time follows what is visited, whether searches are long and thin or wide. With goal, a mark for each node, a search ends where it has visited one of these at level `least` or beyond."""

    goal: np.ndarray | None = None
    least = 0

    def __init__(self, first: np.ndarray, to: np.ndarray, most: int | None = None) -> None:
        # places of slots and marks stay below 2 ** 31
        self.first, self.to, self.most, self.n = first.astype(np.int32), to, most, len(first) - 1
        self.width = min(4096, max(1, _MARKS // max(self.n, 1)))
        self.marks = np.zeros(self.width * self.n, np.int32)

    def follow(self, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in node, end) of all out-edges of node, in pieces."""
        many = self.first[node + 1] - self.first[node]
        ends = np.cumsum(many, dtype=np.int64)
        bounds = np.searchsorted(ends, np.arange(_FOLLOWED, ends[-1], _FOLLOWED)).tolist() if len(node) and ends[-1] > _FOLLOWED else []
        for low, high in zip([0, *bounds], [*bounds, len(node)]):
            if low < high:
                m = many[low:high]
                owner = np.repeat(np.arange(low, high, dtype=np.int32), m)
                yield owner, self.to[np.arange(len(owner), dtype=np.int32) + np.repeat(self.first[node[low:high]] - np.cumsum(m, dtype=np.int32) + m, m)]

    def _run(self, starts: np.ndarray, barred: np.ndarray | None) -> tuple | None:
        n, marks = self.n, self.marks
        slot, node = np.arange(len(starts), dtype=np.int32), starts.astype(np.int32)
        last, parts, sizes, total = np.zeros(len(starts), np.int64), [], [], 0
        up, ended = np.full(len(starts), -1, np.int32), np.zeros(len(starts), bool)
        marks[slot * n + node] = 1
        while len(node):
            parts.append((slot, node, up))
            sizes.append(len(node))
            total += len(node)
            if (total > _HELD and len(starts) > 1) or (self.most is not None and len(sizes) > self.most):
                break
            on = np.arange(len(node), dtype=np.int32)
            if self.goal is not None and len(sizes) > self.least:
                ended[slot[self.goal[node]]] = True
                on = on[~ended[slot]]
                if not len(on):
                    node = on
                    break
            found = []
            for owner, v in self.follow(node[on]):
                owner = on[owner]
                s = slot[owner]
                if barred is not None:
                    met = v == barred[s]
                    last[s[met]] = len(sizes)
                    owner, v, s = owner[~met], v[~met], s[~met]
                key = s * n + v
                new = np.flatnonzero(marks[key] == 0)
                key = key[new]
                # of several edges to one place the last written stays
                turn = np.arange(1, len(key) + 1, dtype=np.int32)
                marks[key] = turn
                new = new[marks[key] == turn]
                found.append((s[new], v[new], owner[new]))
            start = total - len(node)
            slot, node, owner = (np.concatenate(x) for x in zip(*found))
            up = owner + np.int32(start)
        visited = [np.concatenate(x) for x in zip(*parts)]
        marks[visited[0] * n + visited[1]] = 0
        if len(node) and not (self.most is not None and len(sizes) > self.most):
            return None
        return *visited, np.array(sizes), last

    def each(self, starts: np.ndarray, barred: np.ndarray | None = None) -> Iterator[tuple[slice, tuple]]:
        """For pieces of starts: (slot, node, up, sizes, last). slot, node and up name the places visited, level after level, and within a level by slot; up is where in these arrays a place was reached from; sizes are those of the levels. A slot never enters its barred node, and last is the level at which it would have done so last, or 0."""
        at = 0
        while at < len(starts):
            piece = slice(at, min(at + self.width, len(starts)))
            got = self._run(starts[piece], None if barred is None else barred[piece])
            if got is None:
                # more than a task should hold
                self.width = max(1, self.width // 4)
                continue
            yield piece, got
            at = piece.stop


def level_runs(slot: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, d, n) of what Searches.each() returned: how many places each slot has at each level."""
    d = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (d[1:] != d[:-1])]))
    return slot[starts], d[starts], np.diff(starts, append=len(slot))


def searched(steps: DataFrame, sources: DataFrame, harvest: Callable[[Searches, np.ndarray, np.ndarray], Iterator[tuple]], schema: str, alone: Callable[[np.ndarray], tuple] | None = None, most: int | None = None) -> DataFrame:
    """What harvest(searches, their starts, names of places) yields as columns in each task, over steps sent to all tasks, and alone(sources without a step)."""
    spark = steps.sparkSession
    graph = sent(steps)
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, to = graph.value
        s = np.concatenate([np.zeros(0, np.int64), *[b.column(0).to_numpy() for b in batches]])
        at = np.searchsorted(names, s)
        there = np.append(names, 0)[at] == s if len(names) else np.zeros(len(s), bool)
        there &= at < len(names)
        rows = harvest(Searches(first, to, most), at[there], names) if there.any() else []
        for found in rows if alone is None else chain([alone(s[~there])], rows):
            for low in range(0, len(found[0]), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(x[low : low + _ROWS]) for x in found], columns)

    # the work for a source doesn't follow the size of its row
    return sources.select("s").distinct().repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, schema)


def per_source(steps: DataFrame, sources: DataFrame, visit: Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(s, t, d): for each of sources (s) what visit(first, to, its place) returns as (places, d), over steps sent to all tasks. A source without a step has nothing."""
    spark = steps.sparkSession
    graph = sent(steps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, to = graph.value
        parts, held = [], 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["s", "t", "d"])

        for batch in batches:
            for s in batch.column(0).to_pylist():
                at = int(np.searchsorted(names, s))
                if at == len(names) or names[at] != s:
                    continue
                places, d = visit(first, to, at)
                t = names[places]
                parts.append((np.full(len(t), s, np.int64), t, d.astype(np.int32)))
                held += len(t)
                if held > _ROWS:
                    yield rows()
                    parts, held = [], 0
        if parts:
            yield rows()

    # the work for a source doesn't follow the size of its row
    return sources.select("s").distinct().repartition(2 * spark.sparkContext.defaultParallelism).mapInArrow(run, "s long, t long, d int")


def in_one_task(nodes: DataFrame, edges: DataFrame, solve: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What solve(ix, src, dst, w) returns as columns, for the whole graph of nodes (ix) and edges (src, dst, w) at once; ix ascends, src and dst are places in it. For graphs that is_small() lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("w", pa.float64())]))
        node = held["dst"].is_null().to_numpy()
        a, b, w = held["src"].to_numpy(), held["dst"].fill_null(0).to_numpy()[~node], held["w"].fill_null(0.0).to_numpy()[~node]
        ix, a = np.unique(a[node]), a[~node]
        if len(ix):
            out = solve(ix, np.searchsorted(ix, a), np.searchsorted(ix, b), w)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out.values()], list(out))

    none = F.lit(None)
    rows = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("double")).unionByName(nodes.select(F.col("ix").cast("long").alias("src"), none.cast("long").alias("dst"), none.cast("double").alias("w")))
    return rows.repartition(1).mapInArrow(run, schema)


def _pairs(search: Searches, starts: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    for piece, (slot, node, _, sizes, _) in search.each(starts):
        yield names[starts[piece]][slot], names[node], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _sizes(search: Searches, starts: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
    for piece, (slot, _, _, sizes, _) in search.each(starts):
        slot, d, n = level_runs(slot, sizes)
        yield names[starts[piece]][slot], d.astype(np.int32), n


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None, backward: bool = False) -> DataFrame:
    """(s, t, d): steps of the shortest directed path from each source (s) to each node that it reaches within `most` steps, itself at 0; along edges (src, dst), or against them."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("ea"), F.col(b).alias("eb")).distinct(), "steps")
    if is_small(steps, times=SEARCHED):
        return searched(steps, sources, _pairs, "s long, t long, d int", lambda s: (s, s, np.zeros(len(s), np.int32)), most)
    return walked(steps, sources.selectExpr("s", "s AS t", "s AS barred").distinct(), most, False)


def level_sizes(nodes: DataFrame, edges: DataFrame, most: int | None = None, backward: bool = False) -> DataFrame:
    """(s, d, n): how many nodes each node (ix) of nodes has at each distance, without a row for each pair where the graph is small."""
    a, b = ("dst", "src") if backward else ("src", "dst")
    steps = cut(edges.select(F.col(a).alias("ea"), F.col(b).alias("eb")).distinct(), "steps")
    sources = nodes.selectExpr("ix AS s")
    if is_small(steps, times=SEARCHED):
        return searched(steps, sources, _sizes, "s long, d int, n long", lambda s: (s, np.zeros(len(s), np.int32), np.ones(len(s), np.int64)), most)
    return walked(steps, sources.selectExpr("s", "s AS t", "s AS barred").distinct(), most, False).groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"))


def walked(steps: DataFrame, start: DataFrame, most: int | None, bar: bool) -> DataFrame:
    """(s, t, d), or (barred, s, t, d) if bar: distances from start (s, t, barred) along steps (ea, eb) by one join a level; with bar never into the row's barred node."""
    keys = ["barred", "s", "t"] if bar else ["s", "t"]
    levels = [cut(start.select(*keys).withColumn("d", F.lit(0)).distinct(), "level")]
    while most is None or len(levels) <= most:
        front = levels[-1].select(*[F.col(k).alias(f"f_{k}") for k in keys])
        seen = reduce(DataFrame.unionByName, levels).select(*[F.col(k).alias(f"k_{k}") for k in keys])
        new = front.join(steps, F.col("f_t") == F.col("ea"))
        if bar:
            new = new.filter("eb != f_barred")
        new = new.select(*[F.col(f"f_{k}").alias(k) for k in keys[:-1]], F.col("eb").alias("t")).distinct()
        new = new.join(seen, reduce(lambda x, y: x & y, [F.col(k) == F.col(f"k_{k}") for k in keys]), "left_anti").withColumn("d", F.lit(len(levels)))
        level = cut(new, "level")
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def place_of(rows: DataFrame, key: str) -> DataFrame:
    """rows with `at`: the place of each in the order of key, from 0. Rows are sorted in ranges, and each range starts where those before end."""
    sorted_ = cut(rows.orderBy(key).withColumn("m", F.monotonically_increasing_id()), "sorted").withColumn("range", F.shiftright("m", 33))
    # a row for each range
    before = sorted_.groupBy("range").agg(F.count(F.lit(1)).alias("c")).select("range", F.coalesce(F.sum("c").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return sorted_.join(F.broadcast(before), "range").withColumn("at", F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).drop("range", "before", "m")


def all_distances(nodes: DataFrame, edges: DataFrame, **options) -> DataFrame:
    return distances(edges, nodes.selectExpr("ix AS s"), **options)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ix, component): the least ix of the weakly connected component. Large and small stars in turn, a logarithmic number of rounds."""
    stars = cut(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).filter("u != v").distinct(), "stars")
    nodes = cut(nodes.select("ix"), "nodes")
    if is_small(stars, nodes):

        def solve(ix, a, b, _):
            label = np.arange(len(ix))
            while len(a):
                a, b = label[a], label[b]
                a, b = a[a != b], b[a != b]
                # only roots move, so that all members of a component come along
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(label, up := label[label]):
                    label = up
            return {"ix": ix, "component": ix[label]}

        return in_one_task(nodes, stars.selectExpr("u AS src", "v AS dst", "0D AS w"), solve, "ix long, component long")
    seen = None
    while True:
        both = stars.unionByName(stars.selectExpr("v AS u", "u AS v"))
        large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).filter("v > u").selectExpr("v AS u", "m AS v").distinct()
        low = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        stars = cut(low.selectExpr("explode(array(struct(u AS u, m AS v), struct(v AS u, m AS v))) AS e").selectExpr("e.u", "e.v").filter("u != v").distinct(), "stars", stars)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == seen:
            break
        seen = now
    return nodes.select("ix").join(stars.selectExpr("u AS ix", "v"), "ix", "left").select("ix", F.coalesce("v", "ix").alias("component"))


def _settle(label: DataFrame, edges: DataFrame) -> DataFrame:
    """label (ix, c): each node takes the least label among its own and those of nodes with an edge to it, until nothing changes."""
    while True:
        sent = label.selectExpr("ix AS lx", "c AS lc").join(edges, F.col("lx") == F.col("ea")).groupBy("eb").agg(F.min("lc").alias("got"))
        new = cut(label.join(sent, F.col("ix") == F.col("eb"), "left").select("ix", F.least("c", F.coalesce("got", "c")).alias("c"), (F.col("got") < F.col("c")).alias("moved")), "label")
        label = new.select("ix", "c")
        if new.filter("moved").isEmpty():
            return label


def _tarjan(ix: np.ndarray, src: np.ndarray, dst: np.ndarray, _: np.ndarray) -> dict[str, np.ndarray]:
    """One depth-first search with a stack of its own."""
    order = np.argsort(src, kind="stable")
    first, to = np.searchsorted(src[order], np.arange(len(ix) + 1)).tolist(), dst[order].tolist()
    seen, low, held = [-1] * len(ix), [0] * len(ix), [False] * len(ix)
    at, scc, waiting, count = first[:-1].copy(), np.full(len(ix), -1, np.int64), [], 0
    for root in range(len(ix)):
        if seen[root] >= 0:
            continue
        path = [root]
        while path:
            v = path[-1]
            if seen[v] < 0:
                seen[v] = low[v] = count
                count += 1
                waiting.append(v)
                held[v] = True
            if at[v] < first[v + 1]:
                u = to[at[v]]
                at[v] += 1
                if seen[u] < 0:
                    path.append(u)
                elif held[u]:
                    low[v] = min(low[v], seen[u])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[v])
            if low[v] == seen[v]:
                members = []
                while not members or members[-1] != v:
                    members.append(waiting.pop())
                    held[members[-1]] = False
                if len(members) > 1:
                    scc[members] = ix[min(members)]
    some = scc >= 0
    return {"ix": ix[some], "scc": scc[some]}


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ix, scc) of nodes in strongly connected components of two or more nodes; scc is the least ix.

    Rounds of colouring: nodes without an edge in or out among the rest go;
    each other node takes as colour the least node that reaches it; of a
    colour, the nodes that reach the node it is named after are a component
    and go.
    """
    left = cut(edges.filter("src != dst").select(F.col("src").alias("ea"), F.col("dst").alias("eb")).distinct(), "left")
    nodes = cut(nodes.select("ix"), "nodes")
    if is_small(left, nodes):
        return in_one_task(nodes, left.selectExpr("ea AS src", "eb AS dst", "0D AS w"), _tarjan, "ix long, scc long")
    done = []
    while True:
        # trim
        while not left.isEmpty():
            heads, tails = left.selectExpr("ea AS k").distinct(), left.selectExpr("eb AS k").distinct()
            core = heads.join(tails, "k", "left_semi")
            kept = left.join(core.selectExpr("k AS ka"), F.col("ea") == F.col("ka"), "left_semi").join(core.selectExpr("k AS kb"), F.col("eb") == F.col("kb"), "left_semi")
            before = left.count()
            left = cut(kept, "left", left)
            if left.count() == before:
                break
        if left.isEmpty():
            break
        rest = left.selectExpr("ea AS ix").union(left.selectExpr("eb AS ix")).distinct()
        color = _settle(cut(rest.selectExpr("ix", "ix AS c"), "label"), left)
        # within one colour, back from the node that names it
        inner = left.join(color.selectExpr("ix AS ea", "c AS ca"), "ea").join(color.selectExpr("ix AS eb", "c AS cb"), "eb").filter("ca = cb")
        reach = _settle(color.selectExpr("ix", "CASE WHEN ix = c THEN 0 ELSE 1 END AS c"), cut(inner.selectExpr("eb AS ea", "ea AS eb"), "inner"))
        found = cut(color.selectExpr("ix", "c AS scc").join(reach.filter("c = 0").select("ix"), "ix", "left_semi"), "scc")
        done.append(found)
        gone = found.selectExpr("ix AS g")
        left = cut(left.join(gone, F.col("ea") == F.col("g"), "left_anti").join(gone, F.col("eb") == F.col("g"), "left_anti"), "left")
    none = nodes.selectExpr("ix", "ix AS scc").limit(0)
    every = reduce(DataFrame.unionByName, done, none)
    return every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("scc"))).filter("n > 1").select("ix", "scc")
