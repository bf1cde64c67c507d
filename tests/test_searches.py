"""Searches from many places at once, and what rests on them, against brute force."""

import random

import graphs
import numpy as np
import pyarrow as pa
import pytest
from grovemap.operators import centrality, impact, planned, primitives, quality, risk
from test_graph import column, reachable

RING, STEP = 1500, 10


def held(n, pairs):
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[np.argsort(a, kind="stable")].astype(np.int32)


def rows(found):
    return [r for arrays in found for r in zip(*[x.tolist() for x in arrays])]


@pytest.mark.parametrize(("marks", "followed", "kept"), [(1 << 16, 1 << 16, 1 << 23), (30, 1, 5), (90, 3, 40)])
def test_searches_in_pieces(monkeypatch, marks, followed, kept):
    for name, value in (("_MARKS", marks), ("_FOLLOWED", followed), ("_HELD", kept)):
        monkeypatch.setattr(primitives, name, value)
    for seed in range(30):
        rng = random.Random(seed)
        n = rng.randint(2, 25)
        pairs = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 60))) if a != b} | {(0, 1)})
        names, search = np.arange(n), primitives.Searches(*held(n, pairs))
        dist = [reachable(n, pairs, s) for s in range(n)]
        assert sorted(rows(primitives._pairs(search, names, names))) == sorted((s, t, d) for s in range(n) for t, d in dist[s].items())
        near = primitives.Searches(*held(n, pairs), 2)
        assert sorted(rows(primitives._sizes(near, names, names))) == sorted((s, d, c) for s in range(n) for d in range(3) if (c := list(dist[s].values()).count(d)))
        roots = np.array([v for v in range(n) if not any(b == v for _, b in pairs)], np.int64)
        depth = dict(rows(risk._deepest(search, roots, names)))
        for v in range(n):
            assert depth.get(v, 0) == max([0, *[1 + d for r in roots.tolist() if r != v for p, d in reachable(n, pairs, r, without=v).items() if (p, v) in pairs]])
        assert not search.marks.any()


def test_no_root_needs_no_search(spark, monkeypatch):
    """without a node that has no in-edges all depths are 0, however many nodes lie on cycles."""
    monkeypatch.setattr(risk, "strong_components", None)
    g = graphs.plain(spark, 6, [(0, 1), (1, 0), (2, 3), (3, 2), (4, 5), (5, 4), (0, 2)], "method")
    assert column(risk.max_root_depth(g), "depth") == [0] * 6
    assert column(risk.technical_debt(g), "debt") == pytest.approx([0.2 / 3, *[0.1 / 3] * 5])


@pytest.fixture(scope="module")
def ring(spark):
    """A ring that a root enters at every STEP-th node, and the depths of its nodes."""
    entries = range(0, RING, STEP)
    pairs = [(i, (i + 1) % RING) for i in range(RING)] + [(RING + k, e) for k, e in enumerate(entries)]
    want = [max(1 if e == v else 2 + (v - 1 - e) % RING for e in entries) for v in range(RING)] + [0] * len(entries)
    return graphs.plain(spark, RING + len(entries), pairs), pairs, want


def test_root_depth_on_a_long_ring(ring):
    """nodes on cycles aren't searched from each root."""
    g, pairs, want = ring
    assert column(risk.max_root_depth(g), "depth") == want
    runs = []

    class Counted(primitives.Searches):
        def _run(self, starts, barred):
            runs.append(len(starts))
            return super()._run(starts, barred)

    roots = np.arange(RING, len(want))
    list(risk._deepest(Counted(*held(len(want), pairs)), roots, np.arange(len(want))))
    assert sum(runs) <= 2 * len(roots)


def test_debt_on_a_long_ring(ring):
    """the same depths as part of the debt."""
    g, pairs, want = ring
    outs = np.bincount([a for a, _ in pairs], minlength=len(want))
    assert column(risk.technical_debt(g), "debt") == pytest.approx([(min(o / 10, 1) + min(d / 10, 1) + min(o / 20, 1)) / 3 for o, d in zip(outs, want)])


def test_debt_searches_no_node_of_a_cycle_on_its_own(spark, monkeypatch):
    """the debt too takes the depths of nodes on cycles from the searches of the roots."""
    monkeypatch.setattr(risk, "strong_components", None)
    monkeypatch.setattr(risk, "walked", None)
    # a ring of six that two roots enter
    g = graphs.plain(spark, 8, [*[(i, (i + 1) % 6) for i in range(6)], (6, 0), (7, 2)])
    depth = [5, 6, 3, 4, 5, 6, 0, 0]
    assert column(risk.technical_debt(g), "debt") == pytest.approx([(0.1 + d / 10 + 0.05) / 3 for d in depth])


@pytest.mark.parametrize("budget", [0, 60, 1 << 20])
def test_depths_up_to_a_bound(monkeypatch, budget):
    """the depths of technical debt against brute force, with loops; what is over the budget is left open."""
    monkeypatch.setattr(primitives, "_HELD", 50)
    left = 0
    for seed in range(60):
        rng = random.Random(seed)
        n, top = rng.randint(2, 30), rng.choice([1, 2, 3, 5, 10])
        line = [(i, i + 1) for i in range(n - 1)] if seed % 2 else [(0, n - 1)]
        pairs = sorted({*line, *[(rng.randrange(n), rng.randrange(1, n)) for _ in range(rng.randint(0, n))]})
        steps, names = {p for p in pairs if p[0] != p[1]}, np.unique(pairs)
        place = {v: i for i, v in enumerate(names.tolist())}
        search = primitives.Searches(*held(len(names), [(place[b], place[a]) for a, b in pairs]))
        depth = dict(rows(risk._deep_or_not(search, np.arange(len(names)), names, top, 0, budget)))
        roots = {a for a, _ in pairs} - {b for _, b in pairs}
        for v in range(n):
            want = max([0, *[1 + d for r in roots - {v} for p, d in reachable(n, steps, r, without=v).items() if (p, v) in steps]])
            left += depth.get(v, 0) < 0
            assert depth.get(v, 0) in ([min(want, top)] if budget > 60 else [min(want, top), -1])
    assert (left > 0) == (budget <= 60)


def test_debt_needs_no_search_from_each_root(ring, monkeypatch):
    """one root that is far enough will do, and nodes over the budget get the same depths."""
    g, pairs, want = ring
    outs = np.bincount([a for a, _ in pairs], minlength=len(want))
    debt = pytest.approx([(min(o / 10, 1) + min(d / 10, 1) + min(o / 20, 1)) / 3 for o, d in zip(outs, want)])
    monkeypatch.setattr(risk, "_SPENT", 0)
    monkeypatch.setattr(risk, "_SPARE", 0)
    assert column(risk.technical_debt(g), "debt") == debt
    monkeypatch.undo()
    monkeypatch.setattr(risk, "_deepest", None)
    assert column(risk.technical_debt(g), "debt") == debt


def test_depths_visit_few_places_of_a_graph_with_many_cycles():
    """the places visited follow the nodes, not the roots times what they reach."""
    rng = random.Random(3)
    seen = {}
    for n in (2000, 8000):
        # half of the nodes in one tangle, the rest roots into it
        pairs = sorted({(a, b) for k in range(n // 2) for a, b in ((k, rng.randrange(n // 2)), (k, rng.randrange(n // 2)), (n // 2 + k, rng.randrange(n // 2))) if a != b})
        visited = []

        class Counted(primitives.Searches):
            def _run(self, starts, barred):
                got = super()._run(starts, barred)
                visited.append(0 if got is None else len(got[1]))
                return got

        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(risk, "Searches", Counted)
            depth = dict(rows(risk._deep_or_not(Counted(*held(n, [(b, a) for a, b in pairs])), np.arange(n), np.arange(n), 10, 1 << 12, 0)))
        assert len(depth) >= n // 2 - n // 8 and min(depth.values()) > 0
        seen[n] = sum(visited)
    assert seen[8000] < 8 * seen[2000]


def test_graphs_beyond_two_million_edges_are_searched_as_arrays(spark, monkeypatch):
    """no table of a row for each pair of nodes, up to SEARCHED times the bound of other operators."""
    g = graphs.plain(spark, 5, [(0, 1), (1, 2), (2, 3), (3, 4), (0, 3)])
    monkeypatch.setattr(primitives, "SENT_EDGES", 1)
    monkeypatch.setattr(primitives, "walked", None)
    assert column(impact.impact_probability(g), "probability") == pytest.approx([0.2, 1.7 / 5, 2.19 / 5, (1 + 1.4 + 0.49) / 5, (1 + 0.7 + 0.98 + 0.343) / 5])


def test_betweenness_counts_all_sources(spark):
    """a path longer than the former sample of 1,000 sources."""
    n = 1100
    g = graphs.plain(spark, n, [(i, i + 1) for i in range(n - 1)])
    want = np.array([t * (n - 1 - t) for t in range(n)])
    assert column(centrality.betweenness_v2(g), "betweenness") == pytest.approx((want / want.max()).tolist())
    assert column(centrality.betweenness_v2(g, 1000, True), "betweenness")[1050] == pytest.approx(1000 * 49 / max(min(t, 1000) * (n - 1 - t) for t in range(n)))


def test_planned_composites_take_no_sample(spark, monkeypatch):
    """its betweenness is that over all sources."""
    monkeypatch.setattr(centrality, "_sampled", None)
    assert planned.planned_composites(graphs.mixed4(spark)).count() == 4


def test_planned_composites_compute_each_measure_once(spark, monkeypatch):
    """not again for the quantiles."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.zeros(b.num_rows))], ["ix", "clustering"])

    monkeypatch.setattr(centrality, "clustering", lambda g: g.nodes.select("ix").mapInArrow(counted, "ix long, clustering double"))
    assert planned.planned_composites(graphs.mixed4(spark)).count() == 4
    assert planned.planned_composites(graphs.mixed4(spark)).collect()
    assert seen.value == 8


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 1000])
def test_cut_points_of_many_components(monkeypatch, rows):
    """the components of a batch are searched together; one that goes on in the next batch is searched whole."""
    # paths of three nodes, rings of three and single nodes in turn
    parts, want = [], []
    for c in range(0, 300, 3):
        kind, nodes = c % 9, range(c, c + 3)
        links = {0: [(c, c + 1), (c + 1, c + 2)], 3: [(c, c + 1), (c + 1, c + 2), (c + 2, c)], 6: []}[kind]
        nodes = nodes if links else [c]
        parts += [(c, v, None, None) for v in nodes] + [(c, a, b, 3 * c + i) for i, (a, b) in enumerate(links)]
        want += [(v, kind == 0 and v == c + 1, kind == 0) for v in nodes]
    calls, search = [], planned._low_links
    monkeypatch.setattr(planned, "_low_links", lambda *x: calls.append(1) or search(*x))
    table = pa.Table.from_arrays([pa.array(x, pa.int64()) for x in zip(*parts)], ["component", "ix", "dst", "eix"])
    found = pa.Table.from_batches(list(planned._searched_whole(iter(table.to_batches(max_chunksize=rows)))))
    assert sorted(zip(*found.to_pydict().values())) == sorted(want)
    assert rows < len(table) or len(calls) <= 2


def test_distances_have_no_bound(spark):
    """F4 to F10: paths of more than 30 steps, at which the SQL of these queries stops, count in full."""
    n = 40
    g = graphs.plain(spark, n, [(i, i + 1) for i in range(n - 1)])
    assert {tuple(r) for r in primitives.all_distances(g.nodes, g.edges).select("s", "t", "d").collect()} == {(s, t, t - s) for s in range(n) for t in range(s, n)}
    assert column(centrality.closeness(g), "closeness")[0] == pytest.approx(39 / sum(range(40)))
    assert column(quality.complexity_v1(g), "cognitive") == pytest.approx([c * (1 + 0.1 * v) for v, c in enumerate(column(quality.complexity_v1(g), "cyclomatic"))])
    # all sources of in-edges come later in the search than the node they point at, so that each is a push
    assert column(risk.change_propagation(g), "propagation") == pytest.approx([min((1 if v else 0) + v // 2, n) / n for v in range(n)])
