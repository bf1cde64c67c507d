import random

import graphs
import pytest
from grovemap.operators import centrality, community, graph, impact, lod, primitives, quality, report, risk
from pyspark.sql import functions as F


def column(df, name, g=None):
    return [r[name] for r in df.orderBy("ix").collect()]


GOLDEN = {
    "mixed4": {
        "pagerank": (centrality.pagerank, "pagerank", [0.0375, 0.053437, 0.053437, 0.128344]),
        "degree_v1": (centrality.degree_v1, "degree", [0.333333] * 4),
        "betweenness_v1": (centrality.betweenness_v1, "betweenness", [0, 0.333333, 0.333333, 0.333333]),
        "betweenness_v2": (centrality.betweenness_v2, "betweenness", [0, 1, 1, 0]),
        "closeness": (centrality.closeness, "closeness", [0.75, 1, 1, 0]),
        "clustering": (centrality.clustering, "clustering", [0] * 4),
        "cyclomatic": (quality.cyclomatic_v1, "cyclomatic", [6, 10, 2, 0]),
        "risk_v1": (risk.risk_v1, "risk", [0.388562, 0.333333, 0.253333, 0.2]),
        "risk_v2": (risk.risk_v2, "risk", [0.291421, 0.25, 0.19, 0.15]),
        "chokepoint_v1": (risk.chokepoint_v1, "chokepoint", [0, 0.5, 0.5, 0]),
        "impact": (impact.impact_probability, "probability", [0.25, 0.425, 0.425, 0.7225]),
        "dependency_depth": (impact.dependency_depth, "depth", [2, 1, 1, 0]),
        "maintainability": (quality.maintainability_v2, "maintainability", [88.333333, 85.064935, 90.909091, 88.076923]),
        "importance": (report.composites, "importance", [0.11875, 0.326719, 0.326719, 0.364172]),
        "payoff": (report.composites, "payoff", [0.34105, 0.381349, 0.349349, 0.339252]),
    },
    "star5": {
        "pagerank": (centrality.pagerank, "pagerank", [0.03] + [0.036375] * 4),
        "betweenness_v1": (centrality.betweenness_v1, "betweenness", [0] + [0.25] * 4),
        "betweenness_v2": (centrality.betweenness_v2, "betweenness", [0] * 5),
        "risk_v1": (risk.risk_v1, "risk", [0.586667] + [0.08] * 4),
        "maintainability": (quality.maintainability_v2, "maintainability", [88.511548] + [97.212847] * 4),
        "payoff": (report.composites, "payoff", [0.434167] + [0.258706] * 4),
    },
    "cycle3": {
        "pagerank_v2": (lambda g: centrality.pagerank(g, tolerance=1e-6), "pagerank", [0.333333] * 3),
        "betweenness_v1": (centrality.betweenness_v1, "betweenness", [1.0] * 3),
        "closeness_v1": (centrality.closeness, "closeness", [0.666667] * 3),
        "closeness_v2": (lambda g: centrality.closeness(g, True), "closeness", [1.0] * 3),
        "clustering": (centrality.clustering, "clustering", [1.0] * 3),
        "chokepoint_v1": (risk.chokepoint_v1, "chokepoint", [0.666667] * 3),
        "impact": (impact.impact_probability, "probability", [0.73] * 3),
        "importance": (report.composites, "importance", [0.416667] * 3),
    },
    "god50": {
        "risk_v2": (risk.risk_v2, "risk", [0.794118] + [0.005882] * 50),
        "cyclomatic": (quality.cyclomatic_v1, "cyclomatic", [50] + [0] * 50),
        "impact": (impact.impact_probability, "probability", [0.019608] + [0.033333] * 50),
        "maintainability": (quality.maintainability_v2, "maintainability", [46.666667] + [92.272727] * 50),
        "payoff": (report.composites, "payoff", [0.512304] + [0.214486] * 50),
    },
    "path10": {
        "betweenness_v1": (centrality.betweenness_v1, "betweenness", [0, 0.111111, 0.208333, 0.291667, 0.361111, 0.416667]),
        "betweenness_v2": (centrality.betweenness_v2, "betweenness", [0, 0.4, 0.7, 0.9, 1, 1]),
        "dependency_depth": (impact.dependency_depth, "depth", list(range(9, -1, -1))),
        "impact": (impact.impact_probability, "probability", [0.1, 0.17, 0.219, 0.2533, 0.27731]),
        "root_depth": (risk.max_root_depth, "depth", list(range(10))),
    },
}


def build(spark, name):
    return {"mixed4": graphs.mixed4, "star5": graphs.star5, "god50": graphs.god50, "cycle3": lambda s: graphs.plain(s, 3, [(0, 1), (1, 2), (2, 0)]), "path10": lambda s: graphs.plain(s, 10, [(i, i + 1) for i in range(9)])}[name](spark)


@pytest.mark.parametrize("name,metric", [(n, m) for n, ms in GOLDEN.items() for m in ms])
def test_golden(spark, name, metric):
    f, c, want = GOLDEN[name][metric]
    assert column(f(build(spark, name)), c)[: len(want)] == pytest.approx(want, abs=1e-6)


def test_god_object_and_cycle(spark):
    large = graphs.make(spark, [("god", "class", 1, None), *[(f"d{i}", "file", 1, None) for i in range(60)]], [("god", f"d{i}", "imports", 1) for i in range(60)])
    for g, severity in ((graphs.god50(spark), "Medium"), (large, "High")):
        assert [r["severity"] for r in quality.smells(g).collect() if r["smell"] == "God Object"] == [severity]
    found = risk.cycles(build(spark, "cycle3")).collect()
    assert [(r["n"], r["members"]) for r in found] == [(3, ["node0", "node1", "node2"])]


def test_edge_rules(spark):
    empty, single, loop = graphs.plain(spark, 0, []), graphs.plain(spark, 1, []), graphs.plain(spark, 1, [(0, 0)])
    for g in (empty, single, loop):
        assert centrality.degree_v1(g).count() == 0
        assert risk.cycles(g).count() == 0
    assert column(centrality.closeness(single), "closeness") == [1.0]
    assert column(centrality.eigenvector(single), "eigenvector") == [1.0]
    for f in (centrality.pagerank, centrality.betweenness_v1, centrality.betweenness_v2, centrality.clustering, centrality.core_numbers, community.louvain, risk.risk_v2, impact.blast_radius, report.composites, impact.dependency_depth):
        assert f(empty).count() == 0
    assert graph.payload_stats(empty).first()["total_nodes"] == 0
    summary = report.summary_v1(empty).first()
    assert (summary["total_nodes"], summary["total_edges"], summary["circular_dependencies"]) == (0, 0, 0)


def test_summaries_count_cycles_and_weigh_communities(spark):
    g = graphs.plain(spark, 5, [(0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (2, 3)])
    parts = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 3), (4, 3)], "ix long, community long")
    first, second = report.summary_v1(g, parts).first(), report.summary_v2(g).first()
    assert (first["num_communities"], first["modularity"]) == (2, pytest.approx(community.modularity_v1(g, parts).first()[0]))
    assert "modularity" not in report.summary_v1(g).columns
    assert second["total_circular_deps"] == first["circular_dependencies"] == 2


def test_odd_weights_leave_ranks_finite(spark):
    nodes = [(f"n{i}", "file", 1, None) for i in range(3)]
    for w in (float("nan"), float("inf"), -3.0):
        g = graphs.make(spark, nodes, [("n0", "n1", "imports", w), ("n1", "n2", "imports", 1)])
        assert all(0 < r < 1 for r in column(centrality.pagerank(g), "pagerank"))
        found = sorted(set(column(community.louvain(g), "community")))
        assert found == list(range(len(found)))
        assert 0 <= community.modularity_v2(g, community.singletons(g)).first()[0] <= 1


def random_graph(spark, seed, n=9, m=16):
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    return graphs.plain(spark, n, pairs), n, pairs


def reachable(n, pairs, s, without=None):
    seen, front = {s: 0}, [s]
    while front:
        new = []
        for c in front:
            for a, b in pairs:
                if a == c and b not in seen and b != without:
                    seen[b] = seen[c] + 1
                    new.append(b)
        front = new
    return seen


@pytest.mark.parametrize(("seed", "most"), [(1, primitives.SENT_EDGES), (2, primitives.SENT_EDGES), (2, -1)])
def test_random_graphs_against_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(primitives, "SENT_EDGES", most)
    g, n, pairs = random_graph(spark, seed)
    dist = [reachable(n, pairs, s) for s in range(n)]
    assert {tuple(r) for r in primitives.all_distances(g.nodes, g.edges).select("s", "t", "d").collect()} == {(s, t, d) for s in range(n) for t, d in dist[s].items()}
    scc = {r[0]: r[1] for r in primitives.strong_components(g.nodes, g.edges).collect()}
    want = {v: min(u for u in range(n) if u in dist[v] and v in dist[u]) for v in range(n) if sum(u in dist[v] and v in dist[u] for u in range(n)) > 1}
    assert scc == want
    und = pairs + [(b, a) for a, b in pairs]
    assert column(primitives.components(g.nodes, g.edges), "component") == [min(reachable(n, und, v)) for v in range(n)]
    # core numbers: remove nodes with fewer than k edge ends for rising k
    core, left = {}, set(range(n))
    for k in range(1, 40):
        while True:
            low = {v for v in left if sum((a == v) + (b == v) for a, b in pairs if a in left and b in left) < k}
            if not low:
                break
            core |= dict.fromkeys(low, k - 1)
            left -= low
    assert column(centrality.core_numbers(g), "k_core") == [core[v] for v in range(n)]
    roots = [v for v in range(n) if not any(b == v for _, b in pairs)]
    depth = [max([0, *[1 + d for r in roots if r != v for p, d in reachable(n, pairs, r, without=v).items() if (p, v) in pairs and p != v]]) for v in range(n)]
    assert column(risk.max_root_depth(g), "depth") == depth
    direct = [sum(b == v for _, b in pairs) for v in range(n)]
    assert column(impact.blast_radius(g), "n_direct") == direct


def test_louvain_finds_two_triangles(spark):
    names = [f"c1_node{i}" for i in range(3)] + [f"c2_node{i}" for i in range(3)]
    edges = [(f"c{c}_node{i}", f"c{c}_node{(i + 1) % 3}", "calls", 2) for c in (1, 2) for i in range(3)] + [("c1_node0", "c2_node0", "calls", 0.1)]
    g = graphs.make(spark, [(n, "file", 1, None) for n in names], edges)
    for version in (1, 2):
        parts = column(community.louvain(g, version), "community")
        assert sorted(set(parts)) == list(range(len(set(parts))))
    parts = column(community.louvain(g), "community")
    assert parts[:3] == [parts[0]] * 3 and parts[3:] == [parts[3]] * 3 and parts[0] != parts[3]
    assert community.modularity_v1(g, community.louvain(g)).first()[0] > community.modularity_v1(g, community.singletons(g)).first()[0]
    assert column(community.boundary(g, community.louvain(g)), "boundary") == pytest.approx([1 / 3, 0, 0, 1 / 3, 0, 0])


def test_relabelling_changes_nothing(spark):
    g, n, pairs = random_graph(spark, 5)
    turn = [(3 * v + 1) % n if n % 3 else (v + 4) % n for v in range(n)]
    other = graphs.plain(spark, n, [(turn[a], turn[b]) for a, b in pairs])
    for f, c in ((centrality.pagerank, "pagerank"), (centrality.clustering, "clustering"), (impact.impact_probability, "probability")):
        a, b = column(f(g), c), column(f(other), c)
        assert [b[turn[v]] for v in range(n)] == pytest.approx(a)


def test_registry_isolates_failures(spark):
    g = graphs.mixed4(spark)
    report.register("broken", lambda g: 1 / 0)
    results, errors = report.run_metrics(g, ["degree", "broken", "risk"])
    del report.METRICS["broken"]
    assert set(results) == {"degree", "risk"} and "ZeroDivisionError" in errors["broken"]
    assert report.long_form(results).filter("metric = 'risk'").count() == 4


def test_client_contract(spark):
    rows = report.client_metrics(graphs.mixed4(spark)).orderBy("ix").collect()
    assert [r["path"] for r in rows] == ["/src/main.rs", "/src/lib.rs", "/src/main.rs", "/src/lib.rs"]
    assert rows[0]["raw"]["out_degree"] == 2 and rows[0]["raw"]["churn"] is None and rows[0]["version"] == 1


def test_builders(spark):
    nodes = spark.createDataFrame([(0, "a", 0), (1, "b", 1), (2, "a", 1), (3, "", 1)], "ix long, id string, file_ord int").withColumns({"name": F.col("id"), "node_type": F.lit("file"), "size": F.lit(1.0), "color": F.lit(""), "file_path": F.lit(None).cast("string")})
    links = spark.createDataFrame([(0, "a", "b", "imports", 1.0, 0), (1, "b", "a", "imports", 1.0, 1), (2, "a", "zzz", "imports", 1.0, 0), (3, "", "a", "imports", 1.0, 1)], "eix long, source string, target string, edge_type string, weight double, file_ord int")
    assert sorted(tuple(r)[:3] for r in graph.build(nodes, links).edges.collect()) == [(0, 2, 1), (1, 1, 2)]
    assert sorted(tuple(r)[:3] for r in graph.build_one_pass(nodes, links).edges.collect()) == [(1, 1, 2)]


def test_lod_round_trip(spark):
    nodes = [("file_a", "file", 1, "p/a.ts"), ("file_b", "file", 1, "q/b.ts"), ("f", "function", 1, "p/a.ts"), ("h", "function", 1, "q/b.ts"), ("lost", "function", 1, None)]
    g = graphs.make(spark, nodes, [("file_a", "f", "contains", 1), ("file_b", "h", "contains", 1), ("file_a", "file_b", "imports", 1), ("f", "h", "calls", 1), ("f", "lost", "calls", 1)])
    s = lod.snapshot(g)
    assert {tuple(r)[:3] for r in lod.view(s, 1)[1].select("source", "target", "weight").collect()} == {("pkg.p", "pkg.q", 1)}
    assert {r["id"] for r in lod.view(s, 4)[0].collect()} == {"f", "h"}
    assert [r["id"] for r in lod.view(s, 4)[1].collect()] == ["f->h"]
    opened = lod.expand(s, "pkg.p", 2)[0]
    both = lod.apply_delta(lod.view(s, 1)[0], add=opened)
    assert {r["id"] for r in both.collect()} == {"pkg.p", "pkg.q", "file_a"}
    gone, edges = lod.collapse(s, "pkg.p")
    assert {r["id"] for r in gone.collect()} == {"file_a", "f"} and {r["id"] for r in edges.collect()} == {"file_a->file_b", "f->h"}
    assert {r["id"] for r in lod.apply_delta(both, remove=gone).collect()} == {"pkg.p", "pkg.q"}
    assert lod.view(s, 7)[0].count() == 0


def test_loops_and_arrays_give_the_same(spark, monkeypatch):
    g, _, _ = random_graph(spark, 5, 12, 20)
    rank = [(centrality.pagerank, "pagerank"), (lambda g: centrality.pagerank(g, tolerance=1e-6), "pagerank"), (centrality.eigenvector, "eigenvector"), (centrality.core_numbers, "k_core"), (impact.blast_radius, "n_indirect")]
    held = [column(f(g), c) for f, c in rank]
    monkeypatch.setattr(primitives, "SENT_EDGES", -1)
    for (f, c), want in zip(rank, held):
        assert column(f(g), c) == pytest.approx(want)
