import graphs
import pytest
from grovemap.api import Session
from grovemap.operators import planned


def test_cut_points(spark):
    # two triangles on a bridge, and a pair with parallel edges
    g = graphs.plain(spark, 9, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3), (6, 7), (7, 6), (8, 8)])
    rows = {r["ix"]: (r["articulation"], r["bridge"]) for r in planned.cut_points(g).collect()}
    assert {v for v, (a, _) in rows.items() if a} == {2, 3}
    assert {v for v, (_, b) in rows.items() if b} == {2, 3}
    assert len(rows) == 9


def test_planned_composites(spark):
    rows = planned.planned_composites(graphs.mixed4(spark)).collect()
    assert len(rows) == 4
    for r in rows:
        assert r["payoff"] == pytest.approx(r["risk"] * r["importance"])
        assert all(0 <= r[c] <= 1 for c in ("importance", "chokepoint", "risk", "payoff"))


def test_session(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("from b import f\n\ndef g():\n    return f()\n")
    (tmp_path / "src/b.py").write_text("def f():\n    return 1\n")
    told = []
    s = Session(spark, lambda stage, share: told.append(stage))
    with pytest.raises(RuntimeError):
        s.generate_graph()
    s.parse_codebase(str(tmp_path / "src"))
    assert told == ["scan", "graph"] and s.errors.count() == 0
    nodes, links, stats = s.generate_graph()
    assert stats.first()["total_nodes"] == nodes.count() == 4
    assert {(r["src_id"], r["edge_type"]) for r in links.collect()} >= {("file:a.py", "imports"), ("function:a.py:g", "calls")}
    assert [r["path"] for r in s.file_tree().collect()] == ["a.py", "b.py"]
    assert {r["id"] for r in s.get_graph_at_lod(4)[0].collect()} == {"function:a.py:g", "function:b.py:f"}
    results, errors = s.run_metrics(["degree", "risk"])
    assert not errors and results["risk"].count() == 4
    s.expand_node("pkg.root", 2)
    s.expand_node("file:a.py", 4)
    nodes, _, bundles = s.collapse_node("pkg.root")
    assert {r["id"] for r in nodes.collect()} >= {"file:a.py", "function:a.py:g"} and bundles.count() == 0 and s.expanded == set()
    s.save_graph(f"{tmp_path}/saved")
    s.save_graph(f"{tmp_path}/saved")
    s.reset()
    assert s.get_saved_graph(f"{tmp_path}/saved").nodes.count() == 4
