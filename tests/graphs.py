"""Small graphs for tests."""

from grovemap.operators.graph import EDGES, NODES, Graph


def make(spark, nodes, edges):
    """nodes: (id, type, size, path); edges: (source, target, type, weight) by id."""
    at = {n[0]: i for i, n in enumerate(nodes)}
    rows = [(i, n[0], n[0], n[1], float(n[2]), "#888888", n[3]) for i, n in enumerate(nodes)]
    links = [(k, at[a], at[b], kind, float(w)) for k, (a, b, kind, w) in enumerate(edges)]
    return Graph(spark.createDataFrame(rows, NODES), spark.createDataFrame(links, EDGES))


def plain(spark, n, pairs, kind="file"):
    return make(spark, [(f"node{i}", kind, 100, f"/file{i}.js") for i in range(n)], [(f"node{a}", f"node{b}", "imports", 1) for a, b in pairs])


def mixed4(spark):
    nodes = [("file1", "file", 100, "/src/main.rs"), ("file2", "file", 200, "/src/lib.rs"), ("function1", "function", 50, "/src/main.rs"), ("class1", "class", 150, "/src/lib.rs")]
    return make(spark, nodes, [("file1", "file2", "imports", 1), ("file1", "function1", "contains", 1), ("file2", "class1", "contains", 1), ("function1", "class1", "calls", 2)])


def star5(spark):
    return make(spark, [(f"node{i}", "file", 1, None) for i in range(5)], [("node0", f"node{i}", "imports", 1) for i in range(1, 5)])


def god50(spark):
    return make(spark, [("god", "class", 1000, "/god.js"), *[(f"dep{i}", "file", 100, f"/dep{i}.js") for i in range(50)]], [("god", f"dep{i}", "imports", 1) for i in range(50)])
