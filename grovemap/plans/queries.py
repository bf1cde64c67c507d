"""Queries of the graph operators over the derived graphs, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.operators import centrality, community, filetree, graph, impact, lod, planned, primitives, quality, report, risk
from grovemap.plans import trees
from grovemap.plans.fixtures import GRAPHS, SQL
from grovemap.sources import languages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, integers as long: what both engines agree on."""
    cast = {"double": lambda c: F.round(F.col(c), 6), "float": lambda c: F.round(F.col(c).cast("double"), 6), "int": lambda c: F.col(c).cast("long"), "tinyint": lambda c: F.col(c).cast("long")}
    return df.select(*[cast[kind](c).alias(c) if kind in cast else F.col(c) for c, kind in df.dtypes])


def add(name: str, which: str, f: Callable[[graph.Graph], DataFrame], sql: str | None = None, ctes: str = "", recursive: bool = False) -> None:
    def run(which: str, f: Callable, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(f(GRAPHS[which](spark, sf_dir)))

    QUERIES[name] = partial(run, which, f)
    if sql:
        ORACLE_SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{SQL[which]}{', ' + ctes if ctes else ''}\n{sql}"


_RISK2 = """least(greatest(0.3 * least(CASE WHEN node_type IN ('function', 'method') THEN least(d_out + 1, 50) WHEN node_type = 'class' THEN least(d_out * 2, 100) WHEN node_type IN ('file', 'module') THEN least(sqrt(d_out) * 5, 50) ELSE 1 END / 15.0, 1)
 + 0.3 * least((d_in + d_out) / n::DOUBLE, 1) + 0.2 * CASE WHEN d_in > 5 AND d_out > 5 THEN 0.5 ELSE 0 END + 0.2 * CASE WHEN d_in + d_out > 10 THEN least((d_in + d_out - 10) / 10.0, 1) ELSE 0 END, 0), 1)"""
_RISK1 = """least(greatest(0.4 * least(CASE WHEN node_type IN ('function', 'method') THEN d_out + 1 WHEN node_type = 'class' THEN d_out * 2 WHEN node_type IN ('file', 'module') THEN sqrt(d_out) * 5 ELSE 1 END / 15.0, 1)
 + 0.4 * least((d_in + d_out) / n::DOUBLE, 1) + 0.2 * CASE WHEN d_in > 5 AND d_out > 5 THEN 0.5 ELSE 0 END, 0), 1)"""
_CHOKE1 = "CASE WHEN d_in > 0 AND d_out > 0 THEN least(least(d_in, d_out) / greatest(d_in, d_out)::DOUBLE * ((d_in + d_out) / n::DOUBLE), 1) ELSE 0 END"
_CHOKE2 = "SELECT ix, round(c, 6) AS chokepoint FROM (SELECT ix, sqrt(least(d_in / 10.0, 1) * least(d_out / 10.0, 1)) AS c FROM deg WHERE d_in > 5 OR d_out > 5) WHERE c > 0.1"
_DIST = "walk AS (SELECT ix AS s, ix AS t, 0 AS d FROM nodes UNION SELECT s, dst, d + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM edges) ON t = src WHERE d < {most}), dist AS (SELECT s, t, min(d) AS d FROM walk GROUP BY s, t)"
_BACK = _DIST.replace("SELECT s, dst, d + 1", "SELECT s, src, d + 1").replace("ON t = src", "ON t = dst")
_TRI = "tri AS (SELECT e.*, a.node_type AS st, b.node_type AS dt, a.file_path AS sp, b.file_path AS dp FROM edges e JOIN nodes a ON e.src = a.ix JOIN nodes b ON e.dst = b.ix)"
_NEAR = "near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"
_CYC1 = "cyc AS (SELECT ix, (CASE WHEN node_type IN ('function', 'method') THEN coalesce(outs, 0) + 1 WHEN node_type = 'class' THEN 2 * coalesce(methods, 0) + coalesce(outs, 0) WHEN node_type IN ('file', 'module') THEN coalesce(parts, 0) ELSE 1 END)::DOUBLE AS cyclomatic FROM nodes LEFT JOIN (SELECT src, count(*) AS outs, count(*) FILTER (dt = 'method') AS methods, sum(CASE dt WHEN 'function' THEN 5 WHEN 'class' THEN 10 ELSE 1 END) AS parts FROM tri GROUP BY src) ON ix = src)"
_REACH = "reach AS (SELECT DISTINCT src AS s, dst AS t FROM edges UNION SELECT s, dst FROM reach JOIN (SELECT DISTINCT src, dst FROM edges) ON t = src)"
_WCC = "und AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), comp AS (SELECT ix AS s, ix AS t FROM nodes UNION SELECT s, b FROM comp JOIN und ON t = a), wcc AS (SELECT s AS ix, min(t) AS component FROM comp GROUP BY s)"
_SCC = _REACH + ", scc AS (SELECT a.s AS ix, min(a.t) AS scc FROM (SELECT s, t FROM reach UNION SELECT ix, ix FROM nodes) a JOIN (SELECT s, t FROM reach UNION SELECT ix, ix FROM nodes) b ON a.s = b.t AND a.t = b.s GROUP BY a.s HAVING count(*) > 1)"


def _pagerank_sql(rounds: int, damping: float = 0.85) -> str:
    out = ["shares AS MATERIALIZED (SELECT src, dst, count(*) / max(outs)::DOUBLE AS share FROM edges JOIN (SELECT src, count(*) AS outs FROM edges GROUP BY src) USING (src) GROUP BY src, dst)", "r0 AS (SELECT ix, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for k in range(1, rounds + 1):
        out.append(f"r{k} AS MATERIALIZED (SELECT x.ix, {1 - damping}::DOUBLE / n + {damping} * coalesce(g, 0) AS r FROM r{k - 1} x CROSS JOIN n LEFT JOIN (SELECT dst, sum(r * share) AS g FROM r{k - 1} JOIN shares ON ix = src GROUP BY dst) ON x.ix = dst)")
    return ", ".join(out)


def _pagerank_stop_sql(rounds: int = 30, damping: float = 0.85, tolerance: float = 1e-6) -> str:
    """The same with ranks within 0..1; `ranked` has those of the first round in which none moved by the tolerance."""
    out = ["shares AS MATERIALIZED (SELECT src, dst, count(*) / max(outs)::DOUBLE AS share FROM edges JOIN (SELECT src, count(*) AS outs FROM edges GROUP BY src) USING (src) GROUP BY src, dst)", "p0 AS (SELECT ix, 1.0::DOUBLE / n AS r FROM nodes, n)"]
    for k in range(1, rounds + 1):
        out.append(f"p{k} AS MATERIALIZED (SELECT ix, least(greatest(new, 0), 1) AS r, abs(least(greatest(new, 0), 1) - r) AS moved FROM (SELECT x.ix, x.r, {1 - damping}::DOUBLE / n + {damping} * coalesce(g, 0) AS new FROM p{k - 1} x CROSS JOIN n LEFT JOIN (SELECT dst, sum(r * share) AS g FROM p{k - 1} JOIN shares ON ix = src GROUP BY dst) ON x.ix = dst))")
    every = " UNION ALL ".join(f"SELECT {k} AS k, * FROM p{k}" for k in range(1, rounds + 1))
    return ", ".join(out) + f", every AS ({every}), ranked AS (SELECT ix, r FROM every WHERE k = (SELECT coalesce(min(k), {rounds}) FROM (SELECT k FROM every GROUP BY k HAVING max(moved) < {tolerance})))"


def _eigenvector_sql(rounds: int = 100, tolerance: float = 1e-6) -> str:
    """`vector` has the values of the first round whose norm is within the tolerance of that before."""
    out = ["links AS MATERIALIZED (SELECT src, dst, max_by(weight, eix) AS w FROM edges GROUP BY src, dst)", "v0 AS (SELECT ix, 1.0::DOUBLE / n AS x, 0.0::DOUBLE AS norm FROM nodes, n)"]
    for k in range(1, rounds + 1):
        out.append(f"v{k} AS MATERIALIZED (SELECT ix, raw / norm AS x, norm FROM (SELECT ix, raw, sqrt(sum(raw * raw) OVER ()) AS norm FROM (SELECT x.ix, coalesce(g, 0) AS raw FROM v{k - 1} x LEFT JOIN (SELECT src, sum(w * x) AS g FROM v{k - 1} JOIN links ON ix = dst GROUP BY src) ON x.ix = src)))")
    norms = " UNION ALL ".join(f"SELECT {k} AS k, * FROM v{k}" for k in range(rounds + 1))
    return ", ".join(out) + f", every AS ({norms}), norms AS (SELECT k, any_value(norm) AS norm FROM every GROUP BY k), vector AS (SELECT ix, abs(x) AS x FROM every WHERE k = (SELECT coalesce(min(a.k), {rounds}) FROM norms a JOIN norms b ON a.k = b.k + 1 WHERE abs(a.norm - b.norm) < {tolerance}))"


def _core_sql(rounds: int = 24) -> str:
    """Core numbers as the limit of h-indices: each round a node takes the largest h of whose edge ends h lead to a value of h or more."""
    out = ["ends AS MATERIALIZED (SELECT src AS v, dst AS u FROM edges UNION ALL SELECT dst, src FROM edges)", "h0 AS (SELECT ix, d_in + d_out AS h FROM deg)"]
    for k in range(1, rounds + 1):
        out.append(f"h{k} AS MATERIALIZED (SELECT x.ix, coalesce(g, 0) AS h FROM h{k - 1} x LEFT JOIN (SELECT v, max(least(h, nth)) AS g FROM (SELECT v, h, row_number() OVER (PARTITION BY v ORDER BY h DESC) AS nth FROM ends JOIN h{k - 1} ON u = ix) GROUP BY v) ON x.ix = v)")
    return ", ".join(out) + f", core AS (SELECT ix, h AS k_core FROM h{rounds})"


_PR30 = _pagerank_sql(30)
_SEV = "x AS (SELECT ix, (n_direct + 0.5 * n_indirect) / n AS x, * FROM blast), "
_BLAST = """one AS (SELECT DISTINCT dst AS v, src AS w FROM edges), two AS (SELECT DISTINCT a.v, b.w FROM one a JOIN one b ON a.w = b.v), three AS (SELECT DISTINCT a.v, b.w FROM two a JOIN one b ON a.w = b.v),
ind AS (SELECT v, count(*) AS c FROM (SELECT * FROM two UNION SELECT * FROM three) p WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.v = p.v AND one.w = p.w) GROUP BY v),
blast AS (SELECT ix, d_in AS n_direct, coalesce(c, 0) AS n_indirect, (d_in + 0.5 * coalesce(c, 0)) / n AS x FROM deg LEFT JOIN ind ON ix = v),
sev AS (SELECT ix, n_direct, n_indirect, n_direct + n_indirect AS n_total, round(CASE WHEN x < 0.1 THEN 2 * x WHEN x < 0.3 THEN 0.2 + 3 * (x - 0.1) ELSE least(0.8 + 0.5 * (x - 0.3), 1) END, 6) AS severity FROM blast)"""
_B2 = "lev AS (SELECT s, d, count(*) AS c FROM dist GROUP BY s, d), far AS (SELECT s, d, coalesce(sum(c) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS w FROM lev), sc AS (SELECT t, sum(w) AS b FROM dist JOIN far USING (s, d) WHERE s != t GROUP BY t)"
_CLUST = "cl AS (SELECT ix, CASE WHEN k >= 2 THEN coalesce(links, 0) / (k * (k - 1) / 2.0) ELSE 0 END::DOUBLE AS clustering FROM nodes LEFT JOIN (SELECT a, count(*) AS k FROM near GROUP BY a) q ON ix = q.a LEFT JOIN (SELECT x.a AS m, count(*) AS links FROM near x JOIN near y ON x.a = y.a AND x.b < y.b JOIN near z ON z.a = x.b AND z.b = y.b GROUP BY x.a) w ON ix = w.m)"


def flagship(g: graph.Graph) -> DataFrame:
    """The ten riskiest nodes with their degrees and chokepoint scores."""
    scores = graph.with_degrees(g).select("ix", "id", "d_in", "d_out").join(risk.risk_v2(g).select("ix", "risk"), "ix").join(risk.chokepoint_v2(g), "ix", "left")
    return scores.withColumn("risk", F.round("risk", 6)).orderBy(F.desc("risk"), "ix").limit(10)


add("top_risk", "handoff", flagship, f"SELECT ix, id, d_in, d_out, round({_RISK2}, 6) AS risk, c.chokepoint FROM deg LEFT JOIN ({_CHOKE2}) c USING (ix) ORDER BY risk DESC, ix LIMIT 10")
add("degree_v1", "handoff", centrality.degree_v1, "SELECT ix, round(d_in / (n - 1), 6) AS in_degree, round(d_out / (n - 1), 6) AS out_degree, round((d_in / (n - 1) + d_out / (n - 1)) / 2, 6) AS degree FROM deg WHERE n > 1".replace("/ (n - 1)", "/ (n - 1)::DOUBLE"))
add("degree_v2", "keys", centrality.degree_v2, "SELECT ix, round(least(d_in / (n - 1)::DOUBLE, 1), 6) AS in_degree, round(least(d_out / (n - 1)::DOUBLE, 1), 6) AS out_degree, round(least((d_in + d_out) / (2.0 * (n - 1)), 1)::DOUBLE, 6) AS degree FROM deg WHERE n > 1")
add("payload_nodes", "keys", lambda g: graph.payload_nodes(g).select("ix", "id", "node_type", "size", "connections"), "SELECT ix, id, node_type, greatest((d_in + d_out) * 10.0, 10)::DOUBLE AS size, d_in + d_out AS connections FROM deg")
add("payload_stats", "keys", graph.payload_stats, "SELECT count(*) AS total_nodes, count(*) FILTER (node_type = 'file') AS files, count(*) FILTER (node_type = 'function') AS functions, count(*) FILTER (node_type = 'variable') AS variables, count(*) FILTER (node_type = 'class') AS classes, (SELECT count(*) FROM edges) AS total_edges FROM nodes")
add("triplets", "keys", lambda g: graph.triplets(g).select("eix", "src_id", "dst_id", "src_type", "dst_type", "edge_type"), "SELECT eix, a.id AS src_id, b.id AS dst_id, a.node_type AS src_type, b.node_type AS dst_type, edge_type FROM edges JOIN nodes a ON src = a.ix JOIN nodes b ON dst = b.ix")
add("edge_weights", "keys", lambda g: g.edges.groupBy("edge_type").agg(F.sum(graph.edge_weight(F.col("edge_type"))).alias("total")), "SELECT edge_type, sum(CASE edge_type WHEN 'calls' THEN 1.5 WHEN 'imports' THEN 2 WHEN 'exports' THEN 2 WHEN 'extends' THEN 3 WHEN 'implements' THEN 3 ELSE 1 END)::DOUBLE AS total FROM edges GROUP BY edge_type")
add("builder_size", "keys", lambda g: g.nodes.select("ix", graph.builder_size(F.col("node_type"), F.lit(1), F.col("size")).alias("size")), "SELECT ix, round(CASE WHEN node_type IN ('file', 'module') THEN 20 WHEN node_type IN ('class', 'interface') THEN 15 WHEN node_type IN ('function', 'method') THEN 10 ELSE 5 END + least(size / 10, 10), 6)::DOUBLE AS size FROM nodes")
_ALL_TYPES = [*graph.NODE_TYPES, "type_alias", "package", "other"]
_typed = lambda g: g.nodes.withColumn("node_type", F.element_at(F.array(*[F.lit(t) for t in _ALL_TYPES]), (F.col("ix") % len(_ALL_TYPES) + 1).cast("int")))
_TYPED = f"(SELECT * REPLACE (([{', '.join(repr(t) for t in _ALL_TYPES)}])[ix % {len(_ALL_TYPES)} + 1] AS node_type) FROM deg)"
#: Written out from the specification, not from the operator's own tables.
_SHADES = {
    "builder": "file 4a9eff module 4a9eff class ff9800 interface 9c27b0 function 4caf50 method 8bc34a variable 607d8b property 795548 type e91e63 enum ff5722 else cccccc",
    "payload": "file 4A90E2 module 7B68EE class 50C878 function FFB347 method FFA07A variable 87CEEB import DDA0DD export F0E68C interface 98D8C8 property F7DC6F type_alias BB8FCE type BB8FCE enum 85C1E2 else 7ED321",
    "lod": "package ff6b6b file 4ecdc4 function 45b7d1 class 96ceb4 else 95a5a6",
}


def _shade_sql(text: str) -> str:
    words = text.split()
    return "CASE node_type " + " ".join(f"ELSE '#{c}'" if t == "else" else f"WHEN '{t}' THEN '#{c}'" for t, c in zip(words[::2], words[1::2])) + " END"


add("colors", "keys", lambda g: _typed(g).select("ix", *[graph.color_of(F.col("node_type"), p).alias(p) for p in graph.PALETTES]), f"SELECT ix, {', '.join(f'{_shade_sql(t)} AS {p}' for p, t in _SHADES.items())} FROM {_TYPED}")
add("display_size", "keys", lambda g: graph.display_size(graph.Graph(_typed(g), g.edges)), f"SELECT ix, round(least(greatest(CASE WHEN node_type = 'file' THEN 8 WHEN node_type = 'module' THEN 7 WHEN node_type = 'class' THEN 6 WHEN node_type = 'interface' THEN 5 WHEN node_type IN ('function', 'enum') THEN 4 WHEN node_type IN ('import', 'export', 'property') THEN 2 ELSE 3 END * CASE WHEN d_in + d_out > 0 THEN greatest(CASE WHEN size > 0 THEN sqrt(size / 10) ELSE 1 END, 1 + 0.3 * ln(d_in + d_out + 1)) WHEN size > 0 THEN sqrt(size / 10) ELSE 1 END, 2), 20), 6)::DOUBLE AS display_size FROM {_TYPED}")
add("self_loops", "handoff", lambda g: graph.loops(g).select("eix", "src"), "SELECT eix, src FROM edges WHERE src = dst")
add("build_two_pass", "keys", lambda g: graph.build(g.nodes, graph.triplets(g).select("eix", F.col("src_id").alias("source"), F.when(F.col("eix") % 11 == 0, "").otherwise(F.col("dst_id")).alias("target"), "edge_type", "weight")).edges.select("eix", "src", "dst", "edge_type"), "SELECT eix, src, dst, edge_type FROM edges WHERE eix % 11 != 0")
add("build_one_pass", "keys", lambda g: graph.build_one_pass(g.nodes.withColumn("file_ord", F.col("ix") % 10), graph.triplets(g).select("eix", F.col("src_id").alias("source"), F.col("dst_id").alias("target"), "edge_type", "weight", (F.col("src") % 10).alias("file_ord"))).edges.select("eix", "src", "dst"), "SELECT eix, src, dst FROM edges WHERE dst % 10 <= src % 10")
add("match_metrics", "keys", lambda g: graph.match_metrics(g.nodes.filter("node_type = 'class'").select(F.concat(F.lit("/base/"), "file_path").alias("path")), g.nodes.select("ix", F.col("file_path").alias("id"))), "SELECT '/base/' || a.file_path AS path, min(b.ix) AS ix, min_by(b.file_path, b.ix) AS id FROM nodes a JOIN nodes b ON a.file_path = b.file_path WHERE a.node_type = 'class' GROUP BY 1")
add("pagerank_fixed", "handoff", centrality.pagerank, "SELECT ix, round(r, 6) AS pagerank FROM r30", _PR30)
add("pagerank_converged", "handoff", partial(centrality.pagerank, tolerance=1e-6), "SELECT ix, round(r, 6) AS pagerank FROM ranked", _pagerank_stop_sql())
add("betweenness_v1", "handoff", centrality.betweenness_v1, "SELECT ix, round(coalesce(b, 0) / ((n - 1.0) * (n - 2)), 6)::DOUBLE AS betweenness FROM nodes CROSS JOIN n LEFT JOIN (SELECT t, CASE WHEN (SELECT n FROM n) > 100 THEN count(*) ELSE sum(w) END AS b FROM sampled GROUP BY t) ON ix = t", _REACH + ", pairs AS (SELECT s, t FROM reach UNION SELECT ix, ix FROM nodes), sampled AS (SELECT p.s, p.t, (SELECT count(*) - 1 FROM reach r WHERE r.s = p.s AND r.t != p.s) AS w FROM pairs p, n WHERE CASE WHEN n > 100 THEN p.s % (n // 50) = 0 AND p.s // (n // 50) < 50 ELSE p.s != p.t END)", True)
add("betweenness_v2", "purchase", centrality.betweenness_v2, "SELECT ix, round(coalesce(b, 0) / (SELECT max(b) FROM sc), 6)::DOUBLE AS betweenness FROM nodes LEFT JOIN sc ON ix = t", _DIST.format(most=30) + ", " + _B2, True)
add("closeness_v1", "purchase", centrality.closeness, "SELECT ix, round(coalesce(k / total, 0), 6)::DOUBLE AS closeness FROM nodes LEFT JOIN (SELECT s, count(*) AS k, sum(d)::DOUBLE AS total FROM dist WHERE d > 0 GROUP BY s) ON ix = s", _DIST.format(most=30), True)
add("closeness_v2", "purchase", partial(centrality.closeness, normalised=True), "SELECT ix, round(c / (SELECT max(c) FROM cc), 6)::DOUBLE AS closeness FROM cc", _DIST.format(most=30) + ", cc AS (SELECT ix, least(coalesce(k / total, 0), 1) AS c FROM nodes LEFT JOIN (SELECT s, count(*) AS k, sum(d)::DOUBLE AS total FROM dist WHERE d > 0 GROUP BY s) ON ix = s)", True)
add("eigenvector", "handoff", centrality.eigenvector, "SELECT ix, round(x, 6) AS eigenvector FROM vector", _eigenvector_sql())
add("k_core", "purchase", centrality.core_numbers, "SELECT ix, k_core FROM core", _core_sql())
add("k_core_dense", "handoff", centrality.core_numbers, "SELECT ix, k_core FROM core", _core_sql(60))
add("clustering", "handoff", centrality.clustering, "SELECT ix, round(clustering, 6) AS clustering FROM cl", _NEAR + ", " + _CLUST)
add("distances", "purchase", lambda g: primitives.all_distances(g.nodes, g.edges), "SELECT s, t, d::BIGINT AS d FROM dist", _DIST.format(most=30), True)
add("weak_components", "purchase", lambda g: primitives.components(g.nodes, g.edges), "SELECT ix, component FROM wcc", _WCC, True)
add("strong_components", "purchase", lambda g: primitives.strong_components(g.nodes, g.edges), "SELECT ix, scc FROM scc", _SCC, True)
add("cycles", "purchase", lambda g: risk.cycles(g).select("scc", "n", F.array_join("members", ",").alias("members")), "SELECT scc, count(*) AS n, string_agg(id, ',' ORDER BY id) AS members FROM scc JOIN nodes USING (ix) GROUP BY scc ORDER BY scc LIMIT 100", _SCC, True)
add("validation", "purchase", lambda g: primitives.components(g.nodes, g.edges).agg(F.countDistinct("component").alias("components")).crossJoin(graph.loops(g).agg(F.count(F.lit(1)).alias("loops"))), "SELECT (SELECT count(DISTINCT component) FROM wcc) AS components, (SELECT count(*) FROM edges WHERE src = dst) AS loops", _WCC, True)
add("coupling_v1", "keys", quality.coupling_v1, "SELECT ix, ca AS afferent, ce AS efferent, round(CASE WHEN ca + ce > 0 THEN ce / (ca + ce)::DOUBLE ELSE 0 END, 6) AS instability FROM (SELECT ix, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce FROM nodes LEFT JOIN (SELECT dst, count(DISTINCT src) AS ca FROM u2 GROUP BY dst) ON ix = dst LEFT JOIN (SELECT src, count(DISTINCT dst) AS ce FROM u2 GROUP BY src) ON ix = src WHERE node_type IN ('file', 'module', 'class'))", _TRI + ", u2 AS (SELECT * FROM tri WHERE st IN ('file', 'module', 'class') AND dt IN ('file', 'module', 'class'))")
add("coupling_v2", "keys", quality.coupling_v2, "SELECT ix, d_in AS afferent, d_out AS efferent, round(CASE WHEN d_in + d_out > 0 THEN d_out / (d_in + d_out)::DOUBLE ELSE 0 END, 6) AS instability, round(least((d_in + d_out) / 20.0, 1), 6)::DOUBLE AS score FROM deg")
add("cohesion_v1", "handoff", quality.cohesion_v1, "SELECT ix, round(CASE WHEN coalesce(k, 0) < 2 THEN 1 ELSE coalesce(l, 0) / (k * (k - 1))::DOUBLE END, 6)::DOUBLE AS cohesion FROM nodes LEFT JOIN (SELECT src, count(*) AS k FROM mem GROUP BY src) q ON ix = q.src LEFT JOIN (SELECT a.src, count(*) AS l FROM mem a JOIN mem b ON a.src = b.src AND a.eix != b.eix JOIN (SELECT DISTINCT src AS x, dst AS y FROM edges) e ON e.x = a.dst AND e.y = b.dst GROUP BY a.src) w ON ix = w.src WHERE node_type IN ('class', 'module')", _TRI + ", mem AS (SELECT * FROM tri WHERE st IN ('class', 'module') AND dt IN ('function', 'method'))")
add("cohesion_v2", "handoff", quality.cohesion_v2, "SELECT ix, round(CASE WHEN k > 0 THEN i / k::DOUBLE ELSE 1 END, 6)::DOUBLE AS cohesion, CASE WHEN node_type = 'class' THEN round((coalesce(k, 0) - coalesce(i, 0)) / greatest(coalesce(k, 0), 1)::DOUBLE, 6) END AS lcom FROM nodes LEFT JOIN (SELECT near.a, count(*) AS k, count(*) FILTER (x.ix % 7 = y.ix % 7) AS i FROM near JOIN nodes x ON near.a = x.ix JOIN nodes y ON near.b = y.ix GROUP BY near.a) ON ix = a", _NEAR)
add("complexity_v1", "purchase", quality.complexity_v1, "SELECT ix, cyclomatic, round(cyclomatic * (1 + 0.1 * depth), 6)::DOUBLE AS cognitive FROM cyc JOIN (SELECT s AS ix, max(d) AS depth FROM dist GROUP BY s) USING (ix)", _BACK.format(most=30) + ", " + _TRI + ", " + _CYC1, True)
add("cyclomatic_v1", "keys", quality.cyclomatic_v1, "SELECT ix, cyclomatic FROM cyc", _TRI + ", " + _CYC1)
add("maintainability_v1", "handoff", quality.maintainability_v1, "SELECT ix, round(least(greatest((171 - 5.2 * greatest(CASE WHEN d_out > 0 THEN ln(d_out * ln(d_out + 2)) ELSE 0 END, 0) - 0.23 * cyclomatic - 16.2 * greatest(CASE WHEN cyclomatic > 0 THEN ln(cyclomatic * 10) ELSE 0 END, 0)) / 100, 0), 1), 6)::DOUBLE AS maintainability FROM deg JOIN cyc USING (ix)", _TRI + ", " + _CYC1)
add("complexity_v2", "keys", quality.complexity_v2, "SELECT ix, round(c, 6) AS cyclomatic, round(c * 1.2, 6) AS cognitive, least(size, 10000)::DOUBLE AS loc, round(least(sqrt(d_in), 10), 6)::DOUBLE AS inheritance_depth FROM (SELECT *, CASE WHEN node_type IN ('function', 'method') THEN least(1.0 + d_out, 50) WHEN node_type = 'class' THEN least((d_in + d_out) / 2.0, 100) WHEN node_type IN ('file', 'module') THEN least((d_in + d_out) / 3.0, 50) ELSE 1 END::DOUBLE AS c FROM deg)")
add("smells", "keys", quality.smells, "SELECT ix, 'God Object' AS smell, CASE WHEN d_in + d_out > 50 THEN 'High' ELSE 'Medium' END AS severity FROM deg WHERE d_in + d_out > 30 UNION ALL SELECT ix, 'Large File', CASE WHEN size > 1000 THEN 'High' ELSE 'Medium' END FROM deg WHERE size > 500 UNION ALL SELECT ix, 'Feature Envy', 'Medium' FROM deg WHERE d_out > 15 UNION ALL SELECT ix, 'Shotgun Surgery', 'High' FROM deg WHERE d_in > 20")
add("maintainability_v2", "keys", quality.maintainability_v2, "SELECT ix, round(100 * (0.4 / (1 + d_out / 10.0) + 0.3 / (1 + size / 500.0) + 0.3 / (1 + d_in / 10.0)), 6)::DOUBLE AS maintainability FROM deg")
add("risk_v1", "keys", lambda g: risk.risk_v1(g).select("ix", "risk"), f"SELECT ix, round({_RISK1}, 6)::DOUBLE AS risk FROM deg")
add("risk_v2", "keys", lambda g: risk.risk_v2(g).select("ix", "risk"), f"SELECT ix, round({_RISK2}, 6)::DOUBLE AS risk FROM deg")
add("chokepoint_v1", "handoff", risk.chokepoint_v1, f"SELECT ix, round({_CHOKE1}, 6)::DOUBLE AS chokepoint FROM deg")
add("chokepoint_v2", "handoff", risk.chokepoint_v2, _CHOKE2)
add("percentile_rank", "keys", lambda g: risk.percentile_rank(graph.with_degrees(g).select("ix", F.when(F.col("d_in") % 7 == 3, F.lit(float("nan"))).otherwise(F.col("d_in").cast("double")).alias("value"))), "SELECT ix, round(CASE WHEN d_in % 7 = 3 THEN 0 ELSE (SELECT count(*) FROM deg b WHERE b.d_in < deg.d_in AND b.d_in % 7 != 3) / (SELECT count(*) FROM deg WHERE d_in % 7 != 3)::DOUBLE END, 6)::DOUBLE AS rank FROM deg")
_ROOTS = """step AS (SELECT DISTINCT src, dst FROM edges WHERE src != dst), roots AS (SELECT ix FROM nodes WHERE ix NOT IN (SELECT dst FROM edges)),
away AS (SELECT v.ix AS v, r.ix AS r, r.ix AS t, 0 AS d FROM nodes v, roots r WHERE v.ix != r.ix UNION SELECT v, r, dst, d + 1 FROM away JOIN step ON t = src WHERE dst != v AND d < 30),
far AS (SELECT v, max(d) + 1 AS depth FROM (SELECT v, r, t, min(d) AS d FROM away GROUP BY v, r, t) JOIN step ON src = t AND dst = v GROUP BY v)"""
add("root_depth", "purchase", risk.max_root_depth, "SELECT ix, coalesce(depth, 0)::BIGINT AS depth FROM nodes LEFT JOIN far ON ix = v", _ROOTS, True)
_DEBT = "SELECT ix, round((least(d_out / 10.0, 1) + least(coalesce(depth, 0) / 10.0, 1) + CASE WHEN node_type IN ('file', 'module') THEN least(d_out / 20.0, 1) WHEN node_type = 'class' THEN least(coalesce(m, 0) / 15.0, 1) ELSE 0 END) / 3, 6)::DOUBLE AS debt FROM deg LEFT JOIN far ON ix = v LEFT JOIN (SELECT src, count(*) AS m FROM edges JOIN nodes ON dst = ix WHERE node_type = 'method' GROUP BY src) ON ix = src"
add("technical_debt", "keys", risk.technical_debt, _DEBT, _ROOTS, True)
add("technical_debt_deep", "purchase", risk.technical_debt, _DEBT, _ROOTS, True)
add("change_propagation", "purchase", risk.change_propagation, "SELECT ix, round(least((d_in + coalesce(p, 0) // 2) / n::DOUBLE, 1), 6)::DOUBLE AS propagation FROM deg LEFT JOIN (SELECT a.s AS v, count(*) AS p FROM dist a JOIN edges e ON a.t = e.dst JOIN dist b ON b.s = a.s AND b.t = e.src WHERE b.d > a.d OR (b.d = a.d AND b.t > a.t) GROUP BY a.s) ON ix = v", _BACK.format(most=30), True)
add("impact_probability", "handoff", impact.impact_probability, "SELECT s AS ix, round(least(sum(0.7 ** d) / (SELECT n FROM n), 1), 6)::DOUBLE AS probability FROM dist GROUP BY s", _BACK.format(most=4), True)
add("blast_radius", "handoff", impact.blast_radius, "SELECT ix, n_direct, n_indirect, n_total, severity FROM sev", _BLAST)
add("high_impact", "handoff", lambda g: impact.blast_radius(g).withColumn("severity", F.round("severity", 6)).orderBy(F.desc("severity"), "ix").limit(10), "SELECT ix, n_direct, n_indirect, n_total, severity FROM sev ORDER BY severity DESC, ix LIMIT 10", _BLAST)
add("dependency_depth", "purchase", impact.dependency_depth, "SELECT ix, coalesce(k, 0)::BIGINT AS depth FROM nodes LEFT JOIN (SELECT s, min(d) AS k FROM dist WHERE t IN (SELECT ix FROM deg WHERE d_out = 0) GROUP BY s) ON ix = s", _DIST.format(most=30), True)
add("deep_dependencies", "purchase", partial(impact.deep_dependencies, least=3), "SELECT s AS ix, min(d)::BIGINT AS depth FROM dist WHERE t IN (SELECT ix FROM deg WHERE d_out = 0) GROUP BY s HAVING min(d) >= 3", _DIST.format(most=30), True)
_SCC_COUNT = "(SELECT least(count(DISTINCT scc), {most}) FROM scc)"
add("summary_v2", "purchase", report.summary_v2, f"""SELECT count(*) FILTER (r > 0.7) AS high_risk_count, round(avg(r), 6) AS avg_risk, {_SCC_COUNT.format(most=100)} AS total_circular_deps, round(avg(c), 6) AS avg_complexity, (SELECT round(avg(CASE WHEN k > 0 THEN i / k::DOUBLE ELSE 1 END), 6) FROM nodes LEFT JOIN (SELECT near.a, count(*) AS k, count(*) FILTER (x.ix % 7 = y.ix % 7) AS i FROM near JOIN nodes x ON near.a = x.ix JOIN nodes y ON near.b = y.ix GROUP BY near.a) ON ix = a) AS avg_cohesion, sum((d_in + d_out > 30)::INT + (size > 500)::INT + (d_out > 15)::INT + (d_in > 20)::INT)::BIGINT AS total_smells
 FROM (SELECT *, {_RISK2}::DOUBLE AS r, CASE WHEN node_type IN ('function', 'method') THEN least(1.0 + d_out, 50) WHEN node_type = 'class' THEN least((d_in + d_out) / 2.0, 100) WHEN node_type IN ('file', 'module') THEN least((d_in + d_out) / 3.0, 50) ELSE 1 END::DOUBLE AS c FROM deg)""", _NEAR + ", " + _SCC, True)
add("composites", "handoff", report.composites, f"""SELECT ix, round(importance, 6) AS importance, round(choke, 6) AS chokepoint, round(risk, 6) AS risk, round(0.4 * risk + 0.3 * importance + 0.15, 6)::DOUBLE AS payoff FROM (SELECT deg.ix, 0.5 * least(greatest(r, 0), 1) + 0.3 * least(((d_in + d_out) / (n - 1.0)) / 2, 1) + 0.2 * CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (b - lo) / (hi - lo) END AS importance, {_RISK1}::DOUBLE AS risk, {_CHOKE1}::DOUBLE AS choke FROM deg JOIN r30 USING (ix) JOIN btw USING (ix) CROSS JOIN (SELECT min(b) AS lo, max(b) AS hi FROM btw))""", _REACH + ", pairs AS (SELECT s, t FROM reach UNION SELECT ix, ix FROM nodes), sampled AS (SELECT p.s, p.t, (SELECT count(*) - 1 FROM reach r WHERE r.s = p.s AND r.t != p.s) AS w FROM pairs p, n WHERE CASE WHEN n > 100 THEN p.s % (n // 50) = 0 AND p.s // (n // 50) < 50 ELSE p.s != p.t END), btw AS (SELECT ix, coalesce(b, 0) / ((n - 1.0) * (n - 2))::DOUBLE AS b FROM nodes CROSS JOIN n LEFT JOIN (SELECT t, CASE WHEN (SELECT n FROM n) > 100 THEN count(*) ELSE sum(w) END AS b FROM sampled GROUP BY t) ON ix = t), " + _PR30, True)
add("louvain_v1", "purchase", community.louvain)
add("louvain_v2", "purchase", partial(community.louvain, version=2))
_PARTS = "parts AS (SELECT ix, ix % 5 AS community FROM nodes), pe AS (SELECT e.*, a.community AS ca, b.community AS cb, CASE WHEN weight > 0 THEN weight ELSE 1 END AS w1 FROM edges e JOIN parts a ON src = a.ix JOIN parts b ON dst = b.ix)"
_parts = lambda g: g.nodes.select("ix", (F.col("ix") % 5).alias("community"))
add("modularity_v1", "handoff", lambda g: community.modularity_v1(g, _parts(g)), "SELECT round((SELECT sum(w1) FILTER (ca = cb) / sum(w1) FROM pe) - (SELECT sum(k * k) FROM (SELECT v, sum(w1) AS k FROM (SELECT src AS v, w1 FROM pe UNION ALL SELECT dst, w1 FROM pe) GROUP BY v)) / (SELECT sum(w1) ** 2 FROM pe), 6)::DOUBLE AS modularity", _PARTS)
add("modularity_v2", "handoff", lambda g: community.modularity_v2(g, _parts(g)), "SELECT round(least(greatest(2 * sum(weight) FILTER (ca = cb) / sum(weight), 0), 1), 6)::DOUBLE AS modularity FROM pe", _PARTS)
add("clusters", "handoff", lambda g: community.clusters(g, _parts(g)).select("community", "n", F.array_join("members", ",").alias("members")), "SELECT community, count(*) AS n, string_agg(id, ',' ORDER BY id) AS members FROM parts JOIN nodes USING (ix) GROUP BY community", _PARTS)
add("boundary", "handoff", lambda g: community.boundary(g, _parts(g)), "SELECT ix, round(coalesce(x / k, 0), 6)::DOUBLE AS boundary FROM nodes LEFT JOIN (SELECT v, count(*) FILTER (o) AS x, count(*)::DOUBLE AS k FROM (SELECT src AS v, ca != cb AS o FROM pe UNION ALL SELECT dst, ca != cb FROM pe) GROUP BY v) ON ix = v", _PARTS)
add("singletons", "purchase", community.singletons, "SELECT ix, ix AS community FROM nodes")
_BTW = _REACH + ", pairs AS (SELECT s, t FROM reach UNION SELECT ix, ix FROM nodes), sampled AS (SELECT p.s, p.t, (SELECT count(*) - 1 FROM reach r WHERE r.s = p.s AND r.t != p.s) AS w FROM pairs p, n WHERE CASE WHEN n > 100 THEN p.s % (n // 50) = 0 AND p.s // (n // 50) < 50 ELSE p.s != p.t END), btw AS (SELECT ix, coalesce(b, 0) / ((n - 1.0) * (n - 2))::DOUBLE AS b FROM nodes CROSS JOIN n LEFT JOIN (SELECT t, CASE WHEN (SELECT n FROM n) > 100 THEN count(*) ELSE sum(w) END AS b FROM sampled GROUP BY t) ON ix = t)"
_FIXED = {"k_core": (0, 10), "churn": (0, 100), "owners": (0, 10), "coverage": (0, 1), "pagerank_imports": (0, 1), "pagerank_calls": (0, 1)}
add("ranges", "purchase", report.ranges, "SELECT (SELECT round(min(b), 6) FROM btw) AS betweenness_min, (SELECT round(max(b), 6) FROM btw) AS betweenness_max, (SELECT round(min(clustering), 6) FROM cl) AS clustering_min, (SELECT round(max(clustering), 6) FROM cl) AS clustering_max, (SELECT min(cyclomatic) FROM cyc) AS cyclomatic_min, (SELECT max(cyclomatic) FROM cyc) AS cyclomatic_max, (SELECT min(d_in)::DOUBLE FROM deg) AS in_degree_min, (SELECT max(d_in)::DOUBLE FROM deg) AS in_degree_max, " + ", ".join(f"{x}::DOUBLE AS {k}_{end}" for k, pair in _FIXED.items() for end, x in zip(("min", "max"), pair)), ", ".join([_BTW, _NEAR, _CLUST, _TRI, _CYC1]), True)
_MODULARITY = "(SELECT round((SELECT sum(w1) FILTER (ca = cb) / sum(w1) FROM pe) - (SELECT sum(k * k) FROM (SELECT v, sum(w1) AS k FROM (SELECT src AS v, w1 FROM pe UNION ALL SELECT dst, w1 FROM pe) GROUP BY v)) / (SELECT sum(w1) ** 2 FROM pe), 6)::DOUBLE)"
add("summary_v1", "purchase", lambda g: report.summary_v1(g, _parts(g)), f"SELECT count(*) AS total_nodes, (SELECT count(*) FROM edges) AS total_edges, (SELECT round(avg(cyclomatic), 6) FROM cyc) AS avg_complexity, count(*) FILTER (r > 0.7) AS high_risk_count, (SELECT count(DISTINCT scc) FROM scc) AS circular_dependencies, (SELECT count(DISTINCT community) FROM parts) AS num_communities, {_MODULARITY} AS modularity FROM (SELECT *, {_RISK1}::DOUBLE AS r FROM deg)", ", ".join([_PARTS, _SCC, _TRI, _CYC1]), True)
add("client_metrics", "purchase", lambda g: report.client_metrics(g, _parts(g)).select("ix", "path", "community", "importance", "chokepoint", "risk", "payoff", F.col("raw.k_core").alias("k_core"), F.col("raw.cyclomatic").alias("cyclomatic"), F.col("normalized.in_degree").alias("in_degree"), F.col("normalized.clustering").alias("clustering")), f"""SELECT ix, file_path AS path, ix % 5 AS community, round(importance::FLOAT::DOUBLE, 6) AS importance, round(choke::FLOAT::DOUBLE, 6) AS chokepoint, round(risk::FLOAT::DOUBLE, 6) AS risk, round((0.4 * risk + 0.3 * importance + 0.15)::FLOAT::DOUBLE, 6) AS payoff, k_core, cyclomatic::BIGINT AS cyclomatic, round((CASE WHEN dhi - dlo < 1e-12 THEN 0.5 ELSE (d_in - dlo) / (dhi - dlo)::DOUBLE END)::FLOAT::DOUBLE, 6) AS in_degree, round((CASE WHEN chi - clo < 1e-12 THEN 0.5 ELSE (clustering - clo) / (chi - clo) END)::FLOAT::DOUBLE, 6) AS clustering
 FROM (SELECT deg.*, k_core, cyclomatic, clustering, 0.5 * least(greatest(r, 0), 1) + 0.3 * least(((d_in + d_out) / (n - 1.0)) / 2, 1) + 0.2 * CASE WHEN hi - lo < 1e-12 THEN 0.5 ELSE (b - lo) / (hi - lo) END AS importance, {_RISK1}::DOUBLE AS risk, {_CHOKE1}::DOUBLE AS choke FROM deg JOIN r30 USING (ix) JOIN btw USING (ix) JOIN core USING (ix) JOIN cyc USING (ix) JOIN cl USING (ix) CROSS JOIN (SELECT min(b) AS lo, max(b) AS hi FROM btw)) CROSS JOIN (SELECT min(d_in) AS dlo, max(d_in) AS dhi FROM deg) CROSS JOIN (SELECT min(clustering) AS clo, max(clustering) AS chi FROM cl)""", ", ".join([_BTW, _NEAR, _CLUST, _TRI, _CYC1, _core_sql(), _PR30]), True)
_APART = """lk AS (SELECT eix, src AS a, dst AS b FROM edges WHERE src != dst UNION ALL SELECT eix, dst, src FROM edges WHERE src != dst),
rim AS (SELECT a AS v, min(b) AS s FROM lk GROUP BY a), round AS (SELECT v, s AS t FROM rim UNION SELECT v, b FROM round JOIN lk ON t = a WHERE b != v),
art AS (SELECT DISTINCT a AS v FROM lk WHERE NOT EXISTS (SELECT 1 FROM round r WHERE r.v = lk.a AND r.t = lk.b)),
off AS (SELECT eix, src AS t FROM edges WHERE src != dst UNION SELECT off.eix, b FROM off JOIN lk ON t = a WHERE lk.eix != off.eix),
brd AS (SELECT src, dst FROM edges e WHERE src != dst AND NOT EXISTS (SELECT 1 FROM off WHERE off.eix = e.eix AND off.t = e.dst))"""
add("cut_points", "purchase", planned.cut_points, "SELECT ix, ix IN (SELECT v FROM art) AS articulation, ix IN (SELECT src FROM brd UNION SELECT dst FROM brd) AS bridge FROM nodes", _APART, True)
_UNIT = "least(greatest(CASE WHEN {p}h = {p}l THEN 1 ELSE ({x} - {p}l) / nullif({p}h - {p}l, 0) END, 0), 1)"
_MEASURES = {"r": "prc", "k_core": "core", "clustering": "clu", "bt": "btw", "cyclomatic": "cyc"}
add("planned_composites", "purchase", planned.planned_composites, f"""SELECT ix, round(imp, 6) AS importance, round(choke, 6) AS chokepoint, round(0.3 + 0.25 * {_UNIT.format(p="cyc", x="cyclomatic")} + 0.2 + 0.15 * choke, 6)::DOUBLE AS risk, round((0.5 + 0.25 * {_UNIT.format(p="cyc", x="cyclomatic")} + 0.15 * choke) * imp, 6)::DOUBLE AS payoff
 FROM (SELECT ix, cyclomatic, cych, cycl, 0.35 + 0.25 * {_UNIT.format(p="prc", x="r")} + 0.15 * {_UNIT.format(p="core", x="k_core")} + 0.1 + 0.15 * {_UNIT.format(p="clu", x="clustering")} AS imp, 0.6 * {_UNIT.format(p="btw", x="bt")} + 0.2 * (ix IN (SELECT v FROM art))::INT + 0.2 * (ix IN (SELECT src FROM brd UNION SELECT dst FROM brd))::INT AS choke FROM ms CROSS JOIN (SELECT {", ".join(f"quantile_cont({c}::DOUBLE, 0.01) AS {p}l, quantile_cont({c}::DOUBLE, 0.99) AS {p}h" for c, p in _MEASURES.items())} FROM ms))""", ", ".join([_DIST.format(most=30), _B2, _NEAR, _CLUST, _TRI, _CYC1, _core_sql(), _PR30, _APART, "ms AS (SELECT ix, r, k_core, clustering, cyclomatic, coalesce(b, 0) / (SELECT max(b) FROM sc)::DOUBLE AS bt FROM nodes JOIN r30 USING (ix) JOIN core USING (ix) JOIN cl USING (ix) JOIN cyc USING (ix) LEFT JOIN sc ON ix = t)"]), True)
_scores = lambda g: risk.risk_v2(g).join(g.nodes.select("ix", F.col("file_path").alias("path")), "ix").select("ix", "path", F.round("risk", 6).alias("risk"))
add("top_by_risk", "keys", lambda g: planned.top_by(_scores(g), "risk", 7), f"SELECT ix, file_path AS path, round({_RISK2}, 6)::DOUBLE AS risk FROM deg ORDER BY risk DESC, path LIMIT 7")
add("node_lookup", "keys", lambda g: planned.node_metrics(_scores(g), "p3/nation/3"), f"SELECT ix, file_path AS path, round({_RISK2}, 6)::DOUBLE AS risk FROM deg WHERE file_path = 'p3/nation/3'")
add("high_payoff", "keys", lambda g: report.high_payoff(_scores(g).withColumnRenamed("risk", "payoff"), 0.1), f"SELECT ix, file_path AS path, r AS payoff FROM (SELECT ix, file_path, round({_RISK2}, 6)::DOUBLE AS r FROM deg) WHERE r >= 0.1")
_field = lambda name: F.get_json_object("json", f"$.{name}")
add("payload_json", "keys", lambda g: graph.payload_json(g).select("kind", F.coalesce(_field("id"), _field("source")).alias("a"), F.coalesce(_field("name"), _field("target")).alias("b"), _field("type").alias("type"), F.coalesce(_field("size"), _field("value")).cast("double").alias("value"), _field("filePath").alias("path")), "SELECT 'node' AS kind, id AS a, name AS b, node_type AS type, greatest((d_in + d_out) * 10.0, 10)::DOUBLE AS value, file_path AS path FROM deg UNION ALL SELECT 'link', a.id, b.id, edge_type, weight, NULL FROM edges JOIN nodes a ON src = a.ix JOIN nodes b ON dst = b.ix")
add("palette", "keys", lambda g: graph.palette_filter(g.nodes.select(F.col("name").alias("label"), F.col("node_type").alias("category"), F.when(F.col("ix") % 3 == 0, F.concat(F.lit("Ctrl+"), F.col("ix") % 10)).alias("shortcut")), "L+7"), "SELECT name AS label, node_type AS category, CASE WHEN ix % 3 = 0 THEN 'Ctrl+' || ix % 10 END AS shortcut FROM nodes WHERE ix % 3 = 0 AND ix % 10 = 7")
add("robust_scaled", "keys", lambda g: report.robust_scaled(graph.with_degrees(g).select("ix", F.col("d_in").cast("double").alias("value"))), "SELECT ix, round(CASE WHEN hi = lo THEN 1 ELSE least(greatest((d_in - lo) / nullif(hi - lo, 0), 0), 1) END, 6)::DOUBLE AS scaled FROM deg, (SELECT quantile_cont(d_in::DOUBLE, 0.01) AS lo, quantile_cont(d_in::DOUBLE, 0.99) AS hi FROM deg)")

_LOD = """files AS (SELECT ix, id, name AS label, 'pkg.' || split_part(file_path, '/', 1) AS package FROM nodes WHERE node_type = 'file'),
functions AS (SELECT x.ix, x.id, x.name AS label, min_by(f.id, e.eix) AS file FROM nodes x JOIN edges e ON e.dst = x.ix AND e.edge_type = 'contains' JOIN nodes f ON e.src = f.ix AND f.node_type = 'file' WHERE x.node_type IN ('function', 'class', 'method') GROUP BY ALL),
imports AS (SELECT a.id AS source, b.id AS target FROM edges JOIN files a ON src = a.ix JOIN files b ON dst = b.ix WHERE edge_type = 'imports'),
calls AS (SELECT a.id AS source, b.id AS target FROM edges JOIN functions a ON src = a.ix JOIN functions b ON dst = b.ix WHERE edge_type = 'calls')"""
_FILE_OF = "SELECT id, label, 'file' AS kind, package AS parent FROM files"
_IMPORT_EDGES = "SELECT source || '->' || target AS id, source, target, 'imports' AS kind, count(*) AS weight FROM imports {} GROUP BY source, target"
_CALL_EDGES = "SELECT source || '->' || target AS id, source, target, 'calls' AS kind, count(*) AS weight FROM calls {} GROUP BY source, target"
_view = lambda level, part: lambda g: lod.view(lod.snapshot(g), level)[part]
add("lod1_nodes", "keys", _view(1, 0), "SELECT DISTINCT package AS id, replace(package, 'pkg.', '') AS label, 'package' AS kind, NULL::VARCHAR AS parent FROM files", _LOD)
add("lod1_edges", "keys", _view(1, 1), "SELECT a.package || '->' || b.package AS id, a.package AS source, b.package AS target, 'bundled' AS kind, count(*) AS weight FROM imports JOIN files a ON source = a.id JOIN files b ON target = b.id WHERE a.package != b.package GROUP BY a.package, b.package", _LOD)
add("lod2_nodes", "keys", _view(2, 0), _FILE_OF, _LOD)
add("lod2_edges", "keys", _view(2, 1), _IMPORT_EDGES.format(""), _LOD)
add("lod4_nodes", "keys", _view(4, 0), "SELECT id, label, 'function' AS kind, file AS parent FROM functions", _LOD)
add("lod4_edges", "keys", _view(4, 1), _CALL_EDGES.format(""), _LOD)
add("lod_file_edges", "keys", lambda g: lod.file_edges(lod.snapshot(g)), "SELECT source, target, count(*) AS weight FROM imports GROUP BY source, target", _LOD)
add("lod_expand_nodes", "keys", lambda g: lod.expand(lod.snapshot(g), "pkg.p1", 2)[0], f"{_FILE_OF} WHERE package = 'pkg.p1'", _LOD)
add("lod_expand_edges", "keys", lambda g: lod.expand(lod.snapshot(g), "nation:3", 4)[1], _CALL_EDGES.format("WHERE source IN (SELECT id FROM functions WHERE file = 'nation:3')"), _LOD)
add("lod_collapse_nodes", "keys", lambda g: lod.collapse(lod.snapshot(g), "pkg.p2")[0], "SELECT id FROM files WHERE package = 'pkg.p2' UNION SELECT id FROM functions WHERE file IN (SELECT id FROM files WHERE package = 'pkg.p2')", _LOD)
add("lod_collapse_edges", "keys", lambda g: lod.collapse(lod.snapshot(g), "pkg.p2")[1], "SELECT DISTINCT source || '->' || target AS id FROM (SELECT * FROM imports UNION ALL SELECT * FROM calls) WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)", _LOD + ", gone AS (SELECT id FROM files WHERE package = 'pkg.p2' UNION SELECT id FROM functions WHERE file IN (SELECT id FROM files WHERE package = 'pkg.p2'))")
add("lod_apply_delta", "keys", lambda g: (lambda s: lod.apply_delta(lod.view(s, 2)[0], add=lod.expand(s, "nation:3", 4)[0], remove=lod.collapse(s, "pkg.p2")[0]))(lod.snapshot(g)), f"{_FILE_OF} WHERE package != 'pkg.p2' UNION ALL SELECT id, label, 'function', file FROM functions WHERE file = 'nation:3'", _LOD)
add("lod_restored_edges", "keys", lambda g: (lambda s: lod.apply_delta(lod.view(s, 2)[1], remove=lod.collapse(s, "pkg.p2")[1], restore=lod.bundles_of(s, "pkg.p2")))(lod.snapshot(g)), f"""{_IMPORT_EDGES.format("WHERE source NOT IN (SELECT id FROM files WHERE package = 'pkg.p2') AND target NOT IN (SELECT id FROM files WHERE package = 'pkg.p2')")}
 UNION ALL SELECT a.package || '->' || b.package, a.package, b.package, 'bundled', count(*) FROM imports JOIN files a ON source = a.id JOIN files b ON target = b.id WHERE a.package != b.package AND 'pkg.p2' IN (a.package, b.package) GROUP BY a.package, b.package""", _LOD)
_TREE = "parts AS (SELECT string_split(file_path, '/') AS p FROM nodes), tree AS (SELECT array_to_string(p[1:i], '/') AS path, any_value(array_to_string(p[1:i - 1], '/')) AS parent, any_value(p[i]) AS name, any_value(i)::BIGINT AS depth, bool_or(i < len(p)) AS is_folder FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM parts) GROUP BY 1)"
_paths = lambda g: g.nodes.select(F.col("file_path").alias("path"))
add("file_tree", "keys", lambda g: filetree.tree(_paths(g)), "SELECT path, parent, name, depth, is_folder FROM tree", _TREE)
add("tree_search", "keys", lambda g: filetree.search(filetree.tree(_paths(g)), "77"), "SELECT path, parent, name, depth, is_folder FROM tree t WHERE contains(name, '77') OR EXISTS (SELECT 1 FROM tree h WHERE contains(h.name, '77') AND starts_with(h.path, t.path || '/'))", _TREE)
add("common_base", "keys", lambda g: filetree.common_base(_paths(g).filter("path LIKE 'p1/c%'").select(F.concat(F.lit("/x/y/"), "path").alias("path"))), "SELECT regexp_replace(left(lo, (SELECT max(k) FROM range(0, 40) AS r(k) WHERE left(lo, k) = left(hi, k))), '/[^/]*$', '') AS base FROM (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT '/x/y/' || file_path AS p FROM nodes WHERE file_path LIKE 'p1/c%'))")
add("highlight", "keys", lambda g: graph.highlighted(g.nodes.select("ix", "id"), g.nodes.filter("ix % 9 = 0").select("id")), "SELECT ix, id, ix % 9 = 0 AS in_path FROM nodes")
add("display_marks", "keys", lambda g: graph.display(risk.risk_v2(g).join(g.nodes.select("ix", "id"), "ix").select("id", "risk", (F.col("risk") * 2).alias("chokepoint"), F.col("risk").alias("importance"), (F.col("ix") % 23).alias("community"))), f"SELECT id, r > 0.7 AS is_risky, r * 2 > 0.7 AS is_chokepoint, round(0.5 + 1.5 * r, 6) AS scale, (ix % 23) % 10 AS color_index FROM (SELECT *, {_RISK2}::DOUBLE AS r FROM deg)")
add("extension_language", "keys", lambda g: g.nodes.select("ix", languages.language_of(F.concat("name", F.element_at(F.array(*[F.lit(x) for x in (".ts", ".py", ".c", ".md", ".jsx", ".h")]), (F.col("ix") % 6 + 1).cast("int")))).alias("language")), "SELECT ix, CASE ix % 6 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'c' WHEN 4 THEN 'javascript' WHEN 5 THEN 'c' END AS language FROM nodes")

for _name, _query in trees.QUERIES.items():
    QUERIES[_name] = (lambda query: lambda spark, sf_dir: tidy(query(spark, sf_dir)))(_query)
    ORACLE_SQL[_name] = trees.ORACLE_SQL[_name]
