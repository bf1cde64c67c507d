"""Composite scores, summaries and the per-node contract of a client."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.functions.exprs import clamp, scaled
from grovemap.operators import centrality, community, quality, risk
from grovemap.operators.graph import Graph, degrees, with_degrees

#: Measures by name, each from a graph to (ix, value columns). More can be registered.
METRICS: dict[str, Callable[[Graph], DataFrame]] = {
    "degree": centrality.degree_v2, "pagerank": centrality.pagerank, "betweenness": centrality.betweenness_v1, "closeness": centrality.closeness, "clustering": centrality.clustering, "coupling": quality.coupling_v2, "complexity": quality.cyclomatic_v1, "maintainability": quality.maintainability_v2, "risk": risk.risk_v2, "chokepoint": risk.chokepoint_v1,
}


def register(name: str, metric: Callable[[Graph], DataFrame]) -> None:
    METRICS[name] = metric


def run_metrics(g: Graph, names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results by name, and the errors of measures that failed; one failure leaves the others alone."""
    results, errors = {}, {}
    for name in names or list(METRICS):
        try:
            results[name] = METRICS[name](g)
        except Exception as e:
            errors[name] = f"{type(e).__name__}: {e}"
    return results, errors


def long_form(results: dict[str, DataFrame]) -> DataFrame:
    """(ix, metric, value) of all numeric columns."""
    out = None
    for name, df in results.items():
        columns = [c for c, kind in df.dtypes if c != "ix" and kind in ("double", "int", "bigint")]
        rows = df.select("ix", F.explode(F.create_map(*[x for c in columns for x in (F.lit(name if c == name else f"{name}.{c}"), F.col(c).cast("double"))])).alias("metric", "value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def ranges(g: Graph, between: DataFrame | None = None, clustered: DataFrame | None = None) -> DataFrame:
    """One row of least and greatest betweenness, clustering, cyclomatic complexity and in-degree, and constants for the rest. between, clustered: these measures, where they are known already."""
    between = centrality.betweenness_v1(g) if between is None else between
    clustered = centrality.clustering(g) if clustered is None else clustered
    rows = between.join(clustered, "ix").join(quality.cyclomatic_v1(g), "ix").join(degrees(g), "ix")
    pair = lambda c, name: (F.coalesce(F.min(c), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(c), F.lit(1.0)).alias(f"{name}_max"))
    found = rows.agg(*pair("betweenness", "betweenness"), *pair("clustering", "clustering"), *pair("cyclomatic", "cyclomatic"), *pair(F.col("d_in").cast("double"), "in_degree"))
    fixed = {"pagerank_imports": (0.0, 1.0), "pagerank_calls": (0.0, 1.0), "k_core": (0.0, 10.0), "churn": (0.0, 100.0), "owners": (0.0, 10.0), "coverage": (0.0, 1.0)}
    return found.select("*", *[F.lit(v).alias(f"{k}_{end}") for k, pair_ in fixed.items() for end, v in zip(("min", "max"), pair_)])


def composites(g: Graph, ranked: DataFrame | None = None, between: DataFrame | None = None) -> DataFrame:
    """(ix, importance, chokepoint, risk, payoff). ranked, between: PageRank and betweenness, where they are known already."""
    ranked = centrality.pagerank(g) if ranked is None else ranked
    # stands in the rows and in their range
    between = cut(centrality.betweenness_v1(g), "between") if between is None else between
    spread = between.agg(F.min("betweenness").alias("lo"), F.max("betweenness").alias("hi"))
    zero, one = F.lit(0.0), F.lit(1.0)
    scores = g.nodes.select("ix").join(ranked, "ix").join(between, "ix").join(centrality.degree_v1(g).select("ix", "degree"), "ix", "left").join(risk.risk_v1(g).select("ix", "risk"), "ix").join(risk.chokepoint_v1(g), "ix").crossJoin(F.broadcast(spread))
    importance = 0.5 * scaled(F.col("pagerank"), zero, one) + 0.3 * scaled(F.coalesce("degree", zero), zero, one) + 0.2 * scaled(F.col("betweenness"), F.col("lo"), F.col("hi"))
    out = scores.withColumn("importance", importance)
    return out.select("ix", "importance", "chokepoint", "risk", (0.4 * F.col("risk") + 0.3 * F.col("importance") + 0.3 * F.lit(0.5)).alias("payoff"))


def summary_v1(g: Graph, communities: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, mean cyclomatic complexity, nodes of risk above 0.7, cycles, and communities with their modularity if given."""
    parts = [
        g.nodes.agg(F.count(F.lit(1)).alias("total_nodes")), g.edges.agg(F.count(F.lit(1)).alias("total_edges")),
        quality.cyclomatic_v1(g).agg(F.coalesce(F.avg("cyclomatic"), F.lit(0.0)).alias("avg_complexity")),
        risk.risk_v1(g).agg(F.count_if(F.col("risk") > 0.7).alias("high_risk_count")), risk.cycles(g, None).agg(F.count(F.lit(1)).alias("circular_dependencies")),
    ]
    if communities is not None:
        parts.append(communities.agg(F.countDistinct("community").alias("num_communities")))
        parts.append(community.modularity_v1(g, communities))
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out


def summary_v2(g: Graph) -> DataFrame:
    zero = F.lit(0.0)
    r = risk.risk_v2(g).agg(F.count_if(F.col("risk") > 0.7).alias("high_risk_count"), F.coalesce(F.avg("risk"), zero).alias("avg_risk"))
    q = quality.complexity_v2(g).agg(F.coalesce(F.avg("cyclomatic"), zero).alias("avg_complexity"))
    c = quality.cohesion_v2(g).agg(F.coalesce(F.avg("cohesion"), zero).alias("avg_cohesion"))
    s = quality.smells(g).agg(F.count(F.lit(1)).alias("total_smells"))
    k = risk.cycles(g).agg(F.count(F.lit(1)).alias("total_circular_deps"))
    return r.crossJoin(k).crossJoin(q).crossJoin(c).crossJoin(s)


def client_metrics(g: Graph, communities: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """The nested contract for each node: path (or id), name, type, community, composites, raw and normalised measures, version. extra: (ix, churn, owners, coverage), null where unknown."""
    # each measured once
    ranked, between, clustered = (cut(f(g), name) for name, f in (("ranked", centrality.pagerank), ("between", centrality.betweenness_v1), ("clustered", centrality.clustering)))
    rows = with_degrees(g).join(composites(g, ranked, between), "ix").join(ranked, "ix").join(between, "ix").join(clustered, "ix").join(centrality.core_numbers(g), "ix").join(quality.cyclomatic_v1(g), "ix").crossJoin(F.broadcast(ranges(g, between, clustered)))
    if communities is not None:
        rows = rows.join(communities, "ix", "left")
    else:
        rows = rows.withColumn("community", F.lit(0).cast("long"))
    rows = rows.join(extra, "ix", "left") if extra is not None else rows.withColumns({c: F.lit(None).cast("double") for c in ("churn", "owners", "coverage")})
    f = lambda c: F.col(c).cast("float")
    norm = lambda c, lo, hi: scaled(F.col(c).cast("double"), lo, hi).cast("float")
    at = lambda name: (F.col(f"{name}_min"), F.col(f"{name}_max"))
    raw = F.struct("pagerank", "betweenness", "clustering", "k_core", F.col("d_in").alias("in_degree"), F.col("d_out").alias("out_degree"), F.col("cyclomatic").cast("bigint").alias("cyclomatic"), "churn", "owners", "coverage")
    normalized = F.struct(norm("pagerank", F.lit(0.0), F.lit(1.0)).alias("pagerank"), *[norm(c, *at(n)).alias(n) for c, n in (("betweenness", "betweenness"), ("clustering", "clustering"), ("cyclomatic", "cyclomatic"), ("d_in", "in_degree"), ("k_core", "k_core"))])
    return rows.select("ix", F.coalesce("file_path", "id").alias("path"), "name", "node_type", F.coalesce("community", F.lit(0)).alias("community"), f("importance").alias("importance"), f("chokepoint").alias("chokepoint"), f("risk").alias("risk"), f("payoff").alias("payoff"), raw.alias("raw"), normalized.alias("normalized"), F.lit(1).cast("tinyint").alias("version"))


def robust_units(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with each of columns between its 1 % and 99 % quantiles; 1 where they are equal."""
    ends = rows.agg(*[F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).alias(f"{c}_ends") for c in columns])

    def unit(c: str) -> Column:
        lo, hi = F.col(f"{c}_ends")[0], F.col(f"{c}_ends")[1]
        return F.when(hi == lo, 1.0).otherwise(clamp((F.col(c) - lo) / F.nullif(hi - lo, F.lit(0.0))))

    return rows.crossJoin(F.broadcast(ends)).withColumns({c: unit(c) for c in columns}).select(*rows.columns)


def robust_scaled(values: DataFrame) -> DataFrame:
    """(ix, scaled) of (ix, value) between its 1 % and 99 % quantiles; 1 where they are equal."""
    return robust_units(values, ["value"]).select("ix", F.col("value").alias("scaled"))


def top_important(scores: DataFrame, most: int) -> DataFrame:
    return scores.orderBy(F.desc("importance"), "ix").limit(most)


def high_payoff(scores: DataFrame, least: float) -> DataFrame:
    return scores.filter(F.col("payoff") >= least)
