"""Graphs derived from the driver's tables, as DataFrames and as SQL.

handoff: users linked to the user of the next error event; cyclic and dense.
purchase: the same over purchases, kept where the value is above 130; sparse,
with many components. keys: regions, nations, customers, suppliers and orders
with foreign keys as references and containment, imports among nations and calls
from customers to suppliers; a typed graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemap.cluster import cut
from grovemap.operators.graph import Graph

#: Ids of users that one task numbers.
BLOCK = 1_000_000
_SIZE = "CAST(({x} * 37) % 1200 AS DOUBLE)"
_TYPE = "CASE {x} % 3 WHEN 0 THEN 'file' WHEN 1 THEN 'function' ELSE 'class' END"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _trail(spark: SparkSession, sf_dir: str, kind: str, least: float | None) -> Graph:
    events = _table(spark, sf_dir, "events")
    # places in order from totals of blocks of ids, so that no window sees all users
    ids = events.select("user_id").distinct().withColumn("block", F.floor(F.col("user_id") / BLOCK))
    before = ids.groupBy("block").agg(F.count(F.lit(1)).alias("c")).select("block", F.coalesce(F.sum("c").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    # written once, as nodes and both ends of edges rest on them
    users = cut(ids.join(before, "block").select("user_id", (F.col("before") + F.row_number().over(Window.partitionBy("block").orderBy("user_id")) - 1).cast("long").alias("ix")), "users")
    nodes = users.select("ix", F.col("user_id").cast("string").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("name"), F.expr(_TYPE.format(x="ix")).alias("node_type"), F.expr(_SIZE.format(x="ix")).alias("size"), F.lit("#888888").alias("color"), F.expr("concat('/d', CAST(ix % 7 AS STRING), '/f', CAST(ix AS STRING))").alias("file_path"))
    # the next event is in the same day, or else the first of the next day that has one
    rows = events.filter(F.col("event_type") == kind).select(F.col("event_id").alias("eix"), "ts", "user_id", "value", F.to_date("ts").alias("day"))
    first = rows.groupBy("day").agg(F.min(F.struct("ts", "eix", "user_id")).alias("first"))
    after = first.select("day", F.lead("first.user_id").over(Window.orderBy("day")).alias("after"))
    inside = F.lead("user_id").over(Window.partitionBy("day").orderBy("ts", "eix"))
    steps = rows.withColumn("inside", inside).join(after, "day").select("eix", "user_id", F.coalesce("inside", "after").alias("next_id"), "value").filter("next_id IS NOT NULL")
    if least is not None:
        steps = steps.filter(F.col("value") > least)
    a, b = users.select(F.col("user_id"), F.col("ix").alias("src")), users.select(F.col("user_id").alias("next_id"), F.col("ix").alias("dst"))
    edges = steps.join(a, "user_id").join(b, "next_id").select("eix", "src", "dst", F.lit("calls").alias("edge_type"), (F.col("eix") % 4).cast("double").alias("weight"))
    # written once, as the operators read them several times
    return Graph(nodes, cut(edges, "edges"))


def handoff(spark: SparkSession, sf_dir: str) -> Graph:
    return _trail(spark, sf_dir, "error", None)


def purchase(spark: SparkSession, sf_dir: str) -> Graph:
    return _trail(spark, sf_dir, "purchase", 130.0)


#: Offsets that keep the keys of the five tables apart in one numbering.
_KINDS = {"region": (0, "r_regionkey", "module"), "nation": (1, "n_nationkey", "file"), "supplier": (2, "s_suppkey", "class"), "customer": (3, "c_custkey", "class"), "orders": (4, "o_orderkey", "method")}
_BASE = 10**10
_LINKS = [("nation", "n_nationkey", "region", "n_regionkey", "imports", False), ("supplier", "s_suppkey", "nation", "s_nationkey", "contains", True), ("customer", "c_custkey", "nation", "c_nationkey", "contains", True), ("orders", "o_orderkey", "customer", "o_custkey", "contains", True), ("orders", "o_orderkey", "customer", "o_custkey", "references", False)]


def _keys_nodes_sql() -> str:
    text = "SELECT CAST({k} AS BIGINT) * {b} + {key} AS ix, concat('{t}:', CAST({key} AS VARCHAR(20))) AS id, concat('{t} ', CAST({key} AS VARCHAR(20))) AS name, '{kind}' AS node_type, CAST(({key} * 37) % 1200 AS DOUBLE) AS size, '#888888' AS color, concat('p', CAST({key} % 5 AS VARCHAR(20)), '/{t}/', CAST({key} AS VARCHAR(20))) AS file_path FROM {{{t}}}"
    return " UNION ALL ".join(text.format(k=k, b=_BASE, key=key, t=t, kind=kind) for t, (k, key, kind) in _KINDS.items())


def _keys_edges_sql() -> str:
    def link(n: int, key: str, a: str, b: str, kind: str, tables: str) -> str:
        return f"SELECT CAST({n} AS BIGINT) * {_BASE} + {key} AS eix, {a} AS src, {b} AS dst, '{kind}' AS edge_type, CAST(1.0 AS DOUBLE) AS weight FROM {tables}"

    at = lambda t, key: f"CAST({_KINDS[t][0]} AS BIGINT) * {_BASE} + {key}"
    out = []
    for n, (t, key, other, fk, kind, down) in enumerate(_LINKS):
        ends = (at(other, fk), at(t, key)) if down else (at(t, key), at(other, fk))
        out.append(link(n, key, *ends, kind, f"{{{t}}}"))
    out.append(link(5, "n_nationkey", at("nation", "n_nationkey"), at("nation", "((n_nationkey * 7 + 3) % 25)"), "imports", "{nation}"))
    out.append(link(6, "c_custkey", at("customer", "c_custkey"), at("supplier", "s_suppkey"), "calls", "{customer} JOIN {supplier} ON c_custkey = s_suppkey"))
    return " UNION ALL ".join(out)


def keys(spark: SparkSession, sf_dir: str) -> Graph:
    tables = {t: _table(spark, sf_dir, t) for t in _KINDS}
    return Graph(spark.sql(_keys_nodes_sql(), **tables), spark.sql(_keys_edges_sql(), **tables))


def _trail_sql(kind: str, least: float | None) -> str:
    return f"""u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS ix FROM (SELECT DISTINCT user_id FROM events)),
nodes AS (SELECT ix, user_id::VARCHAR AS id, {_TYPE.format(x="ix")} AS node_type, {_SIZE.format(x="ix")} AS size, '/d' || (ix % 7) || '/f' || ix AS file_path FROM u),
steps AS (SELECT event_id AS eix, user_id, lead(user_id) OVER (ORDER BY ts, event_id) AS next_id, value FROM events WHERE event_type = '{kind}'),
edges AS (SELECT eix, a.ix AS src, b.ix AS dst, 'calls' AS edge_type, (eix % 4)::DOUBLE AS weight FROM steps JOIN u a USING (user_id) JOIN u b ON steps.next_id = b.user_id {"" if least is None else f"WHERE value > {least}"})"""


_COMMON = """,
n AS (SELECT count(*) AS n FROM nodes),
deg AS (SELECT nodes.*, coalesce(i, 0) AS d_in, coalesce(o, 0) AS d_out, (SELECT n FROM n) AS n FROM nodes LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY dst) ON ix = dst LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY src) ON ix = src)"""
SQL = {"handoff": _trail_sql("error", None) + _COMMON, "purchase": _trail_sql("purchase", 130.0) + _COMMON, "keys": f"nodes AS ({_keys_nodes_sql()}), edges AS ({_keys_edges_sql()})".format(**{t: t for t in _KINDS}) + _COMMON}
GRAPHS = {"handoff": handoff, "purchase": purchase, "keys": keys}
