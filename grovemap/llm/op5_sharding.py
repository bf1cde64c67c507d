"""Contiguous balanced shards from global byte-size prefix sums.

Documents are ordered by id. The order is split into ranges; each range's byte
total is summed on its own, the running sum over the totals places the range,
and a running sum inside it places the document. Equal cuts of the whole give
the shards. No sum runs over all rows in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemap.llm.common import table

SHARDS = 64
#: Text bytes that a range of the order is to hold, and the most ranges; larger tables get larger ranges.
RANGE_BYTES = 16_000_000
MAX_RANGES = 100_000
#: Most quantiles that one aggregation finds; more ranges take two levels of them.
QUANTILES = 1000
_FIRST = -(2**63)


def range_bounds(keys: DataFrame, ranges: int) -> list[int]:
    """About ranges - 1 keys (k) in order that cut the rows into about equal ranges. A key that fills several ranges stands there as often."""
    if ranges <= 1:
        return []
    coarse = -(-ranges // QUANTILES)
    fine = -(-ranges // coarse)
    cuts = lambda n: F.percentile_approx("k", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))
    if coarse == 1:
        return sorted(keys.agg(cuts(ranges)).first()[0] or [])
    tops = sorted(keys.agg(cuts(coarse)).first()[0] or [])
    inside = keys.groupBy(_range_of(F.col("k"), F.lit(0.0), tops).alias("top")).agg(cuts(fine).alias("b")).collect()
    return sorted([*tops, *(x for r in inside for x in r["b"] or [])])


def _range_of(key: Column, tie: Column, bounds: list[int]) -> Column:
    """Number of bounds below key. The rows of a key that is a bound several times are shared out over the ranges between those by tie, from 0 to 1."""
    if not bounds:
        return F.lit(0)
    at = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def run(keys: pd.Series, ties: pd.Series) -> pd.Series:
        k = keys.to_numpy(np.int64)
        low = np.searchsorted(at, k, "left")
        many = np.searchsorted(at, k, "right") - low
        return pd.Series((low + np.where(many > 1, np.minimum((ties.to_numpy() * (many + 1)).astype(np.int64), many), 0)).astype(np.int32))

    return run(key, tie)


def shard(docs: DataFrame, shards: int = SHARDS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, byte_start and shard (0 to shards - 1).

    byte_start is the UTF-8 size of all rows before this one in the order of
    id, ties in the order of a hash of the row; shard is where the row's first
    byte falls in `shards` equal parts, so that a long document may leave a
    part empty. Null ids come first, null and empty texts have 0 bytes, and
    rows after the last byte join the last shard. Repeated rows stand side by
    side. An empty table stays empty. If docs has columns of the three names
    they are replaced.
    """
    base = docs.drop("n_bytes", "byte_start", "shard")
    size = F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    # maps and variants have no hash of their own
    tie = F.xxhash64(*[F.to_json(f"`{c}`") if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in base.dtypes])
    total = base.agg(F.sum(size)).first()[0] or 0
    bounds = range_bounds(base.select(key.alias("k")), min(MAX_RANGES, -(-total // range_bytes)))
    # the hash takes the whole row, so that it is left out where no key fills several ranges
    share = (tie.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) if len(set(bounds)) < len(bounds) else F.lit(0.0)
    placed = _range_of(key, share, bounds)
    marked = base.withColumn("n_bytes", size).withColumn("_gm_range", placed)
    totals = base.select(placed.alias("_gm_r"), size.alias("b")).groupBy("_gm_r").agg(F.sum("b").alias("_gm_total"))
    before = totals.select("_gm_r", F.coalesce(F.sum("_gm_total").over(Window.orderBy("_gm_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_gm_before"))
    inside = F.sum("n_bytes").over(Window.partitionBy("_gm_range").orderBy(key, F.col(id_col).isNotNull(), tie).rowsBetween(Window.unboundedPreceding, -1))
    # a row for each range, at most about MAX_RANGES
    joined = marked.withColumn("_gm_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(before), F.col("_gm_range") == F.col("_gm_r"))
    out = joined.withColumn("byte_start", F.col("_gm_inside") + F.col("_gm_before"))
    number = F.least(F.floor(F.col("byte_start").cast("decimal(28,0)") * F.lit(shards) / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int")
    return out.withColumn("shard", number).select(*[F.col(f"`{c}`") for c in base.columns], "n_bytes", "byte_start", "shard")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT *, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
p AS (SELECT *, (sum(n_bytes) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_bytes)::BIGINT AS byte_start, (sum(n_bytes) OVER ())::BIGINT AS total FROM d)
SELECT doc_id, text, lang, source, n_chars, n_bytes, byte_start, least(byte_start * {SHARDS} // greatest(total, 1), {SHARDS - 1})::INTEGER AS shard FROM p
"""
