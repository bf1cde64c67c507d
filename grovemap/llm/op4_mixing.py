"""Mixing sources to target weights by deterministic repetition.

Tokens are summed for each source; the source's rate is its target share of
all tokens over its own tokens. A document is emitted floor(rate) times, and
once more if a hash of the seed and its id falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.llm.common import cut, table, words_in

#: Target weights of sources, relative to each other; sources not named have DEFAULT_WEIGHT.
WEIGHTS: Mapping[str, float] = {"src0": 2.0, "src1": 3.0, "src2": 1.5}
DEFAULT_WEIGHT = 1.0
SEED = 20240607


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) with 32 bits, from the md5 of seed and key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def weight(source: Column, weights: Mapping[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    pairs = F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))])
    return F.coalesce(F.element_at(pairs, source), F.lit(float(default)))


def rates(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, budget: int | None = None) -> DataFrame:
    """(_gm_source, tokens, rate) of each source, null being a source of its own. budget: tokens of the whole mixture, by default as many as there are. A source without a token has rate 0."""
    sums = docs.select(F.col("source").cast("string").alias("_gm_source"), words_in(F.col("text").cast("string")).alias("n")).groupBy("_gm_source").agg(F.sum("n").alias("tokens"))
    shares = sums.withColumn("w", F.when(F.col("tokens") > 0, weight(F.coalesce("_gm_source", F.lit("")), weights, default)).otherwise(0.0))
    total = shares.agg(F.sum("tokens").alias("all_tokens"), F.sum("w").alias("all_w"))
    whole = F.col("all_tokens").cast("double") if budget is None else F.lit(float(budget))
    rate = F.when((F.col("tokens") > 0) & (F.col("all_w") > 0), F.col("w") / F.col("all_w") * whole / F.col("tokens")).otherwise(0.0)
    return shares.crossJoin(total).select("_gm_source", "tokens", rate.alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, default: float = DEFAULT_WEIGHT, seed: int = SEED, budget: int | None = None, copy_col: str | None = None) -> DataFrame:
    """docs with each row emitted floor(rate) times plus one hash-seeded Bernoulli copy; copy_col, if named, numbers the copies from 0.

    The draw depends on the seed and the id alone: repeated rows of one id
    are drawn alike, and rows with a null id share one draw. Null and empty
    texts count no token but are emitted at their source's rate; where a source
    has no token at all its rate is 0. The null source is a source with the
    default weight. Texts of any length are counted whole; an empty table gives
    no row. Extra columns pass through; one of copy_col's name is replaced.
    """
    # The table of rates has a row for each source. Written out, its size is known to the planner, which broadcasts it if that allows; else the join shuffles, and AQE splits hot sources.
    r = cut(rates(docs, weights, default, budget), "rates").select(F.col("_gm_source"), F.col("rate").alias("_gm_rate"))
    joined = docs.join(r, docs["source"].cast("string").eqNullSafe(r["_gm_source"]))
    whole = F.floor("_gm_rate")
    copies = (whole + F.when(uniform(seed, docs["doc_id"]) < F.col("_gm_rate") - whole, 1).otherwise(0)).cast("int")
    out = joined.withColumn("_gm_copy", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    kept = [docs[c] for c in docs.columns if not copy_col or c.lower() != copy_col.lower()]
    return out.select(*kept, *([F.col("_gm_copy").cast("long").alias(copy_col)] if copy_col else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), copy_col="copy_no")


_W = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(WEIGHTS.items())) + f" ELSE {DEFAULT_WEIGHT} END"
SQL = rf"""
WITH d AS (SELECT *, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ')) END AS n FROM documents),
s AS (SELECT source AS src, sum(n)::DOUBLE AS tokens, CASE WHEN sum(n) > 0 THEN {_W}::DOUBLE ELSE 0 END AS w FROM d GROUP BY source),
r AS (SELECT src, CASE WHEN tokens > 0 THEN w / (SELECT sum(w) FROM s) * (SELECT sum(tokens) FROM s) / tokens ELSE 0 END AS rate FROM s),
c AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 8))::BIGINT / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.src)
SELECT doc_id, text, lang, source, n_chars, unnest(range(copies)) AS copy_no FROM c WHERE copies > 0
"""
