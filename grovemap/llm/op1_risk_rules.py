"""Quality rules with risk-controlled thresholds.

Each rule rejects documents with a feature above a cutoff. Labelled documents
are the holdout: for each stratum, rule and cutoff an exact binomial test asks
whether good documents are rejected at less than the allowed rate. All tests
share the error probability by Bonferroni's correction, so that with
probability 1 - DELTA every cutoff chosen keeps its promise.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovemap.llm.common import cut, spread, table

#: Largest share of a stratum's good documents that all rules together may reject, and the probability that this fails.
MAX_FALSE_REJECTION = 0.05
DELTA = 0.05
CUTOFFS = [0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
RULES = ["symbols", "capitals", "digits", "repeated_words", "repeated_lines"]
ALPHA = MAX_FALSE_REJECTION / len(RULES)
SYMBOLS = "#$%&*|!^~<>{}=+@\\_"


def features(text: Column) -> dict[str, Column]:
    """Features in [0, 1]; 0 for null and empty texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    lines, words = F.col("_gm_lines"), F.col("_gm_words")
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b), lambda x: x))
    return {
        "symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) / n,
        "capitals": (F.length(t) - F.length(F.regexp_replace(t, "[A-ZÀ-Þ]", ""))) / n,
        "digits": (F.length(t) - F.length(F.translate(t, "0123456789", ""))) / n,
        "repeated_words": again / F.size(words).cast("double"),
        "repeated_lines": F.lit(1.0) - F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """(id, stratum, rules): a narrow row for each document."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = spread(docs.select("doc_id", "lang", "text")).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("none")).alias("stratum"), t.alias("_gm_text"), F.split(t, "\n").alias("_gm_lines"), F.split(F.trim(F.regexp_replace(t, r"\s+", " ")), " ").alias("_gm_words"))
    return base.select("id", "stratum", *[c.alias(k) for k, c in features(F.col("_gm_text")).items()])


def log_binomial_tail(k: int, n: int, p: float) -> float:
    """log P(X <= k) of a binomial variable."""
    terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
    top = max(terms)
    return top + math.log(math.fsum(math.exp(x - top) for x in terms))


def false_rejection_p(rejected: str, good: str, alpha: float = ALPHA) -> Column:
    """p-value of 'good documents are rejected at a rate of alpha or more'. At or above the expected number it is beyond any level of use and given as 1."""

    @F.pandas_udf("double")
    def run(rejected: pd.Series, good: pd.Series) -> pd.Series:
        return pd.Series([1.0 if n == 0 or k >= n * alpha else math.exp(log_binomial_tail(int(k), int(n), alpha)) for k, n in zip(rejected, good)])

    return run(rejected, good)


def thresholds(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(stratum, rule, cutoff) where one is certified to reject more bad than good labelled documents; of several the one that does so by most, of equals the highest.

    A document whose labels differ counts as good, since that is the side on
    which errors are bounded. Of several texts of one id the one of the least
    stratum and features counts, once. Labels or rows with a null id, and
    labels without a quality, count nothing.
    """
    marks = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality").cast("int")).alias("good"))
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), reduce(lambda a, b: a + b, [F.when(F.col(r) > c, 1).otherwise(0) for c in CUTOFFS]).alias("above")) for r in RULES]))
    one = rows.join(marks, "id").groupBy("id", "good").agg(F.min(F.struct("stratum", *RULES)).alias("r")).select("good", "r.*")
    held = one.select("stratum", (F.col("good") > 0).alias("good"), pairs.alias("p"))
    bins = held.groupBy("stratum", "p.rule", "p.above").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # from here on a few rows for each stratum
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for i, c in enumerate(CUTOFFS)]))
    each = bins.withColumn("s", steps).groupBy("stratum", "rule", "s.step", "s.cutoff").agg(*[F.sum(F.when(F.col("above") > F.col("s.step"), F.col(k)).otherwise(0)).alias(f"{k}_out") for k in ("good", "bad")], F.sum("good").alias("n_good"))
    tests = each.withColumn("tests", F.count(F.lit(1)).over(Window.partitionBy()))
    sure = tests.filter(false_rejection_p("good_out", "n_good", alpha) <= F.lit(DELTA) / F.col("tests")).withColumn("gain", F.col("bad_out") - F.col("good_out")).filter("gain > 0")
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("cutoff"))
    return sure.withColumn("place", F.row_number().over(best)).filter("place = 1").select("stratum", "rule", "cutoff")


def kept(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, stratum) of each document that no certified rule rejects.

    Strata are languages, null being one of its own. A stratum with too few
    good labelled documents to certify a cutoff keeps all its documents, and so
    does a table without labels. Null and empty texts have features of 0 and
    stay, whatever their id; texts of any length are measured to their end;
    repeated rows are each judged, once counted for the thresholds; an empty
    table gives no row; other columns are ignored. alpha: the share of good
    documents that each rule may reject.
    """
    rows = cut(measured(docs), "features")
    chosen = thresholds(rows, labels, alpha).groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in RULES])
    over = reduce(lambda a, b: a | b, [F.coalesce(F.col(r) > F.col(f"max_{r}"), F.lit(False)) for r in RULES])
    return rows.join(chosen, "stratum", "left").filter(~over).select(F.col("id").alias("doc_id"), "stratum")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def rules_at_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a rate that the holdouts of small tables can certify."""
    return kept(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), 0.5)


def _sql(alpha: float = ALPHA) -> str:
    n = "greatest(length(t), 1)::DOUBLE"
    above = lambda r: " + ".join(f"({r} > {c})::INT" for c in CUTOFFS)
    symbols = SYMBOLS.replace("'", "''")
    return rf"""
WITH b AS (SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines, string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' ') AS w FROM documents),
f AS (SELECT doc_id, stratum, (length(t) - length(translate(t, '{symbols}', ''))) / {n} AS symbols, (length(t) - length(regexp_replace(t, '[A-ZÀ-Þ]', '', 'g'))) / {n} AS capitals, (length(t) - length(translate(t, '0123456789', ''))) / {n} AS digits,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / len(w)::DOUBLE AS repeated_words, 1.0::DOUBLE - len(list_distinct(lines)) / len(lines)::DOUBLE AS repeated_lines FROM b),
m AS (SELECT doc_id, max(quality) > 0 AS good FROM labels GROUP BY doc_id),
h AS ({" UNION ALL ".join(f"SELECT stratum, good, '{r}' AS rule, {above(r)} AS above FROM f JOIN m USING (doc_id)" for r in RULES)}),
g AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (good AND above > step) AS good_out, count(*) FILTER (NOT good AND above > step) AS bad_out, count(*) FILTER (good) AS n FROM h, (VALUES {", ".join(f"({i}, {c}::DOUBLE)" for i, c in enumerate(CUTOFFS))}) AS s(step, cutoff) GROUP BY ALL),
p AS (SELECT *, (SELECT count(*) FROM g) AS tests, CASE WHEN n = 0 OR good_out >= n * {alpha}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, good_out + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({alpha}::DOUBLE) + (n - j) * ln(1 - {alpha}::DOUBLE)))) END AS p FROM g),
c AS (SELECT stratum, rule, cutoff FROM p WHERE p <= {DELTA} / tests AND bad_out > good_out QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad_out - good_out DESC, cutoff DESC) = 1)
SELECT doc_id, stratum FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = f.stratum AND CASE c.rule {" ".join(f"WHEN '{r}' THEN f.{r}" for r in RULES)} END > c.cutoff)
"""


SQL, HALF_SQL = _sql(), _sql(0.5)
