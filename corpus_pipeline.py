"""Corpus pipeline: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and all rows that the one before kept;
its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovemap.llm.common import cut, table
from grovemap.llm.op4_mixing import mix
from grovemap.llm.op5_sharding import shard
from grovemap.llm.op6_nbsvm import good_documents
from grovemap.llm.op7_decontaminate import clean_documents
from grovemap.llm.op8_simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; rows without a token, and every row where the labels lack a class, stay. Labels and texts may be null, ids repeated; an empty table stays empty."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; rows with a null id and texts without a word stay, repeated rows are one."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; rows with a null id or text stay."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says; repeated rows are drawn alike, a source without a token has rate 0."""
    return mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with n_bytes, byte_start and shard, in the order of ids, null ids first."""
    return shard(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mixture", mixture), ("shards", shards)]

#: The first three stages fit a model, compare fingerprints and search an index, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
