"""Shared helpers: table access, lineage cuts in the shared folder, even spread, bounded text chunks."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovemap.cluster import cut

__all__ = ["CHUNK_CHARS", "WORD", "chunks", "cut", "few", "least_hashed", "release", "spread", "table", "tidy", "without", "words_in"]

WORD = re.compile(r"\w+")
#: Characters of text that a Python worker tokenises at a time.
CHUNK_CHARS = 1_000_000
#: Ids that are sent to all tasks, where each takes some 50 bytes; more are joined by a shuffle.
SENT_IDS = 1_000_000

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its scan has fewer partitions than those, as a single small file has; tables of many files stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # a plan with a shuffle is spread already, and asking it for its partitions would run it
    if "Exchange" in df._jdf.queryExecution().sparkPlan().toString() or df._jdf.queryExecution().executedPlan().nodeName().startswith("Adaptive"):
        return df
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def least_hashed(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows of at most limit keys, those of the least hash, each with the least of its rows. Keys above a hash that about twice as many stay below are dropped first, so that what tasks hand to the driver doesn't grow with the table."""
    h, n = F.xxhash64(key), rows.agg(F.approx_count_distinct(key, 0.02)).first()[0]
    if n > 4 * limit:
        rows = rows.filter(h < F.lit(int(-(2**63) + 2 * limit / n * 2**64)))
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, "r.*")
    return one.orderBy(h, key).limit(limit)


def few(ids: DataFrame) -> DataFrame:
    """ids, a written table, marked to be sent to all tasks if it has no more than SENT_IDS rows; else as it is."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among ids (_gm_id), a written table. As long as the ids can be sent to the documents, these aren't shuffled."""
    gone = few(ids.select("_gm_id"))
    return docs.join(gone, docs["doc_id"] == gone["_gm_id"], "left_anti")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, which afterwards hands its memory back to the system: Python workers stay alive between stages."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def words_in(text: Column) -> Column:
    """Number of white-space separated words; 0 for null and blank text."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, " "))).cast("long")


def chunks(texts: Sequence[str | None], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of at most about limit characters; a longer text is a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)
