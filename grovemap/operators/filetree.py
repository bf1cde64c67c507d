"""File trees as parent-pointer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree(paths: DataFrame) -> DataFrame:
    """(path, parent, name, depth, is_folder) of all files in paths (path) and the folders above them, each once; parent is empty at the top. Empty path segments count for nothing."""
    parts = paths.select(F.filter(F.split("path", "/"), lambda x: x != "").alias("parts")).filter(F.size("parts") > 0)
    steps = parts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.struct(F.array_join(F.slice("parts", 1, i), "/").alias("path"), F.array_join(F.slice("parts", 1, i - 1), "/").alias("parent"), F.element_at("parts", i).alias("name"), i.alias("depth"), (i < F.size("parts")).alias("is_folder")))).alias("s"))
    return steps.select("s.*").groupBy("path").agg(F.first("parent").alias("parent"), F.first("name").alias("name"), F.first("depth").cast("long").alias("depth"), F.max("is_folder").alias("is_folder"))


def ordered(rows: DataFrame) -> DataFrame:
    """In the order of a listing: by parent, folders first, names without regard to case."""
    return rows.orderBy("parent", F.desc("is_folder"), F.lower("name"), "name")


def search(rows: DataFrame, text: str) -> DataFrame:
    """Entries whose name holds the text in any case, and the folders above them."""
    hits = rows.filter(F.lower("name").contains(text.lower()))
    above = hits.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("path")).distinct()
    return rows.join(above, "path", "left_semi")


def common_base(paths: DataFrame) -> DataFrame:
    """(base): the longest folder that all paths share. The least and the greatest path decide, since all others lie between."""
    ends = paths.agg(F.min("path").alias("a"), F.max("path").alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.element_at(a, i) == F.element_at(b, i))
    n = F.coalesce(F.array_position(same, F.lit(False)) - 1, F.lit(0))
    folders = F.least(F.size(a), F.size(b)) - 1
    return ends.select(F.coalesce(F.array_join(F.slice(a, 1, F.when(n >= 0, F.least(n, folders)).otherwise(folders).cast("int")), "/"), F.lit("")).alias("base"))
