"""Degrees kept up to date over a stream of edges.

An extension: the batch operators have no streaming counterpart in what they
were modelled on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_degrees(edges: DataFrame, watermark: str | None = None, window: str = "1 hour") -> DataFrame:
    """(ix, d_in, d_out), or with a watermark (window, ix, d_in, d_out), of streamed edges (src, dst, ts). State is one row for each node, of a window until the watermark passes it."""
    if watermark:
        edges = edges.withWatermark("ts", watermark)
    ends = edges.select("ts", F.explode(F.array(F.struct(F.col("src").alias("ix"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("ix"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("ts", "e.*")
    keys = [F.window("ts", window), "ix"] if watermark else ["ix"]
    return ends.groupBy(*keys).agg(F.sum("i").alias("d_in"), F.sum("o").alias("d_out"))
