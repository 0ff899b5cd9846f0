"""Pitch tracks cut into windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOP_S = 512 / 16_000


def window_medians(frames: DataFrame, key: str, window_s: float = 1.0, least: int = 5) -> DataFrame:
    """key, windows: medians of the voiced f0 of each window of ``frames`` (i, f0, voiced), in
    order; null where fewer than ``least`` frames are voiced."""
    per_window = int(round(window_s / HOP_S))
    voiced = F.col("voiced") & F.col("f0").isNotNull() & ~F.isnan("f0")
    cut = frames.groupBy(key, F.floor(F.col("i") / per_window).alias("w")).agg(F.count_if(voiced).alias("n"), F.median(F.when(voiced, F.col("f0"))).alias("m"))
    rows = cut.select(key, F.struct("w", F.when(F.col("n") >= least, F.col("m")).alias("m")).alias("x"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["m"]).alias("windows"))
