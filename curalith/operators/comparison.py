"""Results of several models side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions.text import fixed


def side_by_side(sentences: DataFrame, results: DataFrame, on: str, models: list[str], metrics: list[str]) -> DataFrame:
    """``sentences`` with each metric of each model (``model_metric``); null where a model has none.
    Of a model's repeated results for a sentence the least, compared by all metrics, stands."""
    best = results.groupBy(on, "model").agg(F.min(F.struct(*metrics)).alias("r")).select(on, "model", "r.*")
    wide = best.groupBy(on).pivot("model", models).agg(*[F.first(m).alias(m) for m in metrics])  # one row each
    return sentences.join(wide, on, "left")


def comparison_sheet(sentences: DataFrame, results: DataFrame, on: str, models: list[str]) -> DataFrame:
    """``sentences`` with each model's audio, time_s, duration_s (two digits) and drop_st (one digit)
    as texts; empty where there is none."""
    digits = {"audio": None, "time_s": 2, "duration_s": 2, "drop_st": 1}
    wide = side_by_side(sentences, results, on, models, list(digits))
    shown = lambda name, n: F.col(name) if n is None else fixed(F.col(name), n)
    return wide.select(*sentences.columns, *[F.coalesce(shown(f"{m}_{k}", n), F.lit("")).alias(f"{m}_{k}") for m in models for k, n in digits.items()])


def real_time_factors(results: DataFrame, drop_st: float = 5.0) -> DataFrame:
    """model, n, rtf (the sum of times over the sum of durations), drifted."""
    return results.groupBy("model").agg(F.count("*").alias("n"), F.try_divide(F.sum("time_s"), F.sum("duration_s")).alias("rtf"), F.count_if(F.col("drop_st") >= drop_st).alias("drifted"))
