"""Joins of scripts, audio and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.functions.text import clip_id


def with_transcripts(audio: DataFrame, scripts: DataFrame) -> DataFrame:
    """Every audio row (id) with its script's text and pos; without one, an error.  Scripts' order
    first, then the rest by id (column place is that order's sort key)."""
    joined = audio.join(scripts.select("id", "text", "pos").withColumn("_known", F.lit(True)), "id", "left")
    place = F.struct(F.col("pos").isNull().alias("orphan"), "pos", "id")
    return joined.select("*", F.coalesce("_known", F.lit(False)).alias("has_text"), F.when(F.col("_known").isNull(), F.array(F.lit("no transcript for this audio file"))).otherwise(F.array().cast("array<string>")).alias("errors"), place.alias("place")).drop("_known")


def missing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Keys of ``left`` that ``right`` lacks."""
    return left.select(on).distinct().join(right.select(on), on, "left_anti")


def todo(planned: DataFrame, done: DataFrame, on: str = "clip_id") -> DataFrame:
    """What of ``planned`` isn't in the log ``done`` yet."""
    return planned.join(done.select(on).distinct(), on, "left_anti")


def with_category(records: DataFrame, categories: DataFrame, on: str) -> DataFrame:
    """``records`` with category; "unknown" where there is none."""
    return records.join(categories.select(on, "category"), on, "left").withColumn("category", F.coalesce("category", F.lit("unknown")))


def text_collisions(rows: DataFrame, text: str, script: str, id_: str) -> DataFrame:
    """The ``rows`` whose text, but for case, another script (of few scripts) has too: its name and
    its least id there, in other_script and other_id; of several the first.  Texts are joined with
    their scripts, not with each other, so a common text costs no more than its rows."""
    keyed = rows.withColumn("_key", F.sha2(F.lower(text).cast("binary"), 256))
    scripts = keyed.filter("_key IS NOT NULL").groupBy("_key", script).agg(F.min(id_).alias("i"))
    two = F.slice(F.array_sort(F.collect_list(F.struct(F.col(script).alias("s"), "i"))), 1, 2)
    found = scripts.filter(F.col(script).isNotNull()).groupBy("_key").agg(two.alias("_two")).filter(F.size("_two") > 1)
    other = F.when(F.col(script) == F.col("_two")[0]["s"], F.col("_two")[1]).otherwise(F.col("_two")[0])
    return keyed.join(found, "_key").withColumns({"other_script": other["s"], "other_id": other["i"]}).drop("_key", "_two")


def clauses(rows: DataFrame, split: Column, id_: str) -> DataFrame:
    """A row for each clause of ``split`` (an array column), with clip_id and clause."""
    return rows.withColumn("_all", split).select("*", F.posexplode("_all").alias("_k", "clause")).select(*rows.columns, clip_id(F.col(id_).cast("string"), F.size("_all"), F.col("_k") + 1).alias("clip_id"), "clause")
