"""Resumable logs as stream sinks: each key is added once, however often a batch is repeated."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from curalith.sources.tables import read_small, stored, write_small

CONFIG = "_run_config.json"


def guard_config(spark: SparkSession, log_path: str, config: dict) -> None:
    """Keeps the settings of the run that began the log at ``log_path``; raises where a resumed run's
    differ, and names what does."""
    known = read_small(spark, f"{log_path}/{CONFIG}")
    if known is None:
        write_small(spark, f"{log_path}/{CONFIG}", json.dumps(config, ensure_ascii=False, sort_keys=True, indent=2), overwrite=False)
        return
    before = json.loads(known)
    now = json.loads(json.dumps(config))
    unlike = sorted(k for k in before.keys() | now.keys() if before.get(k) != now.get(k))
    if unlike:
        raise ValueError(f"{log_path} was begun with other settings: " + ", ".join(f"{k} {before.get(k)!r}, now {now.get(k)!r}" for k in unlike))


def _missing(e: AnalysisException) -> bool:
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_appended(spark: SparkSession, log_path: str) -> DataFrame:
    """The log, whatever batches it was written in."""
    return spark.read.option("basePath", log_path).parquet(log_path).drop("batch")


def append_new(stream: DataFrame, log_path: str, checkpoint: str, key: str = "clip_id", config: dict | None = None) -> StreamingQuery:
    """Appends to the Parquet log at ``log_path`` the rows of ``stream`` whose ``key`` it hasn't yet.

    Keys that the stream has seen stand in its state, under ``checkpoint``.  What the log held before
    this query began is read once, and its keys are written down; batches are held against those.
    Each batch overwrites a folder of its own number and checkpoint, so a batch that is killed and
    run again adds nothing twice."""
    spark = stream.sparkSession
    if config is not None:
        guard_config(spark, log_path, config)
    writer = f"{hash_of(checkpoint):x}"
    try:
        done = spark.read.option("basePath", log_path).parquet(log_path)
        # this query's own batches are remembered by its state, and may be written again
        own = done.filter(~done["batch"].startswith(f"{writer}-")) if "batch" in done.columns else done
        known = stored(own.select(key).distinct(), "keys")
    except AnalysisException as e:
        if not _missing(e):
            raise
        known = None

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if known is None else batch.join(known, key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={writer}-{number}")

    return stream.dropDuplicates([key]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hash_of(name: str) -> int:
    """A number of 48 bits that a name always has."""
    return int.from_bytes(sha256(name.encode()).digest()[:6], "big")
