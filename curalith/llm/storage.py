"""Tables that cut lineage: written to the folder that the cluster shares, read again from there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (as in tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    on_one_machine = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    return f"file://{tempfile.gettempdir()}/curalith-checkpoints" if on_one_machine else "curalith-checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: texts are some KB each, and a batch stands in memory several times.
BATCH_ROWS = 1000


def text_batches(batches):
    """Arrow batches of bounded size, whatever the session's own bound is."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(lo, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of bounded size while an action of our own runs, then the session's own again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps never redo it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: A key with at least one of so many rows is a hot one: there are at most that many.
HOT_SHARE = 2000


def hot_join(rows: DataFrame, found: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``found``, which has one row for each of its keys, its
    number of rows in ``copies`` (left out here) and is read twice.  Rows of hot keys aren't
    shuffled: those keys, at most HOT_SHARE, are sent to every task."""
    hot = F.col("copies") * HOT_SHARE >= max(1, rows.count())
    columns = [c for c in found.columns if c not in (*keys, "copies")]
    few = F.broadcast(found.filter(hot).select(*keys, *columns, F.lit(True).alias("_hot")))
    met = rows.join(few, keys, "left")
    rest = met.filter("_hot IS NULL").select(*rows.columns).join(found.filter(~hot).select(*keys, *columns).hint("merge"), keys, how)
    return rest.unionByName(met.filter("_hot").drop("_hot"))
