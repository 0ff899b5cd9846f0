"""Writers: tables, manifests, reports and resumable logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.sources.tables import write_small


def write_tsv(df: DataFrame, path: str, columns: list[str], mode: str = "errorifexists", bom: bool = False) -> None:
    """Chosen columns in order, with a header.  With ``bom`` each file begins with a byte order mark, by
    which spreadsheets know UTF-8; the readers here drop it."""
    shown = df.select(*columns).toDF(*[f"\ufeff{c}" if bom and not k else c for k, c in enumerate(columns)])
    shown.write.mode(mode).options(sep="\t", header=True, encoding="UTF-8", emptyValue="").csv(path)


def write_manifests(df: DataFrame, path: str) -> None:
    """JSON lines of id, audio and text in a folder for each split, ordered by id."""
    df.select("split", "id", "audio", "text").repartitionByRange("split", "id").sortWithinPartitions("split", "id").write.partitionBy("split").json(path)


def write_summary(spark: SparkSession, found: dict, path: str) -> None:
    """A summary of few numbers as one JSON file, in place of an older one."""
    write_small(spark, path, json.dumps(found, ensure_ascii=False, indent=2))


def append_log(df: DataFrame, path: str) -> None:
    """Rows added to a log; what is there stays."""
    df.write.mode("append").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, rows: int = 2000) -> None:
    """Shards of at most ``rows`` rows in place of older ones."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def create_once(df: DataFrame, path: str) -> None:
    """Writes a sheet for people to fill in; never over an existing one."""
    df.write.mode("ignore").option("header", True).csv(path)


def with_status(accepted: DataFrame) -> DataFrame:
    """Kept or excluded as a column; files aren't moved."""
    return accepted.withColumn("status", F.when(F.col("verdict") == "kept", "kept").otherwise("excluded"))


def checksums(files: DataFrame) -> DataFrame:
    """path, sha256 of files read as binaryFile."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def unlike_pins(files: DataFrame, pins: DataFrame) -> DataFrame:
    """name, expected, found of each of ``pins`` (name, sha256) whose file (of ``files``, read as
    binaryFile) has another checksum, or is missing (found is null).  Case doesn't matter."""
    found = checksums(files).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("sha256").alias("found"))
    rows = pins.select("name", F.lower("sha256").alias("expected")).join(found, "name", "left")
    return rows.filter(~F.col("expected").eqNullSafe(F.col("found")))


def text_report(sections: dict[str, list[str]]) -> str:
    """A report of few lines: a heading for each section, "none" under an empty one."""
    return "\n".join(line for title, lines in sections.items() for line in (title, *(f"  {x}" for x in lines or ["none"]), "")) + "\n"


def missing_files(spark, paths: list[str]) -> list[str]:
    """Those of a short list of required paths that don't exist."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    return [p for p in paths if not exists(p)]
