"""Folders that are published whole: readers see the old version or the new one, never a part.

A version is written to a folder of its own; then a pointer file is put in place by a rename, which
is what readers follow.  A writer that fails leaves its folder behind and the pointer alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from curalith.sources.tables import file_system, read_small, write_small

POINTER = "_current"


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that is published at ``root``."""
    name = read_small(spark, f"{root}/{POINTER}")
    return f"{root}/{name.strip()}" if name else None


def publish(spark: SparkSession, root: str, write: Callable[[str], None], keep: int = 2) -> str:
    """Lets ``write`` fill a new version's folder, makes it the current one, and returns the folder.
    Of the versions that were published before, the last ``keep`` stay."""
    name = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    write_small(spark, f"{root}/{name}/_PUBLISHED", "")
    before = read_small(spark, f"{root}/{POINTER}")
    write_small(spark, f"{root}/_next-{name}", name)
    jvm, (fs, source) = spark.sparkContext._jvm, file_system(spark, f"{root}/_next-{name}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, options)
    _forget(spark, root, {name, (before or "").strip()}, keep)
    return f"{root}/{name}"


def _forget(spark: SparkSession, root: str, named: set[str], keep: int) -> None:
    """Removes published versions, oldest first, but for ``keep`` of them and those that are named.
    Folders without their mark may belong to another writer, so they stay."""
    fs, where = file_system(spark, root)
    jvm = spark.sparkContext._jvm
    marked = [s for s in fs.listStatus(where) if s.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_PUBLISHED"))]
    for s in sorted(marked, key=lambda s: s.getModificationTime())[: -keep or None]:
        if s.getPath().getName() not in named:
            fs.delete(s.getPath(), True)
