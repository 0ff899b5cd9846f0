"""Connected components of a table of links.

Links are contracted in parts of bounded size, each by a union-find in one task, which leaves at
most a link for each node of a part.  What one part holds is done then; links of several parts go
on by alternating large and small stars until nothing changes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.llm.storage import stored

MAX_ROUNDS = 60
#: Links of a part.
PART = 250_000


def _forest(batches):
    """Links (a, b) from every node of a partition's links to its least connected node."""
    given = [np.stack([np.asarray(b.column("a")), np.asarray(b.column("b"))]) for b in batches if b.num_rows]
    if not given:
        return
    names, ends = np.unique(np.concatenate(given, axis=1), return_inverse=True)
    label, (x, y) = np.arange(len(names)), ends.reshape(2, -1)
    while True:  # least label over each link, then over the label's own label
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        np.minimum.at(new, label, new.copy())
        new = new[new]
        if (new == label).all():
            break
        label = new
    far = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[label[far]])], names=["a", "b"])


def _star(links: DataFrame) -> DataFrame:
    """Links (a > b) after every node's larger neighbours, then its smaller ones and itself, have
    been tied to its least neighbour."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    tied = large.join(least, "a")
    # each smaller neighbour to the least one, and the node itself
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its least node) of every node that a link (a, b) names."""
    given = stored(links.select("a", "b").filter("a <> b"), "links")
    parts = -(-given.count() // PART)
    shape = "a long, b long"
    if parts <= 1:
        now = stored(given.coalesce(1).mapInArrow(_forest, shape), "links")
        return _named(now)
    now = stored(given.repartition(parts).mapInArrow(_forest, shape), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stored(_star(now), "links")
        # stars whose centres are no other star's ray don't change any more
        new = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == new:
            break
        mark = new
    else:
        raise RuntimeError("components haven't settled")
    return _named(now)


def _named(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
