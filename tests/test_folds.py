"""Folds over runs of any length against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curalith.operators import split, training


def _plain(rows, patience, delta):
    best, at, streak = math.inf, None, 0
    for step, loss in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        if loss is not None and loss < best - delta:
            best, at, streak = loss, step, 0
        else:
            streak += 1
        if streak >= patience:
            return at, best if at is not None else None, step
    return at, best if at is not None else None, None


@pytest.mark.parametrize(("patience", "delta"), [(1, 0.0), (3, 0.0), (4, 0.5), (60, 0.1)])
def test_early_stop_is_the_plain_fold(spark, patience, delta):
    r = random.Random(patience)
    runs = {f"r{k}": [(s, r.choice([None, r.gauss(0, 1), 5 - s / 20, float(r.randrange(3))])) for s in range(0, 2 * r.randint(1, 60), 2)] for k in range(40)}
    runs |= {"down": [(s, -float(s)) for s in range(300)], "up": [(s, float(s)) for s in range(300)], "flat": [(s, 1.0) for s in range(50)], "none": [(s, None) for s in range(5)], None: [(1, 2.0), (2, 1.0)]}
    df = spark.createDataFrame([(k, s, x) for k, v in runs.items() for s, x in v], "run string, step long, loss double").repartition(3)
    got = {x.run: (x.best_step, x.best_loss, x.stop_step) for x in training.early_stop(df.filter("run IS NOT NULL"), "run", patience, delta).collect()}
    assert got == {k: _plain(v, patience, delta) for k, v in runs.items() if k is not None}


def test_one_long_run(spark):
    """Two million evaluations of one run: nothing is collected to an array, and no task has them all."""
    n = 2_000_000
    df = spark.range(n, numPartitions=4).select(F.lit("a").alias("run"), F.col("id").alias("step"), (F.when(F.col("id") < 1_500_000, F.lit(1.0) / (F.floor(F.col("id") / 1000) + 1)).otherwise(9.0)).alias("loss"))
    found = training.early_stop(df, "run", patience=5000)
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.first()) == ("a", 1_499_000, pytest.approx(1 / 1500), 1_504_000)
    from curalith.operators.ranking import in_order

    sizes = [r["count"] for r in in_order(df, "run", ["step"]).groupBy("_part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.4 * n


@pytest.mark.parametrize(("n", "batch"), [(0, 4), (1, 1), (7, 4), (1000, 16), (4097, 1)])
def test_epoch_is_a_permutation(spark, n, batch):
    df = spark.range(n).select((F.col("id") * 7 + 3).alias("key"))
    orders = []
    for epoch in (1, 2):
        rows = split.epoch_batches(df, "key", batch, 42, epoch).collect()
        assert sorted((r.batch, r.place) for r in rows) == [(k // batch, k % batch) for k in range(n // batch * batch)]
        assert len({r.key for r in rows}) == len(rows)
        orders.append([r.key for r in sorted(rows, key=lambda r: (r.batch, r.place))])
    assert orders[0] == [r.key for r in sorted(split.epoch_batches(df.repartition(3), "key", batch, 42, 1).collect(), key=lambda r: (r.batch, r.place))]
    if n > 100:
        moved = sum(a == b for a, b in zip(*orders, strict=True))
        assert orders[0] != orders[1] and moved < 20 and sum(x == 7 * k + 3 for k, x in enumerate(orders[0])) < 20
        up = sum(a < b for a, b in zip(orders[0], orders[0][1:], strict=False)) / n
        assert 0.45 < up < 0.55  # neighbours aren't in order more often than by chance
