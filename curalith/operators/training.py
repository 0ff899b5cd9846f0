"""Training logs, schedules and batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.operators.ranking import carried, in_order


def learning_rate(step: Column, warmup: int, total: int, base: float) -> Column:
    """Linear warm-up, then a cosine down to a twentieth."""
    progress = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, base * step / F.lit(float(max(1, warmup)))).otherwise(0.05 * base + 0.475 * base * (1 + F.cos(F.lit(math.pi) * progress)))


def loss_windows(log: DataFrame, every: int) -> DataFrame:
    """window, mean loss and steps of each ``every`` steps (step from 1)."""
    return log.groupBy(F.ceil(F.col("step") / every).alias("window")).agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("steps"))


def weighted_loss(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("loss"))


_FOLDED = "run binary, best_at long, best_loss double, stop_at long"


def _stops(patience: int, min_delta: float):
    """Folds evaluations that are sorted by run and place, a row at a time: the best so far, and the
    place at which ``patience`` others in a row are full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, at, stop, size, out = None, math.inf, 0, None, 0, []

        def closed() -> tuple:
            end = stop if stop is not None else at + patience if size - at >= patience else None
            return now, at or None, best if at else None, end

        for batch in batches:
            for key, k, loss, n in zip(*(batch.column(c).to_pylist() for c in ("run", "k", "loss", "n")), strict=True):
                if key != now:
                    if now is not None:
                        out.append(closed())
                    now, best, at, stop, size = key, math.inf, 0, None, n
                if stop is None and k - at > patience:
                    stop = at + patience
                if stop is None and loss is not None and loss < best - min_delta:
                    best, at = loss, k
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if now is not None:
            out.append(closed())
        yield _rows(out)

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.float64(), pa.int64())
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _FOLDED.split(", ")])


def early_stop(log: DataFrame, run: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """run, best_step, best_loss, stop_step (null if it never stops): an evaluation is better if its
    loss lies more than ``min_delta`` under the best so far; ``patience`` others in a row stop.

    A better one is always less than all before it, so a run's parts, each in a task of its own, hand
    on their number of evaluations and their least loss, and only the evaluations that are less than
    all before them (and the last, which tells the run's length) go on to the fold, which reads them
    a row at a time.  No run is held as a whole, however long it is."""
    rows = log.select(F.col(run).alias("run"), F.col("step").cast("long").alias("step"), F.nanvl(F.col("loss").cast("double"), F.lit(None)).alias("loss"))
    ordered = in_order(rows, "run", ["step", "loss"])
    handed = carried(ordered, "run", n=F.count("*"), min_loss=F.min("loss")).withColumnsRenamed({"n": "_before", "min_loss": "_least"})
    inside = Window.partitionBy("run", "_part").orderBy("_turn")
    least = F.least("_least", F.min("loss").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = ordered.groupBy("run").agg(F.count("*").alias("n"))
    placed = ordered.join(handed, ["run", "_part"]).withColumns({"k": F.row_number().over(inside) + F.col("_before"), "_least": least})
    # the first of a run is taken along too, so that every run has a row
    records = placed.filter((F.col("k") == 1) | (F.col("loss") < F.coalesce("_least", F.lit(float("inf"))))).join(sizes, "run")
    key = F.encode(F.to_json(F.struct("run")), "utf-8")
    sorted_ = records.select(key.alias("run"), "k", "loss", "n").repartition("run").sortWithinPartitions("run", "k")
    folded = sorted_.mapInArrow(_stops(patience, min_delta), _FOLDED)
    # the places of a best and a stop are looked up among the rows that can be one
    wanted = folded.select("run", "best_loss", "best_at", "stop_at", F.explode(F.array_distinct(F.array(F.coalesce("best_at", F.lit(1)), F.coalesce("stop_at", F.lit(1))))).alias("k"))
    found = placed.select(F.col("run").alias("_run"), key.alias("run"), "k", "step").join(wanted, ["run", "k"])
    at = lambda place: F.max(F.when(F.col("k") == F.col(place), F.col("step")))
    return found.groupBy("_run").agg(at("best_at").alias("best_step"), F.first("best_loss").alias("best_loss"), at("stop_at").alias("stop_step")).withColumnRenamed("_run", run)


def keep_last(checkpoints: DataFrame, run: str, n: int) -> DataFrame:
    """The ``n`` checkpoints of each run with the highest step."""
    return checkpoints.withColumn("_k", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("step")))).filter(F.col("_k") <= n).drop("_k")


def admitted(latents: DataFrame, vocabulary: dict[str, int], max_frames: int, unknown: int = 1) -> DataFrame:
    """``latents`` (text, n_frames) with ids: 8 to ``max_frames`` frames, and 1 to 250 ids of the
    first 300 characters."""
    table = F.create_map(*[F.lit(x) for kv in vocabulary.items() for x in kv])
    ids = F.transform(F.filter(F.split(F.substring(F.coalesce("text", F.lit("")), 1, 300), ""), lambda c: c != ""), lambda c: F.coalesce(table[c], F.lit(unknown)))
    return latents.filter(F.col("n_frames").between(8, max_frames)).withColumn("ids", ids).filter(F.size("ids").between(1, 250))


def padded(items: DataFrame, batch: str) -> DataFrame:
    """``items`` (batch, ids) with ids padded to their batch's longest, the mask, and log_frames."""
    longest = items.groupBy(batch).agg(F.max(F.size("ids")).alias("longest"))
    rows = items.join(longest, batch)
    pad = F.col("longest") - F.size("ids")
    return rows.withColumns({"padded": F.concat("ids", F.array_repeat(F.lit(0), pad)), "mask": F.concat(F.transform("ids", lambda _: F.lit(True)), F.array_repeat(F.lit(False), pad)), "log_frames": F.log(F.col("n_frames").cast("double"))})


def plan(config: DataFrame) -> DataFrame:
    """Steps an epoch and epochs of runs with n, batch, accumulate and steps."""
    per = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") / F.col("batch")) / F.col("accumulate")))
    return config.withColumns({"steps_per_epoch": per, "epochs": F.ceil(F.col("steps") / per)})
