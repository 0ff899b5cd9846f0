"""Places and medians over whole tables, found by ranges, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.sources.tables import stored

#: Error of the approximate quantiles: a rank is off by at most one in so many rows.
ACCURACY = 10_000


def numbered(rows: DataFrame, section: str, value: str, ties: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of ``section`` (a column of few values), the
    number ``value`` (nulls first) and ``ties``.  Approximate quantiles cut each section into
    ranges; the rows before each range are counted, and only the rows of a range are sorted in one
    task, so rows of one value stay together."""
    n = ranges or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n == 1:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(section, F.asc_nulls_first(value), *ties)).cast("long"))
    cuts = rows.groupBy(section).agg(F.percentile_approx(value, [k / n for k in range(1, n)], ACCURACY).alias("_cuts"))
    cut = rows.join(F.broadcast(cuts), section)  # a row for each section
    cut = cut.withColumn("_range", F.when(F.col(value).isNull(), -1).otherwise(F.size(F.filter("_cuts", lambda x: x < F.col(value))))).drop("_cuts")
    counts = cut.groupBy(section, "_range").agg(F.count("*").alias("_n"))
    before = counts.select(section, "_range", (F.sum("_n").over(Window.orderBy(section, "_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(section, "_range").orderBy(F.asc_nulls_first(value), *ties))
    return cut.withColumn("_inside", inside).join(before, [section, "_range"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def in_order(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows``, written down in the order of ``by`` and ``order``, with _part and _turn: parts of
    about one size, of which one ``by`` may fill many, and numbers that grow along the order."""
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.repartitionByRange(tasks, by, *order).sortWithinPartitions(by, *order)
    return stored(cut.withColumns({"_part": F.spark_partition_id(), "_turn": F.monotonically_increasing_id()}), "ordered")


def carried(ordered: DataFrame, by: str, **sums: Column) -> DataFrame:
    """by, _part and for each of ``sums`` (aggregates that add up or take a least: a "min_" before the
    name) what the parts before hand on: of few rows, one for each ``by`` in each part."""
    parts = ordered.groupBy(by, "_part").agg(*[c.alias(k) for k, c in sums.items()])
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(by, "_part", *[(F.min(k).over(before) if k.startswith("min_") else F.coalesce(F.sum(k).over(before), F.lit(0))).alias(k) for k in sums])


def ranked_by_hash(rows: DataFrame, by: str, h: str) -> DataFrame:
    """``rows`` with rank (from 1, in the order of the hexadecimal hash ``h``) and n (their number),
    both in each ``by``.  The hash's first three digits cut each ``by`` into even ranges."""
    cut = rows.withColumn("_range", F.substring(h, 1, 3))
    counts = cut.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    order = Window.partitionBy(by).orderBy("_range")
    before = counts.select(by, "_range", (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(by, "_range").orderBy(h))
    return cut.withColumn("_inside", inside).join(before, [by, "_range"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_before")


def quantiles(rows: DataFrame, by: list[str], value: str | Column, points: dict[str, float]) -> DataFrame:
    """``by``..., n and a column for each of ``points`` (name: share from 0 to 1): the exact quantiles,
    between values by linear interpolation, of each group's values that aren't null.

    One lazy plan for all groups: a sketch brackets each quantile, a second reading counts what lies
    below its bracket and how often each value inside comes, and only those (about one row in
    ACCURACY / 8) are put in order.  No group's values are held together."""
    keys, names = [f"_k{k}" for k in range(max(1, len(by)))], list(points)
    # null keys are groups too, and joins don't match nulls
    key = [F.struct(F.col(c)) for c in by] or [F.struct(F.lit(0))]
    values = rows.select(*[k.alias(n) for k, n in zip(key, keys, strict=True)], (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    margin = 4 / ACCURACY
    around = [x for p in points.values() for x in (max(0.0, p - margin), min(1.0, p + margin))]
    cuts = values.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", around, ACCURACY).alias("_cuts"))
    near = values.join(cuts, keys)
    # in a group of few values the bracket might end beside the value's neighbour, so it holds them all
    few, limit = F.col("n") <= ACCURACY, F.lit(float("inf"))
    low, high = (lambda k: F.when(few, -limit).otherwise(F.col("_cuts")[2 * k])), (lambda k: F.when(few, limit).otherwise(F.col("_cuts")[2 * k + 1]))
    inside = F.filter(F.array(*[F.when(F.col("_v").between(low(k), high(k)), k) for k in range(len(names))]), lambda k: k.isNotNull())
    # values beside all brackets come to one row with how many lie below each
    marked = near.withColumn("_in", inside).withColumn("_at", F.when(F.size("_in") > 0, F.col("_v")))
    counted = marked.groupBy(*keys, "_at").agg(F.first("n").alias("n"), F.first("_in").alias("_in"), F.count("*").alias("_m"), *[F.count_if(F.col("_v") < low(k)).alias(f"_b{k}") for k in range(len(names))])
    each = Window.partitionBy(*keys)
    counted = counted.withColumns({f"_b{k}": F.sum(f"_b{k}").over(each) for k in range(len(names))}).filter("_at IS NOT NULL")
    exploded = counted.withColumn("_q", F.explode("_in"))
    below = F.element_at(F.array(*[F.col(f"_b{k}") for k in range(len(names))]), F.col("_q") + 1)
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_q").orderBy("_at")) + below
    place = (F.col("n") - 1) * F.element_at(F.array(*[F.lit(float(p)) for p in points.values()]), F.col("_q") + 1)
    reached = exploded.withColumns({"_upto": upto, "_place": place})
    first, last = (F.min(F.when(F.col("_upto") > f("_place"), F.col("_at"))) for f in (F.floor, F.ceil))
    found = reached.groupBy(*keys, "n", "_q", "_place").agg(first.alias("_x"), last.alias("_y"))
    found = found.withColumn("_value", F.col("_x") + (F.col("_y") - F.col("_x")) * (F.col("_place") - F.floor("_place")))
    named = found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("_q") == k, F.col("_value"))).alias(name) for k, name in enumerate(names)])
    return named.select(*[F.col(f"{n}.{c}").alias(c) for n, c in zip(keys, by, strict=False)], "n", *names)


def exact_median(rows: DataFrame, value: str | Column) -> float | None:
    """The median of the values that aren't null, null without any."""
    found = quantiles(rows, [], value, {"m": 0.5}).first()
    return found.m if found else None
