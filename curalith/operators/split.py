"""Reproducible splits and samples by seeded hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.functions.text import let
from curalith.operators.ranking import carried, in_order, ranked_by_hash


def seeded(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def holdout(n: Column, ratio: float) -> Column:
    """How many of n groups are held out: none of fewer than three, else at least one, halves to even."""
    return F.when((n < 3) | F.lit(ratio <= 0), F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(ratio), 0))).cast("long")


def assign_splits(records: DataFrame, seed: int = 42, val_ratio: float = 0.05, test_ratio: float = 0.05) -> DataFrame:
    """``records`` (id, text, category) with split: texts that are equal but for case stay together,
    under the category of their first id, and are ranked in it by a seeded hash, found by ranges
    of the hash.  A null category is "unknown"; a null text has no split.  Texts aren't shuffled."""
    keyed = records.select("id", "category", seeded(seed, F.lower("text")).alias("key")).filter("key IS NOT NULL")
    groups = keyed.groupBy("key").agg(F.min_by(F.coalesce("category", F.lit("unknown")), "id").alias("stratum"))
    ranked = ranked_by_hash(groups, "stratum", "key")
    n_test = holdout(F.col("n"), test_ratio)
    n_val = holdout(F.col("n") - n_test, val_ratio)
    ranked = ranked.select("key", "stratum", F.when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train").alias("split"))
    return keyed.join(ranked, "key").select("id", F.col("stratum").alias("category"), "split")


def sample_by_hash(rows: DataFrame, by: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` rows of each ``by`` in the order of a seeded hash of ``key``."""
    order = Window.partitionBy(by).orderBy(seeded(seed, F.col(key)))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


#: Rounds of a permutation, and the prime that its bits are mixed by.
ROUNDS, PRIME = 24, (1 << 31) - 1


def round_keys(seed: int, epoch: int) -> list[tuple[int, int, int, int]]:
    """For each round the number whose difference a place is swapped with, and three by which it is
    decided whether it is."""
    words = [hashlib.sha256(f"{seed}:{epoch}:{k}".encode()).digest() for k in range(ROUNDS)]
    return [(int.from_bytes(w[:8], "big") >> 4, *(int.from_bytes(w[i : i + 4], "big") % (PRIME - 1) + 1 for i in (8, 12, 16))) for w in words]


def permuted(rows: DataFrame, place: str, n: str, seed: int, epoch: int) -> DataFrame:
    """``rows`` whose ``place`` (0 to n - 1) is moved by a keyed permutation of 0 to n - 1: in each
    round a place and its mirror (key - place modulo n) are swapped or not, as a bit says that both
    have in common.  Arithmetic on each row alone, at any n; nothing is sorted or shuffled."""
    size = F.col(n).cast("long")

    def moved(x: Column, key: Column) -> Column:
        mirror = F.pmod(key["q"] % size - x, size)
        mixed = let(mirror, lambda y: (F.greatest(x, y) % PRIME * key["a"] + key["b"]) % PRIME)
        swapped = let(mixed, lambda v: F.shiftright((v * v + key["c"]) % PRIME, 11).bitwiseAND(F.lit(1).cast("long"))) == 1
        return F.when(swapped, mirror).otherwise(x)

    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(name) for v, name in zip(k, "qabc", strict=True)]) for k in round_keys(seed, epoch)])
    return rows.withColumn(place, F.aggregate(keys, F.col(place).cast("long"), moved))


def row_numbers(rows: DataFrame, key: str) -> DataFrame:
    """key, at (from 0, in the order of ``key``) and n of all rows: once for all epochs.  Parts of the
    order are counted, and only a part is numbered in one task."""
    ordered = in_order(rows.select(F.lit(0).alias("_all"), key), "_all", [key])
    handed = carried(ordered, "_all", before=F.count("*"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_turn")) - 1
    sizes = handed.join(ordered.groupBy("_part").agg(F.count("*").alias("_n")), "_part")
    total = sizes.agg(F.max(F.col("before") + F.col("_n")).alias("n")).withColumn("_all", F.lit(0))
    return ordered.withColumn("_inside", inside).join(handed, ["_all", "_part"]).join(total, "_all").select(key, (F.col("_inside") + F.col("before")).cast("long").alias("at"), "n")


def epoch_batches(rows: DataFrame, key: str, batch: int, seed: int, epoch: int) -> DataFrame:
    """key, batch, place: a seeded order of an epoch cut into whole batches; the short last one is
    dropped.  ``rows`` may be numbered already (``row_numbers``); else they are."""
    numbered = rows.select(key, "at", "n") if {"at", "n"} <= set(rows.columns) else row_numbers(rows, key)
    placed = permuted(numbered, "at", "n", seed, epoch)
    return placed.filter(F.col("at") < F.floor(F.col("n") / batch) * batch).select(key, F.floor(F.col("at") / batch).alias("batch"), (F.col("at") % batch).alias("place"))
