"""Homomorphic multiset hash of documents, by DataFrame functions only.

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to a wide vector, and a
text's fingerprint is the sum of its paragraphs' vectors modulo 2**32 in every lane.  So the order
of paragraphs doesn't matter, and paragraphs are added or taken away by adding or subtracting
their vectors (``merged``, ``without``) without reading the rest of the text.

The vector has EXACT lanes, 32-bit halves of seeded hashes of the whole paragraph, and LIKE lanes,
each the number of the paragraph's word pairs whose hash has a certain bit set, besides the number
of its word pairs.  The exact lanes decide equality.  Likeness comes from the others: with signs
(+1 for a set bit, -1 else) the mean product of two texts' lanes estimates the inner product of
their multisets of word pairs, and 2 A.B / (A.A + B.B) is 1 for equal multisets and about 0 for
disjoint ones.

Defined results: a null text is empty (one empty paragraph); equal texts have equal fingerprints;
rows that repeat a doc_id are ordered by a hash of their text, then the text; null doc_ids come
last in descending order; with one row, the next document is itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalith.llm.storage import shuffle_width

#: Seeded hashes of a paragraph, two lanes each; numbers that hold four counted bits of a word
#: pair's two hashes each.
EXACT, PACKED = 4, 32
LANE = (1 << 32) - 1
#: Bytes of text for each task; blocks for each task, so that their hashes fill the tasks evenly.
TASK_BYTES, BLOCKS = 1 << 26, 8
_EVERY_16 = 0x0001000100010001


def _exact(text: Column) -> Column:
    """The exact lanes: an array of 2 * EXACT numbers below 2**32.  A hash goes on from that of the
    column before, so the seed comes first: each is a hash of its own of the paragraph."""

    def add(acc, paragraph):
        lanes = []
        for seed in range(EXACT):
            h = F.xxhash64(F.lit(seed), paragraph)
            lanes += [h.bitwiseAND(F.lit(LANE)), F.shiftrightunsigned(h, 32)]
        return F.array(*[(acc[k] + x).bitwiseAND(F.lit(LANE)) for k, x in enumerate(lanes)])

    return F.aggregate(F.split(text, "\n"), F.array(*[F.lit(0).cast("long")] * (2 * EXACT)), add)


def _pairs(text: Column) -> Column:
    """Hashes of the pairs of neighbouring words of each paragraph; its last word stands alone."""
    words = F.transform(F.split(text, "\n"), lambda p: F.split(p, " "))
    return F.flatten(F.transform(words, lambda w: F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.xxhash64(a, b))))


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Fingerprints of ``texts``, whose columns are ``keys`` (together unique) and text:
    the keys, exact (array of lanes), pairs (their number) and lanes (array).  The aggregation
    needs no shuffle where the rows are already dealt out by some of the keys."""
    # in two steps: what stands beside explode() in one is worked out for each row that it makes
    hashed = texts.select(*keys, _exact(F.col("text")).alias("exact"), _pairs(F.col("text")).alias("pairs"))
    exploded = hashed.select(*keys, "exact", F.posexplode("pairs").alias("at", "h"))
    # four counters of 16 bits in one number stay below 2**62 in a chunk of 2**14 pairs
    rows = exploded.withColumn("chunk", F.shiftright("at", 14)).withColumn("g", F.xxhash64("h"))
    counters = lambda k: F.shiftrightunsigned("h" if k < 16 else "g", k % 16).bitwiseAND(F.lit(_EVERY_16))
    summed = rows.groupBy(*keys, "exact", "chunk").agg(F.count("*").alias("n"), *[F.sum(counters(k)).alias(f"s{k}") for k in range(PACKED)])
    chunks = summed.select(*keys, "exact", "n", F.array(*[f"s{k}" for k in range(PACKED)]).alias("packed"))
    whole = chunks.groupBy(*keys, "exact").agg(F.sum("n").alias("pairs"), F.collect_list("packed").alias("chunks"))
    lanes = f"transform(sequence(0, {4 * PACKED - 1}), i -> aggregate(chunks, 0L, (a, p) -> a + (shiftrightunsigned(p[i div 4], cast(16 * (i % 4) AS INT)) & 65535L)))"
    return whole.select(*keys, "exact", "pairs", F.expr(lanes).alias("lanes"))


def merged(a: Column, b: Column) -> Column:
    """The lanes of both multisets together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(F.lit(LANE)))


def without(a: Column, b: Column) -> Column:
    """The lanes of the first multiset without the second."""
    return F.zip_with(a, b, lambda x, y: (x - y).bitwiseAND(F.lit(LANE)))


def as_text(exact: Column, pairs: Column, lanes: Column) -> Column:
    """A fingerprint as one string of hexadecimal lanes."""
    hexed = lambda a: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")
    return F.concat(hexed(exact), F.lit("-"), F.lower(F.hex(pairs)), F.lit("-"), F.array_join(F.transform(lanes, lambda x: F.lower(F.hex(x))), "."))


def likeness(exact_a: Column, pairs_a: Column, lanes_a: Column, exact_b: Column, pairs_b: Column, lanes_b: Column) -> Column:
    """From 0 to 1; 1 for equal fingerprints."""
    zero = F.lit(0.0)
    signed = lambda lanes, pairs: F.transform(lanes, lambda x: (2 * x - pairs).cast("double"))
    a, b = signed(lanes_a, pairs_a), signed(lanes_b, pairs_b)
    total = lambda array: F.aggregate(array, zero, lambda s, x: s + x)
    product = total(F.zip_with(a, b, lambda x, y: x * y))
    norms = total(F.transform(a, lambda x: x * x)) + total(F.transform(b, lambda x: x * x))
    return F.when(exact_a == exact_b, 1.0).otherwise(F.greatest(zero, F.least(F.lit(1.0), F.coalesce(F.try_divide(2 * product, norms), zero))))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """``docs`` (doc_id, h) with block: ranges of doc_id, higher ones for higher ids.  Rows without a
    doc_id, which are ordered by h, have the blocks -1 to -16 by its highest bits."""
    quantiles = [k / blocks for k in range(1, blocks)]
    bounds = docs.agg(F.percentile_approx("doc_id", quantiles, max(10_000, 4 * blocks))).first()[0] if quantiles else None
    inner = sorted(set(bounds or []))
    step = max(1, int(len(inner) ** 0.5))
    array = lambda xs: F.expr("CAST(array(" + ", ".join(map(str, xs)) + ") AS array<bigint>)")
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    # first among every step-th bound, then among those up to the next of these
    docs = docs.withColumn("coarse", upto(array(inner[::step])))
    passed = F.greatest(F.col("coarse") - 1, F.lit(0)) * step
    fine = passed + upto(F.slice(array(inner), passed + 1, step))
    unnamed = -1 - (F.shiftright("h", 60) + 8).cast("int")
    return docs.withColumn("block", F.when(F.col("doc_id").isNull(), unnamed).when(F.col("coarse") == 0, 0).otherwise(fine)).drop("coarse")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in descending doc_id with the next one's text: block, place (from 1 in its block),
    last (whether it is its block's last), doc_id, text, next_text."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    tasks = max(shuffle_width(docs.sparkSession), -(-size // TASK_BYTES))
    docs = in_blocks(docs.withColumn("h", F.xxhash64("text")), BLOCKS * tasks).repartition(tasks, "block")
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "h", "text")
    rows = docs.select("block", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("next_text"))
    heads = rows.filter("place = 1").select("block", F.col("text").alias("head_text"))
    # one row for each block
    everywhere = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turn = Window.orderBy(F.desc("block"))
    following = heads.select(F.col("block").alias("of"), F.coalesce(F.lead("head_text").over(turn), F.first("head_text").over(everywhere)).alias("head_text"))
    joined = rows.join(following.hint("shuffle_merge"), rows["block"] == following["of"])
    return joined.select("block", "place", F.col("next_text").isNull().alias("last"), "doc_id", "text", F.coalesce("next_text", "head_text").alias("next_text"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs`` (doc_id, text), of their edited texts, and their likenesses."""
    n = F.char_length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next_text"), F.lit(1), k))
    rows = with_next(docs).withColumn("edited", edited)
    keys = ["block", "place", "doc_id", "n_chars", "edited_sha256", "which"]
    # a block's last row also brings the next document, which stands in another block
    version = lambda which, text: F.struct(F.lit(which).alias("which"), F.col(text).alias("text"))
    versions = F.when(F.col("last"), F.array(version(0, "text"), version(1, "edited"), version(2, "next_text"))).otherwise(F.array(version(0, "text"), version(1, "edited")))
    rows = rows.select("block", "place", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), versions.alias("versions"))
    rows = rows.select(*keys[:-1], F.explode("versions").alias("v"))
    # everything below stays where the rows were dealt out by block
    prints = fingerprints(rows.select(*keys[:-1], "v.which", "v.text"), keys)
    order = Window.partitionBy("block").orderBy("place", "which")
    own = F.struct("exact", "pairs", "lanes")
    lined = prints.select("doc_id", "n_chars", "edited_sha256", "which", own.alias("own"), F.lead(own, 1).over(order).alias("edited"), F.lead(own, 2).over(order).alias("following")).filter("which = 0")
    parts = lambda name: [F.col(f"{name}.{x}") for x in ("exact", "pairs", "lanes")]
    return lined.select(
        "doc_id", "n_chars", "edited_sha256",
        as_text(*parts("own")).alias("fingerprint"), as_text(*parts("edited")).alias("edited_fingerprint"),
        likeness(*parts("own"), *parts("edited")).alias("near_edited"), likeness(*parts("own"), *parts("following")).alias("near_next"),
    )


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
