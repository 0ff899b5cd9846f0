"""Substring dedup: near-equal lines across documents by MinHash banding, and repeated passages.

A paragraph is a line with at least ``MIN_WORDS`` words.  Equal paragraphs (same words) are one
class.  Classes get MinHash signatures of their word shingles, cut into bands whose number is
tuned so that a pair at the threshold is missed with at most a given probability.  Classes that
collide in a band form candidate groups; inside these the exact Jaccard similarity decides (the
blocks of the prefix-tree join, so a large group is not compared in all pairs).  Linked classes
are clustered by connected components, and of each cluster only the first paragraph (least
doc_id, then place) stays.

In what these leave, passages are found wherever they begin and across line breaks: windows of
``WINDOW`` words, of which each text names those whose hash is the least of ``WINDOW`` neighbours,
so that any run of 2 * WINDOW - 1 equal words names a common one.  Around windows that are named
twice all windows are compared, and all but the first occurrence's words go.

Defined results: null and empty texts have no paragraphs; rows with a null doc_id take no part;
rows that repeat a doc_id share their decisions on lines; shorter lines are never removed as
lines; a paragraph repeated inside one document stays once, a passage too.  A class and a window
are named by a 64-bit hash of their words.  A passage never reaches over a removed line.  An empty
table gives no rows; other columns don't matter (``without_repeats`` keeps them).  A text is read
whole: its words and their hashes must fit a task's memory several times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from curalith.llm.graph import components
from curalith.llm.kernels import chunks, distinct_sets, flat_texts, lower, mix, powers, set_hashes, sliding, span_hashes, word_shingles, words
from curalith.llm.op7_ngram_jaccard_join import _union, _verified
from curalith.llm.storage import hot_join, shuffle_width, stored, text_batches

WIDTH, MIN_WORDS = 5, 5
#: Words of a window of a passage; bits of the filter of documents that may share one.
WINDOW, FILTER_BITS = 25, 1 << 23
#: The share of pairs at the threshold that banding may miss.
MISS = 0.001
_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def tuned_bands(threshold: float, miss: float = MISS, rows: int = 3) -> int:
    """How many bands of ``rows`` hashes find a pair at ``threshold`` but for ``miss``."""
    return int(np.ceil(np.log(miss) / np.log1p(-(threshold**rows))))


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' lines with enough words: document, line, number of words, key (a hash of the
    words in order), and the hashes of all their shingles with the paragraph of each."""
    low = lower(data)
    starts, ends, doc = words(low, offsets)
    breaks = np.flatnonzero(low == 0x0A)
    line = np.searchsorted(breaks, starts)  # breaks before a word; lines never reach into other documents
    h = span_hashes(low, starts, ends)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    unit = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    keep = count >= MIN_WORDS
    place = np.cumsum(keep) - 1
    mine = keep[unit]
    of = place[unit[mine]]
    grams, owner = word_shingles(h[mine], of, int(keep.sum()), WIDTH)
    first = first[keep]
    own_doc = doc[first]
    in_doc = line[first] - np.searchsorted(breaks, offsets[:-1][own_doc])
    at = np.arange(len(of)) - np.repeat(np.cumsum(count[keep]) - count[keep], count[keep])
    key = np.zeros(len(first), np.uint64)
    np.add.at(key, of, mix(h[mine] + mix(at.astype(np.uint64) + np.uint64(1))))
    return own_doc, in_doc, count[keep], mix(key), grams, owner


def _each(batches: Iterator[pa.RecordBatch]):
    for batch in text_batches(batches):
        data, offsets = flat_texts(batch.column("text"))
        for lo, hi in chunks(offsets, 2 << 20):
            at = offsets[lo : hi + 1]
            yield batch.slice(lo, hi - lo), data[at[0] : at[-1]], at - at[0]


def _signatures(grams: np.ndarray, owner: np.ndarray, n: int, hashes: int) -> np.ndarray:
    """MinHash values (n, hashes)."""
    first = np.searchsorted(owner, np.arange(n))
    return np.stack([np.minimum.reduceat(mix(grams * s), first) for s in _SEEDS[:hashes]], axis=1) if n else np.zeros((0, hashes), np.uint64)


def _banded(bands: int, rows: int, buckets: int):
    """(bucket, payload) rows: band hashes and the keys of a chunk's distinct paragraphs."""

    def run(batches):
        for _, data, offsets in _each(batches):
            *_, key, grams, owner = paragraphs(data, offsets)
            distinct, pick = np.unique(key, return_index=True)
            if not len(distinct):
                continue
            sig = _signatures(grams, owner, len(key), bands * rows)[pick]
            hashed = np.concatenate([mix(sum(mix(sig[:, b * rows + k] + np.uint64(k)) for k in range(rows)) + np.uint64(b)) for b in range(bands)])
            keys = np.tile(distinct, bands)
            bucket = (hashed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cuts))
            out = [hashed[order[cuts[b] : cuts[b + 1]]].tobytes() + keys[order[cuts[b] : cuts[b + 1]]].tobytes() for b in used]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return run


def _collisions(batches):
    """Classes that share a band, each tied to the least of them."""
    bands, keys = [], []
    for batch in batches:
        for raw in batch.column("payload").to_pylist():
            both = np.frombuffer(raw, np.uint64)
            bands.append(both[: len(both) // 2])
            keys.append(both[len(both) // 2 :].view(np.int64))
    if bands:
        band, key = np.concatenate(bands), np.concatenate(keys)
        order = np.lexsort((key, band))
        band, key = band[order], key[order]
        first = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
        least = np.repeat(key[first], np.diff(np.append(first, len(key))))
        tied = np.unique(np.stack([key, least], axis=1)[key != least], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(tied[:, 0]), pa.array(tied[:, 1])], names=["a", "b"])


def repeated_lines(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, paragraph (line, from 0), n_words, cluster, first_doc_id, removed of every paragraph
    that has an equal or near-equal one; two are near-equal when den * intersection >= num * union
    of their sets of five-word shingles."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    rows, width = 3, shuffle_width(spark)
    bands = tuned_bands(num / den, rows=rows)

    def listed(batches):
        for batch, data, offsets in _each(batches):
            doc, line, count, key, *_ = paragraphs(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(line, pa.int32()), pa.array(count, pa.int32()), pa.array(key.view(np.int64))], names=["doc_id", "paragraph", "n_words", "key"])

    units = stored(docs.mapInArrow(listed, "doc_id long, paragraph int, n_words int, key long"), "paragraphs")
    classes = units.groupBy("key").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("copies"))
    met = docs.select("text").mapInArrow(_banded(bands, rows, 4 * width), "bucket int, payload binary").repartition(width, "bucket").mapInArrow(_collisions, "a long, b long").distinct()
    groups = components(met).select(F.col("node").alias("key"), F.col("component").alias("comp"))
    wanted = groups.join(classes, "key").select("key", "comp", F.col("first.doc_id").alias("doc_id"))

    def as_sets(batches):
        for batch, data, offsets in _each(batches):
            doc, _, _, key, grams, owner = paragraphs(data, offsets)
            h, at = distinct_sets(grams, owner, len(key))
            wanted = [{x["key"]: x["comp"] for x in own} for own in batch.column("wanted").to_pylist()]
            found = {k: (c, k, i) for i, (d, k) in enumerate(zip(doc.tolist(), key.view(np.int64).tolist(), strict=True)) if (c := wanted[d].get(k)) is not None}.values()
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _, _ in found], pa.int64()), pa.array([k for _, k, _ in found], pa.int64()), pa.array([h[at[i] : at[i + 1]].tobytes() for _, _, i in found], pa.binary())], names=["comp", "node", "grams"])

    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("key", "comp")).alias("wanted"))
    sets = docs.join(per_doc.hint("merge"), "doc_id").mapInArrow(as_sets, "comp long, node long, grams binary").dropDuplicates(["node"])
    linked = components(_union(_verified(sets, num, den))).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    named = classes.join(linked, "key", "left").withColumn("cluster", F.coalesce("cluster", "key"))
    clusters = named.groupBy("cluster").agg(F.min("first").alias("kept"), F.sum("copies").alias("all"))
    repeated = stored(named.select("key", "cluster", "copies").join(clusters.filter(F.col("all") > 1), "cluster"), "repeated")
    found = hot_join(units, repeated, ["key"])
    removed = F.struct("doc_id", "paragraph") != F.struct(F.col("kept.doc_id").alias("doc_id"), F.col("kept.paragraph").alias("paragraph"))
    return found.select("doc_id", "paragraph", "n_words", "cluster", F.col("kept.doc_id").alias("first_doc_id"), removed.alias("removed"))


def windows(data: np.ndarray, offsets: np.ndarray, gone: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of WINDOW words in one document, with no word in the lines that ``gone`` lists
    for it: document, place of the first word, its line, hash, and whether such a run starts there."""
    low = lower(data)
    starts, ends, doc = words(low, offsets)
    breaks = np.flatnonzero(low == 0x0A)
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[doc]
    first = np.searchsorted(doc, np.arange(len(offsets)))
    place = np.arange(len(doc)) - first[doc]
    kept = np.ones(len(doc), bool)
    for d, lines in enumerate(gone):
        if lines:
            kept[first[d] : first[d + 1]] = ~np.isin(line[first[d] : first[d + 1]], lines)
    n = max(0, len(doc) - WINDOW + 1)
    up, down = powers(len(doc) + 1)
    prefix = np.zeros(len(doc) + 1, np.uint64)
    np.cumsum(span_hashes(low, starts, ends) * up[: len(doc)], out=prefix[1:])
    h = mix((prefix[WINDOW:] - prefix[:-WINDOW]) * down[:n]) if n else np.zeros(0, np.uint64)
    lost = np.append(0, np.cumsum(~kept))
    whole = (doc[:n] == doc[WINDOW - 1 :]) & (lost[WINDOW:] == lost[:-WINDOW]) if n else np.zeros(0, bool)
    return doc[:n], place[:n], line[:n], h, whole


def _named(batches):
    """The windows whose hash is the least of WINDOW neighbours in some place."""
    for batch, data, offsets in _each(batches):
        doc, place, line, h, whole = windows(data, offsets, [])
        if not whole.any():
            continue
        most = np.uint64(2**64 - 1)
        h = np.where(whole, h, most)
        edge = np.full(WINDOW - 1, most)
        least = sliding(np.concatenate([edge, h, edge]), WINDOW, np.minimum)
        at = np.flatnonzero(whole & (sliding(least, WINDOW, np.maximum) == h))
        own = pa.array(doc[at])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("tag").take(own), pa.array(place[at], pa.int32()), pa.array(line[at], pa.int32()), pa.array(h[at].view(np.int64))], names=["doc_id", "tag", "place", "paragraph", "key"])


def _around(batches):
    """All windows with fewer than WINDOW places between them and one of ``near``."""
    for batch, data, offsets in _each(batches):
        doc, place, line, h, whole = windows(data, offsets, batch.column("gone").to_pylist())
        first = np.searchsorted(doc, np.arange(len(offsets) - 1))
        turns = np.zeros(len(doc) + 1, np.int64)
        for d, near in enumerate(batch.column("near").to_pylist()):
            at = first[d] + np.array(near, np.int64)
            np.add.at(turns, np.clip(at - WINDOW + 1, 0, len(doc)), 1)
            np.add.at(turns, np.clip(at + WINDOW, 0, len(doc)), -1)
        at = np.flatnonzero(whole & (np.cumsum(turns)[:-1] > 0))
        own = pa.array(doc[at])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(own), batch.column("tag").take(own), pa.array(place[at], pa.int32()), pa.array(line[at], pa.int32()), pa.array(h[at].view(np.int64))], names=["doc_id", "tag", "place", "paragraph", "key"])


def repeated_passages(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, tag (a hash of the text), at and to (the first and the last word, from 0), paragraph
    (the line in which it starts), n_words, cluster, first_doc_id, removed of every passage that
    stands twice outside the lines (doc_id, paragraph)."""
    spark, shape = docs.sparkSession, "doc_id long, tag long, place int, paragraph int, key long"
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).filter("doc_id IS NOT NULL")
    lines = lines.select("doc_id", "paragraph").distinct()
    named = stored(docs.mapInArrow(_named, shape), "named")
    shared = lambda rows: hot_join(rows, stored(rows.groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1"), "shared"), ["key"])
    outside = stored(shared(named).join(lines.hint("merge"), ["doc_id", "paragraph"], "left_anti"), "named")
    near = shared(outside).groupBy("doc_id", "tag").agg(F.collect_list("place").alias("near"))
    gone = lines.groupBy("doc_id").agg(F.collect_list("paragraph").alias("gone"))
    near = stored(near.join(gone.hint("merge"), "doc_id", "left"), "near")
    # few documents have any, so that most texts needn't be shuffled: a filter of fixed size
    place = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(FILTER_BITS)).cast("int")
    marks = near.select((place / 8).cast("int").alias("byte"), place.bitwiseAND(7).alias("bit")).groupBy("byte").agg(F.expr("bit_or(shiftleft(1, bit))").alias("bits"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for batch in marks.toArrow().to_batches():
        bits[np.asarray(batch.column("byte"))] = np.asarray(batch.column("bits"))
    bits = spark.sparkContext.broadcast(bits)

    def marked(batches):
        for batch in batches:
            at = np.asarray(batch.column("place"))
            yield batch.filter(pa.array((bits.value[at >> 3] >> (at & 7) & 1).astype(bool)))

    some = docs.withColumn("place", place).mapInArrow(marked, "doc_id long, text string, tag long, place int").drop("place")
    met = some.join(near.hint("merge"), ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    found = stored(met.select("doc_id", "text", "tag", "near", "gone").mapInArrow(_around, shape), "windows")
    first = found.groupBy("key").agg(F.min(F.struct("doc_id", "tag", "place")).alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    found = hot_join(found, stored(first, "first"), ["key"])
    same = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.tag") == F.col("tag"))
    # what overlaps its own first occurrence goes only from that one's end on
    apart = F.col("first.place") + F.when(F.col("place") > F.col("first.place"), WINDOW).otherwise(0)
    found = found.select(
        "doc_id", "tag", "place", "paragraph", "key", F.col("first.doc_id").alias("first_doc_id"),
        (~(same & (F.col("place") == F.col("first.place")))).alias("removed"), F.when(same, F.greatest("place", apart)).otherwise(F.col("place")).alias("from"),
    )
    order = Window.partitionBy("doc_id", "tag").orderBy("place")
    before = F.lag(F.struct(F.col("place") + 1, "removed", "first_doc_id")).over(order)
    runs = found.withColumn("new", (~before.eqNullSafe(F.struct("place", "removed", "first_doc_id"))).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    least = lambda x: F.min_by(x, "place")
    spans = runs.groupBy("doc_id", "tag", "run").agg(
        F.min("from").alias("at"), (F.max("place") + (WINDOW - 1)).alias("to"), least("paragraph").alias("paragraph"),
        least("key").alias("cluster"), least("first_doc_id").alias("first_doc_id"), least("removed").alias("removed"),
    )
    return spans.select("doc_id", "tag", "at", "to", "paragraph", (F.col("to") - F.col("at") + 1).cast("int").alias("n_words"), "cluster", "first_doc_id", "removed")


def _both(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    lines = stored(repeated_lines(docs, num, den), "lines")
    return lines, stored(repeated_passages(docs, lines.filter("removed")), "passages")


def repeated_paragraphs(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``repeated_lines``, and of the passages that stand twice in what is left:
    their line is the one they start in, their cluster the hash of their first window."""
    lines, passages = _both(docs, num, den)
    return lines.unionByName(passages.select(*lines.columns))


def _cut(text: str, spans: list) -> str:
    """``text`` without the words from at to to of each span; its line breaks stay."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]))
    keep = np.ones(len(data), bool)
    for at, to in spans:
        after = starts[to + 1] if to + 1 < len(starts) else len(data)
        keep[starts[at] : after if 0x0A not in data[ends[to] : after] else ends[to]] = False
    return data[keep | (data == 0x0A)].tobytes().decode()


@F.pandas_udf(StringType())
def _without_spans(text: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _cut(t, [(x["at"], x["to"]) for x in s]) for t, s in zip(text, spans, strict=True)], dtype=object)


def without_repeats(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with its columns; what is removed is cut out of text, n_chars follows if it is there."""
    lines, passages = _both(docs, num, den)
    gone = lines.filter("removed").groupBy("doc_id").agg(F.collect_set("paragraph").alias("_gone"))
    spans = passages.filter("removed").groupBy("doc_id", "tag").agg(F.collect_list(F.struct("at", "to")).alias("spans"))
    spans = spans.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "spans"))).alias("_spans"))
    both = gone.join(spans, "doc_id", "full").withColumnRenamed("doc_id", "_gone_id")
    joined = docs.join(both.hint("merge"), docs["doc_id"] == F.col("_gone_id"), "left")
    joined = joined.withColumn("_cut", F.col("_spans")[F.xxhash64("text")])
    cut = _without_spans(F.when(F.col("_cut").isNotNull(), F.col("text")), F.col("_cut"))
    joined = joined.withColumn("_left", F.coalesce(cut, "text"))
    lines = F.filter(F.split("_left", "\n"), lambda _, k: ~F.array_contains("_gone", k))
    joined = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("_left")).otherwise(F.array_join(lines, "\n")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("_gone_id").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return joined.select(*docs.columns)


def op6_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
