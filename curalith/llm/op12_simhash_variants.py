"""SimHash near-duplicates by deletion-variant signatures.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the 64-bit hashes of the
text's shingles, repeats included.  Fingerprints that differ in at most RADIUS = 4 bits are linked.

1. Equal fingerprints are one class.  Each is cut into SEGMENTS = 3 segments.  Four differing bits
   leave a segment with at most one of them (with as many segments as differing bits and one more,
   one would be equal, but the segments were shorter and their buckets fuller).
2. Each fingerprint goes to the bucket of each segment as it is, and to one for each of the
   segment's bits with that bit left out: 67 signatures.  Two fingerprints meet at an equal segment
   once, and at one of one differing bit once, for where a bit is left out only those that differ in
   it are compared.  A signature follows from the fingerprint, so 8 bytes are shuffled for each.
3. Buckets of at most PAIRED are compared pair by pair, larger ones by a search from neighbour to
   neighbour, which never looks at two that are connected already, so the many fingerprints of a
   group of near copies take a few steps.  All 64 bits are verified.
4. What a search hasn't compared after BUDGET comparisons (buckets of many that aren't alike) is
   refined: dealt out once more by variants of those bits that the bucket doesn't fix, cut into
   three again.  After two such steps a bucket fixes all but about 23 bits, so its distinct
   fingerprints fit a task.  Segments that more than HOT fingerprints have are counted first and
   refined at once, so their bucket is never sent to one task.
5. Links are contracted to components (``graph.components``), and each gets its least doc_id.

Defined results: null and empty texts and texts without words have the fingerprint zero and are
linked like any other; a text with fewer words than a shingle is one shingle.  Rows with a null
doc_id take no part and have a null component_id; rows that repeat a doc_id are one node with the
links of all of them.  An empty table gives no rows.  Other columns don't matter.  A text is handled
whole, whatever its length: it must fit a task's memory several times.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.graph import components
from curalith.llm.kernels import chunks, flat_texts, lower, mix, words
from curalith.llm.storage import HOT_SHARE, hot_join, shuffle_width, stored, text_batches

RADIUS, SEGMENTS = 4, 3
#: Fingerprints of buckets that are compared in pairs, comparisons of a search in a larger one, and
#: fingerprints of a segment that is refined at once.
PAIRED, BUDGET, HOT = 48, 1_000_000_000, 4_000_000
#: Levels of variants: a bucket of the last one isn't refined.
LEVELS = 3
#: Bytes of signatures in a task, fingerprints that are dealt out at once, pairs that are looked at once.
TASK_BYTES, DEALT, PAIRS = 32 << 20, 50_000, 2_000_000

U64 = np.uint64
ALL = (1 << 64) - 1


# -- fingerprints ----------------------------------------------------------------------------------


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the ``width``-word shingles, repeats included, of lower-cased words joined by one
    space, and their documents; fewer words are one shingle."""
    low, n = lower(data), len(offsets) - 1
    starts, ends, doc = words(low, offsets)
    sizes = ends - starts
    first = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.full(int((sizes + 1).sum()), 0x20, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[first + sizes] = False
    inside = np.zeros(len(low) + 1, np.int8)  # runs that touch at a document's end are two words
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    joined[letters] = low[np.cumsum(inside[:-1]) > 0]
    count = np.bincount(doc, minlength=n)
    many = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    owner = np.repeat(np.arange(n), many)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(np.cumsum(count) - count, many)
    last = at + np.minimum(width, count[owner]) - 1
    raw, hashed = memoryview(joined.tobytes()), np.empty(len(owner), U64)
    for lo in range(0, len(owner), 500_000):
        i, j = first[at[lo : lo + 500_000]].tolist(), (first + sizes)[last[lo : lo + 500_000]].tolist()
        hashed[lo : lo + len(i)] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(i, j, strict=True)]
    return hashed, owner


def simhashes(hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The fingerprint of each of ``n`` documents from its shingles' hashes (``owner`` ascends)."""
    many = np.bincount(owner, minlength=n)
    ones = np.zeros((n, 64), np.int64)
    if len(hashed):
        # eight counters of a byte in a number, so at most 255 hashes at once
        inside = np.arange(len(owner)) - (np.cumsum(many) - many)[owner]
        parts = np.flatnonzero(inside % 255 == 0)
        new = np.flatnonzero(np.diff(owner[parts], prepend=-1))
        for k in range(8):
            lanes = np.add.reduceat((hashed >> U64(k)) & U64(0x0101010101010101), parts).astype("<u8")
            ones[owner[parts[new]], k::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), new, axis=0)
    return np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprints(width: int, seed: int):
    def run(batches):
        for batch in text_batches(batches):
            data, offsets = flat_texts(batch.column("text"))
            for lo, hi in chunks(offsets, 4 << 20):
                own = offsets[lo : hi + 1]
                found = simhashes(*shingle_hashes(data[own[0] : own[-1]], own - own[0], width, seed), hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


# -- signatures ------------------------------------------------------------------------------------
# A kind of signature is (keep, wild, rest): the bits that are equal in its buckets, those that were
# left out and must differ, and those that it doesn't look at.


def _bits(mask: int) -> list[int]:
    return [k for k in range(64) if mask >> k & 1]


def segments(rest: int) -> list[int]:
    """The bits of ``rest``, in order, as SEGMENTS masks of about one size."""
    return [sum(1 << int(k) for k in part) for part in np.array_split(_bits(rest), SEGMENTS)]


def variants(keep: int, wild: int, rest: int) -> list[tuple[int, int, int]]:
    """The kinds one step finer: each segment of the rest as it is, and without each of its bits."""
    out = []
    for part in segments(rest):
        out.append((keep | part, wild, rest & ~part))
        out += [(keep | part & ~(1 << k), wild | 1 << k, rest & ~part) for k in _bits(part)]
    return out


def _deal(given, buckets: int, warm: dict[int, np.ndarray]):
    """(bucket, payload) rows of the finer signatures of (keep, wild, rest, fingerprints).  A payload
    holds the kinds, their numbers of fingerprints, and these."""
    for kind, fps in given:
        todo = [(k, fps) for k in variants(*kind)]
        whole = dict.fromkeys(segments(kind[2])) if kind[0] == 0 and warm else {}
        sections = []
        while todo:
            (keep, wild, rest), own = todo.pop()
            part = next((p for p in whole if p == keep | wild), None)
            if part is not None and len(warm[part]):
                value = own & U64(part)
                hot = np.isin(value, warm[part]) | np.isin(value ^ U64(wild), warm[part])
                if hot.any():
                    todo += [(k, own[hot]) for k in variants(keep, wild, rest)]
                    own = own[~hot]
            if len(own):
                sections.append(((keep, wild, rest), own))
        number = np.concatenate([np.full(len(own), k) for k, (_, own) in enumerate(sections)])
        every = np.concatenate([own for _, own in sections])
        masks = np.array([k for k, _ in sections], U64)
        bucket = (mix((every & masks[number, 0]) ^ mix(masks[number, 0] + masks[number, 1] * U64(3))) % U64(buckets)).astype(np.int64)
        order = np.lexsort((number, bucket))
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        payloads = []
        for b in used.tolist():
            pick = order[cuts[b] : cuts[b + 1]]
            kinds, many = np.unique(number[pick], return_counts=True)
            payloads.append(np.array([len(kinds)], U64).tobytes() + masks[kinds].tobytes() + many.astype(U64).tobytes() + every[pick].tobytes())
        for lo in range(0, len(used), 1000):
            yield pa.RecordBatch.from_arrays([pa.array(used[lo : lo + 1000], pa.int32()), pa.array(payloads[lo : lo + 1000], pa.binary())], names=["bucket", "payload"])


def _first(buckets: int, warm: dict[int, np.ndarray]):
    def given(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64))
            n += len(held[-1])
            if n >= DEALT:
                yield (0, 0, ALL), np.concatenate(held)
                held, n = [], 0
        if n:
            yield (0, 0, ALL), np.concatenate(held)

    return lambda batches: _deal(given(batches), buckets, warm)


def _again(buckets: int):
    def given(batches):
        for batch in batches:
            for keep, wild, rest, raw in zip(*(batch.column(c).to_pylist() for c in ("keep", "wild", "rest", "fps")), strict=True):
                yield (keep & ALL, wild & ALL, rest & ALL), np.frombuffer(raw, U64)

    return lambda batches: _deal(given(batches), buckets, {})


# -- buckets ---------------------------------------------------------------------------------------


def _small(fps: np.ndarray, sizes: np.ndarray, wild: int):
    """Links inside consecutive buckets of the given sizes, all pairs looked at."""
    inside = np.arange(len(fps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.append(0, np.cumsum(inside))  # pairs with an earlier one of the bucket
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + PAIRS, "right")) - 1)
        y = np.repeat(np.arange(lo, hi), inside[lo:hi])
        x = y - 1 - (np.arange(len(y)) - np.repeat(before[lo:hi] - before[lo], inside[lo:hi]))
        unlike = fps[x] ^ fps[y]
        near = (np.bitwise_count(unlike) <= RADIUS) & (unlike & U64(wild) == U64(wild))
        yield fps[x[near]], fps[y[near]]
        lo = hi


def _searched(sides: list[np.ndarray], budget: float):
    """Links that connect what is linked between two sides, or inside one; and where more than
    ``budget`` comparisons would be needed, those fingerprints that aren't compared with all others
    (else None).  What is compared goes on from neighbour to neighbour, so that those which are
    connected already aren't looked at again."""
    rest, other, stack, links, looked = list(sides), len(sides) - 1, [], [], 0
    while stack or (len(rest[0]) and len(rest[other])):
        if looked > budget:
            return links, np.concatenate([*rest, np.array([p for _, p in stack], U64)])
        if not stack:
            stack.append((0, rest[0][0]))
            rest[0] = rest[0][1:]
        side, p = stack.pop()
        there = other - side
        near = np.bitwise_count(rest[there] ^ p) <= RADIUS
        looked += len(near)
        if near.any():
            found = rest[there][near]
            rest[there] = rest[there][~near]
            links.append((np.full(len(found), p), found))
            stack += [(there, q) for q in found]
    return links, None


def _sides(fps: np.ndarray, wild: int):
    """The pairs of sides of a bucket that differ in all of the ``wild`` bits."""
    if not wild:
        yield [fps]
        return
    side = fps & U64(wild)
    for v in np.unique(side):
        if v < v ^ U64(wild):
            pair = [fps[side == v], fps[side == v ^ U64(wild)]]
            if len(pair[1]):
                yield sorted(pair, key=len)


def _met(last: bool):
    """Links (a, b) of one task's buckets, and the buckets that are to be refined."""
    names = ["a", "b", "keep", "wild", "rest", "fps"]

    def links(x, y):
        none = [pa.nulls(len(x), pa.int64())] * 3
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), *none, pa.nulls(len(x), pa.binary())], names=names)

    def run(batches):
        kinds = defaultdict(list)
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                n = int(np.frombuffer(raw, U64, 1)[0])
                masks, many = np.frombuffer(raw, U64, 3 * n, 8).reshape(n, 3).tolist(), np.frombuffer(raw, U64, n, 8 + 24 * n).astype(np.int64)
                fps = np.frombuffer(raw, U64, -1, 8 + 32 * n)
                for kind, own in zip(masks, np.split(fps, np.cumsum(many)[:-1]), strict=True):
                    kinds[tuple(kind)].append(own)
        for keep, wild, rest in sorted(kinds):
            fps = np.unique(np.concatenate(kinds.pop((keep, wild, rest))))
            fps = fps[np.argsort(fps & U64(keep), kind="stable")]
            first = np.flatnonzero(np.append(True, np.diff(fps & U64(keep)) != 0))
            sizes = np.diff(np.append(first, len(fps)))
            few = (sizes > 1) & (sizes <= PAIRED)
            for x, y in _small(fps[np.repeat(few, sizes)], sizes[few], wild):
                yield links(x, y)
            for i, n in zip(first[sizes > PAIRED].tolist(), sizes[sizes > PAIRED].tolist(), strict=True):
                own = fps[i : i + n]
                for sides in _sides(own, wild):
                    found, left = _searched(sides, np.inf if last else BUDGET)
                    if found:
                        yield links(*(np.concatenate(z) for z in zip(*found, strict=True)))
                    if left is not None:
                        signed = [pa.array(np.array([m], U64).view(np.int64)) for m in (keep, wild, rest)]
                        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), *signed, pa.array([left.tobytes()], pa.binary())], names=names)

    return run


_DEALT, _FOUND = "bucket int, payload binary", "a long, b long, keep long, wild long, rest long, fps binary"


def _warm(fps: DataFrame, n: int) -> dict[int, np.ndarray]:
    """For each segment its values that many fingerprints have: at most HOT_SHARE of each."""
    parts = segments(ALL)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("v")) for k, m in enumerate(parts)]))
    counted = fps.select(values.alias("x")).groupBy("x.k", "x.v").count()
    rows = counted.filter(F.col("count") > max(HOT, n // HOT_SHARE)).collect()
    return {m: np.array([r.v for r in rows if r.k == k], np.int64).view(U64) for k, m in enumerate(parts)}


def near_links(fps: DataFrame) -> list[DataFrame]:
    """Tables of links (a, b) that connect all of the distinct fingerprints (column fp) that differ
    in at most RADIUS bits."""
    n, width, out = fps.count(), shuffle_width(fps.sparkSession), []
    warm = _warm(fps, n)
    buckets = max(width, -(-n * 8 * len(variants(0, 0, ALL)) // TASK_BYTES))
    dealt = fps.select("fp").mapInArrow(_first(buckets, warm), _DEALT)
    for level in range(1, LEVELS + 1):
        found = stored(dealt.repartition(buckets, "bucket").mapInArrow(_met(level == LEVELS), _FOUND), "variants")
        out.append(found.filter("fps IS NULL").select("a", "b"))
        more = found.filter("fps IS NOT NULL").select("keep", "wild", "rest", "fps")
        size = more.agg(F.sum(F.length("fps").cast("long"))).first()[0]
        if not size:
            break
        buckets = max(width, -(-size * 50 // TASK_BYTES))
        dealt = more.repartition(width).mapInArrow(_again(buckets), _DEALT)
    return out


def simhash_components(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of ``docs`` (doc_id, text)."""
    rows = stored(docs.select("doc_id", "text").mapInArrow(_fingerprints(width, seed), "doc_id long, fp long"), "fingerprints")
    known = rows.filter("doc_id IS NOT NULL")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    links = near_links(classes)
    # a repeated doc_id is one node: its rows' fingerprints are connected through it
    repeated = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    links.append(known.join(repeated, "doc_id").select("a", F.col("fp").alias("b")))
    every = links[0]
    for t in links[1:]:
        every = every.unionByName(t)
    named = components(every.filter("a <> b").distinct()).withColumnRenamed("node", "fp")
    joined = stored(classes.join(named, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("copies"))
    found = stored(hot_join(joined.select("fp", F.col("copies").alias("rows"), "component"), least, ["component"]), "least").select("fp", F.col("rows").alias("copies"), "component_id")
    own = hot_join(rows, found, ["fp"], "left")
    return own.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
