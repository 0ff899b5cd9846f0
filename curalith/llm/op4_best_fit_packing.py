"""Best-fit packing by a grouping genetic algorithm (GGA).

An individual is a whole packing: its genes are bins, not items.  Crossover takes the well-filled
bins of one parent whole into the other, drops that parent's bins which now hold a duplicate, and
puts the displaced items into the bins where they fit best.  Items are dealt at random into blocks of
bounded size; each block is evolved by several islands (one task each), and between epochs every
island sends its elite to the next one, by a shuffle.  After a round, bins that are as good as full
stay; the items of the others go into a next round with fewer, new blocks, until one block is left
or a round makes no more full bins.  So the waste is that of a few bins, however large the input.

Defined results: a null text is empty; every row of the input is its own document, so rows that
repeat a doc_id or a text are all packed; an empty table gives no sequences.  Pieces that fill a
sequence alone aren't searched for.  Ties in length are ordered by the row's number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.kernels import flat_texts
from curalith.llm.storage import stored
from curalith.llm.tokens import word_encoder

CAPACITY = 4096
#: Items of a block, islands for each block, individuals for each island.
BLOCK_ITEMS, ISLANDS, POPULATION = 2048, 2, 4
#: Epochs between which elites migrate, and crossovers of an island in each.
EPOCHS, CROSSOVERS = 2, 8
#: Unused share of a bin up to which it is kept between rounds.
FULL = 0.001
MAX_ROUNDS = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut into
    pieces of ``capacity`` ids of which the last may be shorter."""

    def cut(batches):
        encoder = word_encoder(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = flat_texts(batch.column("text"))
            out = []
            for k, ids in encoder.documents(data, offsets):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, lo in enumerate(range(0, len(ids), capacity)):
                    own = ids[lo : lo + capacity]
                    out.append((doc_ids[k], piece, lo, len(own), zlib.crc32(own.tobytes())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts items, in their order, each into the fullest bin that takes it, or a new one."""
    free = sorted((r, b) for b, r in enumerate(room) if r > 0)
    for i in items:
        at = bisect_left(free, (sizes[i], -1))
        if at < len(free):
            r, b = free.pop(at)
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
            room.append(capacity)
        room[b] = r - sizes[i]
        if room[b] > 0:
            insort(free, (room[b], b))


def fitness(room: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with fuller bins among them (larger is better)."""
    fill = 1 - np.asarray(room, float) / capacity
    return -len(room), float((fill * fill).mean()) if len(room) else 0.0


def crossover(one: tuple, other: tuple, sizes: list[int], capacity: int, rng) -> tuple:
    """The well-filled bins of ``other`` go whole into ``one``."""
    bins, room = one
    given = [b for b, r in enumerate(other[1]) if r <= FULL * capacity]
    if not given:
        given = sorted(range(len(other[1])), key=lambda b: other[1][b])[: max(1, len(other[1]) // 4)]
    picked = [b for b, keep in zip(given, rng.random(len(given)) < 0.5, strict=True) if keep] or given[:1]
    injected = {i for b in picked for i in other[0][b]}
    kept = [b for b, own in enumerate(bins) if injected.isdisjoint(own)]
    held = set(kept)
    displaced = [i for b, own in enumerate(bins) if b not in held for i in own if i not in injected]
    # the emptiest of the kept bins give their items up as well, so that new fits can form
    loose = {b for b in sorted(kept, key=lambda b: -room[b])[:2] if room[b] > 0}
    displaced += [i for b in loose for i in bins[b]]
    new = [list(other[0][b]) for b in picked] + [list(bins[b]) for b in kept if b not in loose]
    left = [other[1][b] for b in picked] + [room[b] for b in kept if b not in loose]
    displaced.sort(key=lambda i: (-sizes[i], i))
    if len(displaced) > 2 and rng.random() < 0.5:  # a little disorder keeps parents apart
        k = int(rng.integers(len(displaced) - 1))
        displaced[k], displaced[k + 1] = displaced[k + 1], displaced[k]
    best_fit(displaced, sizes, new, left, capacity)
    return new, left


def _individual(of: np.ndarray, sizes: list[int], capacity: int) -> tuple:
    bins: list[list[int]] = [[] for _ in range(int(of.max()) + 1 if len(of) else 0)]
    room = [capacity] * len(bins)
    for i, b in enumerate(of.tolist()):
        bins[b].append(i)
        room[b] -= sizes[i]
    return bins, room


def _genes(bins: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, np.int32)
    for b, own in enumerate(bins):
        of[own] = b
    return of.tobytes()


def evolve(sizes: list[int], given: list[bytes], capacity: int, seed: int, size: int = POPULATION, crossovers: int = CROSSOVERS) -> list[bytes]:
    """An island's next population, its elite first.  Individuals are bins' numbers by item."""
    n, rng = len(sizes), np.random.default_rng(seed)
    people = [_individual(np.frombuffer(g, np.int32), sizes, capacity) for g in given]
    by_size = sorted(range(n), key=lambda i: (-sizes[i], i))
    while len(people) < size:
        order = by_size
        if people:  # the first is best-fit decreasing; others start from disturbed orders
            noise = rng.random(n)
            order = sorted(range(n), key=lambda i: (-sizes[i] * (1 + 0.3 * noise[i]), i))
        bins, room = [], []
        best_fit(order, sizes, bins, room, capacity)
        people.append((bins, room))
    rank = lambda x: fitness(x[1], capacity)
    people.sort(key=rank, reverse=True)
    least = -(-sum(sizes) // capacity)
    for _ in range(crossovers):
        if len(people[0][1]) <= least:
            break
        a, b = rng.choice(len(people), 2, replace=False)
        people.append(crossover(people[a], people[b], sizes, capacity, rng))
        people.sort(key=rank, reverse=True)
        people = people[:size]
    return [_genes(x[0], n) for x in people[:size]]


STATE = "block long, island int, items binary, sizes binary, genes array<binary>"
_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("items", pa.binary()), ("sizes", pa.binary()), ("genes", pa.list_(pa.binary()))])


def _begin(capacity: int):
    """One island's first epoch from its block's items."""

    def run(table: pa.Table) -> pa.Table:
        items, sizes = np.asarray(table["uid"], np.int64), np.asarray(table["length"], np.int64)
        block, island = table["block"][0].as_py(), table["island"][0].as_py()
        order = np.lexsort((items, -sizes))
        items, sizes = items[order], sizes[order]
        genes = evolve(sizes.tolist(), [], capacity, seed=(block * 1009 + island) % (1 << 32))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((block, island, items.tobytes(), sizes.tobytes(), genes), _STATE, strict=True)], schema=_STATE)

    return run


def _migrated(capacity: int, epoch: int):
    """One island's next epoch from its own population and the elite sent to it."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: len(r["genes"]))
        sizes = np.frombuffer(rows[0]["sizes"], np.int64).tolist()
        genes = [g for r in rows for g in r["genes"]][: POPULATION + 1]
        genes = evolve(sizes, list(dict.fromkeys(genes)), capacity, seed=(rows[0]["block"] * 1009 + rows[0]["island"] + 7919 * epoch) % (1 << 32))
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip((rows[0]["block"], rows[0]["island"], rows[0]["items"], rows[0]["sizes"], genes), _STATE, strict=True)], schema=_STATE)

    return run


def _chosen(capacity: int, everything: bool):
    """Of a block's islands the best packing: uid, bin, place and whether the bin is kept."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sizes = np.frombuffer(rows[0]["sizes"], np.int64)
        n = len(sizes)
        people = [np.frombuffer(r["genes"][0], np.int32) for r in sorted(rows, key=lambda r: r["island"])]
        rooms = [capacity - np.bincount(of, sizes).astype(np.int64) for of in people]
        best = max(range(len(people)), key=lambda k: (fitness(rooms[k].tolist(), capacity), -k))
        of, room = people[best], rooms[best]
        order = np.argsort(of, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        place = np.empty(n, np.int64)
        place[order] = before - np.repeat(before[first], np.diff(np.append(first, n)))
        kept = (room[of] <= FULL * capacity) | everything
        return pa.table({"uid": np.frombuffer(rows[0]["items"], np.int64), "length": sizes, "block": np.full(n, rows[0]["block"]), "bin": of.astype(np.int64), "offset": place, "kept": kept})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(uid, length) with distinct uids and lengths from 1 to ``capacity`` -> uid, sequence_id,
    offset: every item's sequence and place there."""
    alone = items.filter(F.col("length") == capacity).select("uid", (F.col("uid") + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.filter(F.col("length") < capacity).select("uid", "length")
    found, before, count = [alone], None, rest.count()
    for turn in range(MAX_ROUNDS):
        if not count:
            break
        blocks = max(1, -(-count // BLOCK_ITEMS))
        everything = blocks == 1 or turn == MAX_ROUNDS - 1 or (before is not None and count > 0.9 * before)
        dealt = rest.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks))).withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
        state = dealt.groupBy("block", "island").applyInArrow(_begin(capacity), STATE)
        for epoch in range(1, EPOCHS):
            next_island = F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")
            # each row goes to its own island whole, and its elite alone to the next
            sent = F.array(F.struct("island", "genes"), F.struct(next_island.alias("island"), F.slice("genes", 1, 1).alias("genes")))
            state = state.withColumn("sent", F.explode(sent)).select("block", "sent.island", "items", "sizes", "sent.genes")
            state = state.groupBy("block", "island").applyInArrow(_migrated(capacity, epoch), STATE)
        packed = stored(state.groupBy("block").applyInArrow(_chosen(capacity, everything), "uid long, length long, block long, bin long, offset long, kept boolean"), "packing")
        sequence = F.lit(turn << 56).bitwiseOR(F.shiftleft("block", 16)).bitwiseOR(F.col("bin"))
        found.append(packed.filter("kept").select("uid", sequence.alias("sequence_id"), "offset"))
        rest = packed.filter("not kept").select("uid", "length")
        before, count = count, rest.count()
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """Packs ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(cut_documents(docs, tokenizer, end_id, capacity), "pieces").withColumn("uid", F.monotonically_increasing_id())
    pieces = stored(pieces, "pieces")
    return pieces.join(pack(pieces, capacity), "uid").drop("uid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
