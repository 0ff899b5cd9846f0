"""N-gram Jaccard self-join by a prefix tree.

A document's set is its distinct word n-grams.  Sets are ordered by one global order, rare n-grams
first: by the value of a counter that the n-gram shares with others (a table of fixed size, counted
over all documents), then by its hash.  Any order that is the same for all documents is exact; this
one keeps common passages out of the front.

1. Of two sets that are alike enough, the fronts (the first n - ceil(t n) + 1 members) share one.
   Fronts are dealt out by n-gram.  Documents with equal sets are one class.  Classes that meet are
   candidates if their lengths allow it: pairs where few meet at an n-gram, kept if they meet at as
   many n-grams of their fronts as the threshold asks for; where many meet, neighbours by length
   (which connects all whose lengths allow a link).
2. Candidates' components are cut into blocks of bounded size.  A block's sets are stored in a
   compressed trie, common n-grams first, and every set walks it: the overlap of a shared path is
   counted once, and a subtree is left as soon as its remaining length can't reach the threshold.
   Pairs that are connected already aren't looked at.
3. Components of more than one block: representatives of the blocks' components are joined again,
   level by level; then every set outside its component's largest class of linked sets walks the
   blocks of sets whose length allows a link.  So no link between different components is lost, and
   the many sets of a large group of near copies aren't compared in all pairs.  No task holds more
   than about BLOCK stored and PROBES walking sets of a component at once.

Defined results: null and empty texts have empty sets and are linked with nothing; rows with a null
doc_id take no part and have a null component_id; rows that repeat a doc_id are one node with the
links of all of them; equal sets are always in one component; an empty table gives no rows; other
columns don't matter.  A text is handled whole, whatever its length: its words and shingles must
fit a task's memory several times.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalith.llm.graph import components
from curalith.llm.kernels import chunks, distinct_sets, flat_texts, mix, set_hashes, shingles
from curalith.llm.storage import hot_join, shuffle_width, small_batches, stored, text_batches

#: Counters of the global order (a table of fixed size).
COUNTERS = 1 << 20
#: Tasks whose counters are added up together; three such steps make one row of 64 parts up to
#: FAN_IN**3 tasks, beyond that a few.
FAN_IN = 128
#: Classes that may meet at an n-gram and still be paired there; beyond, neighbours by length.
PAIRED = 48
#: Sets of a block, and sets that walk it in one task.
BLOCK, PROBES = 512, 2048


def _need(n, m, num: int, den: int):
    """The overlap that sets of n and m members need for a link (numbers or arrays)."""
    return -(-(num * (n + m)) // (den + num))


def _front(n, num: int, den: int):
    """How many first members decide whether a set can be linked at all."""
    return n - -(-(num * n) // den) + 1


def _sets(batch: pa.RecordBatch, width: int):
    """(first document, hashes, offsets) of the distinct n-grams, a bounded number of bytes at a time."""
    data, offsets = flat_texts(batch.column("text"))
    for lo, hi in chunks(offsets):
        at = offsets[lo : hi + 1]
        h, owner = shingles(data[at[0] : at[-1]], at - at[0], width)
        yield lo, *distinct_sets(h, owner, hi - lo)


def count_order(docs: DataFrame, width: int) -> np.ndarray:
    """The counters: how many n-grams of all documents' sets fall on each."""

    def counted(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in text_batches(batches):
            for _, h, _ in _sets(batch, width):
                counts += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        used = np.flatnonzero(counts)
        cuts = np.searchsorted(used, np.arange(65) * (COUNTERS // 64))
        some = [used[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [pa.array(np.arange(64)), pa.array([TaskContext.get().partitionId()] * 64, pa.int64()), pa.array([x.tobytes() for x in some], pa.binary()), pa.array([counts[x].tobytes() for x in some], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "task", "at", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total, part = np.zeros(COUNTERS // 64, np.int64), table["part"][0].as_py()
        for at, counts in zip(table["at"].to_pylist(), table["counts"].to_pylist(), strict=True):
            total[np.frombuffer(at, np.int64) - part * len(total)] += np.frombuffer(counts, np.int64)
        used = np.flatnonzero(total)
        columns = [pa.array([part]), table["task"].slice(0, 1), pa.array([(used + part * len(total)).tobytes()], pa.binary()), pa.array([total[used].tobytes()], pa.binary())]
        return pa.Table.from_arrays(columns, names=["part", "task", "at", "counts"])

    shape = "part long, task long, at binary, counts binary"
    parts = docs.select("text").mapInArrow(counted, shape)
    for _ in range(3):  # tasks' counters are added up by FAN_IN, so that no task reads those of all
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("part", "task").applyInArrow(summed, shape)
    out = np.zeros(COUNTERS, np.int64)
    with small_batches(docs.sparkSession):
        rows = parts.collect()
    for r in rows:
        np.add.at(out, np.frombuffer(r.at, np.int64), np.frombuffer(r.counts, np.int64))
    return out


def _ordered(h: np.ndarray, offsets: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Each set's members in the global order."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return h[np.lexsort((h, counters[(h >> np.uint64(44)).astype(np.int64)], owner))]


def _fronts(counters, width: int, num: int, den: int, buckets: int):
    """(bucket, payload) rows of fronts; a payload holds the classes of a chunk (id, set hash, size)
    and, for the bucket's n-grams, n-gram and class."""
    table = counters.value if hasattr(counters, "value") else counters

    def run(batches):
        for batch in text_batches(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, h, offsets in _sets(batch, width):
                n = np.diff(offsets)
                key, own = set_hashes(h, offsets), ids[lo : lo + len(n)].astype(np.int64)
                order = np.lexsort((own, key))  # equal sets of a chunk: the least id stands for them
                first = order[np.flatnonzero(np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)))] if len(order) else order
                first = np.sort(first[n[first] > 0])
                h = _ordered(h, offsets, table)
                size = _front(n[first], num, den)
                at = np.repeat(offsets[first] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                gram, of = h[at], np.repeat(np.arange(len(first), dtype=np.uint32), size)
                # n-grams of fronts crowd where counters are low, so their hash is mixed again
                bucket = (mix(gram) >> np.uint64(32)).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                out_bucket, out = [], []
                for b in np.flatnonzero(np.diff(cuts)):
                    pick = order[cuts[b] : cuts[b + 1]]
                    used, local = np.unique(of[pick], return_inverse=True)
                    f = first[used]
                    out_bucket.append(int(b))
                    out.append(np.array([len(used), len(pick)], np.int64).tobytes() + own[f].tobytes() + key[f].tobytes() + n[f].astype(np.uint32).tobytes() + gram[pick].tobytes() + local.astype(np.uint32).tobytes())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out, pa.binary())], names=["bucket", "payload"])

    return run


def _pairs_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs inside consecutive groups of the given sizes."""
    start = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    inside = np.arange(total) - np.repeat(start, sizes)
    i = np.repeat(np.arange(total), inside)
    j = np.repeat(np.repeat(start, sizes), inside) + np.arange(len(i)) - np.repeat(np.cumsum(inside) - inside, inside)
    return j, i


def _meetings(num: int, den: int):
    """Candidates of one partition's n-grams: a, b, met (n-grams; null where many meet), n_a, n_b."""

    def run(batches):
        ids, keys, sizes, grams, of, before = [], [], [], [], [], 0
        for batch in batches:
            for raw in batch.column("payload").to_pylist():
                c, g = np.frombuffer(raw, np.int64, 2)
                at = 16
                for out, kind, k in ((ids, np.int64, c), (keys, np.uint64, c), (sizes, np.uint32, c), (grams, np.uint64, g), (of, np.uint32, g)):
                    out.append(np.frombuffer(raw, kind, k, at))
                    at += np.dtype(kind).itemsize * int(k)
                of[-1] = of[-1].astype(np.int64) + before
                before += int(c)
        if not grams:
            return
        ids, keys, sizes, grams, of = map(np.concatenate, (ids, keys, sizes, grams, of))
        sizes = sizes.astype(np.int64)
        # one row for a class at an n-gram, under its least id
        order = np.lexsort((ids[of], keys[of], sizes[of], grams))
        g, k, o = grams[order], keys[of][order], of[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        g, o = g[new], o[new]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        many = np.diff(np.append(first, len(g)))
        size_of = np.repeat(many, many)
        n, i = sizes[o], ids[o]
        few = (size_of > 1) & (size_of <= PAIRED)
        x, y = _pairs_of(many[(many > 1) & (many <= PAIRED)])
        place = np.flatnonzero(few)
        x, y = place[x], place[y]
        ok = (den * n[x] >= num * n[y]) & (i[x] != i[y])
        x, y = x[ok], y[ok]
        hot = np.flatnonzero((size_of[1:] > PAIRED) & (g[1:] == g[:-1]))
        hot = hot[(den * n[hot] >= num * n[hot + 1]) & (i[hot] != i[hot + 1])]
        for met, a, b in ((True, x, y), (False, hot, hot + 1)):
            swap = i[a] > i[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            known, code = np.unique(i, return_inverse=True)
            _, pick, count = np.unique(code[a] * len(known) + code[b], return_index=True, return_counts=True)
            a, b = a[pick], b[pick]
            for lo in range(0, len(a), 100_000):
                p, q, c = a[lo : lo + 100_000], b[lo : lo + 100_000], count[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(i[p]), pa.array(i[q]), pa.array(n[p]), pa.array(n[q]), pa.array(c if met else [None] * len(c), pa.int64())], names=["a", "b", "n_a", "n_b", "met"])

    return run


class Trie:
    """A compressed trie of sets (ascending arrays of small numbers), with the bounds of what lies
    below each node."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tolist())
        self.root = self._node(0, len(sets), 0) if sets else None

    def _node(self, lo: int, hi: int, depth: int) -> list:
        """[depth, edge's members, least and largest size below, sets that end here, children, a set
        below if all of them are known to be connected]."""
        first, last = self.sets[self.order[lo]], self.sets[self.order[hi - 1]]
        k = min(len(first), len(last))
        unlike = np.flatnonzero(first[depth:k] != last[depth:k])
        end = depth + int(unlike[0]) if len(unlike) else k
        ending, children, at = [], [], lo
        while at < hi and len(self.sets[self.order[at]]) == end:
            ending.append(self.order[at])
            at += 1
        while at < hi:
            token, to = self.sets[self.order[at]][end], at + 1
            while to < hi and self.sets[self.order[to]][end] == token:
                to += 1
            children.append(self._node(at, to, end))
            at = to
        sizes = [len(self.sets[k]) for k in ending] + [s for c in children for s in c[2:4]]
        return [end, first[depth:end], min(sizes), max(sizes), ending, children, None]

    def _connected(self, node: list, top) -> int | None:
        """The group of all sets below a node, if it is one; once so, it stays so."""
        if node[6] is None:
            some, member = None, None
            for k in node[4]:
                if some is not None and top(k) != some:
                    return None
                some, member = top(k), k
            for child in node[5]:
                own = self._connected(child, top)
                if own is None or (some is not None and own != some):
                    return None
                some, member = own, child[6]
            node[6] = member
        return top(node[6])

    def walk(self, mask: np.ndarray, n: int, num: int, den: int, top=None, own=None):
        """(set, overlap) of the stored sets that are alike enough to the one that ``mask`` marks.
        With ``top`` (a set's group now) and ``own`` (the group of the walking set now), subtrees
        whose sets are all in that group already are left out."""
        stack = [(self.root, 0)] if self.root else []
        while stack:
            node, overlap = stack.pop()
            if top is not None and self._connected(node, top) == own():
                continue
            depth, edge, least, most, ending, children, _ = node
            if den * most < num * n or num * least > den * n:  # no length below allows a link
                continue
            overlap += int(np.count_nonzero(mask[edge]))
            # what lies below has at most so many more members, and the walking set itself has
            if overlap + min(most - depth, n - overlap) < _need(n, max(least, -(-num * n // den)), num, den):
                continue
            for k in ending:
                if overlap >= _need(n, depth, num, den):
                    yield k, overlap
            stack += [(c, overlap) for c in children]


class Groups:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def tie(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _local(blobs: list[bytes]) -> tuple[list[np.ndarray], int]:
    """Sets in one numbering of their n-grams, common ones first, and how many there are."""
    sets = [np.frombuffer(b, np.uint64) for b in blobs]
    _, back, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(many), np.int64)
    rank[np.lexsort((np.arange(len(many)), -many))] = np.arange(len(many))
    return [np.sort(x) for x in np.split(rank[back], np.cumsum([len(s) for s in sets])[:-1])], len(many)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _joined(num: int, den: int):
    """Links inside a block (columns node, label, probe, grams): stored rows against each other where
    nothing is a probe, else probes against stored rows; equal labels are connected already."""

    def run(table: pa.Table) -> pa.Table:
        nodes, labels, probe = table["node"].to_pylist(), table["label"].to_pylist(), table["probe"].to_pylist()
        links: list[tuple[int, int]] = []
        kept = [k for k, p in enumerate(probe) if not p]
        if kept and len(nodes) > 1:
            sets, many = _local(table["grams"].to_pylist())
            trie, groups = Trie([sets[k] for k in kept]), Groups(len(nodes))
            first: dict[int, int] = {}
            for k, label in enumerate(labels):
                groups.tie(k, first.setdefault(label, k))
            mask = np.zeros(many, bool)
            for k in [k for k, p in enumerate(probe) if p] or range(len(nodes)):
                mask[sets[k]] = True
                for j, _ in trie.walk(mask, len(sets[k]), num, den, lambda j: groups.top(kept[j]), lambda k=k: groups.top(k)):
                    if groups.tie(k, kept[j]):
                        links.append((nodes[k], nodes[kept[j]]))
                mask[sets[k]] = False
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*links, strict=True) if links else ([], []))], schema=_LINKS)

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows`` (comp, node, ...) with block (by hash) and blocks, how many their component has."""
    sizes = rows.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return rows.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _verified(sets: DataFrame, num: int, den: int) -> list[DataFrame]:
    """Tables of links (a, b) that connect what is linked among ``sets`` (comp, node, grams)."""
    run = _joined(num, den)
    join = lambda rows: stored(rows.select("comp", "block", "node", "label", "probe", "grams").groupBy("comp", "block").applyInArrow(run, "a long, b long"), "links")
    plain = {"label": F.col("node"), "probe": F.lit(False)}
    rows = stored(_blocks(sets).withColumns(plain), "sets")
    found = [join(rows)]
    large = rows.filter("blocks > 1")
    if large.isEmpty():
        return found
    large = large.drop("label", "probe")
    labelled = lambda: large.join(components(_union(found)).select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    before = None
    while True:  # representatives of what is connected so far, joined across blocks
        named = stored(labelled(), "labelled")
        heads = named.filter("label = node").drop("block", "blocks")
        count = heads.count()
        if before is not None and count > 0.7 * before:
            break
        before = count
        found.append(join(_blocks(heads).withColumn("probe", F.lit(False)).withColumn("label", F.col("node"))))
    counts = named.groupBy("comp", "label").count()
    main = counts.withColumn("k", F.row_number().over(Window.partitionBy("comp").orderBy(F.desc("count"), "label"))).filter("k = 1").select("comp", F.col("label").alias("main"))
    found.append(stored(_walked(named.drop("block", "blocks"), main, num, den).applyInArrow(run, "a long, b long"), "links"))
    return found


def _walked(named: DataFrame, main: DataFrame, num: int, den: int):
    """Groups of stored sets and of those that walk them.  Lengths are cut into ranges that grow by
    den / num, so that a set can be linked with its own range's sets and both neighbours' only."""
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    turn = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    length = F.length("grams") / 8
    ranged = named.withColumn("range", F.floor(F.log(length) / float(np.log(den / num))).cast("long"))
    cells = ranged.groupBy("comp", "range").agg(F.count("*").alias("held"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    walking = ranged.join(main, "comp").filter("label <> main").drop("main")
    # a hair's breadth of rounding at a range's border is covered by one range more on each side
    reached = walking.withColumn("range", F.explode(F.transform(F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)]), lambda k: F.col("range") + k)))
    many = reached.groupBy("comp", "range").agg(F.count("*").alias("reaching"), F.ceil(F.count("*") / PROBES).alias("slices"))
    tasks = stored(many.join(cells, ["comp", "range"]), "tasks")
    met = lambda rows, own: hot_join(rows, tasks.select("comp", "range", "blocks", "slices", F.col(own).alias("copies")), ["comp", "range"])
    columns = ["comp", "range", "block", "slice", "node", "label", "probe", "grams"]
    stored_sets = met(ranged, "held").withColumn("block", turn("blocks")).withColumn("slice", spread("slices")).withColumn("probe", F.lit(False))
    probes = met(reached, "reaching").withColumn("slice", turn("slices")).withColumn("block", spread("blocks")).withColumn("probe", F.lit(True))
    return stored_sets.select(*columns).unionByName(probes.select(*columns)).groupBy("comp", "range", "block", "slice")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text): two documents are
    linked when den * intersection >= num * union of their sets of ``width``-word n-grams."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    known = docs.filter("doc_id IS NOT NULL")
    counters = spark.sparkContext.broadcast(count_order(known, width))

    def measured(batches):
        for batch in text_batches(batches):
            for lo, h, offsets in _sets(batch, width):
                own = batch.column("doc_id").slice(lo, len(offsets) - 1)
                low, high = set_hashes(h, offsets), set_hashes(mix(h), offsets)
                yield pa.RecordBatch.from_arrays([own, pa.array(np.diff(offsets)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64))], names=["doc_id", "n_shingles", "low", "high"])

    rows = stored(docs.mapInArrow(measured, "doc_id long, n_shingles long, low long, high long"), "rows")
    known_rows = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stored(known_rows.groupBy("low", "high").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).filter("copies > 1"), "classes")
    width_of = shuffle_width(spark)
    fronts = known.mapInArrow(lambda batches: _fronts(counters, width, num, den, 4 * width_of)(batches), "bucket int, payload binary").repartition(width_of, "bucket")
    met = fronts.mapInArrow(_meetings(num, den), "a long, b long, n_a long, n_b long, met long")
    met = met.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("met").alias("met"), F.max(F.col("met").isNull()).alias("hot"))
    # common members outside both fronts lie in the rest of that set whose front ends first
    rest = F.greatest(*[F.ceil(num * F.col(n) / den) - 1 for n in ("n_a", "n_b")])
    least = F.ceil(F.lit(num) * (F.col("n_a") + F.col("n_b")) / (den + num)) - rest
    candidates = stored(met.filter(F.col("hot") | (F.col("met") >= least)).select("a", "b"), "candidates")
    groups = components(candidates).select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))

    def as_sets(batches):
        for batch in text_batches(batches):
            for lo, h, offsets in _sets(batch, width):
                k = len(offsets) - 1
                grams = [h[i:j].tobytes() for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("comp").slice(lo, k), batch.column("doc_id").slice(lo, k), pa.array(grams, pa.binary())], names=["comp", "node", "grams"])

    sets = known.join(groups.hint("merge"), "doc_id").mapInArrow(as_sets, "comp long, node long, grams binary").filter(F.length("grams") > 0)
    linked = components(_union([*_verified(sets, num, den)]))
    own = hot_join(rows, classes, ["low", "high"], "left").withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node"))).withColumn("node", F.coalesce("node", "doc_id"))
    # a repeated doc_id is one node: its rows' classes are connected through it
    repeated = own.filter("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    again = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    if not again.isEmpty():
        linked = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(repeated))
        own = own.withColumn("node", F.col("doc_id"))
    return own.join(linked, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)
