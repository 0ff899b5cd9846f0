"""Hard-negative mining by dual-tree search over largest inner products.

Candidates and anchors both stand in trees of balls.  Of two balls the inner products of all their
vectors lie in one interval: c . d, give or take |c| s + |d| r + r s (centres c, d, radii r, s).  So
a pair of nodes, a whole group of anchors with a whole group of candidates, is left as soon as its
interval misses every score that its anchors still look for, or as its labels do; pairs of leaves
that remain are scored exactly.

1. Equal vectors of one label are one candidate with its first ids (more can't matter), and equal
   anchors are searched once.  A tree of at most CELLS cells, fitted on FIT vectors, deals all
   vectors to cells, cells are cut into shards of at most SHARD, and a shard's tree is built once:
   by label first, then halved along its widest component.  Anchors are dealt the same way, in
   blocks of about BLOCK.
2. Positives: blocks meet the shards of their own cell, which bounds what they still look for, and
   then the shards of the cells whose ball may hold more.
3. Negatives: each anchor looks for the first ones in the window of scores of each of its positives,
   all windows at once; blocks meet the shards of the cells that may hold such scores.

A task holds one block and one shard.  The anchors are a stated query set; where nothing can be
pruned (vectors without any structure) each block meets all shards.  Scores are integers below 2**53
and exact; vectors with larger components raise an error.

Defined results: rows with a null vec_id or label, a null vector, null or non-finite components or
another length than most take no part; rows that are equal in vec_id, label and vector count once,
others that repeat a vec_id are rows like all others; negative positive scores have empty windows;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalith.llm.storage import stored

#: Rows of a shard and of a block of anchors, and of the leaves of their trees.
SHARD, BLOCK, LEAF, ANCHOR_LEAF = 8192, 2048, 64, 32
#: Cells at most, rows of a cell before there are more of them, vectors that they are fitted on.
CELLS, CELL_ROWS, FIT = 256, 65_536, 4096
#: Leaves that are scored first, to bound what the others must reach.
AHEAD = 2
LARGE = 2.0**60


# -- trees -----------------------------------------------------------------------------------------


def node_bounds(n: int, depth: int) -> np.ndarray:
    """Where the 2**depth leaves of a tree over n rows begin and end."""
    bounds = [0, n]
    for _ in range(depth):
        bounds = [0, *(x for lo, hi in zip(bounds[:-1], bounds[1:], strict=True) for x in ((lo + hi) // 2, hi))]
    return np.array(bounds)


def depth_for(n: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))


def tree_order(x: np.ndarray, labels: np.ndarray, leaf: int) -> np.ndarray:
    """The rows in the order of their tree: by label, then each half's half along its widest component."""
    order, bounds = np.argsort(labels, kind="stable"), [0, len(x)]
    for level in range(depth_for(len(x), leaf)):
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            own = order[lo:hi]
            if labels[own[0]] == labels[own[-1]]:
                part = x[own]
                order[lo:hi] = own[np.argpartition(part[:, np.ptp(part, axis=0).argmax()], (hi - lo) // 2)]
        bounds = node_bounds(len(x), level + 1).tolist()
    return order


class Tree:
    """Balls and label ranges of all nodes, level by level, over rows in tree order."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        self.x, self.labels, self.depth = x, labels, depth_for(len(x), leaf)
        self.bounds = [node_bounds(len(x), level) for level in range(self.depth + 1)]
        self.balls = []
        for bounds in self.bounds:
            first, many = bounds[:-1], np.diff(bounds)
            centre = np.add.reduceat(x, first, axis=0) / many[:, None]
            away = x - np.repeat(centre, many, axis=0)
            radius = np.sqrt(np.maximum.reduceat(np.einsum("ij,ij->i", away, away), first))
            self.balls.append((centre, radius, np.sqrt((centre * centre).sum(axis=1)), np.minimum.reduceat(labels, first), np.maximum.reduceat(labels, first)))


def interval(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between all nodes (centres, radii, norms of centres) of two levels."""
    (c, r, m), (d, s, n) = a, b
    dot, slack = c @ d.T, m[:, None] * s + r[:, None] * n + r[:, None] * s
    slack += 1e-9 * (m[:, None] * n + slack) + 1e-3  # rounding
    return dot - slack, dot + slack


def open_pairs(q: Tree, c: Tree, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of leaves may hold scores from ``low`` to ``high`` of their anchors between rows
    of one label (``same``) or of different ones, and the largest inner product that each may have."""
    alive = np.ones((1, 1), bool)
    for level in range(max(q.depth, c.depth) + 1):
        i, j = min(level, q.depth), min(level, c.depth)
        for axis, tree in enumerate((q, c)):
            if 0 < level <= tree.depth:
                alive = np.repeat(alive, 2, axis=axis)
        *ball, least, most = q.balls[i]
        *other, their_least, their_most = c.balls[j]
        lower, upper = interval(ball, other)
        first = q.bounds[i][:-1]
        alive &= (upper >= np.minimum.reduceat(low, first)[:, None]) & (lower <= np.maximum.reduceat(high, first)[:, None])
        if same:
            alive &= (least[:, None] <= their_most) & (most[:, None] >= their_least)
        else:
            alive &= (least != most)[:, None] | (their_least != their_most) | (least[:, None] != their_least)
        if not alive.any():
            break
    return alive, upper


def _best(row, score, ids, low, high, top: int):
    """(row, window, score, id) of the first ``top`` of each window of each row."""
    order = np.lexsort((ids, -score, row))
    row, score, ids, out = row[order], score[order], ids[order], []
    for w in range(low.shape[1]):
        pick = np.flatnonzero((score >= low[row, w]) & (score <= high[row, w]))
        own = row[pick]
        rank = np.arange(len(pick)) - np.searchsorted(own, own)
        pick = pick[rank < top]
        out.append((row[pick], np.full(len(pick), w), score[pick], ids[pick], rank[rank < top]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def dual_search(q: Tree, c: Tree, first_id: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, top: int, same: bool):
    """(anchor, window, score, id) of the first ``top`` of each anchor's windows (columns of ``low``
    and ``high``) among the candidates; those of a candidate k are ids[first_id[k] : first_id[k + 1]]."""
    alive, upper = open_pairs(q, c, low.min(axis=1), high.max(axis=1), same)
    leaves, theirs, found = q.bounds[-1], c.bounds[-1], []
    for leaf in np.flatnonzero(alive.any(axis=1)) if alive.shape[0] == len(leaves) - 1 else []:
        lo, hi = leaves[leaf], leaves[leaf + 1]
        near = np.flatnonzero(alive[leaf])
        near = near[np.argsort(-upper[leaf, near], kind="stable")]
        own_low, own_high, kept = low[lo:hi].copy(), high[lo:hi], [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]
        for part in (near[:AHEAD], near[AHEAD:]):
            part = part[upper[leaf, part] >= own_low.min()]
            if not len(part):
                break
            columns = np.concatenate([np.arange(theirs[k], theirs[k + 1]) for k in part])
            scores = q.x[lo:hi] @ c.x[columns].T
            ok = (scores >= own_low.min(axis=1)[:, None]) & (scores <= own_high.max(axis=1)[:, None]) & ((q.labels[lo:hi, None] == c.labels[columns]) == same)
            row, column = np.nonzero(ok)
            of = columns[column]
            many = first_id[of + 1] - first_id[of]
            at = np.repeat(first_id[of] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            new = np.repeat(row, many), np.repeat(scores[row, column], many), ids[at]
            kept = [np.concatenate(x) for x in zip(kept, new, strict=True)]
            row, window, score, some, rank = _best(*kept, own_low, own_high, top)
            full = rank == top - 1  # a full window's last one bounds the next ones
            own_low[row[full], window[full]] = np.maximum(own_low[row[full], window[full]], score[full])
        if len(kept[0]):
            found.append((row + lo, window, score, some))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4


# -- rows ------------------------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (array of whole numbers as doubles), a, b (a key of label and vector) of the
    rows that take part, each once."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v.alias("v")).filter(F.size("v") > 0)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    n = common.n if common else 0
    largest = F.array_max(F.transform("v", F.abs))
    checked = F.when(largest * largest * n < 2.0**53, F.col("v")).otherwise(F.raise_error(F.lit("components are too large for exact scores")).cast("array<double>"))
    return rows.filter(F.size("v") == n).withColumn("v", checked).withColumns({k: F.xxhash64(F.lit(seed), "label", "v") for seed, k in enumerate("ab")}).dropDuplicates(["vec_id", "a", "b"])


class Cells:
    """A tree of halving planes, fitted on a sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        order, self.planes = np.arange(len(sample)), []
        for level in range(depth):
            bounds, cut = node_bounds(len(sample), level), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                part = sample[order[lo:hi]]
                axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
                order[lo:hi] = order[lo:hi][np.argsort(part[:, axis], kind="stable")]
                cut.append((axis, float(sample[order[(lo + hi) // 2], axis]) if len(part) else 0.0))
            self.planes.append((np.array([a for a, _ in cut]), np.array([t for _, t in cut])))
        where = self(sample)
        self.centres = np.array([sample[where == k].mean(axis=0) if (where == k).any() else np.zeros(sample.shape[1]) for k in range(1 << depth)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for axis, value in self.planes:
            at = 2 * at + (x[np.arange(len(x)), axis[at]] >= value[at])
        return at


def _wide(column, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat, dtype=np.float64).reshape(n, -1)


def _with_cell(cells: Cells):
    def run(batches):
        for batch in batches:
            yield batch.append_column("cell", pa.array(cells(_wide(batch.column("v"), batch.num_rows)) if batch.num_rows else [], pa.int64()))

    return run


_SHARD = "cell long, slice long, radius double, labels binary, first_id binary, ids binary, v binary"


def _as_shard(cells: Cells):
    """The candidates of one shard as one row, in tree order."""

    def run(table: pa.Table) -> pa.Table:
        x, labels = _wide(table["v"], table.num_rows), table["label"].to_numpy()
        cell, order = table["cell"][0].as_py(), tree_order(x, labels, LEAF)
        ids = [table["ids"][k].as_py() for k in order.tolist()]
        away = x - cells.centres[cell]
        values = [cell, table["slice"][0].as_py(), float(np.sqrt((away * away).sum(axis=1).max())), labels[order].astype(np.int64).tobytes(), np.append(0, np.cumsum([len(i) for i in ids])).astype(np.int64).tobytes(), np.array([i for own in ids for i in own], np.int64).tobytes(), x[order].astype(np.int32).tobytes()]
        kinds = [pa.int64(), pa.int64(), pa.float64(), *[pa.binary()] * 4]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[c.split()[0] for c in _SHARD.split(", ")])

    return run


def _met(top: int, same: bool):
    """One block of anchors (aid, label, v, lows, highs) against one shard."""

    def run(anchors: pa.Table, shards: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if anchors.num_rows and shards.num_rows:
            one = {c: shards[c][0].as_py() for c in ("labels", "first_id", "ids", "v")}
            labels, first_id, ids = (np.frombuffer(one[c], np.int64) for c in ("labels", "first_id", "ids"))
            x, own = _wide(anchors["v"], anchors.num_rows), anchors["label"].to_numpy()
            order = tree_order(x, own, ANCHOR_LEAF)
            lows, highs = anchors["lows"].to_pylist(), anchors["highs"].to_pylist()
            low, high = np.full((len(x), max(map(len, lows))), LARGE), np.full((len(x), max(map(len, lows))), -LARGE)
            for k, i in enumerate(order.tolist()):
                low[k, : len(lows[i])], high[k, : len(highs[i])] = lows[i], highs[i]
            q, c = Tree(x[order], own[order], ANCHOR_LEAF), Tree(np.frombuffer(one["v"], np.int32).reshape(len(labels), -1).astype(np.float64), labels, LEAF)
            row, window, score, found = dual_search(q, c, first_id, ids, low, high, top, same)
            out = [anchors["aid"].to_numpy()[order][row], high[row, window] if len(row) else [], score, found]
        return pa.Table.from_arrays([pa.array(np.asarray(x).astype(np.int64)) for x in out], names=["aid", "high", "score", "vec_id"])

    return run


class Mine:
    """Candidates in shards, anchors in blocks, and searches of the latter in the former."""

    def __init__(self, rows: DataFrame, is_anchor, top: int):
        ids_at = Window.partitionBy("a", "b").orderBy("vec_id")
        few = rows.withColumn("k", F.row_number().over(ids_at)).filter(F.col("k") <= top)
        classes = stored(few.groupBy("a", "b").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
        n = classes.count()
        keys = [r.a for r in classes.select("a").orderBy("a").limit(FIT).collect()] if n else []
        sample = np.array([r.v for r in sorted(classes.filter(F.col("a") <= keys[-1]).select("a", "b", "v").collect())[:FIT]]) if n else np.zeros((0, 1))
        depth = depth_for(min(n, CELLS * CELL_ROWS), CELL_ROWS)
        self.cells = Cells(sample, min(depth, max(0, int(np.log2(max(1, len(sample)))))))
        shape = classes.select("a", "b", "label", "v", "ids")
        placed = stored(shape.mapInArrow(_with_cell(self.cells), "a long, b long, label long, v array<double>, ids array<long>, cell long"), "placed")
        dealt = lambda df, size: df.join(F.broadcast(df.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("_n"))), "cell").withColumn("slice", F.pmod(F.xxhash64("b", F.lit(3)), "_n")).drop("_n")  # noqa: E731  at most CELLS rows are sent
        self.shards = stored(dealt(placed, SHARD // 2).groupBy("cell", "slice").applyInArrow(_as_shard(self.cells), _SHARD), "shards")
        radii = {r.cell: r.r for r in self.shards.groupBy("cell").agg(F.max("radius").alias("r")).collect()}
        self.radius = np.array([radii.get(k, -1.0) for k in range(len(self.cells.centres))])
        self.anchors = rows.filter(is_anchor).select(F.col("vec_id").alias("anchor_id"), "a", "b", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).cast("long").alias("own"))
        asked = placed.join(self.anchors.select("a", "b").distinct(), ["a", "b"], "left_semi")
        self.blocks = stored(dealt(asked.drop("ids"), BLOCK).select("cell", "slice", F.monotonically_increasing_id().alias("aid"), "a", "b", "label", "v"), "blocks")

    def _open_cells(self, home: bool | None):
        """cell, slice, other: the cells that each block must meet; its own (``home``), the others
        (not ``home``), or all."""
        cells, radius = self.cells, self.radius

        def run(table: pa.Table) -> pa.Table:
            cell, x = table["cell"][0].as_py(), _wide(table["v"], table.num_rows)
            low, high = (np.array([f(i, default=d) for i in table[c].to_pylist()], float) for c, f, d in (("lows", min, LARGE), ("highs", max, -LARGE)))
            centre = x.mean(axis=0)[None]
            r = np.sqrt(((x - centre) ** 2).sum(axis=1).max())[None]
            lower, upper = interval((centre, r, np.sqrt((centre**2).sum(axis=1))), (cells.centres, np.maximum(radius, 0), np.sqrt((cells.centres**2).sum(axis=1))))
            there = (radius >= 0) & (upper[0] >= low.min()) & (lower[0] <= high.max())
            if home is not None:
                there &= (np.arange(len(radius)) == cell) == home
            other = np.flatnonzero(there)
            return pa.Table.from_arrays([pa.array(np.full(len(other), cell)), pa.array(np.full(len(other), table["slice"][0].as_py())), pa.array(other)], names=["cell", "slice", "other"])

        return run

    def search(self, anchors: DataFrame, top: int, same: bool, home: bool | None = None) -> DataFrame:
        """aid, high, score, vec_id: the first ``top`` of each window (lows, highs) of ``anchors``."""
        open_cells = anchors.groupBy("cell", "slice").applyInArrow(self._open_cells(home), "cell long, slice long, other long")
        slices = self.shards.select(F.col("cell").alias("other"), F.col("slice").alias("part"))
        pairs = stored(open_cells.join(slices, "other"), "pairs")
        asking = anchors.join(pairs, ["cell", "slice"]).select("cell", "slice", "other", "part", "aid", "label", "v", "lows", "highs")
        asked = self.shards.select(F.col("cell").alias("other"), F.col("slice").alias("part"), "labels", "first_id", "ids", "v").join(pairs, ["other", "part"])
        key = ["cell", "slice", "other", "part"]
        found = asking.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_met(top, same), "aid long, high long, score long, vec_id long")
        return first_rows(found, top)


def first_rows(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("aid", "high").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 5, least: tuple[int, int] = (80, 100), scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for the rows of
    ``vectors`` (vec_id, embedding, label) for which ``is_anchor`` holds, the first rows of other
    labels that score at most as much as one of the anchor's ``positives`` first rows of its own label
    and at least least[0] / least[1] of that."""
    rows = stored(whole_vectors(vectors, scale), "vectors")
    top, (num, den) = positives + 1, least
    mine = Mine(rows, is_anchor, max(top, negatives))
    all_scores = mine.blocks.withColumn("lows", F.array(F.lit(-LARGE))).withColumn("highs", F.array(F.lit(LARGE)))
    near = stored(mine.search(all_scores, top, same=True, home=True), "near")
    reached = near.filter(F.col("k") == top).select("aid", F.array(F.col("score").cast("double")).alias("lows"))
    further = mine.blocks.join(reached, "aid", "left").withColumn("lows", F.coalesce("lows", F.array(F.lit(-LARGE)))).withColumn("highs", F.array(F.lit(LARGE)))
    far = mine.search(further, top, same=True, home=False)
    best = first_rows(near.drop("k").unionByName(far.drop("k")), top)
    best = stored(best.groupBy("aid").agg(F.array_sort(F.collect_list(F.struct("k", "score", "vec_id"))).alias("best")), "positives")
    scores = F.array_distinct(F.transform(F.filter("best", lambda x: x["score"] >= 0), lambda x: x["score"]))
    windows = best.select("aid", scores.alias("s")).filter(F.size("s") > 0).select("aid", F.transform("s", lambda p: F.ceil(p * num / den).cast("double")).alias("lows"), F.col("s").cast("array<double>").alias("highs"))
    found = mine.search(mine.blocks.join(windows, "aid"), negatives, same=False)
    # the anchor's own row is left out once; equal ones can't be told apart
    others = F.transform("best", lambda x: F.struct(x["score"].alias("score"), x["vec_id"].alias("vec_id")))
    own = F.array_position("others", F.struct(F.col("own").alias("score"), F.col("anchor_id").alias("vec_id")))
    asked = mine.anchors.join(mine.blocks.select("aid", "a", "b"), ["a", "b"]).join(best, "aid").withColumn("others", others)
    pairs = asked.select("anchor_id", "aid", F.explode(F.slice(F.filter("others", lambda x, i: i != own - 1), 1, positives)).alias("p"))
    joined = pairs.select("anchor_id", F.col("p.vec_id").alias("positive_id"), "aid", F.col("p.score").alias("high")).join(found, ["aid", "high"])
    return joined.select("anchor_id", "positive_id", F.col("k").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("high").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH r AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM r a, r c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY rank <= 5
"""
