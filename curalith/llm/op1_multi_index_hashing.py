"""Approximate nearest neighbours by largest inner product: multi-index hashing.

Vectors get binary codes from learned rotations (iterative quantisation on a bounded sample).  A
code is cut into substrings and each is indexed.  Codes within Hamming radius r of a query's agree
with it in some substring within r // SUBSTRINGS (pigeonhole), so probing all substrings' near
values finds every code within the radius; the found vectors are reranked by their exact inner
product in double precision.  Norms that differ are handled by one more coordinate, sqrt(M^2 - |x|^2),
with which the largest inner product is the smallest angle.

The search runs in blocks: distinct query vectors in blocks against shards of the index, each pair
of them one task of bounded size.  Equal vectors are searched once, and of equal candidates only
the first TOP + 1 ids can matter, so a very common vector costs nothing.

The radius is the smallest within which the sample's own nearest lie with share ``SAMPLE_RECALL``;
a query that finds too few rows within it is searched again with the full radius, that is exactly.

Defined results: vectors that are null, zero, of another length than most, or hold nulls or
non-finite numbers take no part; rows with the query's own vec_id are not its candidates; null
vec_ids take no part; with too few candidates all are returned; ties go to smaller vec_ids; equal
rows count once; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalith.llm.storage import stored

BITS, SUBSTRINGS = 128, 8
#: Vectors that the rotations and the radius are fitted on, and queries among them for the radius.
FIT_VECTORS, FIT_QUERIES, SAMPLE_RECALL = 4096, 512, 0.98
QUERY_BLOCK, SHARD = 4096, 16_384
#: All values of a substring by how many bits they have, and how many have at most so many.
BY_BITS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable").astype(np.uint16)
WITHIN = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), minlength=17))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles), a, b (a 128-bit key of the vector) of the rows that take part."""
    v = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # -0.0 is 0.0
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == (common.n if common else 0)).withColumns({k: F.xxhash64(F.lit(seed), "v") for seed, k in enumerate("ab")})


class Codes:
    """Fitted rotations: codes of index vectors and of queries as arrays of 16-bit substrings."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.longest = longest
        x = self._index_space(sample)
        self.mean = x.mean(axis=0)
        x = x - self.mean
        d = x.shape[1]
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        axes = np.vstack([axes, np.zeros((max(0, d - len(axes)), d))])[:d]
        blocks, made = [], 0
        while made < BITS:  # as many learned rotations as there are bits for
            k = min(d, BITS - made)
            p = x @ axes[:k].T
            r = np.linalg.qr(rng.normal(size=(k, k)))[0]
            for _ in range(20):
                u, _, w = np.linalg.svd(p.T @ np.where(p @ r > 0, 1.0, -1.0))
                r = u @ w
            blocks.append(axes[:k].T @ r)
            made += k
        self.matrix = np.hstack(blocks)

    def _index_space(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0.0, self.longest**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]]) / self.longest

    def _pack(self, x: np.ndarray) -> np.ndarray:
        bits = (x - self.mean) @ self.matrix > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def of_index(self, x: np.ndarray) -> np.ndarray:
        return self._pack(self._index_space(x))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        return self._pack(np.hstack([unit, np.zeros((len(x), 1))]))


def distances(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=1, dtype=np.int64)


def fit(rows: DataFrame, top: int) -> tuple[Codes, int] | None:
    """Codes and the radius, from those FIT_VECTORS of the distinct vectors with the smallest keys."""
    keys = [r.a for r in rows.select("a").orderBy("a").limit(FIT_VECTORS).collect()]
    if not keys:
        return None
    sample = sorted(rows.filter(F.col("a") <= keys[-1]).select("a", "b", "v").collect())[:FIT_VECTORS]
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0] ** 0.5
    x = np.array([r.v for r in sample])
    codes = Codes(x, longest)
    q = x[:FIT_QUERIES]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : max(1, min(top, len(x) - 1))]
    of_x, of_q = codes.of_index(x), codes.of_queries(q)
    found = np.concatenate([distances(of_x[n], c) for n, c in zip(near, of_q, strict=True)])
    return codes, int(np.quantile(found, SAMPLE_RECALL, method="higher"))


class Shard:
    """A shard's index: for each substring a table by its value of the codes that have it."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.tables = []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            first = np.searchsorted(codes[order, j], np.arange((1 << 16) + 1))
            self.tables.append((np.unique(codes[:, j]), first, order))

    def within(self, one: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within ``radius`` of ``one``: every substring's table is probed with
        all values near enough to the query's, or with those that it holds if they are fewer."""
        hit = np.zeros(len(self.codes), bool)
        reach = min(16, radius // len(self.tables))
        for j, (values, first, order) in enumerate(self.tables):
            if WITHIN[reach] <= len(values):
                keys = BY_BITS[: WITHIN[reach]] ^ one[j]
            else:
                keys = values[np.bitwise_count(values ^ one[j]) <= reach]
            begin = first[keys]
            many = first[keys.astype(np.int64) + 1] - begin
            used = many > 0
            begin, many = begin[used], many[used]
            hit[order[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())]] = True
        found = np.flatnonzero(hit)
        return found[distances(self.codes[found], one) <= radius]


def _search(codes: Codes, radius: int, top: int):
    """One block of queries against one shard: each query vector's best ids there."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and index.num_rows:
            wide = lambda t: np.asarray(t["v"].combine_chunks().flatten()).reshape(t.num_rows, -1)
            q, x = wide(queries), wide(index)
            shard, of_q, ids = Shard(codes.of_index(x)), codes.of_queries(q), index["ids"].to_pylist()
            least = np.array([i[0] for i in ids])
            for a, b, one, v in zip(queries["a"].to_pylist(), queries["b"].to_pylist(), of_q, q, strict=True):
                found = shard.within(one, radius)
                scores = (x[found] * v).sum(axis=1)
                best = np.lexsort((least[found], -scores))[: top + 1]
                rows = sorted((-scores[k], i) for k in best.tolist() for i in ids[found[k]])[: top + 1]
                out += [(a, b, i, -s) for s, i in rows]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "vec_id", "score"])

    return run


def _in_blocks(queries: DataFrame, index: DataFrame, codes: Codes, radius: int, top: int) -> DataFrame:
    """a, b, best: each query vector's first ``top`` + 1 ids over all shards, nearest first."""
    blocks, shards = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (index, SHARD)))
    dealt = lambda df, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64("b", F.lit(2)), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
    q = dealt(queries.select("a", "b", "v"), "block", blocks, "shard", shards)
    x = dealt(index.select("a", "b", "v", "ids"), "shard", shards, "block", blocks)
    run = _search(codes, radius, top)
    found = q.groupBy("block", "shard").cogroup(x.groupBy("block", "shard")).applyInArrow(run, "a long, b long, vec_id long, score double")
    order = Window.partitionBy("a", "b").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= top + 1)
    return best.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("k", "vec_id", "score"))).alias("best"))


def nearest(vectors: DataFrame, is_query, top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) for which the
    condition ``is_query`` holds, its ``top`` nearest other rows."""
    rows = stored(valid_vectors(vectors).dropDuplicates(["vec_id", "a", "b"]), "vectors")
    empty = "query_id long, rank int, vec_id long, score double"
    asked = rows.filter(is_query)
    # own rows are left out at the end: as many more are kept as one id has different vectors
    own_rows = asked.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    wanted, top = top, top + own_rows - 1
    first = Window.partitionBy("a", "b").orderBy("vec_id")
    few = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= top + 1)
    index = stored(few.groupBy("a", "b").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "index")
    fitted = fit(index, top)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], empty)
    codes, radius = fitted
    queries = stored(asked.join(index.select("a", "b"), ["a", "b"]).groupBy("a", "b").agg(F.first("v").alias("v")), "queries")
    found = stored(_in_blocks(queries, index, codes, radius, top), "found")
    enough = min(top + 1, rows.select("vec_id").limit(top + 1).count())
    short = queries.join(found.filter(F.size("best") >= enough), ["a", "b"], "left_anti")
    if not short.isEmpty():
        again = stored(_in_blocks(stored(short, "short"), index, codes, BITS, top), "again")
        found = found.join(again.select("a", "b"), ["a", "b"], "left_anti").unionByName(again)
    joined = asked.select(F.col("vec_id").alias("query_id"), "a", "b").join(found, ["a", "b"])
    own = joined.select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, wanted).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
