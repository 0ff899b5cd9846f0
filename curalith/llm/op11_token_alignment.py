"""Cross-tokenizer alignment: which tokens of one tokenizer share bytes with which of another, and
how often, over the whole corpus.

Both tokenizers spell the same bytes, so the ends of their tokens cut a document into pieces; each
piece is the overlap of one token of A and one of B, a link.  Ends that both have close a group.

1. One pass over the texts makes, for each chunk of documents, the rows of documents and for each
   stripe of STRIPE ids of A the chunk's id pairs (with how many documents hold each) and each
   pair's documents (with how many links).  These rows are written to the shared folder.
2. Pairs alone go to their stripes, which are dealt out by bytes, so that the stripe of the most
   frequent ids is many tasks.  Each adds its pairs up in a dense matrix of the stripe (np.add.at);
   the matrices of a stripe are added up by FAN_IN until one is left, whose row maxima are the
   counts of each id's best partners.
3. Links meet the counts of their stripe, dealt out by bytes in the same way.  Each chunk gets back
   sums of its documents, which are added up for the chunk.

A task holds a stripe's matrix (STRIPE rows of as many cells as B has ids) and a bounded number of
bytes of rows.  Nothing is collected but the bytes of each stripe, of which there are as many as
ids of A divided by STRIPE.

Defined results: texts that are null, empty or not spelled by the tokens of both (U+2581 in a text,
bytes that aren't UTF-8) have no tokens: zeros and an empty ``groups_sha256``.  Rows with a null
doc_id, and each of the rows that repeat one, are documents like all others.  An empty table gives
no rows.  Other columns don't matter.  A text is handled whole, whatever its length: its links must
fit a task's memory several times.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.kernels import chunks, flat_texts
from curalith.llm.storage import stored, text_batches
from curalith.llm.tokens import byte_vocabulary, piece_vocabulary

#: Ids of A in a stripe.
STRIPE = 128
#: Bytes of texts in a chunk, compressed bytes of a stripe's rows in one task, matrices added up at once.
CHUNK_BYTES, TASK_BYTES, FAN_IN = 1 << 20, 4 << 20, 16

_MADE = "chunk long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, pairs_bytes int, links_bytes int, pairs binary, links binary"
_COUNTS = "stripe int, part long, counts binary"


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one length, compressed."""
    head = np.array([len(columns[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpacked(raw: bytes, *kinds) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(raw)
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _decimals(ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Each id in decimal digits with its byte of ``ends`` after it; where each of them ends."""
    width = len(str(int(ids.max(initial=0))))
    cells = np.empty((len(ids), width + 1), np.uint8)
    rest, digits = ids.copy(), np.ones(len(ids), np.int64)
    for k in range(width - 1, -1, -1):
        cells[:, k] = 48 + rest % 10
        rest //= 10
        digits += (rest > 0) & (k > 0)
    cells[:, width] = ends
    return cells[np.arange(width + 1) >= (width - digits)[:, None]].tobytes(), np.cumsum(digits + 1)


class Aligned:
    """Tokens, groups and links of the documents of one flat array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, path_a: str, path_b: str):
        a, b, n = byte_vocabulary(path_a), piece_vocabulary(path_b), len(offsets) - 1
        self.n, self.ids_b = n, len(b.spelled)
        data = np.insert(data, offsets[:-1], 0x20)
        offsets = offsets + np.arange(n + 1)
        (ids_a, at_a, good_a), (ids_b, at_b, good_b) = a(data, offsets), b(data, offsets)
        good = good_a & good_b & (np.diff(offsets) > 1)
        doc_a, doc_b = (np.repeat(np.arange(n), np.diff(at)) for at in (at_a, at_b))
        self.a, self.b, self.doc_a, self.doc_b = ids_a[good[doc_a]], ids_b[good[doc_b]], doc_a[good[doc_a]], doc_b[good[doc_b]]
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        total = int(end_a[-1]) + 1 if len(end_a) else 0
        in_a, in_b = np.zeros(total, bool), np.zeros(total, bool)
        in_a[end_a], in_b[end_b] = True, True
        both = in_a & in_b
        ends = np.flatnonzero(in_a | in_b)
        self.link_a, self.link_b = (np.cumsum(x)[ends] - x[ends] for x in (in_a, in_b))
        before = np.cumsum(both) - both
        self.last_a, self.last_b, self.group_a, self.group_b = both[end_a], both[end_b], before[end_a], before[end_b]

    def counts(self) -> list[np.ndarray]:
        """n_a, n_b, n_groups, n_links of each document."""
        return [np.bincount(d, minlength=self.n) for d in (self.doc_a, self.doc_b, self.doc_a[self.last_a], self.doc_a[self.link_a])]

    def digests(self) -> list[str]:
        """The hash of each document's groups, written out; '' without tokens."""
        per_group = [np.append(0, np.cumsum(np.bincount(g, minlength=int(self.last_a.sum())))) for g in (self.group_a, self.group_b)]
        place_a = np.arange(len(self.a)) + per_group[1][self.group_a]
        place_b = np.arange(len(self.b)) + per_group[0][self.group_b + 1]
        ids, marks = np.empty(len(self.a) + len(self.b), np.int64), np.empty(len(self.a) + len(self.b), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        marks[place_a], marks[place_b] = np.where(self.last_a, ord("|"), ord(",")), np.where(self.last_b, ord(";"), ord(","))
        text, ends = _decimals(ids, marks)
        n_a, n_b = self.counts()[:2]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(n_a + n_b))].tolist()
        view = memoryview(text)
        return [sha256(view[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def stripes(self):
        """(stripe, pairs, links): a, b and number of documents of each pair of ids, and in the same
        order each of its documents with its number of links."""
        key = (self.a[self.link_a] * self.ids_b + self.b[self.link_b]) * self.n + self.doc_a[self.link_a]
        key, links = np.unique(key, return_counts=True)
        pair, doc = np.divmod(key, max(self.n, 1))
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        many, pair = np.diff(np.append(first, len(doc))), pair[first]
        a, b = np.divmod(pair, self.ids_b)
        cuts = np.flatnonzero(np.diff(a // STRIPE, prepend=-1))
        for i, j in zip(cuts.tolist(), [*cuts.tolist(), len(a)][1:], strict=True):
            lo, hi = int(first[i]), int(first[j]) if j < len(first) else len(doc)
            yield int(a[i]) // STRIPE, packed((a[i:j] % STRIPE).astype(np.uint8), b[i:j].astype(np.uint32), many[i:j].astype(np.uint32)), packed(doc[lo:hi].astype(np.uint32), links[lo:hi].astype(np.uint32))


def _made(path_a: str, path_b: str):
    """Rows of documents (without a stripe), then those of stripes, for each chunk of the texts."""
    shape = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for x in _MADE.split(", ")])

    def table(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in shape], schema=shape)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in text_batches(batches):
            data, offsets = flat_texts(batch.column("text"))
            for lo, hi in chunks(offsets, CHUNK_BYTES):
                own, n = offsets[lo : hi + 1], hi - lo
                found = Aligned(data[own[0] : own[-1]], own - own[0], path_a, path_b)
                n_a, n_b, n_groups, n_links = found.counts()
                yield table(n, chunk=np.full(n, chunk), at=np.arange(n), doc_id=batch.column("doc_id").slice(lo, n), n_a=n_a, n_b=n_b, n_groups=n_groups, n_links=n_links, groups_sha256=found.digests())
                stripes = list(found.stripes())
                if stripes:
                    stripe, pairs, links = zip(*stripes, strict=True)
                    yield table(len(stripes), chunk=np.full(len(stripes), chunk), stripe=stripe, pairs_bytes=list(map(len, pairs)), links_bytes=list(map(len, links)), pairs=pairs, links=links)
                chunk += 1

    return run


def _matrix(ids_b: int, rows) -> np.ndarray:
    """The dense matrix of a stripe, from (a, b, count) columns."""
    out = np.zeros((STRIPE, ids_b), np.int64)
    for a, b, n in rows:
        np.add.at(out, (a, b), n.astype(np.int64))
    return out


def _added(ids_b: int, kind):
    """The rows of one part of a stripe as one."""

    def run(table: pa.Table) -> pa.Table:
        total = _matrix(ids_b, (unpacked(x, np.uint8, np.uint32, kind) for x in table["counts"].to_pylist()))
        a, b = np.nonzero(total)
        raw = packed(a.astype(np.uint8), b.astype(np.uint32), total[a, b])
        return pa.Table.from_arrays([table["stripe"].slice(0, 1), table["part"].slice(0, 1), pa.array([raw], pa.binary())], names=["stripe", "part", "counts"])

    return run


def _parts(made: DataFrame, column: str) -> tuple[DataFrame, int]:
    """stripe, parts: in how many tasks of TASK_BYTES its rows are dealt out; the most of them."""
    sizes = made.groupBy("stripe").agg(F.sum(f"{column}_bytes").alias("bytes")).collect()
    parts = [(r.stripe, -(-r.bytes // TASK_BYTES)) for r in sizes]
    return F.broadcast(made.sparkSession.createDataFrame(parts, "stripe int, parts long")), max((p for _, p in parts), default=1)


def pair_counts(made: DataFrame, ids_b: int) -> DataFrame:
    """stripe, counts: in how many documents each pair of ids of the stripe is linked."""
    parts, most = _parts(made, "pairs")
    dealt = made.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), "parts").alias("part"), F.col("pairs").alias("counts"))
    out = dealt.groupBy("stripe", "part").applyInArrow(_added(ids_b, np.uint32), _COUNTS)
    while most > 1:
        out = out.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("stripe", "part").applyInArrow(_added(ids_b, np.int64), _COUNTS)
        most = -(-most // FAN_IN)
    return out.select("stripe", "counts")


def _scored(ids_b: int):
    """Sums of each chunk's documents over the links of one stripe."""

    def run(links: pa.Table, counts: pa.Table) -> pa.Table:
        chunk, out = [], []
        if links.num_rows:
            matrix = _matrix(ids_b, (unpacked(x, np.uint8, np.uint32, np.int64) for x in counts["counts"].to_pylist()))
            best = matrix.max(axis=1)
            for own, pairs, raw in zip(links["chunk"].to_pylist(), links["pairs"].to_pylist(), links["links"].to_pylist(), strict=True):
                a, b, many = unpacked(pairs, np.uint8, np.uint32, np.uint32)
                doc, n = unpacked(raw, np.uint32, np.uint32)
                count, n = matrix[a, b], n.astype(np.int64)
                of = np.repeat(np.arange(len(a)), many)
                used, doc = np.unique(doc, return_inverse=True)
                n_best, total = np.zeros(len(used), np.int64), np.zeros(len(used), np.int64)
                np.add.at(n_best, doc, n * (count == best[a])[of])
                np.add.at(total, doc, n * count[of])
                chunk.append(own)
                out.append(packed(used, n_best, total))
        return pa.Table.from_arrays([pa.array(chunk, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "sums"])

    return run


def _summed(docs: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk's documents with the sums of all stripes."""
    at = docs["at"].to_numpy()
    n_best, total = np.zeros(at.max(initial=0) + 1, np.int64), np.zeros(at.max(initial=0) + 1, np.int64)
    for raw in sums["sums"].to_pylist():
        doc, best, count = unpacked(raw, np.uint32, np.int64, np.int64)
        n_best[doc] += best
        total[doc] += count
    return docs.drop_columns(["chunk", "at"]).append_column("n_best", pa.array(n_best[at])).append_column("count_sum", pa.array(total[at]))


def token_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum of every row of ``docs``
    (doc_id, text): A is a byte-level tokenizers file, which reads a space before the text, and B a
    sentencepiece file, which adds that space."""
    ids_b = len(piece_vocabulary(path_b).spelled)
    made = stored(docs.select("doc_id", "text").mapInArrow(_made(path_a, path_b), _MADE), "aligned")
    own, striped = made.filter("stripe IS NULL"), made.filter("stripe IS NOT NULL")
    counts = stored(pair_counts(striped, ids_b), "counts")
    parts, _ = _parts(striped, "links")
    links = striped.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), "parts").alias("part"), "chunk", "pairs", "links")
    copies = counts.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "counts")
    sums = links.groupBy("stripe", "part").cogroup(copies.groupBy("stripe", "part")).applyInArrow(_scored(ids_b), "chunk long, sums binary")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    shape = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return own.select("chunk", "at", *columns).groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(_summed, shape)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_alignment(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
