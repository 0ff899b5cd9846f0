"""Token-id files: every document's ids compressed on their own with one shared zstandard dictionary.

File format (a Parquet table, so that any Spark store can hold it): one row is a block of
consecutive documents with ``part`` and ``block`` (their order), ``first_id`` and ``last_id`` (the
least and the greatest of their ids, by which readers skip blocks), ``doc_ids``, ``n_tokens`` (each
document's number of ids), ``frames`` (where each document's frame ends in ``payload``),
``payload`` (zstandard frames of little-endian unsigned 32-bit ids, one for each document) and
``dict_hash`` (SHA-256 of the dictionary).  The dictionary lies beside the blocks in a table of
one row.  One short document is read by the offset index without its neighbours' frames.

Defined results: a null text is empty (its ids are the end id alone); null doc_ids come first;
rows that repeat a doc_id are ordered by a hash of their text, then by the text, and each is
written.  An empty table gives files without blocks.  Other columns of the input don't matter.
"""

from __future__ import annotations

import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curalith.llm.kernels import flat_texts
from curalith.llm.storage import new_folder, shuffle_width, text_batches
from curalith.llm.tokens import word_encoder

#: Bounds of the dictionary and of the documents that it is trained on.
DICTIONARY_BYTES = 32_768
TRAIN_DOCUMENTS = 256
TRAIN_TEXT_BYTES = 16_384
#: A block is closed at so many bytes of frames or so many documents.
BLOCK_BYTES, BLOCK_DOCUMENTS = 1 << 20, 1024

BLOCKS = "part long, block long, first_id long, last_id long, doc_ids array<long>, n_tokens array<long>, frames array<long>, payload binary, dict_hash string"


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A dictionary from the id arrays of TRAIN_DOCUMENTS short documents, those whose text has the
    smallest hash; empty when there is too little to train on."""
    short = docs.select("text").filter(F.octet_length("text").between(1, TRAIN_TEXT_BYTES)).withColumn("h", F.xxhash64("text"))
    # the hashes alone first, so that no partition sends texts that aren't taken
    hashes = [r.h for r in short.select("h").distinct().orderBy("h").limit(TRAIN_DOCUMENTS).collect()]
    chosen = short.filter(F.col("h") <= max(hashes, default=0)).groupBy("h").agg(F.min("text").alias("text"))
    texts = [r.text for r in sorted(chosen.collect())] if hashes else []
    data, offsets = flat_texts(pa.array(texts, pa.string()))
    samples = [np.append(ids, np.uint32(end_id)).astype("<u4").tobytes() for _, ids in word_encoder(tokenizer).documents(data, offsets)]
    if len(samples) < 16 or sum(map(len, samples)) < 4 * DICTIONARY_BYTES:
        return b"".join(samples)[:DICTIONARY_BYTES]
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def _dictionary(raw: bytes):
    """Trained dictionaries keep their tables; other bytes are shared content only."""
    kind = zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(raw, dict_type=kind) if len(raw) >= 8 else None


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the ids of ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    raw = train_dictionary(docs, tokenizer, end_id)
    key = sha256(raw).hexdigest()
    spark.createDataFrame([(key, bytearray(raw))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        part = TaskContext.get().partitionId()
        encoder, pressed = word_encoder(tokenizer), zstandard.ZstdCompressor(level=3, dict_data=_dictionary(raw))
        wide, longs = pa.int64(), pa.list_(pa.int64())
        schema = pa.schema(
            [("part", wide), ("block", wide), ("first_id", wide), ("last_id", wide), ("doc_ids", longs), ("n_tokens", longs), ("frames", longs), ("payload", pa.binary()), ("dict_hash", pa.string())]
        )
        block, ids_of, counts, ends, frames = 0, [], [], [], []

        def closed():
            known = [x for x in ids_of if x is not None] or [None]
            row = (part, block, known[0], known[-1], ids_of, counts, ends, b"".join(frames), key)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in text_batches(batches):
            doc_ids = batch.column("doc_id").to_pylist()
            data, offsets = flat_texts(batch.column("text"))
            for k, ids in encoder.documents(data, offsets):
                frame = pressed.compress(np.append(ids, np.uint32(end_id)).astype("<u4").tobytes())
                frames.append(frame)
                ids_of.append(doc_ids[k])
                counts.append(len(ids) + 1)
                ends.append((ends[-1] if ends else 0) + len(frame))
                if ends[-1] >= BLOCK_BYTES or len(ids_of) >= BLOCK_DOCUMENTS:
                    yield closed()
                    block, ids_of, counts, ends, frames = block + 1, [], [], [], []
        if ids_of:
            yield closed()

    ordered = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(shuffle_width(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, BLOCKS).write.parquet(f"{path}/blocks")


def _stored_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary)


def _frames(raw: bytes, key: str):
    """A function from a block's row to its documents' (place, doc_id, start in the block, ids)."""
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))

    def read(row: dict, wanted=None):
        if row["dict_hash"] != key:
            raise ValueError(f"a block names dictionary {row['dict_hash']}, the files have {key}")
        lo = start = 0
        for k, (doc_id, n, hi) in enumerate(zip(row["doc_ids"], row["n_tokens"], row["frames"], strict=True)):
            if wanted is None or doc_id == wanted:
                yield k, doc_id, start, np.frombuffer(press.decompress(row["payload"][lo:hi], max_output_size=4 * n), "<u4")
            lo, start = hi, start + n

    return read


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the ids read back from
    ``path``: ``ids`` as an array, or with ``digest`` ``ids_crc32``."""
    key, raw = _stored_dictionary(spark, path)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def decode(batches):
        read = _frames(raw, key)
        last = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))
        schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                out = [(row["part"], row["block"], doc_id, start, len(ids), zlib.crc32(ids.tobytes()) if digest else ids.tolist()) for _, doc_id, start, ids in read(row)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kind = "ids_crc32 long" if digest else "ids array<long>"
    rows = blocks.mapInArrow(decode, f"part long, block long, doc_id long, start long, n_tokens long, {kind}")
    sizes = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    # ids before a block: those before its part (as many rows as writing tasks) and, in the part, before it
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).withColumn("part_start", F.sum("n").over(Window.orderBy("part")) - F.col("n")).drop("n")
    inside = sizes.withColumn("block_start", F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).drop("n")
    starts = inside.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("before"))
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", kind.split()[0])


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the rows with one doc_id, by the offset index: only blocks
    whose range of ids holds it are read, and only its frames opened."""
    key, raw = _stored_dictionary(spark, path)
    own = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id) & F.array_contains("doc_ids", doc_id)
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter(own).orderBy("part", "block").toLocalIterator()
    return [ids.tolist() for row in rows for _, _, _, ids in _frames(raw, key)(row.asDict(), doc_id)]


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path, digest=True)
