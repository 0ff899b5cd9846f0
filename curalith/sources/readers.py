"""Readers.  Paths go to Spark, so they may be on any store that it reads."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curalith.functions.text import stripped

LOG = T.StructType([T.StructField(n, T.StringType()) for n in ("clip_id", "source", "source_id", "category", "text", "status")] + [T.StructField("scale", T.DoubleType()), T.StructField("attempts", T.IntegerType())] + [T.StructField(n, T.DoubleType()) for n in ("duration_s", "opening_hz", "median_f0_hz", "min_f0_hz", "voiced_ratio", "max_drop_st", "letters_per_s", "clipped_fraction")] + [T.StructField("reasons", T.StringType()), T.StructField("compute_s", T.DoubleType())])
MANIFEST = "id string, audio string, text string"


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """id, category, text of a ``|``-separated sentence file; ``#`` lines and blank ones are skipped.
    Lines with empty or missing fields and repeated ids raise, with the first of them named."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), stripped(F.regexp_replace("value", "^﻿", "")).alias("line")).filter("line <> '' AND NOT startswith(line, '#')")
    parts = F.split("line", r"\|", 3)
    rows = lines.select("file", "line", *[stripped(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(("id", "category", "text"))])
    bad = rows.filter("coalesce(id, '') = '' OR coalesce(category, '') = '' OR coalesce(text, '') = ''").first()
    if bad:
        raise ValueError(f"{bad.file}: expected id|category|text, found {bad.line!r}")
    twice = rows.groupBy("id").count().filter("count > 1").first()
    if twice:
        raise ValueError(f"{path}: id {twice.id!r} stands {twice['count']} times")
    return rows.select("id", "category", "text")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table of strings with a header; a byte order mark before it is dropped."""
    df = spark.read.options(sep="\t", header=True, encoding="UTF-8").csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """id, text, pos of a script: ids and texts are stripped, a null text is empty; of a repeated id
    the last text counts, at the first one's place."""
    df = read_tsv(spark, path)
    if not {"id", "train_text"} <= set(df.columns):
        raise ValueError(f"{path}: expected columns 'id' and 'train_text'")
    rows = df.select(stripped(F.col("id")).alias("id"), F.coalesce(stripped(F.col("train_text")), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("pos"))
    return rows.groupBy("id").agg(F.max_by("text", "pos").alias("text"), F.min("pos").alias("pos"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """id (as it stands) and category, "unknown" where the column or the value is missing."""
    df = read_tsv(spark, path)
    category = F.col("category") if "category" in df.columns else F.lit(None).cast("string")
    return df.select("id", F.coalesce(category, F.lit("unknown")).alias("category"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A generation log with typed columns; empty where there is no file yet."""
    try:
        return spark.read.schema(LOG).options(header=True, nullValue="", multiLine=True, escape='"').csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], LOG)
        raise


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id, audio, text of a JSON lines manifest; blank lines are skipped, a malformed line raises."""
    rows = spark.read.schema(f"{MANIFEST}, _malformed string").option("columnNameOfCorruptRecord", "_malformed").json(path)
    broken = F.when(F.col("_malformed").isNotNull(), F.raise_error(F.concat(F.lit("a manifest line is no JSON object: "), "_malformed"))).cast("string")
    rows = rows.filter("_malformed IS NOT NULL OR id IS NOT NULL OR audio IS NOT NULL OR text IS NOT NULL")
    return rows.select(F.coalesce(broken, "id").alias("id"), "audio", "text")


def load_config(text: str, overrides: list[str]) -> dict:
    """A JSON object with ``key=value`` overrides; a value that is no JSON stays a string."""
    config = json.loads(text)
    for item in overrides:
        key, _, value = item.partition("=")
        try:
            config[key] = json.loads(value)
        except ValueError:
            config[key] = value
    return config


def _samples(raw: bytes, channels: int, width: int) -> np.ndarray:
    """PCM bytes as levels from -1 to 1, a row for each frame and a column for each channel."""
    if len(raw) % (channels * width) or width not in (1, 2, 3, 4):
        raise ValueError("truncated or unknown samples")
    parts = np.frombuffer(raw, np.uint8).reshape(-1, width).astype(np.int64)
    values = (parts << (8 * np.arange(width))).sum(axis=1)
    values = values - 128 if width == 1 else values - ((values >> (8 * width - 1)) << 8 * width)
    return (values / (1 << 8 * width - 1)).reshape(-1, channels)


def _subtype(width: int) -> str:
    return "PCM_U8" if width == 1 else f"PCM_{8 * width}"


def decode_wav(content: bytes) -> dict:
    """Header, samples (channel by channel, from -1 to 1) and their digest (of 32-bit floats, channels
    interleaved) of a PCM WAV file, or an error."""
    empty = {"digest": None, "sample_rate": None, "channels": None, "subtype": None, "samples": None}
    try:
        with wave.open(io.BytesIO(content)) as w:
            n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
            levels = _samples(w.readframes(w.getnframes()), n, width)
        digest = sha256(levels.astype("<f4").tobytes()).hexdigest() if len(levels) else None
        return {"digest": digest, "sample_rate": rate, "channels": n, "subtype": _subtype(width), "samples": levels.T.tolist(), "error": None}
    except (wave.Error, EOFError, ValueError) as e:
        return empty | {"error": f"unreadable audio: {type(e).__name__}: {e}"}


def wav_chunks(name: str, content: bytes, length: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``chunks.CHUNKS`` of a PCM WAV file, one chunk of all channels at a time.  A file
    that ends early is one row with an error, after the chunks that could be read."""
    kinds = {"id": pa.string(), "sample_rate": pa.int32(), "channels": pa.int32(), "subtype": pa.string(), "error": pa.string(), "channel": pa.int32(), "chunk": pa.int64(), "start": pa.int64(), "samples": pa.list_(pa.float64())}
    row = lambda **given: pa.RecordBatch.from_arrays([pa.array([given.get(c)], k) for c, k in kinds.items()], names=list(kinds))
    try:
        with wave.open(io.BytesIO(content)) as w:
            n, width, rate, frames = w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()
            head = {"id": name, "sample_rate": rate, "channels": n, "subtype": _subtype(width)}
            if not frames:
                yield row(**head, channel=0, chunk=0, start=0, samples=[])
            for chunk in range(-(-frames // length)):
                levels = _samples(w.readframes(length), n, width)
                if len(levels) < min(length, frames - chunk * length):
                    raise ValueError("truncated or unknown samples")
                for c in range(n):
                    yield row(**head, channel=c, chunk=chunk, start=chunk * length, samples=levels[:, c])
    except (wave.Error, EOFError, ValueError) as e:
        yield row(id=name, error=f"unreadable audio: {type(e).__name__}: {e}")


def read_wav_chunks(spark: SparkSession, folder: str, length: int = 1 << 18) -> DataFrame:
    """Every WAV file as rows of ``length`` samples of one channel (see ``operators.chunks``).  A
    file's bytes stand in a task once, its samples a chunk at a time; a missing folder gives no rows."""
    shape = "id string, sample_rate int, channels int, subtype string, error string, channel int, chunk long, start long, samples array<double>"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from wav_chunks(batch.column("id")[k].as_py(), batch.column("content")[k].as_buffer().to_pybytes(), length)

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], shape)
    return files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("id"), "content").mapInArrow(decoded, shape)


def read_wavs(spark: SparkSession, folder: str) -> DataFrame:
    """id (the file's stem), digest of the samples, sample_rate, channels, subtype, samples (an array
    for each channel) and error of every WAV file; a broken one is a row with an error, not a
    failure; a missing folder gives no rows."""
    schema = "id string, digest string, sample_rate int, channels int, subtype string, samples array<array<double>>, error string"

    def decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [decode_wav(bytes(c)) for c in frame["content"]]
            yield pd.DataFrame(rows).assign(id=frame["id"].values)[["id", "digest", "sample_rate", "channels", "subtype", "samples", "error"]].astype({"sample_rate": "Int32", "channels": "Int32"})

    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(folder)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    named = files.select(F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("id"), "content")
    return named.mapInPandas(decoded, schema)


def read_latents(spark: SparkSession, path: str) -> DataFrame:
    """Shards of latents (Parquet with id, text and latent, an array of frames, as ``write_shards``
    leaves them): id, text (empty where there is none), latent, n_frames, ready for ``training.admitted``."""
    frames = F.coalesce(F.size(F.filter("latent", lambda x: x.isNotNull())), F.lit(0))
    return spark.read.parquet(path).select("id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "latent", frames.alias("n_frames"))
