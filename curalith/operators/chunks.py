"""Recordings of any length as chunks of samples: a row for each file, channel and chunk, so that no
row and no task grows with a recording's length.

A chunk table has id, sample_rate, channels, subtype, error, channel, chunk (from 0), start (the
place of its first sample) and samples.  All chunks of a recording but its last have one length, a
multiple of BLOCK.  A file that can't be read, or is empty, is one row without samples.

What crosses the chunks' borders is carried: frames that two chunks share are added up, filters get
their neighbours' nearest samples, digests are folded block by block.  So the results don't depend
on how a recording is cut."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curalith.functions import signal as S
from curalith.functions.text import decibels
from curalith.operators import validation
from curalith.operators.ranking import quantiles
from curalith.sources.tables import stored

#: Samples whose digest is taken at once.
BLOCK = 4096
CHUNKS = "id string, sample_rate int, channels int, subtype string, error string, channel int, chunk long, start long, samples array<double>"


def cut(audio: DataFrame, length: int) -> DataFrame:
    """Whole recordings (as ``read_wavs`` gives them: samples is an array for each channel) as chunks
    of ``length`` samples."""
    n = F.greatest(F.lit(1), F.ceil(F.size("one") / length)).cast("long")
    each = audio.select("id", "sample_rate", "channels", "subtype", "error", F.posexplode_outer("samples").alias("channel", "one"))
    parts = each.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1)) - 1)))
    return parts.withColumn("start", F.col("chunk") * length).select("id", "sample_rate", "channels", "subtype", "error", "channel", "chunk", "start", F.slice("one", (F.col("start") + 1).cast("int"), length).alias("samples"))


def mono(chunks: DataFrame) -> DataFrame:
    """Chunks of one channel, the mean of all; those of one channel aren't shuffled."""
    one, rest = chunks.filter("coalesce(channels, 1) <= 1"), chunks.filter("channels > 1")
    shared = ("sample_rate", "channels", "subtype", "error", "start")
    sides = F.array_sort(F.collect_list(F.struct("channel", "samples")))
    mixed = rest.groupBy("id", "chunk").agg(*[F.first(c).alias(c) for c in shared], F.transform(sides, lambda x: x["samples"]).alias("_all"))
    mixed = mixed.withColumn("samples", F.when(F.get("_all", F.lit(0)).isNotNull(), S.downmixed(F.col("_all")))).withColumn("channel", F.lit(0))
    return one.unionByName(mixed.select(one.columns))


def with_overlap(chunks: DataFrame, n: int) -> DataFrame:
    """Chunks with before and after, the nearest ``n`` samples on both sides (fewer at the ends of a
    recording).  Only these are sent to the neighbours; chunks must have ``n`` samples or be last."""
    key = ["id", "channel", "chunk"]
    tail = F.slice("samples", -F.least(F.lit(n), F.size("samples")), n)
    ends = chunks.filter(F.size("samples") > 0)
    before = ends.select("id", "channel", (F.col("chunk") + 1).alias("chunk"), tail.alias("before"))
    after = ends.filter("chunk > 0").select("id", "channel", (F.col("chunk") - 1).alias("chunk"), F.slice("samples", 1, n).alias("after"))
    none = F.array().cast("array<double>")
    return chunks.join(before, key, "left").join(after, key, "left").withColumns({c: F.coalesce(c, none) for c in ("before", "after")})


# -- levels ----------------------------------------------------------------------------------------

_PARTS = "id string, n long, peak double, clipped long, first_frame long, power array<double>, many array<int>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows' arrays and where each begins and ends."""
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return np.asarray(column.flatten(), np.float64), np.append(0, np.cumsum(sizes))


def _parts(clip_level: float):
    """Sums of each chunk: samples, peak, clipped ones, and the power of each frame's part in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = _flat(batch.column("samples"))
            out: list[tuple] = []
            for i, j, start, rate in zip(bounds[:-1], bounds[1:], batch.column("start").to_pylist(), batch.column("sample_rate").to_pylist(), strict=True):
                x = flat[i:j]
                if not len(x) or rate is None:
                    out.append((len(x), None, 0, 0, [], []))
                    continue
                step = max(1, int(S.FRAME_S * rate))
                first, last = start // step, (start + len(x) - 1) // step
                edges = np.maximum(np.arange(first, last + 1) * step - start, 0)
                out.append((len(x), float(np.abs(x).max()), int((np.abs(x) >= clip_level).sum()), first, np.add.reduceat(x * x, edges), np.diff(np.append(edges, len(x))).astype(np.int32)))
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32()))
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[c.split()[0] for c in _PARTS.split(", ")])

    return run


def parts(chunks: DataFrame, clip_level: float = 0.999) -> DataFrame:
    """Of each chunk of one channel what can be added up: see ``_parts``."""
    return chunks.select("id", "start", "sample_rate", "samples").mapInArrow(_parts(clip_level), _PARTS)


def levels(found: DataFrame, rates: DataFrame) -> DataFrame:
    """id, frame, level of each whole frame, from ``parts`` and each id's step.  Frames that lie in
    one chunk aren't shuffled."""
    each = found.join(rates, "id").select("id", "step", "first_frame", F.posexplode(F.arrays_zip("power", "many")).alias("k", "x"))
    rows = each.select("id", "step", (F.col("first_frame") + F.col("k")).alias("frame"), "x.power", "x.many")
    shared = rows.filter("many < step").groupBy("id", "frame", "step").agg(F.sum("power").alias("power"), F.sum("many").alias("many"))
    whole = rows.filter("many = step").unionByName(shared.filter("many = step"), allowMissingColumns=True)
    return whole.select("id", "frame", decibels(F.sqrt(F.col("power") / F.col("step"))).alias("level"))


# -- digests ---------------------------------------------------------------------------------------


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, bounds = _flat(batch.column("samples"))
        raw = memoryview(flat.astype("<f4").tobytes())
        out = [b"".join(sha256(raw[4 * k : 4 * min(k + BLOCK, j)]).digest() for k in range(i, j, BLOCK)) for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "channel", "chunk")] + [pa.array(out, pa.binary())], names=["id", "channel", "chunk", "blocks"])


def digests(chunks: DataFrame) -> DataFrame:
    """id, digest: a hash over the hashes of each channel's blocks of BLOCK samples (32-bit floats) in
    order, 32 bytes for each; null for recordings without samples."""
    blocks = chunks.filter(F.size("samples") > 0).select("id", "channel", "chunk", "samples").mapInArrow(_digested, "id string, channel int, chunk long, blocks binary")
    order = F.array_sort(F.collect_list(F.struct("channel", "chunk", F.hex("blocks").alias("blocks"))))
    return blocks.groupBy("id").agg(F.sha2(F.array_join(F.transform(order, lambda x: F.concat(F.when(x["chunk"] == 0, F.concat(x["channel"].cast("string"), F.lit(":"))).otherwise(""), x["blocks"])), ""), 256).alias("digest"))


# -- measures --------------------------------------------------------------------------------------


def sound(chunks: DataFrame, th: validation.Thresholds = validation.Thresholds()) -> DataFrame:
    """What ``validation.measures`` gives of whole recordings, of chunks (which are read twice)."""
    one = mono(chunks)
    heads = chunks.groupBy("id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("sample_rate", "channels", "subtype", "error")])
    step = F.greatest(F.lit(1), F.floor(F.lit(S.FRAME_S) * F.col("sample_rate"))).cast("int")
    found = stored(parts(one, th.clip_level), "chunks")
    sums = found.groupBy("id").agg(F.sum("n").alias("n_samples"), F.max("peak").alias("peak"), (F.sum("clipped") / F.nullif(F.sum("n"), F.lit(0))).alias("clipped"))
    every = stored(levels(found, heads.select("id", step.alias("step"))), "levels")
    loudest = every.groupBy("id").agg(F.max("level").alias("loudest"), F.count("*").alias("n_frames"))
    spoken = every.join(loudest.filter(F.col("loudest") >= th.no_speech_dbfs), "id")
    edges = spoken.filter(F.col("level") > F.col("loudest") + th.silence_rel_db).groupBy("id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    beside = spoken.join(edges, "id").withColumn("speech", F.col("frame").between(F.col("first"), F.col("last")))
    kinds = F.array(F.lit("all"), F.when(F.col("speech"), "speech").otherwise("edge"))
    noise = quantiles(beside.select("id", "level", F.explode(kinds).alias("kind")), ["id", "kind"], "level", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    noise = noise.groupBy("id").agg(of("speech", "p90").alias("_s"), of("edge", "p50").alias("_e"), of("edge", "n").alias("_n"), of("all", "p10").alias("_r"))
    noise = noise.select("id", F.when(F.col("_n") >= 5, F.col("_s") - F.col("_e")).alias("snr"), (F.col("_s") - F.col("_r")).alias("rough"))
    rows = heads.withColumnRenamed("error", "unread").join(sums, "id", "left").join(loudest, "id", "left").join(edges, "id", "left").join(noise, "id", "left").join(digests(chunks), "id", "left")
    readable = F.col("unread").isNull()
    rows = rows.withColumns({c: F.when(readable, F.coalesce(c, F.lit(0)).cast("int")) for c in ("n_samples", "n_frames")})
    return validation.reported(rows).select("id", "digest", "unread", "sample_rate", "channels", "subtype", *validation.SOUND)


def end_levels(chunks: DataFrame, window_s: float = 0.03) -> DataFrame:
    """id, end_db: the level of each recording's last ``window_s`` against its peak, -200 for silence."""
    one = mono(chunks).filter(F.size("samples") > 0)
    whole = one.groupBy("id").agg(F.max(F.col("start") + F.size("samples")).alias("_n"), F.max(S.peak(F.col("samples"))).alias("_peak"))
    window = F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.lit(window_s) * F.col("sample_rate"))))
    inside = one.join(whole, "id").withColumn("_window", window).withColumn("_left", (F.col("_n") - F.col("_window") - F.col("start")).cast("int")).filter(F.col("_left") < F.size("samples"))
    tail = F.slice("samples", F.greatest(F.col("_left"), F.lit(0)) + 1, F.size("samples"))
    power = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x * x)
    level = F.sqrt(F.sum(power) / F.first("_window")) / F.first("_peak")
    return inside.groupBy("id").agg(F.when(F.first("_peak") > 0, decibels(level)).otherwise(-200.0).alias("end_db"))


# -- resampling ------------------------------------------------------------------------------------

#: Zero crossings of the kernel on each side, and the share of the band that passes.
ZEROS, PASSING = 48, 0.94


def kernel(up: int, down: int, zeros: int = ZEROS) -> np.ndarray:
    """The taps of each of ``up`` phases: a sinc that lets PASSING of the narrower band pass, under a
    Blackman-Harris window.  Phase p, tap k weighs the sample k - half places after floor(p * down / up)."""
    cutoff = PASSING * min(1.0, up / down)
    half = reach(up, down, zeros)
    at = np.arange(-half, half + 1) - ((np.arange(up) * down) % up)[:, None] / up
    window = sum(c * np.cos(k * np.pi * at / (half + 1)) for k, c in enumerate((0.35875, 0.48829, 0.14128, 0.01168)))
    return cutoff * np.sinc(cutoff * at) * np.where(np.abs(at) < half + 1, window, 0.0)


def reach(up: int, down: int, zeros: int = ZEROS) -> int:
    """How many samples on each side a sample of the new rate is made of."""
    return int(np.ceil(zeros / min(1.0, up / down)))


def _resampled(rate: int, zeros: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernels: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            (flat, at), (left, left_at), (right, right_at) = (_flat(batch.column(c)) for c in ("samples", "before", "after"))
            out, starts = [], []
            for k, (old, start) in enumerate(zip(batch.column("sample_rate").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                x = flat[at[k] : at[k + 1]]
                if not len(x) or not old:
                    out.append(x)
                    starts.append(start)
                    continue
                up, down = rate // gcd(rate, old), old // gcd(rate, old)
                taps, half = kernels.setdefault((up, down), kernel(up, down, zeros)), reach(up, down, zeros)
                before, after = left[left_at[k] : left_at[k + 1]][-half:], right[right_at[k] : right_at[k + 1]][:half]
                padded = np.concatenate([np.zeros(half - len(before)), before, x, after, np.zeros(half - len(after))])
                first, last = -(-start * up // down), -(-(start + len(x)) * up // down)  # those whose place lies in this chunk
                m = np.arange(first, last)
                y, phase, place = np.zeros(len(m)), m % up, m * down // up - start
                for p in np.unique(phase):
                    own = np.flatnonzero(phase == p)
                    for lo in range(0, len(own), 4096):
                        some = own[lo : lo + 4096]
                        y[some] = padded[place[some][:, None] + np.arange(2 * half + 1)] @ taps[p]
                out.append(y)
                starts.append(first)
            columns = {"sample_rate": pa.array([rate if r else r for r in batch.column("sample_rate").to_pylist()], pa.int32()), "start": pa.array(starts, pa.int64()), "samples": pa.array(out, pa.list_(pa.float64()))}
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([columns.get(c, batch.column(c) if c not in columns else None) for c in names], names=names)

    return run


def resampled(chunks: DataFrame, rate: int, zeros: int = ZEROS) -> DataFrame:
    """``chunks`` at ``rate`` samples a second.  Each chunk makes the samples that fall into it, with
    what its neighbours lend it; chunks must be longer than the kernel's reach (``zeros`` zero
    crossings on each side), or be a recording's only one."""
    rates = [r.sample_rate for r in chunks.select("sample_rate").filter("sample_rate > 0").distinct().collect()]  # a few
    lent = with_overlap(chunks, max((reach(rate // gcd(rate, r), r // gcd(rate, r), zeros) for r in rates), default=1))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return lent.select(*names, "before", "after").mapInArrow(_resampled(rate, zeros), CHUNKS)


def joined(chunks: DataFrame) -> DataFrame:
    """id, samples of recordings that are short enough for a row: their chunks put together again."""
    parts_ = F.array_sort(F.collect_list(F.struct("channel", "chunk", "samples")))
    return chunks.filter(F.size("samples") > 0).groupBy("id").agg(F.flatten(F.transform(parts_, lambda x: x["samples"])).alias("samples"))
