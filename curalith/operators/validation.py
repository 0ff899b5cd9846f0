"""Rules for transcripts and audio, and the summaries of their messages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from curalith.functions import signal as S
from curalith.functions.text import MOJIBAKE, fixed, let, letters, message_type, rounded, unmappable
from curalith.operators.duplicates import first_occurrence
from curalith.operators.leak import leaks
from curalith.operators.ranking import quantiles
from curalith.sources.tables import spread


@dataclass(frozen=True)
class Thresholds:
    """The limits of the audio rules."""

    sample_rate: int = 48_000
    min_sample_rate: int = 22_050
    min_duration_s: float = 0.5
    max_duration_s: float = 14.0
    clip_level: float = 0.999
    max_clipped: float = 0.001
    min_peak_dbfs: float = -20.0
    silence_rel_db: float = -40.0
    no_speech_dbfs: float = -50.0
    max_edge_s: float = 1.0
    min_edge_s: float = 0.02
    min_snr_db: float = 30.0
    min_rate: float = 5.0
    max_rate: float = 25.0


def messages(*rules: tuple[Column, str | Column]) -> Column:
    """The texts of the rules whose condition holds, in order."""
    found = [F.when(condition, text if isinstance(text, Column) else F.lit(text)) for condition, text in rules]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


_EMPTY = "empty transcript"


def text_errors(text: Column, vocabulary: str, leak: Column | None = None) -> Column:
    """An empty text, or else every other fault: wrong decoding, characters outside, a leak.  Each
    fault is looked for once."""

    def found(x: Column) -> Column:
        rules = ("marks", "encoding problem in transcript: "), ("outside", "unmappable characters: ")
        return messages(*[(F.size(x[k]) > 0, F.concat(F.lit(said), F.array_join(x[k], " "))) for k, said in rules])

    marks = F.filter(F.array(*[F.lit(m) for m in MOJIBAKE]), lambda m: F.contains(text, m))
    faults = let(F.struct(marks.alias("marks"), unmappable(text, vocabulary).alias("outside")), found)
    errors = F.when(F.coalesce(text, F.lit("")) == "", F.array(F.lit(_EMPTY))).otherwise(faults)
    return errors if leak is None else let(errors, lambda e: with_leak(e, leak))


def with_leak(errors: Column, leak: Column) -> Column:
    """The ``text_errors`` of a text and behind them its leak, which an empty text never has."""
    return F.when(leak.isNull() | F.array_contains(errors, _EMPTY), errors).otherwise(F.concat(errors, F.array(F.concat(F.lit("evaluation-set leakage: "), leak))))


#: What is measured of a recording's sound: columns of ``sound`` and of ``chunks.sound``.
SOUND = ("n_samples", "n_frames", "duration_s", "clipped", "peak_dbfs", "loudest", "leading_s", "trailing_s", "snr_db", "rough_snr_db", "speech_s")


def sound(audio: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """``audio`` (samples of one channel, sample_rate) with the measures of SOUND in their place,
    rounded as they are reported."""
    samples = F.col("samples")
    df = audio.withColumns({"levels": S.frame_levels(samples, S.hop(F.col("sample_rate"))), "n_samples": F.size(samples)})
    df = df.withColumns({"clipped": S.clipped_fraction(samples, th.clip_level), "peak": S.peak(samples), "n_frames": F.size("levels"), "loudest": F.array_max("levels")})
    edge = F.when(F.col("loudest") >= th.no_speech_dbfs, S.voiced_edges(F.col("levels"), -th.silence_rel_db))
    df = df.withColumn("edge", edge)
    noise = F.when(F.col("edge").isNotNull(), S.noise_ratio(F.col("levels"), F.col("edge.first"), F.col("edge.last")))
    df = df.withColumn("noise", noise).withColumns({"first": F.col("edge.first"), "last": F.col("edge.last"), "snr": F.col("noise.snr"), "rough": F.col("noise.rough")})
    return reported(df).drop("samples", "levels", "peak", "edge", "noise", "first", "last", "snr", "rough")


def reported(df: DataFrame) -> DataFrame:
    """Measures as they are reported: from n_samples, n_frames, peak, first and last (places of the
    edges' frames), snr and rough."""
    speech = (F.col("last") - F.col("first") + 1) * S.FRAME_S
    return df.withColumns({
        "duration_s": rounded(F.col("n_samples") / F.nullif(F.col("sample_rate"), F.lit(0)), 3), "peak_dbfs": rounded(S.decibels(F.col("peak")), 1),
        "leading_s": rounded(F.col("first") * S.FRAME_S, 2), "trailing_s": rounded((F.col("n_frames") - 1 - F.col("last")) * S.FRAME_S, 2),
        "snr_db": rounded(F.col("snr"), 1), "rough_snr_db": rounded(F.col("rough"), 1), "speech_s": speech,
    })


def with_rate(rows: DataFrame) -> DataFrame:
    """Rows (text, speech_s) with letters_per_s; null without a text or speech."""
    return rows.withColumn("letters_per_s", rounded(F.when(F.col("text") != "", letters(F.col("text")) / F.col("speech_s")), 1))


def measured(audio: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """``audio`` (samples of one channel, sample_rate, text) with its measures and speaking rate."""
    return with_rate(sound(audio, th))


def audio_messages(m: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """``measured`` rows (with channels and subtype) with errors and warnings.  Empty audio has that
    error alone; audio shorter than a frame isn't looked at further."""
    c = F.col
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    some, speech, seconds = c("n_samples") > 0, c("speech_s").isNotNull(), fixed(c("duration_s"), 2)
    rate, snr = c("sample_rate").cast("string"), lambda name: fixed(c(name), 1)

    def edge(name):
        value = c(f"{name}_s")
        return [(speech & (value > th.max_edge_s), said(f"long {name} silence: ", fixed(value, 2), "s")), (speech & (value < th.min_edge_s), f"no {name} silence: speech may be cut off")]

    errors = messages(
        (~some, "empty audio (0 samples)"),
        (some & (c("sample_rate") < th.min_sample_rate), said("low sample rate: ", rate, f" Hz < {th.min_sample_rate} Hz")),
        (some & (c("duration_s") < th.min_duration_s), said("too short: ", seconds, f"s < {th.min_duration_s}s")),
        (some & (c("duration_s") > th.max_duration_s), said("too long: ", seconds, f"s > {th.max_duration_s}s")),
        (some & (c("clipped") > th.max_clipped), said("clipping: ", fixed(c("clipped") * 100, 2), "% of samples at full scale")),
        (some & (c("n_frames") == 0), "too short: shorter than one analysis frame"),
        (c("loudest") < th.no_speech_dbfs, said("no speech detected: loudest frame ", fixed(c("loudest"), 1), " dBFS")),
    )
    warnings = messages(
        (some & (c("sample_rate") >= th.min_sample_rate) & (c("sample_rate") != th.sample_rate), said("sample rate: ", rate, f" Hz (expected {th.sample_rate})")),
        (some & (c("channels") != 1), said("channels: ", c("channels").cast("string"), " (expected mono; will be downmixed)")),
        (some & ~c("subtype").isin("PCM_24", "PCM_32", "FLOAT", "DOUBLE"), said("bit depth: ", c("subtype"), " (24-bit recommended)")),
        (speech & (c("peak_dbfs") < th.min_peak_dbfs), said("low level: peak ", snr("peak_dbfs"), " dBFS")), *edge("leading"), *edge("trailing"),
        (c("snr_db") < th.min_snr_db, said("low estimated SNR: ", snr("snr_db"), " dB")),
        (c("snr_db").isNull() & (c("rough_snr_db") < th.min_snr_db), said("low estimated SNR: ~", snr("rough_snr_db"), " dB (no silent edges; rough estimate)")),
        (~c("letters_per_s").between(th.min_rate, th.max_rate), said("speaking rate: ", snr("letters_per_s"), f" letters/s outside {th.min_rate}-{th.max_rate}: transcript may not match audio")),
    )
    return m.withColumns({"errors": errors, "warnings": warnings})


def measures(audio: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """id, digest, unread, sample_rate, channels, subtype and SOUND of each file of ``audio`` (as
    ``read_wavs`` gives it): all that is ever asked of its samples."""
    mono = lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(S.downmixed(x))
    rows = audio.withColumnRenamed("error", "unread").withColumn("samples", F.when(F.col("unread").isNull(), mono(F.col("samples"))))
    return sound(rows, th).select("id", "digest", "unread", "sample_rate", "channels", "subtype", *SOUND)


def validate(script: DataFrame, audio: DataFrame, evaluation: DataFrame, vocabulary: str, th: Thresholds = Thresholds(), prepare=None) -> DataFrame:
    """A record for each audio file: ``script`` (id, text, pos), ``audio`` (as ``read_wavs`` gives it)
    and ``evaluation`` (text) -> id, text, its measures, errors, warnings, accepted.  Files that the
    script doesn't name come last.  ``prepare`` is applied to texts before leaks are sought."""
    return records(script, measures(audio, th), evaluation, vocabulary, th, prepare)


def records(script: DataFrame, measured_files: DataFrame, evaluation: DataFrame, vocabulary: str, th: Thresholds = Thresholds(), prepare=None) -> DataFrame:
    """The same from files that are ``measures``d already.  They are read several times, so store
    them first where their samples are far away (``dataset.validated`` does)."""
    c = F.col
    named = script.select("id", F.coalesce("text", F.lit("")).alias("text"), c("pos").cast("long").alias("pos"), F.lit(True).alias("listed"))
    rows = measured_files.join(named, "id", "left").withColumns({"text": F.coalesce("text", F.lit("")), "listed": c("listed").isNotNull()})
    rows = rows.withColumn("turn", F.struct((~c("listed")).alias("last"), "pos", "id"))
    rows = audio_messages(with_rate(rows), th).withColumnsRenamed({"errors": "heard", "warnings": "noticed"})
    leaking = leaks(named.select(c("id").alias("doc_id"), "text"), evaluation, prepare=prepare).select(c("doc_id").alias("id"), c("reason").alias("leak"))
    rows = rows.join(leaking, "id", "left")
    rows = first_occurrence(rows, c("digest"), "turn", "id").withColumnRenamed("first_id", "same_audio")
    spoken = F.when(c("listed") & (c("text") != ""), F.lower("text"))
    rows = first_occurrence(rows, spoken, "turn", "id").withColumnRenamed("first_id", "same_text")
    text = F.when(~c("listed"), F.array(F.lit("no transcript for this audio file (id not in script)"))).otherwise(text_errors(c("text"), vocabulary, c("leak")))
    heard = F.when(c("unread").isNotNull(), F.array("unread")).otherwise(c("heard"))
    again = messages((c("same_audio").isNotNull(), F.concat(F.lit("duplicate audio: same samples as "), "same_audio")))
    noticed = F.when(c("unread").isNull(), c("noticed")).otherwise(F.array().cast("array<string>"))
    repeated = messages((c("same_text").isNotNull(), F.concat(F.lit("same transcript: as "), "same_text")))
    rows = rows.withColumns({"errors": F.concat(text, heard, again), "warnings": F.concat(noticed, repeated)})
    shown = ("sample_rate", "channels", "subtype", "duration_s", "peak_dbfs", "leading_s", "trailing_s", "snr_db", "letters_per_s")
    return rows.select("id", "text", *shown, "errors", "warnings", (F.size("errors") == 0).alias("accepted"))


def observed(rows: DataFrame, name: str = "validation") -> tuple[DataFrame, Observation]:
    """Records that are counted while they are written: the counts of audio_files, accepted,
    rejected and with_warnings come from the same run."""
    watch, taken = Observation(name), F.col("accepted")
    counts = {"audio_files": F.count("*"), "accepted": F.count_if(taken), "rejected": F.count_if(~taken), "with_warnings": F.count_if(taken & (F.size("warnings") > 0))}
    return rows.observe(watch, *[x.alias(k) for k, x in counts.items()]), watch


def counters(records: DataFrame) -> DataFrame:
    """kind, value, n: how many records have each sample rate, number of channels and subtype; missing
    values and zeros don't count."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("sample_rate", "channels", "subtype")]
    rows = records.select(F.explode(F.array(*kinds)).alias("x")).select("x.kind", "x.value").filter("value IS NOT NULL AND value NOT IN ('', '0')")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))


def message_counts(records: DataFrame) -> DataFrame:
    """kind, type, n: errors over the rejected records, warnings over all."""
    said = lambda kind: F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), message_type(m).alias("type")))
    return records.select(F.explode(F.concat(said("errors"), said("warnings"))).alias("x")).groupBy("x.kind", "x.type").agg(F.count("*").alias("n"))


def summary(script: DataFrame, records: DataFrame, letters_shown: str = "çğıöşü") -> dict:
    """The summary of ``validate``'s records, a nested dictionary of a few numbers.  The records are
    read for the counts, for the durations, and for the letters of the accepted ones."""
    ids = script.select("id").distinct().join(records.select("id").distinct().withColumn("found", F.lit(True)), "id", "left")
    entries = ids.agg(F.count("*").alias("n"), F.count_if(F.col("found").isNull()).alias("missing")).first()
    long = records.filter("duration_s <> 0").select(F.explode(F.array(F.lit("all_audio"), F.when(F.col("accepted"), "accepted_audio"))).alias("which"), "duration_s").filter("which IS NOT NULL")
    lengths = {r.which: r for r in long.groupBy("which").agg((F.sum("duration_s") / 60).alias("total_min"), F.avg("duration_s").alias("mean_s"), F.min("duration_s").alias("min_s"), F.max("duration_s").alias("max_s")).join(quantiles(long, ["which"], "duration_s", {"median_s": 0.5}), "which").collect()}
    marks = [F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("sample_rate", "channels", "subtype")]
    heads = [F.struct(F.lit("head").alias("kind"), F.when(x, k).alias("value")) for k, x in (("audio_files", F.lit(True)), ("accepted", F.col("accepted")), ("with_warnings", F.col("accepted") & (F.size("warnings") > 0)))]
    typed = lambda kind: F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), message_type(m).alias("value")))
    counted = records.select(F.explode(F.concat(F.array(*heads, *marks), typed("errors"), typed("warnings"))).alias("x")).filter("x.value IS NOT NULL AND x.value NOT IN ('', '0')").groupBy("x.kind", "x.value").count().collect()
    of = lambda kind: dict(sorted((r.value, r["count"]) for r in counted if r.kind == kind))
    head = {"audio_files": 0, "accepted": 0, "with_warnings": 0} | of("head")
    shown = lambda r: {"n": r.n} | {k: round(r[k], 2) for k in ("total_min", "mean_s", "median_s", "min_s", "max_s")}
    out = {"script_entries": entries.n, "audio_files": head["audio_files"], "missing_audio": entries.missing, "accepted": head["accepted"], "rejected": head["audio_files"] - head["accepted"], "with_warnings": head["with_warnings"]}
    out |= {k: shown(lengths[k]) if k in lengths else {"n": 0} for k in ("all_audio", "accepted_audio")}
    out |= {"sample_rates": of("sample_rate"), "channels": of("channels"), "subtypes": of("subtype"), "error_types": of("errors"), "warning_types": of("warnings")}
    return out | {"letter_counts": {r.letter: r.n for r in letter_counts(records.filter("accepted"), letters_shown).collect()}}


def duration_stats(rows: DataFrame, column: str) -> DataFrame:
    """Count, total, mean, median, least and most of the values that are neither null nor 0."""
    kept = rows.filter(F.col(column) != 0)
    one = kept.agg(F.count("*").alias("n"), (F.sum(column) / 60).alias("total_min"), F.avg(column).alias("mean_s"), F.min(column).alias("min_s"), F.max(column).alias("max_s"))
    return one.join(quantiles(kept, [], column, {"median_s": 0.5}), "n", "left").select("n", "total_min", "mean_s", "median_s", "min_s", "max_s")


def _bytes(column: pa.Array) -> bytes:
    """The bytes of all texts, one after the other."""
    column = pa.compute.fill_null(column, "")
    wide = "q" if pa.types.is_large_string(column.type) else "i"
    at = memoryview(column.buffers()[1]).cast("B").cast(wide)
    data = column.buffers()[2]
    return memoryview(data)[at[column.offset] : at[column.offset + len(column)]].tobytes() if data is not None and len(column) else b""


def letter_counts(texts: DataFrame, alphabet: str) -> DataFrame:
    """letter, n for each letter of ``alphabet`` (0 where it doesn't occur).  UTF-8 letters can't be
    found across characters, so each batch of texts is looked through as one run of bytes."""
    shown = list(dict.fromkeys(alphabet))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _bytes(batch.column("t"))
            yield pa.RecordBatch.from_arrays([pa.array(shown), pa.array([raw.count(c.encode()) for c in shown], pa.int64())], names=["letter", "n"])

    found = spread(texts.select(F.lower("text").alias("t"))).mapInArrow(counted, "letter string, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    every = texts.sparkSession.createDataFrame([(c,) for c in shown], "letter string")
    return every.join(found, "letter", "left").select("letter", F.coalesce("n", F.lit(0)).alias("n"))


def read_seconds(text: Column) -> Column:
    """How long a sentence takes to read: 14 characters a second and 0.35 s for each comma."""
    return F.length(text) / 14.0 + 0.35 * (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))))


def too_long_to_read(text: Column, limit: float = 14.0) -> Column:
    """Whether a sentence's estimated length is over the limit."""
    return read_seconds(text) > limit
