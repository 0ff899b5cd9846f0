"""Choice of takes, consistency of a voice, and the summaries of a generation log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curalith.functions.text import message_type, rounded, semitones
from curalith.operators.ranking import exact_median, quantiles
from curalith.operators.validation import messages


@dataclass(frozen=True)
class TakeThresholds:
    """When a take passes, and when a clip fits the voice."""

    min_voiced_ratio: float = 0.5
    min_opening_hz: float = 200.0
    min_pitch_hz: float = 180.0
    min_duration_s: float = 0.5
    max_duration_s: float = 14.0
    min_rate: float = 5.0
    max_rate: float = 25.0
    max_clipped: float = 0.001
    consistency_st: float = 2.0
    max_end_db: float = -40.0


def take_reasons(th: TakeThresholds = TakeThresholds()) -> Column:
    """The codes of the failed checks of a take (voiced_ratio, opening_hz, min_f0_hz, duration_s,
    letters_per_s, clipped_fraction)."""
    c = F.col
    return messages(
        (c("min_f0_hz").isNull() | (F.coalesce("voiced_ratio", F.lit(0.0)) < th.min_voiced_ratio), "unvoiced"), (c("opening_hz") < th.min_opening_hz, "low_opening"), (c("min_f0_hz") < th.min_pitch_hz, "low_pitch"),
        (~c("duration_s").between(th.min_duration_s, th.max_duration_s), "duration"), (~F.coalesce(c("letters_per_s").between(th.min_rate, th.max_rate), F.lit(False)), "speaking_rate"), (c("clipped_fraction") > th.max_clipped, "clipped"),
    )


def choose_take(takes: DataFrame, clip: str, attempt: str) -> DataFrame:
    """Of each clip's takes (reasons, min_f0_hz) the first that passes, else the one with the fewest
    failed checks, then the highest lowest pitch, then the earliest; attempts counts the takes used."""
    passed = F.size("reasons") == 0
    best = F.struct((~passed).alias("failed"), F.when(passed, F.col(attempt)).otherwise(0).alias("first"), F.size("reasons").alias("faults"), (-F.coalesce("min_f0_hz", F.lit(0.0))).alias("low"), F.col(attempt).alias("attempt"))
    chosen = takes.groupBy(clip).agg(F.min_by(F.struct(*takes.columns), best).alias("t"), F.count("*").alias("n"))
    accepted = F.size("t.reasons") == 0
    return chosen.select(*[F.col(f"t.{c}") for c in takes.columns], F.when(accepted, F.col(f"t.{attempt}").cast("long")).otherwise(F.col("n")).alias("attempts"), F.when(accepted, "accepted").otherwise("rejected").alias("status"))


def choose_by_floor(takes: DataFrame, clip: str, attempt: str, floor_hz: float = 180.0) -> DataFrame:
    """The first take with a floor of at least ``floor_hz``, else the highest floor (earliest of
    ties); a floor of 0 is reported as null."""
    good = F.col("floor") >= floor_hz
    best = F.struct((~good).alias("failed"), F.when(good, F.lit(0.0)).otherwise(-F.col("floor")).alias("low"), F.col(attempt).alias("attempt"))
    chosen = takes.groupBy(clip).agg(F.min_by(F.struct("floor", attempt), best).alias("t"))
    return chosen.select(clip, F.col(f"t.{attempt}").alias(attempt), F.nullif("t.floor", F.lit(0.0)).alias("min_f0_hz"))


def voice_median(log: DataFrame) -> float | None:
    """The median pitch of all accepted rows."""
    return exact_median(log.filter("status = 'accepted'"), "median_f0_hz")


def judged(log: DataFrame, voice: float | None, th: TakeThresholds = TakeThresholds()) -> DataFrame:
    """Rows of ``log`` (status, median_f0_hz, end_db) with f0_dev_st against the pitch ``voice`` and
    verdict: rejected, or for accepted rows kept, inconsistent or end_cut (a null end_db is no cut)."""
    accepted, dev = F.col("status") == "accepted", F.col("f0_dev_st")
    verdict = F.when(~F.coalesce(accepted, F.lit(False)), "rejected").when(F.abs(dev) > th.consistency_st, "inconsistent").when(F.col("end_db") > th.max_end_db, "end_cut").otherwise("kept")
    return log.withColumn("f0_dev_st", F.when(accepted, semitones(F.col("median_f0_hz"), F.lit(voice).cast("double")))).withColumn("verdict", verdict)


def finalize(log: DataFrame, th: TakeThresholds = TakeThresholds()) -> DataFrame:
    """The accepted rows of ``log`` as ``judged`` against the median of all accepted."""
    return judged(log, voice_median(log), th).filter("status = 'accepted'")


def kept_script(verdicts: DataFrame) -> DataFrame:
    """The script of the kept clips: id, category, source, source_id, train_text."""
    return verdicts.filter("verdict = 'kept'").select(F.col("clip_id").alias("id"), "category", "source", "source_id", F.col("text").alias("train_text"))


def summary(log: DataFrame, th: TakeThresholds = TakeThresholds()) -> DataFrame:
    """part, name, value: what became of a generation log (clip_id, source, category, status, reasons,
    scale, attempts, duration_s, compute_s, median_f0_hz, min_f0_hz, max_drop_st, end_db).

    Each row gives its share of every number; the shares are added up before anything is shuffled,
    so the log is read once for them, and for the medians besides."""
    voice = voice_median(log)
    rows = judged(log, voice, th)
    kept = F.col("verdict") == "kept"
    audio = F.when(kept, F.col("duration_s"))

    def share(part, name, value):
        return F.struct(F.lit(part).alias("part"), (F.lit(name) if isinstance(name, str) else name.cast("string")).alias("name"), value.cast("double").alias("value"))

    one = lambda condition: F.when(condition, 1.0)
    shares = [
        share("total", "clips_total", F.lit(1.0)), share("total", "accepted_by_generation", one(F.col("status") == "accepted")), share("total", "excluded_by_consistency", one(F.col("verdict") == "inconsistent")),
        share("total", "excluded_by_end_cut", one(F.col("verdict") == "end_cut")), share("total", "kept", one(kept)), share("total", "kept_s", audio), share("total", "compute_s", F.col("compute_s")),
        share("source_clips", F.col("source"), F.lit(1.0)), share("source_kept", F.col("source"), one(kept)), share("source_kept_minutes", F.col("source"), audio / 60),
        *[share(f"{c}_of_kept", F.col(c), one(kept)) for c in ("category", "scale", "attempts")],
    ]
    added = rows.select(F.explode(F.array(*shares)).alias("x")).select("x.*").groupBy("part", "name").agg(F.sum("value").alias("value"))
    added = added.filter(~(F.col("part").endswith("_of_kept") & F.col("value").isNull())).withColumn("value", F.coalesce("value", F.lit(0.0)))
    added = added.withColumn("value", F.when(F.col("part") == "source_kept_minutes", rounded(F.col("value"), 2)).otherwise(F.col("value")))
    total = {r.name: r.value for r in added.filter("part = 'total'").collect()}
    clips, n, seconds = (total.get(k, 0.0) for k in ("clips_total", "kept", "kept_s"))
    compute = total.get("compute_s", 0.0)
    found = [("total", "kept_ratio", round(n / clips, 3) if clips else 0.0), ("total", "kept_minutes", round(seconds / 60, 2)), ("total", "compute_hours", round(compute / 3600, 3)), ("total", "voice_median_f0_hz", round(voice, 1) if voice is not None else None), ("total", "compute_s_per_kept_audio_s", round(compute / seconds, 2) if seconds else None)]
    for part, some, column in (("min_f0_hz_kept", kept, "min_f0_hz"), ("min_f0_hz_rejected", F.col("status") == "rejected", "min_f0_hz"), ("max_drop_st_kept", kept, "max_drop_st")):
        t = stat_triple(rows.filter(some), column).first()
        found += [(part, "n", float(t.n))] + ([(part, "median", round(t.median, 2)), (part, "max", round(float(t.max), 2))] if t.n else [])
    reasons = reason_counts(log).select(F.lit("reject_reasons").alias("part"), F.col("reason").alias("name"), F.col("n").cast("double").alias("value"))
    derived = log.sparkSession.createDataFrame(found, "part string, name string, value double")
    return added.filter("name IS NULL OR name NOT IN ('kept_s', 'compute_s') OR part <> 'total'").unionByName(derived).unionByName(reasons)


def kept_by_source(log: DataFrame, kept: Column) -> DataFrame:
    """source, clips, kept, kept_ratio, kept_minutes."""
    return log.groupBy("source").agg(F.count("*").alias("clips"), F.count_if(kept).alias("kept"), F.sum(F.when(kept, F.col("duration_s")).otherwise(0.0)).alias("_s")).select("source", "clips", "kept", (F.col("kept") / F.col("clips")).alias("kept_ratio"), (F.col("_s") / 60).alias("kept_minutes"))


def reason_counts(log: DataFrame) -> DataFrame:
    """reason, n over the rejected rows' "; "-joined reasons, most common first."""
    each = log.filter("status = 'rejected'").select(F.explode(F.split("reasons", "; ")).alias("r")).filter("r <> ''")
    return each.groupBy(message_type(F.col("r")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias(column)).agg(F.count("*").alias("n")).orderBy(column)


def stat_triple(rows: DataFrame, column: str) -> DataFrame:
    """n, median and max of a column's values that aren't null."""
    one = rows.agg(F.count(column).alias("n"), F.max(column).alias("max"))
    return one.join(quantiles(rows, [], column, {"median": 0.5}), "n", "left").select("n", "median", "max")


def compute_ratio(rows: DataFrame, kept: Column) -> DataFrame:
    """Compute time of all rows over the audio time of the kept ones; null without any."""
    return rows.agg(F.try_divide(F.sum("compute_s"), F.sum(F.when(kept, F.col("duration_s")).otherwise(0.0))).alias("compute_per_audio"))
