"""A dataset from its files to its splits: validation with its report, and splits that are guarded
against evaluation leaks and published whole.

The samples are read once: what is measured of them is written down, and everything after reads
that table.  The counts that guard the flow are observed while the records are written."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curalith.functions.text import relative_path
from curalith.operators import validation
from curalith.operators.leak import leaks
from curalith.operators.split import assign_splits
from curalith.sources.publish import publish
from curalith.sources.tables import stored, write_small
from curalith.sources.writers import text_report, write_manifests


@dataclass
class Validated:
    """The records of a dataset (a stored table), what was counted while they were written, and the
    ids of the script that have no file."""

    script: DataFrame
    records: DataFrame
    counts: dict[str, int]
    thresholds: validation.Thresholds
    missing: DataFrame = field(init=False)

    def __post_init__(self):
        self.missing = self.script.select("id").distinct().join(self.records.select("id"), "id", "left_anti")

    def summary(self) -> dict:
        return validation.summary(self.script, self.records)


def validated(script: DataFrame, audio: DataFrame, evaluation: DataFrame, vocabulary: str, th: validation.Thresholds = validation.Thresholds(), prepare=None) -> Validated:
    """Validates ``audio`` (as ``read_wavs`` gives it, or files that are measured already, as
    ``chunks.sound`` gives them) against ``script`` and ``evaluation``; its samples are read once."""
    measured = stored(audio if "n_samples" in audio.columns else validation.measures(audio, th), "measures")
    rows, counts = validation.observed(validation.records(script, measured, evaluation, vocabulary, th, prepare))
    return Validated(script, stored(rows, "records"), counts.get, th)


# -- the report ------------------------------------------------------------------------------------

_STATS = (("all_audio", "All audio"), ("accepted_audio", "Accepted audio"))
_COUNTS = (("script_entries", "Script entries"), ("audio_files", "Audio files"), ("missing_audio", "Missing audio"), ("accepted", "Accepted for training"), ("rejected", "Rejected"))


def report_sections(found: dict) -> dict[str, list[str]]:
    """The lines of a ``summary``, under their headings."""
    lines = [f"{label}: {found[k]}" + (f" ({found['with_warnings']} with warnings)" if k == "accepted" else "") for k, label in _COUNTS]
    lines += [f"{label}: {x['total_min']} min, mean {x['mean_s']}s, median {x['median_s']}s, min {x['min_s']}s, max {x['max_s']}s" for k, label in _STATS if (x := found[k])["n"]]
    lines += [f"{label}: " + ", ".join(f"{v} {n}" for v, n in found[k].items()) for k, label in (("sample_rates", "Sample rates"), ("channels", "Channels"), ("subtypes", "Bit depth"), ("letter_counts", "Letters"))]
    types = {title: [f"{k}: {n}" for k, n in sorted(found[key].items())] for title, key in (("ERROR TYPES (records excluded from training)", "error_types"), ("WARNING TYPES (records kept)", "warning_types"))}
    return {"SUMMARY": lines} | types


def record_lines(done: Validated) -> DataFrame:
    """section, id, line: the report's rejected records, those with warnings, and missing ids, of
    which there may be any number."""
    records, line = done.records, lambda kind: F.concat("id", F.lit(": "), F.array_join(kind, "; "))
    rejected = records.filter(~F.col("accepted")).select(F.lit("rejected").alias("section"), "id", line("errors").alias("line"))
    warned = records.filter(F.col("accepted") & (F.size("warnings") > 0)).select(F.lit("warned").alias("section"), "id", line("warnings").alias("line"))
    return rejected.unionByName(warned).unionByName(done.missing.select(F.lit("missing").alias("section"), "id", F.col("id").alias("line")))


def write_report(done: Validated, folder: str) -> None:
    """Publishes the report at ``folder``: report.txt and summary.json, which are of few lines, and
    the records' lines as text files for each section, ordered by id, and the records as JSON lines."""
    spark, found = done.records.sparkSession, done.summary()

    def write(to: str) -> None:
        record_lines(done).repartitionByRange("section", "id").sortWithinPartitions("section", "id").select("section", "line").write.partitionBy("section").text(f"{to}/lines")
        done.records.repartitionByRange("id").sortWithinPartitions("id").write.json(f"{to}/records")
        write_small(spark, f"{to}/summary.json", json.dumps({"summary": found, "thresholds": asdict(done.thresholds)}, ensure_ascii=False, indent=2))
        write_small(spark, f"{to}/report.txt", "DATASET VALIDATION REPORT\n\n" + text_report(report_sections(found)))

    publish(spark, folder, write)


# -- the split -------------------------------------------------------------------------------------


def guarded(rows: DataFrame, evaluation: DataFrame, prepare=None) -> DataFrame:
    """``rows`` (id, text): a job that reads the id of a row whose text leaks the evaluation fails.
    The guard is part of the plan, so nothing can be written past it."""
    found = leaks(rows.select(F.col("id").alias("doc_id"), "text"), evaluation, prepare=prepare).select(F.col("doc_id").alias("id"), F.col("reason").alias("_leak"))
    raised = F.raise_error(F.concat(F.lit("evaluation-set leakage in accepted records: "), F.col("id").cast("string"), F.lit(": "), "_leak"))
    checked = F.when(F.col("_leak").isNull(), F.col("id")).otherwise(raised.cast(rows.schema["id"].dataType))
    return rows.join(found, "id", "left").withColumn("id", checked).drop("_leak")


def digest(*columns: Column) -> Column:
    """A digest of a set of rows that doesn't depend on their order: 15 hexadecimal digits of each
    row's hash, added up."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    return F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")


def split_info(rows: DataFrame) -> DataFrame:
    """split, records, minutes, digest, categories (category, n in order) of ``rows`` (id, category,
    split, duration_s)."""
    by = rows.groupBy("split", "category").agg(F.count("*").alias("n"))
    categories = by.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("category", "n"))).alias("categories"))
    whole = rows.groupBy("split").agg(F.count("*").alias("records"), F.round(F.sum("duration_s") / 60, 2).alias("minutes"), digest(F.col("id")).alias("digest"))
    return whole.join(categories, "split")


def build_split(records: DataFrame, categories: DataFrame, evaluation: DataFrame, folder: str, audio_root: str = "", project_root: str = "/", seed: int = 42, val_ratio: float = 0.05, test_ratio: float = 0.05, prepare=None) -> dict:
    """Splits the accepted ``records`` (id, text, duration_s, accepted; as ``validated`` stores them)
    under ``categories`` (id, category), and publishes at ``folder`` a manifest for each split
    (id, audio, text by id; audio as a path under ``audio_root``, relative to ``project_root``), the
    rejected ids, and split_info.json, which is returned.

    Raises where no record is accepted, and where an accepted text leaks the evaluation, even though
    validation had let it pass; then nothing is published."""
    spark = records.sparkSession
    counts = records.agg(F.count("*").alias("audio_files"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected")).first().asDict()
    if not counts["accepted"]:
        raise ValueError("no records passed validation; nothing to split")
    accepted = guarded(records.filter("accepted").select("id", "text", "duration_s"), evaluation, prepare)
    named = stored(accepted.join(categories.select("id", "category").dropDuplicates(["id"]), "id", "left"), "accepted")
    split = assign_splits(named, seed, val_ratio, test_ratio)
    # a record's own category is what the info counts; the split's stratum is its transcript's
    placed = stored(named.withColumn("category", F.coalesce("category", F.lit("unknown"))).join(split.select("id", "split"), "id"), "splits")
    path = F.concat(F.lit(f"{audio_root.rstrip('/')}/"), F.col("id").cast("string"), F.lit(".wav"))
    info = {"seed": seed, "ratios": {"val": val_ratio, "test": test_ratio}, "method": "group by transcript, stratify by category, seeded sha256 ordering", "validation": counts}
    rows = split_info(placed).collect()
    info["script_digest"] = categories.agg(digest(F.col("id"), F.col("category")).alias("d")).first().d
    info["summary"] = {r.split: {"records": r.records, "minutes": r.minutes, "digest": r.digest, "categories": {c.category: c.n for c in r.categories}} for r in sorted(rows)}

    def write(to: str) -> None:
        write_manifests(placed.select("split", F.col("id").cast("string").alias("id"), relative_path(path, project_root).alias("audio"), "text"), f"{to}/manifests")
        records.filter(~F.col("accepted")).select(F.col("id").cast("string").alias("id")).repartitionByRange("id").sortWithinPartitions("id").write.text(f"{to}/rejected_ids")
        write_small(spark, f"{to}/split_info.json", json.dumps(info, ensure_ascii=False, indent=2))

    publish(spark, folder, write)
    return info
