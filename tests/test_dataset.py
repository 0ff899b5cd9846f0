"""Validation to splits as one flow: one pass over the samples, guards, reports, publishing."""

import glob
import json

import pytest
from pyspark.sql import functions as F

from curalith.operators import dataset, validation
from curalith.sources import publish, tables

EVALUATION = "bu cümle ölçüm kümesinde aynen duruyor işte"
LETTERS = "abcçdefgğhıijklmnoöprsştuüvyz0123456789 "


def _files(spark, ids, counter):
    """Files of two seconds of sound; each time one is made, a line is added to ``counter``."""

    def made(batches):
        import pandas as pd

        for batch in batches:
            with open(counter, "a") as f:
                f.write("".join(f"{i}\n" for i in batch["id"]))
            yield pd.DataFrame([{"id": i, "digest": f"d{i}" if i != "twin" else "da1", "sample_rate": 1000, "channels": 1, "subtype": "PCM_24", "samples": [[0.0] * 200 + [0.5, -0.5] * 500 + [0.0] * 200], "error": None} for i in batch["id"]])

    shape = "id string, digest string, sample_rate int, channels int, subtype string, samples array<array<double>>, error string"
    return spark.createDataFrame([(i,) for i in ids], "id string").mapInPandas(made, shape)


@pytest.fixture
def done(spark, tmp_path):
    names = [f"a{k}" for k in range(12)]
    script = [(i, f"cümle {k % 10} burada", k) for k, i in enumerate(names)] + [("leak", EVALUATION, 12), ("twin", "ikinci", 13), ("gone", "yok", 14), ("bad", "", 15)]
    th = validation.Thresholds(sample_rate=1000, min_sample_rate=100, min_rate=0.0, max_rate=99.0)
    evaluation = spark.createDataFrame([(EVALUATION,)], "text string")
    counter = tmp_path / "made"
    got = dataset.validated(spark.createDataFrame(script, "id string, text string, pos long"), _files(spark, [*names, "leak", "twin", "bad", "orphan"], counter), evaluation, LETTERS, th)
    return got, evaluation, counter


def test_samples_are_read_once_and_counted_on_the_way(spark, done, tmp_path):
    got, _, counter = done
    assert got.counts == {"audio_files": 16, "accepted": 12, "rejected": 4, "with_warnings": 2}
    s = got.summary()
    assert {k: s[k] for k in got.counts} == got.counts and s["missing_audio"] == 1 and s["script_entries"] == 16
    assert s["accepted_audio"] == {"n": 12, "total_min": 0.28, "mean_s": 1.4, "median_s": 1.4, "min_s": 1.4, "max_s": 1.4} and s["warning_types"] == {"same transcript": 2}
    assert s["error_types"] == {"duplicate audio": 1, "empty transcript": 1, "evaluation-set leakage": 1, "no transcript for this audio file (id not in script)": 1}
    dataset.write_report(got, f"{tmp_path}/report")
    at = publish.current(spark, f"{tmp_path}/report")
    report = tables.read_small(spark, f"{at}/report.txt")
    assert "Accepted for training: 12 (2 with warnings)" in report and "duplicate audio: 1" in report and "All audio: 0.37 min, mean 1.4s" in report
    assert json.loads(tables.read_small(spark, f"{at}/summary.json"))["summary"] == s
    lines = {x: [r.value for r in spark.read.text(f"{at}/lines/section={x}").collect()] for x in ("rejected", "warned", "missing")}
    assert lines["missing"] == ["gone"] and lines["rejected"][0] == "bad: empty transcript" and len(lines["rejected"]) == 4 and sorted(lines["warned"]) == lines["warned"] == ["a10: same transcript: as a0", "a11: same transcript: as a1"]
    assert sorted(counter.read_text().split()) == sorted([*[f"a{k}" for k in range(12)], "leak", "twin", "bad", "orphan"])


def test_split_is_published_with_its_info(spark, done, tmp_path):
    got, evaluation, counter = done
    categories = spark.createDataFrame([(f"a{k}", "general" if k < 6 else "number") for k in range(11)], "id string, category string")
    info = dataset.build_split(got.records, categories, evaluation, f"{tmp_path}/splits", "/data/set/wavs", "/data", test_ratio=0.2)
    assert info["validation"] == {"audio_files": 16, "accepted": 12, "rejected": 4}
    of = info["summary"]
    assert sum(x["records"] for x in of.values()) == 12 and set(of) == {"train", "val", "test"} and sum(x["categories"].get("unknown", 0) for x in of.values()) == 1
    at = publish.current(spark, f"{tmp_path}/splits")
    rows = {s: [json.loads(x) for f in sorted(glob.glob(f"{at}/manifests/split={s}/*.json")) for x in open(f, encoding="utf-8")] for s in of}
    assert {s: len(x) for s, x in rows.items()} == {s: x["records"] for s, x in of.items()}
    for x in rows.values():
        assert [r["id"] for r in x] == sorted(r["id"] for r in x) and all(r["audio"] == f"set/wavs/{r['id']}.wav" for r in x)
    where = {r["id"]: s for s, x in rows.items() for r in x}
    assert where["a0"] == where["a10"] and where["a1"] == where["a11"]  # takes of one transcript
    assert sorted(r.value for r in spark.read.text(f"{at}/rejected_ids").collect()) == ["bad", "leak", "orphan", "twin"]
    again = dataset.build_split(got.records.repartition(3), categories, evaluation, f"{tmp_path}/splits", test_ratio=0.2)
    assert again["summary"] == of and publish.current(spark, f"{tmp_path}/splits") != at
    assert len(counter.read_text().split()) == 16


def test_split_aborts(spark, done, tmp_path):
    got, evaluation, _ = done
    categories = spark.createDataFrame([("a1", "x")], "id string, category string")
    dataset.build_split(got.records, categories, evaluation, f"{tmp_path}/splits")
    at = publish.current(spark, f"{tmp_path}/splits")
    planted = got.records.withColumn("accepted", F.col("accepted") | (F.col("id") == "leak"))
    with pytest.raises(Exception, match="evaluation-set leakage in accepted records: leak: "):
        dataset.build_split(planted, categories, evaluation, f"{tmp_path}/splits")
    with pytest.raises(ValueError, match="nothing to split"):
        dataset.build_split(got.records.filter("NOT accepted"), categories, evaluation, f"{tmp_path}/splits")
    assert publish.current(spark, f"{tmp_path}/splits") == at


def test_a_failed_version_leaves_the_old_one(spark, tmp_path):
    root = f"{tmp_path}/table"
    assert publish.current(spark, root) is None
    for k in range(4):
        publish.publish(spark, root, lambda to, k=k: spark.range(k, k + 1).write.parquet(f"{to}/rows"))
    first = publish.current(spark, root)

    def fails(to):
        spark.range(9).write.parquet(f"{to}/rows")
        raise OSError("the disk is full")

    with pytest.raises(OSError, match="full"):
        publish.publish(spark, root, fails)
    assert publish.current(spark, root) == first and [r.id for r in spark.read.parquet(f"{first}/rows").collect()] == [3]
    publish.publish(spark, root, lambda to: spark.range(5, 6).write.parquet(f"{to}/rows"))
    assert [r.id for r in spark.read.parquet(f"{publish.current(spark, root)}/rows").collect()] == [5]
    assert len(glob.glob(f"{root}/v-*/_PUBLISHED")) <= 3 and glob.glob(f"{first}/rows") and not glob.glob(f"{root}/_next*")
