"""Logs that a stream goes on with: no key twice, whatever is repeated or killed."""

import shutil

import pytest

from curalith.streaming import resume


def _add(spark, path, keys, name):
    spark.createDataFrame([(k, name) for k in keys], "clip_id string, source string").coalesce(1).write.parquet(f"{path}/in/{name}")


def _run(spark, path, state="state", **more):
    stream = spark.readStream.schema("clip_id string, source string").parquet(f"{path}/in/*")
    query = resume.append_new(stream, f"{path}/log", f"{path}/{state}", **more)
    query.awaitTermination()


def _keys(spark, path):
    return sorted(r.clip_id for r in resume.read_appended(spark, f"{path}/log").collect())


def test_stream_resumes_without_repeats(spark, tmp_path):
    _add(spark, tmp_path, ["a", "b", "a"], "one")
    _run(spark, tmp_path)
    assert _keys(spark, tmp_path) == ["a", "b"]
    _add(spark, tmp_path, ["b", "c"], "two")
    _run(spark, tmp_path)
    _run(spark, tmp_path, "other")  # another query over the same input finds nothing new
    assert _keys(spark, tmp_path) == ["a", "b", "c"]


def test_a_repeated_batch_adds_no_row(spark, tmp_path):
    """The batch's output is there, but its commit is lost, as if the driver had been killed between."""
    _add(spark, tmp_path, ["a", "b"], "one")
    _run(spark, tmp_path)
    _add(spark, tmp_path, ["c", "a"], "two")
    _run(spark, tmp_path)
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    _run(spark, tmp_path)
    assert _keys(spark, tmp_path) == ["a", "b", "c"]
    half = next((tmp_path / "log").glob(f"batch=*-{last.name}"))
    shutil.rmtree(half)  # killed before its output was whole
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    _run(spark, tmp_path)
    assert _keys(spark, tmp_path) == ["a", "b", "c"]


def test_a_log_that_was_there_before(spark, tmp_path):
    spark.createDataFrame([("a", "old")], "clip_id string, source string").write.parquet(f"{tmp_path}/log/batch=old-0")
    _add(spark, tmp_path, ["a", "d"], "one")
    _run(spark, tmp_path)
    assert _keys(spark, tmp_path) == ["a", "d"]


def test_other_settings_are_refused(spark, tmp_path):
    _add(spark, tmp_path, ["a"], "one")
    _run(spark, tmp_path, config={"seed": 42, "scales": [1.0, 0.9]})
    _run(spark, tmp_path, config={"scales": [1.0, 0.9], "seed": 42})
    with pytest.raises(ValueError, match="seed 42, now 7"):
        _run(spark, tmp_path, config={"seed": 7, "scales": [1.0, 0.9]})
    assert _keys(spark, tmp_path) == ["a"]
