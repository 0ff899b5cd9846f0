"""Sharded, create-once and status sinks, and the reader of latent shards."""

import glob
import json

from curalith.operators import training
from curalith.sources import readers, writers


def test_latent_shards_are_read_and_admitted(spark, tmp_path):
    rows = [("a", "abc", [[0.5, 1.0]] * 8), ("b", None, [[0.5, 1.0]] * 8), ("c", "ab", [[0.0, 0.0]] * 7), ("d", "a?", [[0.0, 0.0]] * 20), ("e", "ab", None)]
    df = spark.createDataFrame(rows, "id string, text string, latent array<array<double>>").coalesce(1)
    path = f"{tmp_path}/latents"
    writers.write_shards(df, path, rows=2)
    assert len(glob.glob(f"{path}/*.parquet")) == 3
    read = readers.read_latents(spark, path)
    assert {r.id: (r.text, r.n_frames) for r in read.collect()} == {"a": ("abc", 8), "b": ("", 8), "c": ("ab", 7), "d": ("a?", 20), "e": ("ab", 0)}
    found = {r.id: list(r.ids) for r in training.admitted(read, {"a": 2, "b": 3, "c": 4}, 19).collect()}
    assert found == {"a": [2, 3, 4]}
    writers.write_shards(df.limit(1), path)
    assert readers.read_latents(spark, path).count() == 1


def test_sheet_is_never_written_over(spark, tmp_path):
    path = f"{tmp_path}/sheet"
    for k in (1, 2):
        writers.create_once(spark.createDataFrame([(k,)], "score int"), path)
    assert [r.score for r in spark.read.csv(path, header=True).collect()] == ["1"]


def test_status_follows_the_verdict(spark):
    rows = spark.createDataFrame([(1, "kept"), (2, "end_cut"), (3, "inconsistent")], "k int, verdict string")
    assert {r.k: r.status for r in writers.with_status(rows).collect()} == {1: "kept", 2: "excluded", 3: "excluded"}


def test_tables_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("ç1", "güzel", None), ("b", 'a "quoted" tab', "x")], "id string, text string, note string").coalesce(1)
    writers.write_tsv(df, f"{tmp_path}/t", ["id", "text", "note"], bom=True)
    (file,) = glob.glob(f"{tmp_path}/t/*.csv")
    raw = open(file, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbfid\ttext\tnote\n") and raw.count(b"\xef\xbb\xbf") == 1 and "güzel".encode() in raw
    read = readers.read_tsv(spark, f"{tmp_path}/t")
    assert read.columns == ["id", "text", "note"] and {r.id: r.note for r in read.collect()} == {"ç1": None, "b": "x"}
    writers.write_tsv(df, f"{tmp_path}/plain", ["id"])
    assert open(glob.glob(f"{tmp_path}/plain/*.csv")[0], "rb").read() == "id\nç1\nb\n".encode()


def test_checksums_are_held_against_pins(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"other")
    of_abc = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    pins = spark.createDataFrame([("a.bin", of_abc.upper()), ("b.bin", of_abc), ("c.bin", of_abc)], "name string, sha256 string")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.bin")
    got = {r.name: r.found for r in writers.unlike_pins(files, pins).collect()}
    assert got.keys() == {"b.bin", "c.bin"} and got["c.bin"] is None and len(got["b.bin"]) == 64


def test_summaries_are_written_over(spark, tmp_path):
    for n in (1, 2):
        writers.write_summary(spark, {"n": n, "letters": {"ç": 3}}, f"{tmp_path}/s.json")
    assert json.loads((tmp_path / "s.json").read_text(encoding="utf-8")) == {"n": 2, "letters": {"ç": 3}}
