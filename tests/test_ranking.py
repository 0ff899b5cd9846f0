"""Places and medians by ranges, previous rows by slices, scripts and summaries against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from curalith.operators import comparison, duplicates, joins, ranking, script, takes


def test_numbered_is_the_order_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.3, rng.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "late boolean, at long, id long")
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    for ranges in (1, 3, 16):
        got = {r.id: r.k for r in ranking.numbered(df, "late", "at", ["id"], "k", ranges).collect()}
        assert got == {r[2]: k for k, r in enumerate(want, 1)}
    assert ranking.numbered(df.limit(0), "late", "at", ["id"], "k", 4).count() == 0


def test_median_narrows_to_the_middle(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ACCURACY", 100)
    rng = random.Random(2)
    for values in ([], [3.0], [1.0, 2.0], [5.0] * 300 + [1.0, 9.0], [rng.gauss(0, 5) for _ in range(999)], [float(rng.randrange(6)) for _ in range(1000)], [1.0] * 50 + [2.0] * 50):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        got = ranking.exact_median(df, "v")
        assert got == (pytest.approx(statistics.median(values)) if values else None)


def test_previous_row_over_slices(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"own {i}"])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string")
    last, want = {}, {}
    for i, t in rows:
        want[i] = last.get(t) if t is not None else None
        last[t] = i
    for slices in (None, F.floor(F.col("id") / 7), F.floor(F.col("id") / 1000)):
        assert {r.id: r.previous_id for r in duplicates.previous_occurrence(df, F.col("text"), ["id"], "id", slices).collect()} == want


def test_texts_of_other_scripts(spark):
    rows = [(1, "a", "Bir"), (2, "b", "bir"), (3, "c", "BIR"), (4, "a", "bir"), (5, "a", "iki"), (6, "a", "iki"), (7, None, "bir"), (8, "b", None), (9, "c", None), (10, "b", ""), (11, "c", "")]
    df = spark.createDataFrame(rows, "id long, file string, text string")
    got = {r.id: (r.other_script, r.other_id) for r in joins.text_collisions(df, "text", "file", "id").collect()}
    assert got == {1: ("b", 2), 4: ("b", 2), 2: ("a", 1), 3: ("a", 1), 7: ("a", 1), 10: ("c", 11), 11: ("b", 10)}
    assert joins.text_collisions(df.limit(0), "text", "file", "id").count() == 0


def test_script_says_what_speaks_against_a_sentence(spark):
    sentences = spark.createDataFrame([("s1", "Saat 3'te geldi.", "time", 1), ("s2", "Başka bir cümle", "plain", 2), ("s3", "başka bir cümle", "plain", 3), ("s4", "bu cümle sınavdan alınmış bir cümledir", "plain", 4), ("s5", "ж " + "çok uzun, " * 30, "plain", 5), ("s6", None, "plain", 6), ("s7", "önceki", "plain", 7)], "id string, text string, category string, pos long")
    evaluation = spark.createDataFrame([("Bu cümle sınavdan alınmış bir şeydir",)], "text string")
    other = spark.createDataFrame([("s7", "ÖNCEKİ x", "pilot", 1), ("p2", "Önceki", "pilot", 2)], "id string, text string, origin string, pos long")
    found = script.recording_script(sentences, evaluation, "abcçdefgğhıijklmnoöprsştuüvyzABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ .,'", other)
    errors = {r.id: r.errors for r in found.collect()}
    assert errors["s1"] == [] and errors["s2"] == [] and errors["s6"] == []
    assert errors["s3"] == ["duplicate of s2"]
    assert errors["s4"] == ["shared run: bu cümle sınavdan alınmış bir"]
    assert errors["s5"][0].startswith("unmappable characters: ж") and errors["s5"][1].startswith("estimated ") and errors["s5"][1].endswith("s exceeds 14.0s")
    assert errors["s7"] == ["id is used in another script", "duplicate of pilot:p2"]
    head = script.script_summary(found, "abcçdefgğhıijklmnoöprsştuüvyz")
    assert head["sentences"] == 7 and head["with_errors"] == 4 and head["categories"] == {"time": 1, "plain": 6} and "j" in head["missing_letters"]


LOG = "clip_id string, source string, source_id string, category string, text string, status string, reasons string, scale double, attempts int, duration_s double, compute_s double, median_f0_hz double, min_f0_hz double, max_drop_st double, end_db double"


def test_summary_of_a_log(spark):
    rows = [
        ("a", "x", "1", "c", "bir", "accepted", "", 1.0, 1, 2.0, 4.0, 200.0, 190.0, 1.0, -60.0), ("b", "x", "2", "c", "iki", "accepted", "", 1.0, 2, 3.0, 4.0, 201.0, 195.0, None, None), ("d", "y", "3", "e", "üç", "accepted", "", 1.5, 1, 3.0, 5.0, 300.0, 195.0, 2.0, -60.0),
        ("f", "y", "4", "e", "dört", "accepted", "", 1.5, 1, 3.0, 5.0, 200.0, 195.0, 2.0, -20.0), ("g", "y", "5", "e", "beş", "rejected", "unvoiced: z; low_pitch: q", 1.5, 3, 3.0, 6.0, None, 100.0, 2.0, None),
    ]
    log = spark.createDataFrame(rows, LOG)
    got = {(r.part, r.name): r.value for r in takes.summary(log).collect()}
    total = {k[1]: v for k, v in got.items() if k[0] == "total"}
    assert total == {"clips_total": 5, "accepted_by_generation": 4, "excluded_by_consistency": 1, "excluded_by_end_cut": 1, "kept": 2, "kept_ratio": 0.4, "kept_minutes": 0.08, "compute_hours": 0.007, "voice_median_f0_hz": 200.5, "compute_s_per_kept_audio_s": 4.8}
    assert got["attempts_of_kept", "2"] == 1 and got["source_kept", "y"] == 0 and got["source_clips", "y"] == 3 and ("category_of_kept", "e") not in got
    assert got["reject_reasons", "low_pitch"] == 1 and got["min_f0_hz_kept", "median"] == 192.5 and got["min_f0_hz_rejected", "max"] == 100 and got["max_drop_st_kept", "n"] == 1
    kept = takes.kept_script(takes.finalize(log)).collect()
    assert sorted((r.id, r.train_text) for r in kept) == [("a", "bir"), ("b", "iki")]
    empty = {(r.part, r.name): r.value for r in takes.summary(log.limit(0)).collect()}
    assert empty["total", "kept_ratio"] == 0 and empty["total", "voice_median_f0_hz"] is None


def test_comparison_sheet_shows_missing_results_as_empty(spark):
    sentences = spark.createDataFrame([(1,), (2,)], "sentence_id long")
    results = spark.createDataFrame([(1, "m", "a.wav", 1.005, 2.675, None)], "sentence_id long, model string, audio string, time_s double, duration_s double, drop_st double")
    rows = {r.sentence_id: r for r in comparison.comparison_sheet(sentences, results, "sentence_id", ["m", "n"]).collect()}
    assert (rows[1].m_audio, rows[1].m_time_s, rows[1].m_duration_s, rows[1].m_drop_st, rows[1].n_audio) == ("a.wav", "1.00", "2.67", "", "")
    assert (rows[2].m_audio, rows[2].m_time_s) == ("", "")


@pytest.mark.parametrize("accuracy", [50, 10_000])
def test_quantiles_of_groups(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranking, "ACCURACY", accuracy)
    rng = random.Random(4)
    draw = {"a": lambda: rng.gauss(0, 5), "b": lambda: float(rng.randrange(3)), None: lambda: rng.paretovariate(0.3), "one": lambda: 7.0}
    rows = [(g, f()) for g, f in draw.items() for _ in range(1 if g == "one" else 700)] + [("a", None), ("none", None)]
    found = {r.g: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.1, "mid": 0.5, "top": 1.0, "high": 0.9}).collect()}
    assert found.keys() == {"a", "b", None, "one"}
    for g, r in found.items():
        v = sorted(x for k, x in rows if k == g and x is not None)
        for name, p in (("low", 0.1), ("mid", 0.5), ("top", 1.0), ("high", 0.9)):
            at = (len(v) - 1) * p
            a, b = v[int(at)], v[min(len(v) - 1, int(at) + 1)]
            assert r.n == len(v) and r[name] == pytest.approx(a + (b - a) * (at - int(at)))
