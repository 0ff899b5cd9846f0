"""Chunked recordings against whole ones, and resampling against sines."""

import wave

import numpy as np
import pytest
from test_functions import _sound, _write

from curalith.operators import chunks, dataset, validation
from curalith.sources import readers

NAMES = ("n_samples", "n_frames", "duration_s", "clipped", "peak_dbfs", "loudest", "leading_s", "trailing_s", "snr_db", "rough_snr_db", "speech_s")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wavs")
    for k, (name, x, rate, channels) in enumerate([("plain", _sound(1.0), 48_000, 1), ("odd", _sound(0.7, rate=22_100, seed=2), 22_100, 1), ("loud", _sound(0.5, gain=5.0), 48_000, 2), ("silent", np.zeros(48_000), 48_000, 1), ("noisy", _sound(0.8, noise=0.02), 48_000, 1), ("tiny", np.full(100, 0.5), 48_000, 1), ("none", np.zeros(0), 48_000, 1), ("twin", _sound(1.0), 48_000, 1)]):
        _write(path / f"{name}.wav", x, rate, 2 if k % 2 else 3, channels)
    _write(path / "twin.wav", _sound(1.0), 48_000, 3, 1)
    (path / "bad.wav").write_bytes(b"RIFF1234")
    (path / "short.wav").write_bytes((path / "plain.wav").read_bytes()[:90_001])
    return str(path)


@pytest.mark.parametrize("length", [4096, 3 * 4096, 1 << 18])
def test_chunks_measure_as_whole_recordings(spark, folder, length):
    read = readers.read_wav_chunks(spark, folder, length).cache()
    assert max(len(r.samples or ()) for r in read.select("samples").collect()) <= length
    whole = {r.id: r for r in validation.measures(readers.read_wavs(spark, folder)).collect()}
    got = {r.id: r for r in chunks.sound(read).collect()}
    assert got.keys() == whole.keys() and len(got) == 10
    for i, r in whole.items():
        assert (got[i].unread is None) == (r.unread is None)
        if r.unread is None:
            assert (got[i].sample_rate, got[i].channels, got[i].subtype) == (r.sample_rate, r.channels, r.subtype)
            for c in NAMES:
                assert got[i][c] == (r[c] if r[c] is None else pytest.approx(r[c], rel=1e-9, abs=1e-9)), (i, c)
    one = {r.id: r.digest for r in chunks.digests(readers.read_wav_chunks(spark, folder, 1 << 20)).collect()}
    assert {i: r.digest for i, r in got.items() if r.digest and r.unread is None} == {i: d for i, d in one.items() if i != "short"}
    assert one["plain"] == one["twin"] and len({*one.values()}) == len(one) - 1


def test_validation_reads_chunks(spark, folder):
    script = spark.createDataFrame([("plain", "bugün hava çok güzel", 0), ("twin", "yarın hava çok güzel", 1)], "id string, text string, pos long")
    evaluation = spark.createDataFrame([], "text string")
    done = [dataset.validated(script, audio, evaluation, "abcçdefgğhıijklmnoöprsştuüvyz ") for audio in (readers.read_wavs(spark, folder), chunks.sound(readers.read_wav_chunks(spark, folder, 8192)))]
    a, b = ({r.id: (r.errors, r.warnings, r.accepted) for r in d.records.collect()} for d in done)
    assert a == b and a["twin"][0] == ["duplicate audio: same samples as plain"] and done[0].counts == done[1].counts


def test_end_levels_cross_chunks(spark):
    x = np.concatenate([np.full(95, 0.5), np.full(20, 0.25)])
    audio = spark.createDataFrame([("a", 1000, 1, "PCM_16", None, [x.tolist()]), ("zero", 1000, 1, "PCM_16", None, [[0.0] * 50])], "id string, sample_rate int, channels int, subtype string, error string, samples array<array<double>>")
    want = 20 * np.log10(np.sqrt((x[-30:] ** 2).mean()) / 0.5)
    for length in (7, 16, 200):
        got = {r.id: r.end_db for r in chunks.end_levels(chunks.cut(audio, length)).collect()}
        assert got == {"a": pytest.approx(want), "zero": -200.0}


def test_an_hour_in_chunks(spark, tmp_path):
    """An hour at 8 kHz: no row is larger than a chunk, and the measures are those of plain numpy."""
    rate, rng = 8000, np.random.default_rng(0)
    n = 3600 * rate
    x = 0.3 * np.sin(2 * np.pi * 200 * np.arange(n) / rate) * (0.6 + 0.4 * np.sin(2 * np.pi * np.arange(n) / rate))
    x[: 2 * rate] = x[-rate:] = 0
    x = np.round((x + rng.normal(0, 1e-3, n)) * 32768).astype("<i2")
    with wave.open(f"{tmp_path}/hour.wav", "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate), w.writeframes(x.tobytes())
    read = readers.read_wav_chunks(spark, str(tmp_path), 1 << 16)
    got = chunks.sound(read).first()
    level = 20 * np.log10(np.maximum(np.sqrt(((x / 32768).reshape(-1, 160) ** 2).mean(axis=1)), 1e-10))
    on = np.flatnonzero(level > level.max() - 40)
    edge = np.concatenate([level[: on[0]], level[on[-1] + 1 :]])
    assert (got.n_samples, got.n_frames) == (n, 3600 * 50) and got.loudest == pytest.approx(level.max())
    assert (got.leading_s, got.trailing_s) == (pytest.approx(on[0] * 0.02), pytest.approx((len(level) - 1 - on[-1]) * 0.02))
    assert got.snr_db == pytest.approx(np.percentile(level[on[0] : on[-1] + 1], 90) - np.median(edge), abs=0.051)


@pytest.mark.parametrize(("old", "new"), [(48_000, 16_000), (44_100, 16_000), (8_000, 16_000), (48_000, 48_000)])
def test_resampled_sines(spark, old, new):
    t, rows = np.arange(old // 2) / old, []
    for k, hz in enumerate((440, 3000, 10_000)):
        rows.append((str(hz), old, 1, "PCM_24", None, [np.sin(2 * np.pi * hz * t + k).tolist()]))
    audio = spark.createDataFrame(rows, "id string, sample_rate int, channels int, subtype string, error string, samples array<array<double>>")
    got = {r.id: np.array(r.samples) for r in chunks.joined(chunks.resampled(chunks.cut(audio, 5000), new)).collect()}
    other = {r.id: np.array(r.samples) for r in chunks.joined(chunks.resampled(chunks.cut(audio, 1 << 20), new)).collect()}
    for k, hz in enumerate((440, 3000, 10_000)):
        y = got[str(hz)]
        assert len(y) == new // 2 and np.allclose(y, other[str(hz)], atol=1e-12)
        inner = slice(len(y) // 5, -len(y) // 5)
        want = np.sin(2 * np.pi * hz * np.arange(len(y)) / new + k) if hz < min(old, new) / 2 else 0
        if hz < old / 2:
            assert np.abs(y - want)[inner].max() < 1e-3  # -60 dB
