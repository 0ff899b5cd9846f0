import sys
import unicodedata
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.functions import numbers, signal, text
from curalith.functions.normalizer import composed, normalized, suffixed
from curalith.operators import duplicates, split, takes, training, validation
from curalith.sources import readers, writers

# Pairs of the source behaviour.
CARDINALS = {
    0: "sıfır", 1: "bir", 10: "on", 19: "on dokuz", 100: "yüz", 101: "yüz bir", 200: "iki yüz", 1000: "bin", 1001: "bin bir", 2026: "iki bin yirmi altı", 5200: "beş bin iki yüz",
    12550: "on iki bin beş yüz elli", 100000: "yüz bin", 1250000: "bir milyon iki yüz elli bin", 2 * 10**9: "iki milyar",
}
SUFFIXES = [
    ("yirmi", "dir", False, "yirmidir"), ("otuz", "da", False, "otuzda"), ("beş", "te", False, "beşte"), ("beş", "e", False, "beşe"), ("iki", "ye", False, "ikiye"), ("iki", "nin", False, "ikinin"),
    ("altı", "dır", False, "altıdır"), ("kuruş", "tir", False, "kuruştur"), ("Türk lirası", "dir", True, "Türk lirasıdır"), ("Türk lirası", "ye", True, "Türk lirasına"),
    ("Türk lirası", "de", True, "Türk lirasında"), ("Türk lirası", "den", True, "Türk lirasından"), ("Türk lirası", "nin", True, "Türk lirasının"), ("Türk lirası", "yi", True, "Türk lirasını"),
    ("ka de ve", "yi", False, "ka de veyi"), ("ka de ve", "nin", False, "ka de venin"), ("yirmi", "", False, "yirmi"), ("", "dir", False, "dir"),
]
SENTENCES = [
    ("KDV %20'dir. Toplam borç ₺12.550,75'tir.", "Ka de ve yüzde yirmidir. Toplam borç on iki bin beş yüz elli Türk lirası yetmiş beş kuruştur."),
    ("Öğrencinin kalan borcu 5.200 TL'dir.", "Öğrencinin kalan borcu beş bin iki yüz Türk lirasıdır."),
    ("Fatura tutarı 1.250.000 TL olarak hesaplandı.", "Fatura tutarı bir milyon iki yüz elli bin Türk lirası olarak hesaplandı."),
    ("Tutar 100 TL'ye düşürüldü.", "Tutar yüz Türk lirasına düşürüldü."),
    ("Tutar ₺250 oldu.", "Tutar iki yüz elli Türk lirası oldu."),
    ("Tutar 99,90 ₺.", "Tutar doksan dokuz Türk lirası doksan kuruş."),
    ("Tutar 10,00 TL.", "Tutar on Türk lirası."),
    ("Tutar 0,5 TL.", "Tutar sıfır Türk lirası elli kuruş."),
    ("TL cinsinden girilmelidir.", "Türk lirası cinsinden girilmelidir."),
    ("Tahsilat oranı %87,5 olarak gerçekleşti.", "Tahsilat oranı yüzde seksen yedi virgül beş olarak gerçekleşti."),
    ("İndirim % 15'tir.", "İndirim yüzde on beştir."),
    ("Ödeme tarihi 30.09.2026'dır.", "Ödeme tarihi otuz Eylül iki bin yirmi altıdır."),
    ("Tarih: 01/01/2027", "Tarih: bir Ocak iki bin yirmi yedi"),
    ("Son ödeme tarihi 15 Ekim 2026'dır.", "Son ödeme tarihi on beş Ekim iki bin yirmi altıdır."),
    ("Geçersiz 45.13.2026 tarihi.", "Geçersiz kırk beş on üç iki bin yirmi altı tarihi."),
    ("Toplantı saat 14:30'da başlayacaktır.", "Toplantı saat on dört otuzda başlayacaktır."),
    ("Saat 09:05'te", "Saat dokuz sıfır beşte"),
    ("Saat 18:00", "Saat on sekiz"),
    ("Oran 3,05 oldu.", "Oran üç virgül sıfır beş oldu."),
    ("2026'da 3 şube açıldı.", "İki bin yirmi altıda üç şube açıldı."),
    ("Kod 0006 girildi.", "Kod sıfır sıfır sıfır altı girildi."),
    ("Müşteri no 12345678.", "Müşteri no bir iki üç dört beş altı yedi sekiz."),
    (
        "IBAN numarası TR12 0006 1005 1978 6457 8413 26 olarak kaydedildi.",
        "İban numarası te re, on iki, sıfır sıfır sıfır altı, bir sıfır sıfır beş, bir dokuz yedi sekiz, altı dört beş yedi, sekiz dört bir üç, iki altı olarak kaydedildi.",
    ),
    ("IBAN bilgilerini kontrol ediniz.", "İban bilgilerini kontrol ediniz."),
    ("CRM modülünde yeni bir kayıt var.", "Si ar em modülünde yeni bir kayıt var."),
    ("ERP sistemi üzerinden cari hesap seçebilirsiniz.", "E re pe sistemi üzerinden cari hesap seçebilirsiniz."),
    ("KDV'yi ve SGK'nın payını hesaplayın.", "Ka de veyi ve se ge kanın payını hesaplayın."),
    ("e-Fatura ve e-Arşiv başarıyla oluşturuldu.", "E fatura ve e arşiv başarıyla oluşturuldu."),
    ("Faturalar, raporlar vb. gönderildi.", "Faturalar, raporlar ve benzeri gönderildi."),
    ("Dashboard üzerindeki KPI değerleri", "Deşbord üzerindeki ke pe i değerleri"),
    ("Raporu Excel formatında export edebilirsiniz.", "Raporu Eksel formatında eksport edebilirsiniz."),
    ("Yeni öğrenci kaydı oluşturabilirsiniz.", "Yeni öğrenci kaydı oluşturabilirsiniz."),
    ("Ankara'daki şubeye gönderildi.", "Ankara'daki şubeye gönderildi."),
    ("  Fazla   boşluk  ", "Fazla boşluk"),
    ("KDV %20’dir.", "Ka de ve yüzde yirmidir."),
    ("KDVSİZ ve TLX kodları", "KDVSİZ ve TLX kodları"),
    ("Tamam. KDV %20'dir. ERP açık.", "Tamam. Ka de ve yüzde yirmidir. E re pe açık."),
]


def spoken(spark, texts):
    """What is said for each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    said = {r.k: r.s for r in df.select("k", normalized(F.col("t")).alias("s")).collect()}
    return [said[k] for k in range(len(texts))]


def test_normalizer_pairs(spark):
    assert spoken(spark, [a for a, _ in SENTENCES]) == [b for _, b in SENTENCES]
    assert spoken(spark, [b for _, b in SENTENCES]) == [b for _, b in SENTENCES]
    suffixes = spark.createDataFrame([(k, *x[:3]) for k, x in enumerate(SUFFIXES)], "k int, form string, suffix string, owned boolean")
    got = {r.k: r.s for r in suffixes.select("k", suffixed(F.col("form"), F.col("suffix"), F.col("owned")).alias("s")).collect()}
    assert [got[k] for k in range(len(SUFFIXES))] == [x[3] for x in SUFFIXES]


def test_normalizer_edges(spark):
    pairs = [
        ("100TL, 12.5505, 5a, %5 TL TR120006100519786457841326", "Yüz Türk lirası, on iki.beş bin beş yüz beş, 5a, %beş Türk lirası te re, on iki, sıfır sıfır sıfır altı, bir sıfır sıfır beş, bir dokuz yedi sekiz, altı dört beş yedi, sekiz dört bir üç, iki altı"),
        ("ONLINE LOGIN %" + "9" * 20, "Onlayn Login yüzde " + " ".join(["dokuz"] * 20)),
        (None, None), ("", ""), (" \t\n", ""), ("\ufdd0 a\ufdda", "A"),
        ("₺1.250.000.", "Bir milyon iki yüz elli bin Türk lirası."),  # points of an amount begin no number
        ("3.7.1999 45.13.2026 1/2.2026", "Üç Temmuz bin dokuz yüz doksan dokuz kırk beş on üç iki bin yirmi altı bir/iki.iki bin yirmi altı"),
        ("10:00. 09:05 24:10", "On. Dokuz sıfır beş yirmi dört:on"),
        ("1,05 TL 1,00 TL 1,5 TL 3,125 ₺", "Bir Türk lirası beş kuruş bir Türk lirası bir Türk lirası elli kuruş üç virgül yüz yirmi beş Türk lirası"),
        ("123456 %123456 123.456 123456,7", "Bir iki üç dört beş altı yüzde yüz yirmi üç bin dört yüz elli altı yüz yirmi üç bin dört yüz elli altı yüz yirmi üç bin dört yüz elli altı virgül yedi"),
        ("KDV'lead e-posta'ya TL-li KDV-li T.C.'nin", "Ka de veleed e postaya Türk lirası-li KDV-li te cenin"),
        ("5'KDV 5'e5", "Beşkdv beşe5"),  # a suffix is no word of its own
        ("KDV'yi%5", "Ka de veyiyizde beş"),  # what touches a suffix is part of it
        ("\u0663 ve 5\u0663a", "Üç ve 5\u0663a"),  # digits of another script
        ("i\u0307. ıslak! çay? Ne.a", "İ\u0307. Islak! Çay? Ne.a"),
        ("DE12 A1B2 C3D4 E5F6 78'den", "De e, on iki, a bir be iki, ce üç de dört, e beş fe altı, yedi sekizden"),
    ]
    assert spoken(spark, [a for a, _ in pairs]) == [b for _, b in pairs]
    # a text of a few megabytes, and forms that are repeated in it
    long = "Tutar 5.200 TL'dir. " * 100_000
    assert spoken(spark, [long])[0] == ("Tutar beş bin iki yüz Türk lirasıdır. " * 100_000).strip()


def test_composed_form(spark):
    """Every character's decomposition, and marks behind letters in an order to be changed."""
    texts = [unicodedata.normalize("NFD", chr(p)) for p in range(0x80, sys.maxunicode) if not 0xD800 <= p < 0xE000 and unicodedata.normalize("NFD", chr(p)) != chr(p)]
    texts += [chr(p) for p in range(0x80, sys.maxunicode) if not unicodedata.is_normalized("NFC", chr(p))]
    texts += ["s\u0307\u0323", "i\u0307", "plain", "\u1100\u1161\u11a8", "a\u0315\u0300\u05ae"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert {r.k: r.c for r in df.select("k", composed(F.col("t")).alias("c")).collect()} == {k: unicodedata.normalize("NFC", t) for k, t in enumerate(texts)}


def test_native_numbers_agree(spark):
    rows = spark.createDataFrame([(n,) for n in CARDINALS], "n long").select("n", numbers.number_to_words(F.col("n")).alias("w")).collect()
    assert {r.n: r.w for r in rows} == CARDINALS
    assert spark.range(1).select(numbers.number_to_words(F.lit(-1)), numbers.number_to_words(F.lit(10**15))).first() == (None, " ".join(["bir", *["sıfır"] * 15]))


def test_rounding_and_holdout(spark):
    rows = spark.createDataFrame([(n,) for n in (2, 3, 30, 50, 70)], "n long").select(split.holdout(F.col("n"), 0.05).alias("h")).collect()
    assert [r.h for r in rows] == [0, 1, 2, 2, 4]
    values = [6.25, 2.675, -2.675, 1.005, 0.125, 0.375, 99.995, -0.001, 45035996273704.955, 4503599627370495.5, 1e15 / 3, float("nan"), float("inf")]
    shown = spark.createDataFrame([(x,) for x in values], "x double").select(*[text.fixed(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    assert [tuple(r) for r in shown] == [tuple(f"{x:.{d}f}" for d in (0, 1, 2)) for x in values]
    assert spark.range(1).select(text.fixed(F.lit(1e25), 2), text.fixed(F.lit(None), 2)).first() == ("1" + "0" * 25 + ".00", None)


def test_words_and_hashes(spark):
    df = spark.createDataFrame([(" 'Bir\u00a0iki\u2003üç. . dört's\tbeş! \x1c",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(text.words(F.col("t"))).collect()]
    assert got == [["bir", "iki", "üç", "dört's", "beş"], [], None]
    hashed = df.select(text.word_hashes(text.words(F.col("t"))).alias("x")).select("x.h", "x.g").first()
    assert len(hashed.h) == len(set(hashed.h)) and not set(hashed.h) & set(hashed.g)


def test_vocabulary(spark):
    df = spark.createDataFrame([("Ğq!hâlâ ☺ é",), (None,), ("",)], "t string")
    vocab = "ğkhâle. "
    assert [r[0] for r in df.select(text.fit_to_vocabulary(F.col("t"), vocab)).collect()] == ["ğk.hâlâ e", None, ""]
    assert df.select(text.unmappable(F.col("t"), vocab)).first()[0] == ["☺"]


def test_vocabulary_of_every_character(spark):
    """All characters of the basic plane and some beyond, against the rule said plainly."""
    vocab = "abcçdefgğhıijklmnoöprsştuüvyzâABCÇDEFGHIİJKLMNOÖPRSŞTUÜVYZ0123456789 .,?:;'-%αΩ"
    known = {"Ğ": "ğ", "q": "k", "î": "i", "Î": "İ", "û": "u", "Û": "U", "!": ".", "“": "", "”": "", '"': "", "«": "", "»": "", "–": ",", "—": ",", "Â": "A"}
    chars = [chr(p) for p in [*range(0x20, 0xD800), *range(0xE000, 0xFFFE), 0x10400, 0x1D11E, 0x1F600] if not chr(p).isspace()]

    def plain(c):
        for to in ([c] if c in vocab else [known[c]] if c in known else [c.lower()] if c.lower() in set(vocab) else [unicodedata.normalize("NFD", c)[0]]):
            return to if to == "" or to in set(vocab) else None

    df = spark.createDataFrame([(k, f"a{c}a") for k, c in enumerate(chars)], "k long, t string")
    got = {r.k: (r.f, r.u) for r in df.select("k", text.fit_to_vocabulary(F.col("t"), vocab).alias("f"), text.unmappable(F.col("t"), vocab).alias("u")).collect()}
    for k, c in enumerate(chars):
        to = plain(c)
        assert got[k] == (("a a", [c]) if to is None else (f"a{to}a", [])), (hex(ord(c)), got[k], to)
    assert (plain("\u212a"), plain("\u212b"), plain("ά")) == ("k", "A", "α")


def test_signal(spark):
    rows = spark.createDataFrame([([0.0, 0.0, 1.0, 1.0, 0.5, 0.5, 0.0],), ([],)], "s array<double>")
    levels = rows.select(signal.frame_levels(F.col("s"), F.lit(2)).alias("l")).collect()
    assert [round(x) for x in levels[0].l] == [-200, 0, -6] and levels[1].l == []
    w = spark.createDataFrame([([330.0, 300.0, None, 280.0],), ([None],), ([],)], "w array<double>")
    assert [r[0] for r in w.select(signal.take_floor(F.col("w"), 0.5, 200.0)).collect()] == [280.0, 0.0, 0.0]
    drops = [r[0] for r in w.select(signal.pitch_drop(F.col("w"))).collect()]
    assert round(drops[0], 3) == 2.039 and drops[1:] == [None, None]


def test_order_dependent(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a"), (5, None), (6, None)], "i long, k string")
    assert [r.first_id for r in duplicates.first_occurrence(rows, F.col("k"), "i", "i").orderBy("i").collect()] == [None, None, 1, 1, None, None]
    assert [r.previous_id for r in duplicates.previous_occurrence(rows, F.col("k"), ["i"], "i").orderBy("i").collect()] == [None, None, 1, 3, None, None]


def test_takes_and_early_stop(spark):
    t = spark.createDataFrame([(1, 1, 100.0, ["x"]), (1, 2, 170.0, ["x"]), (1, 3, 150.0, ["x"]), (2, 1, 100.0, ["x", "y"]), (2, 2, 190.0, []), (2, 3, 250.0, [])], "c long, a int, min_f0_hz double, reasons array<string>")
    got = {r.c: (r.a, r.attempts, r.status) for r in takes.choose_take(t, "c", "a").collect()}
    assert got == {1: (2, 3, "rejected"), 2: (2, 2, "accepted")}
    log = spark.createDataFrame([(1, s, v) for s, v in ((2, 1.0), (4, 1.2), (6, 1.1), (8, 0.5))], "r long, step long, loss double")
    r = training.early_stop(log, "r", 2).first()
    assert (r.best_step, r.best_loss, r.stop_step) == (2, 1.0, 6)


def test_split_is_stable(spark):
    rows = [(f"x{i:03}", f"cümle {i}", "g") for i in range(200)] + [("x000b", "CÜMLE 0", "g")]
    of = lambda n: {r.id: r.split for r in split.assign_splits(spark.createDataFrame(rows[:n], "id string, text string, category string")).collect()}
    whole = of(201)
    assert len(whole) == 201 and whole["x000"] == whole["x000b"] and {*whole.values()} == {"train", "val", "test"}
    assert sum(v == "test" for v in whole.values()) in (10, 11)


def test_sources(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# head\n\na | g | bir|iki\nb|g|üç\n", encoding="utf-8")
    assert sorted(map(tuple, readers.read_sentences(spark, f"{tmp_path}/s.txt").collect())) == [("a", "g", "bir|iki"), ("b", "g", "üç")]
    (tmp_path / "bad.txt").write_text("a|g|x\na|g|y\n")
    with pytest.raises(ValueError, match="stands 2 times"):
        readers.read_sentences(spark, f"{tmp_path}/bad.txt")
    (tmp_path / "t.tsv").write_text("﻿id\ttrain_text\n a\tbir\nb\t\n a\tiki\n", encoding="utf-8")
    assert sorted((r.id, r.text) for r in readers.read_transcripts(spark, f"{tmp_path}/t.tsv").collect()) == [("a", "iki"), ("b", "")]
    assert readers.read_log(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "w").mkdir()
    with wave.open(f"{tmp_path}/w/ok.wav", "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(48000), w.writeframes(b"\x00\x40" * 10)
    (tmp_path / "w" / "bad.wav").write_bytes(b"RIFF1234")
    got = {r.id: r for r in readers.read_wavs(spark, f"{tmp_path}/w").collect()}
    assert got["ok"].samples == [[0.5] * 10] and got["ok"].error is None and got["bad"].error.startswith("unreadable audio")
    assert readers.load_config('{"a": 1}', ["a=2", "b=x"]) == {"a": 2, "b": "x"}
    df = spark.createDataFrame([("train", "1", "a", "t")], "split string, id string, audio string, text string")
    writers.write_manifests(df, f"{tmp_path}/m")
    assert readers.read_manifest(spark, f"{tmp_path}/m/split=train").first().id == "1"
    (tmp_path / "m" / "split=train" / "broken.json").write_text('{"id": "2"\n')
    with pytest.raises(Exception, match="no JSON object"):
        readers.read_manifest(spark, f"{tmp_path}/m/split=train").collect()
    assert "none" in writers.text_report({"ERRORS": []}) and writers.missing_files(spark, [f"{tmp_path}/no"]) == [f"{tmp_path}/no"]


def test_messages(spark):
    df = spark.createDataFrame([("",), ("Ã x",), ("abc",)], "t string").select(validation.text_errors(F.col("t"), "abcx ").alias("e"))
    kinds = [[m.split(":")[0] for m in r.e] for r in df.collect()]
    assert kinds[0] == ["empty transcript"] and kinds[1][0] == "encoding problem in transcript" and kinds[2] == []


def _sound(seconds=2.0, rate=48_000, gain=1.0, noise=1e-4, edge=0.2, f0=190.0, seed=0):
    """A harmonic tone of five partials under a 4 Hz envelope, between silent edges."""
    n, quiet = int(seconds * rate), int(edge * rate)
    t = np.arange(n) / rate
    tone = sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 6)) * (0.6 + 0.4 * np.sin(2 * np.pi * 4 * t)) * 0.2 * gain
    x = np.concatenate([np.zeros(quiet), tone, np.zeros(quiet)])
    return np.clip(x + np.random.default_rng(seed).normal(0, noise, len(x)), -1, 1)


def _write(path, x, rate=48_000, width=3, channels=1):
    values = np.clip(np.round(np.repeat(x, channels) * (1 << 8 * width - 1)), -(1 << 8 * width - 1), (1 << 8 * width - 1) - 1).astype("<i4")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes(values.view(np.uint8).reshape(-1, 4)[:, :width].tobytes())


def test_validate_a_dataset(spark, tmp_path):
    """Every kind of defect, one file each, and the summary."""
    said = "bugün hava çok güzel ve şehir sakin"
    texts = {i: f"{said} {n}" for i, n in zip("ok1 ok2 short long clip silent lowsr dup mojibake leak corrupt sr44 stereo pcm16 mismatch noedge noisy missing empty0".split(), "abcçdefgğhıijklmnoö", strict=True)}
    texts |= {"emptytext": "", "mojibake": "gÃ¼zel bir gÃ¼n", "leak": "bu cümle ölçüm kümesinde aynen duruyor işte", "mismatch": " ".join([said] * 4), "ok2": f"{said} ve deniz"}
    for k, i in enumerate([*texts, "orphan"]):
        if i == "missing":
            continue
        x, rate, width, channels = _sound(seed=k), 48_000, 3, 1
        if i == "short":
            x = _sound(0.3, edge=0.02)
        elif i == "long":
            x = _sound(15.0)
        elif i == "clip":
            x = _sound(gain=5.0)
        elif i == "silent":
            x = np.zeros(3 * 48_000)
        elif i in ("lowsr", "sr44"):
            rate = 16_000 if i == "lowsr" else 44_100
            x = _sound(rate=rate, seed=k)
        elif i == "dup":
            x = _sound(seed=0)
        elif i == "noedge":
            x = x[int(0.25 * 48_000) :]
        elif i == "noisy":
            x = _sound(noise=0.02, seed=k)
        elif i == "empty0":
            x = np.zeros(0)
        width, channels = (2 if i == "pcm16" else width), (2 if i == "stereo" else 1)
        _write(tmp_path / f"{i}.wav", x, rate, width, channels)
    (tmp_path / "corrupt.wav").write_bytes((tmp_path / "ok2.wav").read_bytes()[:20])
    script = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts.items())], "id string, text string, pos long")
    evaluation = spark.createDataFrame([("bu cümle ölçüm kümesinde aynen duruyor işte",)], "text string")
    records = validation.validate(script, readers.read_wavs(spark, str(tmp_path)), evaluation, "abcçdefgğhıijklmnoöprsştuüvyz ").cache()
    got = {r.id: r for r in records.collect()}
    want = {
        "short": "too short", "long": "too long", "clip": "clipping", "silent": "no speech detected", "lowsr": "low sample rate", "dup": "duplicate audio", "emptytext": "empty transcript",
        "mojibake": "encoding problem in transcript", "leak": "evaluation-set leakage", "corrupt": "unreadable audio", "orphan": "no transcript for this audio file (id not in script)", "empty0": "empty audio (0 samples)",
    }
    assert {i: r.errors[0].split(":")[0] for i, r in got.items() if not r.accepted} == want
    noticed = {"sr44": "sample rate", "stereo": "channels", "pcm16": "bit depth", "mismatch": "speaking rate", "noedge": "no leading silence", "noisy": "low estimated SNR"}
    assert {i: w for i, w in noticed.items() if w not in [m.split(":")[0] for m in got[i].warnings]} == {}
    assert got["ok1"].errors == got["ok1"].warnings == got["ok2"].warnings == [] and got["noisy"].snr_db is None
    assert got["dup"].errors == ["duplicate audio: same samples as ok1"] and got["lowsr"].errors == ["low sample rate: 16000 Hz < 22050 Hz"] and got["short"].errors == ["too short: 0.34s < 0.5s"]
    assert got["sr44"].warnings == ["sample rate: 44100 Hz (expected 48000)"] and got["pcm16"].warnings == ["bit depth: PCM_16 (24-bit recommended)"]
    s = validation.summary(script, records)
    assert (s["script_entries"], s["audio_files"], s["missing_audio"], s["accepted"], s["rejected"], s["with_warnings"]) == (20, 20, 1, 8, 12, 6)
    assert s["sample_rates"] == {"48000": 17, "16000": 1, "44100": 1} and s["channels"] == {"1": 18, "2": 1} and s["subtypes"] == {"PCM_24": 18, "PCM_16": 1}
    assert s["error_types"]["duplicate audio"] == 1 and s["warning_types"]["speaking rate"] >= 1 and s["letter_counts"]["ç"] >= 8 and s["accepted_audio"]["n"] == 8
    assert readers.read_wavs(spark, f"{tmp_path}/none").count() == 0
