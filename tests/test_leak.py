"""Leaks against plain Python, and what the filter lets pass."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curalith.functions.text import words
from curalith.operators import leak, validation


def _plain(text, n):
    w = [x.strip(".,;:!?'\"") for x in (text or "").lower().split()]
    w = [x for x in w if x]
    return [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]


def _texts(seed, n, size):
    r = random.Random(seed)
    pool = ["ev", "çok", "güzel", "ŞEHİR".lower(), "deniz", "kitap", "yol", "sakin", "hava", "日本", "été", "bir"]
    return [" ".join(r.choice(pool) + r.choice(["", "", ",", "!", " -"]) for _ in range(r.randint(0, size))) for _ in range(n)]


@pytest.mark.parametrize(("bits", "few", "width"), [(24, 500_000, 5), (1, 500_000, 3), (24, 0, 4)])
def test_leaks_against_plain_python(spark, monkeypatch, bits, few, width):
    monkeypatch.setattr(leak, "FILTER_BITS", bits)
    monkeypatch.setattr(leak, "BROADCAST_RUNS", few)
    docs, evaluation = [*_texts(1, 200, 40), None, "", "bir"], [*_texts(2, 12, 30), None, "Bir ev, çok GÜZEL; deniz"]
    known = {g for t in evaluation for g in _plain(t, width)}
    want = {k: (len(own), min(own)) for k, t in enumerate(docs) if (own := set(_plain(t, width)) & known)}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    found = leak.ngram_leaks(df, spark.createDataFrame([(t,) for t in evaluation], "text string"), width)
    assert {r.doc_id: (r.n_shared, r.first_gram) for r in found.collect()} == want and want
    assert leak.ngram_leaks(df, spark.createDataFrame([], "text string")).count() == 0
    assert leak.ngram_leaks(df.limit(0), spark.createDataFrame([(t,) for t in evaluation], "text string")).count() == 0


def test_only_what_passes_the_filter_is_shuffled(spark):
    """Many runs that aren't the evaluation's: nearly none of them becomes a row."""
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    evaluation = spark.createDataFrame([(text(400),) for _ in range(100)], "text string")
    docs = spark.createDataFrame([(k, text(500)) for k in range(400)], "doc_id long, text string")
    known = leak._runs(evaluation, F.lit(0), words(F.col("text")), 5)
    blocks = leak.run_filter(known, known.count())
    passed = leak._runs(docs, F.col("doc_id"), words(F.col("text")), 5, blocks).count()
    assert passed < 0.01 * 400 * 496
    assert leak._runs(evaluation, F.lit(0), words(F.col("text")), 5, blocks).count() == known.count()  # none is missed
    assert len(blocks) * 64 <= 64 * 100 * 396 and np.bitwise_count(blocks).mean() < 32


def test_letters_are_counted_in_bytes(spark):
    texts = [*_texts(7, 50, 30), None, "", "ÇĞİ çğı"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    low = [r.t for r in df.select(F.lower("text").alias("t")).collect() if r.t]
    got = {r.letter: r.n for r in validation.letter_counts(df, "abçğıiz日é").collect()}
    assert got == {c: sum(t.count(c) for t in low) for c in "abçğıiz日é"}
    assert {r.letter: r.n for r in validation.letter_counts(df.limit(0), "aç").collect()} == {"a": 0, "ç": 0}
