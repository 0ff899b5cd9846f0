"""From texts to splits: faults are looked for once, where the texts are read."""

import random

import numpy as np
import pyarrow as pa
import pytest
from compare import oracle, rows_of
from pyspark.sql import functions as F

from curalith import plans
from curalith.functions import text
from curalith.operators import leak, validation

SF = "/root/testdata/sf0.001"


def _joined(plan) -> list[set[str]]:
    """The names of the columns that come into each side of each join of a plan."""
    sides = [plan.children().apply(k) for k in range(plan.children().size())]
    own = [{s.output().apply(k).name() for k in range(s.output().size())} for s in sides] if plan.nodeName() == "Join" else []
    return own + [x for s in sides for x in _joined(s)]


def test_a_text_is_searched_once_for_characters_outside(spark):
    df = spark.createDataFrame([("", "x"), ("Ã ж", None), ("Ã ж", "a b"), ("abc", "a b"), ("abc", None), (None, None), (None, "y")], "t string, leak string")
    found = df.select(validation.text_errors(F.col("t"), "Aabcx ", F.col("leak")).alias("e"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1
    mojibake, outside, shared = "encoding problem in transcript: Ã", "unmappable characters: ж", "evaluation-set leakage: a b"
    assert [r.e for r in found.collect()] == [["empty transcript"], [mojibake, outside], [mojibake, outside, shared], [shared], [], ["empty transcript"], ["empty transcript"]]
    large = spark.read.parquet(f"{SF}/documents.parquet").select(validation.text_errors(F.col("text"), "abcx ", F.col("source")).alias("e"))
    assert large._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1


def test_texts_do_not_come_to_the_join_of_their_leaks(spark):
    sides = _joined(plans.QUERIES["validation_flags"](spark, SF)._jdf.queryExecution().optimizedPlan())
    assert sides[:2] == [{"doc_id", "own"}, {"doc_id", "first_gram"}]


def test_runs_of_characters_are_the_class(spark):
    assert text.char_runs("ab") == r"[\x{61}\x{62}]+" and text.char_runs("жз") == r"[\x{436}-\x{437}]+"
    chars = [*map(chr, range(1, 0x500)), " ", "\U00010400", "\U0001f600"]
    for listed in ("ab ]^-\\&[ÿĀж", "é", "Ā\U00010400", "".join(chars[::3])):
        df = spark.createDataFrame([("".join(chars),), (None,), ("",)], "t string")
        got = [r[0] for r in df.select(F.regexp_replace("t", text.char_runs(listed), "")).collect()]
        assert got == ["".join(c for c in chars if c not in listed), None, ""]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_runs_stay_inside_their_rows(n):
    rng = random.Random(n)
    rows = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(k)] for k in (0, 2, 7, 0, n, n - 1, 9, 0)] + [None]
    other = [r and [x ^ 12345 for x in r] for r in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))], names=["key", "h", "g"])

    def whole(table):
        # hashes that don't depend on the rows before
        got = [b.to_pylist() for b in leak._found_runs(n, table)([batch])]
        return [(r["key"], r["at"], r["a"], r["b"]) for b in got for r in b]

    alone = lambda row, seed: leak._run_hashes(np.array(row, np.int64).view(np.uint64), n, seed).view(np.int64).tolist()
    want = [(k, at, a, b) for k, row in enumerate(rows) if row for at, (a, b) in enumerate(zip(alone(row, 0), alone(other[k], 1), strict=True))]
    assert whole(None) == want and whole(np.full(16, (1 << 64) - 1, np.uint64)) == want and whole(np.zeros(16, np.uint64)) == []
    assert leak._run_hashes(np.arange(n - 1, dtype=np.uint64), n, 0).tolist() == []


def test_odd_texts_against_the_sql(spark, tmp_path):
    leaking = "one two three four five six"
    texts = [None, "", " ", leaking, f"Ã {leaking}", "w x", "Ã", "ПРИВЕТ abc", "abc\ndef", *[f"metin {k % 37}" for k in range(150)], "METIN 1", "Metin 2"]
    rows = [(k, t, [None, "de", "en"][k % 3], f"src{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/made")
    spark.read.parquet(f"{tmp_path}/made").toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, f"zero {leaking}"), (2, None)], "item_id long, text string").toPandas().to_parquet(f"{tmp_path}/benchmark.parquet")
    for name in ("validation_flags", "error_types", "split_info", "unmappable"):
        got = plans.QUERIES[name](spark, str(tmp_path)).toPandas()
        assert rows_of(got) == rows_of(oracle(plans.ORACLE[name], str(tmp_path))), name
