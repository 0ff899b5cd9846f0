import numpy as np
import pytest
from compare import oracle, rows_of
from pyspark.sql import functions as F

from curalith.llm import op13_dual_tree as op13

SHAPE = "vec_id long, embedding array<float>, label int, cell string, aid double, score int, v string"


def brute_force(rows, every, positives=5, negatives=5):
    x = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(c is not None and np.isfinite(c) for c in v):
            x[(i, label, tuple(np.floor(256 * np.array(v, np.float32).astype(float)).astype(int).tolist()))] = None
    x, out = list(x), []
    m = np.array([v for *_, v in x])
    for k, (i, label, _) in enumerate(x):
        if i % every:
            continue
        s = (m @ m[k]).tolist()
        order = sorted((j for j in range(len(x)) if j != k), key=lambda j: (-s[j], x[j][0]))
        for p in [j for j in order if x[j][1] == label][:positives]:
            fit = [j for j in order if x[j][1] != label and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:negatives]
            out += [(i, x[p][0], r + 1, x[j][0], s[p], s[j]) for r, j in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, clustered):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 8)) * 0.3
    if clustered:
        x = r.normal(size=(20, 8))[r.integers(0, 20, n)] + x * 0.2
    x[n // 4 : n // 2] = x[n // 4]  # a very common vector
    return [(k, v.astype("float32").tolist(), int(r.integers(0, 4))) for k, v in enumerate(x)]


@pytest.mark.parametrize(("clustered", "cell_rows"), [(False, 65_536), (True, 30), (False, 60)])
def test_op13_against_brute_force(spark, monkeypatch, clustered, cell_rows):
    for name, value in (("SHARD", 100), ("BLOCK", 20), ("LEAF", 8), ("ANCHOR_LEAF", 4), ("CELL_ROWS", cell_rows), ("AHEAD", 1)):
        monkeypatch.setattr(op13, name, value)
    rows = vectors(3, 500, clustered)
    rows += [(500, None, 1), (505, [float("nan")] * 8, 1), (510, [1.0, None] + [0.0] * 6, 1), (515, [float("inf")] * 8, 2), (520, [1.0] * 8, None), (None, [1.0] * 8, 1), (525, [0.0] * 8, 1), (530, [0.0] * 8, 2), (535, [-0.001] * 8, 1), (-5, rows[10][1], 3)]
    rows += [rows[5], rows[5], (10, rows[11][1], rows[10][2]), (10, rows[12][1], 7), (540, [2.0] * 8, 99)]
    df = spark.createDataFrame([(*r, "x", 1.0, 2, "y") for r in rows], SHAPE)
    got = op13.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted(tuple(r) for r in got) == brute_force(rows, 5)


def test_op13_few_rows(spark):
    df = lambda rows: spark.createDataFrame([(*r, "x", 1.0, 2, "y") for r in rows], SHAPE)
    assert op13.hard_negatives(df([]), F.lit(True)).count() == 0
    assert op13.hard_negatives(df([(1, [1.0], 1), (2, None, 2)]), F.lit(True)).count() == 0
    three = [(1, [1.0, 0.0], 1), (2, [1.0, 0.5], 1), (3, [0.9, 0.1], 2), (4, [1.0], 1)]
    assert sorted(tuple(r) for r in op13.hard_negatives(df(three), F.lit(True)).collect()) == brute_force(three[:3], 1)
    with pytest.raises(Exception, match="too large"):
        op13.hard_negatives(df([(1, [1e30, 1.0], 1)]), F.lit(True)).collect()


def test_op13_trees_prune_without_loss():
    """Intervals hold all inner products, and clustered data leave most pairs of leaves out."""
    r = np.random.default_rng(1)
    x = (r.normal(size=(30, 16))[r.integers(0, 30, 3000)] * 100 + r.normal(size=(3000, 16)) * 3).round()
    labels = r.integers(0, 3, 3000)
    order = op13.tree_order(x, labels, 8)
    c = op13.Tree(x[order], labels[order], 8)
    order = op13.tree_order(x[:2000], labels[:2000], 8)
    q = op13.Tree(x[:2000][order], labels[:2000][order], 8)
    scores = q.x @ c.x.T
    for level in range(q.depth + 1):
        low, high = op13.interval(q.balls[level][:3], c.balls[level][:3])
        for axis, tree in ((0, q), (1, c)):
            first = tree.bounds[level][:-1]
            scores_low = np.minimum.reduceat(scores if axis == 0 else scores_low, first, axis=axis)
            scores_high = np.maximum.reduceat(scores if axis == 0 else scores_high, first, axis=axis)
        assert (low <= scores_low).all() and (high >= scores_high).all()
    need = np.sort(scores, axis=1)[:, -6]
    alive, _ = op13.open_pairs(q, c, need, np.full(2000, op13.LARGE), same=True)
    assert alive.mean() < 0.25


def test_op13_matches_sql(spark):
    d = "/root/testdata/sf0.01"
    got = op13.op13_dual_tree(spark, d).toPandas()
    assert len(got) and rows_of(got) == rows_of(oracle(op13.ORACLE_SQL, d))
