import random
import re

import numpy as np
import pytest
import xxhash
from llm.conftest import AWKWARD, BASE, words

from curalith.llm import op12_simhash_variants as op12


def fingerprint(text, width):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [w[k : k + width] for k in range(len(w) - width + 1)] if len(w) >= width else [w] if w else []
    h = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(ids, fps):
    """Of each row its component's least id, by all pairs; None without an id."""
    fps = np.array(fps, np.uint64)
    known = [k for k, i in enumerate(ids) if i is not None]
    label = {k: ids[k] for k in known}
    pairs = [(known[x], known[y]) for x, y in zip(*np.nonzero(np.bitwise_count(fps[known][:, None] ^ fps[known]) <= 4), strict=True)] + [(x, y) for x in known for y in known if ids[x] == ids[y]]
    while True:
        before = dict(label)
        for x, y in pairs:
            label[x] = label[y] = min(label[x], label[y])
        if before == label:
            return [label.get(k) for k in range(len(ids))]


def brute_force(rows, width):
    fps = [fingerprint(t, width) for _, t in rows]
    return [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, labels([i for i, _ in rows], fps), strict=True)]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0))


def edited(seed):
    r, out = random.Random(seed), BASE.split()
    for _ in range(r.randint(1, 3)):
        out[r.randrange(len(out))] = "edited"
    return " ".join(out)


ROWS = [*AWKWARD, *[(100 + k, edited(k)) for k in range(150)], *[(400 + k, words(50 + k, k % 7)) for k in range(80)], (600, BASE.upper().replace(" ", " \t")), (601, "a b c"), (602, "a\x0bb c d"), (603, "a b")]


def near_copies(n):
    """Documents of many words of which each differs from the first by a few."""
    r, base = random.Random(3), words(9, 400).split()
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"new{r.randrange(50)}"
        out.append((2000 + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("width", "paired", "budget", "hot"), [(4, 48, 10**9, 10**6), (5, 2, 200, 10**6), (4, 2, 10**9, 60)])
def test_op12_against_brute_force(spark, documents, monkeypatch, width, paired, budget, hot):
    for name, value in (("PAIRED", paired), ("BUDGET", budget), ("HOT", hot), ("PAIRS", 500), ("HOT_SHARE", 50)):
        monkeypatch.setattr(op12, name, value)
    rows = ROWS + near_copies(120)
    assert ordered(op12.simhash_components(documents(rows).repartition(5), width).collect()) == ordered(brute_force(rows, width))


def test_op12_empty_and_long(documents):
    assert op12.simhash_components(documents([])).count() == 0
    long = words(1, 1_000_000)  # 6 MB
    r = op12.simhash_components(documents([(3, long), (1, long + " x"), (2, None), (7, "")])).orderBy("doc_id").collect()
    assert [x.component_id for x in r] == [1, 2, 1, 2] and r[1].fingerprint == "0" * 16
    one = op12.simhash_components(documents([(1, "w" * 6_000_000)])).first()
    assert one.fingerprint == f"{xxhash.xxh64(b'w' * 6_000_000, seed=42).intdigest():016x}"


@pytest.mark.parametrize(("budget", "hot"), [(10**9, None), (3000, None), (10**9, 100)])
def test_op12_links_connect_what_is_near(monkeypatch, budget, hot):
    """The search for near fingerprints without Spark: random ones, chains, and a ball of many."""
    import pyarrow as pa

    monkeypatch.setattr(op12, "BUDGET", budget)
    u, r = np.uint64, np.random.default_rng(0)
    flipped = lambda x, k: x ^ np.bitwise_or.reduce([u(1) << r.integers(0, 64, len(x)).astype(u) for _ in range(k)])
    base = r.integers(0, 1 << 63, 150, dtype=np.int64).view(u)
    fps = np.unique(np.concatenate([base, *[flipped(base, k) for k in (1, 2, 3, 4, 4)], flipped(np.full(300, 5, u), 3), flipped(np.full(30, 5, u), 5)]))
    warm = {m: np.array([v for v in np.unique(fps & u(m)) if (fps & u(m) == v).sum() > hot], u) for m in op12.segments(op12.ALL)} if hot else {}
    dealt, a, b, levels = list(op12._first(5, warm)([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], names=["fp"])])), [], [], 0
    for level in range(1, op12.LEVELS + 1):
        buckets, more = {}, []
        for batch in dealt:
            for k, raw in zip(batch.column("bucket").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                buckets.setdefault(k, []).append(raw)
        for raws in buckets.values():
            for out in op12._met(level == op12.LEVELS)([pa.RecordBatch.from_arrays([pa.array(raws, pa.binary())], names=["payload"])]):
                if out.column("fps").null_count:
                    a.append(out.column("a").to_numpy().view(u))
                    b.append(out.column("b").to_numpy().view(u))
                else:
                    more.append(out)
        levels += 1
        if not more:
            break
        dealt = list(op12._again(5)(more))
    assert levels > 1 or budget > 3000
    a, b = np.searchsorted(fps, np.concatenate(a)), np.searchsorted(fps, np.concatenate(b))
    near = np.bitwise_count(fps[:, None] ^ fps) <= 4
    assert near[a, b].all()

    def component(x, y):
        label = np.arange(len(fps))
        while True:
            new = label.copy()
            np.minimum.at(new, x, label[y])
            np.minimum.at(new, y, label[x])
            if (new == label).all():
                return label.tolist()
            label = new

    assert component(a, b) == component(*np.nonzero(near))


def test_op12_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(op12.op12_simhash_variants(spark, d).collect()) == ordered(brute_force(rows, 4))
