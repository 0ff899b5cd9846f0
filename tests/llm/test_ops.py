"""Each operator on awkward rows and an empty table, against brute force where there is one."""

import base64
import json
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import zstandard
from llm.conftest import AWKWARD, BASE, words
from pyspark.sql import functions as F

from curalith.llm import op1_multi_index_hashing as op1
from curalith.llm import op2_toxicity as op2
from curalith.llm import op3_suffix_dedup as op3
from curalith.llm import op4_best_fit_packing as op4
from curalith.llm import op5_chat_format as op5
from curalith.llm import op6_paragraph_minhash as op6
from curalith.llm import op7_ngram_jaccard_join as op7
from curalith.llm import op8_multiset_hash as op8
from curalith.llm import op9_token_files as op9
from curalith.llm import op10_byte_bpe as op10
from curalith.llm.graph import components
from curalith.llm import storage
from curalith.llm.storage import new_folder

WORD_BPE = P.path("word_bpe_49k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids


def _word_sets(text, width):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def test_op1_finds_the_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16))
    x[100:400] = x[100]  # a very common vector
    x[7] *= 3
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0, None] + [0.0] * 14), (2080, [1.0])]
    df = spark.createDataFrame([(*r, "x", 1.0, 2) for r in [*rows, rows[3]]], "vec_id long, embedding array<float>, a string, v double, ids int")
    got = op1.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    y = x.astype("float32").astype(float)
    found = total = 0
    for q in range(0, 1500, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(1500), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 1e-12).all()
        assert np.allclose(mine.score, y[mine.vec_id] @ y[q])
        found += len(set(want) & set(mine.vec_id))
        total += 20
    assert found / total >= 0.9 and set(got.query_id) == set(range(0, 1500, 20))
    assert op1.nearest(df.limit(0), F.lit(True)).count() == 0
    few = op1.nearest(df.filter("vec_id < 5"), F.lit(True)).groupBy("query_id").count().collect()
    assert {r["count"] for r in few} == {4}


def test_op1_probes_find_all_within_the_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 16, (3000, 8)).astype(np.uint16)
    codes[1000:] = codes[rng.integers(0, 1000, 2000)] ^ (1 << rng.integers(0, 16, (2000, 8)).astype(np.uint16))
    shard = op1.Shard(codes)
    for radius in (0, 7, 8, 15, 40, 57, 128):  # few values near the query, and more than the table holds
        for one in codes[::300]:
            assert shard.within(one, radius).tolist() == np.flatnonzero(op1.distances(codes, one) <= radius).tolist()


def test_op1_copies_of_a_query_row(spark):
    x = np.random.default_rng(1).normal(size=(200, 16)).astype("float32")
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist())] * 2 + [(20, x[20].tolist())] * 29 + [(40, (x[40] * (1 + k / 100)).tolist()) for k in range(1, 4)]
    got = op1.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id").isin(0, 20)).collect()
    assert {q: sorted(r["rank"] for r in got if r.query_id == q) for q in (0, 20)} == dict.fromkeys((0, 20), list(range(1, 21)))
    assert all(r.vec_id != r.query_id for r in got)
    several = op1.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 40).groupBy("query_id").count().collect()
    assert [r["count"] for r in several] == [80]


def test_op2_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    scored = op2.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (scored.predicted == scored.toxic).mean() > 0.97
    assert scored.score.between(0, 1).all()


def test_op2_grammar_and_awkward_rows(spark, documents):
    g = op2.Grammar({"idiot": 3.0, "scum*": 2.0}, op2.PRIOR, op2.PRIOR_BIAS)
    assert g.score("you idiot") > g.score("idiot") > g.score("he said idiot") > g.score("not an idiot") > g.score("fine text")
    assert g.score("scumbags") > g.score("not scummy") and g.score("") == g.score("nothing")
    docs = documents(AWKWARD)
    untrained = op2.trained_on(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert docs.select(op2.toxic_score(untrained)(F.col("text"))).count() == len(AWKWARD)
    one_class = op2.trained_on(docs, spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int"))
    assert all(0 <= r[0] < 0.5 for r in docs.select(op2.toxic_score(one_class)(F.col("text"))).collect())
    assert documents([]).select(op2.toxic_score(one_class)(F.col("text"))).count() == 0
    assert 0 <= g.score("you idiot " * 300_000) <= 1


def test_op2_machine_against_its_parts():
    """The composed tables and the distance against a walk through the parts, word by word."""
    rng = np.random.default_rng(0)
    g = op2.Grammar({"idiot": 3.0, "scum*": 2.0}, op2.PRIOR, op2.PRIOR_BIAS)
    pool = ["idiot", "scumbag", "kill", "you", "not", "said", "word", "other", "the", "x"]
    for _ in range(300):
        text = " ".join(rng.choice(pool, rng.integers(1, 14))) + rng.choice(["", ".", "; the end"])
        taken, total = Counter(), 0.0
        for clause in re.split(r"[.;]", text):
            words_, here = clause.split(), 0.0
            for k, w in enumerate(words_):
                kind = "I" if w in ("idiot", "scumbag") else "H" if w == "kill" else None
                if kind:
                    before = words_[max(0, k - op2.REACH) : k]
                    arc = kind + "".join(m for m, opener in (("n", "not"), ("r", "said"), ("a", "you")) if opener in before)
                    scale = {"idiot": 3.0, "scumbag": 2.0, "kill": 1.0}[w]
                    taken[arc] += scale
                    here += scale * op2.PRIOR[arc]
            total += here
        assert np.allclose(g.arcs(text)[:-1], np.log1p([taken[a] for a in op2.ARCS]))
        assert np.isclose(sum(d for _, d in g.clauses(text)), total)
    # several arcs for one symbol: the best of all paths, by listing them
    two = op2.Transducer((0,), {(0,): {"a": [op2.Arc("b", "p", (0,)), op2.Arc("c", "q", (1,))]}, (1,): {"a": [op2.Arc("b", "r", (0,))]}})
    own = two.compose(op2.Transducer((0,), {(0,): {"b": [op2.Arc("d", "", (0,))], "c": [op2.Arc("d", "", (0,)), op2.Arc("e", "", (1,))]}, (1,): {"b": [op2.Arc("d", "", (0,))]}}))
    weights = {"p": 1.0, "q": -2.0, "r": 7.0}

    def paths(state, left):
        return [0.0] if not left else [weights[a.weight] + rest for a in own.arcs[state].get("a", []) for rest in paths(a.to, left - 1)]

    assert all(own.distance([("a", 1.0)] * n, weights) == max(paths(own.start, n)) for n in range(1, 6))


def _repeats(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if i is not None:
                first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            k = first.get(b[p : p + length])
            if k is not None and (i is None or k < i):
                gone[p : p + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_op3_against_brute_force(spark, documents):
    rows = AWKWARD + [(20, "x" * 400), (21, "y" + "x" * 300 + "z"), (22, "ab" * 100), (23, words(9, 30) + BASE[10:90] + words(8, 20)), (24, BASE[100:149])]
    assert sorted(map(tuple, op3.remove_repeats(documents(rows)).collect()), key=repr) == _repeats(rows)
    assert op3.remove_repeats(documents([])).count() == 0


@pytest.mark.parametrize("hot_runs", [0, 12])
def test_op3_hot_anchors(spark, documents, monkeypatch, hot_runs):
    monkeypatch.setattr(op3, "HOT_RUNS", hot_runs)
    line = words(70, 14)  # in most documents, in other surroundings each
    rows = [(i, f"{words(100 + i, 12)} {line if i % 3 else line[: 40 + i]} {words(200 + i, 12)}") for i in range(40)]
    rows += AWKWARD + [(60, rows[4][1]), (61, line), (61, line), (62, line[1:])]
    assert sorted(map(tuple, op3.remove_repeats(documents(rows)).collect()), key=repr) == _repeats(rows)


def test_op3_blind_trie():
    rng = np.random.default_rng(0)
    data = np.concatenate([rng.integers(97, 99, 4000).astype(np.uint8), np.zeros(8, np.uint8)])
    data[:3000] = np.tile(data[:500], 6)  # long common prefixes
    starts = np.arange(3900)
    order, first = op3.equal_strings(data, starts, 50)
    keys = [data[s : s + 50].tobytes() for s in starts[order]]
    groups = {}
    for place, k in enumerate(keys):
        groups.setdefault(k, set()).add(int(first[place]))
    assert all(len(g) == 1 for g in groups.values()) and len({*map(min, groups.values())}) == len(groups)


def _payload(runs):
    """What a chunk sends of its runs (text, least id)."""
    texts = [t.encode() for t, _ in runs]
    return zstandard.compress(np.int64(len(runs)).tobytes() + np.array([i for _, i in runs], np.int64).tobytes() + np.array([len(t) - 49 for t in texts], np.uint32).tobytes() + b"".join(texts))


def test_op3_sorts_only_unlike_runs_of_an_anchor(monkeypatch):
    """Before, every string of every chunk was sorted, copies included."""
    sorted_strings = []
    whole = op3.equal_strings
    monkeypatch.setattr(op3, "equal_strings", lambda data, starts, length: sorted_strings.append(len(starts)) or whole(data, starts, length))
    copies = [(words(400 + k, 30)[:60], k) for k in range(50)]
    chunks = [[(t, i + 100 * c) for t, i in copies] for c in (3, 1, 2)]
    batch = pa.RecordBatch.from_pydict({"bucket": [0] * 3, "chunk": [0, 1, 2], "payload": [_payload(x) for x in chunks]})
    answers = [a for b in op3._least_ids(50)([batch]) for a in b.column("answer").to_pylist()]
    assert [op3._stretched(a).tolist() for a in answers] == [[i + 100 for _, i in copies for _ in range(11)]] * 3
    assert not sorted_strings


@pytest.mark.parametrize("at_once", [1, 100, 1 << 20])
def test_op3_least_ids_of_strings(monkeypatch, at_once):
    monkeypatch.setattr(op3, "SORTED", at_once)
    lines = [words(500 + k, 30)[:90] for k in range(5)] + ["x" * 120, "ab" * 60]
    ends = [words(600 + k, 9)[:20] for k in range(40)]
    texts = [*{(ends[k] + lines[k % 7] + ends[-k])[k % 21 : 50 + 20 * (k % 4) + k].encode() for k in range(40)}]
    texts = [t for t in texts if len(t) >= 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    first, many, _, doc = op3.runs(data, np.cumsum([0, *map(len, texts)]), 50)
    runs = [*dict.fromkeys(data[f : f + n + 49].tobytes() for f, n in zip(first, many, strict=True))]
    best = np.random.default_rng(1).permutation(len(runs))
    least = {}
    for r, i in zip(runs, best.tolist(), strict=True):
        for k in range(len(r) - 49):
            least[r[k : k + 50]] = min(least.get(r[k : k + 50], i), i)
    ids, sizes, at, stretches = op3.least_of_strings(runs, best, 50)
    for k, r in enumerate(runs):
        own = slice(at[k], at[k] + stretches[k])
        assert np.repeat(ids[own], sizes[own]).tolist() == [least[r[j : j + 50]] for j in range(len(r) - 49)]


def test_op3_sends_a_row_to_each_partition(spark, documents, monkeypatch):
    """Before, a chunk sent four rows to each partition; rows grow with chunks times buckets."""
    buckets, whole = [], op3._texts
    monkeypatch.setattr(op3, "_texts", lambda length, n: buckets.append(n) or whole(length, n))
    assert op3.remove_repeats(documents(AWKWARD)).count() == len(AWKWARD)
    assert buckets == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_op4_packs_everything(spark, documents):
    rows = AWKWARD + [(100 + k, words(k, 30 + 37 * k % 400)) for k in range(60)] + [(99, words(99, 6000))]
    got = op4.pack_documents(documents(rows), WORD_BPE).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*_ids(t), 1]
        for p, lo in enumerate(range(0, len(ids), 4096)):
            want[(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(np.array(ids[lo : lo + 4096], "<u4").tobytes()))] += 1
    mine = Counter((None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    assert mine == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 4096
    assert got.sequence_id.nunique() <= -(-int(got.length.sum()) // 4096) + 1
    assert op4.pack_documents(documents([]), WORD_BPE).count() == 0


def test_op4_crossover_keeps_items():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 60).tolist()
    a, b = (op4._individual(np.frombuffer(g, np.int32), sizes, 100) for g in op4.evolve(sizes, [], 100, 3)[:2])
    bins, room = op4.crossover(a, b, sizes, 100, rng)
    assert sorted(i for own in bins for i in own) == list(range(60)) and all(r == 100 - sum(sizes[i] for i in own) >= 0 for own, r in zip(bins, room, strict=True))


def test_op5_round_trip_and_layouts(spark):
    texts = ["<|im_end|>", "<\\|x<\\\\|", "", None, "a\n<|nl|>", "<"]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(["user", "assistant", None, "assistant", "ro\nle", "assistant"], texts, strict=True))] + [(None, None, "user", "x"), (1, 0, "user", "<|im_end|>")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in op5.read_back(op5.assembled(op5.in_order(op5.formatted_turns(op5.typed_turns(turns, "conv_id"))))).collect()}
    said = "".join(t or "" for (_, _, r, t) in rows[:6] if r == "assistant")
    assert got[1].n_turns == 7 and got[1].loss_chars == len(said) and got[1].loss_sha256 == sha256(said.encode()).hexdigest() and got[None].n_turns == 1
    records = [{"messages": [{"role": "human", "content": "a"}, {"role": "gpt", "content": "b"}]}, {"conversations": [{"from": "human", "value": "q"}]}, {"instruction": "i", "input": "x", "output": "o"}, {"prompt": "p", "completion": "c", "extra": 1}, {"odd": 1}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "{"), (10, None)], "id long, j string")
    out = Counter((r.conv_id, r.layout) for r in op5.json_turns(df, "id", "j").collect())
    assert out == {(0, "messages"): 2, (1, "from_value"): 1, (2, "instruction_input"): 2, (3, "prompt_completion"): 2, (4, None): 1, (9, None): 1, (10, None): 1}
    with pytest.raises(ValueError, match="no mapping"):
        op5.typed_turns(df, "id")
    odd = spark.createDataFrame([(k, json.dumps({"role": "user", "text": "x", "turn": t})) for k, t in enumerate([3, "4", "x", None, [1], 1e300, 10**30])], "id long, j string")
    assert {r.conv_id: r.turn for r in op5.json_turns(odd, "id", "j").collect()} == {0: 3, 1: 4, 2: None, 3: None, 4: None, 5: None, 6: None}
    assert op5.read_back(op5.assembled(op5.in_order(op5.formatted_turns(op5.typed_turns(turns.limit(0), "conv_id"))))).count() == 0


def test_op5_output_is_read_by_its_marks(spark, monkeypatch):
    monkeypatch.setattr(op5, "PIECE", 7)  # pieces that end inside marks
    turns = spark.createDataFrame([(1, k, r, op5.CONTROL * n) for k, (r, n) in enumerate([("user", 1), ("assistant", 3), ("assistant", 0), ("user", 2)])], "conv_id long, turn long, role string, text string")
    formatted = op5.in_order(op5.formatted_turns(turns))
    pieces = op5.assembled(formatted).collect()
    whole = "".join(r.text for r in sorted(pieces, key=lambda r: r.piece))
    assert len(pieces) > 30 and "".join(op5.unescape(whole[x.start : x.start + x.length]) for r in pieces for x in r.loss) == op5.CONTROL * 3
    got = op5.read_back(op5.assembled(formatted)).first()
    assert (got.n_turns, got.loss_chars, got.formatted_chars) == (4, 3 * len(op5.CONTROL), len(whole))
    broken = op5.Reader()  # a text whose marks aren't escaped makes other turns
    broken.feed(f"{op5.START}user\n{op5.CONTROL}{op5.END}\n{op5.START}x", [])
    with pytest.raises(ValueError, match="last mark"):
        broken.row(1)


def test_op5_matches_sql(spark):
    from compare import oracle, rows_of

    d = "/root/testdata/sf0.001"
    assert rows_of(op5.op5_chat_format(spark, d).toPandas()) == rows_of(oracle(op5.ORACLE_SQL, d))


def _paragraph_clusters(rows):
    units = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            if len(line.split()) >= op6.MIN_WORDS:
                units.append((i, k, _word_sets(line, 5)))
    up = list(range(len(units)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(units)):
        for b in range(a):
            n = len(units[a][2] & units[b][2])
            if 100 * n >= 80 * (len(units[a][2]) + len(units[b][2]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    size = Counter(map(top, range(len(units))))
    return {(units[u][0], units[u][1], units[top(u)][0]) for u in range(len(units)) if size[top(u)] > 1}


@pytest.mark.parametrize("hot", [2000, 4])
def test_op6_against_brute_force(spark, documents, monkeypatch, hot):
    monkeypatch.setattr(storage, "HOT_SHARE", hot)
    near = BASE.replace(BASE.split()[60], "changed")
    rows = [r for r in AWKWARD if r[0] != 4] + [(30, "short line\n" + near + "\nend"), (31, BASE + "\n" + BASE), (32, words(7, 25) + "\n" + near), (4, words(2, 40))]
    got = op6.repeated_paragraphs(documents(rows)).collect()
    assert {(r.doc_id, r.paragraph, r.first_doc_id) for r in got} == _paragraph_clusters(rows)
    kept = {r.doc_id: r.text for r in op6.without_repeats(documents(rows)).collect()}
    assert kept[30] == "short line\nend" and kept[31] == "" and kept[-3] == dict(rows)[-3] and kept[None] == BASE and kept[5] is None
    assert op6.repeated_paragraphs(documents([])).count() == 0


def test_op6_passages_and_short_lines(spark, documents):
    passage, short = words(70, 51), words(71, 7)
    w = passage.split()
    rows = [
        (1, words(72, 90) + " " + passage + " " + words(73, 80)),
        (2, words(74, 70) + " " + passage + " " + words(75, 100) + "\n" + short),
        (3, words(76, 60) + " " + " ".join(w[:25]) + "\n" + " ".join(w[25:]) + " " + words(77, 90)),
        (4, "head\n" + short + "\n" + words(78, 60)),
        (5, "ha " * 100),
    ]
    got = op6.repeated_paragraphs(documents(rows)).collect()
    assert {(r.doc_id, r.paragraph, r.first_doc_id, r.removed, r.n_words) for r in got} == {(1, 0, 1, False, 51), (2, 0, 1, True, 51), (3, 0, 1, True, 51), (2, 1, 2, False, 7), (4, 1, 2, True, 7), (5, 0, 5, False, 25), (5, 0, 5, True, 75)}
    kept = {r.doc_id: r for r in op6.without_repeats(documents(rows)).collect()}
    assert kept[1].text == rows[0][1] and kept[2].text == words(74, 70) + " " + words(75, 100) + "\n" + short
    assert kept[3].text == words(76, 60) + " \n" + words(77, 90) and kept[4].text == "head\n" + words(78, 60)
    assert kept[5].text.split() == ["ha"] * 25 and all(r.n_chars == len(r.text) for r in kept.values())


def _components(rows, width, num):
    sets = [(i, _word_sets(t, width)) for i, t in rows]
    up = {i: i for i, _ in sets if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= num * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return Counter((i, len(s), None if i is None else top(i)) for i, s in sets)


@pytest.mark.parametrize("block, paired, probes", [(512, 48, 2048), (4, 2, 3)])
def test_op7_against_brute_force(spark, documents, monkeypatch, block, paired, probes):
    monkeypatch.setattr(op7, "BLOCK", block)
    monkeypatch.setattr(op7, "PROBES", probes)
    monkeypatch.setattr(storage, "HOT_SHARE", 2000 if block > 4 else 8)
    monkeypatch.setattr(op7, "PAIRED", paired)
    parts = BASE.split()
    chain = [(40 + k, " ".join(parts[k * 3 : k * 3 + 60])) for k in range(20)]  # each like its neighbours only
    rows = AWKWARD + chain + [(80 + k, BASE.replace(parts[k], f"w{k}")) for k in range(15)] + [(70, "a b"), (71, "A  b"), (72, "a b c")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in op7.jaccard_components(documents(rows), 4, 85, 100).collect())
    assert got == _components(rows, 4, 85)


def test_op7_empty(documents):
    assert op7.jaccard_components(documents([])).count() == 0


@pytest.mark.parametrize("part", [250_000, 3])
def test_components(spark, monkeypatch, part):
    from curalith.llm import graph

    monkeypatch.setattr(graph, "PART", part)
    chain = [(k, k + 1) for k in range(30)] + [(50, 40), (60, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(31), 0), 40: 40, 50: 40, 60: 40}


def test_op8_edits_and_equality(spark, documents):
    rows = [r for r in AWKWARD if r[0] != 4]
    got = op8.fingerprint_edits(documents(rows)).collect()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [r for r in rows if r[0] is None]
    by = {r.doc_id: r for r in got}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= by[i].near_edited <= 1 and 0 <= by[i].near_next <= 1
    assert by[1].fingerprint == by[2].fingerprint != by[3].fingerprint and by[5].fingerprint == by[6].fingerprint
    assert by[2].near_next == 1.0 and by[9].near_edited > 0.3 > by[9].near_next
    assert op8.fingerprint_edits(documents([])).count() == 0 and op8.fingerprint_edits(documents([(1, "ab cd")])).first().near_next == 1.0


@pytest.mark.parametrize("task_bytes", [1 << 26, 500])
def test_op8_order_over_blocks(spark, documents, monkeypatch, task_bytes):
    """The next document over many blocks, ids far apart and rows without an id, which are ordered by hash."""
    monkeypatch.setattr(op8, "TASK_BYTES", task_bytes)
    rows = [(i * i * 1000 - 5000, f"text {i} " + words(i, i % 9)) for i in range(150)] + [(None, f"no id {i}") for i in range(60)]
    hashes = {r.text: r.h for r in documents(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    order = [t for _, t in sorted((r for r in rows if r[0] is not None), reverse=True)] + sorted((t for i, t in rows if i is None), key=hashes.get)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    got = {r.text: r.next_text for r in op8.with_next(documents(rows)).collect()}
    assert got == following and op8.fingerprint_edits(documents(rows)).count() == len(rows)


def test_op8_lanes_and_likeness_against_brute_force(spark):
    """Fingerprints added up in Python from the hashes that Spark gives, and likeness from all pairs."""
    texts = [words(1, 300), words(1, 300).replace("a", "b", 40), words(2, 250) + "\n" + words(1, 80), "", "a b\na b"]
    got = {r.k: r for r in op8.fingerprints(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), ["k"]).collect()}
    lines = sorted({p for t in texts for p in t.split("\n")})
    hashed = spark.createDataFrame([(p,) for p in lines], "p string").select("p", *[F.xxhash64(F.lit(seed), "p").alias(f"h{seed}") for seed in range(op8.EXACT)]).collect()
    of = {r.p: [x for seed in range(op8.EXACT) for x in (r[f"h{seed}"] & op8.LANE, (r[f"h{seed}"] >> 32) & op8.LANE)] for r in hashed}
    bags = []
    for k, t in enumerate(texts):
        assert got[k].exact == [sum(of[p][lane] for p in t.split("\n")) & op8.LANE for lane in range(2 * op8.EXACT)]
        bags.append(Counter(pair for p in t.split("\n") for pair in zip(p.split(" "), [*p.split(" ")[1:], None], strict=True)))
        assert got[k].pairs == sum(bags[-1].values())
    # the seeded hashes are hashes of their own: none follows from another
    assert len({tuple(np.subtract(of[p][2:], of[p][:-2])) for p in lines}) == len(lines)
    rows = spark.createDataFrame([(i, j, *(got[i][x] for x in ("exact", "pairs", "lanes")), *(got[j][x] for x in ("exact", "pairs", "lanes"))) for i in range(3) for j in range(3)], "i int, j int, ea array<long>, pa long, la array<long>, eb array<long>, pb long, lb array<long>")
    for r in rows.select("i", "j", op8.likeness(*map(F.col, ("ea", "pa", "la", "eb", "pb", "lb"))).alias("s")).collect():
        a, b = bags[r.i], bags[r.j]
        true = 2 * sum(a[x] * b[x] for x in a) / (sum(x * x for x in a.values()) + sum(x * x for x in b.values()))
        assert r.s == 1.0 if r.i == r.j else abs(r.s - true) < 0.3


def test_op8_is_homomorphic(spark):
    rows = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\na b"), (3, "a b"), (4, "c d")], "k long, text string")
    p = {r.k: r for r in op8.fingerprints(rows, ["k"]).collect()}
    assert p[1].exact == p[2].exact and p[1].lanes == p[2].lanes
    whole = spark.createDataFrame([(p[3].exact, p[4].exact, p[1].exact)], "a array<long>, b array<long>, c array<long>")
    assert whole.select(op8.merged(F.col("a"), F.col("b")) == F.col("c"), op8.without(F.col("c"), F.col("b")) == F.col("a")).first() == (True, True)


def test_op8_long_runs_of_equal_pairs(spark, documents):
    rows = [(1, " " * 40_000), (2, "\n" * 40_000), (3, "a " * 40_000), (4, "a " * 40_000)]
    got = {r.doc_id: r for r in op8.fingerprint_edits(documents(rows)).collect()}
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [40_000, 40_000, 80_000, 80_000]
    assert got[3].fingerprint == got[4].fingerprint and got[4].near_next == 1.0 and len({got[i].fingerprint for i in (1, 2, 3)}) == 3
    assert [int(got[i].fingerprint.split("-")[1], 16) for i in (1, 2, 3)] == [40_001, 40_001, 40_001]


def test_op9_files(spark, documents):
    rows = [r for r in AWKWARD if r[0] is not None]
    path = new_folder(spark, "test")
    op9.write_tokens(documents(rows), path, WORD_BPE)
    got = sorted(op9.read_tokens(spark, path, digest=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    start = 0
    for r in got:
        options = [[*_ids(t), 2] for i, t in rows if i == r.doc_id]
        assert r.start == start and any(r.n_tokens == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) for x in options)
        start += r.n_tokens
    assert op9.read_document(spark, path, 1) == [[*_ids(BASE), 2]] and op9.read_document(spark, path, 777) == []
    empty = new_folder(spark, "test")
    op9.write_tokens(documents([]), empty, WORD_BPE)
    assert op9.read_tokens(spark, empty).count() == 0


ADDED = [(1, "end<|endoftext|>now"), (2, "A<|EndOfText|>B <|endoftext|><|startoftext|>\u00e9<|STARTOFTEXT|> <|endoftext|>it's"), (3, "cut <|endof"), (4, "text|> cut"), (5, "<|startoftext|>")]


def test_op4_and_op9_added_tokens(spark, documents):
    want = {i: _ids(t) for i, t in ADDED}
    assert want[1] == [806, 49407, 692]
    path = new_folder(spark, "test")
    op9.write_tokens(documents(ADDED), path, WORD_BPE)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in op9.read_tokens(spark, path, digest=True).collect()}
    crc = lambda ids: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert got == {i: crc([*x, 2]) for i, x in want.items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in op4.pack_documents(documents(ADDED), WORD_BPE).collect()} == {i: crc([*x, 1]) for i, x in want.items()}


def test_op10_as_the_library_does(spark, documents):
    import tiktoken

    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = AWKWARD + [(50, "  a  b\n\n c d　e ÀÉ ×÷ x'll 'S 12 34５ \t  z  "), (51, "Zm9v" * 600 + " \n"), (52, "²³   q<|endoftext|>")]
    got = Counter(map(tuple, op10.round_trip_digests(documents(rows), RANKS, P.PATTERN).collect()))
    want = Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    assert op10.round_trip_digests(documents([]), RANKS, P.PATTERN).count() == 0
    back = op10.decode_ids(op10.encode_texts(documents(rows), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter((r.doc_id, bytes(r.bytes)) for r in back) == Counter((i, (t or "").encode()) for i, t in rows)


def test_op10_long_words():
    """Words longer than any token, many at once or one very long one, as the library does."""
    import tiktoken

    own, _ = op10.bpe(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})._core_bpe
    rng = np.random.default_rng(0)
    parts = ["th", "e", "an", "in", "aa", "a", "é", "st", "stst", "中", "tion"]
    made = {"".join(rng.choice(parts, rng.integers(12, 200))).encode() for _ in range(150)}
    made |= {(p * n).encode() for p in [*parts, "ab", "aba", "the", "=", " "] for n in (35, 101, 1500)} | {bytes(rng.choice(list(b"abcdefghij"), 16_000))}
    for w, ids in own.encode_words(sorted(made)).items():
        assert np.frombuffer(ids, np.uint32).tolist() == library.encode_single_piece(w), w[:40]
    long = b"." * ((1 << 21) + 9) + b"-="  # places beyond 21 bits
    ids = own.encode_words([long])[long]
    assert own.decode([ids]) == [long] and np.frombuffer(ids, np.uint32).tolist() == library.encode_single_piece(long)


def test_pipeline_stages(spark, documents, tmp_path):
    import corpus_pipeline

    rows = AWKWARD + [(60 + k, words(200 + k, 50) + (" you idiot scum" if k % 4 == 1 else "")) for k in range(60)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(60 + k, int(k % 4 == 1)) for k in range(60)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert left[0] >= {i for i, _ in AWKWARD} and {60, 62, 64} <= left[0] and not {61, 65, 69} & left[0]
    assert {2, 3, 11} <= left[0] - left[1] and {1, 4, 5, 6, 7, None} <= left[1] and left[2] == left[1]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == left[2]


@pytest.mark.parametrize("seed", range(3))
def test_op7_block_with_probes(seed):
    """Probes against stored sets of a block: what is connected is what brute force connects."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    bases = [rng.integers(0, 1 << 62, 40).astype(np.uint64) for _ in range(4)]
    sets = []
    for k in range(60):
        x = bases[k % 4].copy()
        j = rng.choice(40, rng.integers(0, 6), replace=False)
        x[j] = rng.integers(0, 1 << 62, len(j))
        sets.append(x)
    labels, probe = [k if k < 30 else 30 + k % 4 for k in range(60)], [k % 3 == 0 for k in range(60)]
    t = pa.table({"node": list(range(60)), "label": labels, "probe": probe, "grams": [x.tobytes() for x in sets]})
    links = op7._joined(80, 100)(t).to_pylist()

    def groups(pairs):
        g = op7.Groups(60)
        first = {}
        for k, label in enumerate(labels):
            g.tie(k, first.setdefault(label, k))
        for a, b in pairs:
            g.tie(a, b)
        return [g.top(k) for k in range(60)]

    real = [(a, b) for a in range(60) for b in range(60) if probe[a] and not probe[b] and 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 80 * len(set(sets[a].tolist()) | set(sets[b].tolist()))]
    assert groups((x["a"], x["b"]) for x in links) == groups(real)
