from collections import Counter
from hashlib import sha256
from itertools import accumulate

import public_tokenizers as P
import pytest
from llm.conftest import AWKWARD

from curalith.llm import op11_token_alignment as op11

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    (20, "It's <|endoftext|> and <s> </s> <unk> <0x41>, plain text"), (21, " two  spaces   here "), (22, "a▁b"), (23, "▁"), (24, " "), (25, "   "), (26, "\n\n a\n b\tc\r\n"), (27, "日本語 ﬁ é é 😀 　x\xa0y"),
    (28, "x\u0000y"), (29, "aaaaaaaaaaaaaaaa" * 40), (30, "don't you're WE'LL 12345 3.14"), (31, "=" * 500 + " end"), (32, "It's It's It's"), (33, "\n"), (34, "a "), (35, "a▁ ▁ b c"),
]


def brute_force(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
    found, counts = [], Counter()
    for i, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        of_a = [bytes(back[c] for c in a.id_to_token(k)) for k in ids_a]
        of_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k in ids_b for p in [b.id_to_piece(k)]]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            found.append((i, 0, 0, 0, [], ""))
            continue
        ea, eb = (list(accumulate(map(len, x))) for x in (of_a, of_b))
        byte_a, byte_b = ([k for k, t in enumerate(x) for _ in t] for x in (of_a, of_b))  # each byte's token
        links = [(ids_a[p], ids_b[q]) for p, q in dict.fromkeys(zip(byte_a, byte_b, strict=True))]
        groups, common = [([], [])], set(ea) & set(eb)
        for p, q in dict.fromkeys(zip(byte_a, byte_b, strict=True)):
            for side, k in zip(groups[-1], (p, q), strict=True):
                side.extend([k] if k not in side[-1:] else [])
            if ea[p] == eb[q] and ea[p] in common:
                groups.append(([], []))
        groups = [(",".join(str(ids_a[k]) for k in x), ",".join(str(ids_b[k]) for k in y)) for x, y in groups[:-1]]
        counts.update(set(links))
        found.append((i, len(ids_a), len(ids_b), len(groups), links, sha256(";".join("|".join(g) for g in groups).encode()).hexdigest()))
    best = {}
    for (p, _), n in counts.items():
        best[p] = max(best.get(p, 0), n)
    return [(i, n, m, g, len(x), h, sum(counts[k] == best[k[0]] for k in x), sum(counts[k] for k in x)) for i, n, m, g, x, h in found]


@pytest.mark.parametrize("task_bytes", [op11.TASK_BYTES, 60])
def test_op11_against_brute_force(spark, documents, monkeypatch, task_bytes):
    monkeypatch.setattr(op11, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(op11, "FAN_IN", 2)
    rows = [(i, t if not t or len(t) < 5000 else t[:3000]) for i, t in [*AWKWARD, *TEXTS]]
    docs = documents(rows).repartition(5)
    got = op11.token_alignment(docs, A, B).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute_force(rows), key=key)
    assert sum(r.n_a == 0 for r in got) >= 5


def test_op11_empty_and_long(documents):
    assert op11.token_alignment(documents([]), A, B).count() == 0
    long = " ".join(f"word{k} and" for k in range(600_000))  # 7 MB, beyond a chunk
    r = op11.token_alignment(documents([(1, long), (2, None), (3, "")]), A, B).orderBy("doc_id").collect()
    assert [x.n_links for x in r] == [r[0].n_a + r[0].n_b - r[0].n_groups, 0, 0] and r[0].n_groups > 600_000
    assert r[0].count_sum == r[0].n_links and r[0].n_best == r[0].n_links


def test_op11_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect() if not r.text or len(r.text) < 4000]
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("text IS NULL OR length(text) < 4000")
    assert sorted(tuple(r) for r in op11.token_alignment(docs, A, B).collect()) == sorted(brute_force(rows))
    assert op11.op11_token_alignment(spark, d).count() == spark.read.parquet(f"{d}/documents.parquet").count()
