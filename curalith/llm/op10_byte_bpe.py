"""Byte-level BPE by recursive DuckDB queries inside each partition.

The merge table is joined to token-position rows: in each step of the recursion every word's
leftmost pair of minimum rank is contracted, until no word has a pair in the table.  A word that
is a token as it stands is taken whole, as in tiktoken.  Only distinct words go through the query;
a Python worker remembers a bounded number of them.  Ids are decoded by an ordered aggregation of
the tokens' bytes over distinct runs of ids.

Words longer than the longest token contract several pairs in a step.  What happens further away
than the longest token can't reach a pair before the pair itself is contracted, if no pair that
near has a lower rank.  So each pair that is the least within that reach goes; equal ones
go together (in a run of them every other one, from its first) where the new token makes no pair
with its neighbours whose rank is as low, else the leftmost alone.  The result is that of one pair
after the other.

Defined results: a null or empty text has no ids; bytes decode to those of the text; repeated rows
give repeated results; an empty table gives none; other columns don't matter.  A text and its
tokens must fit a task's memory several times; there is no other bound on a word's length.
"""

from __future__ import annotations

import base64
import re
import tempfile
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from curalith.llm.kernels import chunks, flat_texts
from curalith.llm.storage import text_batches
from curalith.llm.tokens import ChunkEncoder, Memo, flat_binary, spaced_chunks

#: Bytes of words that go through one recursive query; steps of a query, and rows of all its steps
#: together, before the state is taken over into a new one: these bound its memory.
QUERY_BYTES, QUERY_STEPS, QUERY_ROWS = 400_000, 64, 2_000_000

#: A row is a token under the place of its last byte, with the next token and its place.  A pair's
#: key is its rank, the place of its left token and the length of its right one (16, 40 and 7 bits).
#: A contracted pair stays under its right token's place, so only that row and the one before the
#: pair change.
CONTRACT = f"""
WITH RECURSIVE state(step, word, place, token, next_place, next_token) AS (
  SELECT 0, word, place, token, next_place, next_token FROM begun
  UNION ALL
  (WITH paired AS MATERIALIZED (
     SELECT s.*, (m.merged::BIGINT << 47) | (s.place::BIGINT << 7) | m.right_length AS pair_key
     FROM state s LEFT JOIN merges m ON m.pair = (s.token::BIGINT << 16) | s.next_token),
   least AS MATERIALIZED (
     SELECT word, min(pair_key) AS best FROM paired GROUP BY word HAVING min(pair_key) IS NOT NULL),
   contracted AS (
     SELECT word, (best >> 47)::INT AS merged, ((best >> 7) & 1099511627775)::INT AS left_place,
       ((best >> 7) & 1099511627775)::INT + (best & 127)::INT AS right_place
     FROM least)
   SELECT step + 1, word, place,
     CASE WHEN place = right_place THEN merged ELSE token END,
     CASE WHEN next_place = left_place THEN right_place ELSE next_place END,
     CASE WHEN next_place = left_place THEN merged ELSE next_token END
   FROM paired JOIN contracted USING (word) WHERE place <> left_place AND step < {QUERY_STEPS})
)
SELECT s.word, s.place, s.token, s.step FROM state s
JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON l.word = s.word AND l.step = s.step
ORDER BY s.word, s.place
"""

#: The same for long words, every pair within whose reach none is less at once.
CONTRACT_FAR = """
WITH RECURSIVE state(step, word, place, token) AS (
  SELECT 0, word, place, token FROM begun
  UNION ALL
  (WITH paired AS (
     SELECT n.*, coalesce(m.merged, 65536) AS merged,
       least(coalesce(f.merged, 65536), coalesce(g.merged, 65536), m.twice) <= m.merged AS loud
     FROM (SELECT *, lag(token) OVER o AS token_before, lead(token) OVER o AS next_token, lead(token, 2) OVER o AS token_after
           FROM state WINDOW o AS (PARTITION BY word ORDER BY place)) n
     LEFT JOIN merges m ON m.pair = (n.token::BIGINT << 16) | n.next_token
     LEFT JOIN merges f ON f.pair = (n.token_before::BIGINT << 16) | m.merged
     LEFT JOIN merges g ON g.pair = (m.merged::BIGINT << 16) | n.token_after),
   seen AS (
     SELECT *, merged IS DISTINCT FROM lag(merged) OVER o AS begins,
       coalesce(min(merged) OVER (o ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), 65536) AS before,
       coalesce(min(merged) OVER (o ROWS BETWEEN 1 FOLLOWING AND {reach} FOLLOWING), 65536) AS after,
       coalesce(min(CASE WHEN loud THEN merged END) OVER (o ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), 65536) AS loud_before
     FROM paired WINDOW o AS (PARTITION BY word ORDER BY place)),
   numbered AS (SELECT *, sum(begins::INT) OVER (PARTITION BY word ORDER BY place) AS run FROM seen),
   placed AS (
     SELECT *, row_number() OVER r - 1 AS turn, first_value(before) OVER r AS run_before, first_value(loud_before) OVER r AS run_loud,
       coalesce(bool_or(loud) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS loud_inside
     FROM numbered WINDOW r AS (PARTITION BY word, run ORDER BY place)),
   chosen AS (
     SELECT *, merged < 65536 AND merged <= after AND merged <= run_before
       AND (turn = 0 AND merged < run_before OR turn % 2 = 0 AND run_loud > merged AND NOT loud_inside) AS goes
     FROM placed),
   marked AS (
     SELECT *, lag(goes) OVER o AS went, lag(merged) OVER o AS became, bool_or(goes) OVER (PARTITION BY word) AS open
     FROM chosen WINDOW o AS (PARTITION BY word ORDER BY place))
   SELECT step + 1, word, place, CASE WHEN went THEN became ELSE token END
   FROM marked WHERE open AND NOT goes AND step < {steps})
)
SELECT s.word, s.place, s.token, s.step FROM state s
JOIN (SELECT word, max(step) AS step FROM state GROUP BY word) l ON l.word = s.word AND l.step = s.step
ORDER BY s.word, s.place
"""

#: The tokens' bytes as hexadecimal text, put together in order and turned back into bytes.
DECODE = """
SELECT unhex(string_agg(shown, '' ORDER BY place)) AS bytes
FROM ids JOIN vocabulary USING (token) GROUP BY run ORDER BY run
"""

#: Chunks that are one match of the pattern by their bytes alone.
_ONE_MATCH = re.compile(rb" ?(?:(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+|[0-9]+|[!-&(-/:-@\[-`{-~]+)|\n")


class RecursiveBPE:
    """One worker's DuckDB connection with the merge table and the vocabulary."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        self.reach = max(map(len, ranks))
        if max(ranks.values()) >= 1 << 16 or self.reach >= 1 << 7:
            raise ValueError("ranks beyond 16 bits or tokens beyond 127 bytes need wider keys")
        found = []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    found.append((left, right, rank, len(token) - k))
        left, right, merged, length = np.array(found, np.int64).reshape(-1, 4).T
        twice_of = np.full(1 << 16, 1 << 16, np.int64)  # the rank of a token with itself
        twice_of[list(ranks.values())] = [ranks.get(t + t, 1 << 16) for t in ranks]
        self.pattern = regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": tempfile.gettempdir()})
        self._table("merges", pa.table({"pair": left << 16 | right, "merged": merged.astype(np.int32), "right_length": length.astype(np.int32), "twice": twice_of[merged].astype(np.int32)}))
        self._table("vocabulary", pa.table({"token": pa.array(list(ranks.values()), pa.int32()), "shown": [t.hex() for t in ranks]}))
        self.shown = pa.array([b"%d," % k for k in range(max(ranks.values()) + 1)], pa.large_binary())
        self.decoded = Memo(self._joined)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contracted(self, words: list[bytes], far: bool) -> list[bytes]:
        """The ids of words; ``far`` where some are longer than the longest token."""
        size = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        place = (np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32)
        state = pa.table({"word": word, "place": place, "token": self.byte[np.frombuffer(b"".join(words), np.uint8)]})
        done: list[pa.Table] = []
        while state.num_rows:
            steps = max(1, min(QUERY_STEPS, QUERY_ROWS // state.num_rows)) if far else QUERY_STEPS
            query = CONTRACT_FAR.format(reach=self.reach, steps=steps) if far else CONTRACT
            self.db.register("begun", state if far else _with_next(state))
            rows = self.db.sql(query).to_arrow_table()
            self.db.unregister("begun")
            open_rows = np.asarray(rows["step"]) >= steps
            rows = rows.select(["word", "place", "token"])
            done.append(rows.filter(pa.array(~open_rows)))
            state = rows.filter(pa.array(open_rows))
        rows = pa.concat_tables(done)
        if len(done) > 1:
            rows = rows.sort_by([("word", "ascending"), ("place", "ascending")])
        token = np.asarray(rows["token"]).astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(np.bincount(np.asarray(rows["word"]), minlength=len(words)))).tolist()
        return [token[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct words."""
        out, rest = {}, {False: [], True: []}
        for w in words:
            whole = self.ranks.get(w)
            if whole is None:
                rest[len(w) > self.reach].append(w)
            else:
                out[w] = np.uint32(whole).tobytes()
        for far, own in rest.items():
            lo = size = 0
            for hi, w in enumerate(own):
                size += len(w)
                if size >= QUERY_BYTES or hi + 1 == len(own):
                    part = own[lo : hi + 1]
                    out.update(zip(part, self._contracted(part, far), strict=True))
                    lo, size = hi + 1, 0
        return out

    def encode(self, new: list[bytes]) -> list[bytes]:
        """The ids of chunks, each match of the pattern on its own."""
        one, find = _ONE_MATCH.fullmatch, self.pattern.findall
        split = [(x,) if one(x) else [m.encode() for m in find(x.decode("utf-8", "replace"))] for x in new]
        ids = self.encode_words(list(dict.fromkeys(w for ws in split for w in ws)))
        return [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in split]

    def _joined(self, runs: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(runs), 50_000):
            part = runs[lo : lo + 50_000]
            size = np.array([len(r) // 4 for r in part], np.int64)
            run = np.repeat(np.arange(len(part), dtype=np.int32), size)
            place = np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size)
            self.db.register("ids", pa.table({"run": run, "place": place, "token": np.frombuffer(b"".join(part), np.uint32).astype(np.int32)}))
            rows = iter(self.db.sql(DECODE).to_arrow_table()["bytes"].to_pylist())
            self.db.unregister("ids")
            out += [next(rows) if r else b"" for r in part]
        return out

    def decode(self, runs: list[bytes]) -> list[bytes]:
        """The bytes of runs of ids."""
        return self.decoded(runs)


def _with_next(state: pa.Table) -> pa.Table:
    """Rows in order with the next token of the word and its place (null at its end)."""
    word, last = np.asarray(state["word"]), np.ones(state.num_rows, bool)
    last[:-1] = word[1:] != word[:-1]
    for name in ("place", "token"):
        state = state.append_column(f"next_{name}", pa.array(np.roll(np.asarray(state[name]), -1), mask=last))
    return state


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> tuple[RecursiveBPE, ChunkEncoder]:
    own = RecursiveBPE(path, pattern)
    return own, ChunkEncoder(spaced_chunks, own.encode)


def _pieces(batch: pa.RecordBatch):
    """(first document, offsets, bytes) of a bounded number of bytes at a time."""
    data, offsets = flat_texts(batch.column("text"))
    for lo, hi in chunks(offsets, 4 << 20):
        at = offsets[lo : hi + 1]
        yield lo, at - at[0], data[at[0] : at[-1]]


def encode_texts(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids: the tokens of each row's text."""

    def run(batches):
        for batch in text_batches(batches):
            _, encoder = bpe(ranks, pattern)
            for lo, offsets, data in _pieces(batch):
                ids, at = encoder(data, offsets)
                own = batch.column("doc_id").slice(lo, len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes: what the ids of each row stand for."""

    def run(batches):
        for batch in batches:
            own, _ = bpe(ranks, pattern)
            runs = [np.asarray(x or [], np.uint32).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own.decode(runs), pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; ids are decoded from the ids alone."""

    def run(batches):
        own, encoder = bpe(ranks, pattern)
        hexes = lambda flat, at, cut: [sha256(flat[i : max(i, j - cut)]).hexdigest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for batch in text_batches(batches):
            for lo, offsets, data in _pieces(batch):
                runs, first = encoder.runs(data, offsets)
                flat, bounds = flat_binary(runs)
                at = bounds[first] // 4
                text, text_at = flat_binary(own.shown.take(pa.array(flat.view(np.uint32))))
                coded = runs.dictionary_encode()
                back, back_at = flat_binary(pa.array(own.decode(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, len(offsets) - 1), pa.array(np.diff(at), pa.int64()),
                        pa.array(hexes(text, text_at[at], 1), pa.string()), pa.array(hexes(back, back_at[first], 0), pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
