"""Suffix-array dedup: bytes of repeated 50-byte strings, by deep-shallow sorting.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller doc_id.

1. Each string's anchor is the least hash among its grams of ``GRAM`` bytes, so equal strings have
   equal anchors.  Texts are read once into a table of chunks, bucketed by chunk; the anchors of
   each chunk are dealt out by hash, and those that stand in two documents are sent back.  All
   strings without such an anchor are alone.  An anchor of more than ``HOT_RUNS`` different runs (a
   line that very many documents have, in other surroundings each) is sent back marked as hot: each
   string that has it gets the hash of all its bytes as an anchor of its own, and these are dealt
   and sent back in the same way.
2. Runs of strings with one anchor are dealt out by it as text, each run of a chunk once with its
   least doc_id, and equal runs of all chunks become one.  Where that leaves an anchor one run, its
   strings have the run's least doc_id.  The suffixes of other anchors' runs are sorted by the first
   LENGTH bytes: multikey quicksort, eight bytes a key, to a shallow depth; a group that is still
   together is compared with its first member, and what differs goes through a blind trie.  That
   gives each string's least doc_id.
3. The answers go back to the chunks, whose documents lose the bytes.

A string that very many documents share makes one run for each chunk, not for each document, and
the runs of one anchor are about HOT_RUNS at most, or one string, once for each chunk.
Chunks join their anchors and answers where they lie (the table's buckets).

Defined results: null texts are empty; rows with a null doc_id come after all others (their bytes
can go, but take none from others); rows that repeat a doc_id are no smaller than each other.  A
document lies in one chunk whole, so its text must fit in a task's memory several times.
"""

from __future__ import annotations

import uuid
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalith.llm.kernels import chunks, flat_texts, gram_hashes, mix, sliding, span_hashes
from curalith.llm.storage import new_folder, shuffle_width

LENGTH, GRAM = 50, 18
#: Bytes of a chunk of documents, and of what is hashed at once (its arrays fit a core's cache).
CHUNK_BYTES, SEGMENT = 2 << 20, 1 << 15
#: Bytes of the multikey quicksort; blind tries go on from there.
SHALLOW = 40
PEELED = 3
#: Anchors of more runs than this are hot: their strings are dealt one by one.  So many runs are at
#: most about a million strings, some 100 MB in a task.
HOT_RUNS = 1 << 15
#: Strings that are sorted at once, or those of one anchor; runs whose bytes are gathered at once.
SORTED, GATHERED = 1 << 20, 1 << 12
_LAST = np.iinfo(np.int64).max


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor inside a document: first string, number of
    strings, anchor (its lowest bit is 0), document."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    valid = np.ones(n, bool)
    for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        valid[max(begin, end - length + 1) : end] = False
    found = []
    for lo in range(0, n, SEGMENT):
        hi = min(n, lo + SEGMENT)
        least = sliding(gram_hashes(data[lo : hi + length - 1], GRAM), length - GRAM + 1, np.minimum)
        own, turn = valid[lo:hi], least[1:] != least[:-1]
        start = own.copy()
        start[1:] &= ~own[:-1] | turn
        stop = own.copy()
        stop[:-1] &= ~own[1:] | turn
        s = np.flatnonzero(start)
        found.append((s + lo, np.flatnonzero(stop) + 1 - s, mix(least[s] ^ np.uint64(0x5851F42D4C957F2D)) & ~np.uint64(1)))
    first, many, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
    return first, many, anchor, np.searchsorted(offsets, first, "right") - 1


def _is_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Hashes are looked up only where another has the same highest bits."""
    high = np.zeros(1 << 18, bool)
    high[ascending >> np.uint64(46)] = True
    found = high[values >> np.uint64(46)]
    some = values[found]
    found[found] = ascending[np.minimum(np.searchsorted(ascending, some), len(ascending) - 1)] == some
    return found


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Each anchor's bucket; ascending where the anchors are."""
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _each(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from ``first`` on, ``many`` of them, for each run."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Chunk:
    """A row of the table of chunks."""

    def __init__(self, row: dict):
        self.number = row["chunk"]
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=max(1, int(self.offsets[-1]))), np.uint8)

    def texts_of(self, first: np.ndarray, many: np.ndarray, anchor: np.ndarray, length: int) -> np.ndarray:
        """Hashes of whole runs."""
        return span_hashes(self.data, first, first + many + length - 1) ^ mix(anchor + many.astype(np.uint64))

    def single_strings(self, found: tuple, hot: np.ndarray, length: int):
        """Of the runs ``found`` those with a hot anchor, string by string, as runs of one string
        with the hash of all its bytes for an anchor."""
        first, many, anchor, doc = found
        own = _is_in(anchor, hot)
        at = _each(first[own], many[own])
        whole = mix(span_hashes(self.data, at, at + length) ^ np.uint64(0x2545F4914F6CDD1D)) & ~np.uint64(1)
        return at, np.ones(len(at), np.int64), whole, np.repeat(doc[own], many[own])

    def shared_runs(self, row: dict, length: int, buckets: int):
        """The runs that share an anchor of ``row``, and the distinct ones among them: first, many,
        document, which distinct run each is, and of the distinct ones a place, the least id and
        the bucket, in an order that depends on the chunk and the anchors only."""
        anchors, singles = _joined_anchors(row["anchors"]), _joined_anchors(row["singles"])
        is_hot = anchors & np.uint64(1) > 0
        found = runs(self.data, self.offsets, length)
        cool = _is_in(found[2], anchors[~is_hot])
        parts = [tuple(x[cool] for x in found)]
        if is_hot.any():
            alone = self.single_strings(found, anchors[is_hot] - np.uint64(1), length)
            keep = _is_in(alone[2], singles)
            parts.append(tuple(x[keep] for x in alone))
        first, many, anchor, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        text = self.texts_of(first, many, anchor, length)
        bucket = _bucket(anchor, buckets)
        order = np.lexsort((self.ids[doc], text, bucket))
        new = np.ones(len(order), bool)
        new[1:] = text[order][1:] != text[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        pick = order[new]
        return first, many, doc, which, first[pick], many[pick], self.ids[doc[pick]], bucket[pick]


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _chunked(batches):
    """Documents in chunks: chunk, ids, offsets, texts (compressed)."""
    press, k, part = zstandard.ZstdCompressor(level=1), 0, TaskContext.get().partitionId()
    for batch in batches:
        data, offsets = flat_texts(batch.column("text"))
        ids = batch.column("doc_id").fill_null(int(_LAST)).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in chunks(offsets, CHUNK_BYTES):
            at = offsets[lo : hi + 1]
            row = (part << 24 | k, ids[lo:hi].tobytes(), (at - at[0]).tobytes(), press.compress(data[at[0] : at[-1]].tobytes()))
            k += 1
            yield pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:])], names=["chunk", "ids", "offsets", "texts"])


def _dealt(chunk: Chunk, found: tuple, length: int, buckets: int):
    """(bucket, chunk, payload): a chunk's distinct anchors, the lowest bit set where two of its
    documents have one, and the logarithms of how many different runs have each."""
    first, many, anchor, doc = found
    order = np.argsort(anchor)
    a, d = anchor[order], chunk.ids[doc[order]]
    head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
    several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
    count = np.diff(np.append(head, len(a)))
    texts = np.ones(len(head), np.int64)
    again = order[np.repeat(count, count) > 1]
    if len(again):
        text = chunk.texts_of(first[again], many[again], anchor[again], length)
        by = np.lexsort((text, anchor[again]))
        of, text = anchor[again[by]], text[by]
        other = np.append(True, of[1:] != of[:-1])
        texts[count > 1] = np.add.reduceat((other | np.append(True, text[1:] != text[:-1])).astype(np.int64), np.flatnonzero(other))
    a, size = a[head] | several.astype(np.uint64), np.log2(texts).astype(np.uint8)
    cuts = np.searchsorted(_bucket(a, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    out = [a[i:j].tobytes() + size[i:j].tobytes() for i, j in zip(cuts[used].tolist(), cuts[used + 1].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([chunk.number] * len(used), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "chunk", "payload"])


def _anchors(length: int, buckets: int):
    """The anchors of all strings of a chunk."""

    def run(batches):
        for row in _rows(batches):
            chunk = Chunk(row)
            found = runs(chunk.data, chunk.offsets, length)
            if len(found[0]):
                yield _dealt(chunk, found, length, buckets)

    return run


def _single_anchors(length: int, buckets: int):
    """The anchors of the single strings of a chunk."""

    def run(batches):
        for row in _rows(batches):
            anchors = _joined_anchors(row["anchors"])
            hot = anchors[anchors & np.uint64(1) > 0] - np.uint64(1)
            if len(hot):
                chunk = Chunk(row)
                yield _dealt(chunk, chunk.single_strings(runs(chunk.data, chunk.offsets, length), hot, length), length, buckets)

    return run


def _by_bucket(batches, *columns: str):
    """The rows of each bucket in turn; a bucket's rows are neighbours."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", *columns)), strict=True))
    for bucket, own in groupby(rows, lambda row: row[0]):
        yield bucket, [row[1:] for row in own]


def _shared(hot_runs: int | None):
    """(chunk, anchors): of the anchors of each bucket those that two documents have, the lowest bit
    set where more than ``hot_runs`` runs have one."""

    def run(batches):
        for _, rows in _by_bucket(batches, "chunk", "payload"):
            numbers = np.array([chunk for chunk, _ in rows], np.int64)
            found = [np.frombuffer(raw, np.uint64, len(raw) // 9) for _, raw in rows]
            size = np.concatenate([np.frombuffer(raw, np.uint8, offset=len(raw) // 9 * 8) for _, raw in rows]).astype(np.int64)
            a, of = np.concatenate(found), np.repeat(numbers, [len(x) for x in found])
            order = np.argsort(a)
            plain = a[order] & ~np.uint64(1)
            first = np.flatnonzero(np.append(True, plain[1:] != plain[:-1]))
            many = np.diff(np.append(first, len(plain)))
            keep = np.repeat((many > 1) | (np.maximum.reduceat(a[order] & np.uint64(1), first) > 0), many)
            if hot_runs is not None:
                plain |= np.repeat(np.add.reduceat(1 << size[order], first) > hot_runs, many).astype(np.uint64)
            plain, chunk = plain[keep], of[order[keep]]
            order = np.argsort(chunk, kind="stable")
            plain, chunk = plain[order], chunk[order]
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, np.int64)
            parts = [x.tobytes() for x in np.split(plain, first[1:])] if len(chunk) else []
            yield pa.RecordBatch.from_arrays([pa.array(chunk[first], pa.int64()), pa.array(parts, pa.binary())], names=["chunk", "anchors"])

    return run


def _joined_anchors(parts: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(p, np.uint64) for p in parts])) if parts else np.zeros(0, np.uint64)


def _texts(length: int, buckets: int):
    """(bucket, chunk, payload): a chunk's distinct shared runs with their least ids, as text."""

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        for row in _rows(batches):
            chunk = Chunk(row)
            *_, first, many, least, bucket = chunk.shared_runs(row, length, buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            size = many + length - 1
            texts = b"".join(chunk.data[_each(first[i : i + GATHERED], size[i : i + GATHERED])].tobytes() for i in range(0, len(first), GATHERED))
            ends, many = np.append(0, np.cumsum(size)), many.astype(np.uint32)
            out_bucket, out = [], []
            for b in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[b], cuts[b + 1])
                out_bucket.append(int(b))
                out.append(press.compress(np.int64(cuts[b + 1] - cuts[b]).tobytes() + least[own].tobytes() + many[own].tobytes() + texts[ends[cuts[b]] : ends[cuts[b + 1]]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array([chunk.number] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["bucket", "chunk", "payload"])

    return run


class BlindTrie:
    """A Patricia trie of equally long strings as numbers: nodes hold only the bit that decides.  A
    string is led down blindly, and compared once, with the leaf that it comes to."""

    def __init__(self):
        self.root = None

    def insert(self, value: int, own: int) -> int:
        """The number given with the first equal string."""
        if self.root is None:
            self.root = (None, value, own)
            return own
        node = self.root
        while node[0] is not None:
            node = node[2] if value >> node[0] & 1 else node[1]
        if node[1] == value:
            return node[2]
        bit = (node[1] ^ value).bit_length() - 1
        path, node = [], self.root
        while node[0] is not None and node[0] > bit:
            side = value >> node[0] & 1
            path.append((node, side))
            node = node[1 + side]
        leaf = (None, value, own)
        new = (bit, node, leaf) if value >> bit & 1 else (bit, leaf, node)
        for up, side in reversed(path):
            new = (up[0], new, up[2]) if not side else (up[0], up[1], new)
        self.root = new
        return own


def _key(data: np.ndarray, starts: np.ndarray, at: int) -> np.ndarray:
    """Eight bytes of each string as a number that orders like them."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[starts + at].view(">u8")[:, 0].astype(np.uint64)


def equal_strings(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings data[start : start + length] by deep-shallow sorting: an order in which equal
    ones are neighbours, and for each place of it the place of the first of its equals.
    ``length`` is at least 16."""
    shallow = min(SHALLOW, (length - 8) // 8 * 8)
    order = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)  # by place: the place of the group's first member
    active = np.arange(len(starts))
    for at in range(0, shallow, 8):  # multikey quicksort: only groups that are still together go on
        if not len(active):
            break
        key, own = _key(data, starts[order[active]], at), group[active]
        by = np.lexsort((key, own)) if at else np.argsort(key)
        order[active] = order[active[by]]
        key, own = key[by], own[by]
        new = np.ones(len(by), bool)
        new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(by)))
        group[active] = np.repeat(active[head], size)
        active = active[np.repeat(size, size) > 1]
    first = np.where(np.isin(np.arange(len(starts)), active, assume_unique=True), -1, np.arange(len(starts)))
    rest = [*range(shallow, length - 7, 8), length - 8]
    for _ in range(PEELED):  # equals of a group's first open member
        if not len(active):
            break
        own = group[active]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        leader = np.repeat(active[head], np.diff(np.append(head, len(own))))
        a, b = starts[order[active]], starts[order[leader]]
        same = np.ones(len(active), bool)
        for at in rest:
            same &= _key(data, a, at) == _key(data, b, at)
        first[active[same]] = leader[same]
        active = active[~same]
    tries: dict[int, BlindTrie] = {}
    for place in active.tolist():
        s = int(starts[order[place]])
        value = int.from_bytes(data[s + shallow : s + length].tobytes(), "big")
        first[place] = tries.setdefault(int(group[place]), BlindTrie()).insert(value, place)
    return order, first


def _anchors_of(texts: list[bytes], length: int) -> np.ndarray:
    """What all strings of each run have in common: the least hash of a gram of its first string."""
    step = max(1, SEGMENT // length)
    heads = (np.frombuffer(b"".join(t[:length] for t in texts[i : i + step]), np.uint8) for i in range(0, len(texts), step))
    return np.concatenate([sliding(gram_hashes(x, GRAM), length - GRAM + 1, np.minimum)[::length] for x in heads])


def least_of_strings(texts: list[bytes], best: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The least id of each string of different runs, from the least id of each run, as stretches of
    strings: their ids and lengths, and for each run its first stretch and number of stretches."""
    many = np.fromiter(map(len, texts), np.int64, len(texts)) - (length - 1)
    anchor = _anchors_of(texts, length)
    order = np.argsort(anchor, kind="stable")
    head = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    count = np.diff(np.append(head, len(order)))
    alone = order[head[count == 1]]
    ids, sizes = [best[alone]], [many[alone]]
    first, stretches, before = np.zeros(len(texts), np.int64), np.ones(len(texts), np.int64), len(alone)
    first[alone] = np.arange(before)
    total = np.add.reduceat(many[order], head) * (count > 1)
    part = np.repeat((np.cumsum(total) - total) // SORTED, count)  # anchors that are sorted together
    part, rest = (x[np.repeat(count > 1, count)] for x in (part, order))
    for own in np.split(rest, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(rest) else []:
        n = many[own]
        size = n + length - 1
        data = np.frombuffer(b"".join([*(texts[i] for i in own.tolist()), bytes(8)]), np.uint8)
        given, equals = equal_strings(data, _each(np.cumsum(size) - size, n), length)
        least = np.full(len(given), _LAST)
        np.minimum.at(least, equals, np.repeat(best[own], n)[given])
        answer = np.empty(len(given), np.int64)
        answer[given] = least[equals]
        begin = np.cumsum(n) - n
        new = np.append(True, answer[1:] != answer[:-1])
        new[begin] = True
        at = np.flatnonzero(new)
        ids.append(answer[at])
        sizes.append(np.diff(np.append(at, len(answer))))
        stretches[own] = np.add.reduceat(new.astype(np.int64), begin)
        first[own] = before + np.cumsum(stretches[own]) - stretches[own]
        before += len(at)
    return np.concatenate(ids), np.concatenate(sizes).astype(np.uint32), first, stretches


def _least_ids(length: int):
    """(chunk, bucket, answer): for a payload's strings one after the other the least id that has
    each, as lengths and values of stretches."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for bucket, given in _by_bucket(batches, "chunk", "payload"):
            texts, which, least = {}, [], []
            for _, raw in given:
                raw = press.decompress(raw)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                least.append(np.frombuffer(raw, np.int64, n, 8))
                size = np.frombuffer(raw, np.uint32, n, 8 + 8 * n).astype(np.int64) + length - 1
                end = 8 + 12 * n + np.cumsum(size)
                which.append(np.fromiter((texts.setdefault(raw[i:j], len(texts)) for i, j in zip((end - size).tolist(), end.tolist(), strict=True)), np.int64, n))
            best = np.full(len(texts), _LAST)
            np.minimum.at(best, np.concatenate(which), np.concatenate(least))
            ids, sizes, first, stretches = least_of_strings([*texts], best, length)
            packed = []
            for own in which:
                at = _each(first[own], stretches[own])
                packed.append(np.int64(len(at)).tobytes() + ids[at].tobytes() + sizes[at].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([chunk for chunk, _ in given], pa.int64()), pa.array([bucket] * len(given), pa.int32()), pa.array(packed, pa.binary())], names=["chunk", "bucket", "answer"])

    return run


def _stretched(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.repeat(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.uint32, n, 8 + 8 * n))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(length: int, buckets: int, with_bytes: bool):
    def run(batches):
        for row in _rows(batches):
            chunk = Chunk(row)
            data, offsets, ids = chunk.data, chunk.offsets, chunk.ids
            gone = np.zeros(len(data), bool)  # where a string that goes begins
            if row["anchors"]:
                first, many, doc, which, *_, size, _, bucket = chunk.shared_runs(row, length, buckets)
                answer = np.concatenate([_stretched(x["answer"]) for x in sorted(row["answers"] or [], key=lambda x: x["bucket"])] or [np.zeros(0, np.int64)])
                start = np.cumsum(size) - size  # of each distinct run in the answers
                gone[_each(first, many)[answer[_each(start[which], many)] < np.repeat(ids[doc], many)]] = True
            at = np.flatnonzero(gone)
            doc = np.searchsorted(offsets, at, "right") - 1
            new, last = np.ones(len(at), bool), np.ones(len(at), bool)
            new[1:] = last[:-1] = (np.diff(at) > length) | (doc[1:] != doc[:-1])
            begin, end, doc = at[new], at[last] + length, doc[new]  # of each span
            lengths, lost, spans = np.diff(offsets), np.zeros(len(ids), np.int64), np.bincount(doc, minlength=len(ids))
            np.add.at(lost, doc, end - begin)
            left = np.ones(len(data), bool)
            left[_each(begin, end - begin)] = False
            kept = [(data[i:j][left[i:j]] if n else data[i:j]).tobytes() for i, j, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans.tolist(), strict=True)]
            columns = [pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(lengths, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.int64()), pa.array([sha256(k).hexdigest() for k in kept], pa.string())]
            if with_bytes:
                columns.append(pa.array(kept, pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")] + ["kept"] * with_bytes)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row of ``docs``."""
    spark = docs.sparkSession
    width = buckets = shuffle_width(spark)  # a task has one bucket, and a row of each chunk
    name = f"chunks_{uuid.uuid4().hex}"
    made = docs.select("doc_id", "text").mapInArrow(_chunked, "chunk long, ids binary, offsets binary, texts binary")
    made.write.bucketBy(width, "chunk").option("path", new_folder(spark, "chunks")).format("parquet").saveAsTable(name)
    table = spark.table(name)
    payload = "bucket int, chunk long, payload binary"

    def by_bucket(rows: DataFrame) -> DataFrame:
        return rows.repartitionById(width, "bucket").sortWithinPartitions("bucket")

    def sent_back(dealt: DataFrame, hot_runs: int | None, column: str) -> DataFrame:
        parts = by_bucket(dealt).mapInArrow(_shared(hot_runs), "chunk long, anchors binary")
        found = parts.groupBy("chunk").agg(F.collect_list("anchors").alias(column))
        path = new_folder(spark, column)
        found.write.parquet(path)
        return spark.read.schema(found.schema).parquet(path)

    common = sent_back(table.mapInArrow(_anchors(length, buckets), payload), HOT_RUNS, "anchors")
    singles = sent_back(table.join(common, "chunk").mapInArrow(_single_anchors(length, buckets), payload), None, "singles")
    anchors = common.join(singles, "chunk", "left")
    texts = by_bucket(table.join(anchors, "chunk").mapInArrow(_texts(length, buckets), payload))
    answers = texts.mapInArrow(_least_ids(length), "chunk long, bucket int, answer binary").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers"))
    whole = table.join(anchors, "chunk", "left").join(answers, "chunk", "left")
    return whole.mapInArrow(_cut(length, buckets, with_bytes), RESULT + (", kept binary" if with_bytes else ""))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
