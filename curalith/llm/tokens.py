"""Tokenizers over Arrow batches: texts are cut where no match of the tokenizer's pattern can
cross, each distinct chunk goes through the tokenizer once, and ids are gathered back by Arrow.

The cuts are conservative: a place counts only if the bytes on both sides are known to be on
different sides of a match, so the ids are those of the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa

from curalith.llm.kernels import chunks, lower

#: Entries that one of a Python worker's memories takes before it lets go of the older half, and
#: the longest key that it keeps.
MEMO_CHUNKS, MEMO_BYTES = 200_000, 256

#: ASCII white space 0, letters 1, punctuation but the apostrophe 2; any other byte 4.
_KIND = np.full(256, 4, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 2
_CLASS[48:58] = 3


def _edges(offsets: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    return edge


def _spans(data: np.ndarray, offsets: np.ndarray, contents: tuple[bytes, ...]) -> list[tuple[int, int]]:
    """Where one of ``contents`` stands inside a document, from left to right."""
    raw = data.tobytes() if contents else b""
    if not any(x in raw for x in contents):
        return []
    found = [m.span() for m in re.finditer(b"|".join(map(re.escape, contents)), raw)]
    return [(a, b) for a, b in found if np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b, "left")]


def word_chunks(data: np.ndarray, offsets: np.ndarray, added: tuple[bytes, ...] = ()) -> tuple[pa.Array, np.ndarray]:
    """For tokenizers that lower-case and drop white space: lower-cased chunks without ASCII white
    space, cut also between an ASCII letter and ASCII punctuation other than the apostrophe; and
    the number of chunks before each document (n + 1).  Each of the ``added`` tokens, found in the
    text as it stands, is a chunk of its own that isn't lower-cased."""
    low = lower(data)
    n = len(low)
    kind = _KIND[low]
    kept = kind != 0
    start = _edges(offsets, n)[:n]
    # between a letter (1) and punctuation (2), and after white space (0)
    start[1:] |= ((kind[:-1] ^ kind[1:]) == 3) & (kind[:-1] < 3) & (kind[1:] < 3) | ~kept[:-1]
    for a, b in _spans(data, offsets, added):
        low[a:b], kept[a:b], start[a:b] = data[a:b], True, False
        start[a] = True
        start[b : b + 1] = True
    start &= kept
    ends = np.append(np.flatnonzero(start[kept]), np.count_nonzero(kept)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(low[kept])])
    return found, np.searchsorted(np.flatnonzero(start), offsets, "left")


def _classes(data: np.ndarray) -> np.ndarray:
    """Of each byte: 1 for letters (ASCII, U+00C0 to U+023F but the two signs among them), 2 for
    ASCII punctuation but the apostrophe, 3 for ASCII digits, 0 for anything else."""
    kind = _CLASS[data]
    lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    sign = (data[lead] == 0xC3) & ((data[lead + 1] == 0x97) | (data[lead + 1] == 0xB7))
    lead = lead[~sign & (data[lead + 1] >= 0x80) & (data[lead + 1] < 0xC0)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def spaced_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For byte-level patterns whose matches are letters, digits, other characters (each with one
    space before them) or white space: cut at documents, between neighbours of different classes,
    before a single space between two characters that aren't white space, and around a single line
    end between such."""
    n = len(data)
    cut = _edges(offsets, n)
    kind = _classes(data)
    here, there = kind[:-1], kind[1:]
    cut[1:n] |= (here != there) & (here > 0) & (there > 0)
    space, line = data == 0x20, data == 0x0A
    known = (kind > 0) | (data == 0x27)
    between = np.zeros(n, bool)
    between[1:-1] = known[:-2] & known[2:]
    at = np.flatnonzero((space | line) & between)
    cut[at] = True
    cut[at[line[at]] + 1] = True
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts, n)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(starts, offsets, "left")


def flat_binary(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_binary array one after the other, and offsets (n + 1)."""
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    flat = np.frombuffer(array.buffers()[2], np.uint8) if bounds[-1] else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


class Memo:
    """Values of keys, worked out by ``make`` (a list of keys to their values).  It remembers those
    asked for last: a young generation, which becomes the old one when it is full."""

    def __init__(self, make: Callable[[list[bytes]], list[bytes]], most: int = MEMO_CHUNKS):
        self.make, self.most, self.young, self.old = make, most, {}, {}

    def __call__(self, keys: list[bytes]) -> list[bytes]:
        young, old = self.young, self.old
        out = [young.get(x) for x in keys]
        missing = [k for k, v in enumerate(out) if v is None]
        for k in missing:
            out[k] = old.get(keys[k])
        new = [k for k in missing if out[k] is None]
        for lo in range(0, len(new), 50_000):
            part = new[lo : lo + 50_000]
            for k, v in zip(part, self.make([keys[k] for k in part]), strict=True):
                out[k] = v
        young.update((keys[k], out[k]) for k in missing if len(keys[k]) <= MEMO_BYTES)
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out


class ChunkEncoder:
    """Remembers the ids of chunks; ``encode`` maps a list of new chunks to arrays of ids."""

    def __init__(self, cut: Callable, encode: Callable[[list[bytes]], list[bytes]]):
        self.cut, self.memo = cut, Memo(encode)

    def runs(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The ids of each chunk as bytes of uint32, in order; chunks before each document (n + 1)."""
        found, first = self.cut(data, offsets)
        if not len(found):
            return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
        coded = found.dictionary_encode()
        return pa.array(self.memo(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices), first

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all documents one after the other, and offsets (n + 1)."""
        runs, first = self.runs(data, offsets)
        flat, bounds = flat_binary(runs)
        return flat.view(np.uint32), bounds[first] // 4

    def documents(self, data: np.ndarray, offsets: np.ndarray):
        """(number of the document, its ids), a bounded number of bytes at a time."""
        for lo, hi in chunks(offsets, 4 << 20):
            own = offsets[lo : hi + 1]
            ids, at = self(data[own[0] : own[-1]], own - own[0])
            for k in range(hi - lo):
                yield lo + k, ids[at[k] : at[k + 1]]


def _written() -> dict[int, str]:
    """How byte-level files write bytes as characters: printed Latin-1 as itself, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_encoder(path: str) -> ChunkEncoder:
    """Ids by a tokenizers file whose pattern drops white space and whose normaliser lower-cases."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = tokenizer.model
    written = _written()
    latin = {c: "".join(written[b] for b in chr(c).lower().encode()) for c in [*range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]}
    letters = frozenset(map(chr, latin))

    def encode(new: list[bytes]) -> list[bytes]:
        out: list = [None] * len(new)
        rest = []
        for k, chunk in enumerate(new):
            text = chunk.decode("utf-8", "replace")
            if letters.issuperset(text):  # letters of Latin-1 are one word for the model, in the file's writing of bytes
                out[k] = array("I", [t.id for t in model.tokenize(text if chunk.isascii() else text.translate(latin))]).tobytes()
            else:
                rest.append(k)
        if rest:
            coded = tokenizer.encode_batch([new[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False)
            for k, x in zip(rest, coded, strict=True):
                out[k] = np.asarray(x.ids, np.uint32).tobytes()
        return out

    # longer ones first, as the library prefers them where several begin
    added = sorted((t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
    return ChunkEncoder(partial(word_chunks, added=tuple(added)), encode)


def space_chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For vocabularies in which no piece goes on over a space or holds a line end: cut at documents,
    before each run of spaces and around each line end."""
    n = len(data)
    cut = _edges(offsets, n)
    space, line = data == 0x20, data == 0x0A
    cut[1:n] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
    starts = np.flatnonzero(cut[:n])
    ends = np.append(starts, n).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return found, np.searchsorted(starts, offsets, "left")


class Vocabulary:
    """An encoder of whole texts and the bytes of each of its tokens.  Chunks whose tokens don't
    spell them have no ids."""

    def __init__(self, cut: Callable, spelled: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.spelled, self.lengths = spelled, np.array([len(x) for x in spelled], np.int64)

        def checked(new: list[bytes]) -> list[bytes]:
            coded = encode([x.decode("utf-8", "replace") for x in new])
            return [array("I", ids).tobytes() if b"".join([spelled[i] for i in ids]) == x else b"" for ids, x in zip(coded, new, strict=True)]

        self.encoder = ChunkEncoder(cut, checked)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all documents one after the other, offsets (n + 1), and whether a document is spelled."""
        runs, first = self.encoder.runs(data, offsets)
        flat, bounds = flat_binary(runs)
        unspelled = np.append(0, np.cumsum(np.diff(bounds) == 0))[first]
        return flat.view(np.uint32).astype(np.int64), bounds[first] // 4, np.diff(unspelled) == 0


@lru_cache(maxsize=2)
def byte_vocabulary(path: str) -> Vocabulary:
    """A byte-level tokenizers file; the strings of its special tokens are plain text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    read = {c: b for b, c in _written().items()}
    vocabulary = tokenizer.get_vocab()
    spelled = [b""] * (max(vocabulary.values()) + 1)
    for token, k in vocabulary.items():
        spelled[k] = bytes(read[c] for c in token) if all(c in read for c in token) else token.encode()
    return Vocabulary(spaced_chunks, spelled, lambda new: [x.ids for x in tokenizer.encode_batch(new, add_special_tokens=False)])


@lru_cache(maxsize=2)
def piece_vocabulary(path: str) -> Vocabulary:
    """A sentencepiece file that writes spaces as U+2581 and adds one before a text.  Texts are given
    with that space."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    spelled = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace("\u2581", " ").encode() for k, x in enumerate(pieces)]
    crossing = [x for x in pieces if "\n" in x or re.search("[^\u2581]\u2581", x)]
    if crossing:
        raise ValueError(f"texts can't be cut at spaces and line ends: {crossing[:3]}")
    # a line end stands before each chunk, so that the model's own space doesn't touch it
    lead = len(model.encode("\n"))
    return Vocabulary(space_chunks, spelled, lambda new: [x[lead:] for x in model.encode(["\n" + x for x in new], num_threads=1)])
