"""Scalar text functions as Spark columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation stripped from the edges of words.
EDGE = ".,;:!?'\""
#: Substrings that show wrongly decoded text.
MOJIBAKE = ("Ã", "Ä", "Å", "Â±", "�", "﻿")
#: Characters outside a vocabulary and what stands for them.
FALLBACK = {"Ğ": "ğ", "q": "k", "Â": "A", "î": "i", "Î": "İ", "û": "u", "Û": "U", "!": ".", "“": "", "”": "", '"': "", "«": "", "»": "", "–": ",", "—": ","}


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once; inside a lambda it would be for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: White space of any script, and the separators that count as such.
BLANK = r"\s\x1c-\x1f"
_EDGES = r"[.,;:!?'\"]*"


def stripped(text: Column) -> Column:
    """Text without white space at its ends."""
    return F.regexp_replace(text, f"(?U)^[{BLANK}]+|[{BLANK}]+$", "")


def words(text: Column) -> Column:
    """Words by white space, punctuation stripped from their edges, lower-cased, none empty."""
    inner = F.regexp_replace(F.lower(text), f"(?U)^[{BLANK}.,;:!?'\"]+|[{BLANK}.,;:!?'\"]+$", "")
    return F.filter(F.split(inner, f"(?U){_EDGES}[{BLANK}]+{_EDGES}"), lambda w: w != "")


def ngrams(words_: Column, n: int) -> Column:
    """Runs of n words, joined by spaces; none when there are fewer.  A run that comes again stands
    again: array_distinct compares strings pair by pair, so make them distinct as rows."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(words_, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def word_hashes(words_: Column) -> Column:
    """h, g: two 64-bit hashes of each word, as arrays."""
    return F.struct(F.transform(words_, lambda w: F.xxhash64(w)).alias("h"), F.transform(words_, lambda w: F.xxhash64(w, F.lit(1))).alias("g"))


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def turkish_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def last_vowel(text: Column) -> Column:
    """The last vowel, e where there is none."""
    found = F.regexp_extract(turkish_lower(text), "(?s).*([aeıioöuü])", 1)
    return F.when(found == "", "e").otherwise(found)


def harmonized(vowel: Column, before: Column) -> Column:
    """A suffix vowel after another vowel: a/e by backness; ı/i/u/ü by backness and roundness."""
    back, rounded = before.isin(*"aıou"), before.isin(*"ouöü")
    four = F.when(back & ~rounded, "ı").when(back, "u").when(rounded, "ü").otherwise("i")
    return F.when(vowel.isin("a", "e"), F.when(back, "a").otherwise("e")).when(vowel.isin(*"ıiuü"), four).otherwise(vowel)


def message_type(message: Column) -> Column:
    return F.substring_index(message, ":", 1)


def clip_id(source_id: Column, n: Column, k: Column) -> Column:
    """A source's own id for its only clause, else with the clause's number."""
    return F.when(n == 1, source_id).otherwise(F.concat(source_id, F.lit("_"), k.cast("string")))


def relative_path(path: Column, root: str) -> Column:
    """A path without ``root`` before it."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 20)).otherwise(path)


def decibels(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def semitones(a: Column, b: Column) -> Column:
    """How far a lies above b."""
    return 12 * F.log2(a / b)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals as text: its exact binary value is rounded, halves to even.
    From 2**52 on, where all are whole numbers, digits after the 17th may be zeros."""
    return let(x.cast("double"), lambda v: _fixed(v, digits))


def _fixed(x: Column, digits: int) -> Column:
    scale = float(10**digits)
    product = x * scale
    # the product's rounding error, from halves of both factors whose products are exact
    high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
    scale_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    low, scale_low = x - high(x), scale - scale_high
    error = ((high(x) * scale_high - product) + high(x) * scale_low + low * scale_high) + low * scale_low
    near = F.rint(product)
    off = product - near
    step = F.when((off == 0.5) & (error > 0), 1).when((off == -0.5) & (error < 0), -1).otherwise(F.rint(F.when(F.abs(product) >= 2.0**52, error).otherwise(0.0)))
    whole = F.abs(near.cast("long") + step.cast("long"))
    unit = F.lit(10**digits).cast("long")
    tail = F.concat(F.lit("."), F.lpad((whole % unit).cast("string"), digits, "0")) if digits else F.lit("")
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.call_function("div", whole, unit).cast("string"), tail)
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when(F.abs(x) >= 2.0**52, F.format_string(f"%.{digits}f", x)).otherwise(text))


def rounded(x: Column, digits: int) -> Column:
    """A number rounded as ``fixed`` does."""
    return fixed(x, digits).cast("double")


def char_class(chars: str) -> str:
    """A pattern's class of these characters, in ranges: a class of many single ones is slow."""
    points, ranges = sorted(set(map(ord, chars))), []
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def char_runs(chars: str) -> str:
    """A pattern of runs of these characters.  Java finds a single character below 256 by one look,
    but tries a class's ranges in turn, so most of a Latin text never meets the ranges."""
    low = "".join(f"\\x{{{ord(c):x}}}" for c in sorted(set(chars)) if ord(c) < 256)
    high = char_class("".join(c for c in chars if ord(c) >= 256))
    return "|".join(f"[{c}]+" for c in (low, high) if c)


@lru_cache(maxsize=1)
def _kin() -> dict[str, tuple[str, str]]:
    """Every character of Unicode that has a lower case or a decomposition of its own: the two of
    them, lower case and first character of the decomposition."""
    points = (chr(p) for p in range(sys.maxunicode + 1) if not 0xD800 <= p < 0xE000)
    both = ((c, c.lower(), unicodedata.normalize("NFD", c)[0]) for c in points)
    return {c: (low, base) for c, low, base in both if low != c or base != c}


@lru_cache(maxsize=8)
def stand_ins(vocabulary: str) -> dict[str, str]:
    """What stands for a character that ``vocabulary`` lacks, of all for which something does: a fixed
    one, or else its lower case, or else its base character, whichever the vocabulary has."""
    known = frozenset(vocabulary)
    found = {c: next(x for x in kin if x in known) for c, kin in _kin().items() if not known.isdisjoint(kin)}
    return {c: to for c, to in (found | FALLBACK).items() if c not in known}


def fit_to_vocabulary(text: Column, vocabulary: str) -> Column:
    """Text with only characters of ``vocabulary``; white space is collapsed."""
    found = stand_ins(vocabulary)
    # what has one character in its place is replaced by one call, what has none is dropped by it
    single = {c: to for c, to in found.items() if len(to) == 1}
    dropped = "".join(c for c, to in found.items() if not to)
    fitted = F.translate(text, "".join(single) + dropped, "".join(single.values()))
    listed = char_class(vocabulary + "".join(single.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(fitted, f"[^{listed}]", " "), r"(?U)\s+", " "))


def unmappable(text: Column, vocabulary: str) -> Column:
    """The distinct characters, sorted, for which only a space could stand."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_replace(text, char_runs(vocabulary + "".join(stand_ins(vocabulary))), ""), ""), lambda c: c != "")))
