"""Expressions on base strings (A, C, G, T, N)."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Base codes and complements.
BASES, CODES, COMPLEMENT = "ACGTN", "01234", "TGCAN"


def encode(seq: Column) -> Column:
    """Bases to digits 0..4, case-insensitive."""
    return F.translate(F.upper(seq), BASES, CODES)


def decode(codes: Column) -> Column:
    return F.translate(codes, CODES, BASES)


def one_hot(seq: Column) -> Column:
    """array<array<tinyint>>: four channels a base, N all zero."""
    return F.transform(F.split(F.upper(seq), ""), lambda b: F.array(*[(b == c).cast("tinyint") for c in "ACGT"]))


def gc_fraction(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "GC", ""))) / F.length(seq)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), BASES, COMPLEMENT)


def splice(seq: Column, piece: Column, at: Column) -> Column:
    """The sequence with ``piece`` written over it from position ``at`` (from 0)."""
    return F.overlay(seq, piece, at + 1)


def count_of(seq: Column, piece: str) -> Column:
    """Non-overlapping occurrences."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(piece), F.lit("")))) / len(piece)).cast("long")


def blocks(seq: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` bases, in one pass over the sequence."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))


#: A prime below 2 ** 31: squares of smaller numbers fit into 64 bits.
PRIME = 2147483647


def _numbers(key: str, n: int) -> np.ndarray:
    """The places' order from two numbers of 28 bits of the key's md5, by squares modulo PRIME."""
    digest = hashlib.md5(key.encode()).hexdigest()
    x = (int(digest[:7], 16) + np.arange(n)) % PRIME
    y = (x * x + int(digest[7:14], 16)) % PRIME
    # Sorted as numbers with their places behind them: the stable order, faster than through an index.
    packed = ((y * y + x) % PRIME << 32) | np.arange(n)
    packed.sort()
    return packed & 0xFFFFFFFF


def _digests(key: str, n: int) -> np.ndarray:
    """The places' order from one md5 each, of the key and the place."""
    start = key.encode() + b":"
    digests = np.frombuffer(b"".join(hashlib.md5(start + b"%d" % i).digest() for i in range(n)), ">u8").reshape(n, 2)
    return np.lexsort((digests[:, 1], digests[:, 0]))


def shuffled_blocks(text: str, key: str, size: int = 2, digests: bool = False) -> str:
    """The blocks of a text in an order fixed by the key (with its seed) and their places."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = -(-len(codes) // size)
    order = (_digests if digests else _numbers)(key, n)
    places = (order[:, None] * size + np.arange(size)).ravel()
    return codes[places[places < len(codes)]].tobytes().decode("utf-32-le")


#: Blocks of the arrays that are shuffled by one sort: their places and the arrays' numbers have 16 bits each, the numbers of their order 31.
PLACES = 1 << 16


def shuffled_codes(arrays: list[np.ndarray], keys: list[str], size: int = 2) -> list[np.ndarray]:
    """``shuffled_blocks`` for arrays of numbers that are -1 or more, of any lengths."""
    counts = np.array([-(-len(c) // size) for c in arrays], dtype=np.int64)
    total = int(counts.sum())
    if len(arrays) > 1 and max(total, len(arrays)) > PLACES:
        half = len(arrays) // 2
        return shuffled_codes(arrays[:half], keys[:half], size) + shuffled_codes(arrays[half:], keys[half:], size)
    if total == 0:
        return list(arrays)
    if len(arrays) == 1:
        order = _numbers(keys[0], total)
    else:
        digests = [hashlib.md5(k.encode()).hexdigest() for k in keys]
        x, second = (np.repeat(np.array([int(d[at : at + 7], 16) for d in digests]), counts) for at in (0, 7))
        places, owner = np.arange(total), np.repeat(np.arange(len(arrays)), counts)
        x = (x + places - np.repeat(np.cumsum(counts) - counts, counts)) % PRIME
        y = (x * x + second) % PRIME
        packed = owner << 47 | (y * y + x) % PRIME << 16 | places
        packed.sort()
        order = packed & 0xFFFF
    parts = []
    for c in arrays:
        parts.append(c)
        if len(c) % size:
            parts.append(np.full(size - len(c) % size, -2))
    whole = np.take(np.concatenate(parts).reshape(total, size), order, axis=0).ravel()
    whole = whole[whole > -2]
    ends = np.cumsum([len(c) for c in arrays])
    return [whole[e - len(c) : e] for c, e in zip(arrays, ends, strict=True)]


def shuffled_together(texts: list[str], keys: list[str], size: int = 2) -> list[str]:
    """``shuffled_blocks`` of each text, for texts of one length at once."""
    width, n = len(texts[0]), -(-len(texts[0]) // size)
    digests = [hashlib.md5(k.encode()).hexdigest() for k in keys]
    first, second = (np.array([int(d[at : at + 7], 16) for d in digests])[:, None] for at in (0, 7))
    x = (first + np.arange(n)) % PRIME
    y = (x * x + second) % PRIME
    order = np.argsort((y * y + x) % PRIME, axis=1, kind="stable")
    places = (order[:, :, None] * size + np.arange(size)).reshape(len(texts), -1)
    places = places[places < width].reshape(len(texts), width)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), width)
    whole = np.take_along_axis(codes, places, 1).tobytes().decode("utf-32-le")
    return [whole[at : at + width] for at in range(0, len(whole), width)]


#: Code points of the texts of one length that are shuffled at once.
TOGETHER = 1 << 16


def shuffled_texts(texts: list[str | None], keys: list[str | None], size: int = 2, digests: bool = False) -> list[str | None]:
    """Each text's ``shuffled_blocks`` by its key; a text without key stays."""
    out, by_width = list(texts), {}
    for i, (t, k) in enumerate(zip(texts, keys, strict=True)):
        if t and k is not None:
            by_width.setdefault(len(t), []).append(i)
    for width, rows in by_width.items():
        step = max(1, TOGETHER // width)
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            if digests or len(some) == 1:
                made = [shuffled_blocks(texts[i], keys[i], size, digests) for i in some]
            else:
                made = shuffled_together([texts[i] for i in some], [keys[i] for i in some], size)
            for i, m in zip(some, made, strict=True):
                out[i] = m
    return out


def block_shuffle(seq: Column, key: Column, seed: str, size: int = 2, digests: bool = False) -> Column:
    """Blocks of two bases in an order fixed by key, seed and place: composition of blocks stays. A null key leaves the sequence as it is.

    Each place has its number in the order from one md5 a sequence, or with ``digests`` from one md5 a place.
    """

    def run(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series(shuffled_texts(texts.tolist(), keys.tolist(), size, digests), dtype=object)

    keyed = F.when(key.isNotNull(), F.concat_ws(":", key.cast("string"), F.lit(seed)))
    return F.pandas_udf(run, "string")(seq, keyed)


def kmers(seq: Column, k: int) -> Column:
    """All windows of k bases, in one pass over the sequence; empty if it is shorter."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def fragment_around(seq: Column, first: Column, last: Column, length: int) -> Column:
    """``length`` bases centred on first..last, kept inside the sequence."""
    start = F.greatest(F.lit(0), F.least(F.floor((first + last - length) / 2), F.length(seq) - length))
    return F.substring(seq, (start + 1).cast("int"), F.lit(length))


def compatible(seq: Column, forbidden: list[str], length: int | None = None, gc: tuple[float, float] | None = None) -> Column:
    """No forbidden site on either strand, no N, and the given length and GC range."""
    ok = ~F.contains(seq, F.lit("N"))
    for site in forbidden:
        ok &= ~F.contains(seq, F.lit(site)) & ~F.contains(reverse_complement(seq), F.lit(site))
    if length is not None:
        ok &= F.length(seq) == length
    if gc is not None:
        ok &= gc_fraction(seq).between(*gc)
    return ok


def hamming(a: Column, b: Column) -> Column:
    """Number of differing places of two strings of one length."""
    differs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y)
    return F.size(F.filter(differs, lambda x: x))


def hashed_bases(key: Column, seed: str, length: int) -> Column:
    """A repeatable random sequence: hexadecimal digits of md5 folded to bases."""
    digits = F.concat(*[F.md5(F.concat_ws(":", key.cast("string"), F.lit(seed), F.lit(str(i)))) for i in range(-(-length // 32))])
    return F.translate(F.substring(digits, 1, length), "0123456789abcdef", "ACGTACGTACGTACGT")


def clean_motif_name(name: Column) -> Column:
    """Cluster prefix, database suffix and trailing number taken off."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^HCLUST-\d+_", ""), r"\.UNK\.0\.A", ""), r"\d+$", "")


def flags_of(text: Column) -> Column:
    """A string of 1, 0 and x as integers, x being 0."""
    return F.transform(F.split(text, ""), lambda c: F.when(c == "1", 1).otherwise(0))


def presence_text(names: Column, flags: Column) -> Column:
    """``A+,B-`` from names and flags."""
    return F.array_join(F.zip_with(names, flags, lambda n, f: F.concat(n, F.when(f == 1, F.lit("+")).otherwise(F.lit("-")))), ",")


def conditional_text(names: Column, flags: Column, changed: Column) -> Column:
    """``f(seq | do(A+), B-)``: names with their state, those in ``changed`` (flags) marked as intervened."""
    marks = F.zip_with(F.zip_with(names, flags, lambda n, f: F.concat(n, F.when(f == 1, F.lit("+")).otherwise(F.lit("-")))), changed, lambda t, c: F.when(c == 1, F.concat(F.lit("do("), t, F.lit(")"))).otherwise(t))
    return F.concat(F.lit("f(seq | "), F.array_join(marks, ", "), F.lit(")"))
