"""Tokenizing and hashing of whole Arrow text columns in numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A word is a run of ASCII letters and digits and of bytes of non-ASCII characters, after lower-casing.
WORD = np.zeros(256, dtype=bool)
WORD[[*range(48, 58), *range(97, 123), *range(65, 91), *range(128, 256)]] = True
#: The same as a pattern for SQL engines and tests.
WORD_PATTERN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """hash: one a word, in order; first: where each document's words begin, with the end appended; start, end: byte places in data."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and each one's offset with the end appended."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def range_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair of places, from one pass of prefix sums."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, n), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power(_P_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))


def words(texts: pa.Array) -> Words:
    """The words of the lower-cased texts."""
    data, offsets = text_bytes(pc.utf8_lower(texts))
    inside = WORD[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    at = offsets[(offsets > 0) & (offsets < len(data))]
    before[at] = False
    after[at - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(range_hash(data, start, end), np.searchsorted(start, offsets), start, end, data)


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of words, and where each document's begin. A document of fewer words (but some) has one gram of them all."""
    count = np.diff(w.first)
    total = len(w.hash)
    padded = np.concatenate([w.hash, np.zeros(n, np.uint64)])
    grams = np.zeros(total, dtype=np.uint64)
    doc = np.repeat(np.arange(len(count)), count)
    last = w.first[1:][doc]
    place = np.arange(total)
    for k in range(n):
        part = mix(padded[k : k + total] + np.uint64(k * 0x632BE59BD9B4E019 & (2**64 - 1)))
        grams = np.where(place + k < last, grams * np.uint64(0x100000001B3) + part, grams)
    keep = (place + n <= last) | ((count[doc] < n) & (place == w.first[:-1][doc]))
    return mix(grams[keep]), np.concatenate([[0], np.cumsum(keep)])[w.first]


def chunks(batch: pa.RecordBatch, column: str = "text", at_most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about so many bytes of text, so that temporary arrays stay small; one longer text is a slice by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    total, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
