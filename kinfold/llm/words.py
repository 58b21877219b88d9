"""Whole Arrow batches of texts as arrays of words: where they start, their hashes, their rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that are handled at once; a longer text is a batch of its own.
BATCH_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Lower-cases A-Z and leaves other bytes; what is no a-z, digit or part of a character over 0x7F separates.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SEPARATES = np.ones(256, bool)
SEPARATES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits depend on all input bits."""
    high = x >> U64(32)
    x = x ^ high
    x *= U64(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, U64(29), out=high)
    x *= U64(0xA24BAED4963EE407)
    x ^= np.right_shift(x, U64(32), out=high)
    return x


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch, in order."""

    data: np.ndarray  # UTF-8 of all texts, padded
    offsets: np.ndarray  # of the texts in data
    start: np.ndarray
    length: np.ndarray
    hash: np.ndarray

    @cached_property
    def first(self) -> np.ndarray:
        """Index of each text's first word, and the number of words at the end."""
        return np.searchsorted(self.start, self.offsets)

    @cached_property
    def row(self) -> np.ndarray:
        """Each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without a copy of each text, padded by 8; offsets of the texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    texts = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), offsets - offsets[0]


def split(texts: pa.Array, space: np.ndarray = SPACE, fold: np.ndarray | None = None) -> Words:
    """Words of each text: runs of bytes outside ``space``, after each byte is mapped by ``fold``."""
    data, offsets = utf8(texts)
    n = int(offsets[-1])
    if fold is not None:
        data[:n] = fold[data[:n]]
    # Bytes are mapped as bytes, as an array's indexes would be made eight times as long first.
    inside = np.frombuffer(b"\0" + data[:n].tobytes().translate((~space).tobytes()) + b"\0", bool)
    change = inside[1:] != inside[:-1]
    begins = change & inside[1:]
    ends = change & inside[:-1]
    # Words that meet where a text ends and the next one begins are two.
    meet = offsets[inside[offsets] & inside[offsets + 1]]
    begins[meet] = ends[meet] = True
    start = np.flatnonzero(begins)
    length = np.flatnonzero(ends) - start
    return Words(data, offsets, start, length, _hash(data, start, length))


def _hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))
    if not len(start):
        return np.zeros(0, U64)
    out = mix((length.astype(U64) * U64(0x9E3779B97F4A7C15)) ^ (eight[start] & _LOW[np.minimum(length, 8)]))
    left, done = np.flatnonzero(length > 8), 8
    while len(left):
        rest = length[left] - done
        out[left] = mix(out[left] ^ (eight[start[left] + done] & _LOW[np.minimum(rest, 8)]))
        left, done = left[rest > 8], done + 8
    return out


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; runs may cross texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U64(0x9FB21C651E98DF25)
        out += hashes[k : n + k]
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that ``column`` has about ``limit`` bytes in each; no row is cut."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
        group = (np.cumsum(sizes) - sizes) // limit
        at = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
        for a, b in zip(at, at[1:], strict=False):
            yield batch.slice(a, b - a)


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of the ``n`` positions inside a run of ``size`` that begins at one of ``starts``."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, n), -1)
    return np.cumsum(change[:n]) > 0
