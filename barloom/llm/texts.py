"""Arrow texts as flat numpy arrays: slices of bounded size, words, window hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: The characters between words: space and U+0009 to U+000D.
BLANKS = b"\t\n\x0b\x0c\r "
SLICE_BYTES = 2 << 20

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True


def slices(batch: pa.RecordBatch, column: str | int = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text each; a longer
    text is a part of its own, so no text is ever cut. Memory that Arrow holds back is given up after each
    batch, as workers live on for later stages."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > first and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    yield batch.slice(first)
    pa.default_memory_pool().release_unused()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of each; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lowered(data: np.ndarray) -> np.ndarray:
    """A to Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Words:
    """Words of a column of texts. ``bounds[i]`` to ``bounds[i + 1]`` are those of text i.
    ``change`` may map the bytes, ``cut`` may mark further bytes that begin a word."""

    def __init__(self, texts: pa.Array, change=None, cut=None):
        data, self.offsets = flat(texts)
        if change is not None:
            data = change(data)
        self.data = data
        n = len(data)
        self.ink = ink = ~_BLANK[data]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        if cut is not None and n:
            begins = cut(data)
            first |= begins
            last[:-1] |= begins[1:]
        heads, tails = self.offsets[:-1], self.offsets[1:] - 1
        heads, tails = heads[heads < n], tails[tails >= 0]
        first[heads] = ink[heads]
        last[tails] = ink[tails]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @cached_property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)

    @cached_property
    def array(self) -> pa.Array:
        """The words without what stands between them."""
        at = np.concatenate([[0], np.cumsum(self.ends - self.starts)]).astype(np.int64)
        return binary(at, self.data[self.ink])

    @cached_property
    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """The number of each word in the list of different words, and that list."""
        coded = self.array.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    @cached_property
    def hashes(self) -> np.ndarray:
        codes, words = self.coded
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
        return own[codes] if len(codes) else np.zeros(0, np.uint64)


def binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values: a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """Hashes of runs of consecutive values, any length, from one pass of prefix sums:
    a polynomial in an odd base modulo 2**64, whose powers have inverses."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, values: np.ndarray):
        n = len(values)
        up = np.full(n + 1, self.BASE, np.uint64)
        down = np.full(n + 1, pow(self.BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        up = np.multiply.accumulate(up)
        self.down = np.multiply.accumulate(down)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


def chunks(data: np.ndarray, solid: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of ``data``, about ``limit`` bytes each, that end where a
    byte is not ``solid`` (a table of 256), so no word is cut; a longer word makes a longer part."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        if end < n and solid[data[end]]:
            gaps = np.flatnonzero(~solid[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            while end < n and solid[data[end - 1]] and solid[data[end]]:
                gaps = np.flatnonzero(~solid[data[end : end + limit]])
                end = end + int(gaps[0]) if len(gaps) else min(end + limit, n)
        yield at, end
        at = end
