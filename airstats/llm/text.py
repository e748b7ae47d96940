"""Words and hashes of many texts at once, with numpy over Arrow's own buffers.

A block is the UTF-8 bytes of several texts one after the other and the offsets at which they
begin. All hashes are 64 bits wide and depend on the bytes alone, so they agree between tasks,
retries and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a block of its own.
BLOCK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _table(excluded: str) -> np.ndarray:
    table = np.ones(256, bool)
    for part in excluded.split():
        low, high = (int(x, 16) for x in part.split("-"))
        table[low:high + 1] = False
    return table


#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = _table("20-20 09-0d")
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, for lower-cased texts.
ALNUM = _table("00-2f 3a-60 7b-7f")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * _GOLD)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    both = []
    for base in (_BASE, inverse):
        steps = np.full(size + 1, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps, dtype=np.uint64))
    return both[0], both[1]


@dataclass
class Block:
    """Bytes of texts ``first`` .. ``first + len`` of a batch; ``offsets`` has one entry more."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> "Ranges":
        return Ranges(self.data)


class Ranges:
    """Hashes of any byte ranges of a block, each in constant time."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        self.powers, self.inverse = _powers(size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * self.powers[:len(data)], out=self.sums[1:], dtype=np.uint64)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and their offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    _, places, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(places, np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Consecutive texts of at most ``size`` bytes together, or one longer text alone."""
    data, offsets = text_bytes(column)
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield Block(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Byte ranges of words in reading order, the text of each, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    bounds: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def find_words(block: Block, table: np.ndarray) -> Words:
    """Maximal runs of the bytes in ``table``; a run ends where its text ends."""
    inside = table[block.data]
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    edges = block.offsets[:-1]
    before[edges[edges < len(inside)]] = False
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    edges = block.offsets[1:] - 1
    after[edges[edges >= 0]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, block.offsets)
    return Words(starts, ends, np.repeat(np.arange(len(block)), np.diff(bounds)), bounds)


def shingles(hashes: np.ndarray, words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words and the word each begins at; texts don't mix."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(hashes) - size + 1
    total = np.zeros(count, np.uint64)
    for i in range(size):
        total = total * _BASE + hashes[i:i + count]
    at = np.flatnonzero(words.text[:count] == words.text[size - 1:])
    return mixed(total[at] + _GOLD), at


def joint(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A hash for each pair of a hash and the number of its text."""
    return mixed(hashes ^ mixed((text.astype(np.uint64) + np.uint64(1)) * _GOLD))


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of byte-wise counts over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def sub_batches(batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of a batch with the block of their texts."""
    for block in blocks(batch.column(text)):
        yield batch.slice(block.first, len(block)), Block(0, block.data, block.offsets)
