"""Words of whole Arrow columns as 64-bit hashes, without a Python loop over words.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and return. Its hash is a
polynomial over per-byte random values modulo 2**64, mixed with its length, so that equal words hash alike in any
row, batch and process.
"""

from __future__ import annotations

import ctypes
import functools
import mmap
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: glibc's, where there is one.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Every ASCII character but letters and digits.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


with np.errstate(over="ignore"):
    _BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_ROOT = 0xC2B2AE3D27D4EB4F
_BACK = pow(_ROOT, -1, 1 << 64)
#: Bytes of text in a piece, and the longest table of powers that a process keeps.
PIECE_BYTES = 1 << 20
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64. Those of a piece are kept for the process, those of a longer text are not."""
    if n <= len(_powers.get(name, ())):
        return _powers[name][:n]
    p = np.full(max(n, 1 << 16), _U(base))
    p[0] = 1
    p = np.multiply.accumulate(p)
    if n <= PIECE_BYTES:
        _powers[name] = p
    return p[:n]


#: A task gives memory back only where the process holds more: giving back and taking again costs time.
MOST_HELD = 160 << 20


def release() -> None:
    """Give back what a task has freed: workers are used again, and their allocators keep memory otherwise."""
    if resident() > MOST_HELD:
        _powers.clear()
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def resident() -> int:
    """Bytes that this process holds now; 0 where the system doesn't say."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * mmap.PAGESIZE
    except OSError:
        return 0


def releasing(f: Callable) -> Callable:
    """A mapInArrow function, or its __call__, that gives back its memory when it ends."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            release()

    return run


@dataclass
class Words:
    """hashes of all words in turn; those of text i are hashes[at[i]:at[i + 1]]; start and end: bytes in data."""

    hashes: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def words(column: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR, tail: np.ndarray | None = None) -> Words:
    """Split every text of the column at separator bytes and hash its words; lower folds A to Z.

    tail: bytes that are words of their own where they end a word after an ASCII letter.
    """
    data, at = raw(column)
    if lower:
        data = LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none, data)
    inside = ~separator[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = at[1:] > at[:-1]
    heads, tails = at[:-1][filled], at[1:][filled] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    if tail is not None:
        cut = np.flatnonzero(last & tail[data] & ~first)
        cut = cut[LETTER[data[cut - 1]]]
        first[cut], last[cut - 1] = True, True
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _power("up", _ROOT, n), out=sums[1:])
        h = (sums[end] - sums[start]) * _power("down", _BACK, n)[start]
        h = mix64(h + (end - start).astype(np.uint64))
    return Words(h, np.searchsorted(start, at), start, end, data)


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that work space stays bounded; a longer text is alone."""
    at = raw(batch.column(column))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def combine(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, over all texts put together; runs across texts are the caller's to drop."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out *= _U(0x9E3779B97F4A7C15)
            out += h[k : k + n]
        return mix64(out)


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of data that begin at start, one after another."""
    total = np.cumsum(length)
    return data[np.repeat(start - (total - length), length) + np.arange(total[-1] if len(total) else 0)]


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` bytes."""
    n = len(data)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[data] * _power("up", _ROOT, n), out=sums[1:])
        return mix64((sums[width:] - sums[:-width]) * _power("down", _BACK, n)[: n - width + 1])


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Of each run of ``width`` values the place of the least, the leftmost of equal ones.

    By blocks of that width: a run is the end of one block and the beginning of the next.
    """
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = np.full((-(-len(h) // width), width), ~_U(0))
    blocks.reshape(-1)[: len(h)] = h
    column = np.arange(width, dtype=np.int64)
    up = np.minimum.accumulate(blocks, axis=1)
    newer = np.ones(blocks.shape, bool)
    newer[:, 1:] = blocks[:, 1:] < up[:, :-1]
    first = np.maximum.accumulate(np.where(newer, column, 0), axis=1)
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    newer[:] = True
    newer[:, :-1] = blocks[:, :-1] <= down[:, 1:]
    last = np.minimum.accumulate(np.where(newer, column, width)[:, ::-1], axis=1)[:, ::-1]
    base = np.arange(len(blocks))[:, None] * width
    head, tail = (first + base).reshape(-1)[width - 1 : len(h)], (last + base).reshape(-1)[:n]
    return np.where(down.reshape(-1)[:n] <= up.reshape(-1)[width - 1 : len(h)], tail, head)
