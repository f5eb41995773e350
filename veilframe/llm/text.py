"""Vectorised word work on the UTF-8 bytes of an Arrow text column.

Texts are handled in chunks of whole rows of about ``CHUNK`` bytes, so memory follows the longest
text, not the batch.  Words and word runs are identified by 64-bit polynomial hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BATCH, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
BATCH_BYTES = 8 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates: all but blank, \t, \n, \v, \f and \r.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words made of ASCII digits, lower-case ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, U)
    return tuple(np.concatenate([one, np.cumprod(np.full(size, x, U))]) for x in (BASE, INVERSE))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``size`` of each."""
    return _powers(max(CHUNK, 1 << int(size).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (constants of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def bound_batches(spark) -> None:
    """Arrow batches of about ``BATCH_BYTES`` from now on in this session, unless it names a size of its own.

    Spark's own bound of 64 MB stands, as buffers double and both sides hold copies, for several times that in each task.
    """
    if spark.conf.get(BATCH).rstrip("b") == str(BATCH_DEFAULT):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets into them) of runs of rows; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of words, and each row's first word; no word crosses a row's end."""
    inside = np.zeros(len(buf) + 1, bool)
    inside[:-1] = table[buf]
    before = np.zeros(len(buf) + 1, bool)
    before[1:] = inside[:-1]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (~before | cut))
    ends = np.flatnonzero(before & (~inside | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * powers(len(buf))[0][: len(buf)], out=out[1:])
    return out


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes, wherever it stands."""
    prefix = prefix_hash(buf)
    return mix((prefix[ends] - prefix[starts]) * powers(len(buf))[1][starts] + (ends - starts).astype(U))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words, ``len(words) - length + 1`` of them."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.full(n, length, U)
    for i in range(length):
        out = mix(out * U(BASE) + words[i : i + n])
    return out


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int = 5, table: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """Each row's sorted distinct ``size``-word shingles; a shorter text is one shingle, none is empty."""
    buf = LOWER[buf]
    starts, ends, firsts = word_bounds(buf, offsets, table)
    words = word_hashes(buf, starts, ends)
    runs = run_hashes(words, size)
    for a, b in zip(firsts[:-1], firsts[1:]):
        if b - a >= size:
            yield np.unique(runs[a : b - size + 1])
        else:
            yield run_hashes(words[a:b], int(b - a)) if b > a else np.empty(0, U)
