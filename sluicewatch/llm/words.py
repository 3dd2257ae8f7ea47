"""Hashes of the words of whole texts, straight from Arrow buffers, without a Python object per word."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; a longer document is one piece by itself.
PIECE = 1 << 20
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII bytes other than letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, PIECE + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up), np.cumprod(down)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, ends) for runs of rows with about ``most`` bytes: the UTF-8 of their texts end to
    end and where each one ends. NULL is empty."""
    texts = batch.column(column)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        to = min(to, n)
        yield slice(at, to), data[offsets[at]:offsets[to]], offsets[at + 1:to + 1] - offsets[at]
        at = to
    give_back()


def give_back() -> None:
    """Returns what a worker has freed to the system: it lives on for the next stages, beside the JVM of its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc has it
    if trim:
        trim(0)


def words(data: np.ndarray, ends: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, stop) of each word, ASCII letters taken as lower case.

    A word is a run of bytes not marked in ``apart``; none crosses the end of a document.
    """
    n = len(data)
    inside = ~apart[data]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1])) if n else np.zeros(0, np.int64)
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1 if n else start
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))
    return hashes, np.searchsorted(ends, start, side="right"), start, stop


def shingles(hashes: np.ndarray, document: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of each run of ``width`` words within a document."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    out = hashes[:n] * np.uint64(3)
    for k in range(1, width):
        out = mix(out + np.uint64(k)) + hashes[k:n + k]
    whole = np.flatnonzero(document[:n] == document[width - 1:])
    return mix(out)[whole], document[whole], whole
