"""Vectorised kernels over Arrow string columns, shared by the text operators.

Words are hashed straight from the UTF-8 buffer: a polynomial hash per word from
prefix sums, then a mixing step.  No Python string is made per word, and the
working set is bounded by ``GROUP`` bytes of text plus one longest document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, of the documents that a kernel works on at once, and of a piece of these.
BATCH, _LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
GROUP = 1 << 20
SLICE = 1 << 19

U64 = np.uint64
_C = [U64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_BASE = 0x9E3779B97F4A7C55


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + _C[0]
    x ^= x >> U64(30)
    x *= _C[1]
    x ^= x >> U64(27)
    x *= _C[2]
    x ^= x >> U64(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    return mix(np.arange(start, start + n, dtype=U64) * _C[3])


_BYTE = seeds(256, 1000)
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for at least n places."""
    if not _POW or len(_POW["up"]) < n:
        size = max(n, SLICE + (SLICE >> 2))
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 1 << 64), U64)
            up[0] = down[0] = 1
            _POW["up"], _POW["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW["up"], _POW["down"]


def freed(run: Callable) -> Callable:
    """``run`` over a task's batches; at its end the worker, which later stages use again, hands unused memory back to the system.

    A batch is held by the JVM and, in several forms, by the worker, so the session's limit of its bytes is lowered to ``BATCH``.
    """
    spark = SparkSession.getActiveSession()
    now = spark.conf.get(_LIMIT).removesuffix("b") if spark else ""
    if now.isdigit() and int(now) > BATCH:
        spark.conf.set(_LIMIT, BATCH)

    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


#: Bytes between words: white space; or everything but digits, ASCII letters and what is beyond ASCII.
SPACE = table(bytes([0x20, *range(0x09, 0x0E)]))
NOT_ALNUM = table(bytes(x for x in range(128) if not chr(x).isalnum()))
NOT_LETTER = table(bytes(x for x in range(128) if not chr(x).isalpha()))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, offsets (one more than rows) and validity of a string column; null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    valid = np.asarray(column.is_valid())
    _, off, data = column.buffers()
    if off is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), valid
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0], valid


def groups(offsets: np.ndarray, size: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs [lo, hi) of documents of about ``size`` bytes, one document at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte, end byte of every word, and each document's first word (one entry more than documents).

    ``buf`` holds the documents back to back at ``offsets``; a document's edge ends a word.
    """
    n = len(buf)
    hashes, firsts, ends = [], [], []
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    lo = 0
    while lo < n:
        hi = min(n, lo + SLICE)
        if hi < n:  # cut between words
            back = np.flatnonzero(sep[buf[lo:hi]] | edge[lo:hi])
            if len(back) and back[-1] > 0:
                hi = lo + int(back[-1])
            else:
                while hi < n:
                    ahead = np.flatnonzero(sep[buf[hi : hi + SLICE]] | edge[hi : min(n, hi + SLICE)])
                    if len(ahead):
                        hi += int(ahead[0])
                        break
                    hi = min(n, hi + SLICE)
        b = buf[lo:hi]
        inside = ~sep[b]
        before = np.empty(hi - lo, bool)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[lo:hi]))
        after = np.empty(hi - lo, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        stops = np.flatnonzero(inside & (~after | edge[lo + 1 : hi + 1])) + 1
        if len(starts):
            up, down = _powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, U64)
            np.cumsum(_BYTE[_LOWER[b] if lower else b] * up[: hi - lo], out=total[1:])
            h = (total[stops] - total[starts]) * down[starts]
            hashes.append(mix(h + (stops - starts).astype(U64) * _C[3]))
            firsts.append(starts + lo)
            ends.append(stops + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, offsets)


def word_hash(word: str, lower: bool = False) -> int:
    """The hash that ``words`` gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)]), np.zeros(256, bool), lower)[0][0])


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; windows across documents are the caller's to leave out."""
    if len(h) < k:
        return np.zeros(0, U64)
    n = len(h) - k + 1
    out = np.zeros(n, U64)
    for i, c in enumerate(seeds(k, 77)):
        out += h[i : i + n] * (c | U64(1))
    return mix(out)


def crc_rest(doc_id, n: int):
    """crc32 of a document's id as text, modulo n, as a Column."""
    from pyspark.sql import functions as F

    return F.crc32(doc_id.cast("string")) % n
