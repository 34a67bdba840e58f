"""Helpers inside tasks: texts as byte arrays, words, hashes, and objects kept per worker process.

Texts arrive as Arrow columns. Their bytes are looked at as one numpy array with offsets, in
slices of bounded size, so that short texts share the fixed cost of an array operation and a
very long text never needs more than a few arrays of its own length.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
BLOCK = 1 << 20
# Bytes that separate words, of the two word definitions in use.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
ALNUM_RANGES = ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def keep(name: str, build: Callable):
    """An object built once per worker process, also across tasks and queries."""
    store = sys.modules.setdefault("_changeloom_kept", types.ModuleType("_changeloom_kept"))
    if not hasattr(store, name):
        setattr(store, name, build())
    return getattr(store, name)


def release() -> None:
    """Give up what earlier tasks kept in this worker process, and return its free memory to the system.

    Worker processes are used again by later stages; an operator that keeps nothing begins its tasks with this.
    """
    kept = vars(sys.modules.get("_changeloom_kept", types.ModuleType("_changeloom_kept")))
    for name in [name for name in kept if not name.startswith("__")]:
        del kept[name]
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def space_words() -> np.ndarray:
    """Table of bytes that belong to a word: all but ASCII white space."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def alnum_words() -> np.ndarray:
    """Table of bytes that belong to a word: ASCII digits, lower-case letters, all of 0x80 up."""
    table = np.ones(256, bool)
    for low, high in ALNUM_RANGES:
        table[low:high + 1] = False
    return table


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole, offsets.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets from 0); one row at least per slice."""
    if len(column) == 0:
        return
    data, offsets = text_views(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def word_spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; words never cross rows."""
    if len(data) == 0:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    inside = word[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)

    def run(x: int) -> np.ndarray:
        out = np.full(BLOCK + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return stream(11, 256), run(base), run(inverse)


LANES = 128  # words up to this many groups of 8 bytes are hashed as arrays
KEPT = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)  # the first k bytes of a group


def byte_groups(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number; zeros behind the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def equal_spans(left: np.ndarray, starts: np.ndarray, right: np.ndarray, others: np.ndarray, size: np.ndarray) -> bool:
    """Whether spans of two arrays, of the same sizes, hold the same bytes."""
    one, two = byte_groups(left), byte_groups(right)
    at, lane = np.flatnonzero(size > 0), 0
    while len(at) and lane < LANES:
        rest = size[at] - 8 * lane
        if ((one[starts[at] + 8 * lane] ^ two[others[at] + 8 * lane]) & KEPT[np.minimum(rest, 8)]).any():
            return False
        at, lane = at[rest > 8], lane + 1
    return all(np.array_equal(left[starts[k]:starts[k] + size[k]], right[others[k]:others[k] + size[k]]) for k in at.tolist())


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, of their bytes in groups of eight, each mixed into the ones before.

    Spans of up to 8 bytes with the same length never share a hash. Very long spans have the first
    8 bytes of their BLAKE2b digest instead.
    """
    if len(starts) == 0:
        return np.empty(0, np.uint64)
    size = ends - starts
    groups = byte_groups(data)
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
    at, lane = np.flatnonzero((size > 0) & (size <= 8 * LANES)), 0
    while len(at):
        left = size[at] - 8 * lane
        part = groups[starts[at] + 8 * lane] & KEPT[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ part) + np.uint64(0xD1B54A32D192ED03)
        at, lane = at[left > 8], lane + 1
    for k in np.flatnonzero(size > 8 * LANES).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]], digest_size=8).digest(), "little")
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    count = len(words) - n + 1
    total = np.zeros(count, np.uint64)
    for shift, factor in enumerate(stream(23, n) | np.uint64(1)):
        total += words[shift:shift + count] * factor
    return mix(total + np.uint64(n))


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """Index of the first entry of each of ``n`` rows in an ascending row column, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def hexes(parts: list[bytes]) -> list[str]:
    return [hashlib.sha256(part).hexdigest() for part in parts]
