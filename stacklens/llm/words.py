"""Words of whole Arrow columns as 64-bit hashes, and counts in a table of fixed size.

A word is a longest run of bytes that are not ASCII white space (space, tab, line break, vertical tab, form
feed, carriage return). Hashes are taken for all words of a column at once, from running sums of bytes times
powers of an odd number, so no Python object is made for a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = 0x9E3779B97F4A7C15
#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 19
_POWERS: list[np.ndarray] = []


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads bits; another one for each seed."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + BASE) % 2 ** 64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse ** i, modulo 2 ** 64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK * 2)
        tables = [np.full(size, b, np.uint64) for b in (BASE, pow(BASE, -1, 2 ** 64))]
        for t in tables:
            t[0] = 1
        _POWERS[:] = [np.cumprod(t, dtype=np.uint64) for t in tables]
    return _POWERS[0], _POWERS[1]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, the bytes, and the rows' starts within them, of parts of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(at, at[first] + CHUNK, side="right")) - 1)
        yield first, last, data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def words(data: np.ndarray, starts: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Places where words start, and their hashes; ``starts`` are the texts' starts and the end of the last."""
    solid = ~space[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    own = starts[:-1][starts[:-1] < len(data)]
    begins[own] = solid[own]
    ends = solid.copy()
    ends[:-1] &= begins[1:] | ~solid[1:]
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], dtype=np.uint64)])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return first, mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))


def hashed_counts(df: DataFrame, hashes, slots: int, rows: int = 1) -> np.ndarray:
    """How often hashes fall into each slot of ``rows`` tables of ``slots``, up to 65535; of fixed size on the driver.

    ``hashes`` gives arrays of 64-bit hashes for a batch of ``df``. Each task sends its counts in compressed pieces,
    those that hold any.
    """
    size = min(slots, 1 << 16)

    def run(batches):
        n = np.zeros((rows, slots), np.uint32)
        for b in batches:
            for h in hashes(b):
                for r in range(rows):
                    np.add.at(n[r], slot_of(h, slots, r), np.uint32(1))  # in place, without a table for each call
        for i, part in enumerate(n.reshape(-1, size)):
            if part.any():
                piece = zlib.compress(np.minimum(part, 65535).astype("<u2").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([piece], pa.binary())], ["part", "n"])

    def add(key, table):
        total = np.zeros(size, np.int64)
        for x in table["n"].to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u2")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()),
                         "n": pa.array([np.minimum(total, 65535).astype("<u2").tobytes()], pa.binary())})

    out = np.zeros((rows * slots // size, size), "<u2")
    for r in df.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"]] = np.frombuffer(r["n"], "<u2")
    return out.reshape(rows, slots)


def hashed_bits(df: DataFrame, hashes, slots: int) -> np.ndarray:
    """Into which of ``slots`` slots any hash falls, a bit each; of fixed size on the driver, as ``hashed_counts``."""
    size = min(slots // 8, 1 << 16)

    def run(batches):
        bits = np.zeros(slots // 8, np.uint8)
        for b in batches:
            for h in hashes(b):
                at = slot_of(h, slots)
                np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for i, part in enumerate(bits.reshape(-1, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["part", "n"])

    def add(key, table):
        total = np.zeros(size, np.uint8)
        for x in table["n"].to_pylist():
            total |= np.frombuffer(zlib.decompress(x), np.uint8)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((slots // 8 // size, size), np.uint8)
    for r in df.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect():
        out[r["part"]] = np.frombuffer(r["n"], np.uint8)
    return out.reshape(-1)


def in_bits(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes fall into a slot that has its bit: all that were counted, and few others."""
    at = slot_of(h, len(bits) * 8)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def slot_of(h: np.ndarray, slots: int, row: int = 0) -> np.ndarray:
    return (mix(h, 90 + row) % np.uint64(slots)).astype(np.int64)


def count_of(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The least of a hash's counts in the rows of a table: never less than how often it was counted."""
    out = table[0][slot_of(h, table.shape[1])]
    for r in range(1, len(table)):
        out = np.minimum(out, table[r][slot_of(h, table.shape[1], r)])
    return out
