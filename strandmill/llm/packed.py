"""Integer arrays as compact bytes, and hashing over many of them at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Low bits of a word that hold a place among the values hashed at once.
_PLACE = (1 << 28) - 1
#: Stands for a null element of an array.
NULL = np.iinfo(np.int64).min


def pack(values: np.ndarray) -> bytes:
    """Item size in one byte, then the values in the smallest of 1, 2, 4 and 8 bytes that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        at = np.iinfo(kind)
        if not len(values) or (values.min() >= at.min and values.max() <= at.max):
            return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()
    return b"\x08" + values.astype(np.int64).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of a list array without null lists; null elements become NULL."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    if values.null_count:
        values = values.fill_null(int(NULL))
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def pack_column(column: str):
    """A mapInArrow function that replaces the integer list `column` by its packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(column)
            values, ends = lists(b.column(at).cast(pa.list_(pa.int64())))
            packed = pa.array([pack(values[i:j]) for i, j in zip(ends[:-1], ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([packed if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit over the whole word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gear(codes: np.ndarray, k: int) -> np.ndarray:
    """Gear rolling hash of every k consecutive codes: h = (h << 1) + G[code], kept to k terms.

    G is a mix of the code, so no table of the alphabet is needed.  Entry i belongs to codes i..i+k-1.
    """
    g = mix(codes.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n = max(0, len(g) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h << np.uint64(1)) + g[j : j + n]
    return mix(h)


def inside(ends: np.ndarray, span: int) -> np.ndarray:
    """Whether a stretch of `span` elements that starts here stays in its array; one entry for each start."""
    n = int(ends[-1])
    ok = np.zeros(max(0, n - span + 1), bool)
    lens = np.diff(ends)
    starts = ends[:-1]
    long = lens >= span
    if not len(ok) or not long.any():
        return ok
    flip = np.zeros(n + 1, np.int8)
    np.add.at(flip, starts[long], 1)
    np.add.at(flip, starts[long] + lens[long] - span + 1, -1)
    return np.cumsum(flip)[: len(ok)].astype(bool)


def minima(h: np.ndarray, ends: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of w consecutive k-grams, and the position of the leftmost least hash in each.

    Two equal windows have their least hash at the same place, so every stretch of k + w - 1
    elements that two arrays share is met by a minimum that both select.
    """
    valid = np.flatnonzero(inside(ends, k + w - 1))
    if not len(valid):
        return valid, valid
    # hash and place in one word, so the least word is the leftmost least hash
    x = (h & ~np.uint64(_PLACE)) | (np.arange(len(h), dtype=np.uint64) & np.uint64(_PLACE))
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return valid, valid + ((x[valid] - valid.astype(np.uint64)) & np.uint64(_PLACE)).astype(np.int64)


def windows(codes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """A 64-bit digest of the `span` codes from each start: a polynomial of mixed codes over its prefix sums."""
    n = len(codes)
    base, inverse = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    powers = np.full(n + 1, base, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.int64).view(np.uint64) + np.uint64(0xD1B54A32D192ED03)) * powers[:n], out=sums[1:])
    back = np.full(n + 1, inverse, np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    return mix((sums[starts + span] - sums[starts]) * back[starts])


def document(ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The index of the array that holds each position."""
    return np.searchsorted(ends, at, side="right") - 1
