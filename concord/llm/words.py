"""Words and shingles of Arrow text columns as NumPy arrays, and hash tables of fixed size.

Text is handled as UTF-8 bytes with A-Z lower-cased. A word is a run of word bytes; every byte
of a character outside ASCII is a word byte, so whole characters stay together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text turned into arrays at a time; a longer text is cut between words.
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words are runs of anything but blank and the controls 9 to 13.
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words are runs of digits, a-z and characters outside ASCII.
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROUND = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits."""
    x = (x ^ (x >> _SHIFT)) * _ROUND
    x = (x ^ (x >> _SHIFT)) * _ROUND
    return x ^ (x >> _SHIFT)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [
            np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, SLICE_BYTES) - 1, b, np.uint64))))
            for b in (_BASE, inverse)
        ]
    return _powers[0][:n], _powers[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``, the same wherever the bytes stand."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All text of a column as one byte array, and where each row starts and ends in it. Null is empty."""
    column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(offsets) else (data, np.zeros(1, np.int64))


@dataclass
class Words:
    """Words of some rows: the row, first byte, byte after the last, and hash of each."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def _cuts(inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE_BYTES that end where no word goes on."""
    at, n = 0, len(inside)
    while at < n:
        stop = min(n, at + SLICE_BYTES)
        while stop < n and inside[stop]:
            gap = np.flatnonzero(~inside[stop : stop + SLICE_BYTES])
            stop = stop + int(gap[0]) if len(gap) else min(n, stop + SLICE_BYTES)
        yield at, stop
        at = stop


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Words of every row; ``kind`` says which bytes belong to words."""
    data = LOWER[data]
    inside = kind[data]
    # A word must not run on from one row into the next.
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    hashes = np.empty(len(starts), np.uint64)
    done = 0
    for at, stop in _cuts(inside):
        upto = int(np.searchsorted(starts, stop))
        hashes[done:upto] = span_hashes(data[at:stop], starts[done:upto] - at, ends[done:upto] - at)
        done = upto
    row = np.searchsorted(offsets, starts, side="right") - 1
    return Words(row, starts, ends, hashes, np.bincount(row, minlength=len(offsets) - 1))


def shingles(found: Words, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each row; fewer words than ``size`` make one shingle, none make none."""
    h = found.hash
    rolled = h.copy()
    for k in range(1, min(size, len(h))):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k]) + h[k:]
    rolled = mix(rolled)
    at = 0
    for n in found.counts.tolist():
        if n >= size:
            yield np.unique(rolled[at : at + n - size + 1])
        elif n:
            one = h[at : at + 1].copy()
            for k in range(1, n):
                one = mix(one) + h[at + k]
            yield mix(one + np.uint64(n))
        else:
            yield h[:0]
        at += n


def parts(batch: pa.RecordBatch, text: str, limit: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` bytes of text each, or one row."""
    column = batch.column(batch.schema.get_field_index(text)).fill_null("")
    ends = np.cumsum(pa.compute.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop
