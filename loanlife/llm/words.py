"""Words, word hashes and shingles of whole texts, a batch of rows at a time.

A word is ``[^\\x20\\x09-\\x0D]+``. Texts are treated as UTF-8 bytes; all steps are array
operations over a slice of rows, so no Python code runs per word. Slices end at row borders and
hold about ``SLICE_BYTES`` bytes (a longer text is a slice of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fresh(base: str, taken: list[str]) -> str:
    """A column name not yet taken."""
    known = {t.lower() for t in taken}
    while base.lower() in known:
        base += "_"
    return base


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


@dataclass
class Words:
    """Words of consecutive rows: row ``i`` has words ``offsets[i]:offsets[i + 1]``."""

    data: np.ndarray      # bytes of all rows, one blank after each
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # byte after each word
    offsets: np.ndarray   # rows + 1
    hashes: np.ndarray    # one per word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by one blank, and where each row begins (rows + 1).

    Null texts have no bytes.
    """
    parts = [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]
    lengths = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    parts.append(b"")
    return np.frombuffer(b" ".join(parts), dtype=np.uint8), begins


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each."""
    lengths = column.cast(pa.large_binary())
    lengths = pa.compute.fill_null(pa.compute.binary_length(lengths), 0).to_numpy()
    at, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += int(n) + 1
    if at < len(lengths):
        yield at, len(lengths)


def words(column: pa.Array, powers: Powers, lower: bool = False,
          gaps: np.ndarray = _GAP) -> Words:
    """Split and hash the words of some rows; ``lower`` folds A-Z only.

    ``gaps`` tells of each byte whether it separates words; a blank must.
    """
    data, begins = text_bytes(column)
    folded = _LOWER[data] if lower else data
    gap = gaps[data]
    flips = np.flatnonzero(np.diff(np.concatenate([[True], gap]).view(np.int8)))
    starts, ends = flips[0::2], flips[1::2]
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64),
                           np.cumsum((folded.astype(np.uint64) + _U(1)) * up[:len(data)])])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(hashes ^ mix((ends - starts).astype(np.uint64)))
    return Words(data, starts, ends, np.searchsorted(starts, begins), hashes)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values (rows not regarded)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = RUN_POWERS.upto(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:len(hashes)])])
    return mix((sums[length:] - sums[:n]) * down[:n])


RUN_POWERS = Powers(0xD1B54A32D192ED03 | 1)


def shingles(w: Words, length: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and their offsets (rows + 1).

    A row with fewer than ``length`` words but at least one has its whole sequence as only shingle;
    a row without words has none.
    """
    counts = w.counts
    rows = len(counts)
    each = np.where(counts >= length, counts - length + 1, 0)
    row = np.repeat(np.arange(rows), each)
    first = np.repeat(w.offsets[:-1] - np.concatenate([[0], np.cumsum(each)])[:-1], each)
    all_runs = runs(w.hashes, length)
    values = all_runs[first + np.arange(len(first))]
    for i in np.flatnonzero((counts > 0) & (counts < length)):
        whole = runs(w.hashes[w.offsets[i]:w.offsets[i + 1]], int(counts[i]))
        at = np.searchsorted(row, i)
        values, row = np.insert(values, at, mix(whole)), np.insert(row, at, i)
    offsets = np.searchsorted(row, np.arange(rows + 1))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(rows + 1))


def coordinates(values: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """MinHash signatures, one row of ``size`` 32-bit values for each nonempty range.

    Coordinate k is the least high half of ``mix(value) * odd_k + c_k`` over the range.
    """
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(starts), size), dtype=np.uint32)
    if len(starts) == 0:
        return out
    seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * _U(_BASE))
    base, scratch = mix(values), np.empty_like(values)
    for k in range(size):
        np.multiply(base, seeds[2 * k] | _U(1), out=scratch)
        scratch += seeds[2 * k + 1]
        scratch ^= scratch >> _U(29)
        scratch *= _U(_BASE)
        out[:, k] = (np.minimum.reduceat(scratch, starts) >> _U(32)).astype(np.uint32)
    return out
