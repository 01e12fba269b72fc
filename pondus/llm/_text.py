"""Word and n-gram hashing over Arrow string columns (numpy, no per-row Python).

Texts are handled as UTF-8 bytes.  Every separator used here is an ASCII byte, and no byte
of a multi-byte character is ASCII, so splitting bytes and splitting characters agree.

A word's hash is 64 bits of a polynomial over random byte values, so equal words have equal
hashes everywhere; two different words collide with a probability of about 2**-64.

Memory: a column is walked in slices of about ``SLICE`` bytes (one document at least), and
a slice's bytes in pieces cut between words, so the arrays stay at a small multiple of the
longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 2 << 20
PIECE = 1 << 18

_RNG = np.random.default_rng(20240229)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
GRAM_MULT = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the inclusive ranges."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: ``[^\x20\x09-\x0D]`` and, after lower-casing A-Z, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
NON_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)) | byte_class((0x41, 0x5A))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, applied to a copy."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    inv = pow(_BASE, -1, 2**64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64))), dtype=np.uint64)
                     for b in (_BASE, inv))


_POW: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0][0]) < n:
        _POW[:] = [powers(max(n, PIECE + 1))]
    return _POW[0]


class Slice(NamedTuple):
    """Rows ``first`` to ``first + len(offsets) - 1`` of a column: bytes and row bounds."""

    first: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column, size: int = SLICE) -> Iterator[Slice]:
    """The rows of a string column, in slices of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(off) - 1:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, len(off) - 1)
        yield Slice(i, data[off[i]:off[j]], off[i:j + 1] - off[i])
        i = j


class Words(NamedTuple):
    """Words in order: row within the slice, byte bounds, hash; ``bounds`` has the first
    word of each row and the end."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def words(s: Slice, is_word: np.ndarray, lower: bool = True) -> Words:
    """The maximal runs of word bytes of each row, with the hash of their lower-cased bytes."""
    data, off = s.data, s.offsets
    n = len(data)
    parts: list[tuple[np.ndarray, ...]] = []
    values = BYTE_VALUE[LOWER] if lower else BYTE_VALUE
    mask = is_word[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True  # a row begins here: nothing joins across
    pos = 0
    while pos < n:
        end = min(n, pos + PIECE)
        if end < n and mask[end - 1] and mask[end] and not first[end]:
            back = np.flatnonzero(~mask[pos:end] | first[pos:end])
            cut = int(back[-1]) + pos if len(back) else pos
            if cut > pos:
                end = cut
            else:  # one word fills the piece: go on to where it ends
                while end < n and mask[end] and not first[end]:
                    stop = np.flatnonzero(~mask[end:end + PIECE] | first[end:end + PIECE][:len(mask[end:end + PIECE])])
                    end = end + int(stop[0]) if len(stop) else min(n, end + PIECE)
        m = mask[pos:end]
        before = np.zeros(len(m), dtype=bool)
        before[1:] = m[:-1] & ~first[pos + 1:end]
        start = np.flatnonzero(m & ~before)
        after = np.zeros(len(m), dtype=bool)
        after[:-1] = before[1:] & m[1:]
        stop = np.flatnonzero(m & ~after) + 1
        power, inverse = _powers(len(m) + 1)
        total = np.zeros(len(m) + 1, np.uint64)
        np.cumsum(values[data[pos:end]] * power[:len(m)], out=total[1:])
        h = (total[stop] - total[start]) * inverse[start]
        h = mix(h + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        parts.append((start + pos, stop + pos, h))
        pos = end
    if parts:
        start, stop, h = (np.concatenate(x) for x in zip(*parts))
    else:
        start, stop, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bounds = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    return Words(row, start, stop, h, bounds)


def ngrams(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of ``n`` words of one row; with ``short``, a row of fewer
    words gives one for its whole sequence."""
    h, row = w.hash, w.row
    k = max(0, len(h) - n + 1)
    out = np.zeros(k, np.uint64)
    for j in range(n):
        out += h[j:j + k] * GRAM_MULT[j]
    same = row[:k] == row[n - 1:n - 1 + k]
    rows, hashes = row[:k][same], mix(out[same])
    if short:
        count = np.diff(w.bounds)
        few = np.flatnonzero((count > 0) & (count < n))
        extra = np.empty(len(few), np.uint64)
        for i, r in enumerate(few):
            x = h[w.bounds[r]:w.bounds[r + 1]]
            extra[i] = (np.append(x, np.uint64(len(x))) * GRAM_MULT[-len(x) - 1:]).sum(dtype=np.uint64)
        rows, hashes = np.concatenate((rows, few)), np.concatenate((hashes, mix(extra)))
    return rows, hashes


def sets(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each of ``n`` rows: values sorted within the row, and bounds."""
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order], kind="stable")]
    rows, hashes = rows[order], hashes[order]
    keep = np.ones(len(rows), dtype=bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    rows, hashes = rows[keep], hashes[keep]
    return hashes, np.searchsorted(rows, np.arange(n + 1))
