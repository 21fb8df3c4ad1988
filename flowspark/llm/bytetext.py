"""Texts of an Arrow batch as bytes, and vectorised hashes over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20_240_501)
TABLE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column, and where each row starts (one more than rows); null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def chunks(starts: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges (first, end) of about ``size`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(starts) - 1
    while first < rows:
        end = int(np.searchsorted(starts, starts[first] + size, side="right")) - 1
        end = min(rows, max(end, first + 1))
        yield first, end
        first = end


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit words, in place."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width``-byte string (a power of two), by doubling."""
    h, k = TABLE[data], 1
    while k < width:
        h = h[:-k] * _BASE + h[k:] if k < len(h) else h[:0]
        h ^= h >> np.uint64(29)
        k *= 2
    return mix(h)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width``."""
    if len(h) < width:
        return h[:0]
    k = 1
    while 2 * k <= width:
        h = np.minimum(h[:-k], h[k:])
        k *= 2
    rest = width - k
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the base and of its inverse, modulo 2^64; kept for the process."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_BASE, _UNBASE)):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """A hash of data[begin:end] for each span, from one running polynomial."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x21, 0x7F)]] = 3
_KIND[[*range(48, 58)]] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, kind, begin, end`` of the tokens of texts that stand one after the other.

    Kinds: 1 letters (any byte beyond ASCII counts as one), 2 digits, 3 a single other sign.
    """
    kind = _KIND[data]
    new = kind > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[:-1][starts[:-1] <= len(data)]] = True
    same = (kind[1:] == kind[:-1]) & (kind[1:] < 3) & ~edge[1:-1] if len(data) else np.zeros(0, bool)
    new[1:] &= ~same
    last = kind > 0
    last[:-1] &= ~same
    begin, end = np.flatnonzero(new), np.flatnonzero(last) + 1
    return np.searchsorted(starts, begin, side="right") - 1, kind[begin], begin, end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return _LOWER[data]


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``row, kind, upper, hash`` of the tokens: hashes are of lower-cased bytes, ``upper`` says that
    the first two letters were capitals."""
    row, kind, begin, end = token_spans(data, starts)
    capital = np.concatenate([(data >= 65) & (data <= 90), [False]])
    upper = capital[begin] & capital[begin + 1] & (end - begin > 1)
    return row, kind, upper, span_hashes(lowered(data), begin, end)
