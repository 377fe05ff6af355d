"""Whole Arrow string columns cut into hashed words with numpy, without a Python string for any word.

A word is a maximal run of ASCII letters, ASCII digits and bytes of non-ASCII characters; case is
folded for ASCII and Latin-1 letters. With ``symbols`` the maximal runs of other visible ASCII
characters are tokens as well. With ``numbers`` a point or comma between two digits belongs to their word. Texts of any length are taken whole: a long one passes in pieces cut
between tokens, so the work space stays near CHUNK bytes times a constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE, _WORD, _SYMBOL = 0, 1, 2

_kind = np.zeros(256, np.uint8)
_kind[33:127] = _SYMBOL
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _kind[_a:_b] = _WORD
_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_upper = np.zeros(256, np.uint8)
_upper[65:91] = 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U)
    out[0], done = 1, 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * U(pow(base, done, 1 << 64))
        done += step
    return out


_tables: list[np.ndarray] = [_powers(_BASE, 1024), _powers(pow(_BASE, -1, 1 << 64), 1024)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_tables[0]) < n:
        _tables[:] = [_powers(_BASE, n + n // 4), _powers(pow(_BASE, -1, 1 << 64), n + n // 4)]
    return _tables


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit words."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Tokens(NamedTuple):
    first: int  # index of the first row in the batch
    offsets: np.ndarray  # token offsets of the rows, one more than rows
    hashes: np.ndarray  # uint64
    shouted: np.ndarray  # all capitals, two letters at least
    capital: np.ndarray  # starts with an ASCII capital
    digit: np.ndarray  # starts with an ASCII digit
    opens: np.ndarray  # first token of its text, or after . ! ? : or a line end


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def _piece(b: np.ndarray, breaks: np.ndarray, symbols: bool, context: bool, numbers: bool = False):
    """Tokens of some bytes; breaks are positions at which a text begins."""
    n = len(b)
    kind = _kind[b]
    joint = np.zeros(0, np.int64)
    if numbers and n > 2:
        digit, first = (b >= 48) & (b < 58), np.zeros(n, bool)
        first[breaks[breaks < n]] = True
        joint = np.flatnonzero(((b[1:-1] == 46) | (b[1:-1] == 44)) & digit[:-2] & digit[2:] & ~first[1:-1] & ~first[2:]) + 1
        kind[joint] = _WORD
    if not symbols:
        kind = np.where(kind == _WORD, kind, 0).astype(np.uint8)
    low = _fold[b]
    if n and b.max() >= 128:  # capital letters of Latin-1 are C3 80 to C3 9E, but for the sign C3 97
        at = np.flatnonzero(b[:-1] == 0xC3) + 1
        at = at[(b[at] >= 0x80) & (b[at] <= 0x9E) & (b[at] != 0x97)]
        low[at] += 32
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[breaks[breaks < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    real = kind[starts] != _SPACE
    starts, ends = starts[real], ends[real]
    pw, inv = _power_tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum((low.astype(U) + U(1)) * pw[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U))
    if not context:
        none = np.zeros(0, bool)
        return starts, hashes, none, none, none, none
    caps = np.zeros(n + 1, np.int64)
    np.cumsum(_upper[b], out=caps[1:])
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    lead = b[starts] if len(starts) else np.zeros(0, np.uint8)
    stop = np.zeros(n + 1, np.int64)
    ends_here = (b == 46) | (b == 33) | (b == 63) | (b == 58) | (b == 10)
    ends_here[joint] = False
    np.cumsum(ends_here, out=stop[1:])
    before = np.concatenate(([0], starts[:-1])) if len(starts) else starts
    opens = stop[starts] > stop[before]
    return starts, hashes, shouted, _upper[lead] == 1, (lead >= 48) & (lead < 58), opens


def tokens(col: pa.Array, symbols: bool = False, context: bool = False, numbers: bool = False) -> Iterator[Tokens]:
    """Tokens of a column, for groups of consecutive rows of about CHUNK bytes; ``context`` fills the flags."""
    data, offsets = raw(col)
    rows, i = len(offsets) - 1, 0
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        parts, at = [], lo
        while True:
            end = min(at + CHUNK, hi) if j == i + 1 else hi
            if end < hi:  # a long text: back to a byte between tokens, or on to the next one
                gap = np.flatnonzero(_kind[data[at:end]] == _SPACE)
                if len(gap):
                    end = at + int(gap[-1]) + 1
                else:
                    gap = np.flatnonzero(_kind[data[end:hi]] == _SPACE)
                    end = end + int(gap[0]) + 1 if len(gap) else hi
            b = data[at:end]
            if len(b):
                got = _piece(b, np.maximum(offsets[i:j], at) - at, symbols, context, numbers)
                parts.append((got[0] + at, *got[1:]))
            at = end
            if at >= hi:
                break
        if parts:
            starts, *rest = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        else:
            starts, rest = np.zeros(0, np.int64), [np.zeros(0, U)] + [np.zeros(0, bool)] * 4
        own = np.searchsorted(starts, offsets[i : j + 1])
        if context and len(starts):
            rest[-1] = rest[-1].copy()
            rest[-1][own[:-1][own[:-1] < own[1:]]] = True
        yield Tokens(i, own, *rest)
        i = j


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all k consecutive tokens within a text, their text's index, and their first token."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, U)
    for j in range(k):
        total = total * U(0xD6E8FEB86659FD93) + hashes[j : n - k + 1 + j]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[: n - k + 1] == text[k - 1 :]
    return mix(total[inside]), text[: n - k + 1][inside], np.flatnonzero(inside)


def word_hash(word: str) -> int:
    """The hash that ``tokens`` gives this one token."""
    return int(next(tokens(pa.array([word]), symbols=True)).hashes[0])
