"""Words and word shingles of Arrow text columns as 64-bit hashes, in numpy.

A text column is one run of UTF-8 bytes with offsets, so a batch is split and hashed with no Python
object per word. Texts are worked on in blocks of BLOCK bytes cut between words, which bounds the
temporary arrays however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_ALL = (1 << 64) - 1

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def table(outside: str) -> np.ndarray:
    """Which bytes belong to words. 'space': all but ASCII white space; 'alnum': digits, letters and all
    bytes of characters beyond ASCII (upper-case letters are lower-cased first)."""
    t = np.ones(256, bool)
    if outside == "space":
        t[[9, 10, 11, 12, 13, 32]] = False
    elif outside == "alnum":
        t[:128] = False
        t[48:58] = t[97:123] = True
    else:
        raise ValueError(outside)
    return t


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 on 64-bit integers."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, BLOCK) + 1
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers = (both[0], both[1])
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null reads as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _hashes(low: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each run of `inside` bytes; runs also end at `breaks`."""
    edge = np.zeros(len(low) + 1, bool)
    edge[0] = edge[-1] = True
    edge[breaks] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    at = np.flatnonzero(edge)
    word = inside[at[:-1]]
    start, end = at[:-1][word], at[1:][word]
    power, inverse = _power(len(low))
    sums = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(_BYTE[low] * power[: len(low)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def words(column: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, hash of each word, words before each of those rows and after the last) for
    runs of whole rows of about BLOCK bytes. A longer row comes alone."""
    for first, rows, h, at, _ in placed(column, inside):
        yield first, rows, h, at


def placed(column: pa.Array, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As `words`, and start and end of each word (2 x n) in the bytes of `buffers`."""
    raw, at = buffers(column)
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
        j = min(j, n)
        if at[j] - at[i] <= 2 * BLOCK:
            low = _LOWER[raw[at[i] : at[j]]]
            starts = (at[i:j] - at[i])[: j - i]
            if len(low):
                start, end, h = _hashes(low, inside[low], starts)
                counts, ends = np.searchsorted(start, at[i : j + 1] - at[i]), np.stack([start, end]) + at[i]
            else:
                h, counts, ends = np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), np.zeros((2, 0), np.int64)
            yield i, j - i, h, counts, ends
        else:
            parts, s = [], int(at[i])
            while s < at[j]:
                e = min(s + BLOCK, int(at[j]))
                while e < at[j] and inside[_LOWER[raw[e - 1]]] and inside[_LOWER[raw[e]]]:
                    nxt = np.flatnonzero(~inside[_LOWER[raw[e : min(e + BLOCK, int(at[j]))]]])
                    e = e + int(nxt[0]) if len(nxt) else min(e + BLOCK, int(at[j]))
                low = _LOWER[raw[s:e]]
                start, end, h = _hashes(low, inside[low], np.zeros(0, np.int64))
                parts.append((h, np.stack([start, end]) + s))
                s = e
            h = np.concatenate([p[0] for p in parts])
            yield i, 1, h, np.array([0, len(h)]), np.concatenate([p[1] for p in parts], axis=1)
        i = j


def shingles(column: pa.Array, k: int, inside: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, distinct shingle hashes sorted in each row, hashes before each row and after the last).

    A row of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    for first, rows, h, at in words(column, inside):
        n = np.diff(at)
        acc = np.zeros(len(h), np.uint64)
        for i in range(min(k, len(h))):
            acc[: len(h) - i] += mix(h[i:] + np.uint64(i * 0x9E3779B97F4A7C15 & _ALL))
        row = np.repeat(np.arange(rows), n)
        place = np.arange(len(h)) - at[:-1][row]
        whole = place + k <= n[row]
        out, owner = mix(acc[whole]), row[whole]
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            salt = np.array([(i + 1) * 0xD1B54A32D192ED03 & _ALL for i in range(k)], np.uint64)
            sums = [mix(np.add.reduce(mix(h[at[r] : at[r + 1]] + salt[: n[r]]), keepdims=True)) for r in short]
            out, owner = np.concatenate([out, np.concatenate(sums)]), np.concatenate([owner, short])
        order = np.lexsort((out, owner)) if rows > 1 else np.argsort(out)
        out, owner = out[order], owner[order]
        if len(out):
            new = np.ones(len(out), bool)
            new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
            out, owner = out[new], owner[new]
        yield first, rows, out, np.searchsorted(owner, np.arange(rows + 1))
