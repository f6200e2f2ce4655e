"""Vectorised word and shingle hashing over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur
inside another character, so bytes and code points give the same words. Word hashes are
64-bit differences of prefix sums of a polynomial, so that no word is ever a Python object.
Nulls count as empty texts. Work is cut into segments of ``SEG`` bytes, so memory does not
depend on the length of a text beyond eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEG = 1 << 18
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_made: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (shift-multiply finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _table(name: str) -> np.ndarray:
    if not _made:
        with np.errstate(over="ignore"):
            _made["pow"] = np.multiply.accumulate(np.concatenate([[U(1)], np.full(SEG, U(_BASE))]))
            _made["inv"] = np.multiply.accumulate(np.concatenate([[U(1)], np.full(SEG, U(pow(_BASE, -1, 1 << 64)))]))
            _made["exact"] = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
        fold = _made["exact"].copy()
        fold[65:91] = fold[97:123]
        _made["fold"] = fold
    return _made[name]


def chunks(column: pa.Array, limit: int = SEG) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds of each row's bytes) of runs of rows of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _segments(data: np.ndarray, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``SEG`` bytes (more only within one word) that cut no word."""
    pos, n = 0, len(data)
    while pos < n:
        end = min(n, pos + SEG)
        if end < n:
            back = np.flatnonzero(gaps[data[pos:end]])
            if len(back):
                end = pos + int(back[-1]) + 1
            else:
                while end < n and not gaps[data[end]]:
                    step = np.flatnonzero(gaps[data[end : end + SEG]])
                    end = end + int(step[0]) if len(step) else min(n, end + SEG)
        yield pos, end
        pos = end


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = True, prefixes: tuple[int, ...] = (), gaps: np.ndarray = SPACE):
    """(hash of each word, its row, byte length, [hash of its first k bytes for each k]); ``gaps`` marks the bytes between words."""
    letters = _table("fold" if fold else "exact")
    hs, rows, sizes = [], [], []
    heads: list[list[np.ndarray]] = [[] for _ in prefixes]
    for pos, end in _segments(data, gaps):
        b = data[pos:end]
        word = ~gaps[b]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        cut = bounds[(bounds > pos) & (bounds < end)] - pos
        first[cut] = word[cut]
        last[cut - 1] = word[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        with np.errstate(over="ignore"):
            if len(b) <= SEG:
                sums = np.zeros(len(b) + 1, U)
                np.cumsum(letters[b] * _table("pow")[: len(b)], out=sums[1:])
                turn = _table("inv")[s]
                hs.append(mix((sums[e] - sums[s]) * turn + (e - s).astype(U)))
                for k, out in zip(prefixes, heads):
                    to = np.minimum(s + k, e)
                    out.append(mix((sums[to] - sums[s]) * turn + (to - s).astype(U)))
            else:  # one word longer than a segment
                hs.append(np.array([_long(letters[b[s[0] : e[0]]])], U) if len(s) else np.zeros(0, U))
                for k, out in zip(prefixes, heads):
                    out.append(np.array([_long(letters[b[s[0] : min(e[0], s[0] + k)]])], U) if len(s) else np.zeros(0, U))
        rows.append(np.searchsorted(bounds, s + pos, "right") - 1)
        sizes.append(e - s)
    none = np.zeros(0, np.int64)
    return (
        np.concatenate(hs) if hs else np.zeros(0, U),
        np.concatenate(rows) if rows else none,
        np.concatenate(sizes) if sizes else none,
        [np.concatenate(x) if x else np.zeros(0, U) for x in heads],
    )


def _long(values: np.ndarray) -> int:
    """The hash of one word of any length, block by block."""
    total, at = 0, 0
    for i in range(0, len(values), SEG):
        part = values[i : i + SEG]
        with np.errstate(over="ignore"):
            total += int(np.add.reduce(part * _table("pow")[: len(part)])) * pow(_BASE, at, 1 << 64)
        at += len(part)
    return int(mix(np.array([(total + len(values)) % (1 << 64)], U))[0])


_ODD = mix(np.arange(11, 27, dtype=U)) | U(1)


def shingles(h: np.ndarray, counts: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """For each row, its distinct hashes of ``size`` words running, ascending; a shorter row gives its whole sequence as one."""
    with np.errstate(over="ignore"):
        n = len(h) - size + 1
        every = np.zeros(max(n, 0), U)
        for k in range(size if n > 0 else 0):
            every += h[k : k + n] * _ODD[k]
        every = mix(every)
        at = 0
        for c in counts.tolist():
            if c >= size:
                own = np.sort(every[at : at + c - size + 1])
                fresh = np.flatnonzero(own[1:] != own[:-1])
                yield own if len(fresh) == len(own) - 1 else own[np.concatenate([[0], fresh + 1])]
            elif c:
                yield mix(np.array([np.add.reduce(h[at : at + c] * _ODD[:c]) + _ODD[15] * U(c)], U))
            else:
                yield np.zeros(0, U)
            at += c
