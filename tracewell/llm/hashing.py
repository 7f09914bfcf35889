"""Hashes of the words of many texts at once, in numpy: equal words have equal hashes wherever they stand."""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes that are hashed at once: the arrays of one step stay in the processor's cache. A longer word is hashed by itself.
SEGMENT = 1 << 17
ODD, MIX, NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int) -> np.ndarray:
    factors = np.full(SEGMENT, base, np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


POWERS, INVERSE = _powers(int(ODD)), _powers(pow(int(ODD), -1, 1 << 64))
#: Bytes between words: white space alone, or every ASCII character that is no letter, digit or underscore.
SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
NOT_WORD = np.array([b < 128 and not (chr(b).isalnum() or b == 95) for b in range(256)])
#: For each byte its bits, the highest first, as eight counters of 8 bits.
LANES = np.array([sum((b >> (7 - j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """The hashes with all their bits spread."""
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


def spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for sorted spans that don't overlap: differences of prefix sums of a polynomial modulo 2^64."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        first, last = int(starts[at]), int(ends[to - 1])
        if last - first > SEGMENT:
            out[at] = xxhash.xxh64_intdigest(data[first:last].tobytes())
        else:
            total = np.zeros(last - first + 1, np.uint64)
            np.cumsum((data[first:last].astype(np.uint64) + np.uint64(1)) * POWERS[: last - first], out=total[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (total[e] - total[s]) * INVERSE[s]
        at = to
    return mixed(out)


def _edges(texts: list[bytes], between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of bytes, where their words start and end in it, and where the texts end."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    apart = np.ones(len(data) + 1, bool)
    apart[1:] = between[data]
    edges = np.flatnonzero(apart[1:] != apart[:-1])
    return data, edges[::2], edges[1::2], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)


def words(texts: list[bytes], between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts one after the other, and of which text each word is; between says which bytes are in no word."""
    data, starts, ends, limits = _edges(texts, between)
    return spans(data, starts, ends), np.searchsorted(limits, starts, side="right")


def placed_words(texts: list[bytes], between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, and the number of characters before each word in its text."""
    data, starts, ends, limits = _edges(texts, between)
    row = np.searchsorted(limits, starts, side="right")
    before = np.concatenate(([0], np.cumsum(data & 0xC0 != 0x80)))
    first = np.concatenate(([0], limits))
    return spans(data, starts, ends), row, before[starts] - before[first[row]]


def shingles(h: np.ndarray, row: np.ndarray, size: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of a text, in order, repeats included, and their texts; a text of fewer words gives one, of all its words."""
    n = np.bincount(row, minlength=rows)
    first = np.cumsum(n) - n
    at = np.arange(len(h)) - first[row]
    whole = at <= np.maximum(n - size, 0)[row]
    out = np.zeros(len(h), np.uint64)
    for i in range(size):
        following = np.zeros(len(h), np.uint64)
        following[: len(h) - i] = h[i:]
        out = out * NEXT + np.where(at + i < n[row], following, np.uint64(0))
    return mixed(out[whole] + np.minimum(n, size)[row[whole]].astype(np.uint64)), row[whole]


def simhashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Signed 64-bit SimHashes of runs of n hashes that lie one after the other; a bit is 1 if it is in over half of them, so none give 0."""
    out, some = np.zeros(len(n), np.int64), np.flatnonzero(n)
    ends = np.cumsum(n)
    at = 0
    while at < len(some):
        before = int(ends[some[at]] - n[some[at]])
        to = max(at + 1, int(np.searchsorted(ends[some], before + (1 << 16), side="right")))
        own = n[some[at:to]]
        out[some[at:to]] = _signs(h[before : int(ends[some[to - 1]])], own) if own[0] <= 1 << 16 else _long(h[before : before + int(own[0])])
        at = to
    return out


def _counted(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of each run of hashes, none of them empty, have each bit, the highest first: eight counters of 8 bits are added at once, over 255 hashes at most."""
    starts, parts = np.cumsum(n) - n, -(-n // 255)
    first = np.cumsum(parts) - parts
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    lanes = np.add.reduceat(LANES[h.astype(">u8").view(np.uint8).reshape(-1, 8)], cuts, axis=0)
    return np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 64), first, axis=0, dtype=np.int32)


def _signs(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.packbits(_counted(h, n) * 2 > n[:, None], axis=1).view(">i8").ravel()


def _long(h: np.ndarray) -> int:
    ones = sum(_counted(h[a : a + (1 << 16)], np.array([len(h[a : a + (1 << 16)])])).astype(np.int64) for a in range(0, len(h), 1 << 16))
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])
