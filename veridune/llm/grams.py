"""Hashes of all k-grams of a sequence and content-defined runs of windows, in numpy.

Every window of ``length`` units gets an *anchor*: the least hash of the k-grams inside it.  Equal windows have equal
anchors wherever they stand, and neighbouring windows mostly share one, so a corpus can be dealt out by anchor with a
few fragments per window length and no window is ever missed.
"""

from __future__ import annotations

from functools import cache

import numpy as np

CHUNK = 1 << 19  # units hashed at once: bounds memory whatever the length of a text
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def byte_values(buf: np.ndarray) -> np.ndarray:
    return _BYTE[buf]


_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    count, n = np.zeros(64, np.int64), len(h)
    for a in range(0, n, 1 << 15):
        count += np.unpackbits(h[a : a + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * count > n].sum()) if (2 * count > n).any() else 0


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values (len(values) - k + 1 of them)."""
    n = len(values)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(4, int(n).bit_length()))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=s[1:])
    return mix((s[k:] - s[: n - k + 1]) * down[: n - k + 1])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours."""
    n, step, m = len(h) - w + 1, 1, h
    if n <= 0:
        return np.zeros(0, np.uint64)
    while step * 2 <= w:
        m = np.minimum(m[: len(m) - step], m[step:])
        step *= 2
    return np.minimum(m[:n], m[w - step : w - step + n])


def window_runs(values_of, offsets: np.ndarray, length: int, k: int, most: int = 64):
    """Runs of neighbouring windows with one anchor: (sequence index, first window, windows, anchor) arrays.

    values_of(a, b) gives the hashed units a..b; offsets are the sequences' borders.  A run has at most ``most`` windows;
    cutting a run is safe, since each window keeps its own anchor.
    """
    n = int(offsets[-1])
    seq_l, first_l, count_l, anchor_l = [], [], [], []
    for a in range(0, max(0, n - length + 1), CHUNK):
        b = min(n, a + CHUNK + length - 1)
        m = sliding_min(gram_hashes(values_of(a, b), k), length - k + 1)  # one per window start a..
        if not len(m):
            continue
        at = np.arange(a, a + len(m))
        seq = np.searchsorted(offsets, at, "right") - 1
        ok = at + length <= offsets[seq + 1]
        new = np.ones(len(m), bool)
        new[1:] = (m[1:] != m[:-1]) | ~ok[:-1] | (seq[1:] != seq[:-1])
        new &= ok
        starts = np.flatnonzero(new)
        if not len(starts):
            continue
        # a run ends before the next run or the first invalid window
        valid = np.concatenate([[0], np.cumsum(ok)])
        nxt = np.append(starts[1:], len(m))
        counts = valid[nxt] - valid[starts]
        pieces = -(-counts // most)
        rep = np.repeat(np.arange(len(starts)), pieces)
        part = np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        f = starts[rep] + part * most
        seq_l.append(seq[f])
        first_l.append(at[f])
        count_l.append(np.minimum(most, counts[rep] - part * most))
        anchor_l.append(mix(m[f]))  # least hashes crowd at the low end; mixed again they are even
    if not seq_l:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in (seq_l, first_l, count_l, anchor_l))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of each text: byte starts, byte ends, and the offsets of each text's words."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    borders = offsets[(offsets < len(buf))]
    first[borders] = solid[borders]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends_at = borders[borders > 0] - 1
    last[ends_at] = solid[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # in slices of about CHUNK bytes, one word at least
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, "right")))
        lo, hi = int(starts[at]), int(ends[to - 1])
        v = _BYTE[buf[lo:hi]]
        up, down = _powers(1 << max(4, int(hi - lo + 1).bit_length()))
        s = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(v * up[: hi - lo], out=s[1:])
        a, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((s[e] - s[a]) * down[a] + (e - a).astype(np.uint64))
        at = to
    return out


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (possibly overlapping) byte span, starts ascending within slices of any order."""
    out = np.zeros(len(starts), np.uint64)
    n = len(buf)
    if not n or not len(starts):
        return out
    up, down = _powers(1 << max(4, int(n + 1).bit_length()))
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=s[1:])
    return mix((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The spans' bytes, one after another."""
    n = ends - starts
    return buf[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def joined_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words joined by single spaces: bytes, and each word's start and end there."""
    n = ends - starts + 1
    to = np.cumsum(n)
    out = gather(np.append(buf, np.uint8(0x20)), starts, np.minimum(ends + 1, len(buf) + 1)) if len(starts) else np.zeros(0, np.uint8)
    out[to - 1] = 0x20
    return out, to - n, to - 1
