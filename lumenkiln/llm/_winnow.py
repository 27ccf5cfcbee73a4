"""Content-defined segments of unit sequences.

A *unit* is a byte or a word, given as a 64-bit code.  Every window of
``span`` consecutive units picks one of its ``k``-grams as its anchor: the one
with the smallest hash, the leftmost on ties.  The choice depends on the
window's content alone, so equal windows, wherever they stand, pick equal
anchors at equal offsets.  Consecutive windows that share an anchor form a
segment.  Two windows can therefore only be equal if their segments have the
same anchor fingerprint, which is what the repeat operators shard by.  Hashes
only say what is worth comparing: no window counts as repeated because of them.

Sequences longer than ``PIECE`` units are cut into pieces that overlap by
``span - 1`` units, so every window is seen once and memory stays bounded.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Units handled at once; also the number of position values in a packed key.
PIECE_BITS = 18
PIECE = 1 << PIECE_BITS
_LOW = np.uint64(PIECE - 1)
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit codes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_POWERS: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get((base, 0))
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        have = _POWERS[(base, 0)] = (up, down)
    return have[0][:n], have[1][:n]


def prefix_hash(units: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=total[1:])
    return total, down


def range_hash(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of units[start:end], the same wherever the range stands."""
    total, down = prefix
    return (total[end] - total[start]) * down[start]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def pieces(lengths: np.ndarray, span: int):
    """Groups of (sequence, first unit, last unit) with at most PIECE units each."""
    group, held = [], 0
    for i, n in enumerate(lengths.tolist()):
        if n < span:
            continue
        at = 0
        while True:
            end = min(n, at + PIECE)
            if held + end - at > PIECE and group:
                yield group
                group, held = [], 0
            group.append((i, at, end))
            held += end - at
            if end == n:
                break
            at = end - span + 1
    if group:
        yield group


def segments(units: np.ndarray, bounds: np.ndarray, span: int, k: int) -> dict[str, np.ndarray]:
    """Segments of the sequences units[bounds[j]:bounds[j+1]], at most PIECE units in all.

    ``seq`` j, ``start`` the first window's place in the sequence, ``n`` windows,
    ``fp`` the anchor's fingerprint, ``sh`` a hash of everything the windows cover.
    """
    width = span - k + 1
    h = prefix_hash(units, _BASE)
    places = np.arange(len(units) - k + 1)
    fps = mix64(range_hash(h, places, places + k))
    packed = (fps & ~_LOW) | places.astype(np.uint64)
    chosen = (_sliding_min(packed, width) & _LOW).astype(np.int64)
    n_windows = len(chosen)
    new = np.empty(n_windows, bool)
    new[0] = True
    np.not_equal(chosen[1:], chosen[:-1], out=new[1:])
    new[bounds[:-1][bounds[:-1] < n_windows]] = True
    cut = bounds[1:] - span + 1  # windows from here to the sequence's end would cross it
    new[cut[(cut > 0) & (cut < n_windows)]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], n_windows) - 1
    owner = np.searchsorted(bounds, first, side="right") - 1
    keep = first + span <= bounds[owner + 1]
    first, last, owner = first[keep], last[keep], owner[keep]
    raw = memoryview(np.ascontiguousarray(units)).cast("B")
    wide = units.itemsize
    sh = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip((first * wide).tolist(), ((last + span) * wide).tolist())), np.uint64, len(first))
    return {"seq": owner, "start": first - bounds[owner], "n": last - first + 1, "fp": fps[chosen[first]].view(np.int64), "sh": sh.view(np.int64)}
