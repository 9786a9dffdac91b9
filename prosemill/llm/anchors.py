"""Content-defined anchors of byte strings.

Every window of ``window`` bytes picks the least hash among its ``gram``-byte
substrings, the rightmost of equal ones. Equal windows pick the same substring
at the same offset wherever they stand, so repeats of a window's length and
more can be found from the picked substrings alone, of which there are about
two for each ``window - gram + 2`` bytes.
"""

from __future__ import annotations

import numpy as np

from .common import mix64

BASE = np.uint64(0x100000001B3)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of BASE and of its inverse modulo 2^64, at least n."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        both = []
        for b in (BASE, inverse):
            p = np.ones(size, dtype=np.uint64)
            p[1:] = b
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = both[0], both[1]
    return _POWERS[size]


class Hashes:
    """Hashes of any substrings of one byte array, by differences of a running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def raw_grams(self, n: int) -> np.ndarray:
        """Upper halves of plain polynomial hashes of all substrings of n bytes: an order by content."""
        m = max(0, len(self.sums) - n)
        return ((self.sums[n:] - self.sums[:m]) * self.down[:m] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)


def pick(low: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the place of the least, the rightmost of equal ones."""
    at = np.arange(len(low), dtype=np.int32)
    span = 1
    while span < width:
        step = min(span, width - span)
        right = low[step:] <= low[:-step]
        at = np.where(right, at[step:], at[:-step])
        low = np.where(right, low[step:], low[:-step])
        span += step
    return at


#: Bytes that one step hashes; the arrays of a step take some forty times as much.
STEP_BYTES = 1 << 19


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, place, first window, windows, hash, block hash) of each picked substring of each text.

    The windows that pick one place follow each other; together they are its
    block, whose hash tells whether two blocks are equal. Long texts are cut
    into pieces that overlap by a window, so a block may come in two parts.
    """
    found: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - window + 1), STEP_BYTES):
            piece = text[at : at + STEP_BYTES + window - 1]
            if pieces and size + len(piece) > STEP_BYTES:
                found.append(_step(pieces, window, gram))
                pieces, size = [], 0
            pieces.append((i, at, piece))
            size += len(piece)
    if pieces:
        found.append(_step(pieces, window, gram))
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _step(pieces: list[tuple[int, int, bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
    lengths = np.array([len(p) for _, _, p in pieces])
    starts = np.cumsum(lengths) - lengths
    hashes = Hashes(data)
    low = hashes.raw_grams(gram)
    at = pick(low, window - gram + 1)
    inside = np.ones(len(at), dtype=bool)
    for s, n in zip(starts, lengths, strict=True):  # windows that reach into the next piece
        inside[s + n - window + 1 : s + n] = False
    fresh = np.concatenate(([True], (at[1:] != at[:-1]) | ~inside[:-1])) & inside
    first = np.flatnonzero(fresh)
    stop = np.flatnonzero(inside & np.concatenate(((at[1:] != at[:-1]) | ~inside[1:], [True]))) + 1
    place = at[first].astype(np.int64)
    piece = np.searchsorted(starts, first, side="right") - 1
    base = np.array([a for _, a, _ in pieces])[piece] - starts[piece]
    owner = np.array([i for i, _, _ in pieces])[piece]
    return owner, place + base, first + base, stop - first, hashes.of(place, place + gram), hashes.of(first, stop + window - 1)
