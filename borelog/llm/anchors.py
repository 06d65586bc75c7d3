"""Anchors: positions chosen by content, so that equal windows of bytes choose the same place within them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix, odd_numbers

#: Position bits of a sort key; a piece of text is cut before it is longer than that.
PLACE_BITS = 22
PIECE = 1 << 21


def gram_hash(raw: np.ndarray, gram: int, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a multiple of 8) at each position."""
    n = len(raw) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    loose = np.ndarray((len(raw) - 7,), "<u8", raw.data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for k, c in enumerate(odd_numbers(gram // 8, seed)):
        h += loose[8 * k : 8 * k + n] * c
    return mix(h)


def sliding_min(x: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` neighbours, by doubling."""
    have = 1
    n = len(x) - window + 1
    while 2 * have <= window:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[window - have : window - have + n])


def anchors(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of concatenated texts: hash, place, first and last start of the windows that chose it (all counted from the start of ``raw``).

    A window's anchor is the leftmost least hash of a ``gram`` within it. No window spans two texts."""
    n = len(raw) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = gram_hash(raw, gram)
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min(h & ~mask | np.arange(len(h), dtype=np.uint64), window - gram + 1)[:n]
    change = np.zeros(n + 1, np.int32)
    fits = np.diff(offsets) >= window
    np.add.at(change, offsets[:-1][fits], 1)
    np.add.at(change, offsets[1:][fits] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(change[:n]))
    if not len(start):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    place = (least[start] & mask).astype(np.int64)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    last = np.r_[new[1:], len(place)] - 1
    return h[place[new]], place[new], start[new], start[last]


def pieces(raw: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The texts in one piece, or a long single text in pieces that overlap by a window less one byte, each with its shift."""
    if len(raw) <= PIECE * 2 - window:
        yield raw, offsets, 0
        return
    for i in range(len(offsets) - 1):
        text = raw[offsets[i] : offsets[i + 1]]
        for at in range(0, max(1, len(text) - window + 1), PIECE):
            part = text[at : at + PIECE + window - 1]
            bounds = np.zeros(len(offsets), np.int64)
            bounds[i + 1 :] = len(part)
            yield part, bounds, at + int(offsets[i])
