"""Compact windows: the Cartesian trees of a text's token min-hashes, cut at a least width."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._text import U, mix, owner

SEEDS = np.array([0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0x8F14E45FCEEA167A, 0xC6A4A7935BD1E995, 0xE7037ED1A0B428DB, 0xA0761D6478BD642F, 0x589965CC75374CC3], U)
_PLACE = U((1 << 24) - 1)


def run_minima(values: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the leftmost least value of every run of t values of a text, and the values in a strict order."""
    n = len(values)
    if n < t:
        return np.zeros(0, np.int64), values
    own = owner(at)
    # equal values are told apart by their place, the left one first
    place = (np.arange(n) - at[own]).astype(U)
    x = (values & ~_PLACE) | (place & _PLACE)
    grid = np.full(n + (-n % t), np.iinfo(U).max, U)
    grid[:n] = x
    grid = grid.reshape(-1, t)
    upto = np.minimum.accumulate(grid, 1).ravel()
    since = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(since[: n - t + 1], upto[t - 1 : n])
    start = np.flatnonzero(own[: n - t + 1] == own[t - 1 :])  # runs that stay in a text
    low = low[start]
    new = np.ones(len(start), bool)
    new[1:] = (low[1:] != low[:-1]) | (own[start[1:]] != own[start[:-1]])
    start, low = start[new], low[new]
    # the place of the least value never goes back as a run moves on
    return start + ((low - place[start]) & _PLACE).astype(np.int64), x


def compact_windows(values: np.ndarray, at: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (l, p, r) of all texts' values, at least t wide, as places in ``values``.

    Every run of t or more values of a text, [a, b], lies in exactly one window
    with l <= a <= p <= b <= r, and p holds the run's leftmost least value.

    The nodes of the Cartesian tree with t or more values below them are the
    minima of the runs of exactly t values, and their tree is the tree of these
    places alone; so the tree is built on a small part of the places.
    """
    p, x = run_minima(values, at, t)
    if not len(p):
        return p, p, p
    text = np.searchsorted(at, p, "right") - 1
    before, after = _smaller(x[p], text)
    left = np.where(before >= 0, p[before] + 1, at[text])
    right = np.where(after >= 0, p[after] - 1, at[text + 1] - 1)
    return left, p, right


def _smaller(v: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest smaller value's index on either side in the same text, or -1."""
    n = len(v)
    edge = np.flatnonzero(text[1:] != text[:-1])
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    before[edge + 1] = -1
    after[edge] = after[-1] = -1
    for near in (before, after):
        # all that lies between i and near[i] is greater than v[i]; so is what a greater neighbour has passed by
        todo = np.flatnonzero(near >= 0)
        while True:
            todo = todo[v[near[todo]] > v[todo]]
            if not len(todo):
                break
            near[todo] = near[near[todo]]
            todo = todo[near[todo] >= 0]
    return before, after


def signature_windows(shingles: np.ndarray, at: np.ndarray, t: int, hashes: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash function, signature, l, p, r) of all windows of all texts, one function at a time."""
    for i in range(hashes):
        x = mix(shingles ^ SEEDS[i])
        left, p, right = compact_windows(x, at, t)
        yield i, x[p], left, p, right
