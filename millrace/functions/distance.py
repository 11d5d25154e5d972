"""Edit distances of many pairs of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters of a text that one machine word holds.
WORD = 64
#: Entries of the tables that are held at once: texts are taken in tiles of so many, or one by one.
CELLS = 1 << 20


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distances by code point: a row for each text of ``a``, a column for each of ``b``.

    Myers' bit vectors: a column of the table of distances is kept as the bits of its rises
    and falls, and each step takes all pairs one character of ``b`` further.
    """
    out = np.empty((len(a), len(b)), np.int64)
    words = np.array([max(1, -(-len(x) // WORD)) for x in a], np.int64)
    order = np.argsort([-len(x) for x in b], kind="stable")
    for columns in _tiles(order, [len(b[i]) for i in order]):
        side = [b[i] for i in columns]
        for w in np.unique(words):
            like = np.flatnonzero(words == w)
            for rows in _tiles(like, [int(w) * max(len(side), WORD)] * len(like)):
                out[np.ix_(rows, columns)] = _distances([a[i] for i in rows], side, int(w)).T
    return out


def _tiles(places: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """Runs of ``places`` of at most ``CELLS`` entries, or of one place; no size is above the first of its run."""
    at = 0
    while at < len(places):
        n = max(1, CELLS // max(1, sizes[at]))
        yield places[at : at + n]
        at += n


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and the code points of all texts in a row."""
    lengths = np.array([len(x) for x in texts], np.int64)
    return lengths, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _distances(a: list[str], b: list[str], words: int) -> np.ndarray:
    """A row for each of ``b``, longest first, and a column for each of ``a``, texts of at most ``words`` words."""
    a_lengths, a_points = _points(a)
    b_lengths, b_points = _points(b)
    letters = np.unique(a_points)

    # ``has[i][c]``: the places of letter c in the i-th word of each of ``a``; the last row is for letters that ``a`` lacks.
    owner = np.repeat(np.arange(len(a)), a_lengths)
    place = np.arange(len(a_points)) - np.repeat(np.cumsum(a_lengths) - a_lengths, a_lengths)
    has = np.zeros((words, len(letters) + 1, len(a)), np.uint64)
    bits = np.uint64(1) << (place % WORD).astype(np.uint64)
    np.bitwise_or.at(has, (place // WORD, np.searchsorted(letters, a_points), owner), bits)

    codes = np.searchsorted(letters, b_points)
    known = codes < len(letters)
    known[known] = letters[codes[known]] == b_points[known]
    steps = int(b_lengths.max(initial=0))
    inside = np.arange(steps) < b_lengths[:, None]
    table = np.zeros((len(b), steps), np.int64)
    table[inside] = np.where(known, codes, len(letters))
    active = inside.sum(axis=0).tolist()  # ``b`` that long are a beginning of all, as the longest come first

    rises = np.full((words, len(b), len(a)), ~np.uint64(0))
    falls = np.zeros_like(rises)
    for j, k in enumerate(active):
        at = table[:k, j]
        up, down = np.uint64(1), np.uint64(0)  # what the word above hands on; the table's first row rises
        for i in range(words):
            p, m, eq = rises[i, :k], falls[i, :k], has[i].take(at, axis=0)
            vertical = eq | m
            if i:
                eq |= down
            across = eq & p
            across += p
            across ^= p
            across |= eq
            ups = across | p
            np.invert(ups, out=ups)
            ups |= m
            across &= p  # the steps down
            over = (ups >> np.uint64(WORD - 1), across >> np.uint64(WORD - 1)) if i + 1 < words else None
            ups <<= np.uint64(1)
            ups |= up
            across <<= np.uint64(1)
            if i:
                across |= down
            np.bitwise_and(ups, vertical, out=m)
            vertical |= ups
            np.invert(vertical, out=vertical)
            np.bitwise_or(across, vertical, out=p)
            if over:
                up, down = over

    # The last column starts at the length of ``b`` and rises and falls from there over the letters of ``a``.
    held = np.clip(a_lengths - WORD * np.arange(words)[:, None], 0, WORD)
    mask = np.where(held > 0, ~np.uint64(0) >> (WORD - np.maximum(held, 1)).astype(np.uint64), np.uint64(0))[:, None, :]
    change = np.bitwise_count(rises & mask).astype(np.int64) - np.bitwise_count(falls & mask)
    return b_lengths[:, None] + change.sum(axis=0)
