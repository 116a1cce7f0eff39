"""Line and piece segmentation of many pages at once, on blocks of ink runs: columns x1 to x2 - 1 of ``rows`` rows from y on.

The rules are those of operators/segment.py, in numpy. A page's pieces depend on nothing outside the page, so nothing is
shuffled, and what is found inside a piece depends on its shape alone, so it is found once for each shape.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Pieces:
    """One entry per piece, by page, line and column; the piece's blocks (y, rows, a, b) are at first to first + n."""

    page: np.ndarray
    line: np.ndarray
    paw: np.ndarray
    x1: np.ndarray
    x2: np.ndarray
    first: np.ndarray
    n: np.ndarray
    blocks: np.ndarray


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts[i] items of each i: the i of each item, and its number within i."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)


def bands(ink: np.ndarray, heights: np.ndarray, weights: list[float], ah: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged bands (page, first row, end row) of the pages' rows, which stand in ``ink`` one page below the other."""
    radius, starts = len(weights) // 2, np.cumsum(heights) - heights
    page, at = spread(heights + 2 * radius)
    at -= radius
    high = heights[page]
    at = np.where(at < 0, -1 - at, np.where(at >= high, 2 * high - 1 - at, at))
    padded = ink[starts[page] + at].astype(float)
    page, y = spread(heights)
    inner = starts[page] + 2 * radius * page + y
    smooth = sum(w * padded[inner + k] for k, w in enumerate(weights))
    high = smooth > 0.1 * np.maximum.reduceat(smooth, starts)[page]
    edge = np.zeros(len(high), bool)
    edge[starts] = True
    before = np.concatenate([[False], high[:-1]]) & ~edge
    after = np.concatenate([high[1:], [False]]) & ~np.concatenate([edge[1:], [True]])
    y1, y2 = np.flatnonzero(high & ~before), np.flatnonzero(high & ~after) + 1
    tall = y2 - y1 >= 0.3 * ah
    y1, y2 = y1[tall], y2[tall]
    of = page[y1]
    new = np.ones(len(y1), bool)
    new[1:] = (of[1:] != of[:-1]) | (y1[1:] - y2[:-1] > max(1, int(0.25 * ah)))
    return of[new], y1[new], y2[np.concatenate([new[1:], [True]])] if len(new) else y2


def pieces(page: np.ndarray, y: np.ndarray, rows: np.ndarray, x1: np.ndarray, x2: np.ndarray, heights: np.ndarray, widths: np.ndarray, weights: list[float], ah: float) -> Pieces:
    """The pieces of all lines. ``page`` numbers the pages from 0; each is at least len(weights) // 2 rows high."""
    starts, total = np.cumsum(heights) - heights, int(heights.sum())
    at = starts[page] + y
    steps = np.bincount(at, x2 - x1, total + 1) - np.bincount(at + rows, x2 - x1, total + 1)
    of, top, end = bands(np.cumsum(steps[:-1]), heights, weights, ah)
    line = np.arange(len(of)) - np.searchsorted(of, of)
    band = np.full(total, -1)
    which, k = spread(end - top)
    band[top[which] + k] = which
    torn = np.flatnonzero((band[at] != band[at + rows - 1]) | (band[at] < 0))
    if len(torn):  # blocks over a band's border are looked at row by row
        which, k = spread(rows[torn])
        keep = np.ones(len(at), bool)
        keep[torn] = False
        at = np.concatenate([at[keep], at[torn][which] + k])
        page, x1, x2 = (np.concatenate([c[keep], c[torn][which]]) for c in (page, x1, x2))
        rows = np.concatenate([rows[keep], np.ones(len(k), rows.dtype)])
        held = band[at] >= 0
        at, page, x1, x2, rows = (c[held] for c in (at, page, x1, x2, rows))
    size = max(1, round(0.25 * ah))
    g, wide = band[at], int(widths.max(initial=0)) + size + 1
    left, right = np.maximum(0, x1 + size // 2 - size + 1) + g * wide, np.minimum(widths[page], x2 + size // 2) + g * wide
    order = np.argsort(left, kind="stable")
    g, at, rows, x1, x2, left, right = (c[order] for c in (g, at, rows, x1, x2, left, right))
    reach = np.maximum.accumulate(right)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (left[1:] > reach[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(g)))
    pg = g[first]
    px1, px2 = left[first] - pg * wide, reach[first + n - 1] - pg * wide
    good = px2 - px1 >= max(1, round(0.3 * ah))
    some = np.zeros(len(of), bool)
    some[pg[good]] = True
    bare = ~some[pg]  # a line that keeps no piece is one piece over its whole width
    lead = good | (bare & np.concatenate([[True], pg[1:] != pg[:-1]])[: len(pg)])
    px1, px2 = np.where(bare, 0, px1), np.where(bare, widths[of[pg]], px2)
    if bare.any():
        n = np.where(bare, np.bincount(pg, n, len(of)).astype(np.int64)[pg], n)
    pg, px1, px2, first, n = pg[lead], px1[lead], px2[lead], first[lead], n[lead]
    which, k = spread(n)
    take = first[which] + k
    blocks = np.stack([at[take], rows[take], x1[take] - px1[which], x2[take] - px1[which]], axis=1)
    first = np.cumsum(n) - n
    if len(n):
        blocks[:, 0] -= np.minimum.reduceat(blocks[:, 0], first)[which]
    paw = np.searchsorted(pg, pg, "right") - 1 - np.arange(len(pg))
    return Pieces(of[pg], line[pg], paw, px1, px2, first, n, blocks)


def shapes(p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of pieces of which each has another shape, and for each piece the place of its like among them."""
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    which, k = spread(p.n)
    hashed = ((p.blocks.astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1, dtype=np.uint64) + k.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    hashed = (hashed ^ (hashed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    hashed ^= hashed >> np.uint64(32)
    whole = np.add.reduceat(hashed, p.first) + (p.x2 - p.x1).astype(np.uint64) * mix[1]
    _, one, kind = np.unique(whole, return_index=True, return_inverse=True)
    like = one[kind]
    same = (p.n == p.n[like]) & (p.x2 - p.x1 == (p.x2 - p.x1)[like])
    checked = same[which]
    differ = (p.blocks[checked] != p.blocks[(p.first[like][which] + k)[checked]]).any(axis=1)
    same[which[checked][differ]] = False
    odd = np.flatnonzero(~same)  # of equal hash only
    kind[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), kind


def image(blocks: np.ndarray, width: int) -> np.ndarray:
    """How many blocks ink each pixel."""
    out = np.zeros((int((blocks[:, 0] + blocks[:, 1]).max()), width), np.int64)
    for y, rows, a, b in blocks.tolist():
        out[y : y + rows, a:b] += 1
    return out


def cuts(ink: np.ndarray, ah: float) -> np.ndarray:
    """Middles of runs of columns with less ink than .7 of the 90th percentile of inked columns."""
    column = ink.sum(axis=0)
    inked = np.sort(column[column > 0])
    place = 0.9 * (len(inked) - 1)
    low, up = math.floor(place), math.ceil(place)
    level = inked[low] if inked[low] == inked[up] else (up - place) * inked[low] + (place - low) * inked[up]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (column < 0.7 * level).astype(np.int8), [0]])))
    a, b = edge[::2], edge[1::2]
    return ((a + b - 1) // 2)[b - a >= max(1, round(0.06 * ah))]


def flags(ink: np.ndarray, ah: float) -> np.ndarray:
    """(s, e, rows, area, valid) of the stretches between neighbouring cuts."""
    width = ink.shape[1]
    every = np.unique(np.concatenate([[0], cuts(ink, ah), [width]]))
    s, e = every[:-1], every[1:]
    part = np.add.reduceat(ink, s, axis=1)
    rows, area = (part > 0).sum(axis=0), part.sum(axis=0)
    valid = (rows >= 0.3 * ah) & (rows <= 2 * ah) & (e - s >= 0.1 * ah) & (e - s <= 3 * ah) & (area >= 0.05 * ah * ah)
    return np.stack([s, e, rows, area, valid], axis=1)


#: Shapes whose results a process keeps, from task to task; the results of pieces of more than so many blocks are not kept.
KEPT_SHAPES, KEPT_BLOCKS = 100_000, 40
SEEN: dict[tuple[str, float], dict[bytes, np.ndarray]] = {}


def by_shape(p: Pieces, find: Callable[[np.ndarray], np.ndarray], seen: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``find``, from a piece's image to rows of numbers, for all pieces: the piece of each row, and the rows."""
    if not len(p.n):
        return np.zeros(0, np.int64), np.zeros((0, 9), np.int64)
    one, kind = shapes(p)
    found = []
    for i in one.tolist():
        own, width = p.blocks[p.first[i] : p.first[i] + p.n[i]], int(p.x2[i] - p.x1[i])
        key = own.astype(np.int32).tobytes() + width.to_bytes(8, "little")
        if (got := seen.get(key)) is None:
            got = find(image(own, width))
            if len(own) <= KEPT_BLOCKS:
                if len(seen) >= KEPT_SHAPES:
                    seen.clear()
                seen[key] = got
        found.append(got)
    counts = np.array([len(x) for x in found])
    begin = np.cumsum(counts) - counts
    which, k = spread(counts[kind])
    return which, np.concatenate(found)[begin[kind][which] + k]
