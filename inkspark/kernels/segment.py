"""Segmentation of one page as arrays: lines, pieces, dots and characters, as the set-based operators find them.

Ink is True. A page is one array of bounded size, so a task that has read it can cut it up without any shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np

from ..operators import segment as S
from . import page as K

DEFAULT_HEIGHT = 20.0


@dataclass(frozen=True)
class Dot:
    """A cluster of dots: its middle, the number of dots, above or below the baseline."""

    cx: float
    cy: float
    size: int
    position: str


@dataclass(frozen=True)
class Char:
    """A character's box on the page, its place in reading order, its form, dots and ink."""

    line: int
    paw: int
    char: int
    x1: int
    y1: int
    x2: int
    y2: int
    position: str
    dots: tuple[Dot, ...]
    ink: np.ndarray
    ah: float


@dataclass(frozen=True)
class Part:
    """A connected component: left, top, width, height, area and middle."""

    left: int
    top: int
    width: int
    height: int
    area: int
    cx: float
    cy: float


def parts(label: np.ndarray) -> list[Part]:
    """Components of a label image, by label from 1."""
    n = int(label.max(initial=0))
    y, x = np.nonzero(label)
    if not n:
        return []
    order = np.argsort(label[y, x], kind="stable")
    y, x = y[order], x[order]
    first = np.searchsorted(label[y, x], np.arange(1, n + 1))
    area = np.diff(np.append(first, len(y)))
    low = [np.minimum.reduceat(v, first) for v in (x, y)]
    high = [np.maximum.reduceat(v, first) for v in (x, y)]
    mean = [np.add.reduceat(v, first) / area for v in (x, y)]
    rows = zip(low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1, area, strict=True)
    return [Part(*map(int, r), float(a), float(b)) for r, a, b in zip(rows, *mean, strict=True)]


def average_height(found: list[Part]) -> float:
    return float(np.percentile([p.height for p in found], 70)) if found else DEFAULT_HEIGHT


def stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (start, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def lines(ink: np.ndarray) -> list[tuple[int, int]]:
    """(y1, y2) of the lines, top first: smoothed rows above a tenth of the peak, close ones joined."""
    if not ink.any():
        return []
    ah = average_height(parts(K.components(ink)))
    smooth = np.convolve(np.pad(ink.sum(axis=1).astype(float), S.RADIUS, mode="symmetric"), S.kernel(), mode="valid")
    out: list[tuple[int, int]] = []
    for y1, y2 in stretches(smooth > 0.1 * smooth.max()):
        if y2 - y1 < 0.3 * ah:
            continue
        if out and y1 - out[-1][1] <= max(1, int(0.25 * ah)):
            out[-1] = (out[-1][0], y2)
        else:
            out.append((y1, y2))
    return out


def paws(ink: np.ndarray, ah: float) -> list[tuple[int, int]]:
    """(x1, x2) of a line's pieces, right to left: columns connected after a horizontal dilation; else the whole line."""
    size = max(1, round(0.25 * ah))
    columns = np.flatnonzero(ink.any(axis=0))
    grown = np.zeros(ink.shape[1] + 2 * size, bool)
    for shift in range(size // 2 - size + 1, size // 2 + 1):
        grown[columns + shift + size] = True
    found = [p for p in stretches(grown[size:-size]) if p[1] - p[0] >= max(1, round(0.3 * ah))]
    return sorted(found, reverse=True) or [(0, ink.shape[1])]


def baseline(found: list[Part], ah: float, height: int) -> float:
    """Commonest bottom of components that don't look like dots, the least on ties; else three quarters down."""
    dotty = lambda p: p.height < 0.4 * ah and p.width < 0.4 * ah and p.area < 0.15 * ah * ah and 0.25 <= p.height / p.width <= 4
    bottoms = Counter(p.top + p.height for p in found if not dotty(p))
    return float(min(bottoms, key=lambda b: (-bottoms[b], b))) if bottoms else 0.75 * height


def dot_labels(label: np.ndarray, found: list[Part], ah: float) -> list[int]:
    """Labels of the components that are dots: small in every measure, of even shape, and alone in their box."""
    small = [max(p.height, p.width) <= max(2.0, 0.6 * ah) and 0.2 <= p.height / p.width <= 6 for p in found]
    if not any(small):
        return []
    limit = max(1.0, min(0.2 * ah * ah, 1.5 * float(np.percentile([p.area for p in found], 25))))
    alone = []
    for k, p in enumerate(found, 1):
        box = label[p.top : p.top + p.height, p.left : p.left + p.width]
        if small[k - 1] and p.area <= limit and not ((box != 0) & (box != k)).any():
            alone.append(k)
    return alone


def without_dots(ink: np.ndarray, ah: float) -> tuple[np.ndarray, list[float]]:
    """The piece without its dots, and the columns of the dots' middles in order: their number needs no clusters."""
    new = np.concatenate([[True], (ink[1:] != ink[:-1]).any(axis=1)])  # a row like the one above it changes no component
    label = K.components(ink[new])
    if label.max(initial=0) == 1 and max(ink.any(axis=0).sum(), ink.any(axis=1).sum()) > max(2.0, 0.6 * ah):
        return ink, []
    label = label[np.cumsum(new) - 1]
    found = parts(label)
    alone = dot_labels(label, found, ah)
    return ink & ~np.isin(label, alone) if alone else ink, sorted(found[k - 1].cx for k in alone)


def separate_dots(ink: np.ndarray, ah: float) -> tuple[np.ndarray, list[Dot]]:
    """The piece without its dots, and their clusters."""
    label = K.components(ink)
    found = parts(label)
    if not found:
        return ink, []
    alone = dot_labels(label, found, ah)
    level = baseline(found, ah, ink.shape[0])
    middles = sorted((found[k - 1].cx, found[k - 1].cy) for k in alone)
    root = list(range(len(middles)))
    for i, p in enumerate(middles):
        for j in range(i):
            if math.dist(p, middles[j]) <= 0.5 * ah and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    dots = []
    for r in sorted(set(root)):
        group = [m for m, own in zip(middles, root, strict=True) if own == r]
        cx, cy = (sum(m[k] for m in group) / len(group) for k in (0, 1))
        dots.append(Dot(cx, cy, len(group), "above" if cy < level else "below"))
    return ink & ~np.isin(label, alone), dots


def tag(nth: int, n: int) -> str:
    return "isolated" if n == 1 else "initial" if nth == 0 else "final" if nth == n - 1 else "medial"


def attached(dots: list[Dot], boxes: list[tuple[int, int]]) -> list[list[Dot]]:
    """Each box's dots: a dot goes to the box whose middle is nearest, the first on ties, if it is near enough."""
    out: list[list[Dot]] = [[] for _ in boxes]
    reach = max(4, int(0.7 * int(np.mean([b - a for a, b in boxes]))))
    for dot in dots:
        far = [abs(dot.cx - (a + b) / 2) for a, b in boxes]
        nearest = int(np.argmin(far))
        if far[nearest] <= reach:
            out[nearest].append(dot)
    return out


def characters(ink: np.ndarray) -> list[Char]:
    """All characters of a page in reading order: lines down, pieces and characters right to left."""
    out = []
    for line, (y1, y2) in enumerate(lines(ink)):
        band = ink[y1:y2]
        ah = average_height(parts(K.components(band)))
        for paw, (x1, x2) in enumerate(paws(band, ah)):
            piece = band[:, x1:x2]
            body, dots = separate_dots(piece, ah)
            boxes = S.split_multiscale(body.astype(np.int64), ah)
            for nth, ((a, b), own) in enumerate(zip(boxes, attached(dots, boxes), strict=True)):
                if b > a:
                    out.append(Char(line, paw, nth, x1 + a, y1, x1 + b, y2, tag(nth, len(boxes)), tuple(own), piece[:, a:b], ah))
    return out
