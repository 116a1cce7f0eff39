"""Page kernels on numpy images (paper 255, ink 0): what needs all pixels of a page at once.

Image libraries differ in rounding and border rules, so these are equal to them in function and not pixel by pixel.
"""

from __future__ import annotations

import math

import numpy as np


def gray(image: np.ndarray) -> np.ndarray:
    """One channel of a BGR or gray image, by luminance."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    return np.rint(image[..., :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Linear resampling at pixel centres."""
    h, w = image.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel, edges weighted by their share."""
    out = image.astype(float)
    for axis, n in ((0, height), (1, width)):
        size = out.shape[axis]
        total = np.concatenate([np.zeros_like(out.take([0], axis)), out.cumsum(axis)], axis)
        at = np.arange(n + 1) * size / n
        low = np.minimum(at.astype(int), size - 1)
        share = (at - low).reshape(-1, 1) if axis == 0 else at - low
        out = np.diff(total.take(low, axis) + share * (total.take(low + 1, axis) - total.take(low, axis)), axis=axis) * n / size
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def _cubic(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Source places (n, 4) and weights of cubic resampling at pixel centres, sharpness -.75."""
    at = (np.arange(n) + 0.5) * size / n - 0.5
    base = np.floor(at).astype(int)
    t, a = at - base, -0.75
    far = lambda d: a * (d**3 - 5 * d**2 + 8 * d - 4)
    near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
    weight = np.stack([far(1 + t), near(t), near(1 - t), far(2 - t)], axis=1)
    return np.clip(base[:, None] + np.arange(-1, 3), 0, size - 1), weight


def enlarged(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Cubic resampling of a gray image."""
    y, wy = _cubic(height, image.shape[0])
    x, wx = _cubic(width, image.shape[1])
    rows = (image.astype(float)[y] * wy[..., None]).sum(1)
    return np.clip(np.rint((rows[:, x] * wx).sum(2)), 0, 255).astype(np.uint8)


def bounded(image: np.ndarray, side: int) -> np.ndarray:
    """The image, shrunk so that no side is longer than ``side``."""
    h, w = image.shape
    if max(h, w) <= side:
        return image
    return shrunk(image, *(max(1, round(n * side / max(h, w))) for n in (h, w)))


def upscaled(image: np.ndarray, least: int = 300) -> np.ndarray:
    """The image, enlarged to ``least`` rows if it has fewer."""
    h, w = image.shape
    return image if h >= least else enlarged(image, least, max(1, int(w * (least / h))))


def blurred(image: np.ndarray) -> np.ndarray:
    """Gaussian of 3 x 3 (quarter, half, quarter), mirrored at the border."""
    p = np.pad(image.astype(float), 1, mode="reflect") if min(image.shape) > 1 else np.pad(image.astype(float), 1, mode="edge")
    rows = (p[:-2] + 2 * p[1:-1] + p[2:]) / 4
    return np.rint((rows[:, :-2] + 2 * rows[:, 1:-1] + rows[:, 2:]) / 4).astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    n = np.bincount(image.ravel(), minlength=256).astype(float)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    with np.errstate(divide="ignore", invalid="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - (s0[-1] - s0) / w1) ** 2, 0)
    return int(between.argmax())


def local_statistics(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the window around each pixel; its size follows the page's, and it is mirrored at the border."""
    size = max(11, min(25, min(image.shape) // 8)) | 1
    r = size // 2
    p = np.pad(image.astype(float), r, mode="reflect" if min(image.shape) > r else "symmetric")
    area = lambda a: (lambda c: c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size])(np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))))
    mean = area(p) / size**2
    return mean, np.sqrt(np.maximum(0, area(p * p) / size**2 - mean**2))


def sauvola(image: np.ndarray, k: float, statistics: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """True where a pixel is under the local threshold."""
    mean, deviation = statistics or local_statistics(image)
    return image < mean * (1 + k * (deviation / 127.5 - 1))


def _square(image: np.ndarray, pick) -> np.ndarray:
    p = np.pad(image, ((1, 0), (1, 0)), mode="edge")
    return pick(pick(p[1:, 1:], p[:-1, 1:]), pick(p[1:, :-1], p[:-1, :-1]))


# Sensitivities of the local threshold, tried in this order.
SENSITIVITIES = (0.24, 0.32, 0.40, 0.48)


def local_mask(image: np.ndarray) -> np.ndarray:
    """The local threshold's mask, 255 under it, of the first sensitivity that leaves a tenth or less outside, else the last."""
    statistics = local_statistics(image)
    for k in SENSITIVITIES:
        out = np.where(sauvola(image, k, statistics), 255, 0).astype(np.uint8)
        if (out == 0).mean() <= 0.10:
            break
    return out


def binarized(image: np.ndarray) -> np.ndarray:
    """Ink 0 and paper 255, ink thickened.

    The local mask stands where half of it or more is 255, as on very dark pages; on ordinary ones Otsu's level on the
    blurred page decides, turned round if over half is ink.
    """
    soft = blurred(image)
    out = local_mask(soft)
    if (out == 0).mean() > 0.5:
        out = np.where(soft > otsu(soft), 255, 0).astype(np.uint8)
        if (out == 0).mean() > 0.5:
            out = 255 - out
    opened = _square(_square(out, np.minimum)[::-1, ::-1], np.maximum)[::-1, ::-1]
    return _square(opened, np.minimum)


def components(ink: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected ink, 0 elsewhere: union-find over row runs."""
    h, w = ink.shape
    label, parent, before = np.zeros((h, w), np.int64), [0], []
    find = lambda a: a if parent[a] == a else find(parent[a])
    for y in range(h):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ink[y].astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            roots = {find(k) for s, e, k in before if s <= b and e >= a}
            if roots:
                mine = min(roots)
                for r in roots:
                    parent[r] = mine
            else:
                mine = len(parent)
                parent.append(mine)
            label[y, a:b] = mine
            now.append((a, b, mine))
        before = now
    final = np.array([find(k) for k in range(len(parent))])
    names = np.unique(final, return_inverse=True)[1]
    return names[label]


def without_noise(page: np.ndarray) -> np.ndarray:
    """The page without components that are small for it or stretched."""
    label = components(page == 0)
    n = label.max()
    if not n:
        return page.copy()
    area = np.bincount(label.ravel(), minlength=n + 1)[1:]
    y, x = np.nonzero(label)
    box = np.full((n, 4), -1)
    for column, values, pick in ((0, y, np.minimum), (1, y, np.maximum), (2, x, np.minimum), (3, x, np.maximum)):
        box[:, column] = np.iinfo(np.int32).max if pick is np.minimum else -1
        pick.at(box[:, column], label[y, x] - 1, values)
    height, width = box[:, 1] - box[:, 0] + 1, box[:, 3] - box[:, 2] + 1
    bad = (area < max(3, 0.01 * np.median(area))) | (np.maximum(height, width) / np.maximum(1, np.minimum(height, width)) > 25)
    return np.where(np.concatenate([[False], bad])[label], 255, page).astype(np.uint8)


def rotated(page: np.ndarray, degrees: float) -> np.ndarray:
    """Rotation about the middle by the nearest source pixel; paper comes in at the border."""
    h, w = page.shape
    a = math.radians(degrees)
    y, x = np.mgrid[:h, :w]
    u, v = x - w / 2, y - h / 2
    sx = np.rint(u * math.cos(a) - v * math.sin(a) + w / 2).astype(int)
    sy = np.rint(u * math.sin(a) + v * math.cos(a) + h / 2).astype(int)
    ok = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    out = np.full((h, w), 255, np.uint8)
    out[ok] = page[sy[ok], sx[ok]]
    return out


def skew(page: np.ndarray) -> float | None:
    """Angle of -15 to 15 degrees, by halves, whose row profile varies most; 0 for a gain under 5 %, None for no text."""
    h, w = page.shape
    y, x = np.nonzero(page[int(h * 0.02) : h - int(h * 0.02), int(w * 0.02) : w - int(w * 0.02)] == 0)
    if len(y) < 50:
        return None
    u, v = x - w / 2, y - h / 2
    spread = lambda t: np.var(np.bincount(np.rint(v * math.cos(math.radians(t)) - u * math.sin(math.radians(t)) + h + w).astype(int), minlength=2 * (h + w)))
    angles = np.arange(-30, 31) / 2
    power = [spread(t) for t in angles]
    best = int(np.argmax(power))
    return 0.0 if power[best] < 1.05 * power[30] else float(angles[best])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points, in order."""
    rows = np.unique(points, axis=0)
    if len(rows) < 3:
        return rows
    chains = []
    for part in (rows, rows[::-1]):
        chain: list[np.ndarray] = []
        for p in part:
            while len(chain) > 1 and (u := chain[-1] - chain[-2])[0] * (v := p - chain[-2])[1] - u[1] * v[0] <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def box_angle(page: np.ndarray, most: float = 45.0) -> float | None:
    """Angle, over 0 to 90 degrees, of the smallest rectangle around the ink; None beyond ``most`` or under 10 pixels."""
    y, x = np.nonzero(page == 0)
    if len(y) < 10:
        return None
    corners = hull(np.stack([x, y], axis=1).astype(float))
    if len(corners) < 3:
        return None
    best = (math.inf, 90.0)
    for u, v in np.roll(corners, -1, axis=0) - corners:
        turn = math.degrees(math.atan2(v, u)) % 90 or 90.0
        c, s = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        along, across = corners @ np.array([c, s]), corners @ np.array([-s, c])
        best = min(best, (round(float(np.ptp(along) * np.ptp(across)), 6), turn))
    return best[1] if best[1] <= most else None


def straight(page: np.ndarray) -> tuple[np.ndarray, float]:
    """The page turned upright and the angle: by its row profile, by its smallest rectangle where too sparse, else as it is."""
    angle = skew(page)
    if angle is None:
        y, x = max(1, int(page.shape[0] * 0.02)), max(1, int(page.shape[1] * 0.02))
        angle = box_angle(page[y : page.shape[0] - y, x : page.shape[1] - x]) or 0.0
    return (rotated(page, angle) if angle else page.copy()), angle


def preprocessed(image: np.ndarray, side: int = 2000) -> tuple[np.ndarray, float]:
    """A page ready for segmentation and the angle it was turned by: bounded, upscaled, gray, binary, clean, straight, padded."""
    page, angle = straight(without_noise(binarized(upscaled(bounded(gray(image), side)))))
    y, x = int(page.shape[0] * 0.05), int(page.shape[1] * 0.05)
    return np.pad(page, ((y, y), (x, x)), constant_values=255), angle


def runs(page: np.ndarray) -> np.ndarray:
    """(y, x1, x2) of each run of ink."""
    edge = np.diff(np.pad((page == 0).astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, a = np.nonzero(edge == 1)
    b = np.nonzero(edge == -1)[1]
    return np.stack([y, a, b], axis=1)


def normalized(glyph: np.ndarray, side: int = 32, fit: int = 28) -> np.ndarray:
    """The inked box fitted into ``fit`` pixels and centred on white; white if there is no ink."""
    out = np.full((side, side), 255, np.uint8)
    y, x = np.nonzero(glyph == 0)
    if not len(y):
        return out
    part = glyph[y.min() : y.max() + 1, x.min() : x.max() + 1]
    scale = fit / max(part.shape)
    h, w = (max(1, int(n * scale)) for n in part.shape)
    top, left = (side - h) // 2, (side - w) // 2
    out[top : top + h, left : left + w] = (shrunk if scale < 1 else resized)(part, h, w)
    return out


def hog(image: np.ndarray, cell: int = 4, bins: int = 9) -> np.ndarray:
    """Blocks of 2 x 2 cells of direction histograms, each block scaled, clipped at .2 and scaled again."""
    v = image.astype(float)
    gy, gx = np.zeros_like(v), np.zeros_like(v)
    gy[1:-1], gx[:, 1:-1] = v[2:] - v[:-2], v[:, 2:] - v[:, :-2]
    place = np.minimum(bins - 1, (np.degrees(np.arctan2(gy, gx)) % 180 / (180 / bins)).astype(int))
    n = image.shape[0] // cell
    hist = np.zeros((n, n, bins))
    y, x = np.mgrid[: n * cell, : n * cell] // cell
    np.add.at(hist, (y, x, place[: n * cell, : n * cell]), np.hypot(gx, gy)[: n * cell, : n * cell] / cell**2)
    out = []
    for i in range(n - 1):
        for j in range(n - 1):
            block = hist[i : i + 2, j : j + 2].ravel()
            block = np.minimum(block / math.sqrt((block**2).sum() + 1e-10), 0.2)
            out.append(block / math.sqrt((block**2).sum() + 1e-10))
    return np.concatenate(out)


def contour(image: np.ndarray, samples: int = 64) -> np.ndarray:
    """``samples`` points at equal arc lengths of the longest outer border: x, y (shares of the side) and direction."""
    label = components(image == 0)
    if not label.max():
        return np.zeros(3 * samples)
    size = np.bincount(label.ravel())[1:]
    points = np.array(_border(label == int(size.argmax()) + 1), float)
    if len(points) < 3:
        return np.zeros(3 * samples)
    loop = np.concatenate([points, points[:1]])
    arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(loop, axis=0).T))])
    at = np.linspace(0, arc[-1], samples, endpoint=False)
    y, x = (np.interp(at, arc, loop[:, k]) for k in (0, 1))
    turn = np.arctan2(np.roll(y, -1) - y, np.roll(x, -1) - x)
    return np.stack([x / image.shape[1], y / image.shape[0], (turn + math.pi) / (2 * math.pi)], axis=1).ravel()


def _border(mask: np.ndarray) -> list[tuple[int, int]]:
    """Outer border of a component, clockwise from its first pixel (Moore neighbours)."""
    around = [(0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1)]
    p = np.pad(mask, 1)
    start = tuple(int(k) for k in np.argwhere(p)[0])
    out, here, came, first = [start], start, 0, None
    while True:
        for k in range(8):
            turn = (came + k) % 8
            there = here[0] + around[turn][0], here[1] + around[turn][1]
            if p[there]:
                break
        else:
            break
        if (here, turn) == first or len(out) > 4 * mask.size:
            break
        first = first or (here, turn)
        here, came = there, (turn + 5) % 8
        out.append(here)
    return [(y - 1, x - 1) for y, x in out[:-1]] if len(out) > 1 else [(start[0] - 1, start[1] - 1)]


def grid(image: np.ndarray, cell: int = 4) -> np.ndarray:
    """Share of ink in each cell of a normalised glyph."""
    n = image.shape[0] // cell
    return (image == 0).reshape(n, cell, n, cell).mean(axis=(1, 3)).ravel()


def zernike(image: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Moment magnitudes of a normalised glyph's dark pixels; ``basis`` has a complex row per moment, scaled by its order."""
    return np.abs(basis[:, (image < 128).ravel()].sum(axis=1))
