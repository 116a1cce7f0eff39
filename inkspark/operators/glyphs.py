"""Glyph operators on pixel rows (glyph, y, x, v) or ink rows (glyph, y, x), 8-connected components and dots included."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def otsu(pixels: DataFrame) -> DataFrame:
    """``(glyph, threshold)``: the level of largest between-class variance of the 256-bin histogram, least on ties."""
    bins = pixels.groupBy("glyph", "v").agg(F.count("*").alias("n"))
    order, whole = Window.partitionBy("glyph").orderBy("v"), Window.partitionBy("glyph")
    below = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = bins.select("glyph", "v", F.sum("n").over(below).alias("w0"), F.sum(F.col("n") * F.col("v")).over(below).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("v")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    between = F.round(F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(0.0)), 6)
    best = F.row_number().over(Window.partitionBy("glyph").orderBy(F.desc("between"), "v"))
    return sums.withColumn("between", between).withColumn("best", best).where("best = 1").select("glyph", F.col("v").alias("threshold"))


def binarized(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``(glyph, y, x, ink)``: 1 at or under the threshold; turned round where over half would be ink."""
    dark = pixels.join(thresholds, "glyph").withColumn("dark", (F.col("v") <= F.col("threshold")).cast("int"))
    flip = F.avg("dark").over(Window.partitionBy("glyph")) > 0.5
    return dark.select("glyph", "y", "x", F.when(flip, 1 - F.col("dark")).otherwise(F.col("dark")).alias("ink"))


def neighbourhood(pixels: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """(glyph, y, x, near): each pixel sends its value to the places that see it at one of the offsets."""
    sees = F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in offsets))
    sent = pixels.select("glyph", "y", "x", value, F.explode(sees).alias("o"))
    return sent.select("glyph", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col(value).alias("near"))


SQUARE = [(0, 0), (0, -1), (-1, 0), (-1, -1)]


def eroded(pixels: DataFrame, value: str = "ink") -> DataFrame:
    """Least value of the 2 x 2 square that ends at each pixel; outside the image counts for nothing."""
    return _extreme(pixels, value, SQUARE, F.min)


def dilated(pixels: DataFrame, value: str = "ink") -> DataFrame:
    """Largest value of the 2 x 2 square that begins at each pixel."""
    return _extreme(pixels, value, [(-dy, -dx) for dy, dx in SQUARE], F.max)


def _extreme(pixels: DataFrame, value: str, offsets: list[tuple[int, int]], pick) -> DataFrame:
    seen = neighbourhood(pixels, offsets, value).groupBy("glyph", "y", "x").agg(pick("near").alias(value))
    return seen.join(pixels.select("glyph", "y", "x"), ["glyph", "y", "x"])


def opened(pixels: DataFrame, value: str = "ink") -> DataFrame:
    return dilated(eroded(pixels, value), value)


def sauvola(pixels: DataFrame, window: int, k: float) -> DataFrame:
    """(glyph, y, x, dark): v under m (1 + k (s / 127.5 - 1)), mean and deviation over the window's part in the image."""
    r = window // 2
    offsets = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    stats = neighbourhood(pixels, offsets, "v").groupBy("glyph", "y", "x").agg(F.avg("near").alias("m"), F.stddev_pop("near").alias("s"))
    rows = pixels.join(stats, ["glyph", "y", "x"])
    return rows.select("glyph", "y", "x", (F.col("v") < F.col("m") * (1 + k * (F.col("s") / 127.5 - 1))).cast("int").alias("dark"))


def grid_density(pixels: DataFrame, cell: int) -> DataFrame:
    """(glyph, cy, cx, density): share of ink in cells of ``cell`` by ``cell`` pixels."""
    keys = [F.col("glyph"), F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx")]
    return pixels.groupBy(*keys).agg(F.avg("ink").alias("density"))


def hog_cells(pixels: DataFrame, cell: int, bins: int = 9) -> DataFrame:
    """(glyph, cy, cx, bin, weight): gradient magnitude by unsigned direction; central differences, 0 at the border."""
    key = ["glyph", "y", "x"]
    by_row, by_column = Window.partitionBy("glyph", "y").orderBy("x"), Window.partitionBy("glyph", "x").orderBy("y")
    slope = lambda w: F.coalesce(F.lead("v").over(w) - F.lag("v").over(w), F.lit(0)).cast("double")
    rows = pixels.select(*key, slope(by_row).alias("gx"), slope(by_column).alias("gy"))
    angle = F.pmod(F.degrees(F.atan2("gy", "gx")), F.lit(180.0))
    place = F.least(F.lit(bins - 1), F.floor(F.round(angle, 9) / (180.0 / bins)).cast("int"))
    cells = rows.select("glyph", F.floor(F.col("y") / cell).cast("int").alias("cy"), F.floor(F.col("x") / cell).cast("int").alias("cx"), place.alias("bin"), F.hypot("gx", "gy").alias("g"))
    return cells.groupBy("glyph", "cy", "cx", "bin").agg(F.sum("g").alias("weight")).where("weight > 0")


def zernike_basis(size: int, degree: int = 8) -> list[tuple[int, int, int, int, float, float]]:
    """(n, m, y, x, re, im) of the orders n to ``degree`` and all m from -n to n of n's parity, on the unit disc."""
    out = []
    for y in range(size):
        for x in range(size):
            u, v = (x - size / 2) / (size / 2), (y - size / 2) / (size / 2)
            rho, phi = math.hypot(u, v), math.atan2(v, u)
            if rho > 1:
                continue
            for n in range(degree + 1):
                for m in range(-n, n + 1, 2):
                    a = abs(m)
                    radial = sum((-1) ** s * math.factorial(n - s) / (math.factorial(s) * math.factorial((n + a) // 2 - s) * math.factorial((n - a) // 2 - s)) * rho ** (n - 2 * s) for s in range((n - a) // 2 + 1))
                    out.append((n, m, y, x, radial * math.cos(m * phi), -radial * math.sin(m * phi)))
    return out


def zernike(ink: DataFrame, size: int, degree: int = 8) -> DataFrame:
    """(glyph, n, m, magnitude): moments of the inked pixels, scaled by (n + 1) / pi."""
    spark = ink.sparkSession
    basis = spark.createDataFrame(zernike_basis(size, degree), "n int, m int, y int, x int, re double, im double")
    sums = ink.join(F.broadcast(basis), ["y", "x"]).groupBy("glyph", "n", "m").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return sums.select("glyph", "n", "m", ((F.col("n") + 1) / math.pi * F.hypot("re", "im")).alias("magnitude"))


def skew(ink: DataFrame, shears: list[int]) -> DataFrame:
    """(glyph, shear): the shear (eighths of a row per column) whose row profile varies most, the first on ties."""
    grid = F.explode(F.array(*map(F.lit, shears))).alias("shear")
    rows = ink.select("glyph", "y", "x", grid).withColumn("row", F.col("y") + F.floor(F.col("shear") * F.col("x") / 8))
    profile = rows.groupBy("glyph", "shear", "row").agg(F.count("*").alias("n"))
    spread = profile.groupBy("glyph", "shear").agg(F.round(F.sum(F.col("n") * F.col("n")), 6).alias("power"))
    best = F.row_number().over(Window.partitionBy("glyph").orderBy(F.desc("power"), F.abs("shear"), "shear"))
    return spread.withColumn("best", best).where("best = 1").select("glyph", "shear")


def _labels(ink: np.ndarray) -> np.ndarray:
    """Component of each pixel as the least pixel index in it, 8-connected; -1 off ink."""
    h, w = ink.shape
    label = np.where(ink, np.arange(h * w).reshape(h, w), h * w)
    while True:
        padded = np.pad(label, 1, constant_values=h * w)
        least = np.min([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(ink, least, h * w)
        if (new == label).all():
            return np.where(ink, label, -1)
        label = new


def component_pixels(images: DataFrame, height: int, width: int) -> DataFrame:
    """(glyph, comp, y, x) of images (glyph, ink array of 0 and 1 by rows); one image is one row, so none is split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = []
            for glyph, flat in zip(frame["glyph"], frame["ink"], strict=True):
                label = _labels(np.asarray(flat).reshape(height, width) > 0)
                y, x = np.nonzero(label >= 0)
                parts.append(pd.DataFrame({"glyph": glyph, "comp": label[y, x], "y": y, "x": x}))
            if parts:
                yield pd.concat(parts)

    return images.select("glyph", "ink").mapInPandas(run, "glyph long, comp int, y int, x int")


def component_stats(pixels: DataFrame) -> DataFrame:
    """(glyph, comp, left, top, width, height, area, cx, cy)."""
    return pixels.groupBy("glyph", "comp").agg(
        F.min("x").alias("left"), F.min("y").alias("top"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )


def average_height(stats: DataFrame) -> DataFrame:
    """(glyph, ah): 70th percentile of component heights."""
    return stats.groupBy("glyph").agg(F.expr("percentile(height, 0.7)").alias("ah"))


def without_noise(stats: DataFrame) -> DataFrame:
    """Components but the small (under max(3, 1 % of the median area)) and the stretched (longer side over 25 times)."""
    middle = stats.groupBy("glyph").agg(F.expr("percentile(area, 0.5)").alias("middle"))
    long = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1))
    return stats.join(middle, "glyph").where((F.col("area") >= F.greatest(F.lit(3.0), 0.01 * F.col("middle"))) & (long <= 25)).drop("middle")


def baselines(stats: DataFrame, height: int) -> DataFrame:
    """(glyph, baseline): commonest bottom of components that don't look like dots, the least on ties; else .75 height."""
    aspect = F.col("height") / F.col("width")
    dotty = (F.col("height") < 0.4 * F.col("ah")) & (F.col("width") < 0.4 * F.col("ah")) & (F.col("area") < 0.15 * F.col("ah") ** 2) & aspect.between(0.25, 4)
    rows = stats.join(average_height(stats), "glyph")
    bottoms = rows.where(~dotty).groupBy("glyph", (F.col("top") + F.col("height")).alias("bottom")).agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("glyph").orderBy(F.desc("n"), "bottom"))
    found = bottoms.withColumn("best", best).where("best = 1").select("glyph", F.col("bottom").cast("double").alias("bottom"))
    return stats.select("glyph").distinct().join(found, "glyph", "left").select("glyph", F.coalesce("bottom", F.lit(0.75 * height)).alias("baseline"))


def dots(stats: DataFrame, pixels: DataFrame) -> DataFrame:
    """Components that are dots: small in every measure, of even shape, and alone in their box."""
    quarter = stats.groupBy("glyph").agg(F.expr("percentile(area, 0.25)").alias("p25"))
    rows = stats.join(average_height(stats), "glyph").join(quarter, "glyph")
    ah = F.col("ah")
    small = (F.greatest("height", "width") <= F.greatest(F.lit(2.0), 0.6 * ah)) & (F.col("area") <= F.greatest(F.lit(1.0), F.least(0.2 * ah * ah, 1.5 * F.col("p25"))))
    rows = rows.where(small & (F.col("height") / F.col("width")).between(0.2, 6))
    other = pixels.select("glyph", F.col("comp").alias("o"), "y", "x")
    cond = (rows["glyph"] == other["glyph"]) & (rows["comp"] != other["o"]) & other["x"].between(rows["left"], rows["left"] + rows["width"] - 1) & other["y"].between(rows["top"], rows["top"] + rows["height"] - 1)
    return rows.join(other, cond, "left_anti")


def dot_clusters(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(glyph, cx, cy, size, position): dots within .5 ah of each other, transitively, as one; above or below the baseline.

    A glyph's dots are one small array (bounded by its pixels), clustered in one task.
    """

    @F.pandas_udf("array<struct<cx: double, cy: double, size: int>>")
    def cluster(rows: pd.Series, ah: pd.Series) -> pd.Series:
        out = []
        for points, height in zip(rows, ah, strict=True):
            at = sorted((p["cx"], p["cy"]) for p in points)
            root = list(range(len(at)))
            for i in range(len(at)):
                for j in range(i):
                    if math.hypot(at[i][0] - at[j][0], at[i][1] - at[j][1]) <= 0.5 * height and root[i] != root[j]:
                        old, new = root[i], root[j]
                        root = [new if r == old else r for r in root]
            groups = [[p for p, r in zip(at, root, strict=True) if r == k] for k in sorted(set(root))]
            out.append([{"cx": sum(p[0] for p in g) / len(g), "cy": sum(p[1] for p in g) / len(g), "size": len(g)} for g in groups])
        return pd.Series(out)

    arrays = found.groupBy("glyph").agg(F.collect_list(F.struct("cx", "cy")).alias("points"), F.first("ah").alias("ah"))
    clusters = arrays.select("glyph", F.explode(cluster("points", "ah")).alias("c")).select("glyph", "c.*")
    return clusters.join(lines, "glyph").select("glyph", "cx", "cy", "size", F.when(F.col("cy") < F.col("baseline"), "above").otherwise("below").alias("position"))


def assigned(clusters: DataFrame, boxes: DataFrame) -> DataFrame:
    """Clusters with the box (glyph, char, x1, x2) whose centre is nearest in x, the first on ties, if near enough."""
    reach = boxes.groupBy("glyph").agg(F.greatest(F.lit(4), (0.7 * F.floor(F.avg(F.col("x2") - F.col("x1")))).cast("int")).alias("reach"))
    pairs = clusters.join(boxes, "glyph").withColumn("d", F.abs(F.col("cx") - (F.col("x1") + F.col("x2")) / 2))
    best = F.row_number().over(Window.partitionBy("glyph", "cx", "cy").orderBy("d", "char"))
    return pairs.withColumn("best", best).where("best = 1").join(reach, "glyph").where("d <= reach").select("glyph", "cx", "cy", "size", "position", "char")


def dot_features(clusters: DataFrame, keys: list[str], every: DataFrame | None = None) -> DataFrame:
    """(keys, above, below, has_any, spread): dots above and below, and the deviation of cx of two or more clusters.

    Given ``every`` with the keys of all glyphs, those without dots have zeros; else they have no row.
    """
    side = lambda p: F.sum(F.when(F.col("position") == p, F.col("size")).otherwise(0)).cast("long")
    spread = F.when(F.count("*") > 1, F.stddev_pop("cx")).otherwise(0.0)
    seen = clusters.groupBy(*keys).agg(side("above").alias("above"), side("below").alias("below"), F.lit(1).alias("has_any"), spread.alias("spread"))
    if every is None:
        return seen
    return every.select(*keys).distinct().join(seen, keys, "left").na.fill(0, ["above", "below", "has_any", "spread"])
