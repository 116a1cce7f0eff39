"""Queries over glyph images: each embedding is an 8 x 8 image, element i at row i div 8 and column i mod 8."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glyphs as G
from .corpus import table

SIDE = 8
SHEARS = list(range(-6, 7))


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph"), F.posexplode("embedding").alias("i", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5))).cast("int")
    return rows.select("glyph", F.expr(f"CAST(i DIV {SIDE} AS int)").alias("y"), (F.col("i") % SIDE).alias("x"), v.alias("v"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ink = F.transform("embedding", lambda e: (e > 0).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph"), ink.alias("ink"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images(spark, sf_dir).select("glyph", F.posexplode("ink").alias("i", "ink"))
    return rows.select("glyph", F.expr(f"CAST(i DIV {SIDE} AS int)").alias("y"), (F.col("i") % SIDE).alias("x"), "ink")


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary glyph at 32 x 32, moved one pixel to the right so that cells are partly inked."""
    four = F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = binary(spark, sf_dir).withColumn("dy", four).withColumn("dx", four)
    return rows.select("glyph", (F.col("y") * 4 + F.col("dy")).alias("y"), ((F.col("x") * 4 + F.col("dx") + 1) % 32).alias("x"), "ink")


def _parts(spark, sf_dir):
    pixels = G.component_pixels(images(spark, sf_dir), SIDE, SIDE)
    return pixels, G.component_stats(pixels)


def _clusters(spark, sf_dir):
    pixels, stats = _parts(spark, sf_dir)
    return G.dot_clusters(G.dots(stats, pixels), G.baselines(stats, SIDE))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def glyph_components(spark, sf_dir):
    return _rounded(_parts(spark, sf_dir)[1], "cx", "cy").withColumnsRenamed({"left": "x1", "top": "y1"})


def component_noise_filter(spark, sf_dir):
    return G.without_noise(_parts(spark, sf_dir)[1]).select("glyph", "comp", "area")


def baseline_mode(spark, sf_dir):
    return G.baselines(_parts(spark, sf_dir)[1], SIDE)


def dot_clusters(spark, sf_dir):
    return _rounded(_clusters(spark, sf_dir), "cx", "cy")


def dot_char_assignment(spark, sf_dir):
    halves = spark.createDataFrame([(0, 4, 8), (1, 0, 4)], "char int, x1 int, x2 int")
    boxes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph")).crossJoin(F.broadcast(halves))  # two fixed boxes a glyph
    return _rounded(G.assigned(_clusters(spark, sf_dir), boxes), "cx", "cy")


def dot_feature_vector(spark, sf_dir):
    every = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("glyph"))
    return _rounded(G.dot_features(_clusters(spark, sf_dir), ["glyph"], every), "spread")


def otsu_threshold(spark, sf_dir):
    pixels = gray(spark, sf_dir)
    limits = G.otsu(pixels)
    ink = G.binarized(pixels, limits).groupBy("glyph").agg(F.sum("ink").cast("long").alias("n_ink"))
    return limits.join(ink, "glyph")


def sauvola_mask(spark, sf_dir):
    return G.sauvola(gray(spark, sf_dir), 5, 0.24).groupBy("glyph").agg(F.sum("dark").cast("long").alias("n_dark"), F.sum(F.expr(f"dark * (y * {SIDE} + x)")).cast("long").alias("place"))


def morphology_2x2(spark, sf_dir):
    pixels = binary(spark, sf_dir)
    thin = G.eroded(pixels).withColumnRenamed("ink", "eroded")
    return thin.join(G.opened(pixels).withColumnRenamed("ink", "opened"), ["glyph", "y", "x"])


def grid_density(spark, sf_dir):
    return _rounded(G.grid_density(enlarged(spark, sf_dir), 4), "density")


def zernike_magnitudes(spark, sf_dir):
    return _rounded(G.zernike(enlarged(spark, sf_dir).where("ink = 1"), 32), "magnitude")


def hog_cell_histogram(spark, sf_dir):
    return _rounded(G.hog_cells(gray(spark, sf_dir), 4), "weight")


def skew_angle_search(spark, sf_dir):
    return G.skew(binary(spark, sf_dir).where("ink = 1"), SHEARS)


QUERIES = {f.__name__: f for f in (glyph_components, component_noise_filter, baseline_mode, dot_clusters, dot_char_assignment, dot_feature_vector, otsu_threshold, sauvola_mask, morphology_2x2, grid_density, zernike_magnitudes, hog_cell_histogram, skew_angle_search)}

GRAY = """g AS (SELECT vec_id AS glyph, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(greatest(0, least(255, floor((e::DOUBLE + 1) * 127.5))) AS INTEGER) AS v, CASE WHEN e > 0 THEN 1 ELSE 0 END AS ink
FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"""
COMP = f"""WITH RECURSIVE {GRAY}, p AS (SELECT glyph, y, x, y * 8 + x AS i FROM g WHERE ink = 1),
reach AS (SELECT glyph, i, i AS j FROM p UNION SELECT r.glyph, r.i, b.i FROM reach r JOIN p a ON a.glyph = r.glyph AND a.i = r.j JOIN p b ON b.glyph = a.glyph AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
px AS (SELECT p.glyph, CAST(min(j) AS INTEGER) AS comp, y, x FROM reach JOIN p USING (glyph, i) GROUP BY p.glyph, i, y, x),
st AS (SELECT glyph, comp, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY glyph, comp),
ahs AS (SELECT glyph, quantile_cont(height, 0.7) AS ah, quantile_cont(area, 0.25) AS p25, quantile_cont(area, 0.5) AS middle FROM st GROUP BY glyph)"""
BASE = f"""{COMP}, bt AS (SELECT glyph, top + height AS bottom, count(*) AS n FROM st JOIN ahs USING (glyph)
    WHERE NOT (height < 0.4 * ah AND width < 0.4 * ah AND area < 0.15 * ah * ah AND height / width BETWEEN 0.25 AND 4) GROUP BY ALL),
bl AS (SELECT s.glyph, coalesce(bottom, 6.0)::DOUBLE AS baseline FROM (SELECT DISTINCT glyph FROM st) s LEFT JOIN (SELECT glyph, bottom FROM bt QUALIFY row_number() OVER (PARTITION BY glyph ORDER BY n DESC, bottom) = 1) b USING (glyph))"""
DOTS = f"""{BASE}, dt AS (SELECT st.*, ah, row_number() OVER (PARTITION BY glyph ORDER BY cx, cy) AS k FROM st JOIN ahs USING (glyph)
    WHERE greatest(height, width) <= greatest(2, 0.6 * ah) AND area <= greatest(1, least(0.2 * ah * ah, 1.5 * p25)) AND height / width BETWEEN 0.2 AND 6
    AND NOT EXISTS (SELECT 1 FROM px WHERE px.glyph = st.glyph AND px.comp <> st.comp AND px.x BETWEEN st."left" AND st."left" + width - 1 AND px.y BETWEEN st.top AND st.top + height - 1)),
dr AS (SELECT glyph, k, k AS j FROM dt UNION SELECT r.glyph, r.k, b.k FROM dr r JOIN dt a ON a.glyph = r.glyph AND a.k = r.j JOIN dt b ON b.glyph = a.glyph AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= 0.5 * a.ah),
cl AS (SELECT glyph, avg(cx) AS cx, avg(cy) AS cy, CAST(count(*) AS INTEGER) AS size FROM (SELECT glyph, k, min(j) AS root FROM dr GROUP BY glyph, k) JOIN dt USING (glyph, k) GROUP BY glyph, root),
cp AS (SELECT glyph, cx, cy, size, CASE WHEN cy < baseline THEN 'above' ELSE 'below' END AS position FROM cl JOIN bl USING (glyph))"""
BIG = f"""WITH {GRAY}, e AS (SELECT glyph, y * 4 + dy AS y, (x * 4 + dx + 1) % 32 AS x, ink FROM g, (SELECT unnest(range(0, 4)) AS dy), (SELECT unnest(range(0, 4)) AS dx))"""


def _radial() -> list[tuple[int, int, int, int]]:
    """(n, |m|, power, coefficient) of the radial polynomials."""
    f = math.factorial
    return [(n, m, n - 2 * k, (-1) ** k * f(n - k) // (f(k) * f((n + m) // 2 - k) * f((n - m) // 2 - k))) for n in range(9) for m in range(n % 2, n + 1, 2) for k in range((n - m) // 2 + 1)]


def _near(source: str, r1: int, r2: int, value: str) -> str:
    return f"SELECT a.glyph, a.y, a.x, b.{value} AS near FROM {source} a JOIN {source} b ON a.glyph = b.glyph AND b.y - a.y BETWEEN {r1} AND {r2} AND b.x - a.x BETWEEN {r1} AND {r2}"


SQL = {
    "glyph_components": f'{COMP} SELECT glyph, comp, "left" AS x1, top AS y1, width, height, area, round(cx, 6) AS cx, round(cy, 6) AS cy FROM st',
    "component_noise_filter": f"{COMP} SELECT glyph, comp, area FROM st JOIN ahs USING (glyph) WHERE area >= greatest(3, 0.01 * middle) AND greatest(width, height) / greatest(least(width, height), 1) <= 25",
    "baseline_mode": f"{BASE} SELECT * FROM bl",
    "dot_clusters": f"{DOTS} SELECT glyph, round(cx, 6) AS cx, round(cy, 6) AS cy, size, position FROM cp",
    "dot_char_assignment": f"""{DOTS}, bx(char, x1, x2) AS (VALUES (0, 4, 8), (1, 0, 4)) SELECT glyph, round(cx, 6) AS cx, round(cy, 6) AS cy, size, position, char
FROM (SELECT *, abs(cx - (x1 + x2) / 2) AS d FROM cp, bx) WHERE d <= 4 QUALIFY row_number() OVER (PARTITION BY glyph, cx, cy ORDER BY d, char) = 1""",
    "dot_feature_vector": f"""{DOTS} SELECT e.glyph, CAST(coalesce(sum(CASE WHEN position = 'above' THEN size ELSE 0 END), 0) AS BIGINT) AS above, CAST(coalesce(sum(CASE WHEN position = 'below' THEN size ELSE 0 END), 0) AS BIGINT) AS below,
CAST(count(size) > 0 AS INTEGER) AS has_any, round(CASE WHEN count(size) > 1 THEN stddev_pop(cx) ELSE 0 END, 6) AS spread FROM (SELECT DISTINCT vec_id AS glyph FROM embeddings) e LEFT JOIN cp ON cp.glyph = e.glyph GROUP BY e.glyph""",
    "otsu_threshold": f"""WITH {GRAY}, b AS (SELECT glyph, v, count(*) AS n FROM g GROUP BY glyph, v),
s AS (SELECT *, sum(n) OVER (PARTITION BY glyph ORDER BY v) AS w0, sum(n * v) OVER (PARTITION BY glyph ORDER BY v) AS s0, sum(n) OVER (PARTITION BY glyph) AS w, sum(n * v) OVER (PARTITION BY glyph) AS s FROM b),
t AS (SELECT glyph, v AS threshold FROM (SELECT *, round(CASE WHEN w = w0 THEN 0 ELSE w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2 END, 6) AS q FROM s) QUALIFY row_number() OVER (PARTITION BY glyph ORDER BY q DESC, v) = 1)
SELECT glyph, threshold, CAST(CASE WHEN avg(d) > 0.5 THEN sum(1 - d) ELSE sum(d) END AS BIGINT) AS n_ink FROM (SELECT g.glyph, threshold, CASE WHEN v <= threshold THEN 1 ELSE 0 END AS d FROM g JOIN t USING (glyph)) GROUP BY glyph, threshold""",
    "sauvola_mask": f"""WITH {GRAY}, n AS ({_near("g", -2, 2, "v")}), s AS (SELECT glyph, y, x, avg(near) AS m, stddev_pop(near) AS s FROM n GROUP BY glyph, y, x)
SELECT glyph, CAST(sum(d) AS BIGINT) AS n_dark, CAST(sum(d * (y * 8 + x)) AS BIGINT) AS place FROM (SELECT glyph, y, x, CASE WHEN v < m * (1 + 0.24 * (s / 127.5 - 1)) THEN 1 ELSE 0 END AS d FROM g JOIN s USING (glyph, y, x)) GROUP BY glyph""",
    "morphology_2x2": f"""WITH {GRAY}, n AS ({_near("g", -1, 0, "ink")}), e AS (SELECT glyph, y, x, min(near) AS eroded FROM n GROUP BY glyph, y, x),
m AS ({_near("e", 0, 1, "eroded")}) SELECT glyph, y, x, eroded, opened FROM e JOIN (SELECT glyph, y, x, max(near) AS opened FROM m GROUP BY glyph, y, x) USING (glyph, y, x)""",
    "grid_density": f"{BIG} SELECT glyph, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 4 AS INTEGER) AS cx, round(avg(ink), 6) AS density FROM e GROUP BY glyph, y // 4, x // 4",
    "zernike_magnitudes": f"""{BIG}, c(n, a, power, k) AS (VALUES {", ".join(map(str, _radial()))}),
u AS (SELECT glyph, sqrt(((x - 16) / 16.0) ** 2 + ((y - 16) / 16.0) ** 2) AS rho, atan2((y - 16) / 16.0, (x - 16) / 16.0) AS phi FROM e WHERE ink = 1),
p AS (SELECT glyph, n, a, phi, sum(k * rho ** power) AS r FROM u, c WHERE rho <= 1 GROUP BY glyph, n, a, rho, phi, u.rho),
s AS (SELECT glyph, n, a, sqrt(sum(r * cos(a * phi)) ** 2 + sum(r * sin(a * phi)) ** 2) * (n + 1) / pi() AS magnitude FROM p GROUP BY glyph, n, a)
SELECT glyph, n, m, round(magnitude, 6) AS magnitude FROM (SELECT glyph, n, unnest(CASE WHEN a = 0 THEN [0] ELSE [-a, a] END) AS m, magnitude FROM s)""",
    "hog_cell_histogram": f"""WITH {GRAY}, d AS (SELECT glyph, y, x, coalesce(lead(v) OVER r - lag(v) OVER r, 0)::DOUBLE AS gx, coalesce(lead(v) OVER c - lag(v) OVER c, 0)::DOUBLE AS gy FROM g
    WINDOW r AS (PARTITION BY glyph, y ORDER BY x), c AS (PARTITION BY glyph, x ORDER BY y)),
a AS (SELECT *, degrees(atan2(gy, gx)) AS t, sqrt(gx * gx + gy * gy) AS m FROM d),
b AS (SELECT *, CAST(least(8, floor(round(CASE WHEN t < 0 THEN t + 180 WHEN t >= 180 THEN t - 180 ELSE t END, 9) / 20)) AS INTEGER) AS bin FROM a)
SELECT glyph, CAST(y // 4 AS INTEGER) AS cy, CAST(x // 4 AS INTEGER) AS cx, bin, round(sum(m), 6) AS weight FROM b GROUP BY glyph, y // 4, x // 4, bin HAVING sum(m) > 0""",
    "skew_angle_search": f"""WITH {GRAY}, s AS (SELECT glyph, shear, y + CAST(floor(shear * x / 8) AS INTEGER) AS r FROM g, (SELECT unnest({SHEARS}) AS shear) WHERE ink = 1),
p AS (SELECT glyph, shear, r, count(*) AS n FROM s GROUP BY ALL), q AS (SELECT glyph, shear, sum(n * n) AS power FROM p GROUP BY glyph, shear)
SELECT glyph, shear FROM q QUALIFY row_number() OVER (PARTITION BY glyph ORDER BY power DESC, abs(shear), shear) = 1""",
}
