"""Operators on candidate lists: rows (keys, ord, label, conf), where ord keeps the order given."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import TATWEEL
from ..functions.text import base_of

UNDETECTED = "_"


def with_glyphs(candidates: DataFrame, labels: DataFrame, script: str) -> DataFrame:
    """Adds ``glyph``: a label's character; a label of script characters alone stands for itself; else ``_``."""
    known = F.broadcast(labels.select("label", F.col("glyph").alias("known")))  # the fixed label dimension
    plain = F.col("label").rlike(f"^[{script}]+$")
    glyph = F.when(plain, F.translate("label", TATWEEL, "")).otherwise(F.coalesce("known", F.lit(UNDETECTED)))
    return candidates.join(known, "label", "left").withColumn("glyph", glyph).drop("known")


def merged(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, glyph, p, rank)``: confidences of equal glyphs summed and normalised, best first, ties in order given.

    Undetected glyphs are dropped; a position that keeps no weight has the one candidate ``_`` with p = 1.
    """
    seen = candidates.where(F.col("glyph") != UNDETECTED)
    sums = seen.groupBy(*keys, "glyph").agg(F.sum("conf").alias("conf"), F.min("ord").alias("ord"))
    sums = sums.withColumn("total", F.sum("conf").over(Window.partitionBy(*keys))).where("total > 0")
    places = candidates.select(*keys).distinct()
    full = places.join(sums, keys, "left")
    best = Window.partitionBy(*keys).orderBy(F.desc("conf"), "ord")
    return full.select(
        *keys,
        F.coalesce("glyph", F.lit(UNDETECTED)).alias("glyph"),
        F.coalesce(F.try_divide("conf", "total"), F.lit(1.0)).alias("p"),
        F.row_number().over(best).alias("rank"),
    )


def _normalised(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``score`` over its sum per position, or over 1 where the sum is 0."""
    total = F.sum(score).over(Window.partitionBy(*keys))
    return rows.withColumn("p", F.col(score) / F.when(total == 0, 1.0).otherwise(total))


def _with_expected(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    dots = labels.select("base", "exp_above", "exp_below").distinct()
    return candidates.withColumn("base", base_of(F.col("label"))).join(F.broadcast(dots), "base", "left")


def dot_reranked(candidates: DataFrame, labels: DataFrame, keys: list[str], boost: float = 0.2, penalty: float = 0.1) -> DataFrame:
    """Adds ``p`` and ``rank``: candidates whose expected dots equal ``above`` and ``below`` gain, others lose down to 0;
    names without expected dots stay as they are."""
    match = (F.col("exp_above") == F.col("above")) & (F.col("exp_below") == F.col("below"))
    score = F.when(match, F.col("conf") + boost).when(F.col("exp_above").isNotNull(), F.greatest(F.lit(0.0), F.col("conf") - penalty)).otherwise(F.col("conf"))
    rows = _with_expected(candidates, labels).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "ord"))
    return _normalised(rows, keys, "score").withColumn("rank", rank).drop("base", "exp_above", "exp_below", "score")


def model_reranked(candidates: DataFrame, labels: DataFrame, keys: list[str], weights: list[float], intercept: float, alpha: float = 0.6) -> DataFrame:
    """Adds ``p``: alpha conf + (1 - alpha) P(right), normalised; P is logistic in conf, expected and seen dots.

    The order given stays. ``weights``: conf, expected above and below, seen above and below, any seen, spread.
    """
    inputs = ["conf", F.coalesce("exp_above", F.lit(0)), F.coalesce("exp_below", F.lit(0)), "above", "below", F.when(F.col("above") + F.col("below") > 0, 1).otherwise(0), "spread"]
    logit = F.lit(intercept)
    for weight, x in zip(weights, inputs, strict=True):
        logit = logit + weight * (F.col(x) if isinstance(x, str) else x)
    rows = _with_expected(candidates, labels)
    rows = rows.withColumn("score", alpha * F.col("conf") + (1 - alpha) / (1 + F.exp(-logit)))
    return _normalised(rows, keys, "score").drop("base", "exp_above", "exp_below", "score")


def _kept(rows: DataFrame, keys: list[str], fits) -> DataFrame:
    """The rows that fit; all rows of a position where none does."""
    rows = rows.withColumn("fits", F.coalesce(fits, F.lit(False)).cast("int"))
    return rows.withColumn("any_fits", F.max("fits").over(Window.partitionBy(*keys))).where("fits = 1 OR any_fits = 0").drop("fits", "any_fits")


def by_position(candidates: DataFrame, keys: list[str], suffixes: dict[str, str]) -> DataFrame:
    """Candidates whose label ends in the suffix of their ``position``; confidences stay as they are."""
    suffix = F.create_map(*(F.lit(x) for pair in suffixes.items() for x in pair))[F.col("position")]
    return _kept(candidates, keys, F.endswith("label", F.concat(F.lit("_"), suffix)))


def by_dots(candidates: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Where dots are seen, candidates that expect just these or nothing known."""
    rows = _with_expected(candidates, labels)
    fits = F.col("exp_above").isNull() | ((F.col("exp_above") == F.col("above")) & (F.col("exp_below") == F.col("below")))
    return _kept(rows, keys, (F.col("above") + F.col("below") == 0) | fits).drop("base", "exp_above", "exp_below")


def filtered_reranked(candidates: DataFrame, labels: DataFrame, keys: list[str], suffixes: dict[str, str], boost: float = 0.2, penalty: float = 0.0) -> DataFrame:
    """Position filter with fallback, then the dot rerank."""
    return dot_reranked(by_position(candidates, keys, suffixes), labels, keys, boost, penalty)


def position_tags(parts: DataFrame, group: list[str], order: str) -> DataFrame:
    """Adds ``position`` of each part in its group: isolated, initial, medial or final."""
    place, size = F.row_number().over(Window.partitionBy(*group).orderBy(order)), F.count("*").over(Window.partitionBy(*group))
    rows = parts.withColumn("place", place).withColumn("size", size)
    tag = F.when(F.col("size") == 1, "isolated").when(F.col("place") == 1, "initial").when(F.col("place") == F.col("size"), "final").otherwise("medial")
    return rows.withColumn("position", tag).drop("place", "size")


def top_k(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best classes of each row (all, if fewer), by p, ties to the higher class number."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("p"), F.desc("class")))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
