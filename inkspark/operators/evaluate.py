"""Evaluation: confusion counts, reports, splits and parameter grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classification_report(rows: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """``(class, support, precision, recall, f1)``; a ratio over nothing is 0."""
    confusion = rows.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    sides = confusion.select(F.col("t").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("right"))
    said = confusion.select(F.col("g").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("right"))
    sums = sides.unionByName(said).groupBy("class").agg(*(F.sum(c).cast("long").alias(c) for c in ("support", "said", "right")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall = ratio(F.col("right"), F.col("said")), ratio(F.col("right"), F.col("support"))
    return sums.select("class", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def stratified_split(rows: DataFrame, label: str, order: str, test_share: float) -> DataFrame:
    """Adds ``is_test``: the first ``test_share`` of each label's rows by ``order``."""
    rank = F.percent_rank().over(Window.partitionBy(label).orderBy(order))
    return rows.withColumn("is_test", rank < test_share)


def grid(frame: DataFrame, values: dict[str, list[float]]) -> DataFrame:
    """frame with one row for each combination of the values; the grid is a few fixed rows, so it is broadcast."""
    spark = frame.sparkSession
    parts = [spark.createDataFrame([(float(v),) for v in vs], f"{name} double") for name, vs in values.items()]
    return frame.crossJoin(F.broadcast(reduce(DataFrame.crossJoin, parts)))
