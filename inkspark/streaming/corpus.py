"""The corpus statistics over streams of text files and pages of images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def text_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Lines of text files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).withColumnRenamed("value", "text")


def word_counts(lines: DataFrame, script: str) -> DataFrame:
    """Running (word, cnt) of a stream of lines; the state is one row a distinct word."""
    words = lines.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{script}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("cnt"))


def run_once(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Take in all files that are there, into the in-memory table ``name``; a restart goes on from the checkpoint."""
    query = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
