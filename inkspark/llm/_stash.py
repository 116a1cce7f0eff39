"""Written tables that cut lineage, in the folder the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.stash import fresh_path, shared_dir

__all__ = ["drop", "fresh_path", "shared_dir", "stash"]


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: later plans start there, and survive the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a stashed table that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
