"""Sources and sinks: page images, labelled image trees, corpora, lexicons, statistics and recognised text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..kernels import png

# File name endings of page images.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "tiff")
BOM = "﻿"
PAGE = "page string, height int, width int, channels int, data binary"


def _images(spark: SparkSession, path: str, strict: bool) -> DataFrame:
    rows = spark.read.format("image").option("dropInvalid", str(not strict).lower()).load(path).select("image.*")
    rows = rows.where(F.lower(F.regexp_extract("origin", r"\.([^./]+)$", 1)).isin(*IMAGE_SUFFIXES))
    checked = F.when(F.col("height") < 0, F.raise_error(F.concat(F.lit("not an image: "), "origin"))).otherwise(F.col("data"))
    return rows.select(F.col("origin").alias("page"), "height", "width", F.col("nChannels").alias("channels"), checked.alias("data"))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """(page, height, width, channels, data) of the images of a folder (not below it); BGR by rows.

    An image that can't be decoded is an error, as a page must not vanish silently. Rows come as the files lie: what is
    written or shown is put in the pages' order there, so that pixels are never sorted.
    """
    return _images(spark, path, strict=True)


def labelled_images(spark: SparkSession, path: str, synonyms: dict[str, str] | None = None, need: bool = False) -> DataFrame:
    """Images of a tree with the folder's name as label, synonyms merged; files that are no images are passed over.

    With ``need``, a tree without any image is an error.
    """
    rows = _images(spark, f"{path}/*", strict=False).withColumn("label", F.regexp_extract("page", "([^/]+)/[^/]+$", 1))
    if synonyms:
        merged = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
        rows = rows.withColumn("label", F.coalesce(F.try_element_at(merged, F.col("label")), F.col("label")))
    if need and rows.select("label").isEmpty():
        raise FileNotFoundError(f"no labelled images under {path}")
    return rows


def write_files(files: DataFrame, path: str) -> int:
    """Write rows (name, content) as files of a folder that all executors reach; the number of files.

    Each file is written beside its place and then moved there, so it is whole or absent, and a repeated task writes the
    same once more. The folder may be of any file system that Arrow knows by its URI.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/.{name}.part") as out:
                    out.write(content)
                store.move(f"{base}/.{name}.part", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "n long")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def as_png(pages: DataFrame, name: str = "page") -> DataFrame:
    """(name, content) of gray or BGR images: PNG files named by the images' stems."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            data = [png.encode(d, h, w, c) for d, h, w, c in zip(frame["data"], frame["height"], frame["width"], frame["channels"], strict=True)]
            yield pd.DataFrame({"name": frame["stem"] + ".png", "content": data})

    rows = pages.select(stem(F.col(name)).alias("stem"), "height", "width", "channels", "data")
    return rows.mapInPandas(run, "name string, content binary")


def save_images(pages: DataFrame, path: str) -> int:
    """One PNG file a page under ``path``; the number of files."""
    return write_files(as_png(pages), path)


def stem(path: F.Column) -> F.Column:
    """A path's last part without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def corpus_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of the lines of text files, compressed or not; malformed bytes become replacement characters."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    return rows.select(F.monotonically_increasing_id().alias("doc_id"), F.col("value").alias("text"))


def dump_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, line) of markup dumps, compressed or not: n orders the lines of a block, the split of the file that
    starts at byte ``block``. A dump of any size is read split by split, line by line."""
    rows = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    return rows.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a file with one a line; blanks are dropped."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def with_words(lexicon: DataFrame, words: DataFrame) -> DataFrame:
    """The distinct words (word) of a lexicon and of a further list."""
    return lexicon.select("word").union(words.select("word")).distinct()


def write_statistics(table: DataFrame, path: str) -> None:
    """A bigram, frequency, lexicon or feature table as Parquet."""
    table.write.mode("overwrite").parquet(path)


def write_features(rows: DataFrame, path: str) -> None:
    """(label, features) of labelled glyphs, as Parquet."""
    write_statistics(rows.select("label", F.col("features").cast("array<float>").alias("features")), path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A written table, or an empty one where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def bigrams_to_json(bigrams: DataFrame) -> DataFrame:
    """One row of JSON {prev: {next: p}}; pairs of characters of one script, so its size is bounded."""
    inner = bigrams.groupBy("prev").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("next", "p")))).alias("m"))
    return inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("prev", "m")))).alias("json"))


def bigrams_from_json(rows: DataFrame) -> DataFrame:
    """(prev, next, p) of rows of such JSON."""
    parsed = rows.select(F.explode(F.from_json("json", "map<string, map<string, double>>")).alias("prev", "m"))
    return parsed.select("prev", F.explode("m").alias("next", "p"))


def frequencies_from_json(rows: DataFrame) -> DataFrame:
    """(word, cnt) of rows of JSON {word: count}; a row that isn't such JSON gives none."""
    return rows.select(F.explode(F.from_json("json", "map<string, bigint>")).alias("word", "cnt"))


def text_documents(lines: DataFrame, page: str = "page", order: str = "line", text: str = "text", output: str | None = None) -> DataFrame:
    """(name, content): a page's lines in order behind a byte-order mark, with a final line feed if there is any text.

    Files are named by the pages' stems, or ``output`` where the lines are of one page.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    name = F.concat(stem(F.col(page)), F.lit(".txt")) if output is None else F.lit(output)
    pages = lines.groupBy(page).agg(body.alias("body"))
    return pages.select(name.alias("name"), F.concat(F.lit(BOM), "body", F.when(F.col("body") != "", "\n").otherwise("")).alias("content"))


def write_text(documents: DataFrame, path: str) -> int:
    """One UTF-8 file per row (name, content) under ``path``; the number of files."""
    return write_files(documents, path)


def numbered(lines: DataFrame, page: str) -> DataFrame:
    """Lines with their place on the page, from y1."""
    return lines.withColumn("line", F.row_number().over(Window.partitionBy(page).orderBy("y1")) - 1)
