"""The training-data pipeline: language ID, near-dedup, benchmark decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of docs, whatever their names. Rows are documents: a repeated doc_id
with another text is a document of its own, and rows without a doc_id pass like any others. An empty table passes every
stage as such.
"""

from __future__ import annotations

import public_tokenizers
from inkspark.llm import decontaminate, langid, packing, secrets, simhash
from inkspark.llm._stash import drop, stash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys (17 bytes each) of dropped rows that may be broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000
#: What tells documents apart: doc_id, null or not, and the text's hash. The names are ours alone.
KEY = ["__no_id", "__id", "__mark"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with the columns of KEY; fingerprint rows bring their text's hash as ``mark``."""
    mark = F.col("mark") if "mark" in docs.columns and "text" not in docs.columns else F.xxhash64(F.col("text").cast("string"))
    return docs.withColumns({"__no_id": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__mark": mark})


def without(docs: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """docs but the rows whose keys occur in ``dropped``."""
    dropped = stash(dropped.select(keys).distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_KEYS else dropped, keys, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go (null and empty texts among them), and those whose text is foreign to all learned
    languages by its code length; a missing label is filled with the prediction. Without any label nothing is learned, and
    all documents stay."""
    model = langid.train(docs)
    if not model.langs:
        return docs
    names = ("__lang", "__score", "__fits")
    told = langid.identify(docs, model, names=names).where("__fits")
    return told.withColumn("lang", F.coalesce("lang", "__lang")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the smallest doc_id (a null one last), of equal ids the least text hash; of rows
    with equal doc_id and text one stays. Texts without words are one group."""
    rows = stash(keyed(simhash.simhash_classes(docs)).select("root", F.struct(*KEY).alias("key")), "classes")
    first = stash(rows.groupBy("root").agg(F.min("key").alias("first")), "first")
    told = rows.join(first.hint("merge"), "root")
    kept = without(keyed(docs), told.where("key <> first").select("key.*"), KEY)
    twice = stash(told.where("key = first").groupBy("key").count().where("count > 1").select("key.*"), "twice")
    if not twice.isEmpty():
        kept = kept.join(twice, KEY, "left_anti").unionByName(kept.join(twice, KEY, "left_semi").dropDuplicates(KEY))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts and items hold nothing."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = docs.withColumn("__key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").cast("string")))
    found = decontaminate.contained_items(rows, items, id_col="__key")
    return without(rows, found.select(F.col("doc_id").alias("__key")), ["__key"]).select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and n_chars follows; all documents stay, null and empty texts as they are."""
    clean = secrets.redact(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids; each row is packed once, a null text as its end id."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("packing", pack),
]
#: Trained models and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
