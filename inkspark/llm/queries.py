"""The driver's queries over these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, idfiles, langid, licenses, packing, pages, pii, secrets, topk
from ._scan import ordered, rendered
from ._stash import fresh_path
from .simhash import simhash_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_mixing_range_coder(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    idfiles.write_ids(_table(spark, sf_dir, "documents"), path, _tokenizer())
    return idfiles.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.integer_vectors(_table(spark, sf_dir, "embeddings")), "vec_id % 50 = 0")


def op3_license_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(_table(spark, sf_dir, "documents"), ["doc_id"])
    labels = F.array_sort(F.array_union("base_labels", F.expr("filter(matches, m -> m.best).label")))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max("matches.containment"), F.lit(0.0)))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"),
    )


def op4_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.train(docs), ["doc_id"])
    count = "CAST(size(filter(found, x -> x.kind = '{0}')) AS bigint) AS n_{0}".format
    return found.selectExpr(
        "doc_id",
        *map(count, secrets.BASE),
        f"sha2({rendered(ordered('found', secrets.BASE, by_kind=False))}, 256) AS base_sha256",
        f"{rendered(ordered('found', secrets.KINDS, by_kind=False))} AS spans",
    )


def op5_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, model, ["doc_id"]).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op6_mincut_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract(_table(spark, sf_dir, "pages"), ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op8_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"), ["doc_id"])
    count = "CAST(size(filter(found, x -> x.kind = '{0}')) AS bigint) AS n_{0}".format
    return found.selectExpr(
        "doc_id",
        *map(count, pii.BASE),
        f"sha2({rendered(ordered('found', pii.BASE, by_kind=True))}, 256) AS base_sha256",
        f"{rendered(ordered('found', pii.KINDS, by_kind=True))} AS spans",
    )


def op9_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(_table(spark, sf_dir, "documents"), _tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing_range_coder": op1_mixing_range_coder,
    "op2_threshold_topk": op2_threshold_topk,
    "op3_license_set_join": op3_license_set_join,
    "op4_markov_secrets": op4_markov_secrets,
    "op5_ppm_language": op5_ppm_language,
    "op6_mincut_pages": op6_mincut_pages,
    "op7_simhash_anchors": op7_simhash_anchors,
    "op8_deobfuscated_pii": op8_deobfuscated_pii,
    "op9_tournament_packing": op9_tournament_packing,
    "op10_minhash_containment": op10_minhash_containment,
}
ORACLE_SQL: dict[str, str] = {
    "op2_threshold_topk": topk.ORACLE_SQL,
    "op10_minhash_containment": decontaminate.ORACLE_SQL,
}
