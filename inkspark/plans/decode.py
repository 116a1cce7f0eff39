"""Queries that decode lattices, and the flagship: documents to words to lattices to text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LATIN, Config
from ..operators import corpus as C
from ..operators import decode as D
from . import corpus
from .corpus import BENCH, BIGRAM, FREQ, LATTICE, TOKENS, table

CONFIG = Config(script=LATIN)
WIDTH = CONFIG.beam_width


def _decoded(spark, sf_dir, width):
    rows, bigrams = corpus.lattice(spark, sf_dir)
    out = D.decoded(D.lattices(rows, "word"), "word", D.bigram_dict(bigrams), CONFIG.bigram_miss, width)
    return out.withColumn("score", F.round("score", 6))


def viterbi_decode(spark, sf_dir):
    return _decoded(spark, sf_dir, None)


def beam_decode(spark, sf_dir):
    return _decoded(spark, sf_dir, WIDTH)


def word_bonus(spark, sf_dir) -> dict[str, float]:
    """The bonus of the lexicon's and of the most frequent words: 600,000 words at most, by their two caps."""
    counts = C.word_frequency_top(corpus.doc_tokens(spark, sf_dir), CONFIG.frequency_cap)
    lexicon = corpus.capped_vocabulary(spark, sf_dir).select("word")
    words = lexicon.union(counts.select("word")).distinct().withColumn("conf", F.lit(0.0))
    scored = C.rescored(words, counts, lexicon, CONFIG.lexicon_bonus, CONFIG.frequency_weight)
    return {r["word"]: r["score"] for r in scored.select("word", "score").collect()}


def paw_word_dp(spark, sf_dir):
    """Benchmark items as lines: their words as pieces, decoded and grouped."""
    rows, bigrams = corpus.lattice(spark, sf_dir)
    pieces = D.lattices(rows, "word")
    words = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{CONFIG.script}]+"), F.lit(0))).alias("pos", "word"))
    lines = words.join(pieces, "word").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lattice"))).alias("l"))
    lines = lines.select("item_id", F.transform("l", lambda x: x["lattice"]).alias("pieces"))
    return D.decoded_lines(lines, "item_id", D.bigram_dict(bigrams), CONFIG.bigram_miss, CONFIG.beam_width, CONFIG.max_span, CONFIG.space_penalty, word_bonus(spark, sf_dir))


QUERIES = {f.__name__: f for f in (viterbi_decode, beam_decode, paw_word_dp)}

_MERGED = f"""WITH RECURSIVE {TOKENS}, {FREQ}, {BIGRAM}, {BENCH}, {LATTICE},
mg AS (SELECT word, pos, label, ord, conf / sum(conf) OVER (PARTITION BY word, pos) AS p FROM (SELECT word, pos, label, sum(conf) AS conf, min(ord) AS ord FROM lat GROUP BY ALL)),
cd AS (SELECT *, row_number() OVER (PARTITION BY word, pos ORDER BY p DESC, ord) AS k FROM mg)"""
SQL = {
    "viterbi_decode": f"""{_MERGED}, pa AS (SELECT word, pos, label AS last, label AS path, ln(greatest(p, 1e-9)) AS score, k AS rn FROM cd WHERE pos = 0
    UNION ALL SELECT word, pos, label, path, score, k FROM (SELECT *, row_number() OVER (PARTITION BY word, label ORDER BY score DESC, brn) AS rn FROM (
        SELECT pa.word, cd.pos, label, path || label AS path, score + (ln(greatest(cd.p, 1e-9)) + 0.3 * ln(coalesce(bg.p, 1e-6))) AS score, pa.rn AS brn, cd.k
        FROM pa JOIN cd ON cd.word = pa.word AND cd.pos = pa.pos + 1 LEFT JOIN bg ON prev = last AND next = label)) WHERE rn = 1)
SELECT word, path, round(score, 6) AS score FROM pa WHERE pos = length(word) - 1 QUALIFY row_number() OVER (PARTITION BY word ORDER BY score DESC, rn) = 1""",
    "beam_decode": f"""{_MERGED}, be AS (SELECT word, pos, label AS last, label AS path, ln(greatest(p, 1e-9)) AS score, k AS rn FROM cd WHERE pos = 0
    UNION ALL SELECT word, pos, label, path, score, rn FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY score DESC, brn, k) AS rn FROM (
        SELECT be.word, cd.pos, label, path || label AS path, score + (ln(greatest(cd.p, 1e-9)) + 0.3 * ln(coalesce(bg.p, 1e-6))) AS score, be.rn AS brn, cd.k
        FROM be JOIN cd ON cd.word = be.word AND cd.pos = be.pos + 1 LEFT JOIN bg ON prev = last AND next = label)) WHERE rn <= {WIDTH})
SELECT word, path, round(score, 6) AS score FROM be WHERE pos = length(word) - 1 AND rn = 1""",
}
