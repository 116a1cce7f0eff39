"""Queries over corpus statistics, search and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN, Config
from ..functions import text as X
from ..operators import corpus as C

CONFIG = Config(script=LATIN)
TOP_WORDS = 100
#: A word is in the test lexicon if it occurs so often.
LEXICON_COUNT = 5
SKIP = r"^\s*[|{}\[\]#*]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(table(spark, sf_dir, "documents"), CONFIG.script)


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tokens(table(spark, sf_dir, "benchmark"), CONFIG.script, "item_id").select("word").distinct()


def frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(doc_tokens(spark, sf_dir)).select("word", "cnt")


def lattice(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (word, pos, ord, prev, label, conf) of the benchmark's words, and the bigrams.

    A position has its true character (.5), and the three likeliest successors of the character before (.5 in all).
    """
    bigrams = C.bigrams_within_words(doc_tokens(spark, sf_dir)).select("prev", "next", "p")
    words = benchmark_words(spark, sf_dir)
    places = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "label")).where("label <> ''")
    places = places.withColumn("prev", F.expr("IF(pos = 0, NULL, substring(word, pos, 1))"))
    true = places.select("word", "pos", F.lit(0).alias("ord"), "prev", "label", F.lit(0.5).alias("conf"))
    best = bigrams.withColumn("ord", F.expr("row_number() OVER (PARTITION BY prev ORDER BY p DESC, next)")).where("ord <= 3")
    best = best.withColumn("share", F.expr("0.5 * p / sum(p) OVER (PARTITION BY prev)"))
    near = places.select("word", "pos", "prev").join(F.broadcast(best), "prev")  # three rows a character of the script
    near = near.select("word", "pos", "ord", "prev", F.col("next").alias("label"), F.col("share").alias("conf"))
    return true.unionByName(near), bigrams


def word_freq_topn(spark, sf_dir):
    return C.word_frequency_top(doc_tokens(spark, sf_dir), TOP_WORDS)


def char_bigram_within_word(spark, sf_dir):
    return C.bigrams_within_words(doc_tokens(spark, sf_dir)).withColumn("p", F.round("p", 6))


def char_bigram_cross_word(spark, sf_dir):
    return C.bigrams_across_words(table(spark, sf_dir, "documents"), CONFIG.script).withColumn("p", F.round("p", 6))


def capped_vocabulary(spark, sf_dir):
    return C.capped_vocabulary(doc_tokens(spark, sf_dir), CONFIG.lexicon_cap).select("word", F.col("first_place.id").alias("first_doc"), F.col("first_place.pos").alias("first_pos"))


def markup_stream_tokens(spark, sf_dir):
    lines = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.expr(r"split(replace(html, '<', '\u0001<'), '\u0001')")).alias("n", "line"))
    inside = C.marked_lines(lines, "page_id", "n", "line", "<body", "</body>").where(~F.col("line").rlike(SKIP))
    size = F.size(F.regexp_extract_all("line", F.lit(f"[{CONFIG.script}]+"), F.lit(0)))
    return inside.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.sum(size).cast("long").alias("n_tokens"))


def lexicon_prefix_search(spark, sf_dir):
    return C.prefix_search(doc_tokens(spark, sf_dir).select("word").distinct(), benchmark_words(spark, sf_dir).withColumnRenamed("word", "prefix"))


def lexicon_membership(spark, sf_dir):
    return C.in_lexicon(benchmark_words(spark, sf_dir), frequency(spark, sf_dir).where(F.col("cnt") >= LEXICON_COUNT)).select("word", "in_lexicon")


def word_rescore(spark, sf_dir):
    known = frequency(spark, sf_dir)
    words = benchmark_words(spark, sf_dir).withColumn("conf", F.lit(0.5))
    out = C.rescored(words, known, known.where(F.col("cnt") >= LEXICON_COUNT), CONFIG.lexicon_bonus, CONFIG.frequency_weight)
    return out.select("word", "f", F.round("score", 6).alias("score"))


def bigram_sequence_score(spark, sf_dir):
    out = C.sequence_scores(benchmark_words(spark, sf_dir), C.bigrams_within_words(doc_tokens(spark, sf_dir)), CONFIG.bigram_miss)
    return out.withColumn("score", F.round("score", 6))


def rescore_candidates(spark, sf_dir):
    out = C.candidates_rescored(*lattice(spark, sf_dir), CONFIG.bigram_miss)
    return out.select("word", "pos", "ord", "label", F.round("score", 6).alias("score"))


def strip_marks_nfc(spark, sf_dir):
    mixed = F.concat("text", F.lit("é لًا"))
    clean = table(spark, sf_dir, "documents").select("doc_id", X.nfc(X.strip_marks(mixed)).alias("clean"))
    return clean.select("doc_id", F.length("clean").cast("long").alias("n"), F.md5("clean").alias("digest"))


def non_script_rate(spark, sf_dir):
    n = X.non_script_count(F.col("text"), CONFIG.script)
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(n).cast("long").alias("n_other"), F.sum(F.length("text")).cast("long").alias("n_all"))
    return out.withColumn("rate", F.round(F.try_divide("n_other", "n_all"), 6))


def edit_distance_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    after = items.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    pair = items.join(after, "item_id")
    return pair.select("item_id", F.levenshtein("text", "other").cast("long").alias("distance"), F.round(X.relative_change(F.col("text"), F.col("other")), 6).alias("change"))


#: The SQL engine's distance counts bytes, so letters beyond ASCII become single bytes that no text holds.
_ONE_BYTE = dict(zip("äöüßéèêëçàâîôûùñíóúáÄÖÜÉÈÊÇÑ", (c for c in range(1, 32) if c not in (9, 10, 13)), strict=True))
_AS_BYTES = f"translate(text, '{''.join(_ONE_BYTE)}', {' || '.join(f'chr({c})' for c in _ONE_BYTE.values())})"


QUERIES = {f.__name__: f for f in (word_freq_topn, char_bigram_within_word, char_bigram_cross_word, capped_vocabulary, markup_stream_tokens, lexicon_prefix_search, lexicon_membership, word_rescore, bigram_sequence_score, rescore_candidates, strip_marks_nfc, non_script_rate, edit_distance_pairs)}

TOKENS = f"""tok AS (SELECT word, (doc_id << 32) + pos - 1 AS place FROM (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[{LATIN}]+') AS w FROM documents)))"""
BENCH = f"bw AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{LATIN}]+')) AS word FROM benchmark)"
FREQ = "freq AS (SELECT word, count(*) AS cnt FROM tok GROUP BY word)"
BIGRAM = """pr AS (SELECT substring(word, i, 1) AS prev, substring(word, i + 1, 1) AS next, cnt
    FROM (SELECT word, cnt, unnest(range(1, length(word))) AS i FROM freq WHERE length(word) >= 2)),
bg AS (SELECT prev, next, CAST(sum(cnt) AS BIGINT) AS cnt, sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY prev) AS p FROM pr GROUP BY prev, next)"""
LATTICE = """pl AS (SELECT word, i - 1 AS pos, substring(word, i, 1) AS label, CASE WHEN i > 1 THEN substring(word, i - 1, 1) END AS prev
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM bw)),
best AS (SELECT *, 0.5 * p / sum(p) OVER (PARTITION BY prev) AS share FROM (
    SELECT prev, next, p, row_number() OVER (PARTITION BY prev ORDER BY p DESC, next) AS ord FROM bg) WHERE ord <= 3),
lat AS (SELECT word, pos, 0 AS ord, prev, label, 0.5::DOUBLE AS conf FROM pl
    UNION ALL SELECT word, pos, ord, pl.prev, next, share FROM pl JOIN best ON pl.prev = best.prev)"""
SQL = {
    "word_freq_topn": f"WITH {TOKENS} SELECT word, count(*) AS cnt FROM tok GROUP BY word ORDER BY cnt DESC, min(place) LIMIT {TOP_WORDS}",
    "char_bigram_within_word": f"WITH {TOKENS}, {FREQ}, {BIGRAM} SELECT prev, next, cnt, round(p, 6) AS p FROM bg",
    "char_bigram_cross_word": f"""WITH k AS (SELECT regexp_replace(text, '[^{LATIN}]', '', 'g') AS s FROM documents WHERE text IS NOT NULL),
pr AS (SELECT substring(s, i, 1) AS prev, substring(s, i + 1, 1) AS next FROM (SELECT s, unnest(range(1, length(s))) AS i FROM k))
SELECT prev, next, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (PARTITION BY prev), 6) AS p FROM pr GROUP BY prev, next""",
    "capped_vocabulary": f"""WITH {TOKENS} SELECT word, CAST(p >> 32 AS BIGINT) AS first_doc, CAST(p & 4294967295 AS INTEGER) AS first_pos
FROM (SELECT word, min(place) AS p FROM tok WHERE length(word) >= 2 GROUP BY word ORDER BY p LIMIT {CONFIG.lexicon_cap})""",
    "markup_stream_tokens": rf"""WITH l AS (SELECT page_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT page_id, string_split(replace(html, '<', chr(1) || '<'), chr(1)) AS s FROM pages)),
f AS (SELECT *, max(CASE WHEN contains(line, '<body') THEN n END) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS o,
    max(CASE WHEN contains(line, '</body>') THEN n END) OVER (PARTITION BY page_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM l)
SELECT page_id, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(line, '[{LATIN}]+'))) AS BIGINT) AS n_tokens FROM f
WHERE o IS NOT NULL AND (c IS NULL OR o > c) AND NOT regexp_matches(line, '{SKIP}') GROUP BY page_id""",
    "lexicon_prefix_search": f"WITH {TOKENS}, {FREQ}, {BENCH} SELECT bw.word AS prefix, freq.word FROM bw JOIN freq ON starts_with(freq.word, bw.word)",
    "lexicon_membership": f"WITH {TOKENS}, {FREQ}, {BENCH} SELECT word, word IN (SELECT word FROM freq WHERE cnt >= {LEXICON_COUNT}) AS in_lexicon FROM bw",
    "word_rescore": f"""WITH {TOKENS}, {FREQ}, {BENCH} SELECT bw.word, coalesce(cnt, 0) AS f,
round(0.5 + CASE WHEN coalesce(cnt, 0) >= {LEXICON_COUNT} THEN 0.25 ELSE 0 END + 15 * ln(coalesce(cnt, 0) + 1) / ln((SELECT max(cnt) FROM freq) + 1), 6) AS score
FROM bw LEFT JOIN freq ON bw.word = freq.word""",
    "bigram_sequence_score": f"""WITH {TOKENS}, {FREQ}, {BIGRAM}, {BENCH},
p2 AS (SELECT word, substring(word, i, 1) AS a, substring(word, i + 1, 1) AS b FROM (SELECT word, unnest(range(1, length(word))) AS i FROM bw))
SELECT bw.word, round(coalesce(sum(ln(coalesce(p, 1e-6))) FILTER (WHERE a IS NOT NULL), 0), 6) AS score
FROM bw LEFT JOIN p2 ON bw.word = p2.word LEFT JOIN bg ON a = prev AND b = next GROUP BY bw.word""",
    "rescore_candidates": f"""WITH {TOKENS}, {FREQ}, {BIGRAM}, {BENCH}, {LATTICE}
SELECT word, pos, ord, label, round(CASE WHEN lat.prev IS NULL THEN conf ELSE 0.7 * conf + 0.3 * coalesce(p, 1e-6) END, 6) AS score
FROM lat LEFT JOIN bg ON lat.prev = bg.prev AND label = next""",
    "strip_marks_nfc": r"""SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (
SELECT doc_id, nfc_normalize(regexp_replace(text || chr(101) || chr(769) || ' ' || chr(1604) || chr(1611) || chr(1575), '[\x{064b}-\x{065f}]', '', 'g')) AS c FROM documents)""",
    "non_script_rate": rf"""SELECT source, n_other, n_all, round(n_other / n_all, 6) AS rate FROM (
SELECT source, CAST(sum(length(regexp_replace(text, '[{LATIN}\s]', '', 'g'))) AS BIGINT) AS n_other, CAST(sum(length(text)) AS BIGINT) AS n_all FROM documents GROUP BY source)""",
    "edit_distance_pairs": f"""WITH b AS (SELECT item_id, {_AS_BYTES} AS text FROM benchmark) SELECT a.item_id, levenshtein(a.text, b.text) AS distance, round(levenshtein(a.text, b.text) / greatest(1, length(a.text), length(b.text)), 6) AS change
FROM b AS a JOIN b ON b.item_id = a.item_id + 1""",
}
