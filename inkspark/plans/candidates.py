"""Queries over candidate lists, and the fixture-level classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.labels import POSITIONS, body_dim, body_rows, label_dim, label_rows
from ..operators import candidates as K
from ..operators import evaluate as E
from . import corpus
from .corpus import BENCH, BIGRAM, FREQ, LATTICE, TOKENS, table

CONFIG = Config()
KEYS = ["word", "pos"]
#: Labels that the dimension doesn't know.
STRANGE = ["Unknown_Start", "Unknown", "بـ"]
WEIGHTS, INTERCEPT = [2.0, -0.3, 0.2, 0.25, -0.15, 0.4, 0.05], -0.7
BOOSTS, PENALTIES = [0.0, 0.1, 0.2, 0.3], [0.0, 0.1]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice with labels, seen dots and position tags that follow from its characters by arithmetic."""
    rows, _ = corpus.lattice(spark, sf_dir)
    names = label_rows()
    every = [r[1] for r in names] + STRANGE
    numbered = spark.createDataFrame(list(enumerate(every)), "idx int, name string")
    code = F.ascii("label")
    rows = rows.withColumn("idx", ((code * 31 + F.col("ord") * 7 + F.col("pos")) % len(every)).cast("int"))
    rows = rows.join(F.broadcast(numbered), "idx")
    last = F.length("word") - 1
    tag = F.when(F.col("pos") == 0, "initial").when(F.col("pos") == last, "final").otherwise("medial")
    return rows.select(*KEYS, "ord", "conf", F.col("name").alias("label"), (F.length("word") % 4).alias("above"), (F.col("pos") % 2).alias("below"), tag.alias("position"), (F.col("pos") * 0.5).alias("spread"))


def label_unicode_lookup(spark, sf_dir):
    return K.with_glyphs(labelled(spark, sf_dir).select("label").distinct(), label_dim(spark), CONFIG.script)


def merge_candidates(spark, sf_dir):
    rows = K.with_glyphs(labelled(spark, sf_dir), label_dim(spark), CONFIG.script)
    return K.merged(rows, KEYS).select(*KEYS, "glyph", F.round("p", 6).alias("p"))


def dot_rerank(spark, sf_dir):
    out = K.dot_reranked(labelled(spark, sf_dir), label_dim(spark), KEYS, CONFIG.match_boost, CONFIG.mismatch_penalty)
    return out.select(*KEYS, "ord", "label", F.round("p", 6).alias("p"))


def position_filter_fallback(spark, sf_dir):
    return K.by_position(labelled(spark, sf_dir), KEYS, POSITIONS).select(*KEYS, "ord", "label", F.round("conf", 6).alias("conf"))


def dot_filter_fallback(spark, sf_dir):
    return K.by_dots(labelled(spark, sf_dir), label_dim(spark), KEYS).select(*KEYS, "ord", "label", F.round("conf", 6).alias("conf"))


def filter_rerank_fallback(spark, sf_dir):
    out = K.filtered_reranked(labelled(spark, sf_dir), label_dim(spark), KEYS, POSITIONS, CONFIG.filter_boost, CONFIG.filter_penalty)
    return out.select(*KEYS, "ord", "label", F.round("p", 6).alias("p"))


def learned_rerank_fixed_weights(spark, sf_dir):
    out = K.model_reranked(labelled(spark, sf_dir), label_dim(spark), KEYS, WEIGHTS, INTERCEPT)
    return out.select(*KEYS, "ord", "label", F.round("p", 6).alias("p"))


def position_tags(spark, sf_dir):
    words = corpus.benchmark_words(spark, sf_dir)
    parts = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "part")).where("part <> ''")
    return K.position_tags(parts, ["word"], "pos").select("word", "pos", "position")


def body_letters(spark, sf_dir):
    """Letters of dotless bodies by observed dots, over a grid of observations."""
    bodies = body_dim(spark)
    seen = bodies.select("body").distinct().crossJoin(spark.range(4).select(F.col("id").cast("int").alias("above"))).crossJoin(spark.range(3).select(F.col("id").cast("int").alias("below")))
    return seen.join(F.broadcast(bodies), ["body", "above", "below"], "left")


def hyperparameter_grid(spark, sf_dir):
    """Per boost and penalty, in how many positions the dot rerank puts another candidate first."""
    rows = labelled(spark, sf_dir).join(F.broadcast(label_dim(spark).select("label", "exp_above", "exp_below")), "label", "left")
    rows = E.grid(rows, {"boost": BOOSTS, "penalty": PENALTIES})
    match = (F.col("exp_above") == F.col("above")) & (F.col("exp_below") == F.col("below"))
    score = F.when(match, F.col("conf") + F.col("boost")).when(F.col("exp_above").isNotNull(), F.greatest(F.lit(0.0), F.col("conf") - F.col("penalty"))).otherwise(F.col("conf"))
    keys = [*KEYS, "boost", "penalty"]
    best = rows.groupBy(*keys).agg(F.max(F.struct(score.alias("s"), (-F.col("ord")).alias("o"))).alias("best"), F.max(F.struct("conf", (-F.col("ord")).alias("o"))).alias("before"))
    return best.groupBy("boost", "penalty").agg(F.count("*").alias("n"), F.sum((F.col("best.o") != F.col("before.o")).cast("int")).cast("long").alias("changed"))


WEIGHTS_GRID, LEXICON_GRID = [0.0, 0.1, 0.2, 0.3, 0.5], [0.0, 0.25, 0.5]


def tune_lm_grid(spark, sf_dir):
    """Per bigram weight and lexicon bonus: places whose best candidate changes, words read that the lexicon knows, and the
    order of the settings: fewest changes, then most bonus, then the weight nearest to .3."""
    rows, bigrams = corpus.lattice(spark, sf_dir)
    p = bigrams.select("prev", F.col("next").alias("label"), "p")
    found = E.grid(rows.join(p, ["prev", "label"], "left"), {"weight": WEIGHTS_GRID})
    score = F.when(F.col("prev").isNull(), F.col("conf")).otherwise((1 - F.col("weight")) * F.col("conf") + F.col("weight") * F.coalesce("p", F.lit(CONFIG.bigram_miss)))
    best = found.groupBy("word", "pos", "weight").agg(F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("ord")).alias("o"), "label")).alias("b"))
    read = best.groupBy("word", "weight").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b.label"))), lambda x: x["label"]), "").alias("read"), F.sum((F.col("b.o") != 0).cast("int")).cast("long").alias("changed"))
    lexicon = corpus.frequency(spark, sf_dir).where(F.col("cnt") >= corpus.LEXICON_COUNT).select(F.col("word").alias("read"), F.lit(1).alias("known"))
    sums = read.join(lexicon, "read", "left").groupBy("weight").agg(F.sum("changed").alias("changed"), F.count("known").alias("known"))
    points = E.grid(sums, {"bonus": LEXICON_GRID}).withColumn("total", F.col("bonus") * F.col("known"))
    order = F.row_number().over(Window.orderBy("changed", F.desc("total"), F.round(F.abs(F.col("weight") - 0.3), 6), "weight", "bonus"))  # 15 points
    return points.select("weight", "bonus", "changed", "known", order.alias("rank"))


def centroid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, scores): softmax of minus the distance to each label's mean vector, a stand-in for a trained classifier.

    Means are one small row a label; vectors meet them as one broadcast array and are never shuffled.
    """
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    means = rows.select("label", F.posexplode("e").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])
    every = means.groupBy("label").agg(centre.alias("m")).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("class"), "m"))).alias("means"))
    far = lambda c: F.sqrt(F.aggregate(F.zip_with("e", c["m"], lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda s, d: s + d))
    scored = rows.crossJoin(F.broadcast(every)).select("vec_id", "label", F.transform("means", lambda c: F.struct(F.exp(-far(c)).alias("w"), c["class"].alias("class"))).alias("ws"))  # one row of means
    whole = F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"])
    return scored.withColumn("whole", whole).select("vec_id", "label", F.transform("ws", lambda x: F.struct((x["w"] / F.col("whole")).alias("p"), x["class"].alias("class"))).alias("scores"))


def best_classes(scores: DataFrame, k: int) -> DataFrame:
    """(vec_id, label, rank, class, p): the k best classes of each row, found in the row; ties to the higher class."""
    best = scores.select("vec_id", "label", F.posexplode(F.slice(F.sort_array("scores", asc=False), 1, k)).alias("place", "c"))
    return best.select("vec_id", "label", (F.col("place") + 1).alias("rank"), "c.class", "c.p")


def topk_centroid_classifier(spark, sf_dir):
    return best_classes(centroid_scores(spark, sf_dir), CONFIG.top_k).select("vec_id", "rank", "class", F.round("p", 6).alias("p"))


def classification_report(spark, sf_dir):
    best = best_classes(centroid_scores(spark, sf_dir), 1).withColumnRenamed("class", "pred")
    return E.classification_report(best).select("class", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def stratified_split(spark, sf_dir):
    return E.stratified_split(table(spark, sf_dir, "embeddings"), "label", "vec_id", 0.15).select("vec_id", "label", "is_test")


QUERIES = {f.__name__: f for f in (label_unicode_lookup, merge_candidates, dot_rerank, position_filter_fallback, dot_filter_fallback, filter_rerank_fallback, learned_rerank_fixed_weights, position_tags, body_letters, hyperparameter_grid, tune_lm_grid, topk_centroid_classifier, classification_report, stratified_split)}


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


_EVERY = [(k, name) for k, name in enumerate([r[1] for r in label_rows()] + STRANGE)]
DIM = f"dim(idx, label, base, tag, glyph, ea, eb) AS ({_values(label_rows())}), names(idx, name) AS ({_values(_EVERY)}), bdots AS (SELECT DISTINCT base, ea, eb FROM dim)"
LAB = f"""WITH {TOKENS}, {FREQ}, {BIGRAM}, {BENCH}, {LATTICE}, {DIM},
lab AS (SELECT word, pos, ord, conf, name AS label, length(word) % 4 AS above, pos % 2 AS below, pos * 0.5 AS spread,
    CASE WHEN pos = 0 THEN 'initial' WHEN pos = length(word) - 1 THEN 'final' ELSE 'medial' END AS position
    FROM lat JOIN names ON idx = (unicode(lat.label) * 31 + ord * 7 + pos) % {len(_EVERY)}),
exd AS (SELECT lab.*, ea, eb FROM lab LEFT JOIN bdots ON base = regexp_replace(label, '_[^_]*$', ''))"""
_GLYPH = f"CASE WHEN regexp_matches(lab.label, '^[{CONFIG.script}]+$') THEN replace(lab.label, 'ـ', '') ELSE coalesce(dim.glyph, '_') END"
_SUFFIX = "CASE position WHEN 'initial' THEN '_Start' WHEN 'medial' THEN '_Middle' WHEN 'final' THEN '_End' ELSE '_Isolated' END"
_RERANK = "CASE WHEN ea = above AND eb = below THEN conf + {0} WHEN ea IS NOT NULL THEN greatest(0.0, conf - {1}) ELSE conf END"


def _shared(score: str, source: str) -> str:
    return f"SELECT word, pos, ord, label, round(s / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS p FROM (SELECT *, sum(s) OVER (PARTITION BY word, pos) AS t FROM (SELECT *, {score} AS s FROM {source}))"


_CENTROID = """WITH c AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label AS class, i, avg(x) AS m FROM c GROUP BY label, i),
d AS (SELECT vec_id, label, class, sqrt(sum((x - m) * (x - m))) AS d FROM c JOIN m USING (i) GROUP BY vec_id, label, class),
sc AS (SELECT vec_id, label, class, exp(-d) / sum(exp(-d)) OVER (PARTITION BY vec_id) AS p FROM d),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class DESC) AS INTEGER) AS rank FROM sc)"""
SQL = {
    "body_letters": f"""WITH b(body, above, below, letter) AS ({_values(body_rows())}), s AS (SELECT body, above, below FROM (SELECT DISTINCT body FROM b), range(4) a(above), range(3) c(below))
SELECT s.body, CAST(s.above AS INTEGER) AS above, CAST(s.below AS INTEGER) AS below, letter FROM s LEFT JOIN b ON b.body = s.body AND b.above = s.above AND b.below = s.below""",
    "label_unicode_lookup": f"{LAB} SELECT DISTINCT lab.label, {_GLYPH} AS glyph FROM lab LEFT JOIN dim ON lab.label = dim.label",
    "merge_candidates": f"""{LAB}, g AS (SELECT word, pos, conf, {_GLYPH} AS glyph FROM lab LEFT JOIN dim ON lab.label = dim.label),
s AS (SELECT word, pos, glyph, sum(conf) AS conf FROM g WHERE glyph <> '_' GROUP BY ALL), t AS (SELECT *, sum(conf) OVER (PARTITION BY word, pos) AS total FROM s)
SELECT p.word, p.pos, coalesce(glyph, '_') AS glyph, round(coalesce(conf / total, 1), 6) AS p FROM (SELECT DISTINCT word, pos FROM g) p
LEFT JOIN (SELECT * FROM t WHERE total > 0) t ON p.word = t.word AND p.pos = t.pos""",
    "dot_rerank": f"{LAB} {_shared(_RERANK.format(0.2, 0.1), 'exd')}",
    "position_filter_fallback": f"""{LAB} SELECT word, pos, ord, label, round(conf, 6) AS conf FROM (
SELECT *, ends_with(label, {_SUFFIX}) AS ok, bool_or(ends_with(label, {_SUFFIX})) OVER (PARTITION BY word, pos) AS hit FROM lab) WHERE ok OR NOT hit""",
    "dot_filter_fallback": f"""{LAB}, f AS (SELECT *, above + below = 0 OR ea IS NULL OR (ea = above AND eb = below) AS ok FROM exd)
SELECT word, pos, ord, label, round(conf, 6) AS conf FROM (SELECT *, bool_or(ok) OVER (PARTITION BY word, pos) AS hit FROM f) WHERE ok OR NOT hit""",
    "filter_rerank_fallback": f"""{LAB}, f AS (SELECT * FROM (SELECT *, ends_with(label, {_SUFFIX}) AS ok, bool_or(ends_with(label, {_SUFFIX})) OVER (PARTITION BY word, pos) AS hit FROM exd)
WHERE ok OR NOT hit) {_shared(_RERANK.format(0.2, 0.0), 'f')}""",
    "learned_rerank_fixed_weights": f"""{LAB} {_shared(f"0.6 * conf + 0.4 / (1 + exp(-({INTERCEPT} + {WEIGHTS[0]} * conf + {WEIGHTS[1]} * coalesce(ea, 0) + {WEIGHTS[2]} * coalesce(eb, 0) + {WEIGHTS[3]} * above + {WEIGHTS[4]} * below + {WEIGHTS[5]} * CASE WHEN above + below > 0 THEN 1 ELSE 0 END + {WEIGHTS[6]} * spread)))", 'exd')}""",
    "position_tags": f"""WITH {BENCH} SELECT word, i - 1 AS pos, CASE WHEN length(word) = 1 THEN 'isolated' WHEN i = 1 THEN 'initial' WHEN i = length(word) THEN 'final' ELSE 'medial' END AS position
FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM bw)""",
    "hyperparameter_grid": f"""{LAB}, l AS (SELECT lab.*, ea, eb FROM lab LEFT JOIN dim ON lab.label = dim.label),
g AS (SELECT l.*, boost, penalty, CASE WHEN ea = above AND eb = below THEN conf + boost WHEN ea IS NOT NULL THEN greatest(0.0, conf - penalty) ELSE conf END AS s
    FROM l, (SELECT unnest({BOOSTS}::DOUBLE[]) AS boost), (SELECT unnest({PENALTIES}::DOUBLE[]) AS penalty)),
r AS (SELECT *, row_number() OVER (PARTITION BY word, pos, boost, penalty ORDER BY s DESC, ord) AS a, row_number() OVER (PARTITION BY word, pos, boost, penalty ORDER BY conf DESC, ord) AS b FROM g)
SELECT boost, penalty, count(*) FILTER (WHERE a = 1) AS n, count(*) FILTER (WHERE a = 1 AND b <> 1) AS changed FROM r GROUP BY boost, penalty""",
    "tune_lm_grid": f"""WITH {TOKENS}, {FREQ}, {BIGRAM}, {BENCH}, {LATTICE},
sc AS (SELECT word, pos, ord, label, weight, round(CASE WHEN lat.prev IS NULL THEN conf ELSE (1 - weight) * conf + weight * coalesce(p, 1e-6) END, 9) AS s
    FROM lat LEFT JOIN bg ON lat.prev = bg.prev AND label = next, (SELECT unnest({WEIGHTS_GRID}::DOUBLE[]) AS weight)),
be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY word, pos, weight ORDER BY s DESC, ord, label DESC) = 1),
rd AS (SELECT word, weight, string_agg(label, '' ORDER BY pos) AS read, count(*) FILTER (WHERE ord <> 0) AS changed FROM be GROUP BY word, weight),
su AS (SELECT weight, CAST(sum(changed) AS BIGINT) AS changed, count(*) FILTER (WHERE read IN (SELECT word FROM freq WHERE cnt >= {corpus.LEXICON_COUNT})) AS known FROM rd GROUP BY weight)
SELECT weight, bonus, changed, known, CAST(row_number() OVER (ORDER BY changed, bonus * known DESC, round(abs(weight - 0.3), 6), weight, bonus) AS INTEGER) AS rank
FROM su, (SELECT unnest({LEXICON_GRID}::DOUBLE[]) AS bonus)""",
    "topk_centroid_classifier": f"{_CENTROID} SELECT vec_id, rank, class, round(p, 6) AS p FROM rk WHERE rank <= {CONFIG.top_k}",
    "classification_report": f"""{_CENTROID}, b AS (SELECT label, class AS pred FROM rk WHERE rank = 1), k AS (SELECT label AS class FROM b UNION SELECT pred FROM b),
n AS (SELECT class, (SELECT count(*) FROM b WHERE label = class) AS support, (SELECT count(*) FROM b WHERE pred = class) AS said, (SELECT count(*) FROM b WHERE pred = class AND label = class) AS r FROM k),
q AS (SELECT class, support, CASE WHEN said = 0 THEN 0 ELSE r / said END AS precision, CASE WHEN support = 0 THEN 0 ELSE r / support END AS recall FROM n)
SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS f1 FROM q""",
    "stratified_split": "SELECT vec_id, label, percent_rank() OVER (PARTITION BY label ORDER BY vec_id) < 0.15 AS is_test FROM embeddings",
}
