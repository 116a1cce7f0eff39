"""Corpus statistics: tokens of a script, word frequencies, character bigrams, vocabulary, lexicon search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents of neighbouring ids whose new words are counted together when a vocabulary is cut at its cap.
BLOCK_DOCS = 1 << 16


def tokens(docs: DataFrame, script: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, place)``: maximal runs of script characters; place (id, pos) orders tokens by document and position.

    A null text has none. Ids may be any longs, such as those of corpus_lines.
    """
    runs = F.regexp_extract_all(text_col, F.lit(f"[{script}]+"), F.lit(0))
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.posexplode(runs).alias("pos", "word"))
    return words.select("word", F.struct("id", "pos").alias("place"))


def word_counts(toks: DataFrame) -> DataFrame:
    """``(word, cnt, first_place)``; combined before the shuffle, so a frequent word is a row a task."""
    return toks.groupBy("word").agg(F.count("*").alias("cnt"), F.min("place").alias("first_place"))


def word_frequency_top(toks: DataFrame, n: int) -> DataFrame:
    """The n most frequent words, ties to the earlier first occurrence."""
    return word_counts(toks).orderBy(F.desc("cnt"), "first_place").limit(n).select("word", "cnt")


def capped_vocabulary(toks: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` distinct words of two or more characters, in stream order.

    New words are counted per block of BLOCK_DOCS ids first; running sums over the blocks (one small row each) tell where
    the cap is reached, and words are then ranked within their blocks, never all in one task.
    """
    firsts = toks.where(F.length("word") >= 2).groupBy("word").agg(F.min("place").alias("first_place"))
    block = F.floor(F.col("first_place.id") / BLOCK_DOCS)
    bounds = firsts.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    kept = bounds.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < cap).select("block", "before")
    rows = firsts.withColumn("block", block).join(kept, "block")
    nth = F.row_number().over(Window.partitionBy("block").orderBy("first_place"))
    return rows.withColumn("nth", nth + F.col("before")).where(F.col("nth") <= cap).select("word", "first_place")


def _pairs(text: Column) -> Column:
    """Adjacent character pairs of a string; its characters are split once, so the cost is linear in its length."""
    chars = F.array_remove(F.split(text, ""), "")
    cut = lambda c: F.when(F.size(c) >= 2, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(F.get(c, i - 1), F.get(c, i)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(chars), cut)[0]


def _probabilities(pairs: DataFrame) -> DataFrame:
    """(pair, cnt) to (prev, next, cnt, p) with p = cnt / count of prev."""
    whole = Window.partitionBy("prev")
    split = pairs.groupBy("pair").agg(F.sum("cnt").alias("cnt")).select(F.substring("pair", 1, 1).alias("prev"), F.substring("pair", 2, 1).alias("next"), "cnt")
    return split.withColumn("p", F.col("cnt") / F.sum("cnt").over(whole))


def bigrams_within_words(toks: DataFrame) -> DataFrame:
    """``(prev, next, cnt, p)`` of adjacent characters of a word; distinct words are counted first, then cut."""
    words = toks.groupBy("word").agg(F.count("*").alias("cnt"))
    return _probabilities(words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "cnt"))


def bigrams_across_words(docs: DataFrame, script: str, text_col: str = "text") -> DataFrame:
    """``(prev, next, cnt, p)`` of adjacent script characters of a document, other characters taken out first.

    Pairs inside words come from distinct words with their counts; those across from the last and first characters of
    neighbouring words, so a text never becomes an array of its characters.
    """
    runs = F.regexp_extract_all(text_col, F.lit(f"[{script}]+"), F.lit(0))
    words = docs.select(runs.alias("w")).where("size(w) > 0")
    inside = words.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))
    inside = inside.select(F.explode(_pairs(F.col("word"))).alias("pair"), "cnt")
    ends = F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.concat(F.right(a, F.lit(1)), F.left(b, F.lit(1))))
    across = words.where("size(w) > 1").select(F.explode(ends).alias("pair")).groupBy("pair").agg(F.count("*").alias("cnt"))
    return _probabilities(inside.unionByName(across))


def marked_lines(lines: DataFrame, group: str, order: str, line: str, opening: str, closing: str) -> DataFrame:
    """Lines inside marked stretches: from a line with ``opening`` to the next line with ``closing``, both included.

    Two running maxima per group: the last opening line so far, and the last closing line before this one.
    """
    until = Window.partitionBy(group).orderBy(order)
    opened = F.max(F.when(F.contains(line, F.lit(opening)), F.col(order))).over(until.rowsBetween(Window.unboundedPreceding, 0))
    closed = F.max(F.when(F.contains(line, F.lit(closing)), F.col(order))).over(until.rowsBetween(Window.unboundedPreceding, -1))
    both = lines.withColumn("opened", opened).withColumn("closed", closed)
    return both.where("opened IS NOT NULL AND (closed IS NULL OR opened > closed)").drop("opened", "closed")


def marked_dump(lines: DataFrame, opening: str, closing: str) -> DataFrame:
    """As marked_lines, of a dump's lines (file, block, n, line), a block at a time.

    A block's own markers are found by running maxima inside it; what stood open before it follows from one small row per
    block, so that a dump is never one task.
    """
    has = lambda mark: F.when(F.contains("line", F.lit(mark)), F.col("n"))
    blocks = lines.groupBy("file", "block").agg(F.max(has(opening)).alias("o"), F.max(has(closing)).alias("c"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("block", c))).over(before)
    carried = blocks.select("file", "block", last("o").alias("lo"), last("c").alias("lc"))
    open_before = F.col("lo").isNotNull() & (F.col("lc").isNull() | (F.col("lo.block") > F.col("lc.block")) | ((F.col("lo.block") == F.col("lc.block")) & (F.col("lo.o") > F.col("lc.c"))))
    rows = lines.join(carried.select("file", "block", open_before.alias("was_open")), ["file", "block"])
    until = Window.partitionBy("file", "block").orderBy("n")
    rows = rows.withColumn("o", F.max(has(opening)).over(until.rowsBetween(Window.unboundedPreceding, 0))).withColumn("c", F.max(has(closing)).over(until.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.when(F.col("o").isNotNull(), F.col("c").isNull() | (F.col("o") > F.col("c"))).otherwise(F.col("was_open") & F.col("c").isNull())
    return rows.where(inside).drop("was_open", "o", "c")


def prefix_search(lexicon: DataFrame, prefixes: DataFrame, key_chars: int = 3) -> DataFrame:
    """``(prefix, word)`` of lexicon words that start with a prefix, of any length; the empty prefix finds all words.

    The prefix's first characters, ``key_chars`` at most, are an equi key, and a word is looked up under each such length, so
    the search is a hash or merge join instead of a nested loop.
    """
    left = prefixes.select("prefix", F.substring("prefix", 1, key_chars).alias("key"))
    keys = F.array_distinct(F.array(*(F.substring("word", 1, n) for n in range(key_chars + 1))))
    right = lexicon.select("word", F.explode(keys).alias("key"))
    return left.join(right, "key").where(F.startswith("word", "prefix")).select("prefix", "word")


def in_lexicon(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """words with a boolean column: is the word in the lexicon."""
    known = lexicon.select("word").distinct().withColumn("known", F.lit(True))
    return words.join(known, "word", "left").withColumn("in_lexicon", F.coalesce("known", F.lit(False))).drop("known")


def rescored(words: DataFrame, frequency: DataFrame, lexicon: DataFrame, bonus: float, weight: float) -> DataFrame:
    """words (word, conf) with ``f`` and ``score = conf + bonus [in lexicon] + weight ln(f + 1) / ln(max f + 1)``.

    Without any frequency the last term is left out.
    """
    top = frequency.agg(F.max("cnt").alias("top"))
    found = in_lexicon(words, lexicon).join(frequency.select("word", "cnt"), "word", "left").crossJoin(F.broadcast(top))  # one row
    f = F.coalesce("cnt", F.lit(0))
    share = F.coalesce(F.try_divide(F.log(f + 1.0), F.log(F.col("top") + 1.0)), F.lit(0.0))
    score = F.col("conf") + F.when(F.col("in_lexicon"), bonus).otherwise(0.0) + weight * share
    return found.withColumn("f", f).withColumn("score", score).drop("cnt", "top")


def sequence_scores(words: DataFrame, bigrams: DataFrame, miss: float) -> DataFrame:
    """``(word, score)``: sum of ln p over a word's character pairs, ``miss`` for unseen ones; 0 for one character."""
    pairs = words.select("word", F.posexplode_outer(_pairs(F.col("word"))).alias("pos", "pair"))
    pairs = pairs.select("word", "pair", F.substring("pair", 1, 1).alias("prev"), F.substring("pair", 2, 1).alias("next"))
    found = pairs.join(bigrams.select("prev", "next", "p"), ["prev", "next"], "left")
    term = F.when(F.col("pair").isNull(), 0.0).otherwise(F.log(F.coalesce("p", F.lit(miss))))
    return found.groupBy("word").agg(F.sum(term).alias("score"))


def candidates_rescored(lattice: DataFrame, bigrams: DataFrame, miss: float, own: float = 0.7, context: float = 0.3) -> DataFrame:
    """lattice (word, pos, ord, prev, label, conf) with ``score = own conf + context p(prev, label)`` and its rank.

    A position without a predecessor keeps its confidences. Ties keep the order given.
    """
    p = bigrams.select("prev", F.col("next").alias("label"), "p")
    found = lattice.join(p, ["prev", "label"], "left")
    score = F.when(F.col("prev").isNull(), F.col("conf")).otherwise(own * F.col("conf") + context * F.coalesce("p", F.lit(miss)))
    rank = F.row_number().over(Window.partitionBy("word", "pos").orderBy(F.desc("score"), "ord"))
    return found.withColumn("score", score).withColumn("rank", rank).drop("p")
