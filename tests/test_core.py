import itertools
import random
import unicodedata

import numpy as np
from inkspark.functions import labels
from inkspark.functions import text as X
from inkspark.operators import candidates, segment
from inkspark.operators import corpus as C
from inkspark.sources import files
from pyspark.sql import functions as F


def test_labels():
    table, dots = labels.label_table(), labels.dot_table()
    assert table["Ain_Start"] == "عـ" and table["Ha_End"] == "ـه" and table["7"] == "٧" and table["Lam_Alf_Isolated"] == "لا"
    assert dots["Sheen"] == (3, 0) and dots["Yeh"] == (0, 2) and "Lam_Alf" not in dots
    assert len(labels.label_rows()) == len({r[1] for r in labels.label_rows()})


def test_text_functions(spark):
    rows = spark.createDataFrame([("éً",), (None,), ("",)], "s string")
    got = [r[0] for r in rows.select(X.nfc(X.strip_marks(F.col("s")))).collect()]
    assert got == [unicodedata.normalize("NFC", "é"), None, ""]
    assert rows.select(X.join_rtl(F.array(F.lit("a"), F.lit("b")))).first()[0] == "‏a b‏"
    one = spark.range(1)
    assert one.select(X.base_of(F.lit("Alef_Hamza_End")), X.base_of(F.lit("x")), X.relative_change(F.lit(""), F.lit(""))).first()[:] == ("Alef_Hamza", "x", 0.0)


def test_merge_without_weight(spark):
    rows = spark.createDataFrame([(1, 0, "_", 1.0), (2, 0, "a", 0.0), (3, 0, "b", 0.2), (3, 1, "a", 0.2)], "k int, ord int, glyph string, conf double")
    got = {(r.k, r["rank"]): (r.glyph, r.p) for r in candidates.merged(rows, ["k"]).collect()}
    assert got == {(1, 1): ("_", 1.0), (2, 1): ("_", 1.0), (3, 1): ("b", 0.5), (3, 2): ("a", 0.5)}


def _best_by_enumeration(ink, cuts, ah):
    inner, best = cuts[1:-1], None
    for n in range(len(inner) + 1):
        for chosen in itertools.combinations(inner, n):
            parts = list(itertools.pairwise([cuts[0], *chosen, cuts[-1]]))
            if all(segment._valid(ink, s, e, ah) for s, e in parts):
                best = max(best or 0, 88 * len(parts))
    return best


def test_best_cuts_is_optimal():
    for seed in range(60):
        r = np.random.default_rng(seed)
        ink = (r.random((10, 24)) < 0.5).astype(np.int64)
        cuts = sorted({0, 24, *r.integers(1, 24, 4).tolist()})
        parts = segment.best_cuts(ink, cuts, 8.0)
        best = _best_by_enumeration(ink, cuts, 8.0)
        assert [parts[0][0], *[e for _, e in parts]][-1] == 24
        assert best is None and parts == [(0, 24)] or best == 88 * len(parts)


def test_split_covers_piece():
    for seed in range(40):
        r = random.Random(seed)
        ink = np.zeros((8, r.randint(1, 40)), np.int64)
        for x in range(ink.shape[1]):
            ink[r.randint(0, 7) :, x] = 1
        boxes = segment.split_multiscale(ink, 8.0)[::-1]
        assert boxes[0][0] == 0 and boxes[-1][1] == ink.shape[1] and all(a[1] == b[0] for a, b in itertools.pairwise(boxes))


def test_places_of_several_partitions(spark, tmp_path):
    for k, word in enumerate(["gamma", "alpha", "beta"]):
        (tmp_path / f"{k}.txt").write_text(f"{word} {word} x{word}\n")
    lines = files.corpus_lines(spark, str(tmp_path))
    assert lines.select(F.spark_partition_id()).distinct().count() > 1 or lines.rdd.getNumPartitions() > 1
    toks = C.tokens(lines, "a-z", "doc_id")
    assert toks.select("place").distinct().count() == 9
    every = [r.word for r in C.capped_vocabulary(toks, 100).orderBy("first_place").collect()]
    assert len(every) == 6 and [r.word for r in C.capped_vocabulary(toks, 3).orderBy("first_place").collect()] == every[:3]
    assert [r.word for r in C.word_frequency_top(toks, 2).collect()] == [w for w in every if not w.startswith("x")][:2]


def test_prefixes_of_any_length(spark):
    words = spark.createDataFrame([("a",), ("ab",), ("abcd",), ("abce",), ("b",)], "word string")
    prefixes = spark.createDataFrame([("",), ("a",), ("ab",), ("abc",), ("abcd",), ("abcde",)], "prefix string")
    got = {(r.prefix, r.word) for r in C.prefix_search(words, prefixes).collect()}
    assert got == {(p, w) for (p,) in prefixes.collect() for (w,) in words.collect() if w.startswith(p)}


def test_bigrams_across_words(spark):
    docs = spark.createDataFrame([(1, "ab c, de"), (2, None), (3, ""), (4, "x"), (5, "b-c")], "doc_id long, text string")
    got = {(r.prev, r.next): r.cnt for r in C.bigrams_across_words(docs, "a-z").collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 2, ("c", "d"): 1, ("d", "e"): 1}


def test_empty_tables(spark):
    runs = spark.createDataFrame([], "page long, y int, x1 int, x2 int")
    assert segment.row_projection(runs).count() == 0
    heights = spark.createDataFrame([], "page long, height int")
    assert segment.line_bands(segment.smoothed(segment.row_projection(runs), heights), 8.0).count() == 0
