"""Sinks, labelled trees, language-model jobs, training sets, augmentation, overlays and reports."""

import bz2

import numpy as np
import pytest
from inkspark.config import Config
from inkspark.functions import labels as L
from inkspark.functions import text as X
from inkspark.kernels import page as K
from inkspark.kernels import png
from inkspark.operators import augment, inspect, jobs
from inkspark.operators import corpus as C
from inkspark.operators import glyphs as G
from inkspark.operators import models as M
from inkspark.operators import pages as P
from inkspark.operators import recognise as R
from inkspark.plans import recognise
from inkspark.sources import files
from pyspark.sql import functions as F

CONFIG = Config(script="a-z")


@pytest.fixture
def pages(spark):
    return recognise.as_pages(spark.createDataFrame([("x/a.png", ["stone", "bridge"]), ("x/b.png", ["lamp"])], "page string, words array<string>"), "page")


def test_image_files_round_trip(spark, tmp_path, pages):
    assert files.save_images(pages, str(tmp_path / "out")) == 2
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.png", "b.png"]
    back = {r.page.rsplit("/", 1)[1]: r for r in files.page_images(spark, str(tmp_path / "out")).collect()}
    for r in pages.collect():
        got = back[r.page.rsplit("/", 1)[1]]
        assert (got.height, got.width) == (r.height, r.width) and (K.gray(R.image_of(got)) == R.image_of(r)[..., 0]).all()


def test_text_files(spark, tmp_path):
    lines = spark.createDataFrame([("x/p1.png", 1, "zwei"), ("x/p1.png", 0, "eins"), ("x/p2.png", 0, "")], "page string, line int, text string")
    assert files.write_text(files.text_documents(lines), str(tmp_path)) == 2
    assert (tmp_path / "p1.txt").read_bytes() == b"\xef\xbb\xbfeins\nzwei\n" and (tmp_path / "p2.txt").read_bytes() == b"\xef\xbb\xbf"
    one = files.text_documents(lines.where("page = 'x/p1.png'"), output="chosen.txt")
    assert files.write_text(one, "file://" + str(tmp_path)) == 1 and (tmp_path / "chosen.txt").exists()
    assert files.write_files(spark.createDataFrame([], "name string, content string"), str(tmp_path)) == 0


def test_labelled_trees(spark, tmp_path):
    for label in ("Ta_Marbuta_End", "Baa_Start"):
        (tmp_path / label).mkdir()
        (tmp_path / label / "1.png").write_bytes(png.encode(bytes(60), 6, 10))
    (tmp_path / "Baa_Start" / "broken.png").write_bytes(b"nothing")
    got = files.labelled_images(spark, str(tmp_path), L.TRAINING_SYNONYMS)
    assert sorted(r.label for r in got.collect()) == ["Baa_Start", "Teh_Marbuta_End"]
    (tmp_path / "none" / "inner").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        files.labelled_images(spark, str(tmp_path / "none"), need=True)


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_dump_of_several_blocks(spark, tmp_path, split):
    lines = ["out alpha", "<text>beta", "gamma", "delta </text> x", "out", "<text> one </text>", "still two", "</text>", "out", "<text>", *[f"w{k}" for k in range(40)], "</text>", "out"]
    (tmp_path / "d.xml").write_text("\n".join(lines) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, split)
    try:
        rows = files.dump_lines(spark, str(tmp_path / "d.xml"))
        assert (rows.select("block").distinct().count() > 3) == (split == 64)
        got = C.marked_dump(rows, "<text", "</text>").orderBy("block", "n").collect()
        whole = C.marked_lines(rows.withColumn("at", F.struct("block", "n")), "file", "at", "line", "<text", "</text>").orderBy("block", "n").collect()
    finally:
        spark.conf.set(key, before)
    assert [r.line for r in got] == [r.line for r in whole]
    assert [r.line for r in got] == ["<text>beta", "gamma", "delta </text> x", "<text> one </text>", "<text>", *[f"w{k}" for k in range(40)], "</text>"]


def test_compressed_dump(spark, tmp_path):
    (tmp_path / "d.bz2").write_bytes(bz2.compress(b"a\n<text>b\nc</text>\nd\n"))
    assert [r.line for r in C.marked_dump(files.dump_lines(spark, str(tmp_path / "d.bz2")), "<text", "</text>").orderBy("n").collect()] == ["<text>b", "c</text>"]


def test_language_model_jobs(spark, tmp_path):
    docs = spark.createDataFrame([(1, "abc abc ab"), (2, None)], "doc_id long, text string")
    none = jobs.load_language_model(spark, str(tmp_path / "lm"))
    assert none.bigrams.count() == none.lexicon.count() == none.frequency.count() == 0
    jobs.build_language_model(spark, docs, str(tmp_path / "lm"), CONFIG, spark.createDataFrame([("extra",), ("abc",)], "word string"))
    half = jobs.load_language_model(spark, str(tmp_path / "lm"))
    assert half.frequency.count() == 0 and sorted(r.word for r in half.lexicon.collect()) == ["ab", "abc", "extra"]
    jobs.build_word_frequency(spark, docs, str(tmp_path / "lm"), CONFIG)
    lm = jobs.load_language_model(spark, str(tmp_path / "lm"))
    assert {r.word: r.cnt for r in lm.frequency.collect()} == {"abc": 2, "ab": 1}
    assert {(r.prev, r.next): r.p for r in lm.bigrams.collect()} == {("a", "b"): 1.0, ("b", "c"): 1.0}


def test_reranker_rows_and_storage(spark, tmp_path):
    names = ["Baa_Start", "Taa_End", "Alef_Isolated", "Strange"]
    samples = spark.createDataFrame([(k, names[k % 4]) for k in range(40)], "id long, label string")
    rows = M.reranker_rows(samples, L.label_dim(spark), "id").collect()
    assert len(rows) == 200 and sum(r.right for r in rows) == 40 and all(r.conf == 1.0 for r in rows if r.right) and all(0 <= r.conf < 0.9 for r in rows if not r.right)
    assert all((r.exp_above, r.exp_below) == (r.above, r.below) for r in rows if r.right) and {(r.above, r.below) for r in rows if r.id == 0} == {(0, 1)}
    again = M.reranker_rows(samples, L.label_dim(spark), "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    path = str(tmp_path / "reranker")
    assert M.load_reranker(path) is None
    model = M.fit_reranker(again, M.RERANK_INPUTS)
    M.save_reranker(model, path)
    assert M.load_reranker(path).coefficients == model.coefficients
    with pytest.raises(ValueError):
        M.fit_reranker(again.limit(10), M.RERANK_INPUTS)
    assert M.reranker_rows(samples.where("label = 'Strange'"), L.label_dim(spark), "id").where("right = 0").count() == 0


def test_classifier_registry_and_validation(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = spark.createDataFrame([(k, str(k % 3), (r.normal(0, 0.2, 4) + np.eye(4)[k % 3] * 2).tolist()) for k in range(150)], "id long, label string, features array<double>")
    assert M.get_classifier("RF", str(tmp_path), 4).model is None
    M.Classifier("rf", trees=5).fit(rows).save(str(tmp_path / "rf"))
    assert M.get_classifier("rf", str(tmp_path), 4).top_k(rows, ["id"], 1).count() == 150
    best, score = M.fit_with_validation("cnn", rows, "id", steps=(5, 30, 60), target=0.9)
    assert score >= 0.9 and best.params["steps"] in (5, 30, 60)


def test_augmentation_repeats_itself(spark):
    glyphs = spark.createDataFrame([(k, 20, 16, 1, bytearray(np.where(np.arange(320) % 7 < 3, 0, 255).astype(np.uint8).tobytes()), "x") for k in range(6)], "id long, height int, width int, channels int, data binary, label string")
    for kind in ("training", "synthesis"):
        one, two = (sorted((r.id, r.copy, bytes(r.data)) for r in augment.augmented(glyphs, "id", kind, 3).collect()) for _ in range(2))
        assert one == two and len(one) == 18 and len({d for *_, d in one}) > 9 and all(len(d) == 320 for *_, d in one)


def test_stages_overlays_and_crops(spark, tmp_path, pages):
    stages = {r.name: r for r in inspect.stage_images(pages).collect()}
    assert set(stages) == {f"{p}_{s}" for p in "ab" for s in ("gray", "binary", "clean", "deskew", "padded")}
    shown = {r.name: r for r in inspect.overlays(pages).collect()}
    assert set(shown) == {f"{p}_{s}" for p in "ab" for s in inspect.COLOURS}
    image = R.image_of(shown["a_chars"])
    assert image.shape[2] == 3 and (image == inspect.COLOURS["chars"]).all(axis=2).any()
    crops = R.characters(pages)
    flagged = inspect.crop_images(crops, crops.where("page = 'x/b.png' AND paw = 1"))
    assert sorted(r.name for r in flagged.collect()) == ["b_line0_paw1_char0", "b_line0_paw1_char1"]
    assert files.write_files(files.as_png(flagged, "name"), str(tmp_path)) == 2
    report = inspect.piece_report(crops).collect()
    assert sum(r.n for r in report) == 15 and all(r.flags == "" for r in report)
    strange = crops.withColumn("dots", F.expr("array_repeat(named_struct('cx', 1D, 'cy', 1D, 'size', 1, 'position', 'above'), 4)")).withColumn("ah", F.lit(4000.0))
    assert {r.flags for r in inspect.piece_report(strange).collect()} >= {"tiny_avg_w,many_dots"}


def test_comparison_of_variants(spark):
    a = spark.createDataFrame([("p", "ab 1"), ("q", "x")], "page string, text string")
    b = spark.createDataFrame([("p", "ab c"), ("r", "")], "page string, text string")
    got = {r.page: tuple(r)[1:] for r in inspect.compared(a, b, "a-z").collect()}
    assert got["p"] == (1, 0, 1, 0.25) and got["q"] == (0, 0, 1, 1.0) and got["r"] == (0, 0, 0, 0.0)
    assert got[None] == pytest.approx((1 / 3, 0, 2 / 3, 1.25 / 3))
    ranked = spark.range(30).selectExpr("id", "CAST(id + 1 AS int) AS rank")
    assert inspect.first_candidates(ranked).count() == 10


def test_boxes_and_script(spark):
    boxes = spark.createDataFrame([(1, 5, 1, 9, 9, 20, 30), (1, 8, 0, 19, 7, 20, 30)], "paw int, x1 int, y1 int, x2 int, y2 int, page_width int, page_height int")
    assert [tuple(r)[1:5] for r in P.region(boxes).orderBy("x1").collect()] == [(3, 0, 11, 11), (6, 0, 20, 9)]
    assert tuple(P.piece_boxes(boxes, ["paw"]).first()) == (1, 5, 0, 19, 9)
    chars = spark.createDataFrame([("\u0628",), ("b",), ("\u0600",), ("\u0700",), (None,)], "c string")
    assert [r[0] for r in chars.select(X.in_script(F.col("c"), Config().script)).collect()] == [True, False, True, False, None]


def test_dot_features_of_glyphs_without_dots(spark):
    clusters = spark.createDataFrame([(1, 10.0, 2, "above"), (1, 15.0, 1, "below")], "glyph long, cx double, size int, position string")
    got = {r.glyph: tuple(r)[1:] for r in G.dot_features(clusters, ["glyph"], spark.createDataFrame([(1,), (2,)], "glyph long")).collect()}
    assert got == {1: (2, 1, 1, 2.5), 2: (0, 0, 0, 0.0)}
