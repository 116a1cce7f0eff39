import numpy as np
import pytest
from inkspark.kernels import page as K
from inkspark.kernels import png
from inkspark.kernels import segment as G
from inkspark.operators import decode as D
from inkspark.operators import models as M
from inkspark.operators import pages as P
from inkspark.operators import recognise as R
from inkspark.operators import segment as S
from inkspark.plans import recognise
from inkspark.sources import files
from inkspark.streaming import corpus as stream
from pyspark.sql import functions as F


def two_lines():
    page = np.full((200, 400), 255, np.uint8)
    page[30:60, 50:350] = page[110:140, 50:350] = 0
    return page


def test_components_and_noise():
    ink = np.array([[1, 0, 1, 0], [0, 1, 0, 0], [0, 0, 0, 1], [1, 0, 0, 1]]) > 0
    label = K.components(ink)
    assert label.max() == 3 and len({label[0, 0], label[1, 1], label[0, 2]}) == 1 and label[2, 3] == label[3, 3] != label[3, 0]
    page = two_lines()
    page[5, 5] = 0
    assert (K.without_noise(page) == two_lines()).all()
    assert (K.without_noise(np.full((9, 9), 255, np.uint8)) == 255).all()


def test_binarize_and_skew():
    assert set(np.unique(K.binarized(np.full((100, 100), 255, np.uint8)))) <= {0, 255}
    page = two_lines()
    assert K.skew(page) == 0.0 and K.skew(np.full((100, 100), 255, np.uint8)) is None
    turned = K.rotated(page, 4.0)
    assert abs(abs(K.skew(turned)) - 4.0) <= 0.5
    clean, angle = K.preprocessed(np.repeat(page[..., None], 3, axis=2))
    assert clean.shape == (330, 660) and angle == 0.0


def test_otsu_splits_two_levels():
    image = np.where(np.arange(64).reshape(8, 8) % 2 == 0, 40, 200).astype(np.uint8)
    assert 40 <= K.otsu(image) < 200


def test_binarize_keeps_a_dark_local_mask_and_else_takes_the_level():
    noisy = np.random.default_rng(0).integers(0, 256, (120, 120)).astype(np.uint8)
    assert set(np.unique(K.binarized(noisy))) <= {0, 255}
    page = np.full((120, 120), 200, np.uint8)
    page[40:60, 20:100] = 30
    assert (K.local_mask(page) == 0).mean() > 0.5 and (K.binarized(page)[45:55, 30:90] == 0).all()
    brute = lambda y, x: (lambda w: w.mean() * (1 + 0.24 * (w.std() / 127.5 - 1)))(np.pad(noisy.astype(float), 7, mode="reflect")[y : y + 15, x : x + 15])
    assert all(K.sauvola(noisy, 0.24)[y, x] == (noisy[y, x] < brute(y, x)) for y in (0, 5, 60, 119) for x in (0, 33, 119))


def test_resampling():
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert K.shrunk(image, 3, 4).tolist() == np.rint(image.reshape(3, 2, 4, 2).mean(axis=(1, 3))).astype(int).tolist()
    assert K.bounded(np.full((100, 4001), 9, np.uint8), 2000).shape == (50, 2000)
    assert K.upscaled(np.full((100, 50), 7, np.uint8)).shape == (300, 150) and (K.upscaled(np.full((100, 50), 7, np.uint8)) == 7).all()
    assert K.upscaled(np.zeros((400, 10), np.uint8)).shape == (400, 10)
    flat = np.tile(np.linspace(0, 250, 100).astype(np.uint8), (100, 1))
    assert abs(K.enlarged(flat, 300, 300).astype(int) - K.resized(flat, 300, 300).astype(int)).max() <= 3


def test_box_angle():
    page = np.full((60, 60), 255, np.uint8)
    for k in range(30):
        page[10 + k // 3, 10 + k] = 0
    assert abs(K.box_angle(page) - 18.4) < 2.5
    assert K.box_angle(np.full((60, 60), 255, np.uint8)) is None
    bar = np.full((60, 60), 255, np.uint8)
    bar[20:22, 10:30] = 0
    assert K.box_angle(bar) is None and (K.straight(bar)[0] == bar).all() and K.straight(bar)[1] == 0.0
    assert K.straight(page)[1] == K.box_angle(page)  # too sparse for a row profile


def test_page_segmentation_kernel():
    ink = two_lines() == 0
    assert [(a, b) for a, b in G.lines(ink)] and len(G.lines(ink)) == 2
    assert G.paws(np.ones((30, 120), bool), 20.0) == [(0, 120)] and G.lines(np.zeros((50, 50), bool)) == []
    piece = np.zeros((60, 120), bool)
    piece[20:50, 10:110] = piece[10:13, 30:33] = True
    body, dots = G.separate_dots(piece, 20.0)
    assert [(d.size, d.position) for d in dots] == [(1, "above")] and not body[10:13].any() and body[20:50, 10:110].all()
    chars = G.characters(ink)
    assert [c.line for c in chars] == sorted(c.line for c in chars) and {c.position for c in chars} <= {"isolated", "initial", "medial", "final"}
    assert [G.tag(k, 3) for k in range(3)] == ["initial", "medial", "final"] and G.tag(0, 1) == "isolated"


def test_page_kernel_cuts_as_the_relational_operators(spark):
    page = recognise.drawn("the quick brown fox jumps over the lazy dog".split())
    ink = page == 0
    runs = spark.createDataFrame([(1, *map(int, r)) for r in K.runs(page)], "page long, y int, x1 int, x2 int")
    heights, widths = spark.createDataFrame([(1, page.shape[0])], "page long, height int"), spark.createDataFrame([(1, page.shape[1])], "page long, width int")
    ah = G.average_height(G.parts(K.components(ink)))
    bands = S.merged_bands(S.line_bands(S.smoothed(S.row_projection(runs), heights), ah), ah)
    assert [(r.y1, r.y2) for r in bands.orderBy("line").collect()] == G.lines(ink)
    for line, (y1, y2) in enumerate(G.lines(ink)):
        pieces = S.paws(S.in_bands(runs, bands.where(F.col("line") == line)), widths, ah).orderBy("paw")
        assert [(r.x1, r.x2) for r in pieces.collect()] == G.paws(ink[y1:y2], ah)


def test_recognition_from_image_to_text(spark):
    words = ["stone", "bridge", "water", "lamp"]
    letters = sorted(set("".join(words)))
    pages = recognise.as_pages(spark.createDataFrame([("a", words), ("b", words[:2])], "page_id string, words array<string>"), "page_id")
    blank = spark.createDataFrame([("c", 200, 300, 1, bytearray(b"\xff" * 60000))], recognise.PAGE)
    crops = R.characters(pages.union(blank))
    assert {r.page: r["count"] for r in crops.groupBy("page").count().collect()} == {"a": 20, "b": 11}

    class Oracle:
        """Tells a character by its place on the page."""

        def top_k(self, rows, keys, k):
            order = crops.withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("page").orderBy("line", "paw", "char")))
            return order.select(*keys, F.lit(1).alias("rank"), F.substring(F.lit("".join(words)), F.col("n").cast("int"), F.lit(1)).alias("label"), F.lit(0.9).alias("p")).where("n <> 3")

    labels = spark.createDataFrame([(c, c, c, None, None) for c in letters], "label string, base string, glyph string, exp_above int, exp_below int")
    bonus = {w: 5.0 * len(w) ** 2 for w in [*words, "stne"]}
    got = R.recognised(pages.union(blank), Oracle(), {}, bonus, recognise.CONFIG, labels)
    assert {r.page: r.text.replace("\n", " ") for r in got.collect()} == {"a": "stne bridge water lamp", "b": "stne bridge", "c": ""}


def test_drawn_letters_are_told_apart():
    shapes = [recognise.letter(c) for c in recognise.LETTERS]
    blocks = [s[:: recognise.BLOCK, :: recognise.BLOCK] for s in shapes]
    assert all((a != b).any(axis=0).sum() >= 2 for k, a in enumerate(blocks) for b in blocks[:k])


def test_glyph_kernels():
    glyph = np.full((20, 15), 255, np.uint8)
    glyph[3:17, 2:13] = 0
    image = K.normalized(glyph)
    assert image.shape == (32, 32) and (K.normalized(np.full((5, 5), 255, np.uint8)) == 255).all()
    assert K.hog(image).shape == (1764,) and K.contour(image).shape == (192,) and not K.contour(np.full((32, 32), 255, np.uint8)).any()
    border = K._border(np.pad(np.ones((3, 4), bool), 1))
    assert set(border) == {(y, x) for y in range(1, 4) for x in range(1, 5)} - {(2, 2), (2, 3)}


def test_image_source_to_lines(spark, tmp_path):
    for name, image in (("a.png", two_lines()), ("b.PNG", two_lines()[:100])):
        (tmp_path / name).write_bytes(png.encode(image.tobytes(), *image.shape))
    (tmp_path / "notes.txt").write_text("no image")
    runs = P.page_runs(files.page_images(spark, str(tmp_path)))
    ids = runs.select("page").distinct().withColumn("n", F.row_number().over(__import__("pyspark").sql.Window.orderBy("page")))
    numbered = runs.join(ids, "page").select(F.col("n").alias("page"), "y", "x1", "x2", "page_height")
    heights = numbered.select("page", F.col("page_height").alias("height")).distinct()
    bands = S.line_bands(S.smoothed(S.row_projection(numbered.drop("page_height")), heights), 20.0)
    assert {(r.page, r.line) for r in bands.collect()} == {(1, 0), (1, 1), (2, 0)}
    (tmp_path / "broken.png").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not an image"):
        files.page_images(spark, str(tmp_path)).collect()


def test_glyph_features(spark):
    image = np.full((20, 15), 255, np.uint8)
    image[3:17, 2:13] = 0
    rows = spark.createDataFrame([(1, 20, 15, 1, bytearray(image.tobytes()))], "k long, height int, width int, channels int, data binary")
    got = R.features(rows, ["k"]).first().features
    assert len(got) == sum(R.PARTS) == 2069 and got[-4:] == [0, 0, 0, 0]
    dotted = rows.selectExpr("*", "2 AS above", "1 AS below", "1.5D AS spread")
    assert R.features(dotted, ["k"]).first().features[-4:] == [2, 1, 1, 1.5]


def test_statistics_round_trip(spark):
    bigrams = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.5), ("ب", "ت", 1.0)], "prev string, next string, p double")
    assert sorted(map(tuple, files.bigrams_from_json(files.bigrams_to_json(bigrams)).collect())) == sorted(map(tuple, bigrams.collect()))
    rows = spark.createDataFrame([('{"a": 3, "b": 4}',), ("nonsense",)], "json string")
    assert sorted(map(tuple, files.frequencies_from_json(rows).collect())) == [("a", 3), ("b", 4)]


def test_text_documents(spark):
    lines = spark.createDataFrame([("x/p1.png", 1, "two"), ("x/p1.png", 0, "one")], "page string, line int, text string")
    assert [tuple(r) for r in files.text_documents(lines).collect()] == [("p1.txt", files.BOM + "one\ntwo\n")]


def test_corpus_sources(spark, tmp_path):
    (tmp_path / "c.txt").write_text("alpha\n beta \n\nalpha\n")
    assert files.corpus_lines(spark, str(tmp_path)).count() == 4
    assert sorted(r.word for r in files.word_list(spark, str(tmp_path)).collect()) == ["alpha", "beta"]
    assert [r.n for r in files.dump_lines(spark, str(tmp_path)).orderBy("n").collect()] == [0, 1, 2, 3]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one two two\n")
    run = lambda: stream.run_once(stream.word_counts(stream.text_stream(spark, str(tmp_path / "in")), "a-z"), "counts", str(tmp_path / "ck"))
    run()
    assert {tuple(r) for r in spark.table("counts").collect()} == {("one", 1), ("two", 2)}


def test_decoders():
    bigrams = {("a", "b"): 0.9, ("a", "c"): 0.1, ("b", "a"): 1.0}
    lattice = [[("a", 0.6), ("b", 0.4)], [("c", 0.5), ("b", 0.5)], [("a", 1.0)]]
    path, score = D.viterbi(lattice, bigrams, 1e-6)
    best = D.beams(lattice, bigrams, 1e-6, 50)[0]
    assert path == best[1] == "aba" and score == pytest.approx(best[0])
    assert D.viterbi([], bigrams, 1e-6) == ("", 0.0)
    pieces = [[[("a", 1.0)]], [[("b", 1.0)]], [[("_", 1.0)]]]
    assert D.words_of_pieces(pieces, bigrams, 1e-6, 5, 8, 0.0, lambda w: {"ab": 5.0}.get(w, -9.0)) == "ab"


def test_line_decoding_by_brute_force():
    r = np.random.default_rng(4)
    letters = "abcd_"
    bigrams = {(a, b): float(r.random()) for a in letters for b in letters}
    for _ in range(40):
        pieces = [[[(c, float(r.random())) for c in letters[: r.integers(1, 4)]] for _ in range(r.integers(1, 3))] for _ in range(r.integers(1, 6))]
        bonus = lambda w: len(w) ** 2 * 0.7 if w in {"ab", "abab", "aa", "b"} else 0.0  # noqa: B023, E731
        best = [(0.0, [])] + [(-np.inf, [])] * len(pieces)
        for i in range(1, len(pieces) + 1):
            for j in range(max(0, i - 3), i):
                score, word = max(((s + bonus(w := path.replace("_", "")), w) for s, path in D.beams(sum(pieces[j:i], []), bigrams, 1e-6, 50)), key=lambda x: x[0])
                if (total := best[j][0] + score - (0.1 if j else 0)) > best[i][0]:
                    best[i] = (total, best[j][1] + [word] * bool(word))
        assert D.words_of_pieces(pieces, bigrams, 1e-6, 50, 3, -0.1, bonus) == " ".join(best[-1][1])


def test_line_query_has_the_limits_of_the_reference(spark, tmp_path, monkeypatch):
    from inkspark.plans import decode

    names = ["".join("abcdefghijklmnopqrstuvwxyz"[n // 26**k % 26] for k in range(4)) for n in range(25000)]
    docs = [(0, " ".join(["often often", *names]), "en")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "often")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bonus = decode.word_bonus(spark, str(tmp_path))
    assert set(bonus) == {"often", *names} and bonus["often"] == pytest.approx(15.25)
    assert all(bonus[w] == pytest.approx(0.25 + 15 * np.log(2) / np.log(3)) for w in names)
    monkeypatch.setattr(decode, "CONFIG", decode.Config(script=decode.LATIN, frequency_cap=1))
    assert decode.word_bonus(spark, str(tmp_path))[names[0]] == pytest.approx(0.25)
    given = []
    monkeypatch.setattr(decode, "CONFIG", decode.Config(script=decode.LATIN))
    monkeypatch.setattr(D, "decoded_lines", lambda *args: given.append(args[4]))
    decode.paw_word_dp(spark, str(tmp_path))
    assert given == [50]


def test_forest_query_has_all_trees(monkeypatch):
    from inkspark.plans import models

    made = []
    monkeypatch.setattr(models, "_rows", lambda spark, sf_dir: None)
    monkeypatch.setattr(M.Classifier, "fit", lambda self, rows: made.append(M._stages(self.kind, 6, 3, self.seed, self.params)[1].getNumTrees()) or self)
    monkeypatch.setattr(M.Classifier, "top_k", lambda *args: args[1] or __import__("unittest.mock").mock.MagicMock())
    models.QUERIES["rf_topk"](None, None)
    assert made == [300]


@pytest.mark.parametrize("kind", ["SVM", "rf"])
def test_classifier(spark, tmp_path, kind):
    r = np.random.default_rng(0)
    rows = [(k, str(k % 3), (r.normal(0, 0.2, 6) + np.eye(6)[k % 3] * 2).tolist()) for k in range(120)]
    frame = spark.createDataFrame(rows, "id long, label string, features array<double>")
    model = M.Classifier(kind, trees=10).fit(frame)
    got = model.top_k(frame, ["id"]).collect()
    assert len(got) == 360 and sum(g.label == str(g.id % 3) for g in got if g["rank"] == 1) > 110
    model.save(str(tmp_path / "m"))
    again = M.Classifier(kind).load(str(tmp_path / "m"), 6)
    assert again.top_k(frame, ["id"], 1).count() == 120
    with pytest.raises(ValueError):
        M.Classifier("none")


def _plain_tree(x, y, classes, seed):
    """The tree of ``kernels.forest.grow``, node by node from its definition: shares of classes of each row of x."""
    draw, (n, d) = np.random.default_rng(seed), x.shape
    weights = np.bincount(draw.integers(0, n, n), minlength=n)
    level, out, open_rows = [(np.flatnonzero(weights), np.arange(n))], np.zeros((n, classes)), True
    while level and open_rows:
        tables = [np.bincount(y[bag], weights[bag], classes) for bag, _ in level]
        mixed = [k for k, t in enumerate(tables) if (t > 0).sum() > 1]
        turns = dict(zip(mixed, np.argsort(draw.random((len(mixed), d), np.float32), axis=1), strict=True)) if mixed else {}
        below = []
        for k, (bag, walkers) in enumerate(level):
            best = None
            for turn, f in enumerate(turns.get(k, [])):
                if turn >= max(1, int(d**0.5)) and best:
                    break
                known = np.unique(x[bag, f])
                for low, high in zip(known, known[1:], strict=False):
                    sides = [np.bincount(y[s], weights[s], classes) for s in (bag[x[bag, f] <= low], bag[x[bag, f] > low])]
                    score = sum((s**2).sum() / s.sum() for s in sides)
                    if best is None or score > best[0]:
                        best = (score, f, np.float32((float(low) + float(high)) / 2))
            if best is None:
                out[walkers] = tables[k] / tables[k].sum()
                continue
            for side in (False, True):
                below.append(tuple(r[(x[r, best[1]] > best[2]) == side] for r in (bag, walkers)))
        level = below
    return out


@pytest.mark.parametrize("steps", [0, 3])
def test_forest_kernel_by_definition(steps):
    from inkspark.kernels import forest as K

    r = np.random.default_rng(steps)
    x = r.normal(0, 1, (90, 5)) if not steps else r.integers(0, steps, (90, 5))  # ties, constant draws, equal rows
    x, y = K.finite(x), r.integers(0, 4, 90)
    for k in range(6):
        tree = K.Tree.unpack(K.grow(*K.ranked(x), y, 4, [7, k]).pack())
        votes = np.zeros((90, 4))
        K.add_votes(votes, x, tree)
        assert votes == pytest.approx(_plain_tree(x, y, 4, [7, k]))
    odd = K.finite(np.array([[np.nan], [np.inf], [-np.inf], [3e38], [-3e38], [1.0], [np.nextafter(np.float32(1), 2)]]))
    tree, votes = K.grow(*K.ranked(odd), np.array([0, 0, 1, 2, 3, 4, 5]), 6, [0, 0]), np.zeros((7, 6))
    K.add_votes(votes, odd, tree)
    assert votes.sum(1) == pytest.approx(np.ones(7)) and (votes[0] == votes[1]).all()


def test_forest_in_tasks(spark, tmp_path, monkeypatch):
    """Trees grow in tasks without MLlib, whatever the rows' order, and are asked in groups; all of them vote."""
    from inkspark.operators import forest

    r = np.random.default_rng(1)
    rows = [(k, str(k % 3), (r.normal(0, 0.9, 6) + np.eye(6)[k % 3]).tolist()) for k in range(120)]
    schema = "id long, label string, features array<double>"
    monkeypatch.setattr(M, "Pipeline", None)
    model = M.Classifier("rf", trees=9).fit(spark.createDataFrame(rows, schema))
    frame = spark.createDataFrame(rows, schema)
    told = sorted(map(tuple, model.top_k(frame, ["id"]).collect()))
    assert spark.read.parquet(model.trees).count() == 9 and all(p * 9 == pytest.approx(round(p * 9)) for *_, p in told)
    assert [sum(p for k, _, _, p in told if k == i) for i in range(120)] == pytest.approx([1] * 120)
    monkeypatch.setattr(forest, "GROUP_BYTES", 1)
    again = M.Classifier("rf", trees=9).fit(spark.createDataFrame(rows[::-1], schema).repartition(3))
    assert sorted(map(tuple, again.top_k(frame, ["id"]).collect())) == told
    again.save(str(tmp_path / "m"))
    loaded = M.Classifier("rf").load(str(tmp_path / "m"), 6)
    loaded.save(str(tmp_path / "m"))
    assert sorted(map(tuple, loaded.top_k(frame.drop("label"), ["id"]).collect())) == told
    with pytest.raises(Exception, match="hasn't 6 values"):
        model.top_k(spark.createDataFrame([(1, [1.0, None, 0.0, 0.0, 0.0, 0.0])], "id long, features array<double>"), ["id"]).collect()
