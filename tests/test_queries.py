"""Each query with SQL against DuckDB on the smallest tables."""

import random

import duckdb
import numpy as np
import pytest
from inkspark.kernels import segment as G
from inkspark.operators import segment as S
from inkspark.plans import raster, registry

SF = "/root/testdata/sf0.001"
TABLES = "documents pages embeddings benchmark".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(rows):
    cell = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({registry.SQL[name]})").fetchall()
    assert _plain(map(tuple, got.select(*columns).collect())) == _plain(want)


def test_boxes_of_the_raster(spark):
    """Boxes without SQL: they tile their piece right to left, and the reports over them add up."""
    boxes = {}
    for r in registry.QUERIES["char_boxes_multiscale"](spark, SF).collect():
        boxes.setdefault((r.page, r.line, r.paw), []).append((r.char, r.x1, r.x2))
    for own in boxes.values():
        own.sort()
        assert [c for c, *_ in own] == list(range(len(own))) and own[-1][1] == 0
        assert all(left[2] == right[1] for right, left in zip(own, own[1:], strict=False))
    report = {(r.page, r.line, r.paw): r.n for r in registry.QUERIES["paw_diagnostics"](spark, SF).collect()}
    assert report == {k: len(v) for k, v in boxes.items()}
    counts = {(r.page, r.line): (r.n_chars, r.n_pieces) for r in registry.QUERIES["piece_counts"](spark, SF).collect()}
    assert counts[None, None] == (sum(map(len, boxes.values())), len(boxes))


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def _related(spark, folder, name):
    """The query by the relational operators."""
    runs, pieces = raster._line_runs(spark, folder), raster._pieces(spark, folder)
    ink = S.paw_runs(runs, pieces)
    cuts = S.valleys(S.column_steps(ink), raster.AH)
    if name == "column_valleys":
        return cuts
    if name == "valid_char_flags":
        return S.valid_flags(S.segments(cuts, pieces), ink, raster.AH)
    boxes = S.char_boxes(ink, raster.AH)
    if name == "paw_diagnostics":
        return S.paw_diagnostics(boxes, raster.AH)
    return S.piece_counts(boxes) if name == "piece_counts" else boxes


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Texts of other letters, faint lines, blanks, long words; with and without repeated ids."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgäßжع中😀0\t") for _ in range(draw.choice([1, 2, 5, 9, 60])))
    text = lambda: "\n".join(" ".join(word() for _ in range(draw.choice([0, 1, 4, 50]))) for _ in range(draw.randrange(9)))
    rows = [(k, text()) for k in range(12)] + [(None, "no id"), (20, None), (21, ""), (22, "\n\n"), (23, "b"), (24, "a"), (25, " b \nd\n\n" + "a" * 900 + "\n."), (26, "b b b b")]
    out = []
    for name, own in (("once", rows), ("twice", [*rows, *((k, text()) for k in (3, 4, 4, 23, 24)), (7, rows[7][1])])):
        folder = str(tmp_path_factory.mktemp(name))
        spark.createDataFrame(own, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        out.append(folder)
    return out


@pytest.mark.parametrize("name", ["column_valleys", "valid_char_flags", "char_boxes_multiscale", "paw_diagnostics", "piece_counts"])
def test_pages_in_a_task_as_by_the_relational_operators(spark, odd, name):
    for folder in odd:
        got, want = registry.QUERIES[name](spark, folder), _related(spark, folder, name)
        assert got.dtypes == want.dtypes
        assert _plain(map(tuple, got.collect())) == _plain(map(tuple, want.collect()))
        if folder == odd[0] and name != "piece_counts":  # nothing is shuffled where no id repeats
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_dots_of_pieces(spark, tmp_path):
    """Two lines so close that they are one: their single low letters are dots, and pieces are split without them."""
    rows = [(1, "b b a b aaaaaa\naaaaaaaaa b "), (2, "a b cccccccc\naaaaaaaaa b "), (3, "b\nab")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    report = registry.QUERIES["paw_diagnostics"](spark, folder)
    assert report.columns == [*S.PAW, "n", "mean_width", "width", "n_dots", "flags"]
    got = {(r.page, r.paw): (r.n, r.mean_width, r.width, r.n_dots, r.flags) for r in report.where("page < 3").collect()}
    assert got == {(1, 0): (4, 7.0, 28, 4, "many_dots"), (2, 0): (3, 8.0, 24, 2, "")}
    assert sorted((r.line, r.n_dots, r.flags) for r in report.where("page = 3").collect()) == [(0, 1, ""), (1, 0, "")]
    boxes = [(r.char, r.x1, r.x2, r.dots) for r in registry.QUERIES["char_boxes_multiscale"](spark, folder).where("page = 2").collect()]
    assert sorted(boxes) == [(0, 20, 24, 1), (1, 4, 20, 1), (2, 0, 4, 0)]
    for name in ("char_boxes_multiscale", "paw_diagnostics", "piece_counts"):
        assert _plain(map(tuple, registry.QUERIES[name](spark, folder).collect())) == _plain(map(tuple, _related(spark, folder, name).collect()))


def test_dots_are_counted_as_they_are_clustered():
    for seed in range(60):
        r = np.random.default_rng(seed)
        ink = r.random((24, 60)) < r.choice([0.02, 0.1, 0.3])
        ink[8:14, r.integers(0, 30) : r.integers(30, 60)] = True
        body, dots = G.separate_dots(ink, 8.0)
        own, middles = G.without_dots(ink, 8.0)
        boxes = S.split_body(ink.astype(np.int64), 8.0)
        assert (own == body).all() and len(middles) == sum(d.size for d in dots) == sum(n for *_, n in boxes)
        assert [b[:2] for b in boxes] == S.split_multiscale(body.astype(np.int64), 8.0)
