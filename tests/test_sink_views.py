"""Files that appear with the commit, glyphs by their area, and views painted from draw lists."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe import nested_queries as queries
from inkframe.operators import edits, glyphs, images, png
from inkframe.sources import sink


def listing(folder):
    return {n: (folder / n).read_bytes() for n in sorted(os.listdir(folder))} if folder.exists() else None


def rows_of(spark, rows):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in rows], "name string, content binary").repartition(4)


def test_files(spark, tmp_path):
    out = tmp_path / "out"
    sink.save_files(rows_of(spark, [("a.txt", b"1"), ("b c.txt", b""), ("é.png", None)]), out.as_uri())
    assert listing(out) == {"a.txt": b"1", "b c.txt": b"", "é.png": b""}
    sink.save_files(rows_of(spark, [("a.txt", b"2"), ("d", b"4")]), out.as_uri())
    assert listing(out) == {"a.txt": b"2", "b c.txt": b"", "d": b"4", "é.png": b""}
    assert {(r.name, bytes(r.content)) for r in sink.read_files(spark, out.as_uri()).collect()} == {("a.txt", b"2"), ("b c.txt", b""), ("d", b"4"), ("é.png", b"")}
    sink.save_files(rows_of(spark, [("d", b"5")]), out.as_uri(), "overwrite")
    assert listing(out) == {"d": b"5"}
    sink.save_files(rows_of(spark, []), out.as_uri())
    assert listing(out) == {"d": b"5"}


@pytest.mark.parametrize("bad", [[("a", b"1"), ("a", b"2")], [("x/y", b"1")], [("", b"1")], [(None, b"1")], [("_x", b"1")], [("..", b"1")]])
def test_nothing_of_a_failed_job(spark, tmp_path, bad):
    out = tmp_path / "out"
    sink.save_files(rows_of(spark, [("kept", b"0")]), out.as_uri())
    with pytest.raises(Exception):  # noqa: B017  whatever Spark wraps it in
        sink.save_files(rows_of(spark, [(f"n{k}", b"x") for k in range(20)] + bad), out.as_uri())
    assert listing(out) == {"kept": b"0"}


def test_retried_task_leaves_one_file(tmp_path):
    """A task that fails after writing some files runs again: each name once, none of the failed attempt. On a session that retries."""
    code = f"""
import os, sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
import pyarrow as pa
from inkframe.sources import sink
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
def run(it):
    for b in it:
        for k in range(b.num_rows):
            if k == 3 and TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
                raise RuntimeError("lost")
            yield pa.RecordBatch.from_arrays([pa.array([f"f{{b.column(0)[k].as_py()}}"]), pa.array([b"x"], pa.binary())], ["name", "content"])
sink.save_files(spark.range(0, 20, 1, 4).mapInArrow(run, "name string, content binary"), {(tmp_path / "out").as_uri()!r})
"""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    assert listing(tmp_path / "out") == {f"f{k}": b"x" for k in range(20)}


# --- glyphs --------------------------------------------------------------------------------------------------------


def test_coverage_is_area():
    square = np.array([[[2.0, 3.0], [6.0, 3.0], [6.0, 5.0], [2.0, 5.0]]])
    left, top, share = glyphs.coverage(square, 20, 20)
    assert (left, top, share.shape, share.min()) == (2, 3, (2, 4), 1.0)
    half = glyphs.coverage(square + 0.5, 20, 20)[2]
    assert half.sum() == pytest.approx(8) and half[0, 0] == 0.25 and half[0, 1] == 0.5 and half[1, 1] == 1
    triangle = np.array([[[1.0, 1.0], [13.0, 1.0], [1.0, 9.0], [1.0, 9.0]]])
    assert glyphs.coverage(triangle, 20, 20)[2].sum() == pytest.approx(48, rel=0.01)
    assert glyphs.coverage(np.concatenate([square, square]), 20, 20)[2].sum() == 8  # a place counts once
    within = 0.5 * (10 - 2 + 7 - 2) * 2 - (10 - 6 + 7 - 6)  # of the triangle between rows 3 and 5, left of column 6
    assert glyphs.coverage(np.concatenate([square, triangle]), 20, 20)[2].sum() == pytest.approx(48 + 8 - within, rel=0.01)
    assert glyphs.coverage(square - 50, 20, 20)[2].size == glyphs.coverage(square[:0], 20, 20)[2].size == 0
    assert glyphs.coverage(square - (4, 4), 20, 20)[2].sum() == pytest.approx(2)  # what lies in the image


def test_strokes():
    assert len(glyphs.strokes(" ")) == len(glyphs.strokes("\t")) == 0
    assert (glyphs.strokes("é") == glyphs.strokes("e")).all() and len(glyphs.strokes("e")) == len(glyphs.strokes("E"))
    assert (glyphs.strokes("日") == glyphs.strokes("\U0001f600")).all()
    for c in map(chr, range(33, 127)):
        p = glyphs.strokes(c)
        assert len(p) and p[:, [0, 2]].min() >= 0.5 and p[:, [0, 2]].max() <= 4.5 and p[:, [1, 3]].min() >= 0.5 and p[:, [1, 3]].max() <= 6.5, c
    shapes = {c: str(glyphs.coverage(glyphs.outlines(c, 0, 0, 32), 32, 32)[:2]) + glyphs.coverage(glyphs.outlines(c, 0, 0, 32), 32, 32)[2].tobytes().hex() for c in map(chr, [*range(33, 97), *range(123, 127)])}
    assert len(set(shapes.values())) == len(shapes)  # all tell apart


def test_paint():
    page = np.full((40, 100, 4), 255, np.uint8)
    glyphs.paint(page, "-", 10, 4, 32, (0, 0, 0))  # one stroke, two units long and 0.7 wide with its ends
    assert (255 - page[..., 0].astype(float)).sum() / 255 == pytest.approx((2 + 0.7) * 4 * 0.7 * 4, rel=0.04)
    ink = np.argwhere(page[..., 0] < 255)
    assert ink[:, 0].min() >= 4 and ink[:, 1].min() >= 10
    same = np.full((40, 100, 4), 255, np.uint8)
    for font in (None, 0, -3, float("nan")):
        glyphs.paint(same, "x", 1, 1, font)
    glyphs.paint(same, "x" * 100_000, 500, 1, 12)
    assert (same == 255).all()
    # A long text left of the image shows what of it reaches in.
    a, b = np.full((20, 60, 4), 255, np.uint8), np.full((20, 60, 4), 255, np.uint8)
    step = glyphs.ADVANCE * 16 / glyphs.HEIGHT
    glyphs.paint(a, "ab" * 5000, -9990 * step, 2, 16)
    glyphs.paint(b, "abababababab", -2 * step, 2, 16)
    assert (a == b).all() and (a < 255).any()


# --- views ---------------------------------------------------------------------------------------------------------


def test_views(spark):
    page = np.full((50, 100, 4), 255, np.uint8)
    page[..., :3] = 200
    page[10:14, 20:40, :3] = 0  # a word, one to be deleted
    page[30:34, 20:40, :3] = 60  # a word, one to be moved
    none = (None,) * 5
    objects = [
        (1, "obj-bg", 0, "image", "ocr", 0.0, 0.0, 100.0, 100.0, None, 0.0, 0.0, 100.0, 100.0, *none, False, None),
        (1, "obj-1", 1, "word", "ocr", 20.0, 20.0, 20.0, 8.0, 3.0, 20.0, 20.0, 20.0, 8.0, "", "word", 90.0, 0, None, False, None),
        (1, "obj-2", 2, "word", "ocr", 50.0, 80.0, 20.0, 8.0, 8.0, 20.0, 60.0, 20.0, 8.0, "go", "go", 90.0, 1, None, False, "rgb(9, 8, 7)"),
        (1, "obj-3", 3, "word", "ocr", 60.0, 20.0, 20.0, 8.0, 8.0, 60.0, 20.0, 20.0, 8.0, "stays", "stays", 90.0, 0, None, False, None),
    ]
    schema = "scan_id long, id string, ordinal int, type string, origin string, x double, y double, w double, h double, font_size_pct double, original_x double, original_y double, original_w double, original_h double, text string, original_text string, confidence double, line_index int, other int, low_confidence boolean, patch_colour string"
    o = spark.createDataFrame(objects, schema)
    pages = spark.createDataFrame([(1, bytearray(png.encode(page))), (2, bytearray(b"x"))], "scan_id long, content binary")
    sizes = spark.createDataFrame([(1, 100.0, 50.0)], "scan_id long, width double, height double")
    patches = images.inpainted_patches(o.where("id = 'obj-1'"), pages)
    draws = edits.draw_list(o, sizes, patches=patches)
    assert [(r.kind, r.colour, r.patch is not None) for r in draws.orderBy("z").collect()] == [("surface", None, False), ("image", None, False), ("patch", None, True), ("patch", "rgb(9, 8, 7)", False), ("word", None, False)]
    got = {r.scan_id: r.content for r in images.views(draws, pages).collect()}
    assert got.keys() == {1, 2} and got[2] is None
    view = png.decode(bytes(got[1]))
    assert (view[10:14, 20:40, :3] == 200).all() and (view[30:34, 20:40, :3] == (9, 8, 7)).all()
    want = page.copy()
    want[10:14, 20:40, :3], want[30:34, 20:40, :3] = 200, (9, 8, 7)
    glyphs.paint(want, "go", 50, 40, 8)
    assert (view == want).all() and (want[40:, 50:70, 0] < 60).any()
    # The other mode: no image and no patches, every word with text.
    plain = png.decode(bytes({r.scan_id: r.content for r in images.views(edits.draw_list(o, sizes, "image"), pages).collect()}[1]))
    assert (plain[10:14, 20:40, :3] == 255).all() and (plain[10:, 60:90, 0] < 255).any()
    # An image object of its own place.
    half = o.withColumn("x", F.when(F.col("type") == "image", 50.0).otherwise(F.col("x"))).withColumn("w", F.when(F.col("type") == "image", 50.0).otherwise(F.col("w"))).where("type = 'image'")
    moved = png.decode(bytes({r.scan_id: r.content for r in images.views(edits.draw_list(half, sizes), pages).collect()}[1]))
    assert (moved[:, :50, :3] == 255).all() and (moved[:5, 50:, :3] == 200).all()


def test_painted(spark):
    """As views over inpainted_patches, in whole scans whatever the batches are; an image is met once and moved alone."""
    rng = np.random.default_rng(5)
    pages, objects = [], []
    for scan in range(1, 6):
        page = np.full((40, 60, 4), 255, np.uint8)
        page[..., :3] = rng.integers(0, 256, 3) if scan % 2 else rng.integers(0, 256, (40, 60, 3))
        pages.append((scan, bytearray(png.encode(page))))
        objects.append((scan, "obj-bg", 0, "image", "ocr", 0.0, 0.0, 100.0, 100.0, None, 0.0, 0.0, 100.0, 100.0, None, None, None, None))
        for k in range(1, 9):
            x, y, w, h = (float(v) for v in rng.uniform(-5, 110, 4) * (1, 1, 0.3, 0.2))
            objects.append((scan, f"obj-{k}", k, "word", "ocr", x, y, w, h, 8.0, x, y, w, h, "go" if k == 8 else "", "word", 90.0, k))
    schema = "scan_id long, id string, ordinal int, type string, origin string, x double, y double, w double, h double, font_size_pct double, original_x double, original_y double, original_w double, original_h double, text string, original_text string, confidence double, line_index int"
    o, pages = spark.createDataFrame(objects, schema), spark.createDataFrame([*pages, (9, bytearray(b"x"))], "scan_id long, content binary")
    sizes = pages.select("scan_id", F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r.scan_id: bytes(r.content) for r in images.painted(edits.draws(o.withColumn("width", F.lit(60.0)).withColumn("height", F.lit(40.0))), pages).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    patches = images.inpainted_patches(o.where("type = 'word'"), pages)
    want = {r.scan_id: r.content for r in images.views(edits.draw_list(o, sizes, patches=patches), pages).collect()}
    assert got.keys() == {1, 2, 3, 4, 5} and all(got[k] == bytes(want[k]) for k in got)


def test_pages_of_saved_views_are_made_once(spark, tmp_path):
    made = []
    spark.range(3).selectExpr("id AS doc_id", "concat('ab cd ef gh ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    own, queries.nested.page_files = queries.nested.page_files, lambda *a: made.append(1) or own(*a)
    plans, save = [], queries.sink.save_files
    queries.sink.save_files = lambda rows, to: plans.append(rows._jdf.queryExecution().toString()) or save(rows, to)
    try:
        assert queries.QUERIES["saved_views"](spark, str(tmp_path)).count() == 3 and made == [1]
    finally:
        queries.nested.page_files, queries.sink.save_files = own, save
    assert plans[0].split("== Physical Plan ==")[1].count("MapInPandas") == 1
