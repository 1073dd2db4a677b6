from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe import queries
from inkframe.operators import edits, evaluate, fit, layout, order, passes, png, raster, versions
from inkframe.sources import files

SF = "/root/testdata/sf0.001"
WORDS = "scan_id long, pos int, line_index int, text string, confidence double"


def text(spark, rows, level):
    df = spark.createDataFrame([(1, k, i, t, 90.0) for k, (i, t) in enumerate(rows)], WORDS)
    got = layout.words_to_text(df, level).collect()
    return got[0].text if got else ""


@pytest.mark.parametrize(("rows", "raw", "filtered"), [([(0, "a"), (0, "b"), (1, "c")], "a b\nc", "a b\nc"), ([(0, "a"), (1, "--"), (2, "b")], "a\n--\nb", "a\nb"), ([(0, "a"), (1, "--"), (0, "b")], "a\n--\nb", "a\nb"), ([], "", "")])
def test_lines(spark, rows, raw, filtered):
    assert text(spark, rows, "raw") == raw
    assert text(spark, rows, "filtered") == filtered


def test_nested(spark):
    box = (0.0, 0.0, 10.0, 5.0)
    blocks = [(box, [([(box, [(" a ", 50.0, box), ("  ", 9.0, box), ("b", None, (1.0, 1.0, 2.0, 2.0))])],), (None,)]), ((0.0, 0.0, 0.0, 0.0), []), ((5.0, 5.0, 9.0, 9.0), None)]
    pages = spark.createDataFrame([(1, "raw", blocks)], f"scan_id long, pass string, blocks {layout.BLOCKS}")
    r = layout.extract_regions(pages).orderBy("block_no").collect()
    assert [(x.block_no, x.n_words, x.mean_confidence) for x in r] == [(0, 2, 25.0), (2, 0, 0.0)]
    w = layout.flatten_regions(layout.extract_regions(pages).withColumn("rank", F.col("block_no"))).collect()
    assert [(x.pos, x.line_index, x.text) for x in w] == [(0, 0, "a"), (1, 0, "b")]
    el = [([([("x", (0.0, 0.0, 1.0, 1.0)), (" ", None)],), ([],), ([("y", None)],)],)]
    ml = layout.flatten_blocks(spark.createDataFrame([(1, el)], f"scan_id long, blocks {layout.ELEMENTS}")).orderBy("pos").collect()
    assert [(x.line_index, x.text, x.confidence) for x in ml] == [(0, "x", 100.0), (1, "y", 100.0)]


def test_selection_of_passes(spark):
    c = spark.createDataFrame([(1, 0, 50.0), (1, 1, 50.0)], "scan_id long, ordinal int, mean_confidence double")
    assert passes.best_candidate(c, "scan_id").first().ordinal == 0
    old = spark.createDataFrame([(1, k, 4, 60.0) for k in range(4)], "scan_id long, block_no int, n_words int, mean_confidence double")
    new = spark.createDataFrame([(1, 0, 2, 61.0), (1, 1, 1, 99.0), (1, 2, 4, 60.0)], "scan_id long, block_no int, n_words int, mean_confidence double")
    assert [r.accepted for r in passes.accept_regions(old, new).orderBy("block_no").collect()] == [True, False, False, False]
    area = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 0.0, 79.0, 10.0), (1, 1, 0, 0.0, 0.0, 0.0, 80.0, 10.0)], "scan_id long, block_no int, n_words int, mean_confidence double, x0 double, y0 double, x1 double, y1 double")
    area = area.withColumn("image_width", F.lit(100.0)).withColumn("image_height", F.lit(100.0))
    assert [r.block_no for r in passes.weakest_regions(area).collect()] == [0]


def test_fit(spark):
    p = spark.createDataFrame([("y", 1.0, 5.0), ("y", 2.0, 5.0), ("x", 1.0, 2.0), ("x", 1.0, 4.0), ("l", 0.0, 1.0), ("l", 1.0, 3.0)], "k string, x double, y double")
    got = {r.k: (r.slope, r.intercept, r.r2) for r in fit.linear_fit(p, "k").collect()}
    assert got["y"] == (0, 5, 0) and got["x"] == (0, 3, 0) and got["l"] == pytest.approx((2, 1, 1))


def test_reading_order_and_homography(spark):
    r = spark.createDataFrame([(1, 0, 50.0, 0.0, 60.0, 10.0), (1, 1, 10.0, 0.0, 20.0, 10.0), (1, 2, 0.0, 100.0, 9.0, 110.0)], "scan_id long, block_no int, x0 double, y0 double, x1 double, y1 double")
    assert [x.block_no for x in order.reading_order(r).orderBy("rank").collect()] == [1, 0, 2]
    a, b = np.array([[0, 0], [4, 0], [4, 3], [0, 3]], float), np.array([[1, 1], [9, 2], [8, 7], [0, 6]], float)
    h = order.solve_homography(a, b)
    z = np.c_[a, np.ones(4)] @ h.reshape(3, 3).T
    assert np.allclose(z[:, :2] / z[:, 2:], b)
    assert order.solve_homography(np.zeros((4, 2)), b) is None


def test_edits(spark):
    words = spark.createDataFrame([(1, 0, 0, "one", 90.0, (0.0, 0.0, 10.0, 10.0)), (1, 1, 0, "--", 90.0, (20.0, 0.0, 30.0, 10.0))], WORDS + ", bbox " + layout.BBOX)
    images = spark.createDataFrame([(1, 100.0, 50.0)], "scan_id long, width double, height double")
    o = edits.render(words, images)
    assert {r.id for r in o.collect()} == {"obj-1", "obj-2", "obj-bg"}
    back = spark.createDataFrame([(1, 0, None, None, None, None)], "scan_id long, ordinal int, line_index int, text string, confidence double, bbox " + layout.BBOX)
    own = back.unionByName(words.withColumn("ordinal", (F.col("pos") + 1).cast("int")).drop("pos")).join(images, "scan_id")
    assert sorted(map(str, edits.render_numbered(own).select(*o.columns).collect())) == sorted(map(str, o.collect()))
    moved = o.withColumn("x", F.col("x") + F.when(F.col("id") == "obj-1", 0.009).otherwise(0.02))
    assert {r.id: r.modified for r in edits.refresh(moved.where("type = 'word'")).collect()} == {"obj-1": False, "obj-2": True}
    added = spark.createDataFrame([(1, 1.0, 1.0, "mine", 0), (1, 1.0, 1.0, " ", 1)], "scan_id long, x double, y double, text string, seq int")
    more = edits.add_user_text(o, fit.median_font(o, images), images, added)
    assert more.where("origin = 'user'").count() == 1
    assert layout.active_text(more, None).first().text == "one\nmine"
    pick = spark.createDataFrame([(1, "obj-3"), (1, "obj-1"), (1, "obj-bg")], "scan_id long, id string")
    left = {r.id: r.text for r in edits.delete_selected(more, pick).collect()}
    assert left == {"obj-1": "", "obj-2": "--", "obj-bg": None}
    ev = [(1, k, kind, v) for k, (kind, v) in enumerate([("push", 1), ("push", 2), ("undo", None), ("redo", None), ("undo", None), ("push", 3), ("redo", None), ("focus", None), ("blur", 3)])]
    h = edits.history(spark.createDataFrame(ev, "scan_id long, seq long, kind string, version long")).orderBy("seq").collect()
    assert [r.version for r in h] == [1, 2, 1, 2, 1, 3, 3, 3, 3] and h[-1].undo_depth == 2


def test_report(spark):
    refs = spark.createDataFrame([("a", "x y"), ("b", "x")], "name string, text string")
    lines = [r.line for r in evaluate.report(evaluate.evaluate(refs.where("name = 'a'"), refs)).orderBy("name").collect()]
    assert lines == ["a".ljust(15) + "   0.0%     0.0%   0.0s", "b".ljust(15) + " ERROR: no result"]


def test_raster(spark):
    rng = np.random.default_rng(0)
    im = rng.integers(0, 255, (40, 60, 4), dtype=np.uint8)
    assert raster.edges(np.full((5, 5), 7, np.uint8)).min() == 255
    assert raster.preprocess_page(im)[1] and raster.preprocess_page(np.zeros((0, 0, 4), np.uint8)) [0].shape == (1, 1)
    out, _ = raster.warp(im, [(0, 0), (60, 0), (60, 40), (0, 40)], 60, 40)
    assert (out[:, :, :3] == im[:, :, :3]).all()
    flat = np.full((30, 30, 4), 90, np.uint8)
    flat[10:20, 10:20] = 0
    assert (raster.patch(flat, 10, 10, 10, 10)[..., :3] == 90).all()
    assert raster.patch(flat, 50, 50, 5, 5) is None and raster.near_colour(flat, 10, 10, 10, 10) == "rgb(90, 90, 90)"
    df = spark.createDataFrame([(1, 60, 40, bytearray(im.tobytes())), (2, 3, 3, None)], "scan_id long, width int, height int, rgba binary")
    assert [r.preprocessed for r in raster.preprocess_images(df).orderBy("scan_id").collect()] == [True, False]


def test_sources(spark, tmp_path):
    class Fake:  # local, so that workers get it by value
        def recognize(self, image, mode, rotate):
            if image.shape[0] == 3:
                raise ValueError("no page")
            return {"text": f"hi {mode} {rotate}", "blocks": [], "rotate_radians": 0.0}

        def close(self):
            pass

    (tmp_path / "a.png").write_bytes(b"x")
    (tmp_path / "b.txt").write_text("t\nu")
    assert {r.mime: r.error for r in files.read_images(spark, str(tmp_path)).collect()} == {"image/png": None, "application/octet-stream": "type"}
    assert files.read_ground_truth(spark, str(tmp_path)).first() == ("b", "t\nu")
    sizes = spark.createDataFrame([("image/png", 15728640), ("image/png", 15728641), ("text/plain", 1)], "m string, n long")
    assert [r[0] for r in sizes.select(files.rejection(F.col("m"), F.col("n"))).collect()] == [None, "size", "type"]
    page = lambda h: bytearray(png.encode(np.zeros((h, 5, 4), np.uint8)))
    im = spark.createDataFrame([(1, page(4)), (2, page(3)), (3, bytearray(b"bad"))], "scan_id long, content binary")
    got = [(r.width, r.height, r.text, r.error) for r in files.recognize(im, Fake).orderBy("scan_id").collect()]
    assert got == [(5, 4, "hi 3 True", None), (None, None, None, "no page"), (None, None, None, "the image cannot be read")]
    assert [r.text for r in files.dispatch(im.where("scan_id = 1"), "native", Fake, None).collect()] == ["hi 3 True"]


def test_sample(spark):
    rows = files.sample_page(spark).orderBy("line_index").collect()
    page = png.decode(bytes(rows[0].content))
    assert page.shape == (220, 640, 4) and [r.text for r in rows] == [t for t, *_ in files.SAMPLE_LINES]
    for _, x, y, font in files.SAMPLE_LINES:
        assert (page[y : y + int(font), x : x + 40, 0] < 128).any()
    assert (page[:, :30] == 255).all()


def test_benchmark(spark, tmp_path):
    """Folders in, report lines out: a good page, a wrong one, a damaged one, a missing one, one that is no image."""

    class Fake:
        def recognize(self, image, mode, rotate):
            k, box = int(image[0, 0, 0]), {"x0": 0.0, "y0": 0.0, "x1": 4.0, "y1": 2.0}
            words = [{"text": t, "confidence": 99.0, "bbox": box} for t in (["two", "words"] if k == 1 else ["too", "words"])]
            return {"text": "two words", "rotate_radians": 0.0, "blocks": [{"bbox": box, "paragraphs": [{"lines": [{"bbox": box, "words": words}]}]}]}

        def close(self):
            pass

    truths, folder = tmp_path / "truth", tmp_path / "images"
    truths.mkdir(), folder.mkdir()
    for name in ("good", "wrong", "damaged", "missing", "text"):
        (truths / f"{name}.txt").write_text("two words\n")
    for name, k in (("good.png", 1), ("wrong.png", 2), ("extra.png", 1)):
        (folder / name).write_bytes(png.encode(np.full((300, 300, 4), k, np.uint8)))
    (folder / "damaged.jpeg").write_bytes(b"\xff\xd8\xff no picture")
    (folder / "text.html").write_text("<p>")
    lines = {r.name: r.line for r in files.benchmark(spark, str(truths), str(folder), Fake).collect()}
    assert lines.keys() == {"good", "wrong", "damaged", "missing", "text"}
    assert lines["good"].startswith("good              0.0%     0.0%   ") and lines["good"].endswith("s")
    assert lines["wrong"].startswith("wrong            11.1%    50.0%   ")
    assert lines["damaged"] == "damaged         ERROR: the image cannot be read" and lines["missing"] == "missing         ERROR: no result" and lines["text"].endswith("ERROR: type")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    near = lambda rows: sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert near(df.select(*cols).collect()) == near(want)


def test_eval_report_lines(spark):
    """Whole lines: rates and seconds as the reference's toFixed(1) gives them."""
    fixed = lambda v: str(Decimal(v).quantize(Decimal("0.1"), ROUND_HALF_UP))
    rates = {r.item_id: [r.cer] for r in queries.QUERIES["cer_pairs"](spark, SF).collect()}
    for r in queries.QUERIES["wer_pairs"](spark, SF).collect():
        rates[r.item_id].append(r.wer)
    want = []
    for i, (cer, wer) in rates.items():
        good = f"{fixed(cer * 100).rjust(5)}%   {fixed(wer * 100).rjust(5)}%   {fixed(i * 125 / 1000)}s"
        want.append(f"item{i}".ljust(15) + " " + ("ERROR: no result" if i % 10 == 3 else good))
    assert sorted(r.line for r in queries.QUERIES["eval_report"](spark, SF).collect()) == sorted(want)


def test_keystone_all_lines(spark):
    """Every line of a document is fitted, and the quad reaches its last line: brute force over the texts."""
    fits, quads = {}, {}
    for d, t in duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet') WHERE text IS NOT NULL").fetchall():
        rows = [(i, [len(w) for w in line.split(" ") if w]) for i, line in enumerate(t.split("\n"))]
        rows = [(i, max(12 + n % 5 for n in ns)) for i, ns in rows if ns]
        if not rows:
            continue
        i, h = np.array(rows, float).T
        x, y = i * 20 + h / 2, h + 2 * i
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum() if x.var() else 0.0
        at0 = y.mean() - slope * x.mean()
        r2 = 1 - ((y - at0 - slope * x) ** 2).sum() / ((y - y.mean()) ** 2).sum() if x.var() and y.var() else 0.0
        fits[d] = (len(rows), slope, at0, r2)
        top, bottom = at0, at0 + slope * max(300.0, (i * 20 + h).max())
        if len(rows) >= 3 and r2 >= 0.6 and top > 0 and bottom > 0 and (change := abs(bottom - top) / max(top, bottom)) >= 0.15:
            inset = 800 * min(0.4, change)
            a, b = (inset, 0.0) if bottom > top else (0.0, inset)
            quads[d] = (a, 1600 - a, 1600 - b, b)
    assert max(n for n, *_ in fits.values()) > 12
    got = {r.scan_id: (r.n, r.slope, r.intercept, r.r2) for r in queries.QUERIES["keystone_fit"](spark, SF).collect()}
    assert got.keys() == fits.keys() and all(got[d] == pytest.approx(fits[d], abs=1e-3) for d in got)
    got = {r.scan_id: (r.x0, r.x1, r.x2, r.x3) for r in queries.QUERIES["keystone_quad"](spark, SF).collect()}
    assert got.keys() == quads.keys() and all(got[d] == pytest.approx(quads[d], abs=1e-3) for d in got)


def test_versions(spark):
    """Every version of random edits comes back, from snapshots at once or one by one, and storage grows with the changes."""
    import random

    r, state, rows = random.Random(9), {(s, f"obj-{k}"): ("t", float(k)) for s in (1, 2) for k in range(30)}, []
    for v in range(8):
        for _ in range(3 if v else 0):
            key = (r.choice((1, 2)), f"obj-{r.randint(0, 34)}")
            kind = r.random()
            if kind < 0.3:
                state.pop(key, None)
            else:
                state[key] = (r.choice(["t", "u", None]), float(r.randint(0, 3)))
        rows += [(s, v, i, t, x) for (s, i), (t, x) in state.items()]
    schema = "scan_id long, version long, id string, text string, `a.x` double"
    every = spark.createDataFrame(rows, schema)
    one = versions.from_snapshots(every)
    two = versions.from_snapshots(every.where("version < 3"))
    for v in range(3, 8):
        two = versions.commit(two, every.where(f"version = {v}").drop("version"), v)
    two = spark.createDataFrame(two.collect(), two.schema)
    for store in (one, two):
        for v in range(8):
            got = sorted((tuple(g) for g in versions.as_of(store, v).select("scan_id", "id", "text", "`a.x`").collect()), key=str)
            assert got == sorted(((s, i, t, x) for s, w, i, t, x in rows if w == v), key=str)
    order = lambda d: sorted(map(str, d.select("scan_id", "id", "text", "`a.x`", "valid_from", "valid_to").collect()))
    assert order(one) == order(two) and one.count() <= 60 + 7 * 3 < len(rows)
    # Each scan its own version, and an object that comes back after it went.
    mixed = versions.as_of(one, F.when(F.col("scan_id") == 1, 2).otherwise(5)).groupBy("scan_id").count()
    assert {g.scan_id: g["count"] for g in mixed.collect()} == {s: sum(1 for x in rows if x[:2] == (s, v)) for s, v in ((1, 2), (2, 5))}
    gone = spark.createDataFrame([(1, 0, "a", "t", 1.0), (1, 0, "b", "t", 1.0), (1, 1, "b", "t", 1.0), (1, 2, "a", "t", 1.0), (1, 2, "b", "t", 1.0)], schema)
    assert sorted((g.id, g.valid_from, g.valid_to) for g in versions.from_snapshots(gone).collect()) == [("a", 0, 1), ("a", 2, None), ("b", 0, None)]
    assert versions.from_snapshots(gone.limit(0)).count() == 0
    kept = versions.commit(versions.from_snapshots(gone), gone.where("id = 'none'").drop("version"), 3)  # a commit without this scan
    assert kept.where("valid_to IS NULL").count() == 2
    emptied = versions.commit(versions.from_snapshots(gone), gone.where("id = 'none'").drop("version"), 3, gone.select("scan_id"))  # all its objects went
    assert emptied.where("valid_to IS NULL").count() == 0 and versions.as_of(emptied, 2).count() == 2


def test_marquee_pairs(spark):
    """The grid gives what the theta join gives: touching edges, boxes over many cells, beyond the page, and none twice."""
    import random

    r = random.Random(10)
    box = lambda most: (r.choice([-30.0, 0.0, 6.25, 12.5, 99.0, 100.0, r.uniform(-20, 130), 20_000.0]), r.choice([0.0, 6.25, 25.0, r.uniform(-20, 130)]), r.choice([0.0, 6.25, r.uniform(0, most)]), r.choice([0.0, 6.25, r.uniform(0, most)]))
    objects = [(s, f"o{k}", "image" if k == 0 else "word", *box(40)) for s in (1, 2) for k in range(80)] + [(1, "null", "word", None, 1.0, 1.0, 1.0), (1, "nan", "word", float("nan"), 1.0, 1.0, 1.0), (1, "turned", "word", 10.0, 1.0, -5.0, 1.0)]
    marquees = [(s, k, x, y, x + w, y + h) for s in (1, 2) for k in range(40) for x, y, w, h in [box(60)]]
    o = spark.createDataFrame(objects, "scan_id long, id string, type string, x double, y double, w double, h double")
    m = spark.createDataFrame(marquees, "scan_id long, marquee_id long, left double, top double, right double, bottom double")
    for editor in (False, True):
        want = sorted((s, k, i) for s, i, kind, x, y, w, h in objects if x is not None and (editor or kind == "word") for t, k, a, b, c, d in marquees if s == t and w >= 0 and x <= c and x + w >= a and y <= d and y + h >= b)
        for cells in (4, 16):
            assert sorted(map(tuple, fit.marquee_pairs(o, m, editor, cells).collect())) == want
    # Small boxes all over the page meet what is near alone: far fewer candidates than all pairs.
    grid = spark.range(10_000).selectExpr("1L AS scan_id", "cast(id AS string) AS id", "'word' AS type", "cast(id % 100 AS double) AS x", "cast(id div 100 AS double) AS y", "0.5D AS w", "0.5D AS h")
    many = spark.range(400).selectExpr("1L AS scan_id", "id AS marquee_id", "cast(id % 20 * 5 AS double) AS left", "cast(id div 20 * 5 AS double) AS top", "id % 20 * 5 + 1D AS right", "id div 20 * 5 + 1D AS bottom")
    pairs = fit.marquee_pairs(grid, many)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert pairs.count() == 400 * 4 and "cx" in plan


def test_versions_within_objects(spark):
    """Histories of objects that hold their snapshots are the intervals of the same snapshots as a table."""
    rng = np.random.default_rng(3)
    of = {1: [0, 1, 2, 5], 2: [1, 3], 3: [0, 2]}
    held = {(s, f"o{k}"): [(v, int(rng.integers(0, 2)) or None) for v in vs if rng.random() < 0.7] for s, vs in of.items() for k in range(12)}
    held |= {(s, "all"): [(v, 1) for v in vs] for s, vs in of.items()}
    last = {k: int(rng.integers(0, 2)) or None for k in held if rng.random() < 0.7}
    every = spark.createDataFrame([(s, o, v, x) for (s, o), own in held.items() for v, x in own], "scan_id long, id string, version long, x int")
    store = versions.from_snapshots(every)
    scans = spark.createDataFrame([(1,), (3,)], "scan_id long")
    more = spark.createDataFrame([(*k, x) for k, x in last.items() if k[0] != 2 or k[1] < "o3"], "scan_id long, id string, x int")
    rows = [(s, o, [(v, (x,)) for v, x in own], of[s], (last[s, o],) if (s, o) in last and (s != 2 or o < "o3") else None) for (s, o), own in held.items()]
    objects = spark.createDataFrame(rows, "scan_id long, id string, s array<struct<version: long, value: struct<x: int>>>, vs array<long>, n struct<x: int>")
    one = versions.with_history(objects, F.col("s"), F.col("vs"))
    two = versions.with_version(one, F.col("n"), 7, F.col("scan_id") != 2)
    flat = lambda d: sorted(map(tuple, d.select("scan_id", "id", F.explode("history").alias("r")).select("scan_id", "id", "r.value.x", "r.valid_from", "r.valid_to").collect()), key=str)
    table = lambda d: sorted(map(tuple, d.select("scan_id", "id", "x", "valid_from", "valid_to").collect()), key=str)
    store2 = versions.commit(store, more, 7, scans)
    assert flat(one) == table(store) and flat(two) == table(store2)
    for v in (0, 2, 3, 7):
        got = versions.values_as_of(two, F.col("scan_id") * 0 + v).select("scan_id", "id", "value.x").collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, versions.as_of(store2, v).select("scan_id", "id", "x").collect()), key=str)
