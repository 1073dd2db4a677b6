"""Nested, scalar, lookup and pixel queries against SQL; whole-image recognition with a made-up recognizer."""

import duckdb
import numpy as np
import pytest

from inkframe import nested_queries
from inkframe.operators import fit, images, png, raster, scan

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(nested_queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    df = nested_queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    near = lambda rows: sorted((tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({nested_queries.ORACLE_SQL[name]})").fetchall()
    assert want and near(df.select(*cols).collect()) == near(want)


def test_every_query_has_sql():
    assert nested_queries.QUERIES.keys() == nested_queries.ORACLE_SQL.keys()


def fake():
    """A made-up recognizer; made anew, as workers cannot import this file."""

    def word(text, confidence, x0, y0, x1, y1):
        return {"text": text, "confidence": confidence, "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}}

    def block(words, x0, y0, x1, y1):
        box = {"x0": x0, "y0": y0, "x1": x1, "y1": y1}
        return {"bbox": box, "paragraphs": [{"lines": [{"bbox": box, "words": words}]}] if words else None}

    class Fake:
        """By mode and kind of image: what a page shows, and what a crop of it shows on a second look."""

        page, sparse, crop = 60.0, 90.0, 95.0
        seen: list = []

        def recognize(self, image, mode, rotate):
            h, w = image.shape[:2]
            self.seen.append((mode, rotate, image.shape))
            if rotate and mode == scan.AUTO:
                k = w / 400  # a preprocessed page is upscaled
                blocks = [block([word("lower", self.page, 0, 200 * k, 50 * k, 220 * k), word(" ", 99, 0, 0, 1, 1)], 0, 200 * k, 60 * k, 220 * k)]
                blocks += [block([word("upper", 88.0, 10 * k, 10 * k, 90 * k, 30 * k), word("right", None, 100 * k, 10 * k, 150 * k, 30 * k)], 10 * k, 10 * k, 150 * k, 30 * k)]
                blocks += [block([], 300 * k, 300 * k, 310 * k, 310 * k), block([], 5, 5, 5, 9)]
                return {"text": " page ", "rotate_radians": 0.0, "blocks": blocks}
            if rotate:
                return {"text": "sparse", "blocks": [block([word("thin", self.sparse, 0, 0, 20, 10)], 0, 0, 20, 10)]}
            return {"text": "", "blocks": [block([word("again", self.crop, 0, 0, w, h)], 0, 0, w, h)]}

        def close(self):
            self.seen.append("closed")

    return Fake


def test_scan_second_looks():
    image = np.full((400, 400, 4), 200, np.uint8)
    tool = fake()()
    tool.seen = []
    text, preprocessed, words = scan.scan_image(tool, image)
    # The raw page (mean 49) is no worse than the preprocessed one, so it stays; regions under 70 are looked at again.
    assert (text, preprocessed) == ("page", False)
    # One word for two is half of them, which is enough.
    assert [(k, w.text, w.confidence) for k, w in words] == [(0, "again", 95.0), (1, "again", 95.0), (2, "again", 95.0)]
    modes = [s[0] for s in tool.seen]
    assert modes[:2] == [scan.AUTO, scan.AUTO] and sorted(modes[2:]) == [scan.BLOCK, scan.LINE, scan.SPARSE][: len(modes) - 2] or set(modes[2:]) <= {scan.BLOCK, scan.LINE, scan.SPARSE}
    boxes = [w.box for _, w in words]
    assert boxes[0] == pytest.approx((4, 4, 156, 36)) and boxes[1] == pytest.approx((0, 194, 66, 226))


def test_scan_keeps_what_is_better():
    image = np.full((400, 400, 4), 200, np.uint8)

    class Worse(fake()):
        crop = 10.0

    _, _, words = scan.scan_image(Worse(), image)
    assert [w.text for _, w in words][:3] == ["upper", "right", "lower"]

    class Blurred(fake()):
        page = 0.0

    text, _, words = scan.scan_image(Blurred(), image)  # mean 29: the sparse pass is better, and no region is under 85
    assert text == "sparse" and [(w.text, w.confidence) for _, w in words] == [("thin", 90.0)]


def test_scan_images(spark):
    good = png.encode(np.full((30, 40, 4), 120, np.uint8))
    rows = [(1, bytearray(good)), (2, bytearray(b"no image")), (3, None)]
    out = {r.scan_id: r for r in scan.scan_images(spark.createDataFrame(rows, "scan_id long, content binary"), fake()).collect()}
    assert out[1].error is None and out[1].words[0].bbox.x1 > 0
    assert out[2].error == out[3].error == "the image cannot be read"
    timed = {r.name: r for r in scan.timed_scan(spark.createDataFrame([("a", bytearray(good)), ("b", None)], "name string, content binary"), fake()).collect()}
    assert timed["a"].elapsed_ms >= 0 and timed["a"].text and timed["b"].error


def test_png(spark):
    r = np.random.default_rng(0)
    image = r.integers(0, 256, (13, 7, 4)).astype(np.uint8)
    assert (png.decode(png.encode(image)) == image).all()
    assert png.decode(b"") is png.decode(None) is png.decode(png.encode(image)[:60]) is None
    # Rows of every filter undo to the same bytes.
    raw = r.integers(0, 256, (5, 12)).astype(np.uint8)
    rows = np.zeros_like(raw)
    for y in range(5):
        for x in range(12):
            a, b = (int(raw[y, x - 3]) if x > 2 else 0), (int(raw[y - 1, x]) if y else 0)
            c = int(raw[y - 1, x - 3]) if x > 2 and y else 0
            p = a + b - c
            near = min((abs(p - v), k) for k, v in enumerate((a, b, c)))[1]
            rows[y, x] = (int(raw[y, x]) - (0, a, b, (a + b) // 2, (a, b, c)[near])[y]) % 256
    assert (png._unfilter(rows, np.arange(5), 3) == raw).all()
    got = {x.scan_id: x for x in images.read_pixels(spark.createDataFrame([(1, bytearray(png.encode(image))), (2, bytearray(b"x"))], "scan_id long, content binary")).collect()}
    assert (got[1].width, got[1].height, bytes(got[1].rgba)) == (7, 13, image.tobytes()) and got[2].rgba is None


def test_inpaint_order():
    """Anti-diagonals give what pixel by pixel in reading order gives."""
    r = np.random.default_rng(3)
    for x, y, w, h in ((3, 2, 5, 4), (0, 0, 4, 3), (8, 7, 4, 3), (0, 0, 12, 10), (5, 5, 1, 1)):
        image = r.integers(0, 256, (10, 12, 4)).astype(np.uint8)
        H, W = image.shape[:2]
        rgb = image[..., :3].astype(float)
        strips = [s for s in (rgb[y - 1, x : x + w] if y else None, rgb[y + h, x : x + w] if y + h < H else None, rgb[y : y + h, x - 1] if x else None, rgb[y : y + h, x + w] if x + w < W else None) if s is not None]
        rgb[y : y + h, x : x + w] = raster.to_byte(np.concatenate(strips).mean(0)) if strips else raster.NO_COLOUR
        for _ in range(7):
            for j in range(y, y + h):
                for i in range(x, x + w):
                    near = [rgb[b, a] for a, b in ((i - 1, j), (i + 1, j), (i, j - 1), (i, j + 1)) if 0 <= a < W and 0 <= b < H]
                    rgb[j, i] = np.rint(np.mean(near, 0))
        assert (raster.inpaint(image, x, y, w, h, sweeps=7)[..., :3] == rgb).all()


def test_flatten():
    image = np.zeros((4, 4, 4), np.uint8)
    image[..., 0] = 50
    draws = [("surface", 0, 0, 8, 8, None, None, None, None), ("image", 0, 0, 8, 8, None, None, None, None), ("patch", 2, 2, 3, 2, None, (1, 2, 3), None, None)]
    draws += [("patch", 6, 6, 9, 9, np.full((2, 2, 4), 9, np.uint8), (1, 2, 3), None, None), ("patch", 0, 0, 4, 4, None, None, None, None), ("word", 1, 1, 0, 0, None, None, "hi", 5)]
    seen = []
    out = png.flatten(8, 8, image, draws, (7, 7, 7), lambda *a: seen.append(a[1:]))
    assert (out[2:4, 2:5, :3] == (1, 2, 3)).all() and (out[6:, 6:, :3] == 9).all() and out[0, 0].tolist() == [50, 0, 0, 255] and seen == [("hi", 1, 1, 5)]
    assert (png.flatten(2, 2, None, draws[:2], (7, 7, 7))[..., :3] == 7).all()
    assert png.result_name("a", "full") == "a-full-image.png" and png.result_name("a", "other") == "a-image-format.png"


def test_both_keystones(spark):
    """The keystone of a crop in a scan and that of tables of lines are one rule."""
    r = np.random.default_rng(12)
    rows, want = [], {}
    for k in range(120):
        n, w, h = int(r.integers(0, 9)), int(r.integers(50, 400)), int(r.integers(50, 400))
        tops = np.sort(r.uniform(0, h, n))
        heights = np.maximum(1.0, r.uniform(5, 20) + tops * r.choice([0.0, 0.05, -0.03]) + r.normal(0, r.choice([0.0, 0.2, 3.0]), n))
        boxes = [scan.Box(0.0, float(t), 10.0, float(t + d)) for t, d in zip(tops, heights, strict=True)]
        if (quad := scan.keystone(boxes, w, h)) is not None:
            want[k] = [c for p in quad for c in p]
        rows += [(k, (b.y0 + b.y1) / 2, b.y1 - b.y0, float(w), float(h)) for b in boxes]
    got = fit.keystones(spark.createDataFrame(rows, "scan_id long, x double, y double, width double, height double"), "scan_id").collect()
    assert want and len(want) < 120 and {g.scan_id: pytest.approx([c for p in g.quad for c in (p.x, p.y)], abs=1e-6) for g in got} == want
