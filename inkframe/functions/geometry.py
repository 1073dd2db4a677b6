"""Geometry of boxes, crops and homographies as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions.text import half_up

#: Font share of a box's height, crop margin, upscale targets and limits (page, region).
FONT_SHARE, CROP_MARGIN = 0.8, 6
UPSCALE = {"page": (1000.0, 2.0), "region": (200.0, 4.0)}


def clamp(v: Column, low, high) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    return F.when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.least(F.greatest(v, lo), hi))


def clamp_position(v: Column, size: Column) -> Column:
    return clamp(v, 5 - size, 95)


def percent_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    w, h = F.greatest(x1 - x0, F.lit(1.0)), F.greatest(y1 - y0, F.lit(1.0))
    return F.struct((x0 / width * 100).alias("x"), (y0 / height * 100).alias("y"), (w / width * 100).alias("w"), (h / height * 100).alias("h"), (h / width * 100 * FONT_SHARE).alias("font_size_pct"))


def pixel_box(x: Column, y: Column, w: Column, h: Column, font: Column, width: Column, height: Column) -> Column:
    return F.struct((x / 100 * width).alias("px"), (y / 100 * height).alias("py"), (w / 100 * width).alias("pw"), (h / 100 * height).alias("ph"), (font / 100 * width).alias("font_px"))


def rotate(x: Column, y: Column, cx: Column, cy: Column, angle: Column) -> tuple[Column, Column]:
    c, s = F.cos(angle), F.sin(angle)
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def _hull(points: list[tuple[Column, Column]], scale: Column) -> Column:
    xs, ys = zip(*points, strict=True)
    return F.struct((F.least(*xs) / scale).alias("x0"), (F.least(*ys) / scale).alias("y0"), (F.greatest(*xs) / scale).alias("x1"), (F.greatest(*ys) / scale).alias("y1"))


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> list[tuple[Column, Column]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def unrotate_box(x0, y0, x1, y1, width: Column, height: Column, natural_width: Column, radians: Column) -> Column:
    """Box of a rotated, scaled page in natural pixels: corners turned back about the centre, hull, over the scale of the width."""
    pts = [rotate(x, y, width / 2, height / 2, -radians) for x, y in corners(x0, y0, x1, y1)]
    return _hull(pts, width / natural_width)


def crop_box(x0, y0, x1, y1, width: Column, height: Column, margin: int = CROP_MARGIN) -> Column:
    """Whole pixels around a box, clipped to the image; null where nothing is left."""
    left, top = F.greatest(F.floor(x0) - margin, F.lit(0)), F.greatest(F.floor(y0) - margin, F.lit(0))
    right, bottom = F.least(F.ceil(x1) + margin, width.cast("long")), F.least(F.ceil(y1) + margin, height.cast("long"))
    return F.when((right > left) & (bottom > top), F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h")))


def upscale(w: Column, h: Column, kind: str) -> Column:
    target, most = UPSCALE[kind]
    short = F.least(w, h).cast("double")
    return F.when(short < target, F.least(F.lit(most), target / short)).otherwise(1.0)


def apply_homography(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """m: nine coefficients, row by row."""
    z = m[6] * x + m[7] * y + m[8]
    return (m[0] * x + m[1] * y + m[2]) / z, (m[3] * x + m[4] * y + m[5]) / z


def region_word_box(x0, y0, x1, y1, scale: Column, crop_x: Column, crop_y: Column, unwarp: Column | None = None) -> Column:
    """A word box found in an upscaled, perhaps straightened crop, in page pixels."""
    pts = [(x / scale, y / scale) for x, y in corners(x0, y0, x1, y1)]
    if unwarp is not None:
        pts = [apply_homography(unwarp, x, y) for x, y in pts]
    return _hull([(x + crop_x, y + crop_y) for x, y in pts], F.lit(1.0))


def segmentation_mode(n_words: Column, crop_w: Column, crop_h: Column) -> Column:
    return F.when(n_words == 0, 11).when(crop_w / crop_h > 6, 7).otherwise(6)


def inpaint_margin(w: Column, h: Column) -> Column:
    return F.least(F.greatest(half_up(F.least(w, h) * 0.75), F.lit(8)), F.lit(40)).cast("int")


def inpaint_boxes(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Crop around a box with its margin, and the box within the crop, its edges rounded; null for a box without width or height, or when nothing is left."""
    m = inpaint_margin(w, h)
    cl, ct = F.greatest(F.floor(x) - m, F.lit(0)), F.greatest(F.floor(y) - m, F.lit(0))
    cw, ch = F.least(F.ceil(x + w) + m, width.cast("long")) - cl, F.least(F.ceil(y + h) + m, height.cast("long")) - ct
    left, top = F.greatest(half_up(x - cl), F.lit(0)), F.greatest(half_up(y - ct), F.lit(0))
    right, bottom = F.least(half_up(x + w - cl), cw), F.least(half_up(y + h - ct), ch)
    some = (w > 0) & (h > 0) & (cw > 0) & (ch > 0) & (right > left) & (bottom > top)
    return F.when(some, F.struct(cl.alias("x"), ct.alias("y"), cw.alias("w"), ch.alias("h"), left.alias("mask_x"), top.alias("mask_y"), (right - left).alias("mask_w"), (bottom - top).alias("mask_h")))


def place_inpaint_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """boxes (x, y, w, h, and other columns) with the fields of inpaint_boxes in their place; those without are left out.

    Each step is a column of its own, and the last goes through a generator: as one expression the first steps would be
    worked out again for each field and for the filter.
    """
    others = [c for c in boxes.columns if c not in ("x", "y", "w", "h")]
    x, y, w, h, m = (F.col(c) for c in ("x", "y", "w", "h", "__m"))
    cl, ct, cw, ch = (F.col(c) for c in ("__cl", "__ct", "__cw", "__ch"))
    left, top, right, bottom = (F.col(c) for c in ("__l", "__t", "__r", "__b"))
    d = boxes.withColumn("__m", inpaint_margin(w, h))
    d = d.withColumns({"__cl": F.greatest(F.floor(x) - m, F.lit(0)), "__ct": F.greatest(F.floor(y) - m, F.lit(0))})
    d = d.withColumns({"__cw": F.least(F.ceil(x + w) + m, width.cast("long")) - cl, "__ch": F.least(F.ceil(y + h) + m, height.cast("long")) - ct})
    d = d.withColumns({"__l": F.greatest(half_up(x - cl), F.lit(0)), "__t": F.greatest(half_up(y - ct), F.lit(0)), "__r": F.least(half_up(x + w - cl), cw), "__b": F.least(half_up(y + h - ct), ch)})
    some = (w > 0) & (h > 0) & (cw > 0) & (ch > 0) & (right > left) & (bottom > top)
    b = F.struct(cl.alias("x"), ct.alias("y"), cw.alias("w"), ch.alias("h"), left.alias("mask_x"), top.alias("mask_y"), (right - left).alias("mask_w"), (bottom - top).alias("mask_h"))
    return d.select(*others, F.inline(F.when(some, F.array(b))))


def keystone_quad(top: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Corners of the tapered quadrilateral for line heights top and bottom: the edge with smaller lines is inset."""
    change = F.abs(bottom - top) / F.greatest(top, bottom)
    inset = width * F.least(F.lit(0.4), change) * 0.5
    a, b = F.when(top < bottom, inset).otherwise(0.0), F.when(top < bottom, 0.0).otherwise(inset)
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(p(a, F.lit(0)), p(width - a, F.lit(0)), p(width - b, height), p(b, height))


def resize(w: Column, h: Column, font: Column, scale_x: Column, scale_y: Column) -> Column:
    s = clamp((scale_x + scale_y) / 2, 0.2, 6)
    return F.struct(clamp(w * s, 1.5, 400).alias("w"), clamp(h * s, 1.5, 400).alias("h"), F.greatest(font * s, F.lit(0.5)).alias("font_size_pct"))


def drag(x: Column, y: Column, w: Column, h: Column, dx_px: Column, dy_px: Column, dx_pct: Column, dy_pct: Column) -> Column:
    """New position; unchanged until the pointer has travelled more than 3 px."""
    moved = F.hypot(dx_px, dy_px) > 3
    return F.struct(F.when(moved, clamp_position(x + dx_pct, w)).otherwise(x).alias("x"), F.when(moved, clamp_position(y + dy_pct, h)).otherwise(y).alias("y"))
