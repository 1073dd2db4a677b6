"""Recognition of whole images around a plug-in: passes over the page, a second look at weak regions, words in order.

A recognizer is any class with recognize(image, mode, rotate) -> {"text", "rotate_radians", "blocks"} and close();
blocks are nested as in layout.BLOCKS. Every image is worked on by itself, so images are dealt over tasks.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from inkframe.operators import images as images_
from inkframe.operators import passes, raster
from inkframe.operators.fit import LEAST_CHANGE, LEAST_LINES, LEAST_R2
from inkframe.operators.order import compare_regions

#: Segmentation modes, crop margin, how much wider than high one line is.
AUTO, BLOCK, LINE, SPARSE = 3, 6, 7, 11
MARGIN, LINE_ASPECT = 6, 6.0
WORDS = "array<struct<line_index: int, text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>>"
SCANS = f"scan_id long, text string, preprocessed boolean, words {WORDS}, error string"


class Box(NamedTuple):
    x0: float
    y0: float
    x1: float
    y1: float


class Word(NamedTuple):
    text: str
    confidence: float
    box: Box


class Region(NamedTuple):
    box: Box
    boxes: list[Box]  # of the lines
    lines: list[list[Word]]

    @property
    def words(self) -> list[Word]:
        return [w for line in self.lines for w in line]


class Pass(NamedTuple):
    regions: list[Region]
    text: str
    image: np.ndarray
    preprocessed: bool

    @property
    def words(self) -> list[Word]:
        return [w for r in self.regions for w in r.words]


def mean(words: list[Word]) -> float:
    return sum(w.confidence for w in words) / len(words) if words else 0.0


def hull(points) -> Box:
    xs, ys = zip(*points, strict=True)
    return Box(min(xs), min(ys), max(xs), max(ys))


def _corners(b: Box):
    return (b.x0, b.y0), (b.x1, b.y0), (b.x1, b.y1), (b.x0, b.y1)


def _box(b: dict) -> Box:
    return Box(*(float(b[k]) for k in Box._fields))


def _lines(block: dict):
    """(box, words) of a block's lines that hold words; a confidence that is no number is 0."""
    for paragraph in block.get("paragraphs") or []:
        for line in paragraph.get("lines") or []:
            own = [(str(w.get("text") or "").strip(), w.get("confidence"), w["bbox"]) for w in line.get("words") or []]
            words = [Word(t, float(c) if isinstance(c, int | float) else 0.0, _box(b)) for t, c, b in own if t]
            if words:
                yield line.get("bbox"), words


def page_pass(tool, image: np.ndarray, mode: int, preprocessed: bool, natural_width: int) -> Pass:
    """One recognition of the page: its regions in the natural image's pixels, those without words but with an area included."""
    found = tool.recognize(image, mode, True)
    h, w = image.shape[:2]
    angle, scale = -(found.get("rotate_radians") or 0.0), w / natural_width
    c, s = np.cos(angle), np.sin(angle)
    turn = lambda x, y: ((w / 2 + (x - w / 2) * c - (y - h / 2) * s) / scale, (h / 2 + (x - w / 2) * s + (y - h / 2) * c) / scale)
    back = lambda b: hull([turn(x, y) for x, y in _corners(b)])
    regions = []
    for block in found.get("blocks") or []:
        lines = [(back(_box(b)), [x._replace(box=back(x.box)) for x in words]) for b, words in _lines(block)]
        if lines:
            boxes = [b for b, _ in lines]
            regions.append(Region(hull([p for b in boxes for p in _corners(b)]), boxes, [words for _, words in lines]))
        elif block.get("bbox"):
            b = back(_box(block["bbox"]))
            if b.x1 > b.x0 and b.y1 > b.y0:
                regions.append(Region(b, [], []))
    return Pass(regions, (found.get("text") or "").strip(), image, preprocessed)


def keystone(boxes: list[Box], width: int, height: int):
    """Corners of the tapered quadrilateral that line heights suggest; None without a steady change."""
    if len(boxes) < LEAST_LINES:
        return None
    x = np.array([(b.y0 + b.y1) / 2 for b in boxes])
    y = np.array([b.y1 - b.y0 for b in boxes])
    dx, dy = x - x.mean(), y - y.mean()
    slope = float(dx @ dy / (dx @ dx)) if (dx @ dx) else 0.0
    r2 = float((dx @ dy) ** 2 / ((dx @ dx) * (dy @ dy))) if (dx @ dx) and (dy @ dy) else 0.0
    top = float(y.mean() - slope * x.mean())
    bottom = top + slope * height
    if r2 < LEAST_R2 or top <= 0 or bottom <= 0 or abs(bottom - top) / max(top, bottom) < LEAST_CHANGE:
        return None
    inset = width * min(0.4, abs(bottom - top) / max(top, bottom)) * 0.5
    a, b = (inset, 0.0) if top < bottom else (0.0, inset)
    return [(a, 0), (width - a, 0), (width - b, height), (b, height)]


def second_look(tool, image: np.ndarray, region: Region) -> list[list[Word]] | None:
    """Lines of a region recognized anew: cropped, straightened where its lines taper, the best of its renderings; None without words."""
    h, w = image.shape[:2]
    x0, y0 = max(0, int(np.floor(region.box.x0)) - MARGIN), max(0, int(np.floor(region.box.y0)) - MARGIN)
    x1, y1 = min(w, int(np.ceil(region.box.x1)) + MARGIN), min(h, int(np.ceil(region.box.y1)) + MARGIN)
    cw, ch = x1 - x0, y1 - y0
    if cw <= 0 or ch <= 0:
        return None
    crop, lead = image[y0:y1, x0:x1], None
    quad = keystone([Box(b.x0 - x0, b.y0 - y0, b.x1 - x0, b.y1 - y0) for b in region.boxes], cw, ch)
    if quad and (straight := raster.warp(crop, quad, cw, ch)):
        crop, lead = straight
    mode = SPARSE if not region.words else LINE if cw / ch > LINE_ASPECT else BLOCK

    def place(b: Box, scale: float) -> Box:
        points = [(x / scale, y / scale) for x, y in _corners(b)]
        if lead is not None:
            points = [((lead[0] * x + lead[1] * y + lead[2]) / z, (lead[3] * x + lead[4] * y + lead[5]) / z) for x, y in points for z in [lead[6] * x + lead[7] * y + lead[8]]]
        return hull([(x + x0, y + y0) for x, y in points])

    best = None
    for _, plane in raster.region_candidates(crop):
        scale = plane.shape[1] / cw
        found = tool.recognize(plane, mode, False)
        lines = [[x._replace(box=place(x.box, scale)) for x in words] for block in found.get("blocks") or [] for _, words in _lines(block)]
        words = [x for line in lines for x in line]
        if words and (best is None or mean(words) > best[0]):
            best = mean(words), lines
    return best[1] if best else None


def scan_image(tool, image: np.ndarray) -> tuple[str, bool, list[tuple[int, Word]]]:
    """Text and flag of the page pass that is kept, and the words by line, weak regions looked at again."""
    h, w = image.shape[:2]
    best = page_pass(tool, image, AUTO, False, w)
    if mean(best.words) < passes.TRY_PREPROCESSED:
        other = page_pass(tool, raster.preprocess_page(image)[0], AUTO, True, w)
        best = other if mean(other.words) > mean(best.words) else best
    if not best.words or mean(best.words) < passes.RETRY_SPARSE:
        other = page_pass(tool, best.image, SPARSE, best.preprocessed, w)
        best = other if other.words and mean(other.words) > mean(best.words) else best
    regions = list(best.regions)
    if regions and mean(best.words) < passes.TRY_REGIONS:
        area = lambda b: (b.x1 - b.x0) * (b.y1 - b.y0)
        weak = [k for k, r in enumerate(regions) if mean(r.words) < passes.WEAK and (r.words or area(r.box) < passes.WEAK_AREA * w * h)]
        for k in sorted(weak, key=lambda k: mean(regions[k].words))[: passes.MOST_REGIONS]:
            old, new = regions[k], second_look(tool, image, regions[k])
            words = [x for line in new or [] for x in line]
            if words and len(words) >= passes.LEAST_WORDS * len(old.words) and mean(words) > mean(old.words):
                regions[k] = old._replace(lines=new)
    regions.sort(key=functools.cmp_to_key(lambda a, b: compare_regions(a.box, b.box)))
    lines = [line for r in regions for line in r.lines]
    return best.text, best.preprocessed, [(k, x) for k, line in enumerate(lines) for x in line]


def scan_images(images: DataFrame, engine: type) -> DataFrame:
    """images (scan_id, content of a PNG file) to SCANS; a failure, or content that cannot be read, gives a row with its error.

    One recognizer a task, closed in any case.
    """

    def run(it):
        tool = engine()
        try:
            for pdf in it:
                rows = []
                for scan, content in zip(pdf["scan_id"], pdf["content"], strict=True):
                    image = images_.decode(content)
                    if image is None:
                        rows.append((scan, None, None, None, "the image cannot be read"))
                        continue
                    try:
                        text, preprocessed, words = scan_image(tool, image)
                        own = [{"line_index": k, "text": x.text, "confidence": x.confidence, "bbox": x.box._asdict()} for k, x in words]
                        rows.append((scan, text, preprocessed, own, None))
                    except Exception as e:  # noqa: BLE001  a bad image must not end the job
                        rows.append((scan, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=["scan_id", "text", "preprocessed", "words", "error"])
        finally:
            tool.close()

    return images.select("scan_id", "content").mapInPandas(run, SCANS)


def timed_scan(images: DataFrame, engine: type) -> DataFrame:
    """(name, text, elapsed_ms, error) of images (name, content): scans by the clock, for an evaluation report."""

    def run(it):
        import time

        tool = engine()
        try:
            for pdf in it:
                rows = []
                for name, content in zip(pdf["name"], pdf["content"], strict=True):
                    at = time.monotonic()
                    try:
                        image = images_.decode(content)
                        if image is None:
                            raise ValueError("the image cannot be read")
                        text, error = "\n".join(" ".join(x.text for j, x in own if j == k) for own in [scan_image(tool, image)[2]] for k in sorted({j for j, _ in own})), None
                    except Exception as e:  # noqa: BLE001
                        text, error = None, str(e)
                    rows.append((name, text, int((time.monotonic() - at) * 1000), error))
                yield pd.DataFrame(rows, columns=["name", "text", "elapsed_ms", "error"])
        finally:
            tool.close()

    return images.select("name", "content").mapInPandas(run, "name string, text string, elapsed_ms long, error string")
