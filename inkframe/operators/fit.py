"""Line-height regression, keystone decision, median font, marquee hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions.geometry import keystone_quad
from inkframe.operators import whole

#: Least lines, R squared and relative change of a keystone; font without words.
LEAST_LINES, LEAST_R2, LEAST_CHANGE, DEFAULT_FONT = 3, 0.6, 0.15, 3.0


def linear_fit(points: DataFrame, *keys: str) -> DataFrame:
    """Least squares of y on x per key: n, slope, intercept, r2. Constant x: slope 0, intercept the mean. Constant y: r2 0."""
    flat_x, flat_y = F.var_pop("x") == 0, F.var_pop("y") == 0
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.when(flat_x, 0.0).otherwise(F.regr_slope("y", "x")).alias("slope"), F.when(flat_x, F.avg("y")).otherwise(F.regr_intercept("y", "x")).alias("intercept"), F.when(flat_x | flat_y, 0.0).otherwise(F.regr_r2("y", "x")).alias("r2"))


def keystones(lines: DataFrame, *keys: str) -> DataFrame:
    """Quadrilaterals of pages or crops whose line heights change steadily; lines (keys, x: centre, y: height, width, height)."""
    fit = linear_fit(lines, *keys).join(lines.groupBy(*keys).agg(F.max("width").alias("width"), F.max("height").alias("height")), list(keys))
    fit = fit.withColumn("top", F.col("intercept")).withColumn("bottom", F.col("intercept") + F.col("slope") * F.col("height"))
    change = F.abs(F.col("bottom") - F.col("top")) / F.greatest("top", "bottom")
    ok = (F.col("n") >= LEAST_LINES) & (F.col("r2") >= LEAST_R2) & (F.col("top") > 0) & (F.col("bottom") > 0)
    return fit.where(ok).where(change >= LEAST_CHANGE).withColumn("quad", keystone_quad(F.col("top"), F.col("bottom"), F.col("width"), F.col("height")))


def median_font(objects: DataFrame, scans: DataFrame) -> DataFrame:
    """Median font of each scan's recognized words; 3 for a scan without."""
    m = objects.where("origin = 'ocr' AND type = 'word'").groupBy("scan_id").agg(F.median("font_size_pct").alias("m"))
    return scans.select("scan_id").distinct().join(m, "scan_id", "left").select("scan_id", F.coalesce("m", F.lit(DEFAULT_FONT)).alias("font_size_pct"))


#: Cells of a page, across and down, by which many rectangles meet objects.
CELLS = 16


def marquee_pairs(objects: DataFrame, marquees: DataFrame, editor: bool = False, cells: int = CELLS) -> DataFrame:
    """(scan_id, marquee_id, id) of objects that marquees (scan_id, marquee_id, left, top, right, bottom in percent) touch, for many marquees a scan; images only in the editor.

    Both sides are laid over a grid and meet by scan and cell, in arrays of many whole scans at a time, so a marquee meets
    what lies about it alone. A pair that shares cells is given by the one that holds the left upper corner of what both
    have in common. The grid goes on beyond the page, to a hundred pages right and down; what lies further is in the cells
    at its edge. Boxes with a null or NaN edge, or turned over, touch nothing. The marquees of a task's scans are held in
    a hash table.
    """
    o = objects if editor else objects.where("type = 'word'")
    cell = lambda v: F.least(F.greatest(F.floor(v * (cells / 100)), F.lit(-cells)), F.lit(100 * cells)).cast("int")

    def boxes(d: DataFrame, x0, y0, x1, y1, name: str) -> DataFrame:
        d = d.select("scan_id", name, *[v.cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), (x0, y0, x1, y1), strict=True)])
        return d.where("x0 <= x1 AND y0 <= y1 AND NOT isnan(x0) AND NOT isnan(y0) AND NOT isnan(x1) AND NOT isnan(y1)")

    a = boxes(o, F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), "id")
    b = boxes(marquees, *[F.col(c) for c in ("left", "top", "right", "bottom")], "marquee_id")
    b = b.groupBy("scan_id").agg(F.collect_list(F.struct("marquee_id", *_EDGES)).alias("__m"))
    laid = lambda column: [cell(column(v)).alias(k) for k, v in zip(_CELLS, _EDGES, strict=True)]
    b = b.withColumn("__m", F.transform("__m", lambda m: F.struct(*[m[c].alias(c) for c in ("marquee_id", *_EDGES)], *laid(m.__getitem__))))

    def run(rows: pa.RecordBatch, starts: np.ndarray, ends: np.ndarray):
        has = np.flatnonzero(rows.column("__m").is_valid().to_numpy(zero_copy_only=False))
        lists = rows.column("__m").take(pa.array(has))
        m, of = lists.flatten(), np.repeat(np.searchsorted(starts, has, "right") - 1, lists.value_lengths().to_numpy())
        names, scan = m.field("marquee_id"), np.repeat(np.arange(len(starts)), ends - starts)
        both = [np.stack([column(c).to_numpy() for c in cs], 1) for column in (rows.column, m.field) for cs in (_EDGES, _CELLS)]
        for k, j in _meet(*both[:2], scan, *both[2:], of):
            k = pa.array(k)
            yield pa.record_batch({"scan_id": rows.column("scan_id").take(k), "marquee_id": names.take(pa.array(j)), "id": rows.column("id").take(k)})

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema = f"scan_id {kind(a, 'scan_id')}, marquee_id {kind(marquees, 'marquee_id')}, id {kind(a, 'id')}"
    # Cells are worked out after the sort: in one method with the boxes they make it too large to be compiled.
    return whole.with_one(a, b, "__m").select("*", *laid(F.col)).mapInArrow(whole.scans(run), schema)


#: Edges of a box, and the cells that they are in.
_EDGES, _CELLS = ("x0", "y0", "x1", "y1"), ("cx", "cy", "dx", "dy")
#: Cells of objects, and pairs in one cell, that are looked at at once.
MEETING = 1 << 20


def _runs(counts: np.ndarray, most: int):
    """Ranges of entries of at most so many counts together, an entry at least."""
    ends, at = np.cumsum(counts), 0
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each entry as often as it counts, and numbered from 0."""
    return np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _meet(a: np.ndarray, cells_a: np.ndarray, scan_a: np.ndarray, b: np.ndarray, cells_b: np.ndarray, scan_b: np.ndarray):
    """Places in a and b of boxes (n, 4), laid over cells (n, 4), of one scan that touch each other."""
    if not len(a) or not len(b):
        return
    low = min(cells_a.min(), cells_b.min())
    size = int(max(cells_a.max(), cells_b.max()) - low) + 1
    cells_a, cells_b = cells_a.astype(np.int64) - low, cells_b.astype(np.int64) - low
    key = lambda scan, x, y: (scan * size + x) * size + y

    def laid(cells, scan):
        x0, y0, x1, y1 = cells.T
        wide = x1 - x0 + 1
        k, n = _spread(wide * (y1 - y0 + 1))
        x, y = x0[k] + n % wide[k], y0[k] + n // wide[k]
        return k, x, y, key(scan[k], x, y)

    of, _, _, held = laid(cells_b, scan_b)
    order = np.argsort(held, kind="stable")
    of, held = of[order], held[order]
    span = cells_a.T
    for s, e in _runs((span[2] - span[0] + 1) * (span[3] - span[1] + 1), MEETING):
        k, x, y, keys = laid(cells_a[s:e], scan_a[s:e])
        first = np.searchsorted(held, keys)
        many = np.searchsorted(held, keys, "right") - first
        for p, q in _runs(many, MEETING):
            at, n = _spread(many[p:q])
            at += p
            i, j = k[at] + s, of[first[at] + n]
            u, v = a[i], b[j]
            corner = np.maximum(cells_a[i, :2], cells_b[j, :2])
            hit = (corner[:, 0] == x[at]) & (corner[:, 1] == y[at]) & (u[:, :2] <= v[:, 2:]).all(1) & (u[:, 2:] >= v[:, :2]).all(1)
            if hit.any():
                yield i[hit], j[hit]


def marquee_hits(objects: DataFrame, marquees: DataFrame, editor: bool = False) -> DataFrame:
    """(scan_id, id) of objects that a scan's marquee (scan_id, left, top, right, bottom) touches; images only in the editor."""
    o = objects if editor else objects.where("type = 'word'")
    j = o.join(marquees, "scan_id")
    hit = (F.col("x") <= F.col("right")) & (F.col("x") + F.col("w") >= F.col("left")) & (F.col("y") <= F.col("bottom")) & (F.col("y") + F.col("h") >= F.col("top"))
    return j.where(hit).select("scan_id", "id").distinct()
