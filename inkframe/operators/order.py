"""Operators without a relational form: reading order of regions, homography of four points."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Region(NamedTuple):
    at: int
    x0: float
    y0: float
    x1: float
    y1: float


def compare_regions(a, b) -> float:
    """Negative if a is read before b: by top where tops differ by more than half the smaller height, else by left edge."""
    dy = a.y0 - b.y0
    return dy if abs(dy) > 0.5 * min(a.y1 - a.y0, b.y1 - b.y0) else a.x0 - b.x0


def reading_order(regions: DataFrame) -> DataFrame:
    """(scan_id, block_no, rank) of regions (scan_id, block_no, x0, y0, x1, y1).

    Regions whose tops differ by more than half the smaller height go by top, others by left edge. This comparison
    is not transitive: where regions form a cycle, the ranks are those of a stable merge sort in block order.
    """

    one = regions.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("block_no", *[F.col(c).cast("double").alias(c) for c in _EDGES]))).alias("rs"))
    # A scan's regions are one row, and many scans one batch: a group of its own for each costs far more than its sort.
    return one.select("scan_id", "rs", F.posexplode(in_order("rs")).alias("rank", "at")).select("scan_id", F.get("rs", F.col("at"))["block_no"].cast("int").alias("block_no"), F.col("rank").cast("int").alias("rank"))


_EDGES = ("x0", "y0", "x1", "y1")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def in_order(scans: pd.Series) -> pd.Series:
    """The places in its array of each scan's regions (block_no, x0, y0, x1, y1, in block order), in reading order."""
    key = functools.cmp_to_key(compare_regions)
    return pd.Series([[r.at for r in sorted((_Region(k, r["x0"], r["y0"], r["x1"], r["y1"]) for k, r in enumerate(rs)), key=key)] for rs in scans])


def solve_homography(source: np.ndarray, target: np.ndarray, least: float = 1e-10) -> np.ndarray | None:
    """Nine coefficients, the last 1, that map four points onto four; None when a pivot falls under `least`."""
    rows = []
    for (x, y), (u, v) in zip(source, target, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, u], [0, 0, 0, x, y, 1, -v * x, -v * y, v]]
    m = np.array(rows, float)
    for k in range(8):
        p = k + int(np.argmax(np.abs(m[k:, k])))
        if abs(m[p, k]) < least:
            return None
        m[[k, p]] = m[[p, k]]
        m[k] /= m[k, k]
        others = np.arange(8) != k
        m[others] -= np.outer(m[others, k], m[k])
    return np.append(m[:, 8], 1.0)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def homography(source: pd.Series, target: pd.Series) -> pd.Series:
    """Of arrays of eight numbers x, y each; null when there is none."""
    out = [solve_homography(np.reshape(a, (4, 2)), np.reshape(b, (4, 2))) if a is not None and b is not None else None for a, b in zip(source, target, strict=True)]
    return pd.Series([None if x is None else x.tolist() for x in out])
