"""Whole scans in Python, many at a time, out of rows that lie by scan: a group of its own for each costs far more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_one(rows: DataFrame, ones: DataFrame, column: str, *order: str) -> DataFrame:
    """Rows by scan and in order (if any: sorting by the scan alone is cheaper), one of each scan with the column of ones (scan_id, column; a row a scan), which are held in a hash table a task; for scans."""
    r = rows.withColumn("__k", F.row_number().over(Window.partitionBy("scan_id").orderBy(*(order or ["scan_id"]))))
    one = ones.select(F.col("scan_id").alias("__s"), column).hint("shuffle_hash")
    # Rows stream by the table in the order that they are numbered in, so they are sorted once.
    r = r.join(one, (F.col("scan_id") == F.col("__s")) & (F.col("__k") == 1), "left")
    return r.drop("__s", "__k").sortWithinPartitions("scan_id", *order)


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("scan_id").cast(pa.int64()).fill_null(-(1 << 63)).to_numpy()


def ones(rows: pa.RecordBatch, column: str, starts: np.ndarray) -> dict:
    """The value of with_one's column by the first row of its scan; None without."""
    at = np.flatnonzero(rows.column(column).is_valid().to_numpy(zero_copy_only=False))
    found = dict.fromkeys(starts.tolist())
    return found | {int(starts[k]): v for k, v in zip((np.searchsorted(starts, at, "right") - 1).tolist(), rows.column(column).take(pa.array(at)).to_pylist(), strict=True)}


def scans(work):
    """For mapInArrow over rows that lie by scan: work(rows, starts, ends) of many whole scans at a time, in an iterable of batches or a batch."""

    def run(batches):
        held, last = [], None  # of the scan that is not yet whole
        for b in batches:
            if b.num_rows:
                ids = _ids(b)
                new = np.flatnonzero(ids[1:] != ids[:-1]) + 1
                cut = int(new[-1]) if len(new) else 0
                if cut or (held and ids[0] != last):
                    yield from one([*held, b.slice(0, cut)])
                    held = []
                held.append(b.slice(cut))
                last = ids[-1]
        if held:
            yield from one(held)

    def one(parts):
        for rows in pa.Table.from_batches([p for p in parts if p.num_rows]).combine_chunks().to_batches():
            ids = _ids(rows)
            starts = np.append(0, np.flatnonzero(ids[1:] != ids[:-1]) + 1)
            out = work(rows, starts, np.append(starts[1:], rows.num_rows))
            yield from [out] if isinstance(out, pa.RecordBatch) else out

    return run
