"""Progress of recognitions from a stream of events: one closing row a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkframe.functions.text import capitalize_first, percent


def sessions(events: DataFrame, gap: str = "3 minutes", late: str = "10 minutes") -> DataFrame:
    """(scan_id, started, ended, n_events, percent, status) of each session of events (scan_id, at, status, progress from 0 to 1).

    A session ends where a scan has no event for `gap`; its row comes once the watermark, `late` behind the latest
    event, has passed that end; events behind the watermark of the batch before are dropped. Percent and status are those of the last
    event by time (of equal times, of the most progress).
    """
    last = F.max_by(F.struct("status", "progress"), F.struct("at", "progress"))
    s = events.withWatermark("at", late).groupBy("scan_id", F.session_window("at", gap).alias("s")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("n_events"), last.alias("e"))
    return s.select("scan_id", "started", "ended", "n_events", percent(F.col("e.progress")).alias("percent"), capitalize_first(F.col("e.status")).alias("status"))
