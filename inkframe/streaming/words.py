"""Word streams: the per-word operators hold on streams as they are; text needs a closed scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkframe.functions.text import is_noise
from inkframe.operators.layout import filter_words, words_to_text


def noise_counts(words: DataFrame, time: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, n_words, n_noise): words and noise words per event-time window of a word stream, late words dropped after `late`."""
    w = words.withWatermark(time, late).withColumn("noise", is_noise(F.col("text"), F.col("confidence")))
    return w.groupBy(F.window(time, window)).agg(F.count("*").alias("n_words"), F.count_if("noise").alias("n_noise"))


def write_texts(words: DataFrame, path: str, checkpoint: str, level: str = "filtered", **trigger) -> StreamingQuery:
    """Writes the text of the scans of each micro-batch under path/batch=N, which a retry writes anew instead of twice.

    A scan's words must arrive in one batch, as one file of words does. `trigger` as in DataStreamWriter.trigger.
    """

    def one(batch: DataFrame, number: int) -> None:
        words_to_text(batch, level).write.mode("overwrite").parquet(f"{path}/batch={number}")

    out = words.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


__all__ = ["filter_words", "noise_counts", "write_texts"]
