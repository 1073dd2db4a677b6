"""Choosing among recognition passes and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Confidence gates, share of the image that a word-less weak region stays under, regions per scan, least share of words.
TRY_PREPROCESSED, RETRY_SPARSE, TRY_REGIONS, WEAK, WEAK_AREA, MOST_REGIONS, LEAST_WORDS = 70.0, 40.0, 85.0, 70.0, 0.08, 16, 0.5


def candidates(*passes: DataFrame) -> DataFrame:
    """The rows of several passes in one table, ordinal being the pass's number; a column that a pass lacks is null. Unlike names are told apart, repeated rows stay."""
    out = None
    for k, p in enumerate(passes):
        rows = p.withColumn("ordinal", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def best_candidate(candidates: DataFrame, *keys: str) -> DataFrame:
    """The highest mean_confidence per key; of equals the first by ordinal."""
    by = Window.partitionBy(*keys).orderBy(F.col("mean_confidence").desc(), "ordinal")
    return candidates.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def weakest_regions(regions: DataFrame, most: int = MOST_REGIONS) -> DataFrame:
    """The weakest regions of each scan, ranked; regions (scan_id, block_no, n_words, mean_confidence, x0..y1, image_width, image_height)."""
    small = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) < WEAK_AREA * F.col("image_width") * F.col("image_height")
    weak = regions.where((F.col("mean_confidence") < WEAK) & ((F.col("n_words") > 0) | small))
    by = Window.partitionBy("scan_id").orderBy("mean_confidence", "block_no")
    return weak.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)


def page_cascade(passes: DataFrame) -> DataFrame:
    """(scan_id, source, n_words, mean_confidence, sparse) of the pass that each scan keeps.

    passes (scan_id, pass, source, n_words, mean_confidence) hold the results of passes raw, preprocessed and
    sparse (one per source). The preprocessed pass is tried if raw is under 70 and kept if it is better; the sparse
    pass on the winner's source is tried if the winner has no words or is under 40, and kept if it has words and is better.
    """
    p = passes.select("scan_id", "pass", "source", F.struct("n_words", F.col("mean_confidence").alias("mean")).alias("r"))
    one = lambda name, source: F.max(F.when((F.col("pass") == name) & (F.col("source") == source), F.col("r")))
    w = p.groupBy("scan_id").agg(one("raw", "original").alias("raw"), one("preprocessed", "preprocessed").alias("pre"), one("sparse", "original").alias("so"), one("sparse", "preprocessed").alias("sp"))
    take = F.coalesce((F.col("raw.mean") < TRY_PREPROCESSED) & (F.col("pre.mean") > F.col("raw.mean")), F.lit(False))
    w = w.withColumn("source", F.when(take, "preprocessed").otherwise("original")).withColumn("win", F.when(take, F.col("pre")).otherwise(F.col("raw")))
    w = w.withColumn("s", F.when(take, F.col("sp")).otherwise(F.col("so")))
    retry = (F.col("win.n_words") == 0) | (F.col("win.mean") < RETRY_SPARSE)
    keep = F.coalesce(retry & (F.col("s.n_words") > 0) & (F.col("s.mean") > F.col("win.mean")), F.lit(False))
    best = F.when(keep, F.col("s")).otherwise(F.col("win"))
    return w.withColumn("sparse", keep).withColumn("b", best).select("scan_id", "source", F.col("b.n_words").alias("n_words"), F.col("b.mean").alias("mean_confidence"), "sparse")


def accept_regions(regions: DataFrame, again: DataFrame) -> DataFrame:
    """regions left-joined to their reprocessed result (scan_id, block_no, n_words, mean_confidence): accepted, and the figures that hold."""
    a = again.select("scan_id", "block_no", F.col("n_words").alias("new_words"), F.col("mean_confidence").alias("new_mean"))
    ok = F.coalesce((F.col("new_words") >= LEAST_WORDS * F.col("n_words")) & (F.col("new_mean") > F.col("mean_confidence")) & (F.col("new_words") > 0), F.lit(False))
    j = regions.join(a, ["scan_id", "block_no"], "left").withColumn("accepted", ok)
    return j.withColumn("n_words", F.when(F.col("accepted"), F.col("new_words")).otherwise(F.col("n_words"))).withColumn("mean_confidence", F.when(F.col("accepted"), F.col("new_mean")).otherwise(F.col("mean_confidence"))).drop("new_words", "new_mean")


def gates(passes: DataFrame) -> DataFrame:
    """Which further work a pass (n_words, mean_confidence, n_regions) asks for."""
    m = F.col("mean_confidence")
    return passes.withColumn("try_preprocessed", m < TRY_PREPROCESSED).withColumn("retry_sparse", (F.col("n_words") == 0) | (m < RETRY_SPARSE)).withColumn("try_regions", (F.col("n_regions") > 0) & (m < TRY_REGIONS))
