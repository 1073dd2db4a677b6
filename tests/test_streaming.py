"""Word streams over files: texts of each batch, counts per window."""

import random

from pyspark.sql import functions as F

from inkframe.plans import synthetic as syn
from inkframe.operators import edits, layout
from inkframe.streaming import edits as undo
from inkframe.streaming import progress
from inkframe.streaming import words as stream

SF = "/root/testdata/sf0.001"


def test_texts(spark, tmp_path):
    w = syn.words(spark, SF)
    for part in (0, 1):
        w.where(F.col("scan_id") % 2 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(w.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        stream.write_texts(read, f"{tmp_path}/out", f"{tmp_path}/mark", availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.select("batch").distinct().count() == 2
    want = {r.scan_id: r.text for r in layout.words_to_text(w, "filtered").collect()}
    assert {r.scan_id: r.text for r in got.collect()} == want


def test_noise_counts(spark, tmp_path):
    w = syn.words(spark, SF).withColumn("at", F.timestamp_seconds(F.col("scan_id") * 60))
    w.write.parquet(f"{tmp_path}/in")
    read = spark.readStream.schema(w.schema).parquet(f"{tmp_path}/in")
    q = stream.noise_counts(read, "at").writeStream.format("memory").queryName("noise_per_window").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    noise = layout.filter_words(w, "raw").withColumn("noise", stream.is_noise(F.col("text"), F.col("confidence")))
    want = {(r.k, r.n, r.m) for r in noise.groupBy(F.floor(F.col("scan_id") / 5).alias("k")).agg(F.count("*").alias("n"), F.count_if("noise").alias("m")).collect()}
    assert {(int(r.window.start.timestamp()) // 300, r.n_words, r.n_noise) for r in spark.table("noise_per_window").collect()} == want


def test_history_stream(spark, tmp_path):
    """Whatever the batches, and over restarts, the rows of the batch fold: all kinds of events, a cap that is met, repeats."""
    r, rows = random.Random(6), []
    for scan in range(8):
        kinds = ["push"] * 9 + ["undo"] * 6 + ["redo"] * 4 + ["focus", "blur"] * 3 + ["place", "blank"] * 2
        rows += [(scan, seq, kind, None if kind in ("undo", "redo", "focus") else r.randint(1, 9)) for seq, kind in enumerate(r.choices(kinds, k=80))]
    rows.sort(key=lambda e: (e[1], r.random()))
    schema = "scan_id long, seq long, kind string, version long"
    parts = [rows[:100], rows[100:101], rows[101:400], rows[90:110], rows[400:]]  # the fourth holds repeats alone
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 3, 4):  # stopped and started anew
            undo.start(read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/mark", 5, availableNow=True).awaitTermination()
    got = sorted(tuple(x) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    want = edits.history(spark.createDataFrame(rows, schema), 5)
    assert got == sorted(tuple(x) for x in want.collect()) and len(got) == 640
    assert max(x[3] for x in got) >= 5 and "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_progress(spark, tmp_path):
    """A closing row a session, late events dropped, over two restarts."""
    at = lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    batches = [
        [(1, 0, "loading core", 0.0), (1, 2, "recognizing text", 0.125), (2, 1, "recognizing text", 0.5)],
        [(1, 4, "recognizing text", 0.995), (1, 4, "done", 1.0), (2, 30, "again", 0.25)],
        [(3, 60, "x", None), (2, 31, "éa", 0.334)],
        [(1, 3, "too late", 0.9), (9, 200, "end", 1.0)],
        [(9, 201, "end", 1.0)],
    ]
    schema = "scan_id long, at timestamp, status string, progress double"
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(s, at(m), t, p) for s, m, t, p in rows], "scan_id long, at string, status string, progress double")
        df.withColumn("at", F.to_timestamp("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k != 1:
            q = progress.sessions(read.parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").outputMode("append")
            q.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.scan_id, r.started.minute + 60 * r.started.hour, r.n_events, r.percent, r.status) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, 0, 4, 100, "Done"), (2, 1, 1, 50, "Recognizing text"), (2, 30, 2, 33, "Éa"), (3, 60, 1, None, "X")]
