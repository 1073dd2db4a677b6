"""Exact duplicates by content sort: sampled splitters deal texts to ranges, each range is sorted, neighbours are compared in full.

Rows are ordered by normalised text, then by id, the one that stays first. Splitters are cut from a sample of that order,
id included, so a text that makes up a large part of all rows is dealt over many ranges; runs that go on in the next
range are put together afterwards, two texts a range being compared. Texts are shuffled once and leave the plan there.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, exact, parallelism, table

RANGES = 4  # a partition of the shuffle
SAMPLE = 16  # rows a range; they place the splitters, and no row's result depends on them
SPLITTER = 4096  # characters of a splitter at most; different texts that agree in more are dealt together

OP11_SQL = """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


def splitters(rows: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """Ascending (text, back) that cut rows (text, back) into `ranges` parts of about one size, each text as short as tells it from the one before."""
    share = min(1.0, SAMPLE * ranges / max(1, rows.count()))
    some = rows.where(F.rand(11) < share) if share < 1 else rows
    some = some.select(F.substring("text", 1, SPLITTER).alias("text"), "back")
    # One task sorts the sample: SAMPLE rows a range, of SPLITTER characters at most.
    tile = F.ntile(ranges).over(Window.orderBy("text", "back"))
    least = some.withColumn("tile", tile).groupBy("tile").agg(F.min(F.struct("text", "back")).alias("s"))
    out, before = [], None
    for r in least.where("tile > 1").orderBy("tile").collect():
        text, cut = r.s.text, r.s.text
        if before is not None and text != before:
            same = next((k for k, (a, b) in enumerate(zip(before, text)) if a != b), min(len(before), len(text)))  # noqa: B905
            cut = text[: same + 1]
        out.append((cut, r.s.back))
        before = text
    return out


def _range(text: Column, back: Column, bounds: list[tuple[str, int]]) -> Column:
    """How many of the bounds are not after (text, back), by binary search."""
    known = F.from_json(F.lit(json.dumps([{"t": t, "b": b} for t, b in bounds])), "array<struct<t: string, b: bigint>>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, len(bounds).bit_length())))])

    def step(at: Column, s: Column) -> Column:
        x = F.get(known, at + s - 1)  # null beyond the last
        return F.when((x["t"] < text) | ((x["t"] == text) & (x["b"] <= back)), at + s).otherwise(at)

    return F.aggregate(steps, F.lit(0), step)


def exact_dedup(docs: DataFrame, normalise: Callable[[Column], Column] | None = None, largest: bool = False) -> DataFrame:
    """docs (doc_id, text, anything else) to a row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8).

    Texts are equal if they are identical once normalised (as they are, by default); a null text, or one that
    normalises to null, counts as empty. Of equal texts the row with the smallest doc_id stays (or the largest), rows
    without doc_id last; of rows that are equal in both one stays, and these are compared in one range. keep_id is null
    where no row of the text has a doc_id. An empty table gives no rows; other columns of docs are not used.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "exact")
    src = exact(docs, "doc_id", "text")
    text = F.col("text").cast("string")
    src = src.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(normalise(text) if normalise else text, F.lit("")).alias("text"))
    order = F.bitwise_not("doc_id") if largest else F.col("doc_id")
    src = src.withColumn("back", F.coalesce(order, F.lit((1 << 63) - 1))).withColumn("none", F.col("doc_id").isNull())
    bounds = splitters(src.select("text", "back"), RANGES * parallelism(spark))
    w = src.withColumn("range", _range(F.col("text"), F.col("back"), bounds) if bounds else F.lit(0))
    # The texts are sorted and compared, and only those at the ends of a range go on.
    sort = Window.partitionBy("range").orderBy("text", "back", "none")
    w = w.withColumn("before", F.lag("text").over(sort)).withColumn("after", F.lead("text").over(sort)).withColumn("at", F.row_number().over(sort))
    new, last = F.col("before").isNull() | (F.col("before") != F.col("text")), F.col("after").isNull()
    w = w.select("range", "at", "doc_id", new.cast("long").alias("new"), last.alias("last"), F.when((F.col("at") == 1) | last, F.col("text")).alias("edge"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
    w = w.withColumn("run", F.sum("new").over(Window.partitionBy("range").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("range", "run")
    best = F.max if largest else F.min
    w = w.withColumn("n", F.count("*").over(run)).withColumn("best", best("doc_id").over(run)).withColumn("place", F.row_number().over(run.orderBy("at")))
    rows = keep.save(w.drop("new"), "rows")
    chains = _chains(rows, best)
    out = rows.join(F.broadcast(chains), ["range", "run"], "left")  # two rows a range at most
    whole = F.col("total").isNotNull()
    return out.select(
        "doc_id",
        F.when(whole, F.col("keep")).otherwise(F.col("best")).alias("keep_id"),
        F.when(whole, F.col("total")).otherwise(F.col("n")).alias("group_size"),
        ((F.col("place") == 1) & F.coalesce("head", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _chains(rows: DataFrame, best: Callable) -> DataFrame:
    """Runs at the ends of ranges (range, run) with what they have together with those that they go on from or in: total, keep, and head, whether the run is the first."""
    first = rows.where("at = 1").select("range", F.col("edge").alias("first_text"), F.col("n").alias("first_n"), F.col("best").alias("first_best"))
    last = rows.where("last").select("range", F.col("run").alias("runs"), F.col("edge").alias("last_text"), F.col("n").alias("last_n"), F.col("best").alias("last_best"))
    numbers = first.select("range").withColumn("k", F.row_number().over(Window.orderBy("range")))  # one number a range
    a = last.join(F.broadcast(numbers), "range").select((F.col("k") + 1).alias("k"), "last_text")
    b = first.join(F.broadcast(numbers), "range").select("k", "range", "first_text")
    same = b.join(a, "k", "left").select("k", "range", F.coalesce(F.col("first_text") == F.col("last_text"), F.lit(False)).alias("same"))
    ends = same.join(first.drop("first_text"), "range").join(last.drop("last_text"), "range")
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    more = (F.col("runs") > 1).cast("long")
    ends = ends.withColumn("last_chain", F.sum((~F.col("same")).cast("long") + more).over(so_far)).withColumn("first_chain", F.col("last_chain") - more)
    one = lambda run, which: F.struct(run.alias("run"), *[F.col(f"{which}_{c}").alias(c) for c in ("n", "best", "chain")])
    both = F.array(one(F.lit(1).cast("long"), "first"), one(F.col("runs"), "last"))
    nodes = ends.select("range", F.explode(F.when(F.col("runs") > 1, both).otherwise(F.slice(both, 1, 1))).alias("r")).select("range", "r.*")
    chain = Window.partitionBy("chain")
    return nodes.select("range", "run", F.sum("n").over(chain).alias("total"), best("best").over(chain).alias("keep"), (F.col("range") == F.min("range").over(chain)).alias("head"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, texts as they are; the largest doc_id stays."""
    return exact_dedup(table(spark, sf_dir, "documents"), largest=True)
