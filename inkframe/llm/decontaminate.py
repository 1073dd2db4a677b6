"""Benchmark decontamination by spaced-seed hashing, with DataFrame and SQL functions only.

A mask keeps some of the words of a window and ignores the rest. Benchmark items are hashed under every mask at
every position, documents at every second position, or at every one for items of under 13 words; equal hashes give a
diagonal (document position minus item position). Each diagonal is then verified word by word: a window of 13 item
words (or the whole item, if shorter) of which at least 80 % stand in the document at the same places is a leak. The
masks are chosen so that at this window and share no place of the substitutions leaves an item without a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, salted, table

#: Kept positions of each mask.
MASKS = ((0, 1, 2, 4, 7), (0, 1, 3, 4, 6), (0, 2, 3, 5, 8), (0, 1, 2, 3, 5))
STRIDE = 2
#: Masks of items of under 13 words, by number of words; up to 4 words 80 % is every word.
SHORT_MASKS = {
    1: ((0,),),
    2: ((0, 1),),
    3: ((0, 1, 2),),
    4: ((0, 1, 2, 3),),
    5: ((0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4)),
    6: ((0, 1, 2, 3), (0, 1, 3, 4)),
    7: ((0, 1, 3, 4),),
    8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
    9: ((0, 1, 2, 4, 5),),
    10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7)),
    11: ((0, 1, 2, 3, 5), (0, 1, 4, 7, 8)),
    12: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
}
#: More rows than this (benchmark hashes, names of rows that go; two or three numbers each) are joined by shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(masks, stride: int, sizes=None) -> Column:
    """Structs (at, h) of the column `h`, hashed words, under all masks (of sizes[mask] words only, if given) at every stride-th position."""
    parts = []
    for k, mask in enumerate(masks):
        kept = ", ".join(f"h[i + {o}]" for o in mask)
        last = f"size(h) - {mask[-1] + 1}"
        other = f" OR size(h) NOT IN ({', '.join(map(str, sizes[mask]))})" if sizes else ""
        parts.append(f"transform(if({last} < 0{other}, cast(array() AS array<int>), sequence(0, {last}, {stride})), i -> named_struct('at', i, 'h', xxhash64({kept}, {k})))")
    return F.explode(F.expr(f"concat({', '.join(parts)})"))


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a row's doc_id and text."""
    return F.xxhash64(doc_id.cast("long"), text.cast("string")), F.xxhash64(F.lit(1), doc_id.cast("long"), text.cast("string"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8) -> DataFrame:
    """Rows (k1, k2, doc_id, item_id, matched, window_words, item_words): each document and item that it leaks, once.

    docs (doc_id, text, anything else); benchmark (item_id, text). k1 and k2 name doc_id and text. Items without
    words leak nowhere, and texts that are null or without words leak nothing. Items of equal words are searched
    once and reported under each of their ids, null too; repeated rows of docs are reported once. An empty table of
    either kind gives no rows. The masks hold for the default window and share.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "leaks")
    text = F.col("text").cast("string")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), k1.alias("k1"), k2.alias("k2"))
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("b")).where("size(b) > 0")
    named = keep.save(named.withColumn("item", F.concat(F.hex(F.xxhash64("b")), F.hex(F.xxhash64(F.lit(1), "b")))).distinct(), "named")
    items = keep.save(named.select("item", "b").distinct(), "items")
    longest = max(SHORT_MASKS) + 1
    short = sorted(r[0] for r in items.select(F.size("b")).where(f"size(b) < {longest}").distinct().collect())  # below `longest` values
    sizes: dict[tuple, list[int]] = {}
    for n in short:
        for mask in SHORT_MASKS[n]:
            sizes.setdefault(mask, []).append(n)
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))

    def seeds(masks, stride, own_items, sizes=None):
        test = own_items.select("item", hashed("b").alias("h")).select("item", _hashes(masks, 1, sizes).alias("x")).select("item", F.col("x.at").alias("bat"), F.col("x.h").alias("h"))
        test = keep.save(test, f"seeds-{stride}")
        train = src.select("k1", "k2", hashed(words(F.col("text"))).alias("h")).select("k1", "k2", _hashes(masks, stride).alias("x")).select("k1", "k2", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
        met = train.join(F.broadcast(test), "h") if test.count() <= BROADCAST_ROWS else salted(train, test, "h", "k1")
        return met.select("k1", "k2", "item", (F.col("at") - F.col("bat")).alias("shift"))

    hits = seeds(MASKS, STRIDE, items.where(f"size(b) >= {longest}"))
    if short:
        hits = hits.union(seeds(list(sizes), 1, items.where(f"size(b) < {longest}"), sizes))
    # All diagonals of a document and an item in one row, so that the document's words are copied once for each item.
    hits = keep.save(hits.groupBy("k1", "k2", "item").agg(F.collect_set("shift").alias("shifts")), "hits")

    held = src.join(hits.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("k1", "k2", "doc_id", words(F.col("text")).alias("w"))
    pairs = hits.join(items, "item").join(held, ["k1", "k2"]).withColumn("span", F.least(F.size("b"), F.lit(window)))
    same = "transform(b, (x, i) -> if(i + s >= 0 AND i + s < size(w) AND get(w, i + s) = x, 1, 0))"
    best = "array_max(transform(sequence(0, size(b) - span), i -> aggregate(slice(same, i + 1, span), 0, (a, x) -> a + x)))"
    matched = F.expr(f"array_max(transform(shifts, s -> transform(array({same}), same -> {best})[0]))")
    found = pairs.select("k1", "k2", "doc_id", "item", matched.alias("matched"), F.col("span").alias("window_words"), F.size("b").alias("item_words"))
    found = found.where(F.col("matched") >= F.ceil(F.lit(share) * F.col("window_words")))
    out = found.join(named.select("item", "item_id"), "item").select("k1", "k2", "doc_id", "item_id", "matched", "window_words", "item_words")
    out = keep.save(out, "found")
    keep.drop("named", "items", "hits", f"seeds-{STRIDE}", "seeds-1")
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: the pairs that leak."""
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("matched").cast("long").alias("matched"), F.col("window_words").cast("long").alias("window_words"), F.col("item_words").cast("long").alias("item_words"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; rows of equal doc_id and text stay or go together, and no other row goes."""
    keep = Scratch(spark, "clean")
    a, b = f"__k1_{keep.tag}", f"__k2_{keep.tag}"
    bad = keep.save(find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "leaks")
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    few = bad.count() <= BROADCAST_ROWS
    same = (k1 == F.col(a)) & (k2.bitwiseXOR(F.col(b)) == 0)  # joined by one number, checked by the other
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")
