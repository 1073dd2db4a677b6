"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, source mixing, binary token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet under the
shared folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm import decontaminate, language_id, source_mix, token_binary
from inkframe.llm.common import Scratch, salted, table
from inkframe.llm.ngram_join import text_groups, text_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without a letter go."""
    return language_id.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-word shingles at a Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays, null last.

    Rows go by doc_id and text, so another text under the same doc_id is judged on its own. Texts without words link
    with nothing: of rows of equal doc_id and such a text one stays, without doc_id all. No column of docs is taken
    for one of this function's own, whatever its name.
    """
    keep = Scratch(spark, "unique")
    texts = text_groups(docs, keep, n=5, p=8, q=10, chunk=512)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2").alias("row")
    rows = texts.select("h1", "h2", "g1", "g2", "n", F.explode("ids").alias("doc_id")).select("h1", "g1", "g2", (F.col("n") > 0).alias("worded"), row)
    rows = keep.save(rows.groupBy("h1", "g1", "g2", "worded", "row").agg(F.count("*").alias("times")), "rows")
    worded = rows.where("worded")
    best = worded.groupBy("g1", "g2").agg(F.min("row").alias("best"))
    gone = salted(worded, best, ["g1", "g2"], "h1").where("row <> best").select("row.*").withColumn("gone", F.lit(True))
    twice = rows.where("times > 1 AND (worded OR NOT row.none)").select("row.*").withColumn("gone", F.lit(False))
    marks = keep.save(gone.union(twice.join(gone, ["none", "h1", "h2", "doc_id"], "left_anti").select(*gone.columns)), "marks")
    keep.drop("texts", "rows")
    h1, h2 = text_key(F.col("text"))
    doc_id = F.col("doc_id").cast("long")

    def among(which: DataFrame):
        """Rows, and the condition that a row of docs is one of them: joined by one number, checked by another."""
        name = lambda d, a, b: F.xxhash64(d, a, b)
        m = which.select(name("doc_id", "h1", "h2").alias(f"__name_{keep.tag}"), F.col("h1").alias(f"__h1_{keep.tag}"))
        few = which.count() <= decontaminate.BROADCAST_ROWS  # of 16 bytes each
        same = (name(doc_id, h1, h2) == F.col(m.columns[0])) & (h1.bitwiseXOR(F.col(m.columns[1])) == 0)
        return F.broadcast(m) if few else m, same

    left = docs.join(*among(marks.where("gone")), "left_anti")
    again = marks.where("NOT gone")
    if again.isEmpty():
        return left
    name = f"__row_{keep.tag}"
    once = left.join(*among(again), "left_semi").withColumn(name, F.struct(doc_id, h1, h2)).dropDuplicates([name]).drop(name)
    return left.join(*among(again), "left_anti").unionByName(once)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.stage(spark, docs, sf_dir)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources at weights 1, 2, 3, repeating, takes it."""
    return source_mix.stage(spark, docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, which stay, read back: doc_id, start, n_tokens, ids_crc32, and the file that holds the document."""
    return token_binary.token_binary(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mix), ("tokens", tokens)]

#: The mix is an iterative solution and the ids come from a tokenizer library: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = keep.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            keep.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
