"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import exact, small_batches, slices, table, tidy

BUCKETS = 1 << 15
MOST_LANGS = 500  # of a model, which every worker holds
ORDERS = (1, 2, 3)
_SLICE = 1 << 18
_TEXTS = 16  # texts that are scored together
_LETTER = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(c.isalpha() for c in text))


def held_out(doc_id) -> bool:
    """crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


_CODES = np.random.Generator(np.random.PCG64(7)).integers(1, 2**64, len(ORDERS), dtype=np.uint64) | np.uint64(1)


def grams(texts: list[str]):
    """Pairs of arrays (text number, ascending, and bucket number) of all n-grams of the lower-cased texts, piece by piece."""
    low = [f" {t.lower()} " for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "replace"), "<u4")
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    for at in range(0, len(chars), _SLICE):
        end = at + _SLICE + max(ORDERS) - 1
        c, o = chars[at:end].astype(np.uint64), owner[at:end]
        h = c * _CODES[0]
        for n in ORDERS:  # each order's hashes come from those before
            if n > 1:
                h = (h ^ (h >> np.uint64(29)))[:-1] * _CODES[n - 1] + c[n - 1 :]
            k = min(_SLICE, len(h))
            if k > 0:
                bucket = ((h[:k] + np.uint64(n)) * _CODES[1] >> np.uint64(64 - 15)).astype(np.int64)
                if n == 1 or o[0] == o[-1]:
                    yield o[:k], bucket
                else:
                    inside = o[:k] == o[n - 1 : n - 1 + k]
                    yield o[:k][inside], bucket[inside]


class Model:
    """Log-probabilities (buckets x languages) with add-one smoothing; all languages alike a priori."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.logp = np.log((counts + 1.0) / (counts.sum(0) + len(counts)))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its probability; und and 0 for texts that are null or without a letter, and for all without languages."""
        out = [("und", 0.0)] * len(texts)
        todo = [k for k, t in enumerate(texts) if has_letter(t)] if self.langs else []
        for at in range(0, len(todo), _TEXTS):
            own = todo[at : at + _TEXTS]
            total = np.zeros((len(own), len(self.langs)))
            for row, bucket in grams([texts[k] for k in own]):
                # The sparse matrix of the texts' n-grams, an entry each, by its rows, times the log-probabilities.
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[first]] += np.add.reduceat(self.logp.take(bucket, axis=0), first)
            best = total.argmax(1)
            share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            for k, lang, p in zip(own, best.tolist(), share.tolist(), strict=True):
                out[k] = self.langs[lang], p
        return out


def train(docs: DataFrame) -> Model:
    """Counts over all documents with text and lang (doc_id, text, lang); the sums go to the driver, buckets x languages.

    Rows whose text or lang is null teach nothing; repeated rows count as often as they occur. Without any row the
    model has no languages; a table of more than MOST_LANGS values of lang raises.
    """

    @tidy
    def run(it):
        counts: dict[str, np.ndarray] = {}
        for b in slices(it):
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                sums = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for _, bucket in grams(own):
                    sums += np.bincount(bucket, minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    small_batches(docs.sparkSession)
    known = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    if (found := docs.agg(F.approx_count_distinct(F.col("lang").cast("string"))).first()[0]) > MOST_LANGS:
        raise ValueError(f"about {found} values of lang: more than a model holds")
    sums = known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts = np.zeros((BUCKETS, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    counts[sums.column("bucket").to_numpy(), [place[x] for x in sums.column("lang").to_pylist()]] = sums.column("n").to_numpy()
    return Model(langs, counts)


def predictor(spark: SparkSession, model: Model):
    """Column function: text to a struct (lang_pred, score), und and 0 where the text is null or has no letter."""
    shared = spark.sparkContext.broadcast(model)  # buckets x languages, of which there are MOST_LANGS at most

    def predict(texts: pa.Array) -> pa.Array:
        got = [x for at in range(0, len(texts), _TEXTS) for x in shared.value.predict(texts.slice(at, _TEXTS).to_pylist())]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], ["lang_pred", "score"])

    small_batches(spark)
    return F.arrow_udf(predict, "lang_pred string, score double")


def not_held_out() -> object:
    """Column: the row may be learned from."""
    return F.col("doc_id").isNull() | (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    call = predictor(spark, train(docs.where(not_held_out())))
    own = docs.select("doc_id", call(F.col("text").cast("string")).alias("p"))
    return own.select("doc_id", (~not_held_out()).alias("held_out"), "p.lang_pred", "p.score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; those without text, or without a letter in it, go. Without labels to learn from, too. Columns may have any names."""
    model = train(exact(docs, "doc_id", "text", "lang").where(not_held_out()))
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    text = F.col(f"c{docs.columns.index('text')}").cast("string")
    if model.langs:  # a score is 0 for texts without a letter only
        own = own.withColumn("p", predictor(spark, model)(text)).where("p.score > 0").drop("p")
    else:
        own = own.where(F.arrow_udf(lambda texts: pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_()), "boolean")(text))
    return own.toDF(*docs.columns)
