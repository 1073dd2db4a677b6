"""Nested recognizer results, small images and event tables derived from plain documents, for the registered queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.operators import png
from inkframe.operators.layout import BLOCKS, ELEMENTS
from inkframe.plans import photos


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scan_id"), F.split("text", "\n").alias("ls"))


def _words(line: Column) -> Column:
    return F.filter(F.split(line, " +"), lambda x: x != "")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, pass, blocks): five lines a block, two a paragraph.

    With m = 7 * line + word: words of m % 13 = 0 are blank, of m % 29 = 0 null, of m % 17 = 0 without confidence, of
    m % 4 = 0 padded. Blocks of number % 3 = 2 have no paragraphs, of number % 5 = 4 no area.
    """
    number = lambda c: c.cast("double")

    def line(text: Column, i: Column, scan: Column) -> Column:
        def word(w: Column, k: Column) -> Column:
            m = i * 7 + k
            shown = F.when(m % 13 == 0, "  ").when(m % 29 == 0, F.lit(None)).when(m % 4 == 0, F.concat(F.lit(" "), w, F.lit("\t"))).otherwise(w)
            confidence = F.when(m % 17 != 0, number((scan * 31 + i * 17 + k * 7) % 101))
            box = F.struct(number(k * 60).alias("x0"), number(i * 20).alias("y0"), number(k * 60 + 50).alias("x1"), number(i * 20 + 15).alias("y1"))
            return F.struct(shown.alias("text"), confidence.alias("confidence"), box.alias("bbox"))

        box = F.struct(F.lit(0.0).alias("x0"), number(i * 20).alias("y0"), number(F.length(text) * 10).alias("x1"), number(i * 20 + 15).alias("y1"))
        return F.struct(box.alias("bbox"), F.transform(_words(text), word).alias("words"))

    def block(b: Column, scan: Column) -> Column:
        box = F.struct(F.lit(0.0).alias("x0"), number(b * 100).alias("y0"), F.when(b % 5 == 4, 0.0).otherwise(500.0).alias("x1"), number(b * 100 + 90).alias("y1"))
        count = F.size("ls")
        of = lambda p: F.filter(F.sequence(b * 5 + p * 2, F.least(b * 5 + p * 2 + 1, b * 5 + 4)), lambda i: i < count)
        paragraph = lambda p: F.struct(F.transform(of(p), lambda i: line(F.get("ls", i), i, scan)).alias("lines"))
        return F.struct(box.alias("bbox"), F.when(b % 3 != 2, F.transform(F.sequence(F.lit(0), F.lit(2)), paragraph)).alias("paragraphs"))

    d = _lines(spark, sf_dir)
    last = F.floor((F.size("ls") - 1) / 5).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: block(b, F.col("scan_id")))
    return d.select("scan_id", F.lit("raw").alias("pass"), blocks.cast(BLOCKS).alias("blocks"))


def element_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, blocks) without confidences: three lines a block; with m = 5 * line + word elements of m % 11 = 0 are blank, of m % 23 = 0 null."""
    number = lambda c: c.cast("double")

    def line(text: Column, i: Column) -> Column:
        def element(w: Column, k: Column) -> Column:
            m = i * 5 + k
            shown = F.when(m % 11 == 0, " ").when(m % 23 == 0, F.lit(None)).otherwise(w)
            box = F.struct(number(k * 60).alias("left"), number(i * 20).alias("top"), number(k * 60 + 50).alias("right"), number(i * 20 + 15).alias("bottom"))
            return F.struct(shown.alias("text"), box.alias("boundingBox"))

        return F.struct(F.transform(_words(text), element).alias("elements"))

    d = _lines(spark, sf_dir)
    count = F.size("ls")
    of = lambda b: F.filter(F.sequence(b * 3, b * 3 + 2), lambda i: i < count)
    last = F.floor((count - 1) / 3).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.struct(F.transform(of(b), lambda i: line(F.get("ls", i), i)).alias("lines")))
    return d.select("scan_id", blocks.cast(ELEMENTS).alias("blocks"))


#: Pixels in a row of a text's image.
ACROSS = 64


def picture(text: str | None) -> np.ndarray:
    """The image of a text, RGBA: a pixel a character, in rows of 64; with c its code point % 256, or 255 after the end, red c, green 2 c, blue 3 c, all % 256."""
    code = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4") & 255
    c = np.full((max(1, -(-len(code) // ACROSS)), ACROSS), 255)
    c.ravel()[: len(code)] = code
    return np.stack([c, 2 * c, 3 * c, np.full(c.shape, 255)], 2).astype(np.uint8)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scan_id"), "text")


def _files(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), 64):  # a few files at a time
                some = pdf[at : at + 64]
                yield pd.DataFrame({"scan_id": some["scan_id"], "content": [make(s, t) for s, t in zip(some["scan_id"], some["text"], strict=True)]})

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("scan_id"), "text")
    # Making and reading a file takes longer than moving its text: as many tasks as shuffles have.
    return d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "scan_id").mapInPandas(run, "scan_id long, content binary")


def photos_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, content): a JPEG file of each whole text, in colour for odd ids."""
    return _files(spark, sf_dir, lambda scan, text: photos.photo(text, scan % 2 == 1))


#: Pixels of a page's picture: a tenth of those that its boxes are given in.
PAGE_WIDTH, PAGE_HEIGHT = 160, 400


def page_file(text: str | None) -> bytes:
    """A PNG page of one colour, with c the text's first code point % 256 (or 255): red c, green 2 c, blue 3 c, all % 256; its first pixel is black."""
    c = ord(text[0]) % 256 if text else 255
    page = png.plain(PAGE_WIDTH, PAGE_HEIGHT, (c, 2 * c % 256, 3 * c % 256, 255))
    page[0, 0, :3] = 0
    return png.encode(page)


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scan_id, content): the page of each text."""
    return _files(spark, sf_dir, lambda scan, text: page_file(text))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, ordinal, mime): five items a clipboard, by the length of a text."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("clip_id"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ordinal"))
    kinds = F.array(*[F.lit(x) for x in ("text/plain", "image/png", "text/html", "image/jpeg", "application/json")])
    return d.withColumn("mime", F.get(kinds, F.pmod(F.col("n") * 3 + F.col("ordinal") * (F.col("clip_id") % 4 + 1), F.lit(5)).cast("int"))).drop("n")
