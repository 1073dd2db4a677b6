"""Files in, text out, and the boundary to a recognizer (none is shipped)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.functions.text import after_comma
from inkframe.operators import evaluate, glyphs, png, scan
from inkframe.operators.images import decode
from inkframe.operators.layout import BLOCKS

#: Largest file, MIME types by extension.
MAX_BYTES = 15 * 1024 * 1024
MIME = {"html": "text/html", "js": "text/javascript", "css": "text/css", "json": "application/json", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}


def mime_type(path: Column) -> Column:
    """By extension, without the query string; application/octet-stream otherwise."""
    ext = F.lower(F.substring_index(F.substring_index(path, "?", 1), ".", -1))
    pairs = [F.lit(x) for kv in MIME.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[ext], F.lit("application/octet-stream"))


def rejection(mime: Column, length: Column) -> Column:
    """type for what is no image, else size for more than 15 MiB, else null."""
    return F.when(~F.coalesce(mime, F.lit("")).startswith("image/"), "type").when(length > MAX_BYTES, "size")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, mime, length, content, error; the content of a rejected file is null."""
    f = spark.read.format("binaryFile").load(path).withColumn("mime", mime_type(F.col("path")))
    f = f.withColumn("error", rejection(F.col("mime"), F.col("length")))
    return f.select("path", "mime", "length", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


def pasted(items: DataFrame) -> DataFrame:
    """The first image of each clipboard (clip_id, ordinal, mime, ...)."""
    by = Window.partitionBy("clip_id").orderBy("ordinal")
    return items.where("mime LIKE 'image/%'").withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def first_files(items: DataFrame) -> DataFrame:
    """The first file of each drop (drop_id, ordinal, ...); the others are left out."""
    by = Window.partitionBy("drop_id").orderBy("ordinal")
    return items.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def payload(url: Column) -> Column:
    """Bytes of a data URL's base64 payload; null where it is none."""
    return F.try_to_binary(after_comma(url), F.lit("base64"))


#: The sample page: its size, and the lines with their left upper corner and font size.
SAMPLE_SIZE = (640, 220)
SAMPLE_LINES = (("Sample page", 30, 36, 36.0), ("Second line: 12.50", 30, 96, 24.0), ("Third line", 30, 136, 24.0), ("END", 30, 180, 18.0))


def sample_image() -> bytes:
    """The PNG file of the sample page, black on white."""
    width, height = SAMPLE_SIZE
    page = np.full((height, width, 4), 255, np.uint8)
    for text, x, y, font in SAMPLE_LINES:
        glyphs.paint(page, text, x, y, font)
    return png.encode(page)


def sample_page(spark: SparkSession) -> DataFrame:
    """The sample page's image and text: (scan_id, content, line_index, text), a row per line."""
    rows = [(0, bytearray(sample_image()), k, line[0]) for k, line in enumerate(SAMPLE_LINES)]
    return spark.createDataFrame(rows, "scan_id long, content binary, line_index int, text string")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the .txt files of a folder."""
    t = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return t.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("name"), F.col("value").alias("text"))


def write_text(texts: DataFrame, path: str) -> None:
    """The non-empty texts of (scan_id, text), one file line per text line."""
    texts.where("text <> ''").select("text").write.mode("overwrite").text(path)


class Recognizer(Protocol):
    """One engine, opened once per task and closed in any case; the same for single recognitions and whole scans (operators.scan)."""

    def recognize(self, image: np.ndarray, mode: int, rotate: bool) -> dict:
        """text, rotate_radians and blocks (layout.BLOCKS) of pixels (height, width, channels), or (height, width) of grey, by segmentation mode."""

    def close(self) -> None: ...


PAGES = f"scan_id long, pass string, width int, height int, natural_width int, natural_height int, rotate_radians double, text string, blocks {BLOCKS}, error string"


def recognize(images: DataFrame, engine: type, name: str = "raw", mode: int = scan.AUTO) -> DataFrame:
    """Results of one recognition of each whole image (scan_id, content); a failure, or content that cannot be read, gives a row with its error."""
    columns = [c.split()[0] for c in PAGES.split(f", blocks {BLOCKS}")[0].split(", ")] + ["blocks", "error"]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = engine()
        try:
            for pdf in it:
                rows = []
                for scan_id, content in zip(pdf["scan_id"], pdf["content"], strict=True):
                    row = {"scan_id": scan_id, "pass": name}
                    try:
                        if (pixels := decode(content)) is None:
                            raise ValueError("the image cannot be read")
                        h, w = pixels.shape[:2]
                        found = tool.recognize(pixels, mode, True)
                        row |= {"width": w, "height": h, "natural_width": w, "natural_height": h, **{k: found.get(k) for k in ("rotate_radians", "text", "blocks")}}
                    except Exception as e:  # noqa: BLE001  a bad image must not end the job
                        row["error"] = str(e)
                    rows.append(row)
                yield pd.DataFrame(rows).reindex(columns=columns).astype(object).where(lambda d: d.notna(), None)
        finally:
            tool.close()

    return images.select("scan_id", "content").mapInPandas(run, PAGES)


def dispatch(images: DataFrame, platform: str, native: type, other: type) -> DataFrame:
    """The native engine on a native platform, else the other."""
    return recognize(images, native if platform == "native" else other)


def benchmark(spark: SparkSession, truths: str, images: str, engine: type) -> DataFrame:
    """Report lines (name, line) of a recognizer on a folder of images against a folder of .txt files of the same names.

    Each text is one line: error rates and seconds of the image's scan, or why there are none. Of several images of one
    name the first by its whole name counts; images without a text are left out.
    """
    refs = read_ground_truth(spark, truths)
    found = read_images(spark, images).withColumn("file", F.element_at(F.split("path", "/"), -1))
    found = found.withColumn("name", F.regexp_replace("file", r"\.[^.]*$", "")).join(refs.select("name"), "name", "left_semi")
    first = found.groupBy("name").agg(F.min_by(F.struct("content", "error"), "file").alias("f")).select("name", "f.*")
    scanned = scan.timed_scan(first.where("error IS NULL"), engine)
    hyps = scanned.unionByName(first.where("error IS NOT NULL").select("name", "error"), allowMissingColumns=True)
    return evaluate.report(evaluate.evaluate(hyps, refs))
