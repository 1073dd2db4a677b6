"""Audit of five text filters in every order: what each removes, repeats, and costs.

Batches of texts are scanned as Arrow buffers: byte classes and prefix sums give words, capitals, symbols and code
points; hashes of a document's words, sorted, give its distinct words, equal neighbours being compared byte by byte.
A document comes down to one mask of failed filters; counts of masks a part answer every order.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, exact, mix64, salted, slices, table, tidy

LETTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
#: Classes of bytes: 1 space, 2 capital, 4 symbol, 8 continues a code point.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[32, *range(9, 14)]] = 1
_CLASS[65:91] = 2
_CLASS[list(SYMBOLS)] = 4
_CLASS[0x80:0xC0] = 8
_LONG = 64  # bytes of a word from which it is hashed and compared on its own
_RUN = 4 << 20  # bytes of text that are scanned at once, and a text's whole length if it is longer
FIXED = {"words": 200, "distinct": 50, "capitals": 2}  # fixed values of the filters: least words, percents

_WORD = r"'[^\x20\x09-\x0D]+'"
OP13_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT t.part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(s, '[^A-Z]', '', 'g')) > 2 * length(s), regexp_matches(s, '[#$%&*|]'),
  t.doc_id > min(t.doc_id) OVER (PARTITION BY s)] AS f, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id),
m AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM g GROUP BY ALL),
p AS (SELECT unnest(range(1, 6)) AS k), o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM p a, p b, p c, p d, p e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (SELECT part, o, step, n, good, toxic, f[o[step]] AS fails, len(list_filter(o[1:step - 1], lambda i: f[i])) > 0 AS before, len(list_filter(f, lambda v: v)) AS many FROM m, s),
q AS (SELECT part, list_aggregate(list_transform(o, lambda i: 'ABCDE'[i]), 'string_agg', '') AS filter_order, step, o[step] AS letter, CAST(sum(CASE WHEN NOT fails AND NOT before THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fails AND NOT before THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN fails AND before THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN fails AND NOT before THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fails AND NOT before THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q"""


def _load(raw: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each place as a number, of which `left` belong to the word; raw has eight bytes to spare."""
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[at]
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)))


def _hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = mix64(size.astype(np.uint64))
    for at in range(0, _LONG, 8):
        some = np.flatnonzero((size > at) & (size <= _LONG))
        if not len(some):
            break
        h[some] = mix64(h[some] ^ _load(raw, start[some] + at, size[some] - at))
    for k in np.flatnonzero(size > _LONG).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(raw[start[k] : start[k] + size[k]], digest_size=8).digest(), "little")
    return h


def _equal(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether words at places a and b, of one size, hold the same bytes."""
    same = np.ones(len(a), bool)
    for at in range(0, _LONG, 8):
        some = np.flatnonzero((size > at) & (size <= _LONG))
        if not len(some):
            break
        left = size[some] - at
        same[some] &= _load(raw, a[some] + at, left) == _load(raw, b[some] + at, left)
    for k in np.flatnonzero(size > _LONG).tolist():
        same[k] = np.array_equal(raw[a[k] : a[k] + size[k]], raw[b[k] : b[k] + size[k]])
    return same


def distinct_words(raw: np.ndarray, start: np.ndarray, size: np.ndarray, doc: np.ndarray, docs: int, hashes=_hashes) -> np.ndarray:
    """Distinct words of each document, from its words' places in raw (with eight bytes to spare); doc ascends."""
    bits = max(1, int(docs).bit_length())
    key = (doc.astype(np.uint64) << np.uint64(64 - bits)) | (hashes(raw, start, size) >> np.uint64(bits))
    order = np.argsort(key)
    key = key[order]
    twin = np.flatnonzero(key[1:] == key[:-1])  # with the next
    a, b = order[twin], order[twin + 1]
    same = size[a] == size[b]
    same[same] = _equal(raw, start[a[same]], start[b[same]], size[a[same]])
    out = np.bincount(doc, minlength=docs) - np.bincount(doc[a[same]], minlength=docs)
    for d in np.unique(doc[a[~same]]).tolist():  # different words of one hash: count these documents again
        mine = slice(*np.searchsorted(doc, [d, d + 1]).tolist())
        out[d] = len({raw[s : s + n].tobytes() for s, n in zip(start[mine].tolist(), size[mine].tolist(), strict=True)})
    return out


def scan(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, symbols and code points of each text (null: empty)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.zeros(int(ends[-1] - ends[0]) + 8, np.uint8)  # eight to spare
    if len(raw) > 8:
        raw[:-8] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _CLASS[raw[:-8]]

    def count(hit: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[ends])

    word = np.concatenate([[False], (kind & 1) == 0, [False]])
    first = word[1:-1] & ~word[:-2]  # of a word
    last = word[1:-1] & ~word[2:]
    inner = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(kind))]
    first[inner], last[inner - 1] = word[1:-1][inner], word[1:-1][inner - 1]  # a text's end ends a word
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(ends, start, "right") - 1
    return {
        "words": np.bincount(doc, minlength=n),
        "distinct": distinct_words(raw, start, stop - start, doc, n),
        "capitals": count(kind & 2 > 0),
        "symbols": count(kind & 4 > 0),
        "points": count(kind & 8 == 0),
    }


def masks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, text) to (doc_id, part, fails, digest): bits 1 to 8 of the failed filters A to D, SHA-256 of the text (null: empty)."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        text = t.column("text").fill_null("")
        s = scan(text)
        fails = (s["words"] < FIXED["words"]) * 1 + (100 * s["distinct"] < FIXED["distinct"] * s["words"]) * 2 + (100 * s["capitals"] > FIXED["capitals"] * s["points"]) * 4 + (s["symbols"] > 0) * 8
        digests = [hashlib.sha256(v.as_buffer()).digest() for v in text.cast(pa.large_binary())]
        return pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("part"), pa.array(fails.astype(np.int32)), pa.array(digests, pa.binary())], ["doc_id", "part", "fails", "digest"])

    @tidy
    def run(it):
        held, size = [], 0
        for b in slices(it):
            for k, n in enumerate(pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()):
                if held and size + n > _RUN:
                    yield work(held)
                    held, size = [], 0
                held.append(b.slice(k, 1))
                size += n
        if held:
            yield work(held)

    return docs.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def failures(docs: DataFrame, keep: Scratch) -> DataFrame:
    """docs (doc_id, source, text, anything else) to (doc_id, part, fails): bit 16 added for a text that a smaller doc_id has as well, null counting as larger than any."""
    src = exact(docs, "doc_id", "source", "text")
    src = src.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = keep.save(masks(src), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1 AND first IS NOT NULL").drop("c")
    later = salted(rows, first, "digest", "doc_id").where("doc_id > first OR doc_id IS NULL")
    later = later.select("doc_id", "part", (F.col("fails") + 16).alias("fails"), F.lit(1).alias("n"))
    # The rest is what is not among them, and only counts of masks a document are needed: no join back.
    back = later.select("doc_id", "part", (F.col("fails") - 16).alias("fails"), F.lit(-1).alias("n"))
    every = rows.select("doc_id", "part", "fails", F.lit(1).alias("n"))
    return every.unionByName(later).unionByName(back)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (source, null as empty), filter_order (all 120 of ABCDE) and step (1 to 5), of whole texts, null counting as empty.

    A: under 200 words; B: under 50 % distinct words; C: over 2 % capitals; D: a symbol of #$%&*|; E: a smaller doc_id has
    the same text. Counts within the part: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley. A
    document is good, or toxic, if any row of labels (doc_id, quality, toxic) for it says 1; one without doc_id has no
    labels. Rows that repeat a doc_id count each, and are no copies of each other. Empty documents give no rows.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "audit")
    marks = exact(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*[F.max(F.col(c).eqNullSafe(1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    each = failures(docs, keep).groupBy("doc_id", "part", "fails").agg(F.sum("n").alias("n")).where("n > 0").join(marks, "doc_id", "left")
    sums = each.groupBy("part", "fails").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])
    sums = keep.save(sums, "sums")  # 32 rows a part at most
    keep.drop("masks")
    steps = []
    for order in itertools.permutations(range(len(LETTERS))):
        name = "".join(LETTERS[k] for k in order)
        steps += [f"struct('{name}' AS filter_order, {k + 1} AS step, {1 << letter} AS bit, {sum(1 << x for x in order[:k])} AS before)" for k, letter in enumerate(order)]
    s = sums.withColumn("s", F.explode(F.expr(f"array({', '.join(steps)})"))).select("part", "fails", "n", "good", "toxic", "s.*")
    fails, before = F.col("fails").bitwiseAND(F.col("bit")) > 0, F.col("fails").bitwiseAND(F.col("before")) > 0
    total = lambda where, what, name: F.sum(F.when(where, F.col(what)).otherwise(0)).cast("long").alias(name)
    # Of the 120 orders, each of a document's k failing filters comes first in 120 / k.
    share = F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(fails)")).otherwise(0)).cast("long").alias("shapley")
    gone = fails & ~before
    return s.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before, "n", "kept"),
        total(gone, "n", "removed"),
        total(fails & before, "n", "redundant"),
        total(F.col("fails") == F.col("bit"), "n", "unique_fails"),
        total(gone, "good", "good_lost"),
        total(gone, "toxic", "toxic_lost"),
        share,
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and labels."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
