"""Edit distance, character and word error rates, evaluation report."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkframe.functions.text import normalize_space, tokens


#: Length of a side up to which Spark's own distance is taken, whose time grows with the product of both.
MOST_LENGTH = 4096
#: Rows to either side of the diagonal that are tried first.
BAND = 64


def _places(a: Sequence) -> tuple[dict, dict]:
    """Where each item of a occurs, and bits of the places of those that occur often: no more of them than the root of a's length."""
    places: dict = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    return places, {x: _bits(at, 0) for x, at in places.items() if len(at) ** 2 > len(a)}


def _bits(at: Sequence[int], start: int) -> int:
    bits = bytearray((at[-1] - start) // 8 + 1) if at else b""
    for k in at:
        bits[(k - start) >> 3] |= 1 << ((k - start) & 7)
    return int.from_bytes(bits, "little")


def _whole(a: Sequence, b: Sequence) -> int:
    """Edit distance by whole columns of the table, a down."""
    m = len(a)
    places, often = _places(a)
    full, high = (1 << m) - 1, 1 << (m - 1)
    more, less, score = full, 0, m  # rows where the column rises, and where it falls
    for x in b:
        same = often.get(x) or _bits(places.get(x, ()), 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | (full & ~(across | more)), more & across
        score += 1 if up & high else -1 if down & high else 0
        up, down, same = (up << 1 | 1) & full, down << 1 & full, same | less
        more, less = down | (full & ~(same | up)), up & same
    return score


def _banded(a: Sequence, b: Sequence, most: int, known: tuple[dict, dict]) -> int:
    """Edit distance where it is `most` at most, else a larger number: of each column, a (the longer side) down, what lies within `most` of the diagonal; `most` is less than a is long."""
    places, often = known
    wide = 2 * most + 2
    full, edge, row = (1 << wide) - 1, 1 << (wide - 1), 1 << (wide - 2)
    more, less, score = full & (full << (wide - most - 1)), 0, most
    for i, x in enumerate(b):
        start = most + 1 - wide + i  # the first row of the band
        if x in often:
            same = (often[x] >> start if start >= 0 else often[x] << -start) & full
        else:
            at = places.get(x, ())
            at = at[bisect_left(at, start) : bisect_left(at, start + wide)]
            same = _bits(at, start)
        down = (((same & more) + more) ^ more | same | less) & full  # where the diagonal does not rise
        up, fall = less | (full & ~(down | more)), down & more
        if i < len(a) - most:  # along the diagonal to the last row, then along that row
            score += not down & edge
        else:
            score += (up & row > 0) - (fall & row > 0)
            row >>= 1
        if score > most + len(b) - (len(a) - most):  # it cannot come down far enough
            return score
        more, less = fall | (full & ~(down >> 1 | up)), down >> 1 & up
    return score


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance, exact at any length, with memory by one side: a column of the table is two numbers of a bit a row, and of a column only a band about the diagonal is kept, which doubles until the distance fits it."""
    first = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[first:], b[first:]
    last = next((k for k, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=False)) if x != y), min(len(a), len(b)))
    b, a = sorted((a[: len(a) - last], b[: len(b) - last]), key=len)
    if not b:
        return len(a)
    most, known = max(BAND, len(a) - len(b)), None
    while 4 * most < len(b):
        known = known or _places(a)
        if (found := _banded(a, b, most, known)) <= most:
            return found
        most *= 2
    return _whole(b, a)


def _distances(kind: str):
    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        own = str if kind == "text" else list
        return pd.Series([None if x is None or y is None else distance(own(x), own(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return run


def _by_length(a: Column, b: Column, fits: Column, native: Column, kind: str) -> Column:
    """`native` where it fits, the bit-parallel distance elsewhere; rows that fit send nothing to Python."""
    return F.when(fits, native).otherwise(_distances(kind)(F.when(~fits, a), F.when(~fits, b)))


def text_distance(a: Column, b: Column) -> Column:
    """Edit distance of texts in code points."""
    return _by_length(a, b, (F.length(a) <= MOST_LENGTH) & (F.length(b) <= MOST_LENGTH), F.levenshtein(a, b), "text")


def character_error_rate(hyp: Column, ref: Column) -> Column:
    """Edits per reference character after white space is normalised; an empty reference gives 0 or 1. Can exceed 1."""
    h, r = normalize_space(hyp), normalize_space(ref)
    return F.when(F.length(r) == 0, F.when(F.length(h) == 0, 0.0).otherwise(1.0)).otherwise(text_distance(h, r) / F.length(r))


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of arrays: each distinct word of a short pair becomes one character, beyond the surrogates where need be."""
    words = F.array_distinct(F.concat(a, b))
    number = lambda w: F.array_position(words, w) + F.when(F.array_position(words, w) < 55296, 0).otherwise(2048)
    one = lambda w: F.decode(F.unhex(F.lpad(F.hex(number(w)), 8, "0")), "UTF-32")
    fits = (F.size(a) <= MOST_LENGTH) & (F.size(b) <= MOST_LENGTH)
    native = F.levenshtein(F.array_join(F.transform(a, one), ""), F.array_join(F.transform(b, one), ""))
    return _by_length(a, b, fits, F.when(fits, native), "array")


def word_error_rate(hyp: Column, ref: Column) -> Column:
    h, r = tokens(hyp), tokens(ref)
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(token_distance(h, r) / F.size(r))


def evaluate(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """refs (name, text) against hyps (name, text[, elapsed_ms][, error]): name, cer, wer, elapsed_ms, error. A reference without result gives an error row."""
    reason = F.col("error").cast("string") if "error" in hyps.columns else F.lit(None).cast("string")
    h = hyps.select("name", reason.alias("reason"), F.col("text").alias("hyp"), F.lit(True).alias("found"), (F.col("elapsed_ms") if "elapsed_ms" in hyps.columns else F.lit(None)).cast("long").alias("elapsed_ms"))
    j = refs.select("name", F.col("text").alias("ref")).join(h, "name", "left")
    ok = F.col("found") & F.col("hyp").isNotNull()
    return j.select("name", F.when(ok, character_error_rate(F.col("hyp"), F.col("ref"))).alias("cer"), F.when(ok, word_error_rate(F.col("hyp"), F.col("ref"))).alias("wer"), "elapsed_ms", F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("reason", F.lit("no result"))).alias("error"))


def report(results: DataFrame) -> DataFrame:
    """One text line per result: name padded to 15 (never cut), percentages and seconds with one decimal, or the error."""
    name = F.when(F.length("name") < 15, F.rpad("name", 15, " ")).otherwise(F.col("name"))
    one = lambda x: F.round(x, 1)
    seconds = F.coalesce(F.col("elapsed_ms") / 1000.0, F.lit(0.0))
    good = F.format_string("%s %5.1f%%   %5.1f%%   %.1fs", name, one(F.col("cer") * 100), one(F.col("wer") * 100), one(seconds))
    return results.select("name", F.when(F.col("error").isNull(), good).otherwise(F.concat(name, F.lit(" ERROR: "), F.col("error"))).alias("line"))
