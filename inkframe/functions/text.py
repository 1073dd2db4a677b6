"""Text predicates and normalisation as native columns."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that is trimmed and split on, the noise limits, the low-confidence limit.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"
MAX_NON_ALNUM, MIN_CONFIDENCE, LOW_CONFIDENCE = 0.6, 25.0, 65.0
_INNER = SPACE[1:-1]
_ALNUM = string.ascii_letters + string.digits


def strip(t: Column) -> Column:
    return F.regexp_replace(t, rf"\A{SPACE}+|{SPACE}+\z", "")


def has_ink(t: Column) -> Column:
    """Whether anything is left once white space is stripped; false for null."""
    return F.coalesce(t.rlike(f"[^{_INNER}]"), F.lit(False))


def normalize_space(t: Column) -> Column:
    return strip(F.regexp_replace(t, rf"{SPACE}+", " "))


def tokens(t: Column) -> Column:
    return F.filter(F.split(normalize_space(t), " "), lambda x: x != "")


def utf16_length(t: Column) -> Column:
    """Code units: characters beyond U+FFFF count twice."""
    return F.when(F.octet_length(t) == F.length(t), F.length(t)).otherwise((F.octet_length(F.encode(t, "UTF-16BE")) / 2).cast("int"))


def non_alnum_ratio(t: Column) -> Column:
    """Share of the code units that are no ASCII letter or digit."""
    units = utf16_length(t)
    return (units - F.length(t) + F.length(F.translate(t, _ALNUM, ""))) / units


def is_noise(text: Column, confidence: Column) -> Column:
    """Symbols only, four equal characters in a row, over 60 % non-alphanumeric, or (unless an acronym) a confidence under 25. Classes are ASCII; empty text is no noise."""
    t = F.coalesce(text, F.lit(""))
    doubtful = F.coalesce((confidence < MIN_CONFIDENCE) & ~F.isnan(confidence), F.lit(False)) & ~t.rlike(r"\A[A-Z]{3,}\z")
    run = (F.length(t) > 3) & t.rlike(r"(.)\1{3,}")
    # From the cheapest test to the dearest.
    return F.when(t == "", False).otherwise(doubtful | (non_alnum_ratio(t) > F.lit(MAX_NON_ALNUM)) | t.rlike(rf"\A[^\w\s{_INNER}]+\z") | run)


def word_passes(text: Column, confidence: Column, level: Column | str | None, edited: Column | bool = False) -> Column:
    lv = F.lit(level) if level is None or isinstance(level, str) else level
    ed = F.lit(edited) if isinstance(edited, bool) else F.coalesce(edited, F.lit(False))
    return ed | F.coalesce(lv, F.lit("")).isin("", "raw") | ~is_noise(text, confidence)


def capitalize_first(s: Column) -> Column:
    """Upper-case the first character and leave the rest."""
    return F.concat(F.upper(F.substring(s, 1, 1)), s.substr(F.lit(2), F.length(s)))


def half_up(x: Column) -> Column:
    """Round halves toward positive infinity."""
    return F.floor(x + 0.5)


def percent(progress: Column) -> Column:
    return half_up(progress * 100).cast("int")


def low_confidence(confidence: Column) -> Column:
    return F.coalesce((confidence < LOW_CONFIDENCE) & ~F.isnan(confidence), F.lit(False))


def after_comma(s: Column) -> Column:
    """The payload of a data URL: what follows the first comma, or all without one."""
    return F.when(F.instr(s, ",") > 0, s.substr(F.instr(s, ",") + 1, F.length(s))).otherwise(s)


def response_text(body: Column) -> Column:
    """Texts of a JSON answer's content blocks of type text, joined and trimmed; null where that leaves nothing."""
    parsed = F.from_json(body, "content array<struct<type: string, text: string>>")["content"]
    parts = F.transform(F.filter(parsed, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit("")))
    out = strip(F.array_join(parts, ""))
    return F.when(out != "", out)


def status_message(code: Column) -> Column:
    return F.when(code == 401, "key rejected").when(code == 429, "rate limited").when(code >= 500, "service unavailable").when((code < 200) | (code > 299), "request failed")
