import math
import random

import pytest
from pyspark.sql import functions as F

from inkframe.functions import geometry as geo
from inkframe.functions import text as tx
from inkframe.operators import evaluate

NOISE = [("", 1.0, False), (None, 1.0, False), ("!!", 99.0, True), ("–", 99.0, True), ("é", 99.0, True), ("日本語", 99.0, True), ("1000000", 99.0, True), ("AAAA", 99.0, True), ("AAA", 5.0, False), ("$5", 99.0, False), ("$5.", 99.0, True), ("(a)", 99.0, True), ("a-b--", 99.0, False), ("___", 99.0, True), ("5/5", 99.0, False), ("café", 99.0, False), ("AB", 10.0, True), ("Quiz", 24.9, True), ("Quiz", 25.0, False), ("Quiz", None, False), ("Quiz", math.nan, False), ("!\n", 99.0, True)]


def one(spark, col, **values):
    cols = {k: F.lit(v) for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).select(col).first()[0]


def test_noise_table(spark):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(NOISE)], "i int, t string, c double")
    got = [r[0] for r in rows.orderBy("i").select(tx.is_noise(F.col("t"), F.col("c"))).collect()]
    assert got == [x for _, _, x in NOISE]
    for level in ("raw", "", None):
        assert rows.where(tx.word_passes(F.col("t"), F.col("c"), level)).count() == len(NOISE)
    assert rows.where(tx.word_passes(F.col("t"), F.col("c"), "other", True)).count() == len(NOISE)


def test_text(spark):
    assert one(spark, tx.strip(F.lit("  ﻿a b \n"))) == "a b"
    assert one(spark, tx.normalize_space(F.lit(" a \t b "))) == "a b"
    assert one(spark, tx.tokens(F.lit(""))) == []
    assert one(spark, tx.utf16_length(F.lit("a😀"))) == 3
    assert one(spark, tx.capitalize_first(F.lit("loading Core"))) == "Loading Core"
    assert one(spark, tx.half_up(F.lit(-2.5))) == -2
    assert one(spark, tx.after_comma(F.lit("data:x,a,b"))) == "a,b"
    assert one(spark, tx.after_comma(F.lit("ab"))) == "ab"
    body = '{"content":[{"type":"text","text":" a"},{"type":"x","text":"n"},{"type":"text","text":"b "}]}'
    assert one(spark, tx.response_text(F.lit(body))) == "ab"
    assert one(spark, tx.response_text(F.lit('{"content":[]}'))) is None
    assert one(spark, tx.status_message(F.lit(503))) == "service unavailable"


@pytest.mark.parametrize(("h", "r", "cer", "wer"), [("", "", 0, 0), ("x", "", 1, 1), ("abcdef", "ab", 2, 1), ("a  b\nc", "a b c", 0, 0), ("kitten", "sitting", 3 / 7, 1), ("the cat", "the cat sat", 4 / 11, 1 / 3)])
def test_error_rates(spark, h, r, cer, wer):
    assert one(spark, evaluate.character_error_rate(F.lit(h), F.lit(r))) == pytest.approx(cer)
    assert one(spark, evaluate.word_error_rate(F.lit(h), F.lit(r))) == pytest.approx(wer)


def test_geometry(spark):
    box = [F.lit(v) for v in (10.0, 20.0, 30.0, 40.0)]
    same = one(spark, geo.unrotate_box(*box, F.lit(100.0), F.lit(100.0), F.lit(100.0), F.lit(0.0)))
    assert tuple(same) == pytest.approx((10, 20, 30, 40))
    assert tuple(one(spark, geo.unrotate_box(*box, F.lit(200.0), F.lit(100.0), F.lit(100.0), F.lit(0.0)))) == pytest.approx((5, 10, 15, 20))
    for w, h, kind, want in ((500, 800, "page", 2), (800, 2000, "page", 1.25), (1000, 1000, "page", 1), (400, 40, "region", 4), (400, 100, "region", 2), (300, 200, "region", 1)):
        assert one(spark, geo.upscale(F.lit(w), F.lit(h), kind)) == want
    for w, h, want in ((10, 10, 8), (20, 40, 15), (100, 100, 40)):
        assert one(spark, geo.inpaint_margin(F.lit(w), F.lit(h))) == want
    for n, w, h, want in ((0, 1, 1, 11), (1, 61, 10, 7), (1, 60, 10, 6)):
        assert one(spark, geo.segmentation_mode(F.lit(n), F.lit(w), F.lit(h))) == want
    assert one(spark, geo.clamp_position(F.lit(120.0), F.lit(10.0))) == 95
    assert one(spark, geo.clamp_position(F.lit(-50.0), F.lit(10.0))) == -5
    assert one(spark, geo.crop_box(F.lit(300.0), F.lit(0.0), F.lit(310.0), F.lit(5.0), F.lit(100), F.lit(100))) is None
    assert one(spark, geo.clamp(F.lit(None).cast("double"), 0, 1)) is None
    assert tuple(one(spark, geo.resize(F.lit(10.0), F.lit(10.0), F.lit(0.6), F.lit(0.1), F.lit(0.1)))) == pytest.approx((2, 2, 0.5))
    assert tuple(one(spark, geo.drag(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(5.0), F.lit(3.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)))) == (1, 1)


def two_rows(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_distance():
    """Bit by bit what two rows of the table give, about word sizes too."""
    r = random.Random(7)
    for _ in range(400):
        letters = r.choice(["a", "ab", "abcdefgh"])
        a, b = ("".join(r.choice(letters) for _ in range(r.choice([0, 1, 2, 31, 63, 64, 65, 130]))) for _ in "ab")
        assert evaluate.distance(a, b) == two_rows(a, b), (a, b)
        assert evaluate.distance(list(a), list(b)) == two_rows(a, b)
        if a and b:
            assert evaluate._whole(a, b) == two_rows(a, b)
        b, a = sorted((a, b), key=len)
        for most in {max(1, len(a) - len(b)), len(a) // 2, len(a) - 1}:
            if b and len(a) - len(b) <= most < len(a):
                got = evaluate._banded(a, b, most, evaluate._places(a))
                assert got == two_rows(a, b) if two_rows(a, b) <= most else got > most, (a, b, most)


def test_distance_bands(monkeypatch):
    """Long texts with few edits: the band doubles until it holds them."""
    r = random.Random(8)
    monkeypatch.setattr(evaluate, "BAND", 2)
    for _ in range(60):
        a = [r.choice("abcdefghij") + str(r.randint(0, 30)) for _ in range(300)]
        b = list(a)
        for _ in range(r.randint(0, 40)):
            k, kind = r.randrange(len(b)), r.random()
            if kind < 0.4:
                del b[k]
            elif kind < 0.8:
                b.insert(k, r.choice(a))
            else:
                b[k] = "z"
        assert evaluate.distance(a, b) == evaluate.distance(b, a) == two_rows(a, b)


def test_long_distances(spark):
    """Far beyond 30,000 words: planted edits are found, and no rate is null."""
    words = [f"w{k % 7919}x{k}" for k in range(40_000)]
    other = words[:100] + ["new"] + words[100:20_000] + words[20_010:30_000] + ["other"] + words[30_001:]
    df = spark.createDataFrame([(" ".join(other), " ".join(words)), (" ".join(words[:50]), " ".join(words[:49])), ("", " ".join(words)), ("x" * 5000, "y" * 5001), (None, "a")], "h string, r string")
    got = [x.wer for x in df.select(evaluate.word_error_rate(F.col("h"), F.col("r")).alias("wer")).collect()]
    assert got[:4] == pytest.approx([12 / 40_000, 1 / 49, 1.0, 1.0])
    cer = [x.cer for x in df.select(evaluate.character_error_rate(F.col("h"), F.col("r")).alias("cer")).collect()]
    edits = 4 + sum(len(w) + 1 for w in words[20_000:20_010]) + two_rows("other", words[30_000])
    assert cer[0] == pytest.approx(edits / len(" ".join(words))) and cer[3] == 1.0
    far = [f"a{k}" for k in range(6000)], [f"b{k}" for k in range(5000)]
    assert evaluate.distance(*far) == 6000
