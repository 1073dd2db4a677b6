"""What queries move: plans without shuffles of words, groups of one scan in Python, or steps worked out again."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkframe import nested_queries, queries
from inkframe.functions import geometry as geo
from inkframe.operators import edits, fit, layout

SF = "/root/testdata/sf0.001"
ALL = queries.QUERIES | nested_queries.QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["words_to_text", "filtered_text", "saved_texts", "element_text", "element_words", "word_modified", "resized", "inpaint_crops", "nested_words"])
def test_words_stay_where_they_are(spark, name):
    if name == "saved_texts":
        p = plan(layout.lines_to_text(queries.syn.lines(spark, SF), "filtered"))
    else:
        p = plan(ALL[name](spark, SF))
    assert "Window" not in p and ("Exchange" not in p or name == "nested_words")


@pytest.mark.parametrize("name", ["dragged", "patches", "selected_objects", "snapshot_reconcile", "selection_toggle", "draw_list", "selected_text"])
def test_only_texts_are_shuffled(spark, name):
    moved = [x for x in plan(ALL[name](spark, SF)).splitlines() if "Exchange" in x]
    assert moved and not any("id#" in x.split("hashpartitioning(")[-1].replace("scan_id#", "") for x in moved if "hashpartitioning" in x)


def test_marquees_are_held_and_objects_unsorted(spark):
    p = plan(nested_queries.marquee_pairs(spark, SF))
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p


def test_selected_words_stay_in_their_row(spark):
    p = plan(queries.selected_text(spark, SF))
    assert "ShuffledHashJoin" in p and not any(x in p for x in ("Sort ", "SortMergeJoin", "BroadcastExchange", "Window", "Aggregate", "posexplode"))


def test_active_lines(spark):
    """As active_text of the same words as a table: selections of words, of none, of noise, of what is not there; retyped, deleted, blank and user's words, lines without a number."""
    base = [("ocr", 0, " one", " one", 90.0), ("ocr", 0, "", "x", 90.0), ("ocr", 0, "two\n", "two\n", 90.0), ("ocr", 1, "--", "--", 90.0), ("ocr", 2, "++", "+", 90.0), ("ocr", 2, None, "y", 1.0), ("ocr", 5, "", "z", 9.0), ("user", None, "a\nb", "a\nb", None), ("user", None, "\u3000", " ", None), ("user", None, "me", "me", None)]
    nameless = [("ocr", None, "p", "p", 90.0), ("ocr", None, "q", "q", 90.0), ("ocr", 0, "r", "r", 90.0)]
    picks = {1: None, 2: [], 3: ["obj-1", "obj-3", "obj-3", None], 4: ["obj-4"], 5: ["obj-77", "obj-bg"], 6: ["obj-10", "obj-5", "obj-8", "obj-77"], 7: ["obj-2", "obj-7"], 8: None, 9: ["obj-1"], 10: ["obj-2"]}
    words = {s: [(f"obj-{k + 1}", k + 1, *w) for k, w in enumerate(nameless if s == 8 else [] if s == 9 else base)] for s in picks} | {10: None}
    kind = "id string, ordinal int, origin string, line_index long, text string, original_text string, confidence double"
    scans = spark.createDataFrame(list(words.items()), f"scan_id long, words array<struct<{kind.replace(' ', ': ').replace(',: ', ', ')}>>")
    rows = spark.createDataFrame([(s, i) for s, i in picks.items() if i is not None], "scan_id long, ids array<string>")
    o, selected = scans.selectExpr("scan_id", "inline(words)"), rows.selectExpr("scan_id", "explode(ids) AS id")
    text = lambda d: {r.scan_id: r.text for r in d.collect()}
    for level in ("filtered", "raw"):
        got = text(layout.active_lines(scans, rows, level))
        assert got == text(layout.active_text(o, selected, level))
        assert text(layout.active_lines(scans, None, level)) == text(layout.active_text(o, None, level))
    assert got[1] == got[2] == got[5] == "one  two\n--\n++\na\nb\nme" and got[8] == "p q\nr" and got[4] == "--"
    got = text(layout.active_lines(scans, rows))
    assert got == {1: (every := "one  two\n++\na\nb\nme"), 2: every, 3: "one two", 5: every, 6: "++\na\nb\nme", 8: "p q\nr"}


@pytest.mark.parametrize("name", ["reading_order", "column_order", "nested_reading_order", "edit_history"])
def test_many_scans_a_batch(spark, name):
    assert "FlatMapGroups" not in plan(ALL[name](spark, SF))


def test_lines_to_text(spark):
    rows = [(1, [[("a", 90.0), ("--", 90.0)], [("--", 90.0)], [], [("b", 90.0)]]), (2, [[]]), (3, [[("--", 90.0)]]), (4, None)]
    d = spark.createDataFrame(rows, "scan_id long, lines array<array<struct<text: string, confidence: double>>>")
    assert {r.scan_id: r.text for r in layout.lines_to_text(d).collect()} == {1: "a --\n--\nb", 3: "--"}
    assert {r.scan_id: r.text for r in layout.lines_to_text(d, "filtered").collect()} == {1: "a\nb", 3: ""}


def test_inpaint_boxes_in_steps(spark):
    d = spark.range(600).select("id", (F.col("id") * 37 % 180 - 20.25).alias("x"), (F.col("id") * 53 % 90 - 10.5).alias("y"), (F.col("id") % 13 * 2.5).alias("w"), (F.col("id") % 17 * 1.5).alias("h"))
    size = F.lit(160), F.lit(80)
    want = d.select("id", geo.inpaint_boxes(*[F.col(c) for c in "xywh"], *size).alias("b")).where("b IS NOT NULL").select("id", "b.*")
    got = geo.place_inpaint_boxes(d, *size)
    assert 0 < got.count() < 600 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_restored_versions_and_notes_move_no_words(spark):
    """Versions meet within their object: nothing is sorted or joined; notes meet scans, which are not sorted."""
    p = plan(nested_queries.version_restore(spark, SF))
    assert "Join" not in p and "Window" not in p and "Sort" not in p and "Aggregate" not in p and p.count("Exchange") == 1
    p = plan(nested_queries.text_with_notes(spark, SF))
    assert "SortMergeJoin" not in p and "Window" not in p and p.count("Join") == 1


def test_added_lines(spark):
    """The user's words follow those of their scan by seq; blank ones are dropped, scans without words have theirs alone."""
    word = "struct<id: string, ordinal: int, origin: string, line_index: long, text: string, original_text: string, confidence: double>"
    scans = spark.createDataFrame([(1, [("obj-1", 1, "ocr", 0, "one", "one", 90.0), ("obj-2", 2, "ocr", 1, "two", "two", 90.0)]), (2, []), (3, None), (4, None)], f"scan_id long, words array<{word}>")
    added = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, " ", 0), (2, "c", 1), (3, "d", 9), (5, "e", 1)], "scan_id long, text string, seq int")
    got = edits.add_user_lines(scans, added)
    assert {r.scan_id: r.text for r in layout.active_lines(got).collect()} == {1: "one\ntwo\na\nb", 2: "c", 3: "d"}
    assert [(w.id, w.ordinal, w.origin) for w in got.where("scan_id = 1").first().words[2:]] == [("obj-3", 3, "user"), ("obj-4", 4, "user")]


def test_marquees_meet_words_in_arrays(spark):
    """Words are sorted once, by their scan, and not dealt out to cells."""
    p = plan(nested_queries.marquee_pairs(spark, SF))
    assert p.count("Window ") == 1 and "Generate explode(sequence" not in p and p.count("Sort [scan_id") == 1, p


@pytest.mark.parametrize("size", ["1", "7", "1000"])
def test_marquee_pairs_in_batches(spark, size):
    """Scans that go over batches, scans without marquees or words, boxes of many cells: as by looking at every pair."""
    rng = np.random.default_rng(4)
    boxes = lambda n: [(int(rng.integers(1, 7)), k, *(rng.uniform(-20, 120, 2).tolist()), *(rng.uniform(0, 60, 2) ** 2 / 40).tolist()) for k in range(n)]
    words, marks = [b for b in boxes(60) if b[0] != 3], [b for b in boxes(25) if b[0] != 4]
    o = spark.createDataFrame([(s, f"w{k}", "word", x, y, w, h) for s, k, x, y, w, h in words], "scan_id long, id string, type string, x double, y double, w double, h double")
    m = spark.createDataFrame([(s, k, x, y, x + w, y + h) for s, k, x, y, w, h in marks], "scan_id long, marquee_id long, left double, top double, right double, bottom double")
    want = sorted((s, j, f"w{k}") for s, k, x, y, w, h in words for t, j, u, v, a, b in marks if s == t and x <= u + a and x + w >= u and y <= v + b and y + h >= v)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        assert sorted(map(tuple, fit.marquee_pairs(o, m).collect())) == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own, fit.MEETING = fit.MEETING, 3  # a few cells and pairs at once
    try:
        a, b = (np.array([[x, y, x + w, y + h] for _, _, x, y, w, h in rows]) for rows in (words, marks))
        cell = lambda v: np.floor(v * 0.16).astype(int)
        s, t = (np.array([r[0] for r in rows]) for rows in (words, marks))
        assert sorted((words[i][0], marks[j][1], f"w{words[i][1]}") for ii, jj in fit._meet(a, cell(a), s, b, cell(b), t) for i, j in zip(ii.tolist(), jj.tolist(), strict=True)) == want
    finally:
        fit.MEETING = own
