"""Layout objects: rendering, edits, snapshots, selections, draw lists and edit histories."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkframe.functions.geometry import clamp_position, drag, percent_box, pixel_box
from inkframe.functions.text import has_ink, low_confidence, word_passes

#: Tolerance of a move in percent, cap of the undo stack.
TOLERANCE, UNDO_CAP = 0.01, 100


#: The background's box in percent.
_WHOLE = {"x": 0.0, "y": 0.0, "w": 100.0, "h": 100.0}


def render(words: DataFrame, images: DataFrame) -> DataFrame:
    """Words (with line_index) of images (scan_id, width, height) as layout objects, under one background object per scan. See render_numbered for words that are numbered already."""
    w = words.where(has_ink(F.col("text"))).join(images, "scan_id")
    g = percent_box(F.col("bbox.x0"), F.col("bbox.y0"), F.col("bbox.x1"), F.col("bbox.y1"), F.col("width"), F.col("height"))
    w = w.withColumn("g", g).withColumn("ordinal", F.row_number().over(Window.partitionBy("scan_id").orderBy("pos")))
    words_ = w.select("scan_id", F.concat(F.lit("obj-"), F.col("ordinal").cast("string")).alias("id"), F.col("ordinal").cast("int").alias("ordinal"), F.lit("word").alias("type"), F.lit("ocr").alias("origin"), "g.*", *[F.col(f"g.{c}").alias(f"original_{c}") for c in "xywh"], "text", F.col("text").alias("original_text"), "confidence", "line_index", low_confidence(F.col("confidence")).alias("low_confidence"))
    back = images.select("scan_id", F.lit("obj-bg").alias("id"), F.lit(0).alias("ordinal"), F.lit("image").alias("type"), F.lit("ocr").alias("origin"), *[F.lit(v).alias(k) for k, v in _WHOLE.items()], F.lit(None).cast("double").alias("font_size_pct"), *[F.lit(v).alias(f"original_{k}") for k, v in _WHOLE.items()], *[F.lit(None).cast(t).alias(c) for c, t in (("text", "string"), ("original_text", "string"), ("confidence", "double"), ("line_index", "int"))], F.lit(False).alias("low_confidence"))
    return words_.unionByName(back)


def render_numbered(words: DataFrame) -> DataFrame:
    """Layout objects as from render, of words with ink that are numbered within their scan: (scan_id, ordinal from 1, width, height, text, confidence, line_index, bbox), and a row of ordinal 0 for each scan's background.

    Nothing is shuffled or sorted, and the objects lie as the words do.
    """
    o = words.withColumn("g", percent_box(*[F.col(f"bbox.{c}") for c in ("x0", "y0", "x1", "y1")], F.col("width"), F.col("height")))
    word = F.col("ordinal") > 0
    box = {k: F.when(word, F.col(f"g.{k}")).otherwise(v) for k, v in _WHOLE.items()}
    name = F.when(word, F.concat(F.lit("obj-"), F.col("ordinal").cast("string"))).otherwise("obj-bg")
    return o.select("scan_id", name.alias("id"), F.col("ordinal").cast("int").alias("ordinal"), F.when(word, "word").otherwise("image").alias("type"), F.lit("ocr").alias("origin"), *[v.alias(k) for k, v in box.items()], F.when(word, F.col("g.font_size_pct")).alias("font_size_pct"), *[v.alias(f"original_{k}") for k, v in box.items()], *[F.when(word, F.col(c)).alias(k) for k, c in (("text", "text"), ("original_text", "text"), ("confidence", "confidence"), ("line_index", "line_index"))], (word & low_confidence(F.col("confidence"))).alias("low_confidence"))


def text_edited() -> Column:
    return (F.col("origin") == "user") | ~F.col("text").eqNullSafe(F.col("original_text"))


def modified() -> Column:
    return text_edited() | F.greatest(*[F.abs(F.col(c) - F.col(f"original_{c}")) for c in "xywh"]).__gt__(TOLERANCE)


def refresh(objects: DataFrame, level: str = "filtered") -> DataFrame:
    """Adds modified, visible (passes the level, or text edited) and patched (a modified recognized word)."""
    return objects.withColumn("modified", modified()).withColumn("visible", word_passes(F.col("text"), F.col("confidence"), level, text_edited())).withColumn("patched", F.col("modified") & (F.col("origin") == "ocr"))


def reconcile(live: DataFrame, snapshot: DataFrame, *keys: str) -> DataFrame:
    """Restores a snapshot: one row per id with action delete (live only, no image), create (a word of the snapshot only), update, or keep.

    Updated rows take x, y, w, h, and font and text where these are not null. Created rows keep the snapshot's id.
    """
    by = [*keys, "id"]
    cols = ["type", "origin", "x", "y", "w", "h", "font_size_pct", "text"]
    a = live.select(*by, *[F.col(c).alias(f"l_{c}") for c in cols], F.lit(True).alias("in_live"))
    b = snapshot.select(*by, *[F.col(c).alias(f"s_{c}") for c in cols], F.lit(True).alias("in_snap"))
    j = a.join(b, by, "full_outer")
    action = F.when(F.col("in_live").isNull(), F.when(F.col("s_type") == "word", "create").otherwise("ignore")).when(F.col("in_snap").isNull(), F.when(F.col("l_type") == "image", "keep").otherwise("delete")).otherwise("update")
    j = j.withColumn("action", action).where("action <> 'ignore'")
    new = lambda c: F.when(F.col("action").isin("create", "update"), F.coalesce(f"s_{c}", f"l_{c}") if c in ("font_size_pct", "text") else F.col(f"s_{c}")).otherwise(F.col(f"l_{c}")).alias(c)
    return j.select(*by, "action", F.coalesce("l_type", "s_type").alias("type"), F.coalesce("l_origin", "s_origin").alias("origin"), *[new(c) for c in cols[2:]])


def select_objects(objects: DataFrame, selected: DataFrame) -> DataFrame:
    return objects.join(selected.select("scan_id", "id").distinct(), ["scan_id", "id"], "left_semi")


def toggle(selected: DataFrame, ids: DataFrame) -> DataFrame:
    """Symmetric difference of two sets (scan_id, id)."""
    both = selected.select("scan_id", "id").distinct().withColumn("a", F.lit(1)).join(ids.select("scan_id", "id").distinct().withColumn("b", F.lit(1)), ["scan_id", "id"], "full_outer")
    return both.where("a IS NULL OR b IS NULL").select("scan_id", "id")


def marquee_select(selected: DataFrame, hits: DataFrame, additive: bool) -> DataFrame:
    out = hits.select("scan_id", "id")
    return (out.union(selected.select("scan_id", "id")) if additive else out).distinct()


def delete_selected(objects: DataFrame, selected: DataFrame) -> DataFrame:
    """The user's words go, recognized words lose their text, images stay."""
    s = selected.select("scan_id", "id").distinct().withColumn("__sel", F.lit(True))
    j = objects.join(s, ["scan_id", "id"], "left").withColumn("__sel", F.coalesce("__sel", F.lit(False)) & (F.col("type") == "word"))
    return j.where(~(F.col("__sel") & (F.col("origin") == "user"))).withColumn("text", F.when(F.col("__sel"), "").otherwise(F.col("text"))).drop("__sel").select(*objects.columns)


def remove_objects(objects: DataFrame, ids: DataFrame) -> DataFrame:
    return objects.join(ids.select("scan_id", "id"), ["scan_id", "id"], "left_anti")


def add_user_text(objects: DataFrame, fonts: DataFrame, images: DataFrame, added: DataFrame) -> DataFrame:
    """Adds the user's words (scan_id, x, y, text, seq), 12 % wide, in the scan's median font, kept on the page; blank ones are dropped."""
    last = objects.groupBy("scan_id").agg(F.max("ordinal").alias("last"))
    a = added.where(has_ink(F.col("text"))).join(fonts, "scan_id").join(images, "scan_id").join(last, "scan_id", "left")
    n = (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("scan_id").orderBy("seq"))).cast("int")
    h = F.coalesce(F.col("font_size_pct") / 0.8 * F.col("width") / F.col("height"), F.lit(4.0))
    a = a.withColumn("ordinal", n).withColumn("h", h).withColumn("w", F.lit(12.0))
    a = a.withColumn("x", clamp_position(F.col("x"), F.col("w"))).withColumn("y", clamp_position(F.col("y"), F.col("h")))
    have = {"id": F.concat(F.lit("obj-"), F.col("ordinal").cast("string")), "type": F.lit("word"), "origin": F.lit("user"), "original_x": F.col("x"), "original_y": F.col("y"), "original_w": F.col("w"), "original_h": F.col("h"), "original_text": F.col("text"), "low_confidence": F.lit(False)}
    own = ("scan_id", "ordinal", "x", "y", "w", "h", "font_size_pct", "text")
    kinds = dict(objects.dtypes)
    return objects.unionByName(a.select(*[(F.col(c) if c in own else have.get(c, F.lit(None))).cast(kinds[c]).alias(c) for c in objects.columns]))


def draw_list(objects: DataFrame, images: DataFrame, mode: str = "full", patches: DataFrame | None = None) -> DataFrame:
    """What to paint, by z: surface, image at its object's place (full mode), patches of modified recognized words (full mode), then words with text (in full mode not the unmodified recognized ones).

    A patch row carries the patch (binary) that `patches` (scan_id, id, patch) has for its object, and the object's
    patch_colour, where objects have that column. Each object gives its rows by itself, so objects are read once.
    """
    if patches is not None:
        objects = objects.join(patches.select("scan_id", "id", "patch"), ["scan_id", "id"], "left")
    out = draws(objects.join(images.select("scan_id", "width", "height"), "scan_id"), mode)
    surface = images.select("scan_id", F.lit("surface").alias("kind"), *[v.cast("double").alias(k) for k, v in (("px", F.lit(0)), ("py", F.lit(0)), ("pw", F.col("width")), ("ph", F.col("height")))], *[F.lit(None).cast(t).alias(c) for c, t in _OWN.items()], F.lit(0).alias("z"))
    # The surface is the lowest of each image: rows above it are numbered where the objects lie.
    out = out.withColumn("z", F.row_number().over(Window.partitionBy("scan_id").orderBy("layer", "ordinal")))
    return out.drop("ordinal", "layer").unionByName(surface)


def add_user_lines(scans: DataFrame, added: DataFrame) -> DataFrame:
    """As add_user_text, of scans (scan_id, words) that hold their words (as for layout.active_lines): the user's words (scan_id, text, seq) follow theirs, without place or font.

    What is added is held in a hash table of its scans, which words pass by where they lie.
    """
    one = added.where(has_ink(F.col("text"))).select(F.col("scan_id").alias("__s"), F.struct("seq", "text").alias("n"))
    one = one.groupBy("__s").agg(F.array_sort(F.collect_list("n")).alias("__notes"))
    s = scans.join(one.hint("shuffle_hash"), F.col("scan_id") == F.col("__s"), "left")
    fields = scans.schema["words"].dataType.elementType.fields
    s = s.withColumn("words", F.coalesce("words", F.array().cast(scans.schema["words"].dataType)))
    s = s.withColumn("__last", F.coalesce(F.array_max(F.col("words.ordinal")), F.lit(0)))

    def word(n: Column, k: Column) -> Column:
        ordinal = F.col("__last") + k + 1
        have = {"id": F.concat(F.lit("obj-"), ordinal.cast("string")), "ordinal": ordinal, "origin": F.lit("user"), "text": n["text"], "original_text": n["text"]}
        return F.struct(*[have.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])

    return s.select("scan_id", F.concat("words", F.coalesce(F.transform("__notes", word), F.array())).alias("words"))


#: What a row of a draw list has of its own, besides its place.
_OWN = {"patch": "binary", "colour": "string", "text": "string", "font_px": "double"}


def draws(objects: DataFrame, mode: str = "full") -> DataFrame:
    """The rows of draw_list above the surface, to be painted by layer and ordinal, of objects with the width and height of their image, and their patch if they have one. Each object gives its rows by itself, where it lies."""
    o = refresh(objects)
    box = lambda p: pixel_box(*[F.col(f"{p}{c}") for c in "xywh"], *[F.col(c) for c in ("font_size_pct", "width", "height")])
    o = o.withColumn("p", box("")).withColumn("q", box("original_"))
    have = {"patch": F.col("patch") if "patch" in objects.columns else None, "colour": F.col("patch_colour") if "patch_colour" in objects.columns else None, "text": F.col("text"), "font_px": F.col("p.font_px")}

    def row(layer: int, kind: str, place: list, *own: str):
        rest = [(have[c] if c in own and have[c] is not None else F.lit(None)).cast(t).alias(c) for c, t in _OWN.items()]
        return F.struct(F.lit(layer).alias("layer"), F.lit(kind).alias("kind"), *[v.cast("double").alias(k) for k, v in zip(("px", "py", "pw", "ph"), place, strict=True)], *rest)

    at = lambda b: [F.col(f"{b}.{c}") for c in ("px", "py", "pw", "ph")]
    word, full = F.col("type") == "word", F.lit(mode == "full")
    shown = word & (F.coalesce("text", F.lit("")) != "") & (F.col("modified") | ~full)
    rows = F.array(F.when(full & (F.col("type") == "image"), row(1, "image", at("p"))), F.when(full & word & F.col("patched"), row(2, "patch", at("q"), "patch", "colour")), F.when(shown, row(3, "word", at("p"), "text", "font_px")))
    return o.select("scan_id", "ordinal", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("scan_id", "ordinal", "r.*")


class History:
    """Undo and redo stacks of one scan, moved on event by event. An entry is (version, mark); the mark is the event that placed a new word."""

    def __init__(self, undo=(), redo=(), now: int | None = None, held: int | None = None, placed: int | None = None):
        self.undo, self.redo, self.now, self.held, self.placed = list(undo), list(redo), now, held, placed

    def _push(self, version: int | None, cap: int, mark: int | None = None) -> None:
        self.undo.append((version, mark))
        del self.undo[:-cap]
        self.redo.clear()

    def step(self, seq: int, kind: str, version: int | None, cap: int = UNDO_CAP) -> tuple[int | None, int, int]:
        """The current version and both depths after an event."""
        if kind in ("push", "place"):
            self.placed = seq if kind == "place" else self.placed
            self._push(self.now, cap, seq if kind == "place" else None)
            self.now = version
        elif kind == "undo" and self.undo:
            self.redo.append((self.now, None))
            self.now = self.undo.pop()[0]
        elif kind == "redo" and self.redo:
            self.undo.append((self.now, None))
            self.now = self.redo.pop()[0]
        elif kind == "blank" and self.placed is not None:
            self.now = self.undo.pop()[0] if self.undo and self.undo[-1][1] == self.placed else version
            self.placed = None
        elif kind == "focus":
            self.held = self.now
        elif kind == "blur" and version is not None and version != self.held:
            self._push(self.held, cap)
            self.now = version
        return self.now, len(self.undo), len(self.redo)


#: What a history gives for each event.
HISTORY = "scan_id long, seq long, version long, undo_depth int, redo_depth int"


def history_rows(scan: int, events: pd.DataFrame, kept: History, cap: int = UNDO_CAP) -> pd.DataFrame:
    """Rows of HISTORY of one scan's events (seq, kind, version) in order of seq; `kept` moves on."""
    steps = zip(events["seq"], events["kind"], events["version"], strict=True)
    rows = [(scan, seq, *kept.step(seq, kind, None if pd.isna(v) else int(v), cap)) for seq, kind, v in sorted(steps, key=lambda e: e[0])]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in HISTORY.split(", ")]).astype({"version": "Int64", "undo_depth": "int32", "redo_depth": "int32"})


def history(events: DataFrame, cap: int = UNDO_CAP) -> DataFrame:
    """Folds edit events (scan_id, seq, kind, version) into the current version after each: push, undo, redo, focus and blur of a text edit, place and blank of a new word.

    A push drops the redo stack and the oldest entries over the cap; undo and redo move entries between the stacks,
    redo without the cap; an edit counts only if the version changed between focus and blur. Placing a word pushes;
    left blank, the word goes, and with it the entry of its placing if that is still the last one, and the version is
    that of before. seq tells a scan's events apart. The same on a stream: streaming.edits.history_stream.
    """
    one = events.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "kind", F.col("version").cast("long").alias("version")))).alias("es"))

    @F.pandas_udf("array<struct<seq: long, version: long, undo_depth: int, redo_depth: int>>")
    def fold(scans: pd.Series) -> pd.Series:
        out = []
        for es in scans:
            kept = History()
            out.append([(e["seq"], *kept.step(e["seq"], e["kind"], e["version"], cap)) for e in es])
        return pd.Series(out)

    # A scan's events are one row, and many scans one batch: a group of its own for each costs far more than its fold.
    return one.select("scan_id", F.explode(fold("es")).alias("h")).select("scan_id", "h.*")


def drag_objects(objects: DataFrame, starts: DataFrame, moves: DataFrame) -> DataFrame:
    """Objects at their places in a drag: starts (scan_id, id, start_x, start_y) hold the positions at its beginning, moves (scan_id, dx_px, dy_px, dx_pct, dy_pct) one way of the pointer each. Objects without a start are left out."""
    j = objects.join(starts, ["scan_id", "id"]).join(moves, "scan_id")
    p = drag(*[F.col(c) for c in ("start_x", "start_y", "w", "h", "dx_px", "dy_px", "dx_pct", "dy_pct")])
    return j.withColumn("__p", p).select(*[F.col(f"__p.{c}").alias(c) if c in ("x", "y") else F.col(c) for c in objects.columns])


def remember_patches(objects: DataFrame, found: DataFrame) -> DataFrame:
    """(scan_id, id, patch): what was found for the objects, null included, kept by id."""
    return found.join(objects.select("scan_id", "id"), ["scan_id", "id"], "left_semi").select("scan_id", "id", "patch").dropDuplicates(["scan_id", "id"])


def with_patches(objects: DataFrame, kept: DataFrame) -> DataFrame:
    """Objects with patch, and known: whether it was looked for before."""
    k = kept.select("scan_id", "id", "patch", F.lit(True).alias("known"))
    return objects.join(k, ["scan_id", "id"], "left").withColumn("known", F.coalesce("known", F.lit(False)))
