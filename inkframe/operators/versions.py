"""Versions of layouts as intervals: a row per object and value, with the versions in which it held.

An interval (scan_id, id, the object's columns, valid_from, valid_to) holds from version valid_from up to, but without,
valid_to; null is still open. A version costs what it changed, and any version comes back by a filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("scan_id", "id")


def _value(columns: list[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _columns(objects: DataFrame) -> list[str]:
    return [c for c in objects.columns if c not in (*KEYS, "version", "valid_from", "valid_to")]


def from_snapshots(snapshots: DataFrame) -> DataFrame:
    """Intervals of whole snapshots (scan_id, version, id, anything else). A scan's versions are those that hold any object of it; an object is once in each at most."""
    columns = _columns(snapshots)
    versions = snapshots.select("scan_id", "version").distinct()
    number = versions.withColumn("k", F.row_number().over(Window.partitionBy("scan_id").orderBy("version")))
    number = number.withColumn("next", F.lead("version").over(Window.partitionBy("scan_id").orderBy("version")))
    by = Window.partitionBy(*KEYS).orderBy("k")
    s = snapshots.join(number, ["scan_id", "version"]).withColumn("v", _value(columns))
    new = ~(F.lag("v").over(by).eqNullSafe(F.col("v")) & (F.lag("k").over(by) == F.col("k") - 1))
    s = s.withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    held = s.groupBy(*KEYS, "run").agg(F.first("v").alias("v"), F.min("version").alias("valid_from"), F.max(F.struct("k", "next")).alias("last"))
    return held.select(*KEYS, *[F.col("v")[c].alias(c) for c in columns], "valid_from", F.col("last.next").alias("valid_to"))


def commit(store: DataFrame, snapshot: DataFrame, version: int, scans: DataFrame | None = None) -> DataFrame:
    """The store with one more version, later than all: intervals that it changes or ends are closed, new values are opened. Closed intervals pass by untouched.

    The snapshot is of the scans (scan_id) given, of which it may hold no object any more, or else of those that it holds; others keep their intervals open.
    """
    columns = _columns(snapshot)
    live = store.where("valid_to IS NULL")
    scans = (snapshot if scans is None else scans).select("scan_id").distinct().withColumn("seen", F.lit(True))
    old = live.join(scans, "scan_id", "left").select(*KEYS, _value(columns).alias("o"), "valid_from", "seen", F.lit(True).alias("was"))
    now = snapshot.select(*KEYS, _value(columns).alias("n"), F.lit(True).alias("is"))
    both = old.join(now, [*KEYS], "full_outer")
    same = F.col("was") & F.col("is") & F.col("o").eqNullSafe(F.col("n"))
    kept = F.coalesce(same, F.lit(False)) | (F.col("was") & F.col("seen").isNull() & F.col("is").isNull())
    interval = lambda v, a, b: F.struct(v.alias("v"), a.cast("long").alias("valid_from"), b.cast("long").alias("valid_to"))
    end = F.when(~F.coalesce(kept, F.lit(False)), F.lit(version))
    rows = F.array(F.when(F.col("was"), interval(F.col("o"), F.col("valid_from"), end)), F.when(F.col("is") & ~F.coalesce(kept, F.lit(False)), interval(F.col("n"), F.lit(version), F.lit(None))))
    out = both.select(*KEYS, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    out = out.select(*KEYS, *[F.col("r.v")[c].alias(c) for c in columns], "r.valid_from", "r.valid_to")
    return store.where("valid_to IS NOT NULL").unionByName(out)


def as_of(store: DataFrame, version: Column | int) -> DataFrame:
    """The objects of a version; a column of the store may give each scan its own."""
    v = version if isinstance(version, Column) else F.lit(version)
    return store.where((F.col("valid_from") <= v) & (F.col("valid_to").isNull() | (F.col("valid_to") > v))).drop("valid_from", "valid_to")


def with_history(objects: DataFrame, snapshots: Column, versions: Column) -> DataFrame:
    """As from_snapshots, of objects that hold their own snapshots, one row an object: adds history, its intervals (value, valid_from, valid_to) in order.

    snapshots: (version, value: a struct) in order of versions; versions: those of the object's scan, in order. An object
    meets no other, so nothing is shuffled or sorted.
    """
    o = objects.withColumn("__snapshots", snapshots).withColumn("__versions", versions)
    at = lambda i: F.get("__snapshots", i)
    after = lambda v: F.get("__versions", F.array_position("__versions", v).cast("int"))
    goes_on = lambda s, i: at(i - 1)["value"].eqNullSafe(s["value"]) & (after(at(i - 1)["version"]) == s["version"])
    first = F.filter(F.transform("__snapshots", lambda s, i: F.when((i == 0) | ~goes_on(s, i), i)), lambda i: i.isNotNull())
    o = o.withColumn("__first", first)
    last = lambda k: at(F.coalesce(F.get("__first", k + 1), F.size("__snapshots")) - 1)["version"]
    history = F.transform("__first", lambda i, k: F.struct(at(i)["value"].alias("value"), at(i)["version"].alias("valid_from"), after(last(k)).alias("valid_to")))
    return o.withColumn("history", history).drop("__snapshots", "__versions", "__first")


def with_version(objects: DataFrame, value: Column, version: int, seen: Column | bool = True) -> DataFrame:
    """As commit, of objects with a history: value is the object's in the version, null without it there; seen: whether the snapshot is of its scan."""
    o = objects.withColumn("__value", value)
    there, seen = F.col("__value").isNotNull(), seen if isinstance(seen, Column) else F.lit(seen)
    last = F.get("history", F.size("history") - 1)  # only the last interval can be open
    o = o.withColumn("__same", F.coalesce(there & last["valid_from"].isNotNull() & last["valid_to"].isNull() & last["value"].eqNullSafe(F.col("__value")), F.lit(False)))
    ends = F.when(~(F.col("__same") | ~(there | seen)), F.lit(version).cast("long"))
    closed = F.transform("history", lambda r: F.struct(r["value"].alias("value"), r["valid_from"].alias("valid_from"), F.coalesce(r["valid_to"], ends).alias("valid_to")))
    new = F.array(F.struct(F.col("__value").alias("value"), F.lit(version).cast("long").alias("valid_from"), F.lit(None).cast("long").alias("valid_to")))
    opened = F.when(there & ~F.col("__same"), F.concat(closed, new)).otherwise(closed)
    return o.withColumn("history", opened).drop("__value", "__same")


def values_as_of(objects: DataFrame, version: Column | int) -> DataFrame:
    """As as_of, of objects with a history: value instead of it, a row for each object that is in the version."""
    v = version if isinstance(version, Column) else F.lit(version)
    held = F.filter("history", lambda r: (r["valid_from"] <= v) & (r["valid_to"].isNull() | (r["valid_to"] > v)))
    rest = [F.col(f"`{c}`") for c in objects.columns if c != "history"]
    return objects.select(*rest, F.explode(held).alias("r")).select(*rest, F.col("r.value").alias("value"))


def restore(live: DataFrame, store: DataFrame, version: Column | int) -> DataFrame:
    """What leads from the live objects to a version: edits.reconcile with it as the snapshot."""
    from inkframe.operators.edits import reconcile

    return reconcile(live, as_of(store, version), "scan_id")
