"""Mixing sources to target weights by entropy balancing, with DataFrame and SQL functions only.

The rates of documents that stay closest to 1 (in relative entropy) while each source takes its target of words are
r = min(cap, exp(lambda * size / mean size)), one lambda per source. Newton steps on the convex dual find the
lambdas: each step is one distributed aggregation over the table of (source, size, count), kept inside a bracket.
Rates are then rounded into whole copies: sizes from large to small, each carrying its rounding error to the next,
and evenly within the documents of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, parallelism, table

SALTS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def total(x: Column) -> Column:
    """A sum that does not depend on the order of rows, so that reruns agree: terms in steps of 1e-12, summed exactly."""
    return F.sum(x.cast("decimal(38,12)")).cast("double")


def targets(totals: DataFrame, weights: tuple[int, ...], cap: float, keep: Scratch) -> DataFrame:
    """totals (source, total, n): adds most and target. Sources by code point, null last, weigh `weights` repeating and share the sum of totals.

    Targets stop at most = cap * total, and the excess goes to the rest by weight: with c = the words of a unit of
    weight, target = least(most, c * weight), where c makes the targets sum up.
    """
    # A source's place: within its range of names, and after all ranges before it. There is one range a task.
    dealt = totals.repartitionByRange(parallelism(totals.sparkSession), F.col("source").asc_nulls_last())
    dealt = keep.save(dealt.withColumn("part", F.spark_partition_id()), "sources")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    t = dealt.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("w", weight)
    t = keep.save(t.withColumn("most", F.lit(float(cap)) * F.col("total")).select("source", "total", "n", "most", "w"), "weights")
    # c from below: sources that c * weight puts beyond their cap give the rest of it to the others, until none is new.
    unit, capped = 0.0, -1
    while True:
        full = F.lit(unit) * F.col("w") >= F.col("most")
        got = t.agg(total(F.col("most") / F.lit(float(cap))), total(F.when(full, F.col("most"))), total(F.when(~full, F.col("w"))), F.count_if(full)).first()
        if got[3] == capped or not got[2]:
            break
        unit, capped = ((got[0] or 0.0) - (got[1] or 0.0)) / got[2], got[3]
    target = F.least("most", F.lit(unit) * F.col("w")) if got[2] else F.col("most")
    return t.withColumn("target", target).select("source", "total", "n", "most", "target")


def entropy_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, rounds: int = 60, columns: bool = False) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, rate, copies, source), one per row of docs (doc_id, text, source, anything else).

    With columns, all columns of docs follow in the struct `row` instead of being left out. A null text has size 0;
    a size of 0 has rate 1 and one copy, which takes nothing. A null source is a source of its own. Repeated
    rows are rows like others; an empty table gives no rows. Which rows of one source and size get the spare copies
    depends on doc_id and text alone.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "mix")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if columns else []))
    named = named.withColumn("salt", F.pmod(F.col("mark"), F.lit(SALTS)).cast("int"))
    if not columns:
        named = keep.save(named, "sizes")
    hist = keep.save(named.groupBy("source", "size", "salt").agg(F.count("*").alias("n")), "hist")
    by_size = keep.save(hist.groupBy("source", "size").agg(F.sum("n").alias("n")), "by_size")
    goal = keep.save(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n")), weights, cap, keep), "targets")

    # The dual: per source the state of its Newton iteration. Sources at their cap have the solution at the bracket's end.
    mean = F.greatest(F.col("total") / F.col("n"), F.lit(1.0))
    high = F.log(F.lit(float(cap))) * mean * 1.000001
    state = goal.select("source", "target", mean.alias("m"), (mean * -60.0).alias("lo"), high.alias("hi"), F.when(F.col("target") >= F.col("most") * (1 - 1e-12), high).otherwise(0.0).alias("lam"))
    state = keep.save(state.withColumn("err", F.lit(1.0)), "state-0")
    k = 0
    while k < rounds:
        tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("m"), F.lit(50.0)))
        mass = F.col("size") * F.col("n")
        got = by_size.alias("h").join(state.alias("s"), F.expr("h.source <=> s.source")).where("size > 0").select("s.*", "size", "n")
        got = got.groupBy("source", "target", "m", "lo", "hi", "lam").agg(total(mass * F.least(tilt, F.lit(float(cap)))).alias("f"), total(F.when(tilt < cap, mass * F.col("size") / F.col("m") * tilt).otherwise(0.0)).alias("g"))
        got = got.withColumn("err", F.abs(F.col("f") / F.col("target") - 1)).withColumn("lo", F.when(F.col("f") < F.col("target"), F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("f") > F.col("target"), F.col("lam")).otherwise(F.col("hi")))
        step = F.when(F.col("g") > 0, F.col("lam") - (F.col("f") - F.col("target")) / F.col("g"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        lam = F.when(F.col("err") < 1e-9, F.col("lam")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        k += 1
        state = keep.save(got.select("source", "target", "m", "lo", "hi", lam.alias("lam"), "err"), f"state-{k}")
        keep.drop(f"state-{k - 1}")
        error = state.agg(F.max("err")).first()[0] or 0
        if error < 1e-9:
            break
    else:
        if error > 1e-6:
            raise RuntimeError(f"after {rounds} rounds a source is still off its target by a share of {error}")

    rated = by_size.alias("h").join(state.alias("s"), F.expr("h.source <=> s.source"), "left").select("h.*", F.when(F.col("size") > 0, F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("m"), F.lit(50.0))), F.lit(float(cap)))).otherwise(1.0).alias("rate"))
    # One array per source of its distinct sizes: bounded by the longest text, not by the number of documents. Appending
    # copies what is there, so the sizes are walked in steps of 256.
    sizes = rated.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("neg"), "size", "n", "rate"))).alias("g"))
    steps = F.expr("transform(sequence(0, (size(g) - 1) div 256), k -> slice(g, k * 256 + 1, 256))")
    mass = "a.carry + x.n * x.size * x.rate"
    copies = f"if(x.size = 0, x.n, greatest(0L, least({cap}L * x.n, cast(round(({mass}) / x.size) AS bigint))))"
    out = "array<struct<size: bigint, n: bigint, rate: double, copies: bigint>>"
    one = f"""aggregate(step, named_struct('carry', s.carry, 'out', cast(array() AS {out})), (a, x) -> named_struct(
        'carry', {mass} - x.size * {copies}, 'out', concat(a.out, array(named_struct('size', x.size, 'n', x.n, 'rate', x.rate, 'copies', {copies})))))"""
    walk = f"""aggregate(steps, named_struct('carry', 0D, 'out', cast(array() AS array<{out}>)), (s, step) ->
        transform(array({one}), r -> named_struct('carry', r.carry, 'out', concat(s.out, array(r.out))))[0])"""
    dealt = sizes.select("source", steps.alias("steps")).select("source", F.inline(F.expr(f"flatten({walk}.out)")))
    first = F.coalesce(F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = hist.withColumn("before", first).drop("n")
    plan = places.alias("p").join(dealt.alias("d"), F.expr("p.source <=> d.source AND p.size = d.size")).join(goal.alias("t"), F.expr("p.source <=> t.source"))
    plan = keep.save(plan.select("p.source", "p.size", "p.salt", "p.before", "d.n", "d.rate", "d.copies", F.col("t.total").alias("source_size"), "t.target"), "plan")

    keep.drop("hist", "by_size", "targets", "sources", "weights", f"state-{k}")

    order = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("mark", F.lit(1)), "mark", "doc_id")
    ranked = named.withColumn("i", F.row_number().over(order))
    out = ranked.alias("r").join(plan.alias("p"), F.expr("r.source <=> p.source AND r.size = p.size AND r.salt = p.salt"))
    share = F.floor(F.col("p.copies") / F.col("p.n")) + F.expr("(p.before + r.i) * (p.copies % p.n) div p.n - (p.before + r.i - 1) * (p.copies % p.n) div p.n")
    out = out.select("r.*", "p.source_size", "p.target", "p.rate", share.cast("long").alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies", "source", *(["row"] if columns else []))


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; weights 1, 2, 3, repeating; a document is taken three times at most."""
    return entropy_mix(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    mixed = entropy_mix(docs, columns=True).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
