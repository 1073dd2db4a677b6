"""Embedding near-duplicates by an inverted multi-index.

Two codebooks, one on each half of the unit vectors, form a grid of cells. A vector lies in the cell of its nearest
codewords, and its query visits cells in order of the distance that a neighbour must at least have moved to lie
there (the sum over both halves of the squared distance to the border), the nearest first, until the target
recall. How far that is is measured when the index is fitted: sample vectors get partners at just the threshold,
in random directions, and the traversal goes as far as holds the target share of the partners. The codebooks grow
with the number of vectors and are fitted on a bounded sample; every vector is indexed.

Neighbouring cells form a block, the unit of work: a block's members are compared with each other and with the vectors
that visit one of its cells, in double precision. A large block is cut into chunks, each pair of chunks being a
task of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, connected_components, parallelism, release, salted, slices, table, tidy

#: Codewords a half: fewest, most; side of a block in codewords.
FEWEST, MOST, SIDE = 32, 256, 4


def codewords(n: int) -> int:
    """Codewords of a half for n vectors: about 36 vectors a cell, until the most is reached."""
    return min(MOST, max(FEWEST, math.isqrt(n) // 6))


class MultiIndex:
    """Codebooks of two halves and the squared distance up to which the traversal goes."""

    def __init__(self, sample: np.ndarray, words: int, threshold: float, recall: float, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.half = sample.shape[1] // 2
        self.books = [self._fit(h, words, rng) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.gaps = [np.sqrt(np.maximum(((b[:, None] - b[None]) ** 2).sum(2), 1e-300)) for b in self.books]
        self.across = -(-len(self.books[1]) // SIDE)
        noise = rng.standard_normal(sample.shape)
        noise -= (noise * sample).sum(1, keepdims=True) * sample
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
        partner = threshold * sample + np.sqrt(max(0.0, 1 - threshold**2)) * noise
        _, moved = self.place(sample)
        cells, _ = self.place(partner)
        at = np.arange(len(sample))
        self.reach = float(np.quantile(moved[0][at, cells[:, 0]] + moved[1][at, cells[:, 1]], recall)) + 1e-9 if len(sample) else 0.0

    @staticmethod
    def _fit(x: np.ndarray, words: int, rng) -> np.ndarray:
        """Lloyd's k-means; codewords that are close stand close to each other, so that blocks hold neighbours."""
        if not len(x):
            return np.zeros((1, x.shape[1]))
        x = np.unique(x, axis=0)
        book = x[rng.choice(len(x), min(words, len(x)), replace=False)]
        for _ in range(12):
            near = ((book**2).sum(1) - 2 * x @ book.T).argmin(1)
            for k in np.unique(near):
                book[k] = x[near == k].mean(0)
        order, left = [0], set(range(1, len(book)))
        while left:
            if len(order) % SIDE:  # the nearest to the block begun
                centre = book[order[-(len(order) % SIDE) :]].mean(0)
                order.append(min(left, key=lambda k: float(((book[k] - centre) ** 2).sum())))
            else:
                order.append(min(left))
            left.discard(order[-1])
        return book[order]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Cells (n, 2), and for both halves the squared distance (n, words) from each vector to the border of each codeword's region."""
        cells, moved = [], []
        for half, book, gap in zip((x[:, : self.half], x[:, self.half :]), self.books, self.gaps, strict=True):
            d = (half**2).sum(1)[:, None] + (book**2).sum(1) - 2 * half @ book.T
            near = d.argmin(1)
            border = np.maximum(d - d[np.arange(len(d)), near][:, None], 0) / (2 * gap[near])
            border[np.arange(len(d)), near] = 0
            cells.append(near)
            moved.append(border**2)
        return np.stack(cells, 1) if len(x) else np.zeros((0, 2), np.int64), moved

    def blocks(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own block of each vector, and the blocks (vector number, block) that its traversal visits, nearest first, its own included.

        A block is as near as its nearest cell, so its distance is the sum of the least of its codewords in both halves.
        """
        cells, moved = self.place(x)
        own = cells[:, 0] // SIDE * self.across + cells[:, 1] // SIDE
        one, two = (np.minimum.reduceat(m, np.arange(0, m.shape[1], SIDE), axis=1) for m in moved)
        row, i, j = traverse(one, two, self.reach)
        return own, row, i * self.across + j


def traverse(one: np.ndarray, two: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multi-sequence traversal of many vectors side by side: (vector, i, j) by vector, then by ascending one[i] + two[j], each as far as reach.

    Both halves' distances are sorted. Each i holds the next j that it has not given yet; a step gives every vector
    the nearest of these pairs, and vectors whose nearest is beyond reach are done.
    """
    a, b = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
    first, second = np.take_along_axis(one, a, 1), np.take_along_axis(two, b, 1)
    at, ahead = np.zeros(one.shape, np.int64), first + second[:, :1]
    live, rows, left, right = np.arange(len(one)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(live):
        k = ahead[live].argmin(1)
        going = ahead[live, k] <= reach
        live, k = live[going], k[going]
        j = at[live, k]
        rows.append(live), left.append(a[live, k]), right.append(b[live, j])
        at[live, k] = j = j + 1
        ahead[live, k] = np.where(j < two.shape[1], first[live, k] + second[live, np.minimum(j, two.shape[1] - 1)], np.inf)
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")
    return row[order], np.concatenate(left)[order], np.concatenate(right)[order]


def _units(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(1, keepdims=True)
    x = x / np.where(top > 0, top, 1)  # so that no square overflows
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes: of 32-bit numbers where these are exact."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    fits = (short == x).all(1)
    return [(short if f else x)[k].tobytes() for k, f in enumerate(fits)]


def _unpack(rows: list[bytes], size: int) -> np.ndarray:
    if all(len(r) == 4 * size for r in rows):
        return np.frombuffer(b"".join(rows), np.float32).reshape(-1, size).astype(float)
    return np.array([np.frombuffer(r, np.float32 if len(r) == 4 * size else np.float64) for r in rows], float)


def _roots(near: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """For rows and columns of a matrix of links the number of the least node that each reaches: rows, then columns; with same they are the same nodes."""
    m, k = near.shape
    rows, cols = np.arange(m), np.arange(k) + (0 if same else m)
    while True:
        new = np.minimum(cols, np.where(near, rows[:, None], m + k).min(0, initial=m + k))
        if same:
            rows = new = np.minimum(rows, new)
        back = np.minimum(rows, np.where(near, new[None, :], m + k).min(1, initial=m + k))
        if same:
            new = back
        done = (back == rows).all() and (new == cols).all()
        rows, cols = back, new
        if done:
            return rows, cols


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, recall: float = 0.9, words: int | None = None, sample: int = 8192, chunk: int = 2048) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of vectors (vec_id, embedding, anything else).

    Vectors of different length are compared with vectors of their own length only. A vector that is null, empty,
    zero, or holds null or non-finite components links with nothing. Equal vectors are one node that counts as
    often as it occurs, so a repeated row links with its copies. `sample` bounds the vectors (by hash order) on
    which each index is fitted. `recall` is the share of partners at just the threshold that a vector's own traversal is to
    meet; a pair is found from either side, and closer pairs are easier. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    keep = Scratch(spark, "embeddings")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    # Zeros of either sign are equal, and 128 bits name a vector.
    v = F.transform("v", lambda x: x + F.lit(0.0))
    src = src.withColumn("v", v).withColumn("usable", usable).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    nodes = src.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("v").alias("v"))
    nodes = keep.save(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    indexes = {}
    for size, n in sorted(nodes.groupBy(F.size("v")).count().collect()):
        own = nodes.where(F.size("v") == size).select("h1", "h2", "v").orderBy("h1", "h2").limit(sample)
        x = np.array([r.v for r in own.collect()], np.float64).reshape(-1, size)
        indexes[size] = MultiIndex(_units(x), words or codewords(n), threshold, recall)
    shared = spark.sparkContext.broadcast(indexes)  # per length of vectors two codebooks of MOST words at most

    @tidy
    def place(it):
        """A row per vector: its own block and those that it visits."""
        for b in slices(it):
            length = b.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(length).tolist():
                rows = b.filter(pa.array(length == size))
                x = np.asarray(rows.column("v").flatten(), float).reshape(-1, size)
                own, row, block = shared.value[size].blocks(_units(x))
                ends = np.searchsorted(row, np.arange(len(x) + 1))
                visits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(block, pa.int32()))
                cols = [rows.column("node"), rows.column("times"), pa.array([size] * len(x), pa.int32()), pa.array(_pack(x), pa.binary()), pa.array(own, pa.int32()), visits]
                yield pa.RecordBatch.from_arrays(cols, ["node", "times", "size", "v", "own", "visits"])

    placed = nodes.select("node", "times", "v").mapInArrow(place, "node long, times long, size int, v binary, own int, visits array<int>")
    placed = keep.save(placed, "placed")
    met = placed.select("node", "times", "size", "v", "own", "visits", F.explode("visits").alias("block")).withColumn("guest", F.col("block") != F.col("own"))
    parts = lambda c: F.ceil(F.count_if(c) / chunk).cast("int")
    # One row a block: MOST / SIDE squared of them at most for each length.
    chunks = met.groupBy("size", "block").agg(parts(~F.col("guest")).alias("m"), parts(F.col("guest")).alias("w")).where("m > 0")
    mine = met.join(F.broadcast(keep.save(chunks, "chunks")), ["size", "block"])
    # Member chunks are numbered from 0 to m - 1, guest chunks from m on; a task holds chunks i <= j, i a member chunk.
    c = F.when(~F.col("guest"), F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.col("m") + F.pmod(F.xxhash64("node"), F.greatest(F.col("w"), F.lit(1)))).cast("int")
    others = F.when(~F.col("guest"), F.col("m") + F.col("w")).otherwise(F.col("m"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), others - 1), lambda o: F.struct(F.least(o, "c").alias("i"), F.greatest(o, "c").alias("j"))))
    rows = ["size", "block", "node", "times", "v", "own", "guest", "c", F.when(~F.col("guest"), F.col("visits")).alias("visits")]
    mine = mine.withColumn("c", c).select(*rows, pairs.alias("ij")).select("*", "ij.i", "ij.j").drop("ij")

    def links(t: pa.Table) -> pa.Table:
        """Per vector its partners' number (n), and a spanning forest (b: a node that a reaches)."""
        groups: dict[tuple, list] = {}
        for row in zip(*(t.column(x).to_pylist() for x in ("size", "block", "i", "j", "c", "node", "times", "v", "own", "visits")), strict=True):
            groups.setdefault(row[:4], []).append(row[4:])
        a, to, n = [], [], []
        for (size, block, i, j), rows in groups.items():
            left, right = [r for r in rows if r[0] == i], [r for r in rows if r[0] == j]
            if not left or not right:
                continue
            x = _units(_unpack([r[3] for r in left], size))
            y = x if i == j else _units(_unpack([r[3] for r in right], size))
            near = x @ y.T >= threshold
            if i == j:
                near = np.triu(near, 1)
            elif right[0][4] != block:
                # Guests: where the member visits the guest's block too, the pair belongs to the smaller block.
                home = np.array([r[4] for r in right])
                back = np.stack([np.isin(home, r[5]) for r in left])
                near &= ~(back & (home < block)[None, :])
            if not near.any():
                continue
            times = np.array([r[2] for r in left]), np.array([r[2] for r in right])
            for own, sums in ((left, near @ times[1]), (right, near.T @ times[0])):
                for k in np.flatnonzero(sums).tolist():
                    a.append(own[k][1]), to.append(None), n.append(int(sums[k]))
            ids = [r[1] for r in left] + ([] if i == j else [r[1] for r in right])
            roots = _roots(near, i == j)
            for k, root in enumerate(roots[0].tolist() if i == j else np.concatenate(roots).tolist()):
                if root != k:
                    a.append(ids[k]), to.append(ids[root]), n.append(0)
        release()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(to, pa.int64()), "n": pa.array(n, pa.int64())})

    key = F.xxhash64("size", "block", "i", "j")
    task = F.when((F.col("i") == 0) & (F.col("j") <= 1), F.pmod(key, F.lit(4 * parallelism(spark)))).otherwise(key)
    found = keep.save(mine.withColumn("task", task).groupBy("task").applyInArrow(links, "a long, b long, n long"), "found")
    comps = connected_components(found.where("b IS NOT NULL").select("a", "b"), keep, "cc")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
    named = nodes.drop("v").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = keep.save(named.join(counts, "node", "left"), "named")
    least = named.groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    final = salted(named, least, "comp", "node").select("h1", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"))
    rows = salted(src.where("usable").select("vec_id", "h1", "h2"), keep.save(final, "final"), ["h1", "h2"], "vec_id").select("vec_id", "n_links", "component_id")
    none = src.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = keep.save(rows.union(none).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "rows")
    keep.drop("nodes", "placed", "chunks", "found", "named", "final")
    return out


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, linked from a cosine of 0.9 on."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
