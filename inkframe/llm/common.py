"""Shared folder, scratch tables and hashing that the operators of this subpackage use."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, and rows that are worked on at once: texts can be long.
BATCH_ROWS = 512


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="inkframe-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (where unset, in local mode only) one of our own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (known or _own_dir()).rstrip("/")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Where the session leaves the size of Arrow batches at its default, make them small; a size that was set stays."""
    if _BATCH not in dict(spark.conf.getAll):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


class Scratch:
    """Tables written under the shared folder, which cut lineage and outlive any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.tag = uuid.uuid4().hex
        self.root = f"{shared_dir(spark)}/{name}-{self.tag}"
        small_batches(spark)

    @contextlib.contextmanager
    def batch_rows(self, n: int):
        """Within, Arrow batches hold n rows at most."""
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(n))
        try:
            yield
        finally:
            self.spark.conf.set(_BATCH, before)

    def path(self, tag: str) -> str:
        return f"{self.root}/{tag}"

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(tag))
        return self.spark.read.schema(df.schema).parquet(self.path(tag))

    def drop(self, *tags: str) -> None:
        """Remove tables that no returned plan reads any more, and the shuffle files behind them."""
        jvm = self.spark.sparkContext._jvm
        for tag in tags:
            p = jvm.org.apache.hadoop.fs.Path(self.path(tag))
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        jvm.System.gc()  # Spark removes the files of shuffles that the driver has forgotten


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Give freed memory back to the system: Python workers idle between tasks, and others need the room."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """run(batches), a generator, that gives freed memory back at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def slices(batches, rows: int = BATCH_ROWS):
    """Record batches cut to a few rows, whatever the session's batch size."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def object_writer(column: str, uri: str, suffix: str):
    """For tasks: batches to batches with path and n_bytes instead of a binary column, whose values are written as write_objects does."""

    @tidy
    def run(it):
        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root)
        context, k = TaskContext.get(), 0
        for b in it:
            b = b.filter(b.column(column).is_valid())
            out = []
            for value in b.column(column):
                data = value.as_buffer()
                name = f"{root}/part-{context.partitionId():05d}-{k:05d}{suffix}"
                with fs.open_output_stream(f"{name}.{context.taskAttemptId()}", compression=None) as f:
                    f.write(data)
                fs.move(f"{name}.{context.taskAttemptId()}", name)
                out.append((name, data.size))
                k += 1
            names, sizes = zip(*out, strict=True) if out else ((), ())
            others = [c for c in b.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), pa.array(names, pa.string()), pa.array(sizes, pa.int64())], [*others, "path", "n_bytes"])

    return run


def write_objects(rows: DataFrame, column: str, uri: str, suffix: str) -> DataFrame:
    """Each value of a binary column as a file of its own in the folder uri, named by part and number: the other columns of rows, path, n_bytes.

    uri is of any file system that pyarrow opens (file, hdfs, s3, gs) and that all executors reach. A file appears
    under its name once it is whole, and a task that runs again writes the same names anew. Nulls give no file.
    """
    others = [c for c in rows.columns if c != column]
    keep = Scratch(rows.sparkSession, "objects")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != column)
    with keep.batch_rows(4):  # the values are large
        return keep.save(rows.select(*others, column).mapInArrow(object_writer(column, uri, suffix), f"{schema}path string, n_bytes long"), "written")


def uri_of(path: str) -> str:
    """A path of the shared folder as a URI."""
    return path if ":/" in path else f"file://{path}"


def object_opener(uri: str):
    """In a task: path, as write_objects gives it, to the bytes of the file."""
    fs, _ = pafs.FileSystem.from_uri(uri)

    def read(path: str) -> bytes:
        with fs.open_input_stream(path, compression=None) as f:
            return f.read()

    return read


def exact(docs: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever other columns docs has: names with dots, or the same in other case."""
    at = [docs.columns.index(n) for n in names]
    own = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return own.select(*[F.col(f"c{k}").alias(n) for k, n in zip(at, names, strict=True)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def salted(rows: DataFrame, least: DataFrame, keys: str | list[str], by: str, salts: int = 16) -> DataFrame:
    """rows joined with `least` on keys by shuffle: a key's rows are dealt over `salts` tasks by column `by`, and its rows of `least`, which are few, go to each."""
    keys = [keys] if isinstance(keys, str) else keys
    dealt = least.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return rows.join(dealt.hint("merge"), [*keys, "__salt"]).drop("__salt")  # else it may be broadcast, salts and all


_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def connected_components(edges: DataFrame, scratch: Scratch, tag: str, salts: int = 8) -> DataFrame:
    """Smallest reachable node for every node of edges (a, b long): rows (node, comp).

    Alternating large-star and small-star rounds, every round written to the shared folder. Joins against a
    hub are salted, so the edges of a hub that holds a large part of all rows are dealt over several tasks.
    Empty edges give no rows; loops and repeated edges are ignored.
    """
    spark = scratch.spark
    cur = scratch.save(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), f"{tag}-0")
    salted = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))

    def with_min(nb: DataFrame) -> DataFrame:
        """nb (u, v): adds m, the least of u and its neighbours."""
        least = nb.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salted.alias("s"))
        return nb.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(least, ["u", "s"])

    mark, k = None, 0
    while True:
        both = cur.union(cur.selectExpr("v AS u", "u AS v"))
        large = with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        k += 1
        large = scratch.save(large, f"{tag}-{k}")
        down = large.where("u <> v")
        m = with_min(down)
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        k += 1
        nxt = scratch.save(small, f"{tag}-{k}")
        got = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{tag}-{k - 2}", f"{tag}-{k - 1}")
        cur = nxt
        if mark == tuple(got):
            break
        mark = tuple(got)
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
