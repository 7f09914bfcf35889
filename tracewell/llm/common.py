"""Tables, the shared folder and connected components, used by all operators of this subpackage."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = "\\x09-\\x0D\\x20"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; only Spark opens the path, which may lie in any store it reads."""
    bounded(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's own.

    Only where neither is set (a local session in tests) a temporary folder of this machine is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracewell-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_BYTES: rows with very long texts would otherwise fill a worker by the thousand."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


_kept: dict[str, object] = {}


def kept(key: str, make: Callable[[], object]) -> object:
    """What a worker keeps between the tasks of one query, which key names: the next task that ends with `trim` and without that key drops it."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def trim(key: str | None = None) -> None:
    """Gives freed memory back to the system at the end of a task: a worker lives on for the stages that follow. What is `kept` by another key goes."""
    for other in [k for k in _kept if k != key]:
        del _kept[other]
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trim_driver(spark: SparkSession) -> str | None:
    """Gives freed memory of the driver, Python's and the JVM's outside its heap, back to the system: what a session's many short threads and compilations
    leave otherwise grows from query to query. A JVM without that command (before 17.0.9) is left as it is; else its answer."""
    trim()
    sc = spark.sparkContext
    jvm = sc._jvm
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()  # of a class that is not open to calls by name
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    args = sc._gateway.new_array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        return invoke.invoke(server, args)
    except Py4JJavaError:
        return None


_scratch: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `materialise` writes meanwhile, without a list of their own, are deleted at the end, when the driver gives freed memory back as well; results with the
    scratch around this one."""
    made: list[str] = []
    token = _scratch.set((*_scratch.get(), made))
    try:
        yield
    finally:
        _scratch.reset(token)
        discard(spark, made)
        trim_driver(spark)


def materialise(df: DataFrame, tag: str, made: list[str] | None = None, result: bool = False) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors.

    made, if given, gets the path, for `discard`; else the scratch that is open, if any: for a result, which outlives it, the one around it.
    """
    spark = df.sparkSession
    bounded(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    open_ = _scratch.get()[: -1 if result else None]
    if made is None and open_:
        made = open_[-1]
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Edges that one task of a step on edges is given.
EDGES = 500_000
#: Bytes of an Arrow batch.
ARROW_BYTES = 8 << 20
#: Buckets of a hash: a set of them may always be broadcast.
BUCKETS = 1 << 20


def bucket(hashed: Column) -> Column:
    return F.coalesce(F.pmod(hashed, F.lit(BUCKETS)), F.lit(-1))


def buckets(hashes: DataFrame, hashed: str) -> DataFrame:
    """The distinct column `_hash_bucket` of a column of hashes: BUCKETS + 1 numbers at most, so that it's broadcast at any size. Rows of a wide
    table that are in none of them stay out of a shuffle that only the others are needed for."""
    return F.broadcast(hashes.select(bucket(F.col(hashed)).alias("_hash_bucket")).distinct())


def chunks(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a column in runs of about `most` bytes, one text at least, each with the number of its first row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield at, texts.slice(at, to - at).to_pylist()
        at = to


#: Buckets of a bitmap: BITMAP / 64 rows come to the driver at any size, and as many words go out.
BITMAP = 1 << 24


def bitmap(hashes: DataFrame, hashed: str) -> Broadcast:
    """A bitmap of the buckets (the highest bits) of a long column of hashes. Rows in no such bucket aren't among them; the others
    still have to be joined."""
    shift = 64 - (BITMAP.bit_length() - 1)
    b = F.shiftrightunsigned(hashed, shift)
    found = hashes.groupBy(F.shiftright(b, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {shift}) & 63 as int))")).alias("bits"))
    words = np.zeros(BITMAP >> 6, np.int64)
    for batch in found.toArrow().to_batches():
        words[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False)
    return hashes.sparkSession.sparkContext.broadcast(words.view(np.uint64))


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 hashes are in buckets of a bitmap."""
    b = hashes.view(np.uint64) >> np.uint64(64 - (BITMAP.bit_length() - 1))
    return (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & np.uint64(63))) & np.uint64(1) != 0


def packed(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of df in one struct: no name of theirs can meet a name that an operator gives."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in without])


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables that `materialise` wrote and that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files that nothing reads any more: it does so once the driver's JVM has collected their handles, which a heap with
    room puts off."""
    spark.sparkContext._jvm.System.gc()


def connected(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of the long columns (a, b): one row (node, root) for every node of an edge between
    two different nodes; root is the smallest node of the component.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). Every step writes its tables to the
    shared folder and nothing is collected but two totals. The minimum of each node is written before it is joined,
    so both sides of that join are plain exchanges and a node with very many edges can be split.
    Self loops and nulls are dropped; an empty table of edges gives an empty result.
    """
    spark = edges.sparkSession
    made: list[str] = []
    counted = Observation()
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialise(e.observe(counted, F.count("*").alias("n")), tag, made)
    # Steps never make more edges than twice as many as there are: so many partitions, in place of many that are all but empty.
    parts = 1 + 2 * (counted.get["n"] or 0) // EDGES
    before = None
    while True:
        old, made = made, []
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")).coalesce(parts), tag, old)
        large = both.join(low, "a").where("b > a and b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialise(large.distinct().coalesce(parts), tag, old)
        low = materialise(large.groupBy("a").agg(F.min("b").alias("low")).coalesce(parts), tag, old)
        linked = large.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        seen = Observation()
        e = linked.unionByName(low.withColumnRenamed("low", "b")).distinct()
        e = e.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        e = materialise(e.coalesce(parts), tag, made)
        discard(spark, old)
        if before == seen.get:
            if open_ := _scratch.get():
                open_[-1].extend(made)
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = seen.get
