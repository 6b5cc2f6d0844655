"""Shared folder, lineage cuts, code shipping and connected components."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIPPED: set[str] = set()
BATCH_BYTES = str(4 << 20)


def ship(spark: SparkSession) -> None:
    """Gives this package to Python workers, once for each application, and keeps their batches small.

    Texts can be long: a batch ends at ``BATCH_BYTES``, so the JVM, Arrow and numpy hold a few MB of it.
    """
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session, as in tests, may go without and gets one of its own."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None)
    if told:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(told)
        return told.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskweave-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the write that needed them is done, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows of df, written once to the shared folder as Parquet and read again, and where they are: lineage ends here."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``staged`` rows that stay."""
    return staged(df, name)[0]


def delete(spark: SparkSession, path: str) -> None:
    """Takes staged rows that nothing reads any more off the disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}


def sql_type(name: str) -> T.DataType:
    return T.ArrayType(sql_type(name[6:-1])) if name.startswith("array<") else _TYPES[name]


def struct(ddl: str) -> T.StructType:
    """A struct of plain fields, without a running session (workers import it)."""
    return T.StructType([T.StructField(*(n, sql_type(t))) for n, t in (f.split(" ") for f in ddl.split(", "))])


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(struct(ddl))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Edges that one task holds: two columns of 8 bytes and their working copies.
LOCAL_EDGES = 2_000_000


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches]
    ends = np.concatenate(held) if held else np.zeros((0, 2), np.int64)
    nodes, back = np.unique(ends, return_inverse=True)
    a, b = back.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:  # hook each end's root to the smaller label, then jump to the roots
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    for i in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(nodes[label[i : i + 100_000]])], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component: the smallest node reachable over the undirected edges (a, b); ints of 64 bits.

    A graph of up to ``LOCAL_EDGES`` distinct edges is solved by one task in some 100 MB; a larger
    one by alternating large-star and small-star steps (Kiveris et al. 2014), as minima by
    key and equi-joins: no neighbour list is ever gathered, so a star of any size is only many rows
    of a join, which adaptive execution can split. The rows are written after each round.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = written(e.distinct(), "edges")
    if e.count() <= LOCAL_EDGES:
        return e.repartition(1).mapInArrow(_one_task, "node bigint, component bigint")
    both = lambda d: d.select("u", "v").union(d.select(F.col("v").alias("u"), F.col("u").alias("v")))
    last = None
    while True:
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        sym = both(e)
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of these
        down = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "large-star")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        e = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(e.where("u <> v").distinct(), "small-star")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    nodes = e.select("u", "v")
    roots = nodes.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).groupBy("node").agg(F.min("component").alias("component"))


#: A bitmap has 16 bits for each hash, 2 ** 27 (16 MB) at most.
BITMAP_BITS = 27


def bitmap(hashes: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bitmap of the leading bits of 64-bit hashes, and how many: no false negatives, and of a bounded size."""
    n = hashes.count()
    bits = min(max((16 * n).bit_length(), 16), BITMAP_BITS)
    bit = F.shiftrightunsigned(column, 64 - bits)
    mask = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))")
    words = hashes.select(F.shiftright(bit, 6).alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return out, bits


def may_hold(bitmap: tuple[np.ndarray, int], h: np.ndarray) -> np.ndarray:
    words, bits = bitmap
    at = h >> np.uint64(64 - bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case of its letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def no_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
