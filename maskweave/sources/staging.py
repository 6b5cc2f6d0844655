"""Rows written once to the shared folder where several branches of a plan read them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []
_SCOPE = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local session, as in tests, may go without and gets one of its own."""
    sc = spark.sparkContext
    told = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if told:
        return told.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="maskweave-"))
    return sc.getCheckpointDir().rstrip("/")


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """df as Parquet in the shared folder: its plan ends here and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    mine = getattr(_SCOPE, "written", None)
    (_WRITTEN if mine is None else mine).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a scan with fewer splits than cores, such as one small file, dealt out; a larger scan as it is."""
    n = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= n else scan.repartition(n)


def _deleted(spark: SparkSession, paths: list[str]) -> int:
    n = len(paths)
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What this thread stages within is deleted at the end; results must be written by then."""
    before, _SCOPE.written = getattr(_SCOPE, "written", None), []
    try:
        yield
    finally:
        mine, _SCOPE.written = _SCOPE.written, before
        _deleted(spark, mine)


def clear(spark: SparkSession) -> int:
    """Deletes what this session has staged, once its results are written; gives the number of folders."""
    return _deleted(spark, _WRITTEN)
