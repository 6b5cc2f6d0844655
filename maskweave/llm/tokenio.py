"""Token ids in ORC files (operator 7).

``write_tokens`` puts documents in ascending order of id (a range partitioning; no single task
sees them all), tokenises each range and writes it as ORC: integer run-length encoded ids, row
indexes, and a Bloom filter on the document id. ``read_tokens`` reads whole tables stripe by
stripe in parallel, or some ids by pruning on stripe and row-group statistics and Bloom filters.

Defined cases: a null text is empty and has the end id alone; null ids come first; repeated ids
are kept, in the order of their texts; an empty table gives an empty file set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import encode, util

END = 2
_TOKENS = "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>"
ORC_OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.encoding.strategy": "COMPRESSION", "compression": "zstd"}
_ROWS = 256


def _tokenise(tokenizer: str, end: int):
    schema = util.arrow_schema(_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encode.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, len(whole), _ROWS):
                b = whole.slice(lo, _ROWS)
                values, off = enc.encode(b.column(1), end)
                n = np.diff(off)
                starts = at + off[:-1]
                at += int(off[-1])
                ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view("<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part, np.int32)), pa.array(starts), pa.array(n), ids.cast(schema.field("ids").type)], schema=schema)

    return run


def write_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = encode.DEFAULT, end: int = END, partitions: int | None = None) -> None:
    """Writes doc_id, part, at (ids before it in its part), n_tokens, ids to ORC files under path."""
    spark = docs.sparkSession
    util.ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(_tokenise(tokenizer, end), _TOKENS).write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The files' rows; with doc_ids those alone, by an equality filter that ORC prunes with."""
    df = spark.read.schema(_TOKENS).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


@arrow_udf(util.sql_type("bigint"))
def ids_crc32(ids: pa.Array) -> pa.Array:
    """Unsigned crc32 of each list as little-endian unsigned 32-bit integers."""
    off = ids.offsets.to_numpy()
    raw = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<i4", copy=False))).cast("B")
    return pa.array([encode.crc(raw[4 * a : 4 * b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.int64())


def with_starts(tokens: DataFrame) -> DataFrame:
    """Adds start: the ids of all documents before it in the file set.

    A part's total is one row; their running sum is over parts, not documents.
    """
    from pyspark.sql import Window

    parts = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return tokens.join(before, "part").withColumn("start", F.col("before") + F.col("at"))


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 as read back from the files."""
    spark = docs.sparkSession
    path = util.scratch(spark, "tokens")
    write_tokens(docs, path)
    back = read_tokens(spark, path).select("doc_id", "part", "at", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
    return with_starts(back).select("doc_id", "start", "n_tokens", "ids_crc32")
