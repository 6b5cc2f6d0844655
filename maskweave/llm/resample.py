"""Target-distribution importance resampling by external sort-count (operator 13).

1. Words become buckets (CRC-32 of their bytes modulo ``BUCKETS``), written once as packed streams of
   16-bit numbers with the offsets of their documents: two bytes a word.
2. Each block of the streams is sorted and run-length encoded; only its runs (bucket, count) are
   summed in a shuffle, ``BUCKETS`` rows a task at most. The same is done for the target's texts.
3. The gain of a bucket is the log ratio of its smoothed shares. Another pass over the streams gathers
   gains and sums them at the documents' offsets (``np.add.reduceat``).
4. A document's key is its mean gain plus Gumbel noise from a hash of its id, so that the highest
   keys are a weighted sample without replacement. Documents are dealt out in ranges of the key, and
   ranked from the sizes of the ranges before.

Defined cases: a null or wordless text has no features, weight 0, and can't be drawn; a null id hashes
as an empty one and comes last among ties; repeated rows are documents of their own, ranked one after
the other; other columns, whatever their names, are not read; an empty table gives no rows; an empty
target gives gains that favour rare buckets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import util

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: Documents in a block of the streams.
_BLOCK_DOCS = 4096
#: Bytes of a word beyond which it is hashed alone.
_LONG = 64


def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _table()


def crc32_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges: a byte of all words at a time, the longest first."""
    n = end - start
    order = np.argsort(-n, kind="stable")
    at, size = start[order], n[order]
    long = int(np.searchsorted(-size, -_LONG, side="left"))  # these have more bytes
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for j in range(min(int(size[0]), _LONG) if len(size) else 0):
        m = int(np.searchsorted(-size, -j, side="left"))
        crc[:m] = _CRC[(crc[:m] ^ buf[at[:m] + j]) & 255] ^ (crc[:m] >> 8)
    out = np.empty(len(n), np.uint32)
    out[order] = ~crc
    for i in order[:long]:
        out[i] = zlib.crc32(buf[start[i] : end[i]].tobytes())
    return out


def buckets(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each word, and the index of each text's first (with an end)."""
    start, end, first = c.words(K.NOT_ALNUM)
    return (crc32_ranges(K.LOWER[c.buf], start, end) % BUCKETS).astype(np.uint16), first


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = util.arrow_schema("doc_id array<bigint>, offsets array<bigint>, stream binary")
    for b in batches:
        for c in K.chunks(b.column(1)):
            stream, first = buckets(c)
            for i in range(0, len(c), _BLOCK_DOCS):
                z = min(i + _BLOCK_DOCS, len(c))
                ids = b.column(0).slice(int(c.rows[i]), z - i).to_pylist()
                yield K.batch(schema, doc_id=[ids], offsets=[(first[i : z + 1] - first[i]).tolist()], stream=[stream[first[i] : first[z]].tobytes()])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted, run-length encoded blocks: bucket, count, summed over a task's blocks."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        for s in b.column(0):
            sorted_ = np.sort(np.frombuffer(s.as_buffer(), np.uint16))
            begin = np.flatnonzero(np.diff(sorted_, prepend=-1))
            total[sorted_[begin]] += np.diff(begin, append=len(sorted_))
    at = np.flatnonzero(total)
    yield K.batch(util.arrow_schema("bucket int, n bigint"), bucket=at.astype(np.int32), n=total[at])


def _weights(gains: np.ndarray):
    schema = util.arrow_schema("doc_id bigint, n_features bigint, weight bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, offsets, stream in zip(b.column(0), b.column(1), b.column(2), strict=True):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                gathered = gains[np.frombuffer(stream.as_buffer(), np.uint16)]
                some = np.flatnonzero(n)
                weight = np.zeros(len(n), np.int64)
                if len(some):  # an empty range would take its successor's first gain
                    weight[some] = np.add.reduceat(gathered, at[:-1][some]) // n[some]
                yield K.batch(schema, doc_id=ids.values, n_features=n, weight=weight)

    return run


def streams(docs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return util.written(rows.mapInArrow(_streams, "doc_id array<bigint>, offsets array<bigint>, stream binary"), name)


def counts(packed: DataFrame) -> np.ndarray:
    """How often each bucket stands in the streams."""
    found = packed.select("stream").mapInArrow(_runs, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    s, t = source.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_id: str = "item_id", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: one row for each row of docs; rank is null where not drawn."""
    spark = docs.sparkSession
    util.ship(spark)
    packed = streams(docs, doc_id, text, "streams")
    wanted = counts(streams(target, target_id, text, "target-streams"))
    weighted = packed.mapInArrow(_weights(gains(counts(packed), wanted)), "doc_id bigint, n_features bigint, weight bigint")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), util.no_null(F.col("doc_id").cast("string"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = util.written(weighted.withColumn("score", F.col("weight") + noise), "scored")
    able = F.col("n_features") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_copy")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart, so that no range of the order is only ties
    dealt = scored.where(able).withColumn("_copy", F.monotonically_increasing_id()).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    dealt = util.written(dealt, "ranges")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_base")
    ranked = dealt.join(F.broadcast(base), "_part").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    columns = ("doc_id", "n_features", "weight", "score")
    return ranked.select(*columns, "rank").unionByName(scored.where(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
