"""Quality rules with host-level verdicts (operator 4).

Document rules are computed per text; their failures are summed by host, each host's failure
rate is shrunk towards the corpus by a beta prior fitted to the hosts' own rates (method of
moments), and the host's verdict is joined back to its documents:

* a host whose shrunken rate is ``strict_rate`` or more is strict: its documents that break
  any soft rule go; a document that breaks none stays;
* a host at ``reject_rate`` or more is rejected with all its documents.

Defined cases: a null text has no words and fails; a null host is a host of its own; repeated
rows are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import kernel as K
from . import util

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])


def _per_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return K.mix(h + row.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def chunk_stats(c: K.Chunk) -> np.ndarray:
    """A row of the five counts for each text."""
    start, end, first = c.words()
    hasher = K.Hasher(c.buf)
    n = len(c)
    points = c.code_points()
    out = np.zeros((n, 5), np.int64)
    out[:, 0] = np.diff(first)
    out[:, 1] = _sums(points[end] - points[start], first)
    out[:, 2] = _sums(_SYMBOL[c.buf], c.off)
    ls, le, lfirst = c.words(_NEWLINE)
    full = np.searchsorted(start, le) > np.searchsorted(start, ls)
    row = np.repeat(np.arange(n), np.diff(lfirst))[full]
    _, at = np.unique(_per_row(hasher.ranges(ls[full], le[full]), row), return_index=True)
    out[:, 3] = np.bincount(row, minlength=n) - np.bincount(row[at], minlength=n)
    h, at, bounds = K.windows(hasher.ranges(start, end), first, 3)
    if len(h):
        row = np.repeat(np.arange(n), np.diff(bounds))
        _, back, count = np.unique(_per_row(h, row), return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        cover = np.zeros(len(start), bool)
        for j in range(3):
            cover[at + j] = True
        out[:, 4] = _sums(cover, first)
    return out


def stats_array(text: pa.Array) -> pa.StructArray:
    parts = [chunk_stats(c) for c in K.chunks(text)]
    rows = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(5)], names=_NAMES)


def with_stats(docs: DataFrame, text: str, name: str = "_f") -> DataFrame:
    """docs and the counts as a struct column, by whole batches: the kind of Python worker that other stages use."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, _STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, stats_array(b.column(at))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, schema)


_STATS = util.struct(", ".join(f"{n} bigint" for n in _NAMES))


@arrow_udf(_STATS)
def text_stats(text: pa.Array) -> pa.Array:
    return stats_array(text)


def base_failed(s: str) -> Column:
    f = F.col(s)
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > MAX_REPEAT_PCT * f["n_words"])


def soft_failed(s: str) -> Column:
    """Rules that count against the host, and against the document where its host is strict."""
    f = F.col(s)
    long = F.greatest(f["n_words"], F.lit(1))
    return (f["n_symbols"] * 4 > long) | (f["n_dup_lines"] * 20 > long) | (f["word_chars"] > 15 * long) | (f["word_chars"] < 2 * long)


def host_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("base_failed") | F.col("_soft")).cast("long")).alias("k"))


def host_verdicts(hosts: DataFrame, strict_rate: float, reject_rate: float) -> DataFrame:
    """_host, n, k, rate (shrunken), verdict: 0 fine, 1 strict, 2 rejected."""
    rate = F.col("k") / F.col("n")
    # one row of three means, whatever the number of hosts
    m = hosts.agg(F.avg(rate).alias("mean"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("var"), F.avg(1 / F.col("n")).alias("inv")).first()
    mean = min(max(m["mean"] if m["mean"] is not None else 0.5, 1e-4), 1 - 1e-4)
    between = max((m["var"] or 0.0) - mean * (1 - mean) * (m["inv"] or 0.0), 1e-5)
    weight = min(max(mean * (1 - mean) / between - 1, 1.0), 1e4)
    shrunk = (F.col("k") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return hosts.withColumn("rate", shrunk).withColumn("verdict", F.when(F.col("rate") >= reject_rate, 2).when(F.col("rate") >= strict_rate, 1).otherwise(0))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keys: list[str] | None = None, strict_rate: float = 0.5, reject_rate: float = 0.95) -> DataFrame:
    """keys, the five counts, base_failed, host_verdict, kept: one row for each row of docs.

    Counts are made once and written; hosts are partial sums, so a host with a third of all
    rows is as cheap as any. Only hosts with a verdict other than 0 matter to the join.
    """
    util.ship(docs.sparkSession)
    keys = keys or ["doc_id"]
    rows = docs.select(*keys, F.coalesce(F.col(host), F.lit("\x00")).alias("_host"), text_stats(F.col(text)).alias("_f"))
    rows = rows.withColumns({"base_failed": base_failed("_f"), "_soft": soft_failed("_f")})
    rows = util.written(rows, "quality")
    hosts = host_verdicts(util.written(host_counts(rows), "hosts"), strict_rate, reject_rate)
    rows = rows.join(hosts.where("verdict > 0").select("_host", "rate", "verdict"), "_host", "left")
    kept = ~F.col("base_failed") & (F.coalesce(F.col("verdict"), F.lit(0)) < F.when(F.col("_soft"), 1).otherwise(2))
    return rows.select(*keys, *[F.col("_f")[c].alias(c) for c in _NAMES], "base_failed", F.coalesce("verdict", F.lit(0)).alias("host_verdict"), kept.alias("kept"))


def keep(docs: DataFrame, text: str = "text", host: str = "source", strict_rate: float = 0.5, reject_rate: float = 0.95) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    The verdict of a row depends on its host and its counts alone, so the second pass applies the
    verdicts of hosts without a key of documents: repeated rows and null ids need no care.
    """
    util.ship(docs.sparkSession)
    rows = with_stats(docs, text)
    rows = rows.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(host), F.lit("\x00")).alias("_host"), "_f")
    rows = rows.withColumns({"base_failed": base_failed("_f"), "_soft": soft_failed("_f")})
    hosts = host_verdicts(util.written(host_counts(rows), "hosts"), strict_rate, reject_rate)
    rows = rows.where(~F.col("base_failed")).join(hosts.where("verdict > 0").select("_host", "verdict"), "_host", "left")
    rows = rows.where(F.coalesce(F.col("verdict"), F.lit(0)) < F.when(F.col("_soft"), 1).otherwise(2))
    return rows.select("_row.*")
