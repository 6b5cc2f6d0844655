"""Substring deduplication by line hashing (operator 9).

A text is cut into units: at line ends, at sentence ends, and after words chosen by their own hash
(so that long lines without sentences are cut alike wherever they stand). A unit is normalised:
ASCII letters lower-cased, white space as one. A digest covers a unit and those after it until
``MIN_WORDS`` words are reached, so a short common line alone is never a repeat. Besides, of every
``_SPREAD`` runs of ``MIN_WORDS`` words that follow each other the one with the smallest digest is taken
(winnowing), so any passage of ``MIN_WORDS`` + ``_SPREAD`` - 1 = 50 words has one inside, however it is
cut. Spans then grow word by word on both sides while the words equal those of the kept
occurrence; what is left beyond the last chosen run is at most ``_REACH`` words. A span that has fewer than
``least`` words by then is left alone: lines that many documents share are no copies. Digests are grouped
over all documents; the occurrence with the smallest (doc_id, offset) stays, all others are removed,
by their offsets in the original text.

The grouping is partial sums by digest. Only rows whose digest may repeat, by a bitmap of bounded
size without false negatives, are sent to the join that finds the occurrences, and that is a plain
equi-join, so a digest with a third of all rows can be split by adaptive execution.

Defined cases: a null or short text has no units; documents without an id are not ranked, neither
kept nor removed; rows that repeat an id and text are one document; of several texts under one id
the id names one (that with the smallest hash), the others are neither kept nor removed; an empty table gives no spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import util

MIN_WORDS = 20
#: Words of a span that is removed by default: shorter repeats are phrases that documents share by chance, and single lines.
LEAST = 50
_SPLIT = 24
_SPREAD = 31
_REACH = MIN_WORDS + _SPREAD
_UNITS = "d1 bigint, d2 int, doc_id bigint, start int, end int"
_AROUND = "doc_id bigint, at int, side int, w int, h array<int>, to array<int>"


def _chosen(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The first words of the runs of MIN_WORDS words that winnowing takes; h: digests of the runs, those over row ends too."""
    n = len(h)
    if n < _SPREAD:
        return np.zeros(0, np.int64)
    low = (h >> np.uint64(32) << np.uint64(32)) | np.arange(n, dtype=np.uint64)  # of equal ones the leftmost
    for step in (1, 2, 4, 8, _SPREAD - 16):
        low = np.minimum(low[:-step], low[step:])
    at = np.arange(len(low))
    row = np.searchsorted(first, at, side="right") - 1
    whole = at + MIN_WORDS + _SPREAD - 1 <= first[row + 1]
    return np.unique((low[whole] & np.uint64(0xFFFFFFFF)).astype(np.int64))


def unit_windows(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two digests, row, and the byte start and end of every window of units of a chunk."""
    start, end, first = c.words()
    low = K.LOWER[c.buf]
    h = K.Hasher(low).ranges(start, end)
    n = len(h)
    if not n:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z, z, z, z
    lines = np.concatenate([[0], np.cumsum(c.buf == 10)])
    last = np.zeros(n, bool)  # a unit ends with this word
    last[:-1] = lines[start[1:]] > lines[end[:-1]]
    tail = c.buf[end - 1]
    last |= (tail == 46) | (tail == 33) | (tail == 63) | (h % np.uint64(_SPLIT) == 0)
    last[first[1:][np.diff(first) > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]])
    row = np.searchsorted(first, begins, side="right") - 1
    to = np.searchsorted(ends, begins + MIN_WORDS)  # the first unit that ends at MIN_WORDS words or later
    ok = to < len(ends)
    ok[ok] = ends[to[ok]] <= first[row[ok] + 1]
    begins, stop = begins[ok], ends[to[ok]]
    up, back = K._powers(n + 1)
    digests = []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(K.mix(h ^ np.uint64(salt)) * up[:n], out=sums[1:])
        if not digests:
            more = _chosen(K.mix((sums[MIN_WORDS:] - sums[:-MIN_WORDS]) * back[: max(n + 1 - MIN_WORDS, 0)]), first)
            both = np.unique(np.concatenate([begins << 32 | stop, more << 32 | more + MIN_WORDS]))
            begins, stop = both >> 32, both & 0xFFFFFFFF
            row = np.searchsorted(first, begins, side="right") - 1
        digests.append(K.mix((sums[stop] - sums[begins]) * back[begins]))
    return digests[0], (digests[1] >> np.uint64(33)).astype(np.int64), row, start[begins], end[stop - 1]


def _units(bitmap: tuple[np.ndarray, int] | None):
    schema = util.arrow_schema(_UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for c in K.chunks(b.column(1)):
                d1, d2, row, a, z = unit_windows(c)
                if bitmap is not None:
                    ok = util.may_hold(bitmap, d1)
                    d1, d2, row, a, z = d1[ok], d2[ok], row[ok], a[ok], z[ok]
                points = c.code_points()
                base = points[c.off[:-1]][row]
                yield K.batch(schema, d1=K.signed(d1), d2=d2.astype(np.int32), doc_id=ids[c.rows[row]].astype(np.int64), start=(points[a] - base).astype(np.int32), end=(points[z] - base).astype(np.int32))

    return run


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words before (side 0) or after (side 1) places of texts, nearest first: hashes, and where each would put the edge; w is the number of the word at the edge."""
    schema = util.arrow_schema(_AROUND)
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        asked = b.column(2)
        off = asked.offsets.to_numpy()
        flat = asked.values
        at_all, side_all = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        for c in K.chunks(b.column(1)):
            start, end, first = c.words()
            n = len(start)
            if not n:
                continue
            lo, hi = off[c.rows[0]], off[c.rows[-1] + 1]
            at, side = at_all[lo:hi], side_all[lo:hi]
            row = np.repeat(np.arange(len(c)), off[c.rows + 1] - off[c.rows])
            points = c.code_points()
            base = points[c.off[:-1]]
            a, z = points[start], points[end]
            left, right = np.searchsorted(a, base[row] + at), np.searchsorted(z, base[row] + at)
            edge = np.where(side == 0, a[np.minimum(left, n - 1)], z[np.minimum(right, n - 1)])
            ok = edge == base[row] + at  # an id's other text may have no such place
            at, side, row, left, right = at[ok], side[ok], row[ok], left[ok], right[ok]
            k = np.arange(1, _REACH + 1)
            w = np.where(side[:, None] == 0, left[:, None] - k, right[:, None] + k)
            number = np.where(side == 0, left, right) - first[row]
            inside = (w >= first[row][:, None]) & (w < first[row + 1][:, None])
            h = (K.Hasher(K.LOWER[c.buf]).ranges(start, end) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            w = np.clip(w, 0, n - 1)
            to = (np.where(side[:, None] == 0, a[w], z[w]) - base[row][:, None]).astype(np.int32)
            cut = pa.array(np.concatenate([[0], np.cumsum(inside.sum(1))]).astype(np.int32))
            lists = {name: pa.ListArray.from_arrays(cut, pa.array(v[inside], pa.int32())).cast(schema.field(name).type) for name, v in (("h", h[w]), ("to", to))}
            yield K.batch(schema, doc_id=ids[c.rows[row]].astype(np.int64), at=at.astype(np.int32), side=side.astype(np.int32), w=number.astype(np.int32), **lists)


def _numbered(spans: DataFrame) -> DataFrame:
    """Adds span: overlapping and touching spans of a document have the same number."""
    by = Window.partitionBy("doc_id").orderBy("start")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("span", F.sum("new").over(by))


def _grown(rows: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """The spans and what they repeat, grown on both sides over words that are equal in both; those of fewer than least words go."""
    same = F.col("doc_id") == F.col("kept_doc_id")
    edges = [spans.select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side")), spans.select("doc_id", F.col("end"), F.lit(1)), spans.select("kept_doc_id", "kept_start", F.lit(0)), spans.select("last_doc_id", "last_end", F.lit(1))]
    asked = edges[0].union(edges[1]).union(edges[2]).union(edges[3]).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("at", "side")).alias("asked"))
    around = rows.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_around, _AROUND)
    around = util.written(around.groupBy("doc_id", "at", "side").agg(F.min(F.struct("h", "to", "w")).alias("x")), "around")

    def words(side: int, name: str, doc_id: str, at: str) -> DataFrame:
        return around.where(F.col("side") == side).select(F.col("doc_id").alias(doc_id), F.col("at").alias(at), F.col("x").alias(name))

    def many(x: str, y: str) -> Column:
        differ = F.array_position(F.zip_with(F.col(x)["h"], F.col(y)["h"], lambda a, b: ~a.eqNullSafe(b)), True)
        return F.coalesce(F.when(differ == 0, F.size(F.col(x)["h"])).otherwise(differ - 1), F.lit(0)).cast("int")

    def edge(x: Column, n: Column, else_: str) -> Column:
        return F.when(n > 0, F.element_at(x["to"], F.greatest(n, F.lit(1)))).otherwise(F.col(else_))

    out = spans
    for side, (mine, kept) in enumerate(((("doc_id", "start"), ("kept_doc_id", "kept_start")), (("doc_id", "end"), ("last_doc_id", "last_end")))):
        out = out.join(words(side, f"mine{side}", *mine), list(mine), "left").join(words(side, f"kept{side}", *kept), list(kept), "left")
    # in one document neither copy grows into the other
    back = F.when(same, F.least(many("mine0", "kept0"), F.size(F.filter(F.col("mine0")["to"], lambda x: x >= F.col("kept_end"))))).otherwise(many("mine0", "kept0"))
    on = F.when(F.col("doc_id") == F.col("last_doc_id"), F.least(many("mine1", "kept1"), F.size(F.filter(F.col("kept1")["to"], lambda x: x <= F.col("start"))))).otherwise(many("mine1", "kept1"))
    out = out.withColumn("back", back).withColumn("on", on)
    out = out.where(F.coalesce(F.col("mine1")["w"] - F.col("mine0")["w"] + 1 + F.col("back") + F.col("on") >= least, F.lit(True)))
    return out.select("doc_id", edge(F.col("mine0"), F.col("back"), "start").alias("start"), edge(F.col("mine1"), F.col("on"), "end").alias("end"), "kept_doc_id", edge(F.col("kept0"), F.col("back"), "kept_start").alias("kept_start"))


def duplicate_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, start, end, kept_doc_id, kept_start: the spans to remove, in code points, and where what they repeat stays.

    least: words of a span that is removed; under ``MIN_WORDS`` it changes nothing.
    """
    util.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    rows = _named(rows, _ambiguous(rows))
    units = rows.mapInArrow(_units(None), _UNITS)
    firsts = units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "start", "end")).alias("first"))
    firsts = util.written(firsts.where("n > 1").select("d1", "d2", "first"), "repeats")
    bitmap = util.bitmap(firsts, "d1")
    again = rows.mapInArrow(_units(bitmap), _UNITS).join(firsts, ["d1", "d2"])
    gone = again.where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
    gone = gone.groupBy("doc_id", "start").agg(F.max(F.struct("end", "first")).alias("m")).select("doc_id", "start", "m.end", "m.first")
    # overlapping windows of a document become one span
    spans = _numbered(gone).groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("first", "start").alias("first"), F.max_by("first", "end").alias("last"))
    spans = util.written(spans.select("doc_id", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start"), F.col("first.end").alias("kept_end"), F.col("last.doc_id").alias("last_doc_id"), F.col("last.end").alias("last_end")), "spans")
    spans = _numbered(_grown(rows, spans, least)).groupBy("doc_id", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by(F.struct("kept_doc_id", "kept_start"), "start").alias("k"))
    return spans.select("doc_id", "start", "end", "k.kept_doc_id", "k.kept_start")


def _ambiguous(rows: DataFrame) -> DataFrame:
    """id, v: ids of several texts, with the text (the hash of it) that the id names."""
    v = rows.select("doc_id", F.xxhash64("text").alias("v")).groupBy("doc_id").agg(F.min("v").alias("v"), F.max("v").alias("most"))
    return util.written(v.where("v <> most").select(F.col("doc_id").alias("id"), "v"), "ambiguous")


def _named(rows: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """The rows whose text is the one that their id names."""
    if ambiguous.isEmpty():
        return rows
    out = rows.join(ambiguous, F.col("doc_id") == F.col("id"), "left")
    return out.where(F.col("v").isNull() | (F.xxhash64("text") == F.col("v"))).select(*rows.columns)


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the spans cut out of their texts; all else as it was, also other texts under an id of several."""
    key, cut, v = (util.fresh(c, docs) for c in ("_id", "_cut", "_v"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    by_id = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut))
    ambiguous = _ambiguous(rows)
    by_id = by_id.join(ambiguous, by_id["doc_id"] == ambiguous["id"], "left").select(F.col("doc_id").alias(key), cut, F.col("v").alias(v))
    out = docs.join(by_id, (docs[doc_id].cast("long") == by_id[key]) & (by_id[v].isNull() | (F.xxhash64(docs[text]) == by_id[v])), "left")
    t, at = docs[text], by_id[cut]
    # what stays lies between the spans
    ends = F.concat(F.array(F.lit(0)), F.transform(at, lambda c: c["end"]))
    starts = F.concat(F.transform(at, lambda c: c["start"]), F.array(F.length(t)))
    kept = F.array_join(F.zip_with(ends, starts, lambda a, z: F.substring(t, a + 1, z - a)), "")
    return out.select(*[F.when(at.isNull(), t).otherwise(kept).alias(c) if c == text else docs[c] for c in docs.columns])
