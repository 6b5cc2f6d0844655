"""SimHash near duplicates by pigeonhole blocks (operator 11).

A text's fingerprint has a bit set where over half of its 3-word shingles, repeats included, have it
set in their XXH64 (seed 42). Two fingerprints link when three bits or fewer differ:

1. Equal fingerprints are one class; copies are never paired.
2. The 64 bits are cut into ``n`` blocks. Three differing bits spoil three blocks at most, so a close
   pair agrees in some n - 3 of them: each class is dealt out once for every choice of n - 3 blocks,
   keyed by the bits in these. More classes take more blocks, so that keys stay longer than the
   logarithm of their number and a bucket stays small.
3. In a bucket the fingerprints are verified by the bits in which they differ. What leaves it is a
   star for each group found connected there, not its pairs.
4. A bucket of more than ``HOT`` classes is not compared in one task. Its members are dealt out by the
   65 points that are one bit away or none: all that meet at a point are two bits apart at most, so they
   are linked by a star (65 at most). Of the members outside the largest part so connected, the points
   two bits away meet the others' points one bit away, which finds each pair three bits apart. Rows
   grow in proportion to the members.
5. Links found give the components of the classes.

Defined cases: a null, empty or wordless text has the fingerprint zero and links like any other; a
text of fewer than three words has one shingle; a document without an id takes part and shows its
component, but can't name one (a component without any id is null); repeated rows are copies; other
columns, whatever their names, are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import util

WORDS = 3
SEED = 42
#: Bits that may differ.
FAR = 3
#: Classes in a bucket that one task compares.
HOT = 2048
#: Classes that a bucket would have if bits were even.
EVEN = 64
_BLOCK = 1 << 16
_PAIRS = 1 << 20


def _spaced(c: K.Chunk) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case words with one blank between those of a text; where each starts and ends, and each text's first."""
    start, end, first = c.words()
    keep = ~K.SPACE[c.buf]
    buf = K.LOWER[c.buf]
    after = end[end < len(buf)]
    after = after[~keep[after]]
    buf[after] = 0x20
    keep[after] = True
    at = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return buf[keep].tobytes(), at[start], at[end], first


def _majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), _BLOCK):
        ones += np.unpackbits(h[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def chunk_fingerprints(c: K.Chunk) -> np.ndarray:
    text, start, end, first = _spaced(c)
    out = np.zeros(len(c), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i in range(len(c)):
        a, z = int(first[i]), int(first[i + 1])
        if z > a:
            n = max(z - a - WORDS + 1, 1)
            ends = end[a + WORDS - 1 : z] if z - a >= WORDS else end[z - 1 : z]
            out[i] = _majority(np.fromiter((digest(text[x:y], SEED) for x, y in zip(start[a : a + n].tolist(), ends.tolist(), strict=True)), np.uint64, n))
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = util.arrow_schema("doc_id bigint, fp bigint")
    for b in batches:
        found = [chunk_fingerprints(c) for c in K.chunks(b.column(1))]
        yield K.batch(schema, doc_id=b.column(0), fp=K.signed(np.concatenate(found)) if found else [])


def masks(n: int) -> list[int]:
    """The bits of every n - 3 of n blocks, as signed numbers."""
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (z - a)) - 1) << a for a, z in zip(edges, edges[1:], strict=False)]
    whole = [sum(pick) for pick in combinations(blocks, n - FAR)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def blocks_for(classes: int) -> int:
    """The fewest blocks whose keys leave ``EVEN`` classes in a bucket, if bits were even."""
    n = FAR + 1
    while n < 16 and classes > EVEN << (64 * (n - FAR) // n):
        n += 1
    return n


def _labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least index that each of n can reach over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new


def _close(fp: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Of rows in runs of equal groups: for each the first row that links within its run connect it to."""
    n = len(fp)
    last = np.searchsorted(group, group, side="right")
    held_a, held_b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    at, step = np.arange(n), 1
    while len(at := at[at + step < last[at]]):
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= FAR]
        held_a.append(near)
        held_b.append(near + step)
        held += len(near)
        if held > _PAIRS:  # connected so far is a star each, fewer rows than there are fingerprints
            label = _labels(np.concatenate(held_a), np.concatenate(held_b), n)
            held_a, held_b, held = [np.arange(n)], [label], 0
        step += 1
    return _labels(np.concatenate(held_a), np.concatenate(held_b), n)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows choice, key, fp sorted by (choice, key): stars of what is connected within a bucket. A bucket is held whole, ``HOT`` rows at most."""
    schema = util.arrow_schema("a bigint, b bigint")
    rest = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def links(choice, key, fp) -> pa.RecordBatch:
        new = np.ones(len(fp), bool)
        new[1:] = (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])
        head = _close(fp.view(np.uint64), np.cumsum(new))
        far = head != np.arange(len(fp))
        return K.batch(schema, a=fp[head[far]], b=fp[far])

    for b in batches:
        columns = [np.concatenate([r, b.column(i).to_numpy()]) for i, r in enumerate(rest)]
        choice, key, _ = columns
        if not len(key):
            continue
        cut = int(np.flatnonzero((choice != choice[-1]) | (key != key[-1]))[-1]) + 1 if (choice[0], key[0]) != (choice[-1], key[-1]) else 0
        if cut:
            yield links(*(x[:cut] for x in columns))
        rest = [x[cut:] for x in columns]
        K.trim()
    yield links(*rest)


_NEAR = "explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i))))"
_TWO_OFF = "explode(flatten(transform(sequence(1, 63), i -> transform(sequence(0, i - 1), j -> fp ^ shiftleft(1L, i) ^ shiftleft(1L, j)))))"


def _hot_links(members: DataFrame) -> DataFrame:
    """a, b: links that connect all linked fingerprints of the buckets in members (choice, key, fp)."""
    fps = members.select("fp").distinct()
    points = util.written(fps.select(F.expr(_NEAR).alias("point"), "fp"), "points")
    # a point has 65 fingerprints around it at most
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all"))
    stars = util.written(met.where(F.size("all") > 1).select("a", F.explode("all").alias("b")).where("a <> b").distinct(), "stars")
    part = util.components(stars, "a", "b").select(F.col("node").alias("_fp"), F.col("component").alias("part"))
    parts = util.written(members.join(part, F.col("fp") == F.col("_fp"), "left").select("choice", "key", "fp", F.coalesce("part", "fp").alias("part")), "parts")
    main = parts.groupBy("choice", "key", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("choice", "key").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    outside = parts.join(main, ["choice", "key"]).where("part <> main").select("fp").distinct()
    one = points.groupBy("point").agg(F.min("fp").alias("a"))
    three = outside.select(F.expr(_TWO_OFF).alias("point"), F.col("fp").alias("b")).join(one, "point").select("a", "b")
    return stars.unionByName(three.where("a <> b").distinct())


def class_links(classes: DataFrame) -> DataFrame:
    """a, b: links that connect all linked fingerprints of classes (written rows, one a fingerprint)."""
    total = classes.count()
    choices = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(blocks_for(total)))]
    keys = classes.select(F.explode(F.array(*choices)).alias("k"), "fp").select("k.choice", "k.key", "fp")
    hot = util.written(keys.groupBy("choice", "key").count().where(F.col("count") > HOT).select("choice", "key"), "hot")
    some = hot.count()
    if some:
        small = F.broadcast(hot) if some <= 500_000 else hot
        cold = keys.join(small, ["choice", "key"], "left_anti")
    else:
        cold = keys
    links = cold.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(_verify, "a bigint, b bigint")
    if some:
        links = links.unionByName(_hot_links(util.written(keys.join(small, ["choice", "key"], "left_semi"), "members")))
    return links.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row for each row of docs."""
    util.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = util.written(rows.mapInArrow(_fingerprints, "doc_id bigint, fp bigint"), "fingerprints")
    classes = util.written(members.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    linked = util.components(util.written(class_links(classes), "links"), "a", "b").withColumnRenamed("node", "fp")
    label = util.written(classes.join(linked, "fp", "left"), "labels")
    least = label.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    # classes of one document that link with nothing need no lookup
    named = label.where("component IS NOT NULL").join(least, "component").select("fp", "component_id")
    named = named.union(label.where("component IS NULL AND copies > 1").select("fp", "least"))
    out = members.join(util.written(named, "named"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
