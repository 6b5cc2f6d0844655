"""Packing by cutting-stock column generation (operator 3).

A document's ids fill whole sequences as often as they can; what is left over (shorter than a
sequence) is an item. The histogram of item lengths, in classes of ``UNIT`` ids and so of a fixed
size, is a cutting-stock problem: its linear program is solved by column generation, where an
unbounded-knapsack dynamic program prices new patterns. The patterns' counts are rounded down and
assigned to the items by their rank within their class, by arithmetic on a table of patterns. The
few items that rounding leaves (their number depends on the classes, not on the input) stand one
after another and are cut where a sequence is full, so only the last sequence has much padding.

Ranks are counted within each input part and shifted by the parts before it: no class, however
common, is ordered in one task.

Defined cases: a null text is empty and has the end id alone; null and repeated ids are packed
like any row; an empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encode, util

LENGTH = 2048
UNIT = 4
END = 1
_ROWS = 256


def greedy_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis: patterns that take the longest lengths with demand left, each until it uses one up.

    The pattern that uses a length up stands in that length's row, so the basis is triangular; a
    length that ends together with another gets the pattern of its own copies, unused.
    """
    m = len(lengths)
    patterns, x = np.diag(capacity // lengths), np.zeros(m)
    left, alive = demand.astype(float).copy(), list(np.argsort(lengths))
    while alive:
        sizes = lengths[alive]
        column, room = np.zeros(m, np.int64), capacity
        while (k := int(np.searchsorted(sizes, room, side="right"))) > 0:
            i = alive[k - 1]
            copies = int(min(room // lengths[i], max(1, left[i] // 1)))
            column[i] += copies
            room -= copies * lengths[i]
            if copies < room // lengths[i] + copies and room >= lengths[i]:
                sizes = sizes[: k - 1]  # no more of it than there is demand
        used = np.flatnonzero(column)
        times = left[used] / column[used]
        j = used[int(times.argmin())]
        x[j], patterns[j] = times.min(), column
        left[used] -= times.min() * column[used]
        left[j] = 0
        alive = [i for i in alive if left[i] > 1e-9]
    return patterns, x


def inverse_of(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan in plain numpy: the driver's process may have forked since its linear algebra library made its threads, which then never answer."""
    n = len(a)
    both = np.hstack([a, np.eye(n)])
    for i in range(n):
        p = i + int(np.abs(both[i:, i]).argmax())
        both[[i, p]] = both[[p, i]]
        both[i] /= both[i, i]
        rest = np.flatnonzero(both[:, i])
        rest = rest[rest != i]
        both[rest] -= np.outer(both[rest, i], both[i])
    return both[:, n:]


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a row, counts by length) and how often the linear program uses each.

    A revised simplex over the restricted master problem: its basis always meets the demand
    exactly. It ends when no pattern prices in, within ``gap`` of a lower bound (the duals' or
    the lengths' sum), or after ``rounds`` patterns; any basis gives a right packing.
    """
    m = len(lengths)
    patterns, x = greedy_basis(lengths, demand, capacity)
    inverse = inverse_of(patterns.T.astype(float))
    least = float((lengths * demand).sum()) / capacity
    order = np.argsort(lengths)
    sizes = lengths[order]
    for _ in range(rounds if m else 0):
        price = inverse.sum(axis=0)
        by = price[order]
        value, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            value[c] = value[c - 1]
            k = np.searchsorted(sizes, c, side="right")
            if k:
                gain = value[c - sizes[:k]] + by[:k]
                best = int(gain.argmax())
                if gain[best] > value[c] + 1e-12:
                    value[c], pick[c] = gain[best], best
        if value[capacity] <= 1 + 1e-7 or x.sum() <= (1 + gap) * max(least, x.sum() / value[capacity]):
            break
        column, c = np.zeros(m, np.int64), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[order[pick[c]]] += 1
                c -= sizes[pick[c]]
        step = (inverse * column).sum(axis=1)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        theta = ratio[r]
        x = np.maximum(x - theta * step, 0)
        x[r] = theta
        inverse[r] /= step[r]
        others = np.arange(m) != r
        inverse[others] -= np.outer(step[others], inverse[r])
        patterns[r] = column
    return patterns, x


def cut_stream(sizes: list[int], may_cut: list[bool], capacity: int) -> list[list[tuple[int, int]]]:
    """For each item its pieces (sequence, length): items one after another, cut where a sequence is full."""
    out: list[list[tuple[int, int]]] = []
    bin_, room = 0, capacity
    for size, cut in zip(sizes, may_cut, strict=True):
        if size <= room:
            out.append([(bin_, size)])
        elif cut and room:
            out.append([(bin_, room), (bin_ + 1, size - room)])
            bin_, room = bin_ + 1, capacity + room
        else:
            out.append([(bin_ + 1, size)])
            bin_, room = bin_ + 1, capacity
        room -= size
    return out


def _cut_crcs(wanted: dict[tuple[int, int, int], set[int]], tokenizer: str, end: int, length: int):
    """Checksums of both pieces of the cut leftovers; wanted: (doc_id, n, crc) of a leftover to where it, or a row that repeats it, is cut."""
    schema = util.arrow_schema("doc_id bigint, n bigint, crc bigint, cut bigint, first bigint, second bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encode.encoder(tokenizer)
        for b in batches:
            values, off = enc.encode(b.column(1), end)
            view, rows = memoryview(values).cast("B"), []
            for d, lo, hi in zip(b.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                n, lo = hi - lo, hi - (hi - lo) % length
                crc = encode.crc(view[4 * lo : 4 * hi])
                for at in wanted.get((d, n, crc), ()):
                    rows.append((d, n, crc, at, encode.crc(view[4 * lo : 4 * (lo + at)]), encode.crc(view[4 * (lo + at) : 4 * hi])))
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


_ITEMS = "part int, doc_id bigint, n bigint, class int, rank bigint, whole_before bigint, crcs array<bigint>"


def _tokenise(tokenizer: str, end: int, length: int, unit: int):
    schema = util.arrow_schema(_ITEMS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encode.encoder(tokenizer), TaskContext.get().partitionId()
        ranks, whole = np.zeros(length // unit + 1, np.int64), 0
        for full in batches:
            for lo in range(0, len(full), _ROWS):
                b = full.slice(lo, _ROWS)
                cols: dict[str, list] = {k: [] for k in ("n", "class", "rank", "whole_before", "crcs")}
                values, off = enc.encode(b.column(1), end)
                bytes_of = memoryview(values).cast("B")
                for lo_id, hi_id in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n, view = hi_id - lo_id, bytes_of[4 * lo_id : 4 * hi_id]
                    k = -(-(n % length) // unit)
                    for name, v in (("n", n), ("class", k), ("rank", int(ranks[k])), ("whole_before", whole), ("crcs", [encode.crc(view[4 * i : 4 * (i + length)]) for i in range(0, n, length)])):
                        cols[name].append(v)
                    ranks[k] += 1
                    whole += n // length
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part, np.int32)), b.column(0), *(pa.array(v, schema.field(k).type) for k, v in cols.items())], schema=schema)

    return run


class Slots:
    """Where the rounded patterns put the items: for each class, runs of ranks by pattern."""

    def __init__(self, lengths: np.ndarray, patterns: np.ndarray, times: np.ndarray):
        use = np.flatnonzero(times)
        self.sequences = int(times.sum())
        base = np.concatenate([[0], np.cumsum(times[use])])
        self.by_class: dict[int, tuple[np.ndarray, ...]] = {}
        self.taken = np.zeros(int(lengths.max(initial=0)) + 1, np.int64)
        for j, size in enumerate(lengths):
            has = [(p, k) for p, k in enumerate(use) if patterns[k, j]]
            copies = np.array([patterns[k, j] for _, k in has], np.int64)
            ends = np.cumsum(copies * np.array([times[k] for _, k in has], np.int64))
            slot = np.array([patterns[k, :j].sum() for _, k in has], np.int64)
            self.by_class[int(size)] = (ends, copies, base[[p for p, _ in has]], slot)
            self.taken[size] = ends[-1] if len(ends) else 0


def _place(slots: Slots, length: int, first_pattern: int):
    schema = util.arrow_schema("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                n, d = r["n"], r["doc_id"]
                for i in range(n // length):
                    rows.append((d, i * length, length, r["crcs"][i], n, r["whole"] + i, 0))
                k = r["class"]
                if k and r["rank"] < slots.taken[k]:
                    ends, copies, base, slot = slots.by_class[k]
                    p = int(np.searchsorted(ends, r["rank"], side="right"))
                    at = r["rank"] - (int(ends[p - 1]) if p else 0)
                    rows.append((d, n - n % length, n % length, r["crcs"][-1], n, first_pattern + int(base[p]) + at // int(copies[p]), int(slot[p]) + at % int(copies[p])))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = encode.DEFAULT, end: int = END, length: int = LENGTH, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece."""
    spark = docs.sparkSession
    util.ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    items = util.written(rows.mapInArrow(_tokenise(tokenizer, end, length, unit), _ITEMS), "items")

    # at most length / unit rows, whatever the input
    histogram = {r["class"]: r["count"] for r in items.where("class > 0").groupBy("class").count().collect()}
    classes = np.array(sorted(histogram), np.int64)
    patterns, x = solve(classes, np.array([histogram[c] for c in classes.tolist()], float), length // unit)
    slots = Slots(classes, patterns, np.floor(x + 1e-9).astype(np.int64))

    # ranks over all parts: one row for each part and class, then for each part
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_class = items.groupBy("part", "class").agg(F.count(F.lit(1)).alias("c"))
    by_class = by_class.select("part", "class", F.coalesce(F.sum("c").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"))
    whole = F.floor(F.col("n") / length)
    by_part = items.groupBy("part").agg(F.sum(whole).alias("w"))
    by_part = by_part.select("part", F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("whole_parts"))
    n_whole = items.agg(F.sum(whole)).first()[0] or 0
    before = util.written(by_class.join(by_part, "part"), "ranks")
    ranked = items.join(before, ["part", "class"]).select("doc_id", "n", "class", (F.col("rank_before") + F.col("rank")).alias("rank"), (F.col("whole_parts") + F.col("whole_before")).alias("whole"), "crcs")

    placed = ranked.mapInArrow(_place(slots, length, n_whole), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint")
    in_order = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(in_order), F.lit(0))).drop("slot")

    # what rounding left: at most a sequence for each class
    taken = {int(c): int(slots.taken[c]) for c in classes}
    limit = F.create_map(*[F.lit(v) for kv in taken.items() for v in kv]) if taken else F.create_map(F.lit(0), F.lit(0))
    rest = ranked.where((F.col("class") > 0) & (F.col("rank") >= limit[F.col("class")])).select("doc_id", "n", F.element_at("crcs", -1).alias("crc"), "class", "rank").orderBy("class", "rank").toArrow()
    doc, n, crc = (rest[c].to_pylist() for c in ("doc_id", "n", "crc"))
    pieces = cut_stream([v % length for v in n], [d is not None for d in doc], length)
    wanted: dict[tuple[int, int, int], set[int]] = {}
    for d, t, c, p in zip(doc, n, crc, pieces, strict=True):
        if len(p) == 2:
            wanted.setdefault((d, t, c), set()).add(p[0][1])
    crcs: dict[tuple, tuple[int, int]] = {}
    if wanted:  # a document for each of those sequences at most
        some = rows.where(F.col("doc_id").isin(sorted({d for d, *_ in wanted})))
        found = some.mapInArrow(_cut_crcs(wanted, tokenizer, end, length), "doc_id bigint, n bigint, crc bigint, cut bigint, first bigint, second bigint").distinct()
        crcs = {(r["doc_id"], r["n"], r["crc"], r["cut"]): (r["first"], r["second"]) for r in found.collect()}
    used: dict[int, int] = {}
    tail = []
    for d, t, c, parts in zip(doc, n, crc, pieces, strict=True):
        at = t - t % length
        for (bin_, size), checksum in zip(parts, crcs[d, t, c, parts[0][1]] if len(parts) == 2 else (c,), strict=True):
            tail.append((d, at, size, checksum, t, n_whole + slots.sequences + bin_, used.get(bin_, 0)))
            used[bin_] = used.get(bin_, 0) + size
            at += size
    schema = util.struct("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return placed.unionByName(spark.createDataFrame(tail, schema))


def materialise(docs: DataFrame, pieces: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = encode.DEFAULT, end: int = END, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, ids, n_ids: the packed sequences, padded to length unless n_ids is a power of two. Ids of documents must be unique."""
    from .tokenio import _tokenise as tokens

    util.ship(docs.sparkSession)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(tokens(tokenizer, end), "doc_id bigint, part int, at bigint, n_tokens bigint, ids array<int>")
    cut = pieces.join(ids.select("doc_id", "ids"), "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    # a group is one sequence: never more than length ids
    seq = cut.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    fill = F.when(n.bitwiseAND(n - 1) == 0, F.lit(0)).otherwise(length - n)
    return seq.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(pad), fill)).alias("ids"), n.alias("n_ids"))
