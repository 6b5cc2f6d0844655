"""Benchmark decontamination by spaced seeds (operator 5).

Fixed masks over 12 consecutive tokens ignore some positions, so a window's hash survives a
substitution there. Hashes of the test set are looked up in the hashes of every document; each hit
fixes an alignment of document and item, and around it the segment that gains most (a matching
token counts 1, another -4) is verified: ``MIN_MATCH`` matching tokens, or the whole of a shorter
item, of which at least four in five of the segment match.

The test set is taken in blocks of bounded size (``BLOCK_WORDS``), each sent to the workers and
held against all documents; a larger test set means more passes, not more memory.

Tokens are runs of ASCII letters and digits and of non-ASCII characters, ASCII letters lower-cased.
Defined cases: a null text has no tokens; an item of fewer than ``MIN_ITEM`` tokens is no evidence
and is not searched; items with equal tokens are one, named by the smallest id (a null id comes
last); repeated documents are each reported; empty tables give no pairs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import util

#: 1: the position counts. Eight of twelve; no two masks share a pattern of shifts.
MASKS = ("111010011011", "110100110111", "101111001101")
SPAN = 12
MIN_MATCH = 12
MIN_ITEM = 5
MISMATCH = -4
BLOCK_WORDS = 500_000
_BITS = 22
_PAIRS = "doc_id bigint, item_id bigint, n_match int, n_tokens int, start int, end int"


def token_hashes(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    start, end, first = c.words(K.NOT_ALNUM)
    return K.Hasher(K.LOWER[c.buf]).ranges(start, end), start, end, first


def seed_hashes(h: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of each window of a mask inside one row."""
    span = len(mask)
    count = np.maximum(np.diff(first) - span + 1, 0)
    begin = np.cumsum(count) - count
    at = np.repeat(first[:-1] - begin, count) + np.arange(int(count.sum()))
    acc = np.full(len(at), hash_of(mask), np.uint64)
    for j, (keep, w) in enumerate(zip(mask, K.weights(span), strict=True)):
        if keep == "1":
            acc += h[at + j] * w
    return K.mix(acc), at


def hash_of(mask: str) -> int:
    return int(mask, 2) * 0x9E3779B97F4A7C15 % (1 << 64)


class TestSet:
    """Items of one block, their seeds sorted by hash, and a bitmap of hashes."""

    __test__ = False

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.items: list[np.ndarray] = []
        self.ids: list[int | None] = []
        seen: dict[bytes, int] = {}
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        for c in K.chunks(pa.array([texts[i] for i in order], pa.large_string())):
            h, _, _, first = token_hashes(c)
            for r, a, b in zip(c.rows.tolist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if b - a >= MIN_ITEM and h[a:b].tobytes() not in seen:
                    seen[h[a:b].tobytes()] = len(self.items)
                    self.items.append(h[a:b].copy())
                    self.ids.append(ids[order[r]])
        self.masks = list(MASKS) + ["1" * n for n in sorted({len(x) for x in self.items if len(x) < SPAN})]
        seeds, who, pos = [], [], []
        for m in self.masks:
            for i, x in enumerate(self.items):
                if (len(x) >= SPAN) == (m in MASKS) and (m in MASKS or len(m) == len(x)):
                    s, at = seed_hashes(x, np.array([0, len(x)]), m)
                    seeds.append(s)
                    pos.append(at)
                    who.append(np.full(len(s), i))
        s = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        by = np.argsort(s, kind="stable")
        self.seeds = s[by]
        self.who = (np.concatenate(who) if who else np.zeros(0, np.int64))[by].astype(np.int32)
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, np.int64))[by].astype(np.int32)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def overlaps(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """row, item, matching tokens, tokens, start, end in code points: the best overlap of each row and item."""
        for c in K.chunks(column):
            h, start, end, first = token_hashes(c)
            hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
            for m in self.masks:
                s, at = seed_hashes(h, first, m)
                near = np.flatnonzero(self.bitmap[(s >> np.uint64(64 - _BITS)).astype(np.int64)])
                lo = np.searchsorted(self.seeds, s[near])
                hi = np.searchsorted(self.seeds, s[near], side="right")
                for i, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    row = int(np.searchsorted(first, at[i], side="right")) - 1
                    hits[row].update((int(self.who[k]), int(at[i]) - int(self.pos[k])) for k in range(a, b))
            if not hits:
                continue
            points = c.code_points()
            for row, aligned in sorted(hits.items()):
                best: dict[int, tuple] = {}
                for item, shift in sorted(aligned):
                    found = self._verify(self.items[item], h, shift, int(first[row]), int(first[row + 1]))
                    if found and found[0] > best.get(item, (0,))[0]:
                        best[item] = found
                base = points[c.off[row]]
                for item, (match, a, b) in sorted(best.items()):
                    yield int(c.rows[row]), item, match, b - a, int(points[start[a]] - base), int(points[end[b - 1]] - base)

    @staticmethod
    def _verify(item: np.ndarray, h: np.ndarray, shift: int, lo: int, hi: int) -> tuple[int, int, int] | None:
        a, b = max(lo, shift), min(hi, shift + len(item))
        same = h[a:b] == item[a - shift : b - shift]
        gain = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
        rise = gain - np.minimum.accumulate(gain)
        to = int(rise.argmax())
        since = int(np.flatnonzero(gain[: to + 1] == gain[: to + 1].min())[-1])
        match = int(np.count_nonzero(same[since:to]))
        return (match, a + since, a + to) if match >= min(MIN_MATCH, len(item)) else None


def test_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[TestSet]:
    """The test set in blocks of about BLOCK_WORDS words; an empty one gives one empty block."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    words = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-words // (6 * BLOCK_WORDS)))
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b).toArrow()
        yield TestSet(block["i"].to_pylist(), block["t"].to_pylist())


def _pairs(test: TestSet):
    schema = util.arrow_schema(_PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            rows = [(ids[r].as_py(), test.ids[i], *rest) for r, i, *rest in test.overlaps(b.column(1))]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_match, n_tokens, start, end (code points): each document with each item that it overlaps."""
    util.ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for test in test_blocks(benchmark):
        part = rows.mapInArrow(_pairs(test), _PAIRS)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs without any overlap, with all their columns."""
    util.ship(docs.sparkSession)
    at = docs.columns.index(text)

    def without(test: TestSet):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                free = np.ones(len(b), bool)
                free[[r for r, *_ in test.overlaps(b.column(at))]] = False
                yield b.filter(pa.array(free))

        return run

    for test in test_blocks(benchmark):
        docs = docs.mapInArrow(without(test), docs.schema)
    return docs
