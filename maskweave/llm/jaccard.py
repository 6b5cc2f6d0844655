"""N-gram Jaccard join by prefix trees (operator 2).

Two documents link when 100 * |A & B| >= 75 * |A | B| over their sets of distinct 5-word
shingles. The result is exact for any size and any skew (sets are held as 64-bit hashes):

1. Equal sets are one class, named by a hash of the set; copies are never paired.
2. One global order of all shingles: rare ones first. The most frequent shingles (a table of
   fixed size, found by counting within each task and summing) go last by count; the order of
   all others is that of their hashes. Any order gives right results; this one keeps a passage
   that many documents share out of the prefixes.
3. A set's prefix is long enough that two linked sets share at least ``l`` prefix shingles
   (l grows with the set). Prefix rows meet by shingle; a set with too few shared ones has no
   partner and goes. What is left is connected by stars and gives candidate components. One of more than
   ``WIDE`` shingles holds together by chance, mostly: there the shared ones are counted for each pair.
4. Inside a component the globally ordered sets stand in a compressed trie. Each set walks it
   once, sharing overlaps of common paths; a subtree is left when its sizes don't fit, when the
   shingles left on either side can't reach the needed overlap, or when all below it is already
   connected to the set. A larger component is dealt into blocks, each set into one, and a few
   pivots into all; copies of one text are then connected, and nothing in the component is left to
   compare. Where something is, the sets outside its largest connected part meet all blocks, and
   that part is never compared with itself.
5. Links found give the components of the classes.

Defined cases: a null or wordless text has an empty set, links with nothing and is its own
component; a document without an id takes part and shows its component, but can't name one (a
component without any id is null); repeated rows are copies; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from . import util

WORDS = 5
#: Size of the table of frequent shingles: 16 bytes each, whatever the input.
FREQUENT = 1 << 18
#: Shingles and sets in a block of a component, about.
BLOCK = 1 << 16
BLOCK_SETS = 128
#: Shingles in a block of what pivots have not connected.
WIDE = 2_000_000
#: Sets that hold a shingle from which their pairs are not counted one by one.
HUB = 32
#: Sets of a component that meet all its blocks first.
PIVOTS = 8
#: Bytes of prefix rows and sets that one task sorts, about.
TASK_BYTES = 64 << 20
#: Rows of a few numbers that may be broadcast, some 10 MB in the driver; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Two linked sets of n shingles share 1 + n // SHARED of their prefixes.
SHARED = 8
_COUNTED = 1_500_000


def set_hash(s: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(s.tobytes())
    return h - (1 << 64) if h >> 63 else h


def shingle_sets(c: K.Chunk, k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = K.LOWER[c.buf]
    start, end, first = c.words()
    words = K.Hasher(buf).ranges(start, end)
    h, _, bounds = K.windows(words, first, k)
    out = []
    for i in range(len(c)):
        n = first[i + 1] - first[i]
        if n >= k:
            out.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif n:
            out.append(K.windows(words[first[i] : first[i + 1]], np.array([0, n]), int(n), salt=1000 * int(n))[0])
        else:
            out.append(h[:0])
    return out


def shared(n):
    """Prefix shingles that two linked sets of n and more share at least."""
    return 1 + n // SHARED


def needed(n):
    """The fewest shared prefix shingles of a set of n with any partner."""
    return shared(-(-3 * n // 4))


def prefix_length(n):
    return np.minimum(n, n - (-(-3 * n // 4)) + shared(n))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = util.arrow_schema("doc_id bigint, n int, sig bigint")
    for b in batches:
        n, sig = [], []
        for c in K.chunks(b.column(1)):
            for s in shingle_sets(c):
                n.append(len(s))
                sig.append(set_hash(s) if len(s) else None)
        yield K.batch(schema, doc_id=b.column(0), n=n, sig=sig)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that three different sets or more hold, in every few million."""
    schema = util.arrow_schema("h bigint, c int")
    held: list[np.ndarray] = []
    seen: set[int] = set()
    size = 0

    def flush() -> pa.RecordBatch:
        h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
        held.clear()
        seen.clear()
        return K.batch(schema, h=K.signed(h[c >= 3]), c=c[c >= 3].astype(np.int32))

    for b in batches:
        for c in K.chunks(b.column(0)):
            for s in shingle_sets(c):
                if len(s) and (sig := set_hash(s)) not in seen:
                    seen.add(sig)
                    held.append(s)
                    size += len(s)
            if size > _COUNTED:
                yield flush()
                size = 0
    yield flush()


class Order:
    """The global order: position keys of shingles."""

    def __init__(self, h: np.ndarray, count: np.ndarray):
        at = np.argsort(h)
        self.h, self.rank = h[at], np.empty(len(h), np.int64)
        order = np.lexsort((self.h, count[at]))
        self.rank[order] = np.arange(1, len(h) + 1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.h, s), len(self.h) - 1)
        return np.where(self.h[at] == s, self.rank[at], 0)

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        """The first n of a sorted set."""
        key = self.keys(s)
        plain = s[key == 0]
        if len(plain) >= n:
            return plain[:n]
        often = s[key > 0]
        return np.concatenate([plain, often[np.argsort(key[key > 0])][: n - len(plain)]])


def _prefixes(order: Order):
    schema = util.arrow_schema("w bigint, sig bigint, n int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for c in K.chunks(b.column(0)):
                parts, sigs, sizes = [], [], []
                for s in shingle_sets(c):
                    if not len(s) or (sig := set_hash(s)) in seen:
                        continue
                    seen.add(sig)
                    parts.append(order.first(s, int(prefix_length(len(s)))))
                    sigs.append(sig)
                    sizes.append(len(s))
                if parts:
                    reps = [len(p) for p in parts]
                    yield K.batch(schema, w=K.signed(np.concatenate(parts)), sig=np.repeat(np.array(sigs, np.int64), reps), n=np.repeat(np.array(sizes, np.int32), reps))

    return run


def _arrays(b: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in names]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w, sig): those whose w stands with another sig as well, once each."""
    schema = util.arrow_schema("w bigint, sig bigint, n int")
    last: tuple | None = None  # the row before, and whether it has been met
    for b in batches:
        if not len(b):
            continue
        w, sig, n = _arrays(b, "w", "sig", "n")
        if last is not None:
            w, sig, n = (np.concatenate([[x], y]) for x, y in zip(last[:3], (w, sig, n), strict=True))
        was = last[3] if last is not None else False
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (sig[1:] != sig[:-1])
        w, sig, n = w[new], sig[new], n[new]
        same = w[1:] == w[:-1]
        met = np.zeros(len(w), bool)
        met[1:] |= same
        met[:-1] |= same
        met[0] |= was
        out = met.copy()
        out[-1] = False
        yield K.batch(schema, w=w[out], sig=sig[out], n=n[out].astype(np.int32))
        last = (w[-1], sig[-1], n[-1], bool(met[-1]))
        K.trim()
    if last is not None and last[3]:
        yield K.batch(schema, w=[last[0]], sig=[last[1]], n=[int(last[2])])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w, n): an edge from each to the first of its run of sizes that can link."""
    schema = util.arrow_schema("a bigint, b bigint")
    last: tuple | None = None  # w, first sig of the run, last size
    for b in batches:
        if not len(b):
            continue
        w, n, sig = _arrays(b, "w", "n", "sig")
        n = n.astype(np.int64)
        if last is not None:
            w, sig, n = np.concatenate([[last[0]], w]), np.concatenate([[last[1]], sig]), np.concatenate([[last[2]], n])
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (4 * n[:-1] < 3 * n[1:])
        head = sig[np.maximum.accumulate(np.where(new, np.arange(len(w)), 0))]
        edge = np.unique(np.stack([np.minimum(head, sig), np.maximum(head, sig)], 1)[head != sig], axis=0)
        yield K.batch(schema, a=np.ascontiguousarray(edge[:, 0]), b=np.ascontiguousarray(edge[:, 1]))
        last = (w[-1], head[-1], n[-1])
        K.trim()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by w: the pairs of sets of each w whose sizes can link (a, b, the smaller size); where more than ``HUB`` stand with it, each by itself (w, a)."""
    schema = util.arrow_schema("w bigint, a bigint, b bigint, n int")

    def hubs(w, sig, n) -> pa.RecordBatch:
        return K.batch(schema, w=w, a=sig, b=pa.nulls(len(w), pa.int64()), n=n.astype(np.int32))

    def pairs(w, sig, n) -> Iterator[pa.RecordBatch]:
        _, back, count = np.unique(w, return_inverse=True, return_counts=True)
        many = count[back] > HUB
        yield hubs(w[many], sig[many], n[many])
        w, sig, n = w[~many], sig[~many], n[~many]
        for d in range(1, HUB):
            if not (same := w[d:] == w[:-d]).any():
                break
            same &= (4 * n[d:] >= 3 * n[:-d]) & (4 * n[:-d] >= 3 * n[d:])
            x, y = sig[:-d][same], sig[d:][same]
            yield K.batch(schema, w=pa.nulls(len(x), pa.int64()), a=np.minimum(x, y), b=np.maximum(x, y), n=np.minimum(n[:-d], n[d:])[same].astype(np.int32))

    held, hub = [np.zeros(0, np.int64)] * 3, None  # rows of the last w; its name, if they are more than HUB
    for batch in batches:
        held = [np.concatenate(x) for x in zip(held, (x.astype(np.int64) for x in _arrays(batch, "w", "sig", "n")), strict=True)]
        if hub is not None:
            more = held[0] == hub
            yield hubs(*(x[more] for x in held))
            held = [x[~more] for x in held]
        if not len(held[0]):
            continue
        hub, last = None, held[0] == held[0][-1]
        yield from pairs(*(x[~last] for x in held))
        held = [x[last] for x in held]
        if len(held[0]) > HUB:
            hub = held[0][0]
            yield hubs(*held)
            held = [x[:0] for x in held]
        K.trim()
    yield from pairs(*held)


class _Node:
    __slots__ = ("edge", "kids", "least", "most", "deep", "ids", "one")

    def __init__(self, edge, size, deep, ids, one):
        self.edge, self.kids, self.least, self.most, self.deep, self.ids, self.one = edge, {}, size, size, deep, ids, one


class Trie:
    """Ordered sets of ranks, path-compressed, with bounds of each subtree.

    least, most: full sizes below; deep: the most ranks on a path from the node's start down;
    one: a member to which all below are connected, or -1.
    """

    def __init__(self, find):
        self.root, self.find = _Node(np.zeros(0, np.int64), 0, 0, [], -2), find
        self.root.least = 1 << 60

    def add(self, ranks: np.ndarray, size: int, who: int) -> None:
        node, at = self.root, 0
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.deep = max(node.deep, len(node.edge) + len(ranks) - at)
            if node.one == -2 or (node.one >= 0 and self.find(node.one) != self.find(who)):
                node.one = who if node.one == -2 else -1
            if at == len(ranks):
                node.ids.append((who, size))
                return
            kid = node.kids.get(int(ranks[at]))
            if kid is None:
                node.kids[int(ranks[at])] = _Node(ranks[at:], size, len(ranks) - at, [(who, size)], who)
                return
            rest = ranks[at : at + len(kid.edge)]
            differ = np.flatnonzero(kid.edge[: len(rest)] != rest)
            same = int(differ[0]) if len(differ) else len(rest)
            if same < len(kid.edge):
                top = _Node(kid.edge[:same], size, kid.deep, [], kid.one)
                top.least, top.most = kid.least, kid.most
                kid.edge, kid.deep = kid.edge[same:], kid.deep - same
                top.kids[int(kid.edge[0])] = kid
                node.kids[int(ranks[at])] = top
                kid = top
            node, at = kid, at + same

    def links(self, ranks: np.ndarray, size: int, who: int, mark: np.ndarray, join) -> None:
        """Calls join(member) for linked members until all are connected or the trie is done."""
        mark[ranks] = True
        total = len(ranks)
        stack = [(self.root, 0, 0)]  # node, overlap above it, ranks of the set that lie before it
        while stack:
            node, over, used = stack.pop()
            if 4 * node.most < 3 * size or 3 * node.least > 4 * size:
                continue
            if node.one >= 0 and self.find(node.one) == self.find(who):
                continue
            need = -(-3 * (size + max(node.least, -(-3 * size // 4))) // 7)
            if over + min(total - used, node.deep) < need:
                continue
            edge = node.edge
            if len(edge):
                over += int(np.count_nonzero(mark[edge]))
                used = int(np.searchsorted(ranks, edge[-1], side="right"))
                if over + min(total - used, node.deep - len(edge)) < need:
                    continue
            for other, n in node.ids:
                if 7 * over >= 3 * (size + n) and self.find(other) != self.find(who):
                    join(other)
            near = node.kids.get(int(ranks[used])) if used < total else None
            stack.extend((kid, over, used) for kid in node.kids.values() if kid is not near)
            if near is not None:
                stack.append((near, over, used))
        mark[ranks] = False


def trie_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all linked sets, by one walk of the trie for each set."""
    h, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, -count))] = np.arange(len(h))
    useful = count > 1  # what one set alone holds is in no overlap
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    trie, mark = Trie(find), np.zeros(len(h), bool)
    bounds = np.cumsum([0, *map(len, sets)])
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        at = back[bounds[i] : bounds[i + 1]]
        ranks = np.sort(rank[at[useful[at]]])

        def join(other: int, i: int = i) -> None:
            found.append((i, other))
            parent[find(i)] = find(other)

        trie.links(ranks, len(sets[i]), i, mark, join)
        trie.add(ranks, len(sets[i]), i)
    return found


def _set_rows(maps: tuple | None = None):
    """sig, s: the hash and the shingles of each set of texts.

    With a second column sig, rows whose set isn't the one named go: another row may have the same id. With bitmaps of hashed ids and of
    sigs, that column is the hash of the id, and rows that neither can be wanted nor have a wanted set go.
    """
    schema = util.arrow_schema("sig bigint, s binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, named = b.column(0), _arrays(b, b.schema.names[1])[0] if b.num_columns > 1 else None
            if maps is not None:
                some = util.may_hold(maps[0], named.view(np.uint64))
                text, named = text.filter(pa.array(some)), None
            sigs, sets, held, at = [], [], 0, 0
            for c in K.chunks(text):
                for s in shingle_sets(c):
                    sig = set_hash(s)
                    if len(s) and (named is None or sig == int(named[at])):
                        sigs.append(sig)
                        sets.append(s)
                        held += 8 * len(s)
                    at += 1
                if held > 8 << 20:
                    yield out(sigs, sets)
                    sigs, sets, held = [], [], 0
            if sigs:
                yield out(sigs, sets)

    def out(sigs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        ok = util.may_hold(maps[1], np.array(sigs, np.int64).view(np.uint64)) if maps is not None else np.ones(len(sigs), bool)
        return K.batch(schema, sig=[x for x, y in zip(sigs, ok, strict=True) if y], s=[x.tobytes() for x, y in zip(sets, ok, strict=True) if y])

    return run


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows comp, i, j, sig, s sorted by (comp, i, j): the links of each group."""
    schema = util.arrow_schema("a bigint, b bigint")
    key: tuple | None = None
    group: dict[int, np.ndarray] = {}
    out: list[tuple[int, int]] = []

    def close() -> None:
        if len(group) > 1:
            sigs = list(group)
            out.extend((sigs[a], sigs[b]) for a, b in trie_links(list(group.values())))
        group.clear()

    for b in batches:
        for comp, i, j, sig, s in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
            if (comp, i, j) != key:
                close()
                key = (comp, i, j)
            group[sig] = np.frombuffer(s, np.uint64)
        if out:
            yield K.batch(schema, a=[x for x, _ in out], b=[x for _, x in out])
            out.clear()
        K.trim()
    close()
    yield K.batch(schema, a=[x for x, _ in out], b=[x for _, x in out])


def frequent_order(texts: DataFrame) -> Order:
    counted = texts.mapInArrow(_frequent, "h bigint, c int").groupBy("h").agg(F.sum("c").alias("c")).where("c >= 16")
    top = counted.orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()  # a table of fixed size
    return Order(top["h"].to_numpy().view(np.uint64), top["c"].to_numpy())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs."""
    spark = docs.sparkSession
    util.ship(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    members = util.written(rows.mapInArrow(_members, "doc_id bigint, n int, sig bigint"), "members")
    classes = util.written(members.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    links = util.written(class_links(rows, classes), "links")
    linked = util.components(links, "a", "b")
    label = classes.join(linked.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "doc_id", "copies", F.coalesce("component", "sig").alias("label"), F.col("component").isNotNull().alias("joined"))
    label = util.written(label, "labels")
    least = _small(util.written(label.where("joined").groupBy("label").agg(F.min("doc_id").alias("least")), "least"))
    # classes of one document that link with nothing need no lookup
    named = label.where("joined").join(least, "label").select("sig", F.col("least").alias("component_id"))
    named = util.written(named.union(label.where("NOT joined AND copies > 1").select("sig", "doc_id")), "named")
    out = members.join(named, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _tasks(spark, bytes_: int) -> int:
    """Partitions that hold ``TASK_BYTES`` each, and as many as the session wants at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(bytes_) // TASK_BYTES))


def class_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b: links between set hashes that connect all linked classes."""
    spark = rows.sparkSession
    texts = rows.select("text")
    prefixes = texts.mapInArrow(_prefixes(frequent_order(texts)), "w bigint, sig bigint, n int")
    # prefixes are about a third of the shingles, 20 bytes each
    shingles = classes.agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("copies")), F.lit(0.0))).first()[0]
    n = _tasks(spark, 20 * shingles / 3)
    by_word = lambda d, *keys: d.repartition(n, "w").sortWithinPartitions("w", *keys)
    met, path = util.staged(by_word(prefixes, "sig").mapInArrow(_met, "w bigint, sig bigint, n int"), "met")
    enough = met.groupBy("sig", "n").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= 1 + F.floor(F.ceil(F.col("n") * 3 / 4) / SHARED)).select("sig")
    left = met.join(enough, "sig")
    stars = by_word(left.select("w", "n", "sig"), "n", "sig").mapInArrow(_stars, "a bigint, b bigint").distinct()
    comps = util.components(stars, "a", "b").select(F.col("node").alias("sig"), F.col("component").alias("comp"))
    cand = util.written(comps.join(classes.select("sig", "doc_id", F.col("n").cast("long").alias("n")), "sig"), "candidates")
    cand = _parted(cand, left, by_word)
    util.delete(spark, path)
    total = cand.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _links_of(rows, cand, _tasks(spark, 8 * total))


def _parted(cand: DataFrame, left: DataFrame, by_word) -> DataFrame:
    """cand with components of over ``WIDE`` shingles taken apart, so that sets hold together by pairs that share enough, not by chance.

    Two linked sets share as many prefix shingles as the smaller one's size asks for. They are counted for each pair, but for those that over ``HUB``
    sets hold: of these a pair is taken to share as many as either set has, and sets that may link by them alone stay together.
    """
    giant = util.written(cand.groupBy("comp").agg(F.sum("n").alias("all")).where(F.col("all") > WIDE).select("comp"), "giant")
    if giant.isEmpty():
        return cand
    mine = util.written(cand.join(_small(giant), "comp").select("sig", "doc_id", "n"), "mine")
    found, path = util.staged(by_word(left.join(_small(mine.select("sig")), "sig").select("w", "sig", "n")).mapInArrow(_pairs, "w bigint, a bigint, b bigint, n int"), "pairs")
    hubs = found.where("b IS NULL")
    held = util.written(hubs.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n")), "held")
    alone = held.where(F.col("c") >= 1 + F.floor(F.ceil(F.col("n") * 3 / 4) / SHARED)).select("a")
    stars = by_word(hubs.join(_small(alone), "a").select("w", "n", F.col("a").alias("sig")), "n", "sig").mapInArrow(_stars, "a bigint, b bigint")
    counted = found.where("b IS NOT NULL").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    for end in ("a", "b"):
        counted = counted.join(_small(held.select(F.col("a").alias(end), F.col("c").alias(f"c_{end}"))), end, "left")
    alike = F.col("c") + F.least(F.coalesce("c_a", F.lit(0)), F.coalesce("c_b", F.lit(0))) >= 1 + F.floor(F.col("n") / SHARED)
    comps = util.components(counted.where(alike).select("a", "b").unionByName(stars), "a", "b").select(F.col("node").alias("sig"), F.col("component").alias("comp"))
    apart = cand.join(_small(giant), "comp", "left_anti").unionByName(mine.join(comps, "sig"), allowMissingColumns=False)
    out = util.written(apart, "apart")
    util.delete(cand.sparkSession, path)
    return out


def _sets(rows: DataFrame, cand: DataFrame) -> DataFrame:
    """cand (sig, doc_id and others) with s, the set: texts aren't exchanged. Some sets may come twice.

    The texts of few classes are found by a broadcast of their ids, those of more by bitmaps, 16 MB at most, of ids and
    sigs; the sets of texts that only the bitmaps take for wanted go in the join with cand.
    """
    named, kind = cand.where("doc_id IS NOT NULL"), "sig bigint, s binary"
    if cand.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(named.select(F.col("doc_id").alias("_id"), "sig"))
        sets = rows.join(wanted, F.col("doc_id") == F.col("_id")).select("text", "sig").mapInArrow(_set_rows(), kind)
    else:
        maps = util.bitmap(named.select(F.xxhash64("doc_id").alias("h")), "h"), util.bitmap(named.select("sig"), "sig")
        sets = rows.where("doc_id IS NOT NULL").select("text", F.xxhash64("doc_id").alias("h")).mapInArrow(_set_rows(maps), kind)
    # classes that no id names are found by their hash
    bare = rows.where("doc_id IS NULL").select("text").mapInArrow(_set_rows(), kind)
    bare = bare.join(_small(cand.where("doc_id IS NULL").select("sig")), "sig", "left_semi").dropDuplicates(["sig"])
    return sets.unionByName(bare).join(_small(cand), "sig")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has ``BROADCAST_ROWS`` at most; a join with a larger one is a shuffle that may split hot keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _blocks(n, count):
    return F.greatest(F.ceil(F.sum(n) / BLOCK), F.ceil(count / BLOCK_SETS)).cast("int")


def _links_of(rows: DataFrame, cand: DataFrame, n: int) -> DataFrame:
    """Links that connect all linked sets of each component: cand are rows sig, doc_id, comp, n, one a sig, of texts in rows."""
    # what is broadcast has a few numbers in a row; the groups of a set are made beside it
    joined = lambda d, g: util.written(d.select("comp", F.explode(g).alias("g"), "sig", "s").select("comp", "g.i", "g.j", "sig", "s").repartition(n, "comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_join_blocks, "a bigint, b bigint").distinct(), "links")
    own = lambda blocks: F.pmod(F.shiftright("sig", 7), blocks).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    over = lambda blocks, f: F.transform(F.sequence(F.lit(0), F.col(blocks) - 1), f)
    info = cand.groupBy("comp").agg(_blocks(F.col("n"), F.count(F.lit(1))).alias("blocks"), *[F.min(F.struct(F.xxhash64("sig", F.lit(k)), "sig"))["sig"].alias(f"p{k}") for k in range(PIVOTS)])
    # components of several blocks are few, and reach their sets without a shuffle by component
    info = util.written(info.where("blocks > 1").select("comp", "blocks", F.array(*[f"p{k}" for k in range(PIVOTS)]).alias("pivots")), "large")
    dealt = cand.join(_small(info), "comp", "left").select("sig", "doc_id", "comp", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"), F.coalesce(F.array_contains("pivots", F.col("sig")), F.lit(False)).alias("pivot"))
    dealt = util.written(dealt, "dealt")
    sets, path = util.staged(_sets(rows, dealt.drop("n")).drop("doc_id"), "sets")
    first = joined(sets, F.when(F.col("pivot"), over("blocks", lambda i: pair(i, F.lit(0)))).otherwise(F.array(pair(own(F.col("blocks")), F.lit(0)))))

    # components in several blocks: what is connected by now, and what isn't part of the largest such part
    linked = util.components(first, "a", "b").withColumnRenamed("node", "sig")
    part = dealt.where("blocks > 1").join(linked, "sig", "left").select("sig", "comp", "n", "blocks", F.coalesce("component", "sig").alias("part"))
    part = util.written(part, "parts")
    sizes = part.groupBy("comp", "part").agg(F.sum("n").alias("size"), F.max("blocks").alias("blocks"))
    main = sizes.groupBy("comp").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("parts"), F.max("blocks").alias("blocks")).where("parts > 1")
    rest = F.col("all") - F.col("most")
    fit = F.ceil(F.col("all") / WIDE)
    # little outside the main part: it goes to many small blocks of all; else all pairs of wide blocks
    wide = F.when(rest * 8 <= F.col("all"), F.greatest(fit, F.least(F.col("blocks"), F.floor(F.col("all") / rest)))).otherwise(fit).cast("int")
    main = util.written(main.select("comp", "main", wide.alias("wide"), F.ceil(rest / WIDE).cast("int").alias("others"), (rest * 8 > F.col("all")).alias("even")), "rest")
    links = first
    if not main.isEmpty():
        again = sets.select("comp", "sig", "s").join(_small(main), "comp").join(_small(part.join(_small(main.select("comp")), "comp").select("sig", "part")), "sig")
        all_ = over("others", lambda j: pair(own(F.col("wide")), j))
        mine = over("wide", lambda i: pair(i, own(F.col("others"))))
        even = over("wide", lambda o: pair(F.least(own(F.col("wide")), o), F.greatest(own(F.col("wide")), o)))
        groups = F.when(F.col("even"), even).when(F.col("part") == F.col("main"), all_).otherwise(F.array_distinct(F.concat(all_, mine)))
        links = first.unionByName(joined(again, groups)).distinct()
    util.delete(rows.sparkSession, path)
    return links


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, whole: of each component the one with the smallest id.

    Rows are told apart by a hash of id and text, not by their ids: two different texts under one id are
    decided each by itself, of rows with one id and one text one stays, and rows without an id take part, beaten by any
    with one. A text without words links with nothing.
    """
    row = util.fresh("row", docs)
    rows = docs.withColumn(row, F.xxhash64(doc_id, F.col(doc_id).isNull(), text, F.col(text).isNull()))
    found = near_duplicates(rows, row, text).select(F.col("doc_id").alias("_row"), "component_id")
    ids = rows.select(F.col(row).alias("_row"), F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).cast("long").alias("id"), F.col(row).alias("row")).alias("rank"))
    # a row is named by its hash, so repeated rows are one from here on
    ranked = util.written(found.distinct().join(ids.distinct(), "_row"), "ranked")
    best = ranked.groupBy("component_id").agg(F.min("rank").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id", F.col("best.row").alias("best"))
    gone = util.written(ranked.join(_small(util.written(best, "best")), "component_id").where("_row <> best").select("_row"), "gone")
    kept = rows.join(_small(gone), rows[row] == gone["_row"], "left_anti")
    return kept.dropDuplicates([row]).drop(row)
