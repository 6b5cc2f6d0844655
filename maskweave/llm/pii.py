"""Information-theoretic sanitisation of personal data (operator 1).

Base entities (email, ip, card, phone) are found by pattern. A term near an entity reveals it as
far as the corpus says so: with document frequencies over all documents,

    PMI(e, t) = log2(N * n(e, t) / (n(e) * n(t))),   IC(e) = log2(N / n(e)),

and PMI / IC is the share of the entity's information that the term gives away. A term within
``WINDOW`` words of an entity is generalised to its class at ``generalise`` and removed at
``remove``. A pair in c different contexts (copies of a text are one) is trusted to c / (c + 1): its
PMI is lowered by log2((c + 1) / c) bits, so an entity seen once has disclosing terms too, if they are
rare, and needs a larger corpus for their removal.

Counts of pairs come from documents with entities only; n(t) of the terms near them is counted over
all texts, with a bitmap of bounded size (no false negatives) before the shuffle. The
pairs over a threshold go to the workers in blocks of ``BLOCK`` hashes, a pass over the rows for each
block; ``sanitise`` rewrites each row once and so holds all blocks, 8 bytes a pair, in a worker.

Defined cases: a null text has no spans; null ids are kept; repeated rows each have their spans;
an empty table gives an empty result; terms are compared with ASCII letters lower-cased.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from . import kernel as K
from . import util

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 8
MIN_TERM = 3
BLOCK = 2_000_000
#: Terms of texts that a task counts together.
_HELD = 1_000_000
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; leftmost and non-overlapping within a kind."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at)):
            out.append((begin, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _NOT_DIGIT.sub("", m.group())
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def entity_hash(text: str, start: int, kind: int, end: int) -> int:
    """The same for an entity's spellings: case of emails, separators of numbers."""
    value = text[start:end].lower() if kind < 2 else _NOT_DIGIT.sub("", text[start:end])
    return xxhash.xxh3_64_intdigest(f"{kind}:{value}")


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(entity, term, context, start, end) for each term near each base span; a term never touches a base span."""
    c = next(K.chunks(pa.array([text], pa.large_string())))
    first, last, _ = c.words(K.NOT_ALNUM)
    terms = K.Hasher(K.LOWER[c.buf]).ranges(first, last)
    points = c.code_points()
    a, z = points[first], points[last]
    free = np.ones(len(a), bool)
    for start, _, end in spans:
        free[(a < end) & (z > start)] = False
    free &= z - a >= MIN_TERM
    for start, kind, end in spans:
        left = int(np.searchsorted(a, start))
        right = int(np.searchsorted(a, end))
        near = np.r_[max(0, left - WINDOW) : left, right : min(len(a), right + WINDOW)].astype(np.int64)
        near = near[free[near]]
        context = xxhash.xxh3_64_intdigest(terms[near].tobytes())
        e = entity_hash(text, start, kind, end)
        for i in near.tolist():
            yield e, int(terms[i]), context, int(a[i]), int(z[i])


def pair_hash(e: int, t: int) -> int:
    return xxhash.xxh3_64_intdigest(e.to_bytes(8, "little") + t.to_bytes(8, "little"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


_NEAR = "e bigint, t bigint, pair bigint, context bigint, first int"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each pair of a document and context; first marks one of its document; t = 0 stands for the entity alone."""
    schema = util.arrow_schema(_NEAR)
    for b in batches:
        rows: list[tuple] = []
        for text in b.column(0).to_pylist():
            spans = base_spans(text)
            if not spans:
                continue
            rows += [(_signed(e), 0, 0, 0, 1) for e in {entity_hash(text, *s) for s in spans}]
            seen: set[int] = set()
            done: set[tuple[int, int]] = set()
            for e, t, context, _, _ in near_terms(text, spans):
                pair = pair_hash(e, t)
                if (pair, context) not in done:
                    rows.append((_signed(e), _signed(t), _signed(pair), _signed(context), int(pair not in seen)))
                    done.add((pair, context))
                    seen.add(pair)
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)


def _term_counts(bitmap: tuple[np.ndarray, int]):
    schema = util.arrow_schema("t bigint, c bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # a term for each text that holds it, since the last flush
        size = 0

        def flush() -> pa.RecordBatch:
            t, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return K.batch(schema, t=K.signed(t), c=n)

        for b in batches:
            for c in K.chunks(b.column(0)):
                first, last, by_row = c.words(K.NOT_ALNUM)
                h = K.Hasher(K.LOWER[c.buf]).ranges(first, last)
                ok = util.may_hold(bitmap, h)
                row = np.repeat(np.arange(len(c)), np.diff(by_row))[ok]
                if len(row):
                    order = np.lexsort((h[ok], row))
                    t, row = h[ok][order], row[order]
                    new = np.ones(len(t), bool)
                    new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
                    held.append(t[new])
                    size += len(held[-1])
                if size > _HELD:
                    yield flush()
                    size = 0
        yield flush()

    return run


def disclosing_pairs(texts: DataFrame, generalise: float, remove: float) -> DataFrame:
    """pair, ratio: pairs of entity and term over the lower threshold."""
    total = max(texts.count(), 1)
    near = util.written(texts.mapInArrow(_pairs, _NEAR), "near")
    n_e = near.where("t = 0 AND pair = 0").groupBy("e").agg(F.sum("first").alias("n_e"))
    pairs = near.where("NOT (t = 0 AND pair = 0)").groupBy("e", "t", "pair", "context").agg(F.sum("first").alias("f"))
    pairs = pairs.groupBy("e", "t", "pair").agg(F.sum("f").alias("n_et"), F.count(F.lit(1)).alias("contexts"))
    pairs = util.written(pairs, "pairs")
    bitmap = util.bitmap(pairs.select("t").distinct(), "t")
    n_t = texts.mapInArrow(_term_counts(bitmap), "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("n_t"))
    out = pairs.join(n_e, "e").join(n_t, "t")
    trust = F.col("contexts") / (F.col("contexts") + 1)
    pmi = F.log2(F.lit(float(total)) * F.col("n_et") / (F.col("n_e") * F.col("n_t")) * trust)
    # an entity of every document has no information to give away
    ic = F.log2(F.lit(float(total)) / F.col("n_e"))
    return util.written(out.where(ic > 1e-9).select("pair", (pmi / ic).alias("ratio")).where(F.col("ratio") >= min(generalise, remove)), "disclosing")


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("level", T.IntegerType())]))
_ARROW_SPAN = pa.list_(pa.struct([(f, pa.int32()) for f in ("start", "kind", "end", "level")]))


def _finder(weak: np.ndarray, strong: np.ndarray, with_base: bool):
    """Spans of texts: base ones (level 2) and terms of the sorted pair hashes (weak: level 1, strong: 2)."""

    def has(sorted_: np.ndarray, h: int) -> bool:
        at = int(np.searchsorted(sorted_, np.uint64(h)))
        return at < len(sorted_) and int(sorted_[at]) == h

    def find(texts: list[str | None]) -> list[list[dict]]:
        out = []
        for s in texts:
            base = base_spans(s)
            mine = [(a, k, z, 2) for a, k, z in base] if with_base else []
            if base and (len(weak) or len(strong)):
                level: dict[tuple[int, int], int] = {}
                for e, t, _, a, z in near_terms(s, base):
                    pair = pair_hash(e, t)
                    found = 2 if has(strong, pair) else int(has(weak, pair))
                    level[a, z] = max(level.get((a, z), 0), found)
                mine += [(a, 4, z, v) for (a, z), v in level.items() if v]
            out.append([dict(zip(("start", "kind", "end", "level"), m, strict=True)) for m in sorted(mine)])
        return out

    return find


def _spans(find):
    @arrow_udf(_SPAN)
    def spans(text: pa.Array) -> pa.Array:
        return pa.array(find(text.to_pylist()), _ARROW_SPAN)

    return spans


def finders(docs: DataFrame, text: str, generalise: float, remove: float) -> Iterator:
    """A function from texts to spans for each block of disclosing pairs; the first finds the base spans too."""
    util.ship(docs.sparkSession)
    pairs = disclosing_pairs(docs.select(F.col(text).alias("text")), generalise, remove)
    blocks = max(1, math.ceil(pairs.count() / BLOCK))
    for b in range(blocks):
        block = pairs.where(F.pmod("pair", F.lit(blocks)) == b).toArrow()
        h, strong = block["pair"].to_numpy().view(np.uint64), block["ratio"].to_numpy() >= remove
        yield _finder(np.sort(h[~strong]), np.sort(h[strong]), b == 0)


def span_column(docs: DataFrame, text: str, generalise: float, remove: float) -> Column:
    """All spans of a row's text, sorted by start and kind."""
    parts = [_spans(find)(F.col(text)) for find in finders(docs, text, generalise, remove)]
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """doc_id and spans: array of start, kind (index of KINDS), end, level (1 generalise, 2 remove)."""
    column = span_column(docs, text, generalise, remove)
    return docs.select(F.col(doc_id).alias("doc_id"), column.alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", length: str | None = "n_chars", generalise: float = 0.8, remove: float = 0.95) -> DataFrame:
    """docs with entities replaced by their kind, disclosing terms by their class or by nothing; all other columns stay.

    Where spans overlap, the first and longest stands for all that it touches. The column
    ``length``, if there is one, counts the new text.
    """
    names = docs.columns
    at = names.index(text)
    at_length = names.index(length) if length in names else -1
    found = list(finders(docs, text, generalise, remove))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            texts = columns[at].to_pylist()
            spans = [sorted(sum(s, []), key=lambda m: (m["start"], m["kind"], m["end"])) for s in zip(*(find(texts) for find in found), strict=True)]
            new = [rewrite(s, m) for s, m in zip(texts, spans, strict=True)]
            columns[at] = pa.array(new, columns[at].type)
            if at_length >= 0:
                old = columns[at_length].to_pylist()
                columns[at_length] = pa.array([len(t) if m else n for t, m, n in zip(new, spans, old, strict=True)], columns[at_length].type)
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def rewrite(s: str | None, found: list[dict]) -> str | None:
    """The text with its spans replaced."""
    if not s or not found:
        return s
    parts, at = [], 0
    for m in sorted(found, key=lambda m: (m["start"], -m["end"])):
        a, z = m["start"], m["end"]
        if a < at:
            at = max(at, z)
            continue
        parts.append(s[at:a])
        if m["kind"] < 4:
            parts.append(f"<{KINDS[m['kind']].upper()}>")
        elif m["level"] == 1:
            parts.append("<NUMBER>" if s[a:z].isdigit() else "<NAME>" if s[a].isupper() else "<WORD>")
        at = z
    parts.append(s[at:])
    return "".join(parts)


_DIGEST = util.struct("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


@arrow_udf(_DIGEST)
def digest(spans: pa.Array) -> pa.Array:
    """Counts of base spans, their digest, and all spans as text."""
    rows = []
    for found in spans.to_pylist():
        said = [f"{KINDS[m['kind']]}:{m['start']}:{m['end']}" for m in found]
        base = [t for t, m in zip(said, found, strict=True) if m["kind"] < 4]
        rows.append([sum(m["kind"] == k for m in found) for k in range(4)] + [hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(said)])
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.StructArray.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(cols)], names=_DIGEST.names)
