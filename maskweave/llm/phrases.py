"""Phrase collocation mining by level-wise passes (operator 12).

Words are counted first; from then on, level by level, the frequent grams of k - 1 words are
broadcast as a bitmap of their hashes (of a bounded size, without false negatives), and a pass emits a
gram of k words only where both grams of k - 1 words in it may be frequent. Grams are counted by
64-bit hashes (exact up to these), summed within each task before the shuffle; a level keeps those
found ``least`` times and more, and the next pass tells the words of what was kept. All parts of a phrase's cuts
stand in the tables of the levels below, since a part is as frequent as the whole.

Arithmetic: scores are integral quotients of decimals of 38 digits, never doubles.

Defined cases: a null or empty text has no words; a null language is ``und`` and one with that name; a
text counts once for each row that holds it; ties rank by count, then by the phrase's UTF-8 bytes;
other columns, whatever their names, are not read; an empty table, or one without a phrase found
``least`` times, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from . import util

#: Words of the longest phrase.
LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: Hashes that a task holds before it emits their counts.
_HELD = 4_000_000

BREAK = np.zeros(256, bool)
BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
NO_WORD = BREAK.copy()
NO_WORD[[0x20, 9]] = True
_ROWS = "h bigint, c bigint, lang string, phrase string"


def _pieces(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, each piece's first word (with an end), and each piece's row."""
    start, end, first = c.words(NO_WORD)
    breaks = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum(BREAK[c.buf], out=breaks[1:])
    row = np.repeat(np.arange(len(c)), np.diff(first))
    new = np.ones(len(start), bool)
    new[1:] = (breaks[start[1:]] != breaks[start[:-1]]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return start, end, np.append(at, len(start)), row[at]


def _grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of k words within a piece, and which words begin one."""
    if k == 1:
        return words, np.ones(len(words), bool)
    found, at, _ = K.windows(words, first, k, salt=k)
    h, there = np.zeros(len(words), np.uint64), np.zeros(len(words), bool)
    h[at], there[at] = found, True
    return h, there


def _pass(k: int | None, below: tuple[np.ndarray, int] | None, j: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of grams of k words as numbers (none: no counts), and the words of the grams of j that below lets through.

    Rows are a hash with a count, or a hash with a language and a phrase, each once a task or so; at the
    first level also a language with its number of words.
    """
    schema = util.arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        totals: dict[str, int] = {}

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            held.clear()
            return K.batch(schema, h=K.signed(h), c=c, lang=pa.nulls(len(h), pa.string()), phrase=pa.nulls(len(h), pa.string()))

        for b in batches:
            langs = b.column(0).to_pylist()
            codes = K.mix(np.array([xxhash.xxh3_64_intdigest(x) for x in langs], np.uint64))
            for c in K.chunks(b.column(1)):
                start, end, first, row = _pieces(c)
                buf = K.LOWER[c.buf]
                row = np.repeat(c.rows[row], np.diff(first))  # of each word
                words = K.mix(K.Hasher(buf).ranges(start, end) ^ codes[row])
                if below is not None:
                    parts, often = _grams(words, first, j)
                    often &= util.may_hold(below, parts)
                    at = np.flatnonzero(often)
                    each, where = np.unique(parts[at], return_index=True)
                    new = [(h, i) for h, i in zip(K.signed(each).tolist(), at[where].tolist(), strict=True) if h not in seen]
                    if new:
                        seen.update(h for h, _ in new)
                        text = buf.tobytes()
                        phrases_ = [b" ".join(text[start[x] : end[x]] for x in range(i, i + j)).decode() for _, i in new]
                        yield K.batch(schema, h=[h for h, _ in new], c=[0] * len(new), lang=[langs[row[i]] for _, i in new], phrase=phrases_)
                        if len(seen) > _HELD:
                            seen.clear()
                if k is not None:
                    h, there = _grams(words, first, k)
                    if below is not None:
                        there[:-1] &= often[:-1] & often[1:]
                    held.append(h[there])
                    if sum(map(len, held)) > _HELD:
                        yield counted()
                if k == 1:
                    for r, n in zip(*np.unique(row, return_counts=True), strict=True):
                        totals[langs[r]] = totals.get(langs[r], 0) + int(n)
        if k is not None:
            yield counted()
        if totals:
            yield K.batch(schema, h=[0] * len(totals), c=list(totals.values()), lang=list(totals), phrase=pa.nulls(len(totals), pa.string()))

    return run


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def levels(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, k, f of all frequent grams of up to ``longest`` words; lang, n of all words."""
    util.ship(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), util.no_null(F.col(text)).alias("text"))
    below, found = None, []
    for k in range(1, longest + 2):
        made = rows.mapInArrow(_pass(k if k <= longest else None, below, k - 1), _ROWS)
        # a hash has a count at its own level, and at the next its words
        sums = made.groupBy("h", F.when(F.col("h") == 0, F.col("lang")).alias("whose")).agg(F.sum("c").alias("f"), F.max("lang").alias("lang"), F.max("phrase").alias("phrase"))
        level = util.written(sums.where((F.col("f") >= least) | F.col("lang").isNotNull()), f"level-{k}")
        found.append(level)
        below = util.bitmap(level.where("lang IS NULL"), "h")
    named = lambda k: found[k - 1].where("lang IS NULL").select("h", "f").join(found[k].where("phrase IS NOT NULL").select("h", "lang", "phrase"), "h")
    out = None
    for k in range(1, longest + 1):
        some = named(k).select("lang", "phrase", F.lit(k).alias("k"), "f")
        out = some if out is None else out.unionByName(some)
    totals = found[0].where("lang IS NOT NULL").select("lang", F.col("f").alias("n"))
    return util.written(out, "grams"), totals


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by their weakest cut."""
    spark = docs.sparkSession
    grams, totals = levels(docs, lang, text, longest, least)
    long = grams.where("k > 1")
    words = F.split("phrase", " ")
    part = lambda at, n: F.array_join(F.slice(words, at, n), " ")
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_l"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_r"))
    side = lambda name: grams.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))
    cuts = cuts.join(side("l"), ["lang", "_l"]).join(side("r"), ["lang", "_r"])
    score = F.expr(f"cast(cast({SCALE} as decimal(20,0)) * cast(a as decimal(18,0)) div cast(cast(l as decimal(20,0)) + cast(r as decimal(20,0)) as decimal(21,0)) as bigint)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    # what a longer phrase holds, and how often the most frequent of those is found
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("k") - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))))
    held = long.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("most").isNull() | (_big("most") * 100 < _big("a") * 80))
    kept = kept.select("lang", "phrase", "a", "m.l", "m.r", "m.score")
    # the best of each part of a language first, so that no task ranks all of its phrases
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    best = dealt.withColumn("_in", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_in") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
