"""A linear-chain conditional random field over the tokens of a text, trained on Spark.

Features of tokens are made by DataFrame functions and hashed, so the model has a fixed size. Each evaluation of the
likelihood is one job: tasks run forward and backward over their chains, many chains at a time, and their gradients are
summed by feature; the driver holds the weights and takes limited-memory quasi-Newton steps. Texts are whole chains,
however long. The penalty is on squares alone (c2); weights of no use come out small, not zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .anomaly import entropy
from .evaluate import rates

#: The types that make a text sensitive, and from where on one of its tokens is.
SENSITIVE = ("API_KEY_OPENAI", "PAN", "AWS_ACCESS_KEY", "AWS_SECRET_KEY", "PASSWORD", "PRIVATE_KEY", "JWT_TOKEN", "API_KEY_GENERIC")
LEAST_ENTROPY, LEAST_LENGTH = 3.5, 8
LABELS = ("O", "B-SENSITIVE")
#: Features of a token: as many for each.
WIDTH = 12
#: The first of them that a token's own word alone tells.
OWN = 10
#: How packed chains are written, in the order of ``Chains``.
_KINDS = (np.int32, np.float32, np.int32, np.int32, np.float32, np.int8, np.int32)


def tokens(text: Column) -> Column:
    """A text's runs of other than white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"{X._SPACE}+"), lambda w: w != "")


def labels(words: Column, sensitive: Column) -> Column:
    """0 or 1 for each token: 1 for long tokens of high entropy in a text that is sensitive."""
    return F.transform(words, lambda w: (sensitive & (F.length(w) > LEAST_LENGTH) & (entropy(w) > LEAST_ENTROPY)).cast("int"))


def featured(df: DataFrame, words: str = "words", buckets: int = 1 << 15) -> DataFrame:
    """Adds at and x: places in the weights, and values, of WIDTH features for each token, one token after the other."""
    w = F.col(words)
    hashed = lambda name, v: F.pmod(F.xxhash64(F.lit(name), v), F.lit(buckets)).cast("int")
    one, none = F.lit(1.0), F.lit("")
    flag = lambda c: c.cast("double")

    def of(v: Column, i: Column) -> list[tuple[Column, Column]]:
        before = F.when(i > 0, F.lower(F.get(w, i - 1)))
        after = F.lower(F.get(w, i + 1))
        return [
            (hashed("bias", none), one), (hashed("lower", F.lower(v)), one), (hashed("upper", none), flag((F.upper(v) == v) & (F.lower(v) != v))), (hashed("digits", none), flag(v.rlike(r"^\p{Nd}+$"))),
            (hashed("length", none), F.length(v) / 10.0), (hashed("entropy", none), F.round(entropy(v), 2)), (hashed("digit", none), flag(v.rlike(r"\p{Nd}"))), (hashed("special", none), flag(v.rlike("[^a-zA-Z0-9]"))),
            (hashed("suffix", F.right(v, F.lit(3))), one), (hashed("prefix", F.left(v, F.lit(3))), one),
            (F.when(before.isNull(), hashed("first", none)).otherwise(hashed("before", before)), one), (F.when(after.isNull(), hashed("last", none)).otherwise(hashed("after", after)), one),
        ]

    at = F.flatten(F.transform(w, lambda v, i: F.array(*[a for a, _ in of(v, i)])))
    x = F.flatten(F.transform(w, lambda v, i: F.array(*[b.cast("float") for _, b in of(v, i)])))
    return df.withColumn("at", at).withColumn("x", x)


# --- chains, many at a time: rows of all chains one below the other ----------------------------------------


def _steps(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the first tokens of all chains, then of the second, and so on."""
    starts = np.cumsum(lengths) - lengths
    by = np.argsort(-lengths, kind="stable")
    falling = lengths[by]
    for t in range(int(lengths.max(initial=0))):
        yield starts[by[: np.searchsorted(-falling, -t, side="left")]] + t


class Chains(NamedTuple):
    """Chains step by step: their first tokens, longest chain first, then their second ones, and so on.

    What a token's own word says (the first OWN features) stands once for each word that looks alike; the words are numbered.
    """

    own_at: np.ndarray
    own_x: np.ndarray
    word: np.ndarray
    near_at: np.ndarray
    near_x: np.ndarray
    y: np.ndarray
    counts: np.ndarray


def _alike(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal rows, and each row's kind."""
    rows = np.concatenate([np.ascontiguousarray(at, np.int64), np.ascontiguousarray(x, np.float64).view(np.int64)], axis=1)
    odd = np.random.default_rng(1).integers(1, 1 << 62, rows.shape[1]) * 2 + 1
    mixed = (rows ^ (rows >> 29)) * odd
    _, first, kind = np.unique((mixed ^ (mixed >> 31)).sum(axis=1), return_index=True, return_inverse=True)
    if not np.array_equal(rows[first[kind]], rows):  # two kinds under one hash
        _, first, kind = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


def packed(at: np.ndarray, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> Chains:
    steps = list(_steps(lengths))
    by = np.concatenate(steps) if steps else np.zeros(0, np.int64)
    at, x, y = at[by], x[by], y[by]
    first, kind = _alike(at[:, :OWN], x[:, :OWN])
    return Chains(at[first, :OWN], x[first, :OWN], kind, at[:, OWN:], x[:, OWN:], y, np.array([len(r) for r in steps], np.int64))


def _sum(parts: list[np.ndarray]) -> np.ndarray:
    """The logarithm of a sum of exponentials, element by element."""
    out = parts[0]
    for part in parts[1:]:
        out = np.logaddexp(out, part)
    return out


def _expected(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``marginals`` of chains that stand step by step; scores and marginals have a row for each label.

    A chain that goes on stands at one place in all steps, so a step is a slice and its chains come first in the slice before.
    """
    k, n = scores.shape
    starts = np.cumsum(counts) - counts
    forward, backward = scores.copy(), np.zeros_like(scores)
    for t in range(1, len(counts)):
        a, b = slice(starts[t - 1], starts[t - 1] + counts[t]), slice(starts[t], starts[t] + counts[t])
        for j in range(k):
            forward[j, b] += _sum([forward[i, a] + moves[i, j] for i in range(k)])
    for t in range(len(counts) - 1, 0, -1):
        a, b = slice(starts[t - 1], starts[t - 1] + counts[t]), slice(starts[t], starts[t] + counts[t])
        later = scores[:, b] + backward[:, b]
        for i in range(k):
            backward[i, a] = _sum([later[j] + moves[i, j] for j in range(k)])
    at_start = slice(0, counts[0] if len(counts) else 0)
    log_z = _sum(list(scores[:, at_start] + backward[:, at_start]))
    place = np.arange(n) - np.repeat(starts, counts)
    of = log_z[place]
    later = slice(len(log_z), n)
    before = np.repeat(starts[:-1], counts[1:]) + place[later]
    onward = scores[:, later] + backward[:, later] - of[later]
    come = forward[:, before]
    pairs = np.array([[np.exp(come[i] + onward[j] + moves[i, j]).sum() for j in range(k)] for i in range(k)])
    return log_z, np.exp(forward + backward - of), pairs


def marginals(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition function of each chain, label marginals of each row, and the expected count of each move."""
    steps = list(_steps(lengths))
    by = np.concatenate(steps)
    z, q, pairs = _expected(np.ascontiguousarray(scores[by].T), moves, np.array([len(r) for r in steps], np.int64))
    log_z, p = np.empty_like(z), np.empty_like(scores)
    log_z[np.argsort(-lengths, kind="stable")[: len(z)]] = z
    p[by] = q.T
    return log_z, p, pairs


def viterbi(scores: np.ndarray, moves: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The labels of the likeliest path of each chain; ties go to the smaller label."""
    best, back = scores.copy(), np.zeros(scores.shape, np.int64)
    steps = list(_steps(lengths))
    for rows in steps[1:]:
        ways = best[rows - 1][:, :, None] + moves
        back[rows] = ways.argmax(axis=1)
        best[rows] += ways.max(axis=1)
    out = best.argmax(axis=1)
    for rows in steps[:0:-1]:
        out[rows - 1] = back[rows, out[rows]]
    return out


class Crf:
    """Weights by feature and label, and moves from label to label."""

    def __init__(self, weights: np.ndarray, buckets: int):
        k = len(LABELS)
        self.flat, self.buckets = weights, buckets
        self.weights, self.moves = weights[: buckets * k].reshape(buckets, k), weights[buckets * k :].reshape(k, k)

    def scores(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self.weights[at] * x[:, :, None]).sum(axis=1)

    def tag(self, df: DataFrame, words: str = "words", to: str = "tags") -> DataFrame:
        """df with a label of LABELS for each token."""
        model = self
        rows = featured(df, words, self.buckets)
        names = df.columns
        schema = df.withColumn(to, F.array(F.lit("O"))).schema

        def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, x, lengths, _ = _chains(b)
                got = viterbi(model.scores(at, x), model.moves, lengths[lengths > 0])
                said = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.array(LABELS, object)[got], pa.string()))
                yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], said], names=[*names, to])

        return _bounded(rows).mapInArrow(tagged, schema)


def _bounded(df: DataFrame) -> DataFrame:
    """df, whose batches for Python hold no more than 16 MB or one text: a setting of the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return df


def _chains(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    flat = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False)
    at, x = flat("at").reshape(-1, WIDTH), flat("x").astype(float).reshape(-1, WIDTH)
    lengths = b.column("at").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    return at, x, lengths, flat("y") if "y" in b.schema.names else None


def gradient(model: Crf, at: np.ndarray, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of chains with labels y, and its gradient by weight."""
    return _gradient(model, packed(at, x, lengths, y))


def _gradient(model: Crf, c: Chains) -> tuple[float, np.ndarray]:
    """``gradient`` of packed chains: words that look alike are scored, and their gradients summed, as one."""
    k, n = len(LABELS), len(c.y)
    own = model.scores(c.own_at, c.own_x)
    scores = np.stack([own[:, j][c.word] + sum(model.weights[:, j][c.near_at[:, i]] * c.near_x[:, i] for i in range(c.near_at.shape[1])) for j in range(k)])
    log_z, p, pairs = _expected(scores, model.moves, c.counts)
    y, to = c.y, np.arange(len(log_z), n)
    before = y[to - np.repeat(c.counts[:-1], c.counts[1:])]
    loss = log_z.sum() - scores[y, np.arange(n)].sum() - model.moves[before, y[to]].sum()
    pairs -= np.bincount(before * k + y[to], minlength=k * k).reshape(k, k)
    p[y, np.arange(n)] -= 1
    count = lambda at, w: np.bincount(at.ravel(), weights=w.ravel(), minlength=model.buckets)
    by = [count(c.own_at, c.own_x * np.bincount(c.word, weights=p[j], minlength=len(own))[:, None]) + count(c.near_at, c.near_x * p[j][:, None]) for j in range(k)]
    return float(loss), np.concatenate([np.stack(by, axis=1).ravel(), pairs.ravel()])


def _unpacked(row: tuple[pa.Scalar, ...]) -> Chains:
    """A written row of chains."""
    c = Chains(*[np.frombuffer(v.as_buffer(), t).astype(np.float64 if t is np.float32 else np.int64) for v, t in zip(row, _KINDS, strict=True)])
    shaped = lambda v, width: v.reshape(-1, width)
    return c._replace(own_at=shaped(c.own_at, OWN), own_x=shaped(c.own_x, OWN), near_at=shaped(c.near_at, WIDTH - OWN), near_x=shaped(c.near_x, WIDTH - OWN))


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 7, enough: float = 1e-4) -> np.ndarray:
    """A limited-memory quasi-Newton descent with halved steps; ends early where the value falls by less than this share."""
    w, (value, g) = start, f(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            d -= a * y
            kept.append(a)
        d *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += (a - y @ d / (s @ y)) * s
        size = 1.0
        while True:
            new, slope = w - size * d, d @ g
            found, h = f(new)
            if found <= value - 1e-4 * size * slope or size < 1e-6:
                break
            size /= 2
        if found >= value:
            break
        if (h - g) @ (new - w) > 1e-12:
            past = [*past, (new - w, h - g)][-memory:]
        small = value - found < enough * max(1.0, abs(value))
        w, value, g = new, found, h
        if small:
            break
    return w


def train(df: DataFrame, words: str = "words", y: str = "y", buckets: int = 1 << 15, c2: float = 0.1, steps: int = 50) -> Crf:
    """A model of the chains in df, whose y has a label's number for each token; chains without tokens say nothing.

    df's features are worked out once, packed and staged: a row holds the chains of one batch. A task gives one row for each weight it has a gradient for, at most
    2 x buckets + 5, and so does their sum, which the driver reads.
    """
    from ..sources.staging import staged

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x, lengths, labels_ = _chains(b)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([v.astype(t).tobytes()], pa.binary()) for v, t in zip(packed(at, x, lengths, labels_), _KINDS, strict=True)], names=list(Chains._fields))

    each = featured(df.select(F.col(words).alias("words"), F.col(y).alias("y")).where(F.size(words) > 0), "words", buckets).select("at", "x", "y")
    rows = staged(_bounded(each).mapInArrow(pack, ", ".join(f"{f} binary" for f in Chains._fields)), "chains")
    k = len(LABELS)
    n = buckets * k + k * k
    spark = df.sparkSession

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        told = spark.sparkContext.broadcast(w)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, total = Crf(told.value, buckets), np.zeros(n + 1)
            for b in batches:
                for row in zip(*b.columns, strict=True):
                    loss, g = _gradient(model, _unpacked(row))
                    total[:n] += g
                    total[n] += loss
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["i", "g"])

        sums = _bounded(rows).mapInArrow(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).toPandas()
        told.unpersist()
        out = np.zeros(n + 1)
        out[sums["i"].to_numpy()] = sums["g"].to_numpy()
        return out[n] + c2 * float(w @ w), out[:n] + 2 * c2 * w

    return Crf(minimised(value, np.zeros(n), steps), buckets)


def report(df: DataFrame, y: str = "y", tags: str = "tags") -> DataFrame:
    """tokens, tp, fp, fn, precision, recall, f1 of B-SENSITIVE over all tokens: one row."""
    each = df.select(F.explode(F.arrays_zip(F.col(y).alias("y"), F.col(tags).alias("t"))).alias("p")).select((F.col("p.y") == 1).alias("y"), (F.col("p.t") == LABELS[1]).alias("t"))
    sums = each.agg(F.count(F.lit(1)).alias("tokens"), *[F.count_if(c).alias(k) for k, c in (("tp", F.col("y") & F.col("t")), ("fp", ~F.col("y") & F.col("t")), ("fn", F.col("y") & ~F.col("t")))])
    return sums.select("*", *rates(F.col("tp"), F.col("fp"), F.col("fn")))
