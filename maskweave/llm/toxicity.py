"""Toxicity by subword bags (operator 6).

A word is the bag of its byte n-grams (3 to 5, with a blank at either end) and of itself, each
hashed to a row of an embedding; the word vectors are averaged over a passage, and a linear softmax
reads the average. Embeddings and softmax are trained jointly in numpy. As misspellings share most
n-grams with the word, unseen ones still score.

A text is read in passages of ``PASSAGE`` words, so a long text doesn't dilute a few words; the
text's logit is a soft maximum over its passages, in training and in scoring.

Training takes a bounded sample of labelled rows (``SAMPLE`` of each label, in the order of a hash
of the id, as far as their texts fit into ``SAMPLE_BYTES``) and reads their texts whole; scoring
reads all texts whole, a megabyte of bytes at a time.

Defined cases: a null or wordless text gets the score of the bias alone; labels that are null, or
whose document is missing, are not learnt from; without labels of both kinds the score is the
share of label 1 (0 if there are none); repeated labels count again.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import kernel as K
from . import util

GRAMS = (3, 4, 5)
BUCKET_BITS = 18
DIM = 8
PASSAGE = 8
#: Labelled rows of each label that are learnt from, at most, and the bytes of their texts; a text
#: longer than a sixteenth of these isn't drawn.
SAMPLE = 1500
SAMPLE_BYTES = 32 << 20
STEPS = 120
#: An n-gram is learnt if so many texts of the sample hold it.
MIN_TEXTS = 5
#: How far the embedding with the largest gradient moves in a step, and the decay of all.
STRIDE = 8.0
DECAY = 0.002


def subwords(c: K.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and word of each n-gram of a chunk (words in order), and the row bounds of words."""
    buf = np.where(K.NOT_ALNUM[c.buf], np.uint8(32), K.LOWER[c.buf])
    buf = np.insert(buf, c.off, 32).astype(np.uint8)
    off = c.off + np.arange(len(c.off))
    word = buf != 32
    first = word.copy()
    first[1:] &= ~word[:-1]
    number = np.cumsum(first) - 1
    blanks = np.concatenate([[0], np.cumsum(~word)])
    hasher = K.Hasher(buf)
    n = len(buf)
    buckets, words = [], []
    for k in GRAMS:
        at = np.arange(max(n - k + 1, 0))
        at = at[blanks[at + k - 1] == blanks[at + 1]]  # letters only between the ends
        buckets.append(hasher.ranges(at, at + k) >> np.uint64(64 - BUCKET_BITS))
        words.append(number[at + 1])
    start = np.flatnonzero(first)
    edge = word.copy()
    edge[:-1] &= ~word[1:]
    end = np.flatnonzero(edge) + 1
    buckets.append(K.mix(hasher.ranges(start, end)) >> np.uint64(64 - BUCKET_BITS))
    words.append(np.arange(len(start)))
    return np.concatenate(buckets).astype(np.int32), np.concatenate(words), np.searchsorted(start, off)


def _softmax_pool(logit: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """log(mean(exp)) would sink with length; a softmax-weighted mean of passages does not. Returns it and the weights."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, logit)
    w = np.exp(logit - top[row])
    total = np.bincount(row, w, n)
    w /= np.maximum(total[row], 1e-30)
    return np.bincount(row, w * logit, n), w


class Model:
    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores.astype(np.float32), bias

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.full(len(column), self.bias)
        for c in K.chunks(column):
            bucket, word, rows = subwords(c)
            n_words = int(rows[-1])
            if not n_words:
                continue
            count = np.bincount(word, minlength=n_words)
            value = np.bincount(word, self.scores[bucket], n_words) / np.maximum(count, 1)
            per = np.diff(rows)
            row = np.repeat(np.arange(len(c)), per)
            n_pass = -(-per // PASSAGE)
            before = np.cumsum(n_pass) - n_pass
            passage = before[row] + (np.arange(n_words) - rows[:-1][row]) // PASSAGE
            size = np.bincount(passage)
            logit = np.bincount(passage, value) / size + self.bias
            owner = np.repeat(np.arange(len(c)), n_pass)
            pooled, _ = _softmax_pool(logit, owner, len(c))
            out[c.rows] = np.where(per > 0, pooled, self.bias)
        return 1 / (1 + np.exp(-out))


def train(texts: list[str], labels: np.ndarray, seed: int = 7, steps: int = STEPS, rate: float = 0.05) -> Model:
    """Full-batch descent: normalised steps with momentum on the embeddings, Adam on softmax and bias.

    With two classes the softmax has one direction u of free weights, and the gradient of an
    embedding row is (a sum of scalars) * u: forward and backward passes move scalars alone.
    """
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    prior = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    size = 1 << BUCKET_BITS
    if not len(labels) or share in (0.0, 1.0):
        return Model(np.zeros(size), prior if len(labels) else -20.0)
    # distinct words, their n-grams, and the words of each passage
    vocab: dict[bytes, int] = {}
    ids = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        words = np.where(K.NOT_ALNUM[raw], np.uint8(32), K.LOWER[raw]).tobytes().split()
        ids.append(np.fromiter((vocab.setdefault(w, len(vocab)) for w in words), np.int32, len(words)))
    per = np.array([len(x) for x in ids])
    passages = np.maximum(-(-per // PASSAGE), 1)
    n_pass = int(passages.sum())
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), passages)
    first = np.cumsum(per) - per
    p_of = (np.repeat(np.cumsum(passages) - passages, per) + (np.arange(int(per.sum())) - np.repeat(first, per)) // PASSAGE).astype(np.int32)
    w_of = np.concatenate(ids)
    del ids
    weight = (1 / np.maximum(np.bincount(p_of, minlength=n_pass), 1))[p_of].astype(np.float32)
    bucket, word, at = [], [], 0
    names = list(vocab)
    for i in range(0, len(names), 20_000):
        g, w, _ = subwords(next(K.chunks(pa.array([b" ".join(names[i : i + 20_000]).decode()], pa.large_string()))))
        bucket.append(g)
        word.append((w + at).astype(np.int32))
        at += len(names[i : i + 20_000])
    bucket, word = np.concatenate(bucket), np.concatenate(word)
    n_words = len(names)
    per_word = np.bincount(word, minlength=n_words)
    grams = np.maximum(per_word, 1)
    # an n-gram of few texts tells those texts apart and nothing else: its row stays zero
    order = np.argsort(word, kind="stable").astype(np.int32)
    starts = np.cumsum(per_word) - per_word
    found = np.zeros(size, np.int32)
    doc_of = owner[p_of]
    edges = np.searchsorted(doc_of, np.arange(len(texts) + 1))
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = np.unique(w_of[lo:hi])
        n = per_word[mine]
        found[np.unique(bucket[order[np.repeat(starts[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]])] += 1
    live = found >= MIN_TEXTS
    del order, vocab, names
    emb, u, b = rng.normal(0, 0.01, (size, DIM)), rng.normal(0, 0.5, DIM), prior
    emb[~live] = 0
    m_e, m_u, v_u, m_b, v_b = np.zeros_like(emb), np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
    y = labels.astype(float)
    for step in range(1, steps + 1):
        s = np.einsum("ij,j->i", emb, u)  # without threads of a linear algebra library
        by_word = np.bincount(word, s[bucket], n_words) / grams
        logit = np.bincount(p_of, weight * by_word[w_of], n_pass) + b
        pooled, soft = _softmax_pool(logit, owner, len(y))
        p = 1 / (1 + np.exp(-pooled))
        g_doc = (p - y) / len(y)
        # derivative of the pooled logit by a passage's: w * (1 + logit - pooled)
        g_pass = g_doc[owner] * soft * (1 + logit - pooled[owner])
        g_word = np.bincount(w_of, weight * g_pass[p_of], n_words) / grams
        a = np.where(live, np.bincount(bucket, g_word[word], size), 0)
        a /= max(float(np.abs(a).max()), 1e-12)
        g_u, g_b = np.einsum("ij,i->j", emb, a) + 1e-3 * u, float(g_doc.sum())
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        m_e = 0.9 * m_e + 0.1 * a[:, None] * u
        m_u, v_u = 0.9 * m_u + 0.1 * g_u, 0.99 * v_u + 0.01 * g_u**2
        m_b, v_b = 0.9 * m_b + 0.1 * g_b, 0.99 * v_b + 0.01 * g_b**2
        emb -= STRIDE * (m_e / c1) / max(float(np.linalg.norm(u)), 1e-9)
        emb *= 1 - DECAY
        u -= rate * (m_u / c1) / (np.sqrt(v_u / c2) + 1e-9)
        b -= rate * (m_b / c1) / (np.sqrt(v_b / c2) + 1e-9)
    return Model(np.einsum("ij,j->i", emb, u), b)


def held_out(doc_id):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model of the rows outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("_id")))
    share = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    # a bounded sample: 2 * sample rows at most
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select(F.col(doc_id).cast("long").alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).where(F.octet_length("t") <= SAMPLE_BYTES // 16)
    rows = util.written(rows.select("_id", "y", "t", F.octet_length("t").alias("size"), F.xxhash64("_id", "t").alias("turn")), "sample")
    # an id may stand in many rows: as many as wanted are drawn, whole, while their bytes fit
    ends = []
    for y in (0, 1):
        mine = rows.where(F.col("y") == y).select("turn", "size").orderBy("turn", "size").limit(sample).toArrow()
        fit_ = np.cumsum(mine["size"].to_numpy()) <= SAMPLE_BYTES // 2
        ends.append(int(mine["turn"].to_numpy()[fit_][-1]) if fit_.any() else None)
    inside = [(F.col("y") == y) & (F.col("turn") <= end) for y, end in enumerate(ends) if end is not None]
    none = spark.createDataFrame([], rows.schema)
    rows = rows.where(inside[0] | inside[-1]).orderBy("_id", "t").limit(2 * sample).toArrow() if inside else none.toArrow()
    y = np.array(rows["y"].to_pylist(), np.int64)
    model = train(rows["t"].to_pylist(), y)
    # the sample is balanced; the bias goes back to the labels' own share
    n0, n1 = share.get(0, 0), share.get(1, 0)
    s1 = float(y.mean()) if len(y) else 0.0
    if n0 and n1 and 0 < s1 < 1:
        model.bias += float(np.log(n1 / n0) - np.log(s1 / (1 - s1)))
    return model


def score(docs: DataFrame, model: Model, text: str = "text"):
    @arrow_udf(util.sql_type("double"))
    def run(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column))

    return run(F.col(text))


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())
