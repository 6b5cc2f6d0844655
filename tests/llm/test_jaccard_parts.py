"""Large components of candidates: those that hold together by chance are taken apart, and no link is lost."""

import collections
import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from maskweave.llm import jaccard, util


def ring(n=160):
    """Each text shares a short passage with each of four others: enough in all, too little with any."""
    passage = lambda i, by: [f"p{i % n}by{by}x{k}" for k in range(6)]
    return [(i, " ".join(passage(i + n - 1, 1) + passage(i, 1) + [f"own{i}x{k}" for k in range(4)] + passage(i + n - 7, 7) + passage(i, 7))) for i in range(n)]


def families(rng):
    """Near copies of a few texts, some of them linked, that share a passage of their own with the next family."""
    rows = []
    for f in range(5):
        base = [f"f{f}w{k}" for k in range(40)] + [f"f{f + 1}w{k}" for k in range(12)]
        for i in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(50)}"
            rows.append((1000 + 100 * f + i, " ".join(w)))
    return rows


def test_chance_components_are_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WIDE", 200)
    kept = {}
    for name in ("written", "staged"):
        if f := getattr(util, name, None):
            note = lambda df, what, f=f, name=name: (out := f(df, what), kept.setdefault(what, (out if name == "written" else out[0]).count()))[0]
            monkeypatch.setattr(util, name, note)
    rows = ring()
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.components(rows))
    assert kept["candidates"] > 40  # the ring hangs together
    assert kept["sets"] < kept["candidates"] / 4


@pytest.mark.parametrize("hub", [1, 3, 32])
def test_no_link_is_lost(spark, monkeypatch, hub):
    """Pairs that share by shingles of few sets, of many, or of both."""
    monkeypatch.setattr(jaccard, "WIDE", 1)
    if hub == 3:
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    order = jaccard._pairs

    def pairs(batches, hub=hub):
        jaccard.HUB = hub  # in the worker
        yield from order(batches)

    monkeypatch.setattr(jaccard, "_pairs", pairs)
    rows = ring(20) + families(random.Random(hub))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert collections.Counter(tuple(r) for r in got.collect()) == collections.Counter(brute.components(rows))


@pytest.mark.parametrize("step", [1, 2, 7, 100])
def test_pairs_of_batches(monkeypatch, step):
    """Groups that go over batches: all pairs of small ones, each member of large ones."""
    monkeypatch.setattr(jaccard, "HUB", 4)
    rng = random.Random(step)
    rows = sorted((w, 10 * w + k, rng.choice([8, 9, 20])) for w in range(30) for k in range(rng.choice([1, 2, 3, 4, 5, 9])))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step], strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["w", "sig", "n"]) for i in range(0, len(rows), step)]
    got = collections.Counter(tuple(r.values())[1:] for b in jaccard._pairs(iter(batches)) for r in b.to_pylist())
    want = collections.Counter()
    for w in range(30):
        group = [(s, n) for v, s, n in rows if v == w]
        if len(group) > 4:
            want.update((s, None, n) for s, n in group)
        else:
            want.update((x, y, min(a, b)) for i, (x, a) in enumerate(group) for y, b in group[i + 1 :] if 4 * min(a, b) >= 3 * max(a, b))
    assert got == want
    assert np.all([b.num_columns == 4 for b in jaccard._pairs(iter(batches))])
