"""SimHash, phrases and resampling against brute-force versions on small rows with every awkward case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("maskweave.llm")
import xxhash  # noqa: E402
from brute import LOW, WORD  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from maskweave.llm import jaccard, kernel, phrases, resample, simhash  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, fp string, rank string, score string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(["alpha", "Beta", "gamma", "été", "zeta", "eta,", "theta.", "iota", "日本", "x1-y2"]) for _ in range(n))
    long = say(90_000)  # longer than a chunk of the kernel
    near = say(300)
    texts = [None, "", " \t\n", "one", "One two", "ONE TWO", near, near, near + " end", near.replace("alpha", "omega", 1), long, long + " tail", "a b c\x0bd", "!!! ...", say(25)]
    texts += [" ".join(w if rng.random() > 0.01 else "new" for w in near.split()) for _ in range(20)]
    out = [(i, t, ("en", "de", None)[i % 3], "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*out, out[6], (None, near, None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(t):
    w = WORD.findall((t or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def close_groups(ids, fps):
    """The smallest id reachable from each."""
    group = list(range(len(fps)))
    for a in range(len(fps)):
        for b in range(a):
            if group[a] != group[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                group = [group[a] if g == group[b] else g for g in group]
    least = {g: min((i for i, h in zip(ids, group, strict=True) if h == g and i is not None), default=None) for g in group}
    return [least[g] for g in group]


def test_simhash(docs, none, rows):
    fps = [fingerprint(r[1]) for r in rows]
    want = [(r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, close_groups([r[0] for r in rows], fps), strict=True)]
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("hot,blocks", [(2048, 4), (2048, 5), (2048, 6), (6, 4), (1, 5)])
def test_simhash_links_in_small_and_large_buckets(spark, monkeypatch, hot, blocks):
    """Random bits and walks of one to four bits from a few centres, as signed fingerprints."""
    rng = random.Random(hot * 10 + blocks)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = [rng.getrandbits(64) for _ in range(60)] + centres
    for _ in range(240):
        f = rng.choice(fps[-80:])
        for j in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << j
        fps.append(f)
    fps = list(dict.fromkeys(fps))
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "blocks_for", lambda n: blocks)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    classes = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(4)
    links = [(r.a, r.b) for r in simhash.class_links(classes).collect()]
    at = {f: i for i, f in enumerate(signed)}
    group = list(range(len(fps)))
    for a, b in links:
        x, y = group[at[a]], group[at[b]]
        group = [x if g == y else g for g in group]
    parts = collections.defaultdict(set)
    for i, g in enumerate(group):
        parts[g].add(i)
    truth = collections.defaultdict(set)
    for i, g in enumerate(close_groups(list(range(len(fps))), fps)):
        truth[g].add(i)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, truth.values()))


def test_simhash_blocks_are_a_pigeonhole():
    for n in (4, 5, 6, 7):
        whole = [m % (1 << 64) for m in simhash.masks(n)]
        assert len(whole) == math.comb(n, 3)
        rng = random.Random(n)
        for _ in range(300):
            x = sum(1 << j for j in rng.sample(range(64), 3))
            assert any(x & m == 0 for m in whole)
    assert simhash.blocks_for(0) == simhash.blocks_for(4 << 20) == 4 and simhash.blocks_for(10**9) == 5


def brute_phrases(rows, least, top):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f[lang].update(tuple(w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(30, 2000), (3, 7)])
def test_phrases(docs, none, rows, least, top, monkeypatch):
    monkeypatch.setattr(phrases, "_HELD", 50)
    got = sorted(tuple(r) for r in phrases.phrases(docs, least=least, top=top).collect())
    assert got == brute_phrases(rows, least, top) and got
    assert phrases.phrases(none).count() == 0


def test_phrases_nested_and_exact(spark):
    """A phrase in a longer one that is nearly as frequent goes, one below four fifths stays; counts pass pieces by."""
    texts = ["deep sea fish, deep sea"] * 40 + ["red hot iron", "red hot"] * 40 + ["Red hot\tiron. iron red; hot"] * 10
    rows = [(i, t, "en", None, None, None) for i, t in enumerate(texts)]
    got = sorted(tuple(r) for r in phrases.phrases(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute_phrases(rows, 30, 2000)
    assert {p for _, _, p, *_ in got} == {"deep sea", "deep sea fish", "red hot", "red hot iron"}


def brute_resample(rows, target):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    made = lambda t: [zlib.crc32(w.encode()) % 10000 for w in word.findall((t or "").translate(LOW))]
    each = [made(r[1]) for r in rows]
    s, t = collections.Counter(b for e in each for b in e), collections.Counter(b for x in target for b in made(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + 10000.0) / ((s[b] + 1.0) * (t.total() + 10000.0))))
    out = []
    for r, e in zip(rows, each, strict=True):
        weight = sum(map(gain, e)) // len(e) if e else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(e), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for i, x in enumerate(able[: 10 * len(able) // 100]):
        x[4] = i + 1
    return out


def test_resampling(spark, docs, none, rows):
    more = [(1000 + i, f"{r[1]} w{i}", None, None, None, None) for i, r in enumerate(rows * 6) if r[0] != 10 and r[0] != 11]
    target = spark.createDataFrame([(1, "alpha w3 iota 日本"), (2, None), (None, "BETA beta")], "item_id bigint, text string")
    both = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    want = brute_resample([*rows, *more], ["alpha w3 iota 日本", None, "BETA beta"])
    got = [list(r) for r in resample.resample(both, target).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(x[4] is not None for x in got) > 10
    assert resample.resample(none, target).count() == 0
    empty = resample.resample(docs, target.limit(0))
    assert sorted(map(repr, map(list, empty.collect()))) == sorted(map(repr, brute_resample(rows, [])))


def test_resampling_ties_and_ranges(spark):
    """Rows with one id and one text are ranked one after the other, whatever the ranges."""
    rows = [(7, "w " * 30, None, None, None, None)] * 50 + [(i, "v " * 30, None, None, None, None) for i in range(50)]
    out = resample.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, "w")], "item_id bigint, text string")).where(F.col("rank").isNotNull()).collect()
    want = sorted((x[3], x[0]) for x in brute_resample(rows, ["w"]) if x[4])
    assert sorted(r["rank"] for r in out) == list(range(1, 11)) and sorted((r.score, r.doc_id) for r in out) == want


def test_crc_of_ranges():
    rng = random.Random(1)
    buf = np.frombuffer(bytes(rng.getrandbits(8) for _ in range(5000)), np.uint8)
    start = np.array([0, 5, 5, 100, 4000, 4999, 4999], np.int64)
    end = np.array([1, 5, 69, 165, 4900, 5000, 4999], np.int64)
    assert resample.crc32_ranges(buf, start, end).tolist() == [zlib.crc32(buf[a:z].tobytes()) for a, z in zip(start, end, strict=True)]
    assert len(resample.crc32_ranges(buf, start[:0], end[:0])) == 0 and kernel.NOT_ALNUM[0x60] and not kernel.NOT_ALNUM[0x80]


def test_deduplication_tells_rows_apart(spark, none):
    """Two texts under one id of which one has a near copy, repeated rows, rows without an id, texts without words."""
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, c, d = (say(200) for _ in range(4))
    near = " ".join([*a.split()[:-1], "else"])
    rows = [(5, a), (3, near), (5, b), (7, c), (7, c), (None, c), (None, d), (None, d), (9, ""), (9, None), (None, ""), (8, b)]
    out = jaccard.deduplicate(spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)).collect()
    want = [(3, near), (5, b), (7, c), (None, d), (9, ""), (9, None), (None, "")]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out))) == sorted(map(repr, want)) and out[0].__fields__ == none.columns
    assert jaccard.deduplicate(none).count() == 0
