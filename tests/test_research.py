"""The field of tokens, Gaussian kernels and weighted terms against plain versions."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskweave.operators import anomaly, crf, terms
from maskweave.operators.fourier import FourierFeatures, directions


def chains():
    dice = np.random.default_rng(3)
    lengths = np.array([1, 4, 2, 6, 1, 3])
    return dice.normal(size=(lengths.sum(), 2)), dice.normal(size=(2, 2)), lengths


def paths(scores, moves, lengths):
    """For each chain its rows' start, and (path, score) of every path."""
    start = 0
    for n in lengths:
        s = scores[start : start + n]
        yield start, [(p, sum(s[i, y] for i, y in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product((0, 1), repeat=n)]
        start += n


def test_partition_marginals_and_best_path_equal_all_paths():
    scores, moves, lengths = chains()
    log_z, p, pairs = crf.marginals(scores, moves, lengths)
    best = crf.viterbi(scores, moves, lengths)
    counts = np.zeros((2, 2))
    for k, (start, all_) in enumerate(paths(scores, moves, lengths)):
        z = sum(math.exp(s) for _, s in all_)
        assert math.isclose(log_z[k], math.log(z))
        for i in range(lengths[k]):
            assert math.isclose(p[start + i, 1], sum(math.exp(s) for path, s in all_ if path[i]) / z)
        for path, s in all_:
            for a, b in itertools.pairwise(path):
                counts[a, b] += math.exp(s) / z
        assert tuple(best[start : start + lengths[k]]) == max(all_, key=lambda x: x[1])[0]
    assert np.allclose(pairs, counts)


def test_gradient_equals_differences():
    dice = np.random.default_rng(4)
    lengths, n = np.array([3, 1, 5]), 9
    at, x, y = dice.integers(0, 6, (n, crf.WIDTH)), dice.normal(size=(n, crf.WIDTH)), dice.integers(0, 2, n)
    w = dice.normal(size=6 * 2 + 4)
    _, g = crf.gradient(crf.Crf(w, 6), at, x, lengths, y)
    for i in range(len(w)):
        d = np.eye(len(w))[i] * 1e-5
        slope = (crf.gradient(crf.Crf(w + d, 6), at, x, lengths, y)[0] - crf.gradient(crf.Crf(w - d, 6), at, x, lengths, y)[0]) / 2e-5
        assert math.isclose(g[i], slope, rel_tol=1e-4, abs_tol=1e-6)


def test_descent_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    got = crf.minimised(lambda w: (float(w @ a @ w) / 2 - w.sum(), a @ w - 1), np.zeros(3), 60, enough=1e-14)
    assert np.allclose(got, [1, 0.1, 0.01], atol=1e-4)


def test_field_of_tokens(spark):
    texts = [f"the key is Zq{i}xKw9Tv{i * 7}Lp in {w} now" if i % 2 else f"a word like {w} and some more of it" for i, w in enumerate(["internationalisation", "responsibility", "characteristics"] * 20)]
    rows = spark.createDataFrame([(i, t, i % 2 == 1) for i, t in enumerate(texts)] + [(900, None, False), (901, " ", True)], "id int, text string, s boolean").repartition(3)
    rows = rows.withColumn("words", crf.tokens(F.col("text"))).withColumn("y", crf.labels(F.col("words"), F.col("s")))
    model = crf.train(rows.where("id < 40 OR id >= 900"), buckets=1 << 10, steps=15)
    got = {r.id: r for r in model.tag(rows).collect()}
    assert len(got) == 62 and got[900].tags == [] == got[901].tags
    assert all(len(r.tags) == len(r.words) == len(r.y) for r in got.values())
    r = crf.report(model.tag(rows.where("id >= 40"))).first()
    assert r.tp + r.fn == 10 and r.f1 > 0.9
    empty = rows.limit(0)
    assert model.tag(empty).count() == 0 and crf.report(crf.train(empty, buckets=16, steps=2).tag(rows)).first().tokens > 0


def test_fourier_products_are_near_the_kernel(spark):
    dice = np.random.default_rng(5)
    z = dice.normal(size=(12, 3))
    w, b = directions(3, 4096, 0.3, 7)
    r = np.sqrt(2 / 4096) * np.cos(z @ w.T + b)
    assert np.abs(r @ r.T - np.exp(-0.3 * ((z[:, None] - z[None]) ** 2).sum(axis=2))).max() < 0.06
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(z)], ["id", "z"])
    got = FourierFeatures(inputCol="z", outputCol="r", width=3, features=32, gamma=0.3, seed=9).transform(df).orderBy("id").collect()
    w, b = directions(3, 32, 0.3, 9)
    assert np.allclose([v.r.toArray() for v in got], np.sqrt(2 / 32) * np.cos(z @ w.T + b))


def test_kernel_machine_learns_what_no_line_divides_and_is_saved(spark, tmp_path):
    dice = np.random.default_rng(6)
    rows = []
    for i in range(300):
        v = dice.normal(size=len(anomaly.FEATURES))
        rows.append((*map(float, v), float(v[0] * v[1] > 0), i))
    names = [*anomaly.FEATURES, "label", "id"]
    df = spark.createDataFrame(rows, names).select(F.struct(*anomaly.FEATURES).alias("features"), "label", "id").repartition(2)
    model = anomaly.train(df, kind="svm")
    assert anomaly.report(model, df).first().auc > anomaly.report(anomaly.train(df, kind="lr"), df).first().auc + 0.2
    model.write().overwrite().save(str(tmp_path / "m"))
    again = anomaly.saved(spark, str(tmp_path / "m"))
    want, got = ([r.anomaly_score for r in anomaly.score(df, m).orderBy("id").collect()] for m in (model, again))
    assert np.allclose(want, got) and 0 <= min(got) and max(got) <= 1


def test_terms_equal_a_plain_version(spark):
    texts = ["A token and THE token", "the été_1 été_1 x", None, "", "the token ñandú 2٣ token token", "!!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    counts = [Counter(re.findall(r"\w\w+", (t or "").lower())) for t in texts]
    total = sum(counts, Counter())
    top = sorted(sorted(total), key=lambda w: -total[w])[:4]
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in c for c in counts))) + 1 for w in top}
    want = {}
    for i, c in enumerate(counts):
        w = {k: c[k] * idf[k] for k in top if c[k]}
        norm = math.sqrt(sum(v * v for v in w.values()))
        want |= {(i, k): round(v / norm, 9) for k, v in w.items()}
    model = terms.fit(df, "text", 4)
    assert sorted(terms.terms_of(model)) == sorted(top)
    assert {(r.id, r.term): round(r.weight, 9) for r in terms.weights(model, df, ("id",)).collect()} == want
    assert terms.weights(terms.fit(df.limit(0)), df, ("id",)).count() == 0


def test_terms_are_counted_without_a_row_for_each_text_and_term(spark):
    sc = spark.sparkContext
    words = F.array(*[F.concat(F.lit(f"w{k}x"), (F.col("id") % 7).cast("string")) for k in range(20)])
    for n in (2_000, 16_000):
        df = spark.range(0, n, 1, 2).select(F.concat(F.lit("and and "), F.array_join(words, " ")).alias("text"))
        sc.setJobGroup(f"terms{n}", "")
        got = {r.term: (r.n_rows, r.n) for r in terms.vocabulary(df, size=200).collect()}
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert got == {"and": (n, 2 * n)} | {f"w{k}x{i}": (len(range(i, n, 7)),) * 2 for k in range(20) for i in range(7)}
        stages = {s for j in sc.statusTracker().getJobIdsForGroup(f"terms{n}") for s in sc.statusTracker().getJobInfo(j).stageIds}
        sent = [sc._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages if sc.statusTracker().getStageInfo(s)]
        assert 0 < sum(sent) <= 1_000


@pytest.mark.parametrize("text,want", [(None, (0, 0, 0, 0, 0)), ("", (0, 0, 0, 0, 0)), ("abc d", (1, 0, 2, 0, 0)), ("aaaa, aaaa", (0, 1, 2, 0, 0)), ("id 0123456789ab", (1, 0, 2, 0, 1)), ("aaaaaaaaaaaaaaaaaaaaaaaa", (0, 0, 1, 1, 1))])
def test_flags(spark, text, want):
    r = terms.add_flags(spark.createDataFrame([(text,)], "text string")).first()
    assert tuple(r[k] for k in terms.FLAGS[:5]) == want and terms.ORDER[int(r.context_encoded)] == "natural_language"
