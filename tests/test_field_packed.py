"""Chains as training holds them: a word that comes again is held once, and written rows say the same."""

import numpy as np
import pyarrow as pa

from maskweave.operators import crf


def test_words_that_look_alike_are_held_once_and_the_gradient_stays():
    dice = np.random.default_rng(5)
    lengths = np.array([4, 1, 30, 7, 30])
    n, word = lengths.sum(), dice.integers(0, 6, lengths.sum())
    look_at, look_x = dice.integers(0, 50, (6, crf.OWN)), dice.normal(size=(6, crf.OWN)).astype(np.float32).astype(float)
    near_at, near_x = dice.integers(0, 50, (n, crf.WIDTH - crf.OWN)), np.ones((n, crf.WIDTH - crf.OWN))
    at, x, y = np.concatenate([look_at[word], near_at], axis=1), np.concatenate([look_x[word], near_x], axis=1), dice.integers(0, 2, n)
    c = crf.packed(at, x, lengths, y)
    assert len(c.own_at) == 6 and c.counts.sum() == n and list(c.counts[:2]) == [5, 4]
    model = crf.Crf(dice.normal(size=50 * 2 + 4), 50)
    # plain: marginals of the unpacked rows, one chain after the other
    scores = model.scores(at, x)
    log_z, p, pairs = crf.marginals(scores, model.moves, lengths)
    want, loss, start = np.zeros((50, 2)), log_z.sum(), 0
    for i in range(n):
        for j in range(2):
            np.add.at(want[:, j], at[i], x[i] * (p[i, j] - (y[i] == j)))
    for m in lengths:
        loss -= sum(scores[start + i, y[start + i]] for i in range(m))
        for i in range(1, m):
            loss -= model.moves[y[start + i - 1], y[start + i]]
            pairs[y[start + i - 1], y[start + i]] -= 1
        start += m
    written = tuple(pa.scalar(v.astype(t).tobytes(), pa.binary()) for v, t in zip(c, crf._KINDS, strict=True))
    for chains in (c, crf._unpacked(written)):
        got, g = crf._gradient(model, chains)
        assert np.isclose(got, loss) and np.allclose(g, np.concatenate([want.ravel(), pairs.ravel()]))
