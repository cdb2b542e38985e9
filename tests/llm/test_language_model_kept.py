"""What a training window keeps of its steps, and its sums."""

import numpy as np

from gistmill.llm import language_model as lm


def test_kept_states_and_sums_by_token():
    rng = np.random.default_rng(4)
    model = lm.Model(np.arange(1, 400, dtype=np.uint64))
    x, y = (rng.integers(0, 60, (5, 7)).astype(np.int32) for _ in range(2))
    x[1, 3] = lm.END
    h0 = rng.normal(0, 0.3, (5, lm.HIDDEN)).astype(np.float32)
    table = model.p["e"] @ model.p["w"] + model.p["b"]
    kept = [np.full((7, 5, k * lm.HIDDEN), np.nan, np.float32) for k in (1, 2, 1, 1)]
    hs, last = model.steps(x, h0, table, kept)
    plain, end = model.steps(x, h0, table)
    assert np.array_equal(hs, plain) and np.array_equal(last, end)
    assert not any(np.isnan(k).any() for k in kept)
    assert np.array_equal(kept[0][1:][(x.T[1:] != lm.END)], hs[:-1][(x.T[1:] != lm.END)]) and not kept[0][3, 1].any()
    g = model.gradients(x, y, h0)[0]
    assert set(g) == set(model.p) and all(g[k].shape == v.shape for k, v in model.p.items())
    met = np.isin(np.arange(lm.VOCAB), x)
    assert g["e"][met].any(1).all() and not g["e"][~met].any()
    assert np.allclose(g["bc"].sum(), 0, atol=1e-6) and np.allclose(g["bo"].sum(1), 0, atol=1e-6)
