import json
import os

import numpy as np

from contactgrid.functions.optimize import anneal, forward_gradient, lbfgs
from contactgrid.operators import objective as O
from contactgrid.sources.contacts import toy_matrix

#: The stages of the normalisation of the matrix of known(), as established tools have them.
DATA = json.load(open(os.path.join(os.path.dirname(__file__), "data", "object_weights.json")))


def known():
    i, j = np.triu_indices(40)
    return i, j, np.exp(-(j - i) / 3.0) * (50.0 + (7 * i + 13 * j) % 100)


def test_known_stages():
    i, j, v = known()
    marg = O.marginal(40, i, j, v)
    w, valid = O.start_weights(marg)
    assert np.allclose(w, DATA["ini_weights"], rtol=1e-9) and valid.tolist() == DATA["valid_cols"]
    ed = O.expected(*O.distance_sums(40, i, j, v, marg > 0, 200), 10, 400.0)
    assert np.flatnonzero(~np.isnan(ed))[-1] == DATA["maxd"]
    want = np.array([np.nan if x is None else x for x in DATA["ed"]], float)[: DATA["maxd"] + 1]
    assert np.allclose(ed[: DATA["maxd"] + 1], want, rtol=1e-9, equal_nan=True)
    assert O.windows(4_000_000, 100_000, 200 * 100_000) == [tuple(x) for x in DATA["windows"]]


def test_small_pieces():
    assert O.marginal(3, np.array([0, 0, 1]), np.array([1, 0, 2]), np.array([5.0, 2, 3])).tolist() == [7, 8, 3]
    assert O.combined({(0, 2): np.array([1.0, 3]), (1, 3): np.array([5.0, 7])}, 3).tolist() == [1, 4, 7]
    assert O.run_windows(np.array([2, 3, 4, 9, 10, 11]), 10, 1000) == [(2, 4), (9, 11)]


def test_minimisers():
    f = lambda x: (x[0] - 1) ** 2 + (x[1] + 2) ** 2
    assert np.allclose(lbfgs(forward_gradient(f), np.zeros(2))[0], [1, -2], atol=1e-3)
    rough = lambda x: float((x**2 + 10 - 10 * np.cos(2 * np.pi * x)).sum())
    x, value = anneal(rough, np.full(3, -5.0), np.full(3, 5.0), np.full(3, 3.2), rounds=400)
    assert value < 1e-3
    assert anneal(rough, np.full(2, -5.0), np.full(2, 5.0), np.ones(2), 5)[1] == anneal(rough, np.full(2, -5.0), np.full(2, 5.0), np.ones(2), 5)[1]


def test_weights_are_positive(spark):
    m = toy_matrix(spark, domains=4, width=10)
    out = O.normalize(m, O.ObjectiveParams(window=40, rounds=5, min_nnz=5), chroms=["toy1"]).orderBy("bin_id").collect()
    assert len(out) == 80 and all(r.weight == 0 for r in out[40:])
    assert sum(r.weight is not None and r.weight > 0 for r in out[:40]) > 30
