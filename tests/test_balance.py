import json
import math
import os

import pytest

from contactgrid import matrix as M
from contactgrid.operators.balance import BalanceParams, balance, mad_mask, tile, weighted_marginal

#: A matrix, eight sets of options and the weights that established tools give for them.
DATA = json.load(open(os.path.join(os.path.dirname(__file__), "data", "balance.json")))


@pytest.fixture(scope="module")
def matrix(spark):
    chroms = spark.createDataFrame([(k, *c) for k, c in enumerate(DATA["chroms"])], "chrom_id int, name string, length int")
    px = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in DATA["pixels"]], "bin1_id long, bin2_id long, count double")
    return M.ContactMatrix(chroms, M.fixed_bins(chroms, DATA["bin_size"]), px, DATA["bin_size"])


@pytest.mark.parametrize("name", [c["name"] for c in DATA["cases"]])
def test_known_weights(spark, matrix, name):
    case = next(c for c in DATA["cases"] if c["name"] == name)
    p = BalanceParams(**{k: case[k] for k in ("cis_only", "trans_only", "ignore_diags", "mad_max", "min_nnz", "min_count", "tol", "rescale", "max_iters")})
    black = spark.createDataFrame([(b,) for b in case["blacklist"]], "bin_id long") if case["blacklist"] else None
    out, stats = balance(matrix, p, blacklist=black)
    got = {r.bin_id: r.weight for r in out.collect()}
    for k, want in enumerate(case["bias"]):
        if want is None or math.isnan(want):
            assert got[k] is None
        else:
            assert math.isclose(got[k], want, rel_tol=1e-9)
    if not isinstance(case["scale"], list):
        assert math.isclose(stats.scale[0], case["scale"], rel_tol=1e-9) and stats.converged == [case["converged"]]


def test_mad_readings_differ(spark):
    rows = [(k, 0, 1000.0 + k) for k in range(20)] + [(20 + k, 1, 1.0 + k / 50) for k in range(20)]
    marg = spark.createDataFrame(rows, "bin_id long, chrom_id int, marg double")
    low = lambda flag: {r.bin_id for r in mad_mask(marg, 1, flag).collect() if r.low}
    assert low(False) != low(True)


def test_tiles_move_once(spark, matrix):
    """Marginals by tiles of any size are those of the pixels, and a round has no exchange of the tiles."""
    n = matrix.bins.count()
    w = {k: (0.0 if k % 7 == 3 else 0.1 + k % 5) for k in range(n)}
    weights = spark.createDataFrame(list(w.items()), "bin_id long, w double")
    want = {}
    for r in matrix.pixels.collect():
        for k in (r.bin1_id, r.bin2_id):
            want[k] = want.get(k, 0.0) + r["count"] * w[r.bin1_id] * w[r.bin2_id]
    want = {k: v for k, v in want.items() if v}
    for blocks, most in ((1, 10**6), (3, 5), (64, 1)):
        tiles = tile(matrix.pixels, n, blocks, most)
        assert tiles.cells.agg({"tile": "count"}).first()[0] == tiles.index.count()
        got = {r.bin_id: r.marg for r in weighted_marginal(tiles, weights).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = weighted_marginal(tiles, weights)._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    scan = next(k for k, line in enumerate(plan) if "ExistingRDD" in line and "cells" in line)
    join = max(k for k, line in enumerate(plan[:scan]) if "Join" in line)
    assert not any("Exchange" in line for line in plan[join:scan]), plan
