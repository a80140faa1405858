import pytest

from contactgrid import matrix as M
from contactgrid.functions.ranks import average_ranks, ranksum_p
from contactgrid.operators import compare
from contactgrid.schema import MatrixError


@pytest.fixture(scope="module")
def pair(spark):
    chroms = spark.createDataFrame([(0, "c", 40)], "chrom_id int, name string, length int")
    px = lambda v: spark.createDataFrame([(k, k + 1, x) for k, x in enumerate(v)], "bin1_id long, bin2_id long, count double")
    return [M.ContactMatrix(chroms, M.fixed_bins(chroms, 10), px(v), 10) for v in ((1.0, 2.0, 3.0), (3.0, 1.0, 2.0))]


@pytest.mark.parametrize("metric", ["scc", "pearson", "spearman"])
def test_hand_case(pair, metric):
    assert abs(compare.compare(*pair, metric).first().value + 0.5) < 1e-12


def test_self_is_one(pair):
    out = {(r.label_i, r.label_j): r.value for r in compare.compare_all({"a": pair[0], "b": pair[0]}, "pearson").collect()}
    assert len(out) == 4 and all(abs(v - 1) < 1e-12 for v in out.values())


def test_different_binnings(pair):
    from dataclasses import replace

    with pytest.raises(MatrixError):
        compare.compare(pair[0], replace(pair[1], bin_size=20))


def test_smoothing(spark, pair):
    px = spark.createDataFrame([(0, 1, 1.0)], "bin1_id long, bin2_id long, count double")
    bins = pair[0].bins.where("bin_id < 2")
    assert {r.v for r in compare.smoothed(px, bins, 1).collect()} == {0.25}


def test_ranks():
    assert average_ranks([2, 2, 8]).tolist() == [1.5, 1.5, 3]
    assert average_ranks([float("nan"), 1, float("nan")]).tolist() == [2, 1, 3]
    assert abs(ranksum_p([1, 2, 3], [1, 2, 3]) - 1) < 1e-12
    assert ranksum_p(list(range(30)), list(range(100, 130))) < 1e-9


def test_downsampling_is_set_by_its_seed(spark, pair):
    px = spark.createDataFrame([(0, k, float(k)) for k in range(1, 200)], "bin1_id long, bin2_id long, count double")
    a, b = (sorted(map(tuple, compare.downsample(px, 0.5, 3).collect())) for _ in range(2))
    assert a == b
    assert abs(sum(r[2] for r in a) / sum(range(1, 200)) - 0.5) < 0.03 and all(r[2] <= r[1] for r in a)
