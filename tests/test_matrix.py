import math

import pytest

from contactgrid import matrix as M
from contactgrid.functions.formats import format_count, g16
from contactgrid.operators import coarsen, intervals, validate
from contactgrid.schema import MatrixError, Region, weight_is_divisive
from contactgrid.sources import contacts


@pytest.fixture(scope="module")
def small(spark):
    chroms = spark.createDataFrame([(0, "chr1", 250_000), (1, "chr2", 100_000)], "chrom_id int, name string, length int")
    px = spark.createDataFrame([(0, 0, 1.0), (0, 3, 2.0), (2, 2, 3.0)], "bin1_id long, bin2_id long, count double")
    return M.ContactMatrix(chroms, M.fixed_bins(chroms, 100_000), px, 100_000)


def test_bins_and_offsets(small):
    assert [(r.bin_id, r.start, r.end) for r in small.bins.orderBy("bin_id").collect()] == [(0, 0, 100_000), (1, 100_000, 200_000), (2, 200_000, 250_000), (3, 0, 100_000)]
    assert [r.first_bin for r in M.chrom_offsets(small.chroms, 100_000).orderBy("chrom_id").collect()] == [0, 3]
    assert [r.first_row for r in M.bin1_offset(small.bins, small.pixels).orderBy("bin_id").collect()] == [0, 2, 2, 3, 3]


def test_regions(small):
    assert Region.parse(" chr1 ") == Region("chr1") and Region.parse("chr1:5-") == Region("chr1", 5, None) and Region.parse("c:1-2") == Region("c", 1, 2)
    for bad in ("", "chr1:", "chr1:5", "chr1:a-b", "chr1:1,000-2,000", "chr1:9-5", "chr1:-5"):
        with pytest.raises(MatrixError):
            Region.parse(bad)
    assert small.extent(Region.parse("chr1:50000-150000")) == (0, 0, 2)
    assert small.extent(Region.parse("chr2")) == (1, 3, 4)
    assert small.extent(Region("chr1", 100_000, 100_000))[1:] == (1, 1)
    for bad in (Region("chr9"), Region("chr1", 0, 250_001)):
        with pytest.raises(MatrixError):
            small.extent(bad)


def test_bin_columns_and_names(small, spark):
    m = small.set_bin_column("w", small.bins.selectExpr("bin_id", "2.0 as value"))
    assert m.bin_columns() == ["w"] and m.drop_bin_column("w").bin_columns() == []
    for name in ("start", "none"):
        with pytest.raises(MatrixError):
            m.drop_bin_column(name)
    assert {r.name for r in small.rename_chroms({"chr1": "one"}).chroms.collect()} == {"one", "chr2"}
    for bad in ({"chr9": "x"}, {"chr1": ""}, {"chr1": "chr2"}):
        with pytest.raises(MatrixError):
            small.rename_chroms(bad)


def test_coarsening_keeps_chromosomes_apart(small):
    got = sorted(map(tuple, coarsen.coarsen(small, 2).pixels.collect()))
    assert got == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 3.0)]


def test_levels_of_a_known_matrix(spark):
    import json
    import os

    # A matrix and its coarser levels.
    d = json.load(open(os.path.join(os.path.dirname(__file__), "data", "zoom.json")))
    chroms = spark.createDataFrame([(k, *c) for k, c in enumerate(d["chroms"])], "chrom_id int, name string, length int")
    px = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in d["pixels"]], "bin1_id long, bin2_id long, count double")
    m = M.ContactMatrix(chroms, M.fixed_bins(chroms, d["bin_size"]), px, d["bin_size"])
    levels = coarsen.zoom(m, [lv["resolution"] for lv in d["levels"] if lv["resolution"] > d["bin_size"]])
    for lv in d["levels"]:
        assert sorted(map(tuple, levels[lv["resolution"]].pixels.collect())) == sorted((a, b, float(c)) for a, b, c in lv["pixels"])


def test_progressions():
    assert coarsen.nice_resolutions(1000, 100_000) == [1000, 2000, 5000, 10_000, 20_000, 50_000, 100_000]
    assert coarsen.pow2_resolutions(1000, 8000) == [1000, 2000, 4000, 8000]
    assert coarsen.targets(10_000, 10, (40, 20)) == [10, 20, 40]
    for bad in ((20, 20), (5,), (15,)):
        with pytest.raises(MatrixError):
            coarsen.targets(10_000, 10, bad)


def test_dense_text(spark):
    def px(*lines):
        return sorted(map(tuple, contacts.dense_text_pixels(spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")).collect()))

    assert px("1 0 2", "", "3 4 5", "6 0 7") == [(0, 0, 1.0), (0, 2, 2.0), (1, 1, 4.0), (1, 2, 5.0), (2, 2, 7.0)]
    for bad in (("1 2", "3"), ("1 x", "2 3"), ("", " ")):
        with pytest.raises(MatrixError):
            px(*bad)


def test_intervals(spark, small):
    iv = spark.createDataFrame([("chr1", 150_000, 210_000), ("chr2", 5, 6), ("chr1", 7, 7)], "chrom string, start long, end long")
    assert sorted(r.bin_id for r in intervals.overlapping_bins(small, iv).collect()) == [1, 2, 3]
    with pytest.raises(MatrixError):
        intervals.overlapping_bins(small, spark.createDataFrame([("no", 1, 2)], "chrom string, start long, end long"))


def test_validation(small, spark):
    assert validate.issues(small.chroms, small.bins, small.pixels).count() == 0
    px = small.pixels.union(spark.createDataFrame([(3, 1, 1.0), (0, 9, 1.0), (1, 1, math.nan)], "bin1_id long, bin2_id long, count double"))
    found = validate.issues(small.chroms, small.bins, px, {"nnz": 3})
    assert sorted(r.check for r in found.collect()) == ["nnz", "pixel_count", "pixel_lower", "pixel_range"]
    assert validate.at_most(found.union(found), 1).count() == 4


def test_formats(spark):
    values = [0.0, 1.0, -3.0, 0.1, 1e16, 1 / 3, 1e-7, 123456.789, math.inf, -math.inf, math.nan]
    assert [g16(v) for v in values] == ["0", "1", "-3", "0.1", "1e+16", "0.3333333333333333", "1e-07", "123456.789", "inf", "-inf", "nan"]
    frame = spark.createDataFrame([(v,) for v in values[:8]], "v double")
    assert [r.s for r in frame.select(format_count(frame.v).alias("s")).collect()] == [g16(v) for v in values[:8]]
    assert weight_is_divisive("KR") is True and weight_is_divisive("weight") is False and weight_is_divisive("x") is None and weight_is_divisive("KR", 0) is False
