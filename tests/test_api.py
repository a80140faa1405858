import os

import pytest

from contactgrid import api
from contactgrid.schema import MatrixError
from contactgrid.sources import layout
from contactgrid.sources.contacts import toy_matrix


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("api") / "m")
    layout.write_matrix(toy_matrix(spark, domains=4, width=10), path)
    return path


def test_zoom_check_and_convert(spark, stored, tmp_path):
    out = str(tmp_path / "levels")
    assert api.zoomify(spark, stored, out, (200, 400)) == [100, 200, 400]
    assert api.check(spark, out).count() == 0
    levels = {r: api.open_matrix(spark, out, r) for r in (100, 200)}
    levels = {r: m.set_bin_column("weight", m.bins.selectExpr("bin_id", "0.5 as value")) for r, m in levels.items()}
    api.to_hic(levels, str(tmp_path / "x.hic"), weights=["weight"])
    back = api.open_matrix(spark, str(tmp_path / "x.hic"), 100, "weight")
    assert back.pixels.count() == levels[100].pixels.count() and {r.weight for r in back.bins.collect()} == {2.0}
    for bad in ({"resolution": None}, {"resolution": 300}):
        with pytest.raises(MatrixError):
            api.open_matrix(spark, str(tmp_path / "x.hic"), **bad)


def test_normalize_and_dump(spark, stored, tmp_path):
    m = api.open_matrix(spark, stored)
    done = api.normalize(m, "vc")
    assert done.bins.where("weight > 0").count() == 80
    done = api.normalize(m, "ice", max_iters=1, tol=0.0, policy="store_nan")
    assert done.bins.where("weight is not null").count() == 0
    assert api.normalize(m, "ice", max_iters=1, tol=0.0, policy="discard").bin_columns() == []
    with pytest.raises(MatrixError):
        api.normalize(m, "ice", max_iters=1, tol=0.0, policy="error")
    api.dump(api.normalize(m, "vc"), str(tmp_path / "t"), "toy1:0-300", "weight", True)
    rows = [r.value.split("\t") for r in spark.read.text(str(tmp_path / "t")).collect()]
    assert len(rows) == 3 and all(len(r) == 7 for r in rows)


def test_columns_keep_their_attributes(spark, stored, tmp_path):
    m = api.open_matrix(spark, stored)
    assert not api.normalized(m) and m.column_attributes("weight") == {}
    with pytest.raises(MatrixError):
        api.weight_lines(m)
    m = api.normalize(m, "ice", max_iters=2, tol=1e9, mad_max=0, min_nnz=0, cis_only=True)
    kept = m.column_attributes("weight")
    assert kept["cis_only"] == 1 and kept["converged"] == [1.0, 1.0] and len(kept["scale"]) == 2 and m.divisive("weight") is False
    layout.write_matrix(m, str(tmp_path / "m"))
    back = api.open_matrix(spark, str(tmp_path / "m"))
    assert back.column_attributes("weight") == kept and api.normalized(back)
    odd = back.set_bin_column("mine", back.bins.selectExpr("bin_id", "if(bin_id = 3, null, 0.5) as value"), {"divisive_weights": 1})
    assert odd.divisive("mine") is True and odd.divisive("other") is None and odd.divisive("KR") is True
    assert [r.value for r in api.weight_lines(odd, "mine").orderBy("bin_id").limit(5).collect()] == ["0.5", "0.5", "0.5", "", "0.5"]


def test_stored_indexes_are_checked(spark, tmp_path):
    path = str(tmp_path / "m")
    layout.write_matrix(toy_matrix(spark, domains=4, width=10), path)
    assert layout.stored_rows(spark, path, 5, 5).count() == 0 and layout.stored_rows(spark, path, 0, 10**6).count() == 1560
    rows = layout.stored_rows(spark, path, 7, 19).orderBy("row").collect()
    assert [r.row for r in rows] == list(range(7, 19)) and rows == sorted(rows, key=lambda r: (r.bin1_id, r.bin2_id))
    with pytest.raises(MatrixError):
        layout.indexed_rows(spark, path, 0, 10**6)
    assert api.check(spark, path).count() == 0
    spark.createDataFrame([(0, 0, 40), (1, 41, 40)], "chrom_id int, first_bin long, n_bins long").write.mode("overwrite").parquet(f"{path}/indexes/chrom_offset")
    assert [(r.check, r.detail) for r in api.check(spark, path).collect()] == [("chrom_offset", "1")]


def test_scratch_tables_are_removed(spark):
    from contactgrid.plans import scratch

    kept = scratch.materialize(spark.range(3), "some")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and scratch.clear(spark) >= 1 and not os.path.exists(path) and scratch.clear(spark) == 0


def test_load(spark, tmp_path):
    (tmp_path / "d.txt").write_text("1 2\n0 3\n")
    m = api.load(spark, str(tmp_path / "d.txt"), str(tmp_path / "out"), "c", 20, 10)
    assert sorted(map(tuple, m.pixels.collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)]
    with pytest.raises(MatrixError):
        api.load(spark, str(tmp_path / "d.txt"), str(tmp_path / "no"), "c", 90, 10)


def test_callers(spark, stored):
    with pytest.raises(MatrixError):
        api.call_tads(api.open_matrix(spark, stored), "none")
