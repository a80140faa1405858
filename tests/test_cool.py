"""Files of the .cool and .mcool layouts, written byte by byte, read back."""

import math
import random

import pytest
from hdf5_bytes import Writer
from pyspark.errors import AnalysisException

from contactgrid import matrix as M
from contactgrid.operators import validate
from contactgrid.schema import MatrixError
from contactgrid.sources import cool

CHROMS = [("chr1", 1050), ("chr2", 620), ("x", 90)]
SIZE = 100
BINS = [(c, s, min(s + SIZE, n)) for c, (_, n) in enumerate(CHROMS) for s in range(0, n, SIZE)]
PIXELS = sorted({(min(a, b), max(a, b)) for a, b in (((k * 7) % 19, (k * 5 + k // 19) % 19) for k in range(150))})
COUNTS = [1.0 + (k * 13) % 17 for k in range(len(PIXELS))]
WEIGHTS = [math.nan if k % 5 == 3 else 0.5 + k for k in range(len(BINS))]
OFFSETS = [sum(a < k for a, _ in PIXELS) for k in range(len(BINS) + 1)]


def matrix_group(w, size=SIZE, version=3, chunk=16, filters=("shuffle", "deflate"), chrom="enum", extra=(), counts="<i4"):
    column = lambda values, dtype, **kw: w.dataset(values, dtype, chunk=chunk, filters=filters, **kw)
    names = [n for n, _ in CHROMS]
    if chrom == "enum":
        ids = column([c for c, _, _ in BINS], "<i4", enum=True)
    else:
        ids = w.dataset([names[c] for c, _, _ in BINS], chrom)
    wide = "<i8" if version == 1 else "<i4"
    bins = {"chrom": ids, "start": column([s for _, s, _ in BINS], wide), "end": column([e for _, _, e in BINS], wide)}
    bins["weight"] = w.dataset(WEIGHTS, "<f8", attributes=[("scale", 2.5), ("ignore_diags", 2)])
    pixels = {"bin1_id": column([a for a, _ in PIXELS], "<i8"), "bin2_id": w.dataset([b for _, b in PIXELS], ">i4", chunk=11), "count": column(COUNTS, counts)}
    chroms = {"name": w.dataset(names, "S5" if chrom != "vlen" else "vlen"), "length": w.dataset([n for _, n in CHROMS], wide, layout="compact")}
    indexes = {"bin1_offset": column(OFFSETS, "<i8"), "chrom_offset": w.dataset([0, 11, 18, 19], "<i8")}
    groups = {k: w.group(v) for k, v in {"bins": bins, "pixels": pixels, "chroms": chroms, "indexes": indexes}.items()}
    return w.group(groups, [("bin-size", size), *extra])


ATTRIBUTES = [("format", "HDF5::Cooler"), ("format-version", 3), ("storage-mode", "symmetric-upper")]


def check(m):
    assert [tuple(r) for r in m.chroms.orderBy("chrom_id").collect()] == [(k, n, length) for k, (n, length) in enumerate(CHROMS)]
    assert [tuple(r)[:4] for r in m.bins.orderBy("bin_id").collect()] == [(k, *b) for k, b in enumerate(BINS)]
    assert [r.weight for r in m.bins.orderBy("bin_id").collect()] == [None if math.isnan(x) else x for x in WEIGHTS]
    assert sorted(map(tuple, m.pixels.collect())) == [(a, b, c) for (a, b), c in zip(PIXELS, COUNTS, strict=True)]


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("filters", [("shuffle", "deflate", "fletcher"), ("deflate",), ()])
@pytest.mark.parametrize("chrom", ["enum", "S8", "vlen"])
def test_one_matrix(spark, tmp_path, new, filters, chrom):
    w = Writer(new)
    path = str(tmp_path / "a.cool")
    w.finish(path, matrix_group(w, filters=filters, chrom=chrom, version=1 if chrom != "enum" else 3, extra=ATTRIBUTES, counts="<f8" if new else "<i4"))
    m = cool.open_cool(spark, path)
    assert m.bin_size == SIZE
    check(m)
    assert m.column_attributes("weight") == {"scale": 2.5, "ignore_diags": 2} and m.divisive("weight") is False
    assert cool.attributes(path)["format-version"] == 3
    assert cool.attributes(path, dataset="bins/weight") == {"scale": 2.5, "ignore_diags": 2} and cool.attributes(path, dataset="bins/none") == {}


def test_many_and_old_layouts(spark, tmp_path):
    w = Writer()
    path = str(tmp_path / "a.mcool")
    levels = w.group({str(r): matrix_group(w, r, extra=ATTRIBUTES) for r in (100, 2000)})
    w.finish(path, w.group({"resolutions": levels}, [("format", "HDF5::MCOOL")]))
    assert cool.resolutions(path) == [100, 2000]
    check(cool.open_cool(spark, path, 100))
    for bad in (None, 300):
        with pytest.raises(MatrixError):
            cool.open_cool(spark, path, bad)
    old = str(tmp_path / "old.mcool")
    w = Writer()
    w.finish(old, w.group({str(k): matrix_group(w, r, 1, chrom="S9") for k, r in enumerate((2000, 100))}))
    assert cool.resolutions(old) == [100, 2000]
    m = cool.open_cool(spark, old, 2000)
    assert m.bin_size == 2000
    check(m)


def test_refused(spark, tmp_path):
    for k, extra in enumerate(([("format", "HDF5::Other")], [("storage-mode", "square")])):
        w, path = Writer(), str(tmp_path / f"{k}.cool")
        w.finish(path, matrix_group(w, extra=extra))
        with pytest.raises(MatrixError):
            cool.open_cool(spark, path)
    (tmp_path / "no.cool").write_bytes(b"text" * 200)
    with pytest.raises(MatrixError):
        cool.open_cool(spark, str(tmp_path / "no.cool"))
    w, path = Writer(), str(tmp_path / "cut.cool")
    w.finish(path, matrix_group(w))
    (tmp_path / "cut.cool").write_bytes(bytes(w.out[: len(w.out) // 2]))
    with pytest.raises((MatrixError, AnalysisException)):
        cool.open_cool(spark, path)


def test_chunks_runs_and_the_row_index(spark, tmp_path):
    w, path = Writer(), str(tmp_path / "a.cool")
    w.finish(path, matrix_group(w, chunk=4))
    whole = cool.read_table(spark, path, "pixels", task_rows=8)
    assert whole.rdd.getNumPartitions() == -(-len(PIXELS) // 8)
    rows = [tuple(r) for r in whole.orderBy("row").collect()]
    assert rows == [(k, a, b, c) for k, ((a, b), c) in enumerate(zip(PIXELS, COUNTS, strict=True))]
    some = cool.stored_pixels(spark, path, rows=(5, 14))
    assert sorted(map(tuple, some.collect())) == [r[1:] for r in rows[5:14]]
    reader = cool._CoolReader({"path": path, "bins": "4:7", "task_rows": "4"})
    of_bins = [r for p in reader.partitions() for b in reader.read(p) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert of_bins == [r for r in rows if 4 <= r[1] < 7]
    held = {c for p in reader.partitions() for c in p.columns["bin1_id"].chunks}
    assert all(c.start < OFFSETS[7] and c.start + 4 > OFFSETS[4] for c in held)
    assert cool.stored_pixels(spark, path, bins=(6, 6)).collect() == []
    with pytest.raises(AnalysisException, match="not within"):
        cool.stored_pixels(spark, path, rows=(5, 10_000))
    m = cool.open_cool(spark, path)
    assert sorted(map(tuple, cool.stored_index(spark, path).collect())) == sorted(map(tuple, M.bin1_offset(m.bins, m.pixels).collect()))
    assert validate.index_issues(cool.stored_index(spark, path), m.bins, m.pixels).collect() == []
    bad = cool.stored_index(spark, path).selectExpr("bin_id", "first_row + if(bin_id = 7, 3, 0) as first_row").where("bin_id <> 9")
    assert sorted(map(tuple, validate.index_issues(bad, m.bins, m.pixels).collect())) == [("bin1_offset", "7"), ("bin1_offset", "9")]


def test_missing_chunks_and_single_ones(tmp_path):
    from contactgrid.sources import hdf5

    rng = random.Random(2)
    values = [rng.randint(-9, 9) for _ in range(50)]
    for new in (False, True):
        w, path = Writer(new), str(tmp_path / f"{new}.h5")
        root = {"a": w.dataset(values, "<i2", chunk=7, filters=("shuffle", "deflate"), drop=(0, 3)), "none": w.dataset([], "<f4", chunk=4), "u": w.dataset([v % 65536 for v in values[:5]], ">u2", layout="compact")}
        root |= {f"one{len(f)}": w.dataset(values, "<i8", chunk=64, filters=f, layout="single") for f in ((), ("deflate",))}
        w.finish(path, w.group(root))
        with hdf5.open_file(path) as f:
            top = hdf5.File(f).root()
            read = lambda n, lo, hi: hdf5.read_rows(f, top.child(n).column(), lo, hi).tolist()
            assert read("a", 3, 40) == [0 if k // 7 in (0, 3) else values[k] for k in range(3, 40)]
            assert read("none", 0, 0) == [] and read("u", 0, 5) == [v % 65536 for v in values[:5]]
            assert read("one0", 4, 33) == values[4:33] == read("one1", 4, 33)
            assert top.child("a/b") is None and top.child("b") is None
