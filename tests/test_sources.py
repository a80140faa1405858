import struct
import zlib

import numpy as np
import pytest

from contactgrid.operators.coarsen import coarsen
from contactgrid.schema import MatrixError
from contactgrid.sources import hic, layout
from contactgrid.sources.contacts import read_bed, toy_matrix
from contactgrid.streaming import incremental


@pytest.fixture(scope="module")
def toy(spark):
    return toy_matrix(spark, domains=4, width=10)


def cells(m):
    return sorted(map(tuple, m.pixels.select("bin1_id", "bin2_id", "count").collect()))


def test_layout_round_trip(spark, toy, tmp_path):
    path = str(tmp_path / "m")
    layout.write_matrix(toy, path)
    back = layout.open_matrix(spark, path)
    assert cells(back) == cells(toy) and back.bin_size == 100
    assert layout.attributes(spark, path)["nnz"] == len(cells(toy))
    layout.update_bin_column(spark, path, back.set_bin_column("w", back.bins.selectExpr("bin_id", "0.5 as value")))
    assert layout.read_matrix(spark, path).bin_columns() == ["w"]
    with pytest.raises(MatrixError):
        layout.open_matrix(spark, str(tmp_path / "none"))
    with pytest.raises(MatrixError):
        layout.write_matrix(toy.with_pixels(toy.pixels.selectExpr("bin1_id", "bin2_id + 500 as bin2_id", "count")), str(tmp_path / "bad"))


def test_many_resolutions(spark, toy, tmp_path):
    path = str(tmp_path / "many")
    layout.write_resolutions({100: toy, 200: coarsen(toy, 2)}, path)
    assert layout.resolutions(spark, path) == [100, 200]
    assert layout.open_matrix(spark, path, 200).bin_size == 200
    for bad in (None, 300):
        with pytest.raises(MatrixError):
            layout.open_matrix(spark, path, bad)
    with pytest.raises(MatrixError):
        layout.write_resolutions({100: toy}, path)


def test_text(spark, toy, tmp_path):
    lines = layout.pixel_text(toy, toy.pixels.where("bin1_id = 0 and bin2_id < 3"), coordinates=True)
    layout.write_pixel_text(lines, str(tmp_path / "t"))
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())
    assert got == ["toy1\t0\t100\ttoy1\t100\t200\t50", "toy1\t0\t100\ttoy1\t200\t300\t50"]
    rows = [r.value.split("\t") for r in layout.dense_text(toy, 0).orderBy("i").collect()]
    assert len(rows) == 40 and rows[0][:3] == ["0", "50", "50"] and rows[3][0] == "50"
    (tmp_path / "b.bed").write_text("track x\nchr1 5 9 name\nchr1\t7\n\nchr2\t1\t2\n")
    assert sorted(map(tuple, read_bed(spark, str(tmp_path / "b.bed")).collect())) == [("chr1", 5, 9), ("chr2", 1, 2)]


def test_hic_round_trip(spark, toy, tmp_path):
    path = str(tmp_path / "x.hic")
    px = toy.pixels.unionByName(spark.createDataFrame([(3, 60, 1.5), (0, 0, 7.0)], "bin1_id long, bin2_id long, count double"))
    m = toy.with_pixels(px)
    norms = {"KR": {100: [np.arange(1, 41), np.arange(2, 42)]}}
    hic.write_hic({100: m, 200: coarsen(m, 2)}, path, "g", {"made": "here"}, norms)
    h = hic.read_header(path)
    assert h.version == 9 and h.resolutions == [200, 100] and h.attributes == {"made": "here"} and [c[0] for c in h.chroms] == ["All", "toy1", "toy2"]
    back = hic.open_hic(spark, path, 100, "KR")
    assert cells(back) == cells(m)
    assert [r.KR for r in back.bins.orderBy("bin_id").limit(3).collect()] == [1.0, 2.0, 3.0]
    assert cells(hic.open_hic(spark, path, 200)) == cells(coarsen(m, 2))
    with pytest.raises(MatrixError):
        hic.open_hic(spark, path, 300)
    with pytest.raises(MatrixError):
        hic.norm_vector(path, h, "VC", 1, 100)


def test_hic_parts_and_regions(spark, tmp_path):
    """A hot pair of chromosomes is many tasks; a region is read from the blocks that can hold it alone."""
    from contactgrid.matrix import ContactMatrix, fixed_bins
    from contactgrid.schema import Region

    rng = np.random.default_rng(3)
    chroms = spark.createDataFrame([(0, "a", 90_000), (1, "b", 30_000)], "chrom_id int, name string, length int")
    at = np.sort(np.concatenate([rng.integers(0, 9000, (6000, 2)), rng.integers(0, 12_000, (2000, 2))]), axis=1)
    rows = sorted({(int(x), int(y)): float(k % 9 + 1) for k, (x, y) in enumerate(at)}.items())
    px = spark.createDataFrame([(*p, v) for p, v in rows], "bin1_id long, bin2_id long, count double")
    m = ContactMatrix(chroms, fixed_bins(chroms, 10), px, 10)
    path = str(tmp_path / "y.hic")
    hic.write_hic({10: m}, path)
    assert cells(hic.open_hic(spark, path, 10)) == cells(m)
    reader = hic._HicReader({"path": path, "resolution": "10", "part_bytes": "3000"})
    parts = reader.partitions()
    assert sum((p.a, p.b) == (1, 1) for p in parts) > 5 and len(parts) > len({(p.a, p.b) for p in parts})
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(rows)
    assert all(len(p.blocks) == 1 or sum(e[2] for e in p.blocks) <= 3000 for p in parts)
    opened = []
    for text, lo, hi in (("a:5000-9000", 500, 900), ("a:0-90000", 0, 9000), ("b:1000-1010", 9100, 9101), ("a:40000-40000", 4000, 4000), ("a:20000-60000", 2000, 6000)):
        region = Region.parse(text)
        assert cells(hic.open_hic(spark, path, 10, region=region)) == cells(m.with_pixels(m.block(region)))
        first, k = (0, 1) if text[0] == "a" else (9000, 2)
        some = {"path": path, "resolution": "10", "pair": f"{k}:{k}", "rows": f"{lo - first}:{hi - first}", "cols": f"{lo - first}:{hi - first}"}
        opened.append(sum(len(p.blocks) for p in hic._HicReader(some).partitions()))
    every = sum(len(p.blocks) for p in hic._HicReader({"path": path, "resolution": "10", "pair": "1:1"}).partitions())
    assert opened[0] < every / 4 and opened[1] == every and opened[3] == 0


def test_all_chromosomes_in_a_row(spark, toy, tmp_path):
    path = str(tmp_path / "z.hic")
    hic.write_hic({100: toy, 200: coarsen(toy, 2)}, path)
    h = hic.read_header(path)
    assert h.chroms[0] == ("All", 8) and (0, 0) in h.records
    reader = hic._HicReader({"path": path, "resolution": "100", "pair": "0:0"})
    reader.resolution = 1  # its own, in thousands of bases
    got = sorted((x, y, v) for p in reader.partitions() for b in reader.read(p) for x, y, v in zip(*(b.column(k).to_pylist() for k in (1, 3, 4)), strict=True))
    assert got == cells(toy)  # few bins: groups of one
    big = toy.with_pixels(toy.pixels)
    length, size, block = hic.all_block(hic.ContactMatrix(spark.createDataFrame([(0, "c", 10_000_000)], "chrom_id int, name string, length int"), big.bins, big.pixels, 100))
    assert size == 20 and length == 8 and block.total == sum(c[2] for c in cells(toy))  # groups of 200 bins


def test_block_shapes():
    dense = struct.pack("<iiibb", 4, 10, 20, 0, 2) + struct.pack("<ih4h", 4, 2, 1, -32768, 3, 4)
    assert [a.tolist() for a in hic.decode_block(zlib.compress(dense), 8)] == [[10, 10, 11], [20, 21, 21], [1, 3, 4]]
    plain = struct.pack("<i", 2) + struct.pack("<iif", 1, 2, 0.5) + struct.pack("<iif", 3, 4, 2)
    assert [a.tolist() for a in hic.decode_block(zlib.compress(plain), 6)] == [[1, 3], [2, 4], [0.5, 2]]
    rng = np.random.default_rng(0)
    for v in (rng.integers(1, 9, 50).astype(float), rng.uniform(0, 1, 50).astype(np.float32).astype(float)):
        x, y = rng.permutation(90_000)[:50], rng.integers(0, 300, 50)
        got = sorted(zip(*(a.tolist() for a in hic.decode_block(hic.encode_block(x, y, v), 9)), strict=True))
        assert got == sorted(zip(x.tolist(), y.tolist(), v.tolist(), strict=True))


def test_streamed_contacts_sum_up(spark, tmp_path):
    chroms = spark.createDataFrame([(0, "c", 1000)], "chrom_id int, name string, length int")
    rows = [(0, k * 37 % 1000, 0, k * 91 % 1000) for k in range(300)]
    frame = spark.createDataFrame(rows, "chrom1 int, pos1 long, chrom2 int, pos2 long")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.streaming_pixels(stream, chroms, 100).writeStream.outputMode("complete").format("memory").queryName("px").start()
    q.processAllAvailable()
    q.stop()
    from contactgrid.sources.contacts import bin_contacts

    assert sorted(map(tuple, spark.table("px").collect())) == sorted(map(tuple, bin_contacts(frame, chroms, 100).collect()))


def test_datasets_and_pictures():
    from contactgrid.functions import heatmap
    from contactgrid.sources.contacts import parse_datasets

    assert parse_datasets("res:10\n a:x/y\nres:20\nb: z:1\n") == [(10, "a", "x/y"), (20, "b", "z:1")]
    for bad in ("", "a:x", "res:10\nb"):
        with pytest.raises(MatrixError):
            parse_datasets(bad)
    assert heatmap.tsv(["a", "b"], np.eye(2)).splitlines()[1] == "a\t1.0000\t0.0000"
    picture = heatmap.png(np.array([[1.0, -0.5], [np.nan, 0]]), cell=2)
    assert picture[:8] == b"\x89PNG\r\n\x1a\n" and picture.endswith(b"IEND\xaeB`\x82")
