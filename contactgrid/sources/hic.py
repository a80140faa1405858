"""The .hic container: a reader of versions 6 to 9 as a Spark data source, and a writer of version 9.

The reader plans its partitions from the index of blocks, by their bytes, so one pair of chromosomes may be
many tasks; of a region only the blocks are read that can hold any of its cells.  A block is an Arrow batch.
Files are opened through pyarrow's file systems, so a path may be local or in a store those reach.  The writer
makes compressed blocks in parallel, groups bounded by the block grid, and the driver strings them together."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..matrix import ContactMatrix, chrom_offsets, fixed_bins, with_chroms
from ..schema import MatrixError, Region, floor_div

#: Fixed values of the format: the marker, the short that means no value, and the block grid's width.
MAGIC, NO_SHORT, BLOCK_BINS = b"HIC\0", -32768, 1000
#: At most so many bins has the matrix of all chromosomes in a row, whose unit is so many bases.
ALL_BINS, ALL_UNIT = 500, 1000


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


class _Cursor:
    """Reads little-endian values and zero-terminated strings from a place of a file on."""

    def __init__(self, f, at: int = 0, chunk: int = 1 << 16):
        self.f, self.at, self.chunk, self.buffer, self.base = f, at, chunk, b"", at

    def take(self, n: int) -> bytes:
        have = self.at - self.base
        if have + n > len(self.buffer):
            self.f.seek(self.at)
            self.buffer, self.base, have = self.f.read(max(n, self.chunk)), self.at, 0
        out = self.buffer[have : have + n]
        if len(out) < n:
            raise MatrixError("the file ends too early")
        self.at += n
        return out

    def value(self, kind: str):
        return struct.unpack("<" + kind, self.take(struct.calcsize("<" + kind)))[0]

    def text(self) -> str:
        out = bytearray()
        while (c := self.take(1)) != b"\0":
            out += c
        return out.decode("utf-8", "replace")


@dataclass
class Header:
    version: int
    footer: int
    genome: str
    attributes: dict[str, str]
    chroms: list[tuple[str, int]]
    resolutions: list[int]
    records: dict[tuple[int, int], int] = field(default_factory=dict)
    norms: dict[tuple[str, int, int], tuple[int, int]] = field(default_factory=dict)


def read_header(path: str) -> Header:
    with _open(path) as f:
        c = _Cursor(f)
        if c.take(4) != MAGIC:
            raise MatrixError(f"{path} is no .hic file")
        version = c.value("i")
        if not 6 <= version <= 9:
            raise MatrixError(f"version {version}")
        footer, genome = c.value("q"), c.text()
        if version > 8:
            c.value("q"), c.value("q")
        attributes = {c.text(): c.text() for _ in range(c.value("i"))}
        chroms = [(c.text(), c.value("q" if version > 8 else "i")) for _ in range(c.value("i"))]
        h = Header(version, footer, genome, attributes, chroms, [c.value("i") for _ in range(c.value("i"))])
        c = _Cursor(f, footer)
        c.value("q" if version > 8 else "i")
        for _ in range(c.value("i")):
            key, at, _ = c.text(), c.value("q"), c.value("i")
            a, b = (int(x) for x in key.split("_")[:2])
            h.records[a, b] = at
        try:
            _read_norm_index(c, h)
        except MatrixError:
            pass  # older files may end after the index of matrices
        return h


def _read_norm_index(c: _Cursor, h: Header) -> None:
    count, wide = ("q", 4) if h.version > 8 else ("i", 8)
    for normalized in (False, True):
        for _ in range(c.value("i")):
            if normalized:
                c.text()
            c.text(), c.value("i")
            c.at += wide * c.value(count)
            c.at += (4 + wide) * c.value("i")
    for _ in range(c.value("i")):
        kind, chrom, unit, size = c.text(), c.value("i"), c.text(), c.value("i")
        at, n = c.value("q"), c.value(count)
        if unit == "BP":
            h.norms[kind, chrom, size] = (at, n)


def norm_vector(path: str, h: Header, kind: str, chrom: int, resolution: int) -> np.ndarray:
    """A chromosome's divisive weights, cut to its bins.  Raises if there are none or too few."""
    if (kind, chrom, resolution) not in h.norms:
        raise MatrixError(f"no {kind} for chromosome {chrom} at {resolution}")
    at, _ = h.norms[kind, chrom, resolution]
    n_bins = -(-h.chroms[chrom][1] // resolution)
    with _open(path) as f:
        c = _Cursor(f, at)
        n = c.value("q" if h.version > 8 else "i")
        if n < n_bins:
            raise MatrixError(f"{kind} of chromosome {chrom} is cut short")
        return np.frombuffer(c.take(n * (4 if h.version > 8 else 8)), "<f4" if h.version > 8 else "<f8")[:n_bins].astype(float)


def decode_block(data: bytes, version: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, count) of a compressed block; cells without a value are left out."""
    raw = zlib.decompress(data)
    n = struct.unpack_from("<i", raw)[0]
    if version < 7:
        rows = np.frombuffer(raw, np.dtype([("x", "<i4"), ("y", "<i4"), ("c", "<f4")]), n, 4)
        return rows["x"].astype(np.int64), rows["y"].astype(np.int64), rows["c"].astype(float)
    x0, y0, float_counts = struct.unpack_from("<iib", raw, 4)
    at, short_x, short_y = 13, True, True
    if version > 8:
        long_x, long_y = struct.unpack_from("<bb", raw, at)
        short_x, short_y, at = not long_x, not long_y, at + 2
    shape, at = raw[at], at + 1
    value = np.dtype("<f4" if float_counts else "<i2")
    if shape == 2:
        cells, width = struct.unpack_from("<ih", raw, at)
        v = np.frombuffer(raw, value, cells, at + 6)
        ok = ~np.isnan(v) if float_counts else v != NO_SHORT
        k = np.flatnonzero(ok)
        return x0 + k % width, y0 + k // width, v[ok].astype(float)
    if shape != 1:
        raise MatrixError(f"block of an unknown shape {shape}")
    kx, ky = "<i2" if short_x else "<i4", "<i2" if short_y else "<i4"
    wx, wy = np.dtype(kx).itemsize, np.dtype(ky).itemsize
    cell = np.dtype([("x", kx), ("c", value)])
    xs, ys, vs = [], [], []
    rows, at = int(np.frombuffer(raw, ky, 1, at)[0]), at + wy
    for _ in range(rows):
        y, at = int(np.frombuffer(raw, ky, 1, at)[0]), at + wy
        m, at = int(np.frombuffer(raw, kx, 1, at)[0]), at + wx
        part = np.frombuffer(raw, cell, m, at)
        at += m * cell.itemsize
        xs.append(part["x"].astype(np.int64) + x0)
        ys.append(np.full(m, y + y0, dtype=np.int64))
        vs.append(part["c"].astype(float))
    return tuple(np.concatenate(p) if p else np.zeros(0, kind) for p, kind in ((xs, np.int64), (ys, np.int64), (vs, float)))


@dataclass(frozen=True)
class Blocks:
    """The blocks (number, place, bytes) of a pair of chromosomes at a resolution, and their grid."""

    width: int
    columns: int
    banded: bool
    entries: tuple[tuple[int, int, int], ...]

    def near(self, rows: tuple[int, int], cols: tuple[int, int]) -> tuple[tuple[int, int, int], ...]:
        """The blocks that can hold cells (x, y) of rows x cols, both half-open."""
        (x0, x1), (y0, y1) = rows, cols
        if x0 >= x1 or y0 >= y1:
            return ()
        if not self.banded:
            touches = lambda k, lo, hi: k * self.width < hi and (k + 1) * self.width > lo
            return tuple(e for e in self.entries if touches(e[0] % self.columns, x0, x1) and touches(e[0] // self.columns, y0, y1))
        along = [(a + b) // (2 * self.width) for a, b in ((x0, y0), (x1 - 1, y1 - 1))]
        gaps = max(0, y0 - x1 + 1, x0 - y1 + 1), max(abs(x1 - 1 - y0), abs(y1 - 1 - x0))
        deep = [int(math.log2(1 + d / math.sqrt(2) / self.width)) for d in gaps]
        return tuple(e for e in self.entries if along[0] <= e[0] % self.columns <= along[1] and deep[0] <= e[0] // self.columns <= deep[1])


def block_index(f, h: Header, record: int, resolution: int) -> Blocks:
    c = _Cursor(f, record)
    a, b = c.value("i"), c.value("i")
    for _ in range(c.value("i")):
        unit, _, _, _, _, _ = c.text(), *(c.value(k) for k in "iffff")
        size, width, columns, n = (c.value("i") for _ in range(4))
        entries = tuple((c.value("i"), c.value("q"), c.value("i")) for _ in range(n))
        if unit == "BP" and size == resolution:
            return Blocks(width, columns, h.version > 8 and a == b, tuple(e for e in entries if e[2]))
    return Blocks(1, 1, False, ())


@dataclass
class _Part(InputPartition):
    a: int
    b: int
    blocks: tuple[tuple[int, int, int], ...]


def _pair(text: str) -> tuple[int, int]:
    lo, hi = text.split(":")
    return int(lo), int(hi)


class _HicReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.resolution = options["path"], int(options["resolution"])
        self.part_bytes = int(options.get("part_bytes", 16 << 20))
        self.header = read_header(self.path)
        if self.resolution not in self.header.resolutions:
            raise MatrixError(f"{self.resolution} is none of {self.header.resolutions}")
        self.only = _pair(options["pair"]) if "pair" in options else None
        whole = (0, 1 << 62)
        self.rows, self.cols = (_pair(options[k]) if k in options else whole for k in ("rows", "cols"))
        self.all_cells = self.rows == self.cols == whole

    def partitions(self):
        real = lambda k: self.header.chroms[k][0].lower() != "all"
        out = []
        with _open(self.path) as f:
            for (a, b), at in sorted(self.header.records.items()):
                if self.only != (a, b) if self.only else not (real(a) and real(b)):
                    continue
                index = block_index(f, self.header, at, self.resolution)
                blocks = sorted(index.entries if self.all_cells else index.near(self.rows, self.cols), key=lambda e: e[1])
                run, size = [], 0
                for e in blocks:
                    if run and size + e[2] > self.part_bytes:
                        out.append(_Part(a, b, tuple(run)))
                        run, size = [], 0
                    run.append(e)
                    size += e[2]
                if run:
                    out.append(_Part(a, b, tuple(run)))
        return out or [_Part(-1, -1, ())]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        with _open(self.path) as f:
            for _, at, size in partition.blocks:
                f.seek(at)
                x, y, v = decode_block(f.read(size), self.header.version)
                if not self.all_cells:
                    ok = (x >= self.rows[0]) & (x < self.rows[1]) & (y >= self.cols[0]) & (y < self.cols[1])
                    x, y, v = x[ok], y[ok], v[ok]
                ends = (pa.array(np.full(len(x), k, np.int32)) for k in (partition.a, partition.b))
                yield pa.RecordBatch.from_arrays([next(ends), pa.array(x), next(ends), pa.array(y), pa.array(v)], names=["chrom1", "i", "chrom2", "j", "count"])


class HicSource(DataSource):
    """spark.read.format("hic").option("resolution", n).load(path): (chrom1, i, chrom2, j, count).

    Options: resolution; pair ("a:b", numbers of chromosomes in the file), rows and cols ("lo:hi", bins of the
    first and the second of these), part_bytes (of a task's blocks)."""

    @classmethod
    def name(cls):
        return "hic"

    def schema(self):
        return "chrom1 int, i long, chrom2 int, j long, count double"

    def reader(self, schema):
        return _HicReader(self.options)


def open_hic(spark: SparkSession, path: str, resolution: int, norm: str | None = None, region: Region | None = None) -> ContactMatrix:
    """The matrix of a resolution; `norm` adds the file's vectors as a column of the bins.  region: pixels with
    both bins in it alone, read from the blocks that can hold them."""
    h = read_header(path)
    if resolution not in h.resolutions:
        raise MatrixError(f"{resolution} is none of {h.resolutions}")
    spark.dataSource.register(HicSource)
    named = [(k, n, int(length)) for k, (n, length) in enumerate(h.chroms) if n.lower() != "all"]
    chroms = spark.createDataFrame([(i, n, length) for i, (_, n, length) in enumerate(named)], "chrom_id int, name string, length int")
    bins = fixed_bins(chroms, resolution)
    number = spark.createDataFrame([(k, i) for i, (k, _, _) in enumerate(named)], "k int, chrom_id int")
    off = number.join(chrom_offsets(chroms, resolution).select("chrom_id", "first_bin"), "chrom_id")
    read = spark.read.format("hic").option("resolution", resolution)
    if region is not None:
        m = ContactMatrix(chroms, bins, bins.limit(0), resolution)
        chrom, lo, hi = m.extent(region)
        first = off.where(F.col("chrom_id") == chrom).first()
        span = f"{lo - first.first_bin}:{hi - first.first_bin}"
        read = read.option("pair", f"{first.k}:{first.k}").option("rows", span).option("cols", span)
    px = read.load(path)
    for k in (1, 2):
        px = px.join(F.broadcast(off.select(F.col("k").alias(f"chrom{k}"), F.col("first_bin").alias(f"o{k}"))), f"chrom{k}")
    b1, b2 = F.col("o1") + F.col("i"), F.col("o2") + F.col("j")
    px = px.select(F.least(b1, b2).alias("bin1_id"), F.greatest(b1, b2).alias("bin2_id"), "count")
    m = ContactMatrix(chroms, bins, px, resolution)
    if norm:
        values = [(i, p, float(v)) for i, (k, _, _) in enumerate(named) for p, v in enumerate(norm_vector(path, h, norm, k, resolution))]
        w = spark.createDataFrame(values, "chrom_id int, p long, value double").join(off.select("chrom_id", "first_bin"), "chrom_id")
        m = m.set_bin_column(norm, w.select((F.col("first_bin") + F.col("p")).alias("bin_id"), F.when(~F.isnan("value"), F.col("value")).alias("value")))
    return m


def block_number(x: Column, y: Column, cis: Column, columns: Column, width: int = BLOCK_BINS) -> Column:
    """Between chromosomes square tiles; within one bands whose depth doubles with the distance."""
    depth = F.floor(F.log2(1 + F.abs(x - y) / math.sqrt(2) / width)).cast("long")
    return F.when(cis, depth * columns + floor_div(x + y, 2 * width)).otherwise(floor_div(y, width) * columns + floor_div(x, width))


def encode_block(x: np.ndarray, y: np.ndarray, v: np.ndarray) -> bytes:
    """A version 9 block of rows; whole small counts as shorts."""
    x0, y0 = int(x.min()), int(y.min())
    short = bool((v == np.floor(v)).all() and np.abs(v).max() < 32767)
    wide = max(int(x.max()) - x0, int(y.max()) - y0, len(x)) > 32767
    kind = "<i4" if wide else "<i2"
    head = struct.pack("<iiibbbb", len(x), x0, y0, 0 if short else 1, int(wide), int(wide), 1)
    cells = np.zeros(len(x), np.dtype([("x", kind), ("c", "<i2" if short else "<f4")]))
    order = np.lexsort((x, y))
    x, y = x[order] - x0, y[order] - y0
    cells["x"], cells["c"] = x, v[order]
    rows, starts = np.unique(y, return_index=True)
    out = [head, np.array([len(rows)], kind).tobytes()]
    for r, lo, hi in zip(rows, starts, [*starts[1:], len(y)], strict=True):
        out += [np.array([r, hi - lo], kind).tobytes(), cells[lo:hi].tobytes()]
    return zlib.compress(b"".join(out))


def _blocks(m: ContactMatrix) -> DataFrame:
    """(a, b, block, n, total, data): compressed blocks of a resolution, chromosomes numbered from 1."""
    off = chrom_offsets(m.chroms, m.bin_size).select("chrom_id", "first_bin", "n_bins")
    px = with_chroms(m.pixels.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count")), m.bins)
    for k in (1, 2):
        px = px.join(F.broadcast(off.select(F.col("chrom_id").alias(f"chrom_id{k}"), F.col("first_bin").alias(f"o{k}"), F.col("n_bins").alias(f"n{k}"))), f"chrom_id{k}")
    columns = floor_div(F.greatest("n1", "n2"), BLOCK_BINS) + 1
    px = px.select((F.col("chrom_id1") + 1).alias("a"), (F.col("chrom_id2") + 1).alias("b"), (F.col("bin1_id") - F.col("o1")).alias("x"), (F.col("bin2_id") - F.col("o2")).alias("y"), columns.alias("columns"), "count")
    px = px.withColumn("block", block_number(F.col("x"), F.col("y"), F.col("a") == F.col("b"), F.col("columns")))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = f["count"].to_numpy(float)
        data = encode_block(f["x"].to_numpy(int), f["y"].to_numpy(int), v)
        return pd.DataFrame([(f["a"].iloc[0], f["b"].iloc[0], f["columns"].iloc[0], f["block"].iloc[0], len(f), v.sum(), data)], columns=["a", "b", "columns", "block", "n", "total", "data"])

    return px.groupBy("a", "b", "block").applyInPandas(run, "a int, b int, columns long, block long, n long, total double, data binary")


def all_block(m: ContactMatrix) -> tuple[int, int, Row | None]:
    """Length and bin size, in units of ALL_UNIT, of all chromosomes in a row, and its one block (n, total, data):
    bins of the matrix in equal groups, at most ALL_BINS of them."""
    genome, n_bins = m.chroms.agg(F.sum("length")).first()[0], m.bins.count()
    factor = max(1, math.ceil(genome / ALL_BINS / m.bin_size))
    cell = lambda k: floor_div(F.col(f"bin{k}_id"), factor)
    px = m.pixels.groupBy(cell(1).alias("x"), cell(2).alias("y")).agg(F.sum("count").alias("count"))

    def run(f: pd.DataFrame) -> pd.DataFrame:
        v = f["count"].to_numpy(float)
        return pd.DataFrame([(len(f), v.sum(), encode_block(f["x"].to_numpy(int), f["y"].to_numpy(int), v))], columns=["n", "total", "data"])

    found = px.groupBy().applyInPandas(run, "n long, total double, data binary").first()  # a bounded grid
    return n_bins * m.bin_size // ALL_UNIT, max(1, factor * m.bin_size // ALL_UNIT), found


def write_hic(levels: dict[int, ContactMatrix], path: str, genome: str = "unknown", attributes: dict[str, str] | None = None, norms: dict[str, dict[int, list[np.ndarray]]] | None = None) -> None:
    """A version 9 file on the driver's file system of matrices that share their chromosomes.

    The finest gives the matrix of all chromosomes in a row.  norms: name -> resolution -> one vector of divisive
    weights a chromosome.  Blocks come to the driver
    one partition at a time; it keeps their places alone."""
    sizes = sorted(levels, reverse=True)
    any_ = levels[sizes[0]]
    chroms = [(r.name, r.length) for r in any_.chroms.orderBy("chrom_id").collect()]
    text = lambda s: s.encode() + b"\0"
    places: dict[tuple[int, int], dict[int, list]] = {}
    all_length, all_size, whole = all_block(levels[sizes[-1]])
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<i", 9))
        footer_at = f.tell()
        f.write(struct.pack("<q", 0) + text(genome) + struct.pack("<qq", 0, 0))
        f.write(struct.pack("<i", len(attributes or {})) + b"".join(text(k) + text(v) for k, v in (attributes or {}).items()))
        f.write(struct.pack("<i", len(chroms) + 1) + text("All") + struct.pack("<q", all_length))
        f.write(b"".join(text(n) + struct.pack("<q", length) for n, length in chroms))
        f.write(struct.pack("<i", len(sizes)) + struct.pack(f"<{len(sizes)}i", *sizes) + struct.pack("<i", 0))
        for size in sizes:
            for r in _blocks(levels[size]).repartitionByRange("a", "b").sortWithinPartitions("a", "b", "block").toLocalIterator():
                places.setdefault((r.a, r.b), {}).setdefault(size, []).append((r.block, f.tell(), len(r.data), r.n, r.total, r.columns))
                f.write(r.data)
        if whole is not None:
            places[0, 0] = {all_size: [(0, f.tell(), len(whole.data), whole.n, whole.total, 1)]}
            f.write(whole.data)
        index = []
        for (a, b), by_size in sorted(places.items(), key=lambda p: (p[0] == (0, 0), p[0])):
            at = f.tell()
            body = struct.pack("<iii", a, b, len(by_size))
            for z, size in enumerate(sizes if a else [all_size]):
                if size in by_size:
                    blocks = sorted(by_size[size])
                    body += text("BP") + struct.pack("<iffffiiii", z, sum(x[4] for x in blocks), sum(x[3] for x in blocks), 0, 0, size, BLOCK_BINS, blocks[0][5], len(blocks))
                    body += b"".join(struct.pack("<iqi", x[0], x[1], x[2]) for x in blocks)
            f.write(body)
            index.append(text(f"{a}_{b}") + struct.pack("<qi", at, len(body)))
        vectors = []
        for kind, by_size in (norms or {}).items():
            for size, per_chrom in by_size.items():
                for k, v in enumerate(per_chrom, 1):
                    data = struct.pack("<q", len(v)) + np.asarray(v, "<f4").tobytes()
                    vectors.append(text(kind) + struct.pack("<i", k) + text("BP") + struct.pack("<iqq", size, f.tell(), len(data)))
                    f.write(data)
        footer = f.tell()
        body = struct.pack("<i", len(index)) + b"".join(index) + struct.pack("<i", 0)
        f.write(struct.pack("<q", len(body)) + body + struct.pack("<i", 0))
        norm_at = f.tell()
        tail = struct.pack("<i", len(vectors)) + b"".join(vectors)
        f.write(tail)
        f.seek(footer_at)
        f.write(struct.pack("<q", footer) + text(genome) + struct.pack("<qq", norm_at, len(tail)))
