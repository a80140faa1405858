"""Matrices in .cool and .mcool files (HDF5), as a Spark data source.

The driver reads the file's structure; every task gets the places of a run of chunks of the columns it reads
and opens the file for these alone, yielding Arrow batches.  Stored rows and bins can be asked for: bins are
turned to rows by the file's own row index, so other chunks aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..matrix import ContactMatrix
from ..schema import CORE_BIN_COLUMNS, MatrixError
from . import hdf5

#: Fixed values of the format: the attribute of one matrix and of many, the one way of storage, and the group of many.
ONE, MANY, UPPER, RESOLUTIONS = "HDF5::Cooler", "HDF5::MCOOL", "symmetric-upper", "resolutions"
#: Rows of a task and of a batch, about; a task takes whole chunks of its first column.
TASK_ROWS, BATCH_ROWS = 4 << 20, 1 << 17
COLUMNS = {"pixels": {"bin1_id": "bin1_id", "bin2_id": "bin2_id", "count": "count"}, "bin1_offset": {"first_row": "bin1_offset"}, "chrom_offset": {"first_bin": "chrom_offset"}}


def _groups(root: hdf5.Node) -> dict[int | None, str]:
    """The group of each resolution, of old files as well: those number their levels at the root.  None: the
    one matrix of a file that doesn't say its bin size."""
    found = root.attributes().get("format")
    top = root.members()
    if found == MANY:
        return {int(name): f"{RESOLUTIONS}/{name}" for name in root.child(RESOLUTIONS).members()}
    if "chroms" in top:
        return {root.attributes().get("bin-size"): ""}
    out = {}
    for name in sorted((n for n in top if n.isdigit()), key=int):
        level = root.child(name)
        if "chroms" in level.members():
            out[level.attributes().get("bin-size")] = name
    if not out:
        raise MatrixError("no matrix in this file")
    return out


def resolutions(path: str) -> list[int]:
    with hdf5.open_file(path) as f:
        return sorted(r for r in _groups(hdf5.File(f).root()) if r is not None)


def _group(f, resolution: int | None) -> hdf5.Node:
    root = hdf5.File(f).root()
    groups = _groups(root)
    if resolution is None and len(groups) > 1:
        raise MatrixError(f"name one of {sorted(groups)}")
    if resolution is not None and resolution not in groups:
        raise MatrixError(f"{resolution} is none of {sorted(g for g in groups if g is not None)}")
    node = root.child(groups[resolution] if resolution is not None else next(iter(groups.values())))
    for name, want in (("format", ONE), ("storage-mode", UPPER)):
        got = node.attributes().get(name, want)  # old files may lack them
        if got != want:
            raise MatrixError(f"{name} is {got!r}, not {want!r}")
    return node


def _whole(f, node: hdf5.Node, path: str) -> np.ndarray:
    child = node.child(path)
    if child is None:
        raise MatrixError(f"no dataset {path}")
    column = child.column()
    return hdf5.read_rows(f, column, 0, column.rows)


def attributes(path: str, resolution: int | None = None, dataset: str = "") -> dict[str, object]:
    """Attributes of a matrix, or of one of its datasets such as bins/weight; none if it isn't there."""
    with hdf5.open_file(path) as f:
        node = _group(f, resolution).child(dataset)
        return node.attributes() if node else {}


@dataclass
class _Run(InputPartition):
    lo: int
    hi: int
    columns: dict[str, hdf5.Column]


class _CoolReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.table = options["path"], options.get("table", "pixels")
        self.task_rows = int(options.get("task_rows", TASK_ROWS))
        resolution = options.get("resolution")
        with hdf5.open_file(self.path) as f:
            node = _group(f, int(resolution) if resolution else None)
            self.names = _whole(f, node, "chroms/name").tolist()
            if self.table == "bins":
                members = node.child("bins").members()
                wanted = {"chrom_id": "bins/chrom", "start": "bins/start", "end": "bins/end"}
                wanted |= {c: f"bins/{c}" for c in sorted(members) if c not in (*CORE_BIN_COLUMNS, "chrom")}
            elif self.table in COLUMNS:
                folder = "pixels" if self.table == "pixels" else "indexes"
                wanted = {c: f"{folder}/{d}" for c, d in COLUMNS[self.table].items()}
            else:
                raise MatrixError(f"no table {self.table}")
            self.columns = {}
            for name, place in wanted.items():
                child = node.child(place)
                if child is None:
                    raise MatrixError(f"no dataset {place}")
                column = child.column()
                if name == "chrom_id" or column.kind.dtype and not column.kind.text:  # other columns hold numbers
                    self.columns[name] = column
            sizes = {c.rows for c in self.columns.values()}
            if len(sizes) > 1:
                raise MatrixError(f"columns of {self.table} with {sorted(sizes)} rows")
            self.lo, self.hi = 0, sizes.pop()
            if "rows" in options:
                self.lo, self.hi = _bounds(options["rows"], self.hi)
            if "bins" in options:
                index = node.child("indexes/bin1_offset").column()
                first, last = _bounds(options["bins"], index.rows - 1)
                rows = [int(hdf5.read_rows(f, index, k, k + 1)[0]) for k in (first, last)]
                self.lo, self.hi = max(self.lo, rows[0]), min(self.hi, rows[1])

    def fields(self) -> dict[str, str]:
        core = {"bin1_id": "long", "bin2_id": "long", "count": "double", "chrom_id": "int", "start": "int", "end": "int", "first_row": "long", "first_bin": "long"}
        return {"row": "long"} | {c: core.get(c, "double") for c in self.columns}

    def partitions(self):
        step = next(iter(self.columns.values())).step or 1
        rows = max(1, self.task_rows // step) * step
        out, lo = [], self.lo
        while lo < self.hi:
            hi = min(self.hi, (lo // rows + 1) * rows)
            out.append(_Run(lo, hi, {c: col.part(lo, hi) for c, col in self.columns.items()}))
            lo = hi
        return out or [_Run(0, 0, {})]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
        fields = self.fields()
        schema = pa.schema([(c, kinds[k]) for c, k in fields.items()])
        if partition.lo >= partition.hi:
            return
        number = {name: k for k, name in enumerate(self.names)}
        with hdf5.open_file(self.path) as f:
            for lo, hi in _batches(partition):
                arrays = [pa.array(np.arange(lo, hi, dtype=np.int64))]
                for c, column in partition.columns.items():
                    got = hdf5.read_rows(f, column, lo, hi)
                    if got.dtype == object:  # names of chromosomes
                        unknown = set(got) - set(number)
                        if unknown:
                            raise MatrixError(f"bins of unknown chromosomes {sorted(unknown)[:5]}")
                        got = np.array([number[x] for x in got], dtype=np.int32)
                    arrays.append(pa.array(got.astype(kinds[fields[c]].to_pandas_dtype())))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def _batches(run: _Run) -> Iterator[tuple[int, int]]:
    """Stretches of whole chunks of the first column, so that no chunk of it is unpacked twice; of a column
    in one large piece, of BATCH_ROWS."""
    column = next(iter(run.columns.values()))
    rows = max(1, BATCH_ROWS // column.step) * column.step if column.filters else BATCH_ROWS
    lo = run.lo
    while lo < run.hi:
        hi = min(run.hi, (lo // rows + 1) * rows)
        yield lo, hi
        lo = hi


def _bounds(text: str, most: int) -> tuple[int, int]:
    lo, hi = (int(x) for x in text.split(":"))
    if not 0 <= lo <= hi <= most:
        raise MatrixError(f"{text} is not within 0:{most}")
    return lo, hi


class CoolSource(DataSource):
    """spark.read.format("cool").option("table", ...).load(path): a table with the numbers of its stored rows.

    Options: table (pixels, bins, bin1_offset or chrom_offset), resolution, rows ("lo:hi", stored rows), bins
    ("lo:hi", pixels of these rows of the matrix by the file's index), task_rows."""

    @classmethod
    def name(cls):
        return "cool"

    def schema(self):
        return ", ".join(f"`{c}` {k}" for c, k in _CoolReader(self.options).fields().items())

    def reader(self, schema):
        return _CoolReader(self.options)


def read_table(spark: SparkSession, path: str, table: str, resolution: int | None = None, **options: object) -> DataFrame:
    spark.dataSource.register(CoolSource)
    read = spark.read.format("cool").option("table", table)
    for name, value in {"resolution": resolution, **options}.items():
        if value is not None:
            read = read.option(name, str(value))
    return read.load(path)


def stored_pixels(spark: SparkSession, path: str, resolution: int | None = None, rows: tuple[int, int] | None = None, bins: tuple[int, int] | None = None) -> DataFrame:
    """Pixels as stored: of stored rows, of rows of the matrix, or all; only their chunks are read."""
    text = lambda x: None if x is None else f"{x[0]}:{x[1]}"
    return read_table(spark, path, "pixels", resolution, rows=text(rows), bins=text(bins)).drop("row")


def stored_index(spark: SparkSession, path: str, resolution: int | None = None) -> DataFrame:
    """(bin_id, first_row) as the file holds it, to be checked or compared with matrix.bin1_offset."""
    return read_table(spark, path, "bin1_offset", resolution).withColumnRenamed("row", "bin_id")


def open_cool(spark: SparkSession, path: str, resolution: int | None = None) -> ContactMatrix:
    """The matrix of a file, or of a resolution of a file of many.  Further columns of the bins are its weights,
    with their attributes; what is no number there is null."""
    with hdf5.open_file(path) as f:
        node = _group(f, resolution)
        names, lengths = _whole(f, node, "chroms/name"), _whole(f, node, "chroms/length")
        size = node.attributes().get("bin-size")
        kept = {c: node.child(f"bins/{c}").attributes() for c in node.child("bins").members()}
    rows = [(k, str(n), int(length)) for k, (n, length) in enumerate(zip(names, lengths, strict=True))]
    chroms = spark.createDataFrame(rows, "chrom_id int, name string, length int")
    bins = read_table(spark, path, "bins", resolution).withColumnRenamed("row", "bin_id")
    weights = [c for c in bins.columns if c not in CORE_BIN_COLUMNS]
    bins = bins.select(*CORE_BIN_COLUMNS, *(F.when(~F.isnan(c), F.col(c)).alias(c, metadata=kept.get(c, {})) for c in weights))
    return ContactMatrix(chroms, bins, stored_pixels(spark, path, resolution), int(size) if size is not None else None)
