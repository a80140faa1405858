"""Matrices on disk: Parquet folders for one or many resolutions, and text tables.

A matrix is a folder with chroms/, bins/, pixels/, indexes/ and meta/ (one row: format, version, bin type
and size, counts).  Pixels are range-partitioned and sorted by their first bin, so row-group statistics prune
region queries.  indexes/files has a row for each file of pixels, with its first stored row, its number of rows
and its first bins; indexes/bin1_offset the stored rows before each bin's.  By them a slice of stored rows opens
only the files that hold it, and both can be checked against the pixels.  A folder of many resolutions holds resolution=<size>/.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.formats import format_count
from ..matrix import ContactMatrix, annotate, bin1_offset, canonical, chrom_offsets
from ..schema import MatrixError

FORMAT, VERSION = "contact-matrix", 1


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _children(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_matrix(matrix: ContactMatrix, path: str, merge: bool = True, mode: str = "errorifexists") -> None:
    """Pixels become upper-triangle, summed by pair if `merge`; bins out of range are refused."""
    spark = matrix.chroms.sparkSession
    px = canonical(matrix.pixels, merge)
    n = matrix.bins.count()
    bad = px.where((F.col("bin1_id") < 0) | (F.col("bin2_id") >= n)).first()
    if bad is not None:
        raise MatrixError(f"pixel ({bad.bin1_id}, {bad.bin2_id}) of {n} bins")
    matrix.chroms.write.mode(mode).parquet(f"{path}/chroms")
    matrix.bins.write.mode(mode).parquet(f"{path}/bins")
    _delete(spark, *(f"{path}/bins.v{v}" for v in _bin_versions(spark, path)))
    px.repartitionByRange("bin1_id").sortWithinPartitions("bin1_id", "bin2_id").write.mode(mode).parquet(f"{path}/pixels")
    stored = spark.read.parquet(f"{path}/pixels")
    file_index(stored).coalesce(1).write.mode(mode).parquet(f"{path}/indexes/files")
    bin1_offset(matrix.bins, stored).repartitionByRange("bin_id").sortWithinPartitions("bin_id").write.mode(mode).parquet(f"{path}/indexes/bin1_offset")
    matrix.bins.groupBy("chrom_id").agg(F.min("bin_id").alias("first_bin"), F.count("*").alias("n_bins")).coalesce(1).write.mode(mode).parquet(f"{path}/indexes/chrom_offset")
    nnz = stored.count()
    meta = [(FORMAT, VERSION, "fixed" if matrix.bin_size else "variable", matrix.bin_size, "symmetric-upper", matrix.chroms.count(), n, nnz)]
    schema = "format string, version int, bin_type string, bin_size long, storage string, nchroms long, nbins long, nnz long"
    spark.createDataFrame(meta, schema).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def file_index(stored: DataFrame) -> DataFrame:
    """(file, first_row, n_rows, first_bin, last_bin) of stored pixels, whose files follow each other by their
    first bins: a row for each file."""
    files = stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"), F.min("bin1_id").alias("first_bin"), F.max("bin1_id").alias("last_bin"))
    before = F.coalesce(F.sum("n_rows").over(Window.orderBy("first_bin", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("file", before.cast("long").alias("first_row"), "n_rows", "first_bin", "last_bin")


def stored_rows(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """(row, bin1_id, bin2_id, count): the stored rows [lo, hi) of the pixels, numbered in the order of the bins.
    Only the files that hold some of them are opened."""
    index = spark.read.parquet(f"{path}/indexes/files").where((F.col("first_row") < hi) & (F.col("first_row") + F.col("n_rows") > lo) & (F.lit(lo) < hi))
    files = {r.file: r.first_row for r in index.collect()}
    if not files:
        return spark.read.parquet(f"{path}/pixels").select(F.lit(0).cast("long").alias("row"), "bin1_id", "bin2_id", "count").limit(0)
    some = spark.read.parquet(*(f"{path}/pixels/{name}" for name in files))
    first = spark.createDataFrame(list(files.items()), "file string, first_row long")
    rows = some.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("k")).join(F.broadcast(first), "file")
    row = F.col("first_row") + F.col("k")
    return rows.where((row >= lo) & (row < hi)).select(row.alias("row"), "bin1_id", "bin2_id", "count")


def indexed_rows(spark: SparkSession, path: str, first_bin: int, last_bin: int) -> DataFrame:
    """Pixels whose first bin is in [first_bin, last_bin), found by the stored row index."""
    ends = {r.bin_id: r.first_row for r in spark.read.parquet(f"{path}/indexes/bin1_offset").where(F.col("bin_id").isin(first_bin, last_bin)).collect()}
    if first_bin not in ends or last_bin not in ends:
        raise MatrixError(f"bins {first_bin} to {last_bin} are not in the index of {path}")
    return stored_rows(spark, path, ends[first_bin], ends[last_bin]).drop("row")


def index_issues(spark: SparkSession, path: str) -> DataFrame:
    """(check, detail): entries of the stored indexes that don't agree with the stored pixels."""
    from ..operators.validate import index_issues

    stored = spark.read.parquet(f"{path}/pixels")
    out = index_issues(spark.read.parquet(f"{path}/indexes/bin1_offset"), spark.read.parquet(_bins_path(spark, path)), stored)
    bins = spark.read.parquet(_bins_path(spark, path))
    chroms = bins.groupBy("chrom_id").agg(F.min("bin_id").alias("first_bin"), F.count("*").alias("n_bins"))
    for name, right, key in (("files", file_index(stored), "file"), ("chrom_offset", chroms, "chrom_id")):
        held = spark.read.parquet(f"{path}/indexes/{name}")
        wrong = right.exceptAll(held).unionByName(held.exceptAll(right)).select(F.col(key).cast("string").alias("detail")).distinct()
        out = out.unionByName(wrong.select(F.lit(name).alias("check"), "detail"))
    return out


def read_matrix(spark: SparkSession, path: str) -> ContactMatrix:
    if not _exists(spark, f"{path}/meta"):
        raise MatrixError(f"no matrix at {path}")
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta.format != FORMAT or meta.version > VERSION or meta.storage != "symmetric-upper":
        raise MatrixError(f"{path}: {meta.format} {meta.version}, {meta.storage}")
    tables = (spark.read.parquet(p) for p in (f"{path}/chroms", _bins_path(spark, path), f"{path}/pixels"))
    return ContactMatrix(*tables, meta.bin_size)


def attributes(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(f"{path}/meta").first().asDict()


def write_resolutions(levels: dict[int, ContactMatrix], path: str, overwrite: bool = False) -> None:
    """Adds resolutions; one that is there already is refused unless it may be overwritten."""
    spark = next(iter(levels.values())).chroms.sparkSession
    have = set(resolutions(spark, path)) if _exists(spark, path) else set()
    if have & set(levels) and not overwrite:
        raise MatrixError(f"there already: {sorted(have & set(levels))}")
    for size, m in sorted(levels.items()):
        write_matrix(m, f"{path}/resolution={size}", mode="overwrite" if overwrite else "errorifexists")


def resolutions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(c.split("=", 1)[1]) for c in _children(spark, path) if c.startswith("resolution="))


def open_matrix(spark: SparkSession, path: str, resolution: int | None = None) -> ContactMatrix:
    """A matrix of one resolution, or one of many; it must be named if there is more than one."""
    if _exists(spark, f"{path}/meta"):
        m = read_matrix(spark, path)
        if resolution is not None and resolution != m.bin_size:
            raise MatrixError(f"{path} holds {m.bin_size}")
        return m
    have = resolutions(spark, path) if _exists(spark, path) else []
    if not have:
        raise MatrixError(f"no matrix at {path}")
    if resolution is None and len(have) > 1:
        raise MatrixError(f"name one of {have}")
    size = have[0] if resolution is None else resolution
    if size not in have:
        raise MatrixError(f"{size} is none of {have}")
    return read_matrix(spark, f"{path}/resolution={size}")


def _bin_versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions of the bins beside the first; the last one counts."""
    found = (int(c[6:]) for c in _children(spark, path) if c.startswith("bins.v") and c[6:].isdigit())
    return sorted(v for v in found if _exists(spark, f"{path}/bins.v{v}/_SUCCESS"))


def _bins_path(spark: SparkSession, path: str) -> str:
    versions = _bin_versions(spark, path)
    return f"{path}/bins.v{versions[-1]}" if versions else f"{path}/bins"


def update_bin_column(spark: SparkSession, path: str, matrix: ContactMatrix) -> None:
    """Writes changed bins as a version of their own, which counts once it is complete: a loss on the way
    leaves the bins as they were.  The version before stays for those who have it open."""
    versions = _bin_versions(spark, path)
    new = versions[-1] + 1 if versions else 1
    matrix.bins.write.mode("overwrite").parquet(f"{path}/bins.v{new}")
    _delete(spark, *(f"{path}/bins.v{v}" for v in versions[:-1]))


def pixel_text(matrix: ContactMatrix, pixels: DataFrame | None = None, coordinates: bool = False, weight: str | None = None) -> DataFrame:
    """(value, bin1_id, bin2_id): tab-separated lines to be written in the order of the bins, with bin ids
    or coordinates, and raw or balanced counts."""
    px = matrix.pixels if pixels is None else pixels
    if weight:
        if weight not in matrix.bins.columns:
            raise MatrixError(f"no column {weight}")
        from ..operators.balance import apply_weights

        px = apply_weights(ContactMatrix(matrix.chroms, matrix.bins, px, matrix.bin_size), weight, bool(matrix.divisive(weight)))
        px = px.select("bin1_id", "bin2_id", F.coalesce("balanced", F.lit(float("nan"))).alias("count"))
    left = ["bin1_id", "bin2_id"]
    if coordinates:
        px, left = annotate(matrix, px), ["chrom1", "start1", "end1", "chrom2", "start2", "end2"]
    return px.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in left), format_count(F.col("count"))).alias("value"), "bin1_id", "bin2_id")


def write_pixel_text(lines: DataFrame, path: str) -> None:
    lines.repartitionByRange("bin1_id", "bin2_id").sortWithinPartitions("bin1_id", "bin2_id").select("value").write.text(path)


def dense_text(matrix: ContactMatrix, chrom_id: int) -> DataFrame:
    """(i, value): a chromosome's matrix, one tab-separated line a row."""
    from ..matrix import dense, submatrix

    row = chrom_offsets(matrix.chroms, matrix.bin_size).where(F.col("chrom_id") == chrom_id).first()
    span = (row.first_bin, row.first_bin + row.n_bins)
    cells = dense(submatrix(matrix.pixels, span, span), span, span)
    flat = cells.select("i", F.posexplode("values").alias("j", "v")).select("i", "j", format_count(F.col("v")).alias("s"))
    lines = flat.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "s"))).alias("a"))
    return lines.select("i", F.array_join(F.transform("a", lambda x: x["s"]), "\t").alias("value"))
