"""Integrity checks: one row of issues for each fault found, by table scans and equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..matrix import bin1_offset, finite


def _issue(rows: DataFrame, check: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), detail.alias("detail"))


def issues(chroms: DataFrame, bins: DataFrame, pixels: DataFrame, attributes: dict[str, int] | None = None) -> DataFrame:
    """(check, detail); empty if the matrix is sound.  attributes: nchroms, nbins and nnz as declared."""
    s = lambda c: F.col(c).cast("string")
    found = [
        _issue(chroms.where("length is null or length < 0"), "chrom_length", F.col("name")),
        _issue(chroms.groupBy("name").count().where("count > 1"), "chrom_duplicate", F.col("name")),
        _issue(chroms.agg(F.count("*").alias("n")).where("n = 0"), "chrom_none", F.lit("0")),
    ]
    own = bins.join(chroms.select("chrom_id", "length"), "chrom_id", "left")
    found += [
        _issue(own.where("length is null"), "bin_chrom", s("bin_id")),
        _issue(own.where("start < 0 or end <= start"), "bin_interval", s("bin_id")),
        _issue(own.where("end > length"), "bin_beyond", s("bin_id")),
    ]
    w = Window.partitionBy("chrom_id").orderBy("bin_id")
    order = bins.withColumn("before", F.lag("start").over(w)).withColumn("last_id", F.lag("bin_id").over(w))
    found += [
        _issue(order.where("start <= before"), "bin_order", s("bin_id")),
        _issue(order.where("bin_id <> last_id + 1"), "chrom_split", s("bin_id")),
    ]
    n = bins.agg(F.coalesce(F.max("bin_id") + 1, F.lit(0)).alias("n"))
    px = pixels.crossJoin(F.broadcast(n))
    cell = F.concat_ws(",", s("bin1_id"), s("bin2_id"))
    found += [
        _issue(px.where("bin1_id > bin2_id"), "pixel_lower", cell),
        _issue(px.where("bin1_id < 0 or bin2_id < 0 or bin1_id >= n or bin2_id >= n"), "pixel_range", cell),
        _issue(px.where(~finite(F.col("count"))), "pixel_count", cell),
    ]
    for name, table in (("nchroms", chroms), ("nbins", bins), ("nnz", pixels)):
        if attributes and name in attributes:
            found.append(_issue(table.agg(F.count("*").alias("n")).where(F.col("n") != attributes[name]), name, s("n")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def index_issues(stored: DataFrame, bins: DataFrame, pixels: DataFrame) -> DataFrame:
    """(check, detail): bins whose entry in a stored row index (bin_id, first_row) is missing, repeated, wrong or
    of no bin.  The index has one entry more than there are bins."""
    right = bin1_offset(bins, pixels).withColumnRenamed("first_row", "_right")
    held = stored.groupBy("bin_id").agg(F.min("first_row").alias("_low"), F.max("first_row").alias("_high"), F.count("*").alias("_n"))
    same = (F.col("_low") == F.col("_right")) & (F.col("_high") == F.col("_right")) & (F.col("_n") == 1)
    both = right.join(held, "bin_id", "full_outer").where(~F.coalesce(same, F.lit(False)))
    return _issue(both, "bin1_offset", F.col("bin_id").cast("string"))


def at_most(found: DataFrame, limit: int = 20) -> DataFrame:
    """The first issues of every check: the first of 64 parts of each, then of those."""
    part = F.pmod(F.xxhash64("detail"), F.lit(64))
    for by in (Window.partitionBy("check", part), Window.partitionBy("check")):
        found = found.withColumn("_k", F.row_number().over(by.orderBy("detail"))).where(F.col("_k") <= limit).drop("_k")
    return found
