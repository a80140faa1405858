"""Sums over rows of the matrix, and statistics of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..matrix import ContactMatrix, finite, with_chroms
from ..plans.scratch import materialize


def select_pixels(matrix: ContactMatrix, ignore_diags: int = 0, cis: bool = True, trans: bool = True, binarize: bool = False) -> DataFrame:
    """Pixels at `ignore_diags` or more from the diagonal (in bins of the whole genome), of pairs within
    a chromosome, between chromosomes or both; counts as they are or 1 where not zero."""
    px = matrix.pixels
    if ignore_diags:
        px = px.where(F.abs(F.col("bin2_id") - F.col("bin1_id")) >= ignore_diags)
    if not (cis and trans):
        px = with_chroms(px, matrix.bins)
        same = F.col("chrom_id1") == F.col("chrom_id2")
        px = px.where(same if cis else ~same).select("bin1_id", "bin2_id", "count")
    return px.withColumn("count", F.when(F.col("count") != 0, 1.0).otherwise(0.0)) if binarize else px


def marginal(pixels: DataFrame, diagonal_twice: bool = True, value: str | Column = "count") -> DataFrame:
    """(bin_id, marg) of the bins that have pixels: both bins of a pixel get its value, on the diagonal
    twice or once.  One pass and one shuffle: each row is spread to two before the partial sum."""
    ends = F.array("bin1_id", "bin2_id")
    if not diagonal_twice:
        ends = F.when(F.col("bin1_id") == F.col("bin2_id"), F.array("bin1_id")).otherwise(ends)
    v = F.col(value) if isinstance(value, str) else value
    return pixels.select(F.explode(ends).alias("bin_id"), v.alias("v")).groupBy("bin_id").agg(F.sum("v").alias("marg"))


def full_marginal(bins: DataFrame, marg: DataFrame) -> DataFrame:
    return bins.select("bin_id", "chrom_id").join(marg, "bin_id", "left").withColumn("marg", F.coalesce("marg", F.lit(0.0)))


def nonzero_mean_var(marg: DataFrame, *by: str) -> DataFrame:
    m = F.when(F.col("marg") != 0, F.col("marg"))
    return marg.groupBy(*by).agg(F.avg(m).alias("mean"), F.var_pop(m).alias("var"))


def median_and_mad(rows: DataFrame, value: str) -> DataFrame:
    """(median, mad) of a column, both exact."""
    med = rows.agg(F.median(value).alias("median"))
    return rows.crossJoin(F.broadcast(med)).groupBy("median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def in_value_order(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """counts with _part and _inner, written to the shared folder: rows are dealt to ranges of (by, value) by
    splitters that Spark samples, whatever the values' distribution, and _inner is the sum of _n over what is
    before a row in its range.  Written, since a range is only known once it is dealt."""
    ranged = counts.repartitionByRange(*by, value).sortWithinPartitions(*by, value)
    at = ranged.columns.index("_n")
    schema = T.StructType([*ranged.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_inner", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = total + np.cumsum(n)
            total = int(upto[-1]) if len(upto) else total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n)], names=[*b.schema.names, "_part", "_inner"])

    return materialize(ranged.mapInArrow(run, schema), "value-order")


def rows_before(counts: DataFrame, value: str, *by: str) -> DataFrame:
    """counts(value, _n) with _before, the sum of _n over all smaller values, in each group of `by`: within a
    range of values, and over the ranges before by a table of one row for each range and group."""
    placed = in_value_order(counts, value, *by)
    # a range may hold parts of many groups: where a group begins in it is taken off again
    sums = placed.groupBy(*by, "_part").agg(F.sum("_n").alias("_t"), F.min("_inner").alias("_from"))
    upto = F.sum("_t").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = sums.withColumn("_base", F.coalesce(upto, F.lit(0)) - F.col("_from")).drop("_t", "_from")
    return placed.join(base, [*by, "_part"]).withColumn("_before", F.col("_inner") + F.col("_base")).drop("_part", "_inner", "_base")


def average_rank(rows: DataFrame, value: str, name: str = "rank", by: tuple[str, ...] = ()) -> DataFrame:
    """Ranks from 1, ties share their mean, in each group of `by`.  Distinct values are counted first, and
    ordered in ranges of sampled bounds.  The join back has a row a value on one side, so a value that most
    rows hold can be split by Spark on the other."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_n"))
    rank = (F.col("_before") + (F.col("_n") + 1) / 2.0).cast("double")
    return rows.join(rows_before(counts, value, *by).withColumn(name, rank).drop("_n", "_before"), [*by, value])


def rank_nan_last(rows: DataFrame, value: str, ordinal: str) -> DataFrame:
    """The same, with NaN (or null) behind all numbers, each of its own rank in the order of `ordinal`."""
    good = average_rank(rows.where(finite(F.col(value)) | (F.abs(F.col(value)) == float("inf"))), value)
    n = good.agg(F.count("*").alias("_n"))
    bad = rows_before(rows.where(F.col(value).isNull() | F.isnan(value)).withColumn("_n", F.lit(1)), ordinal).drop("_n")
    bad = bad.crossJoin(F.broadcast(n)).withColumn("rank", (F.col("_before") + 1 + F.col("_n")).cast("double")).drop("_n", "_before")
    return good.unionByName(bad)
