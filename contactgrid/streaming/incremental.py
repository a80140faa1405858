"""Matrices from streams of contacts: pixels summed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.contacts import bin_contacts


def streaming_pixels(contacts: DataFrame, chroms: DataFrame, bin_size: int) -> DataFrame:
    """The running matrix of a stream of contacts(chrom1, pos1, chrom2, pos2): a stateful sum by pair, to
    be written in update or complete mode.  State is as large as the matrix has pixels."""
    return bin_contacts(contacts, chroms, bin_size)


def windowed_pixels(contacts: DataFrame, chroms: DataFrame, bin_size: int, time: str, width: str, late: str) -> DataFrame:
    """A matrix for each window of time; late contacts within the watermark still count."""
    from ..matrix import chrom_offsets
    from ..schema import floor_div

    off = chrom_offsets(chroms, bin_size).select("chrom_id", "first_bin")
    c = contacts.withWatermark(time, late)
    for k in (1, 2):
        c = c.join(F.broadcast(off.select(F.col("chrom_id").alias(f"chrom{k}"), F.col("first_bin").alias(f"off{k}"))), f"chrom{k}")
    b1, b2 = (F.col(f"off{k}") + floor_div(F.col(f"pos{k}"), bin_size) for k in (1, 2))
    return c.groupBy(F.window(time, width), F.least(b1, b2).alias("bin1_id"), F.greatest(b1, b2).alias("bin2_id")).agg(F.count("*").cast("double").alias("count"))


def append_batch(path: str):
    """A writer for foreachBatch: each micro-batch's pixels go to a folder of its own number, so a batch
    that is run again replaces itself; reading sums the batches."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def summed_batches(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))
