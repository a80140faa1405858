"""Shared plumbing of the training-data operators: scratch tables, columns, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import shared_dir

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it back: cuts the lineage, and what is read
    again survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hp, True)


def parts(batches: Iterable[pa.RecordBatch], column: int, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about `most` bytes of a text column, or one row: Spark bounds a batch by its
    rows, and what a task makes of the texts should not grow with their length."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over `edges`, for every node on an edge.

    Alternating large-star and small-star rounds.  A round is a partial aggregate (the minimum of
    each node's neighbours) and a plain equi-join back, so a hub of any degree is summed on the map
    side and its join partition can be split.  The edge list is written to the shared folder after
    every round.  Null ends and loops are ignored; no edges give an empty table.  Raises if
    `max_rounds` don't suffice (the number needed grows with the logarithm of the longest path)."""
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        """e has u > v.  large: every node's larger neighbours move to the smallest neighbour;
        small: every node's smaller neighbours and itself do."""
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            low = low.select("u", F.least("u", "m").alias("m"))
            moved = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = both.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
        return moved.where("u <> v").distinct()

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = e.where("u is not null and v is not null and u <> v").distinct()
    old: list[str] = []
    seen = None
    for _ in range(max_rounds):
        path = scratch(spark, "edges")
        e.write.parquet(path)
        e = spark.read.parquet(path)
        n, mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, old)
        old = [path]
        if (n, mark) == seen or not n:
            break
        seen = (n, mark)
        e = star(star(e, True), False)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
