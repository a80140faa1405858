"""Steps that must hold for any distribution of values: ranks, pairs by distance."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactgrid.operators import bands, marginals


@pytest.mark.parametrize("block", [8, 64, 1 << 14])
def test_valid_pairs_as_counted(spark, block):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for chrom in range(4):
        pos = np.flatnonzero(rng.random(200) < (0.2, 0.9, 0.5, 0.0)[chrom])
        rows += [(chrom, int(p)) for p in pos]
        for a in pos:
            for b in pos[pos >= a]:
                want[int(b - a)] = want.get(int(b - a), 0) + 1
    frame = spark.createDataFrame(rows, "chrom_id int, pos long")
    assert {r.d: r.pairs for r in bands.valid_pairs(frame, block).collect()} == want


def test_valid_pairs_of_many_gaps(spark):
    """Every other of 100,000 bins: 50,000 runs of one."""
    frame = spark.range(0, 100_000, 2).select(F.lit(0).alias("chrom_id"), F.col("id").alias("pos"))
    began = time.time()
    got = {r.d: r.pairs for r in bands.valid_pairs(frame).collect()}
    assert time.time() - began < 30
    assert got == {d: 50_000 - d // 2 for d in range(0, 100_000, 2)}


def test_ranks_of_crowded_values(spark):
    """A million distinct values within one per cent, one that a third of the rows hold, and groups of any size: the
    ranges are even, and ranks are those of a sort."""
    n = 1_000_000
    value = F.when(F.col("id") % 3 == 0, 1.0005).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(1 << 52)) / float(1 << 52) / 100)
    rows = spark.range(n).select("id", F.when(F.col("id") % 1000 < 990, "big").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("by"), value.alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = rows.groupBy("by", "v").agg(F.count("*").alias("_n"))
        parts = [r["count"] for r in marginals.in_value_order(counts, "v", "by").groupBy("_part").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(parts) < 1.5 * sum(parts) / len(parts)
    got = marginals.average_rank(rows, "v", by=("by",)).toPandas()
    want = got.groupby("by")["v"].rank(method="average")
    assert len(got) == n and (got["rank"] == want).all()


def test_ranks_of_nothing_and_ties(spark):
    frame = spark.createDataFrame([(k, float(v)) for k, v in enumerate([3, 1, 3, 3, -2, 0])], "id long, v double")
    assert {r.id: r.rank for r in marginals.average_rank(frame, "v").collect()} == {0: 5.0, 1: 3.0, 2: 5.0, 3: 5.0, 4: 1.0, 5: 2.0}
    assert marginals.average_rank(frame.limit(0), "v").collect() == []
    odd = spark.createDataFrame([(0, float("nan")), (1, 2.0), (2, None), (3, 1.0)], "id long, v double")
    assert {r.id: r.rank for r in marginals.rank_nan_last(odd, "v", "id").collect()} == {0: 3.0, 1: 2.0, 2: 4.0, 3: 1.0}
