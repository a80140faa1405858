import random
import time

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from contactgrid.operators import intervals
from contactgrid.plans.queries import QUERIES


def brute(iv):
    out = {}
    for c, s1, e1 in iv:
        for c2, s2, e2 in iv:
            inner = min(e1, e2) - max(s1, s2)
            if c == c2 and inner > 0:
                out[c, s1, e1, s2, e2] = round(inner / (max(e1, e2) - min(s1, s2)), 6)
    return out


def orders(sf):
    names = dict(zip(*(pq.read_table(f"{sf}/region.parquet")[c].to_pylist() for c in ("r_regionkey", "r_name")), strict=True))
    t = pq.read_table(f"{sf}/orders.parquet", columns=["o_orderkey", "o_custkey"]).to_pylist()
    return sorted({(names[r["o_orderkey"] % 5], s, s + 1 + r["o_orderkey"] % 700) for r in t for s in [(r["o_custkey"] * 131 + r["o_orderkey"]) % 19000]})


def test_pairs_as_brute_force(spark):
    rng = random.Random(4)
    iv = {(rng.choice("ab"), s, s + rng.choice((0, 1, 3, 40, 400))) for s in (rng.randint(-50, 500) for _ in range(150))}
    got = intervals.overlapping_pairs(*[spark.createDataFrame(sorted(iv), "chrom string, start long, end long")] * 2).collect()
    assert sorted(map(tuple, got)) == sorted(brute(iv))


def test_ratios_as_brute_force(spark):
    rng = random.Random(5)
    iv = {(rng.choice("ab"), s, s + rng.choice((1, 3, 40, 400))) for s in (rng.randint(-50, 500) for _ in range(100))}
    pairs = intervals.overlapping_pairs(*[spark.createDataFrame(sorted(iv), "chrom string, start long, end long")] * 2)
    ratio = intervals.overlap_ratio(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
    got = {tuple(r)[:5]: r.ratio for r in pairs.withColumn("ratio", ratio).collect()}
    assert got == pytest.approx(brute(iv), abs=1.1e-6)


def test_all_orders(spark, sf):
    iv = orders(sf)
    rows = lambda name: [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    want = brute(iv)
    others = {x: -1 for x in iv}
    for c, s, e, _, _ in want:
        others[c, s, e] += 1
    assert {r[:3]: r[3] for r in rows("interval_overlap_counts")} == others
    assert sorted(rows("included_bins")) == sorted({(c, k) for c, s, e in iv for k in range(s // 100, (e + 99) // 100)})
    assert sorted(rows("low_minus_high")) == [x for x in iv if x[1] <= 6000]
    level = {x: 0 for x in iv}
    for c, s, e, s2, e2 in want:
        level[c, s, e] += s2 <= s and e <= e2 and (s2, e2) != (s, e)
    assert {r[:3]: r[3] for r in rows("nesting_level")} == level
    names = {r.name: r.chrom_id for r in QUERIES["chroms_table"](spark, sf).collect()}
    at = {(r.chrom_id, r.start // 100): r.bin_id for r in QUERIES["bins_table"](spark, sf).collect()}
    inner = {(names[c], k) for c, s, e in iv for k in range(s // 100, (e + 99) // 100)}
    assert sorted(x for x, in rows("blacklist_overlap")) == sorted(at[x] for x in inner if x in at)
    ids = {v: k for k, v in at.items()}
    diagonal = [ids[r.bin1_id] for r in QUERIES["pixels_table"](spark, sf).where("bin1_id = bin2_id").collect()]
    finest = {c: min((i % 3, i) for c2, i in diagonal if c2 == c)[1] for c, _ in diagonal}
    assert dict(rows("finest_resolution")) == finest


@pytest.mark.parametrize("rows", [3, 64, 1 << 17])
def test_levels_as_brute_force(spark, rows):
    """Shared starts and ends, ends before starts, repeated rows and nulls, in few and in many ranges."""
    rng = random.Random(6)
    iv = {(rng.choice("abc"), s, s + rng.choice((-60, 0, 1, 3, 40, 400))) for s in (rng.randint(-50, 50) for _ in range(200))}
    holds = lambda b, a: b[0] == a[0] and b != a and b[1] <= a[1] and b[2] >= a[2]
    want = {a: sum(holds(b, a) for b in iv) for a in iv}
    odd = {(None, 0, 9), ("a", None, 9), ("a", 0, None), (None, None, None)}
    frame = spark.createDataFrame([*iv, *sorted(iv)[:50], *odd, *odd], "chrom string, start long, end long")
    got = [tuple(r) for r in intervals.nesting_levels(frame, rows).collect()]
    assert len(got) == len(iv) + len(odd) and {r[:3]: r[3] for r in got} == want | dict.fromkeys(odd, 0)
    assert intervals.nesting_levels(frame.limit(0), rows).collect() == []


def test_levels_of_deep_nests(spark):
    """60,000 domains each in all before it, and 60,000 of one start: 3.6 billion pairs."""
    n = 60_000
    nest = spark.range(n).select(F.lit("nest").alias("chrom"), F.col("id").alias("start"), (3 * n - F.col("id")).alias("end"))
    fan = spark.range(n).select(F.lit("fan").alias("chrom"), F.lit(5).cast("long").alias("start"), (6 + F.col("id")).alias("end"))
    began = time.time()
    got = intervals.nesting_levels(nest.unionByName(fan), 1 << 13)
    right = F.when(F.col("chrom") == "nest", F.col("start")).otherwise(5 + n - F.col("end"))
    assert got.where(F.col("level") == right).count() == 2 * n == got.count()
    assert time.time() - began < 60
