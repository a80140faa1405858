"""Sums over diagonals and diamonds of the cis matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..matrix import with_chroms
from ..schema import floor_div
from .marginals import rows_before


def cis_cells(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom_id, i, j, d, v): pixels within chromosomes, duplicates summed, bins numbered in theirs."""
    first = bins.groupBy("chrom_id").agg(F.min("bin_id").alias("first"))
    px = with_chroms(pixels, bins).where("chrom_id1 = chrom_id2").withColumnRenamed("chrom_id1", "chrom_id").join(F.broadcast(first), "chrom_id")
    px = px.select("chrom_id", (F.col("bin1_id") - F.col("first")).alias("i"), (F.col("bin2_id") - F.col("first")).alias("j"), "count")
    return px.groupBy("chrom_id", "i", "j").agg(F.sum("count").alias("v")).withColumn("d", F.col("j") - F.col("i"))


def expected_by_distance(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """(chrom_id, d, total, pairs, expected): contacts and bin pairs at each distance that has contacts."""
    n = bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    sums = cells.groupBy("chrom_id", "d").agg(F.sum("v").alias("total"))
    out = sums.join(F.broadcast(n), "chrom_id").withColumn("pairs", F.col("n") - F.col("d"))
    return out.select("chrom_id", "d", "total", "pairs", (F.col("total") / F.col("pairs")).alias("expected"))


def valid_pairs(valid: DataFrame, block: int = 1 << 14) -> DataFrame:
    """(d, pairs): over all chromosomes, the pairs of bins of valid(chrom_id, pos) at each distance that any has.

    A chromosome's positions are cut into blocks; two blocks are set against each other by a fast transform of
    their masks, however many gaps these have.  A task sums by the distance of the blocks before it hands on."""
    own = floor_div(F.col("pos"), block).cast("int")
    masks = valid.select("chrom_id", own.alias("k"), (F.col("pos") - own * block).cast("int").alias("x")).groupBy("chrom_id", "k").agg(F.collect_set("x").alias("x"))
    one, two = (masks.select("chrom_id", F.col("k").alias(f"k{j}"), F.col("x").alias(f"x{j}")) for j in (1, 2))
    met = one.join(two, "chrom_id").where("k2 >= k1").select((F.col("k2") - F.col("k1")).alias("apart"), "x1", "x2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                ends = []
                for column in (1, 2):
                    mask = np.zeros(2 * block)
                    mask[b.column(column)[k].values.to_numpy(zero_copy_only=False)] = 1
                    ends.append(np.fft.rfft(mask))
                # at place m the pairs whose second is m behind the first in their blocks, counted round the end
                found = np.rint(np.fft.irfft(np.conj(ends[0]) * ends[1], 2 * block)).astype(np.int64)
                apart = b.column(0)[k].as_py()
                sums[apart] = sums.get(apart, 0) + found
        for apart, found in sums.items():
            m = np.arange(2 * block)
            d = apart * block + np.where(m < block, m, m - 2 * block)
            some = (found > 0) & (d >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(d[some]), pa.array(found[some])], names=["d", "pairs"])

    return met.mapInArrow(run, "d long, pairs long").groupBy("d").agg(F.sum("pairs").alias("pairs"))


def dynamic_expected(cells: DataFrame, valid: DataFrame, most: int = 10, least_count: float = 400.0) -> DataFrame:
    """(d, expected) over all chromosomes: the sum over the smallest window d-w..d+w, w up to `most`, that
    holds over `least_count` contacts, by the valid pairs in it; null if none does.

    valid: (chrom_id, pos) of bins that count.  The table of distances is as long as a chromosome."""
    ok = lambda k: valid.select("chrom_id", F.col("pos").alias(k), F.lit(True).alias(f"ok{k}"))
    sums = cells.join(ok("i"), ["chrom_id", "i"]).join(ok("j"), ["chrom_id", "j"]).groupBy("d").agg(F.sum("v").alias("total"))
    top = sums.agg(F.max("d").alias("top"))
    line = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("d"))
    pairs = line.join(valid_pairs(valid), "d", "left").fillna(0, ["pairs"])
    both = pairs.join(sums, "d", "left").fillna(0.0, ["total"])
    for w in range(most + 1):
        around = Window.orderBy("d").rowsBetween(-w, w)
        both = both.withColumn(f"t{w}", F.sum("total").over(around)).withColumn(f"p{w}", F.sum("pairs").over(around))
    value = F.lit(None).cast("double")
    for w in reversed(range(most + 1)):
        value = F.when(F.col(f"t{w}") > least_count, F.try_divide(F.col(f"t{w}"), F.col(f"p{w}"))).otherwise(value)
    return both.select("d", value.alias("expected"))


def distance_standardized(cells: DataFrame, bins: DataFrame, band: int) -> DataFrame:
    """(chrom_id, i, j, z): cells under `band` by their diagonal's mean and deviation, absent cells counted
    as zero, plus 1; the variance is at least 1e-6."""
    n = bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    near = cells.where((F.col("d") >= 0) & (F.col("d") < band)).join(F.broadcast(n), "chrom_id").where("d < n - 1")
    size = (F.col("n") - F.col("d")).cast("double")
    stats = near.groupBy("chrom_id", "d", "n").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    mean = F.col("s") / size
    var = F.greatest(F.lit(1e-6), F.col("ss") / size - mean * mean)
    stats = stats.select("chrom_id", "d", mean.alias("mean"), F.sqrt(var).alias("sd"))
    return near.join(stats, ["chrom_id", "d"]).select("chrom_id", "i", "j", ((F.col("v") - F.col("mean")) / F.col("sd") + 1).alias("z"))


def pooled_zscore(cells: DataFrame, bins: DataFrame, bin_size: int, depth: int) -> DataFrame:
    """(chrom_id, i, j, z) of cells off the diagonal, by the pool of their genomic distance; absent cells
    of a distance count as zeros.  A pool without spread gives null; beyond `depth` + 1 z is 0."""
    n = bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    first = bins.withColumn("pos", F.row_number().over(Window.partitionBy("chrom_id").orderBy("bin_id")) - 1)
    px = cells.where("d > 0").join(F.broadcast(n), "chrom_id")
    for k in ("i", "j"):
        px = px.join(first.select("chrom_id", F.col("pos").cast("long").alias(k), F.col("start").alias(f"s{k}")), ["chrom_id", k])
    px = px.withColumn("key", floor_div(F.col("sj") - F.col("si"), bin_size) + 1)
    pools = px.groupBy("chrom_id", "key", "n").agg(F.count("*").alias("m"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    dl = F.greatest(F.col("n") - (F.col("key") - 1), F.col("m")).cast("double")
    mean = F.col("s") / dl
    var = F.greatest(F.lit(0.0), F.col("ss") / dl - mean * mean)
    pools = pools.select("chrom_id", "key", mean.alias("mean"), F.sqrt(var).alias("sd"))
    z = F.when(F.col("key") > depth + 1, 0.0).when(F.col("sd") > 0, (F.col("v") - F.col("mean")) / F.col("sd"))
    return px.join(pools, ["chrom_id", "key"]).select("chrom_id", "i", "j", z.alias("z"))


def diamond_sums(cells: DataFrame, bins: DataFrame, width: int, edges: bool = False) -> DataFrame:
    """(chrom_id, cut, total, mean): the block of `width` bins before a cut by as many from it on.

    edges: also blocks that the chromosome's ends cut short; there the last bin counts to none, and an
    empty block is 0.  Cell (i, j) lies in the diamonds of cuts max(i + 1, j - width + 1) .. min(j, i +
    width): instead of joining cells to cuts, each cell adds at the first and takes away behind the
    last, and a running sum over the cuts of a chromosome gives all diamonds."""
    n = bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    near = cells.where((F.col("d") > 0) & (F.col("d") < 2 * width))
    if edges:
        near = near.join(F.broadcast(n), "chrom_id").where("j < n - 1")
    lo, hi = F.greatest(F.col("i") + 1, F.col("j") - width + 1), F.least(F.col("j"), F.col("i") + width)
    marks = near.where(hi >= lo).select("chrom_id", F.explode(F.array(F.struct(lo.alias("cut"), F.col("v").alias("s")), F.struct((hi + 1).alias("cut"), (-F.col("v")).alias("s")))).alias("e"))
    marks = marks.groupBy("chrom_id", F.col("e.cut").alias("cut")).agg(F.sum("e.s").alias("s"))
    cuts = n.select("chrom_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("cut"))
    run = Window.partitionBy("chrom_id").orderBy("cut")
    out = cuts.join(marks, ["chrom_id", "cut"], "left").withColumn("total", F.sum(F.coalesce("s", F.lit(0.0))).over(run))
    if edges:
        size = F.least(F.col("cut"), F.lit(width)) * (F.least(F.col("cut") + width, F.col("n") - 1) - F.col("cut"))
        return out.select("chrom_id", "cut", "total", F.coalesce(F.try_divide(F.col("total"), size.cast("double")), F.lit(0.0)).alias("mean"))
    full = (F.col("cut") >= width) & (F.col("cut") + width <= F.col("n"))
    return out.where(full).select("chrom_id", "cut", "total", (F.col("total") / float(width * width)).alias("mean"))


def separation_score(z: DataFrame, bins: DataFrame, widths: list[int]) -> DataFrame:
    """(chrom_id, cut, score): the mean over the widths of the diamonds' mean z."""
    out = None
    cells = z.select("chrom_id", "i", "j", (F.col("j") - F.col("i")).alias("d"), F.coalesce("z", F.lit(0.0)).alias("v"))
    for k, w in enumerate(widths):
        s = diamond_sums(cells, bins, w, edges=True).select("chrom_id", "cut", F.col("mean").alias(f"m{k}"))
        out = s if out is None else out.join(s, ["chrom_id", "cut"])
    return out.select("chrom_id", "cut", (sum(F.col(f"m{k}") for k in range(len(widths))) / len(widths)).alias("score"))


def local_delta(scores: DataFrame, value: str = "score") -> DataFrame:
    """Adds delta: the mean of the ten rows before and the nine after a row of its chromosome, leaving
    out the third after it, less the row's own; null within ten rows of either end (eleven at the end of
    the last chromosome)."""
    w = Window.partitionBy("chrom_id").orderBy("cut")
    last = scores.agg(F.max("chrom_id").alias("_last"))
    skipped = F.lead(value, 3).over(w)
    total = F.sum(value).over(w.rowsBetween(-10, 9))
    after = F.count("*").over(w.rowsBetween(0, 11))
    full = (F.row_number().over(w) > 10) & (after >= F.when(F.col("chrom_id") == F.col("_last"), 12).otherwise(11))
    return scores.crossJoin(F.broadcast(last)).withColumn("delta", F.when(full, (total - skipped) / 19.0 - F.col(value))).drop("_last")


def fixed_directionality(cells: DataFrame, bins: DataFrame, window: int) -> DataFrame:
    """(chrom_id, i, di): a t statistic of a bin's contacts upstream less downstream at the distances
    1..window, for bins with so many on both sides; if five distances or more have contacts on both
    sides, over those alone.  0 without spread."""
    n = bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    near = cells.where((F.col("d") >= 1) & (F.col("d") <= window))
    up = near.select("chrom_id", F.col("j").alias("b"), "d", F.col("v").alias("u"), F.lit(0.0).alias("w"))
    down = near.select("chrom_id", F.col("i").alias("b"), "d", F.lit(0.0).alias("u"), F.col("v").alias("w"))
    pairs = up.unionByName(down).groupBy("chrom_id", "b", "d").agg(F.sum("u").alias("u"), F.sum("w").alias("w"))
    both = (F.col("u") != 0) & (F.col("w") != 0)
    sums = {"u": F.col("u"), "w": F.col("w"), "uu": F.col("u") * F.col("u"), "ww": F.col("w") * F.col("w")}
    g = pairs.groupBy("chrom_id", "b").agg(F.sum(F.when(both, 1).otherwise(0)).alias("both"), *(F.sum(v).alias(f"all_{k}") for k, v in sums.items()), *(F.coalesce(F.sum(F.when(both, v)), F.lit(0.0)).alias(f"both_{k}") for k, v in sums.items()))
    s = {k: F.when(F.col("both") >= 5, F.col(f"both_{k}")).otherwise(F.col(f"all_{k}")) for k in sums}
    m = F.when(F.col("both") >= 5, F.col("both")).otherwise(F.lit(window)).cast("double")
    mu, mw = s["u"] / m, s["w"] / m
    var = F.try_divide((s["uu"] - m * mu * mu) + (s["ww"] - m * mw * mw), m * (m - 1))
    di = F.when((m > 1) & (var > 1e-12), (mu - mw) / F.sqrt(var)).otherwise(0.0)
    inner = g.join(F.broadcast(n), "chrom_id").where((F.col("b") >= window) & (F.col("b") < F.col("n") - window))
    return inner.select("chrom_id", F.col("b").alias("i"), di.alias("di"))


def upstream_directionality(cells: DataFrame, gap: int) -> DataFrame:
    """(chrom_id, i, j, di): (left - right) / (left + right) of a bin's cells at one distance d >= gap to
    both sides, at j = i + d; for distances that the chromosome has on both sides and one side has
    contacts at."""
    near = cells.where(F.col("d") >= gap)
    left = near.select("chrom_id", F.col("j").alias("b"), "d", F.col("v").alias("l"))
    right = near.select("chrom_id", F.col("i").alias("b"), "d", F.col("v").alias("r"))
    both = left.join(right, ["chrom_id", "b", "d"], "full").fillna(0.0, ["l", "r"]).where("b >= d")
    return both.select("chrom_id", F.col("b").alias("i"), (F.col("b") + F.col("d")).alias("j"), F.try_divide(F.col("l") - F.col("r"), F.col("l") + F.col("r")).alias("di"))


def islands(positions: DataFrame, max_gap: int) -> DataFrame:
    """(chrom_id, lo, hi, n): runs of positions(chrom_id, pos) with gaps of at most `max_gap`."""
    w = Window.partitionBy("chrom_id").orderBy("pos")
    new = F.when(F.col("pos") - F.lag("pos").over(w) > max_gap, 1).otherwise(0)
    runs = positions.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("chrom_id", "run").agg(F.min("pos").alias("lo"), (F.max("pos") + 1).alias("hi"), F.count("*").alias("n")).drop("run")


def rejection_cutoff(pvalues: DataFrame, q: float) -> DataFrame:
    """(cutoff) of the false discovery rate q: the largest p at or under q * rank / n; null p count as 1.
    Distinct p are ranked, ties by their last."""
    p = pvalues.select(F.coalesce(F.nanvl("p", F.lit(1.0)), F.lit(1.0)).alias("p")).groupBy("p").agg(F.count("*").alias("_n"))
    total = p.agg(F.sum("_n").alias("total"))
    ok = rows_before(p, "p").crossJoin(F.broadcast(total)).withColumn("ok", F.col("p") <= q * (F.col("_before") + F.col("_n")) / F.col("total"))
    return ok.agg(F.max(F.when(F.col("ok"), F.col("p"))).alias("cutoff"))


def bonferroni(pvalues: DataFrame) -> DataFrame:
    n = pvalues.agg(F.count("*").alias("_n"))
    return pvalues.crossJoin(F.broadcast(n)).withColumn("adjusted", F.least(F.col("p") * F.col("_n"), F.lit(1.0))).drop("_n")
