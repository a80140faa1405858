"""Similarity of two matrices of one binning."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import ContactMatrix, with_chroms
from ..schema import MatrixError
from .marginals import average_rank


def correlation(x: Column, y: Column) -> Column:
    """Pearson's r from six sums, over rows where not both are zero; null if under two rows or without
    spread.  (corr() differs on constants and in its last digits.)"""
    keep = (x != 0) | (y != 0)
    s = lambda c: F.sum(F.when(keep, c))
    n = F.sum(F.when(keep, 1.0).otherwise(0.0))
    cov = s(x * y) - F.try_divide(s(x) * s(y), n)
    denom = F.sqrt((s(x * x) - F.try_divide(s(x) * s(x), n)) * (s(y * y) - F.try_divide(s(y) * s(y), n)))
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(cov, denom)))
    return F.when((n >= 2) & (denom != 0) & ~F.isnan(denom), r)


def check_alike(a: ContactMatrix, b: ContactMatrix) -> None:
    if a.bin_size != b.bin_size:
        raise MatrixError(f"bins of {a.bin_size} and of {b.bin_size}")
    if a.chroms.exceptAll(b.chroms).limit(1).count() or b.chroms.exceptAll(a.chroms).limit(1).count():
        raise MatrixError("different chromosomes")


def paired_cells(a: ContactMatrix, b: ContactMatrix) -> DataFrame:
    """(chrom_id, i, j, d, x, y): the cells within chromosomes that either matrix holds, absent counts zero."""
    sums = [m.pixels.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias(v)) for m, v in ((a, "x"), (b, "y"))]
    both = with_chroms(sums[0].join(sums[1], ["bin1_id", "bin2_id"], "full"), a.bins).where("chrom_id1 = chrom_id2")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return both.select(F.col("chrom_id1").alias("chrom_id"), F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), (F.col("bin2_id") - F.col("bin1_id")).alias("d"), zero("x"), zero("y"))


def n_diagonals(bins: DataFrame, bin_size: int, max_dist: int = -1) -> DataFrame:
    """(chrom_id, n_diags): how many diagonals, the main one included, are compared."""
    n = F.count("*")
    return bins.groupBy("chrom_id").agg((n if max_dist < 0 else F.least(F.lit(max_dist // bin_size + 1).cast("long"), n)).alias("n_diags"))


def pearson(cells: DataFrame) -> DataFrame:
    return cells.where("d > 0").groupBy("chrom_id").agg(correlation(F.col("x"), F.col("y")).alias("value"))


def spearman(cells: DataFrame) -> DataFrame:
    """Ranks within each chromosome; a chromosome's distinct counts are ordered, not its cells."""
    ranked = cells.where("d > 0 and (x <> 0 or y <> 0)")
    for v in ("x", "y"):
        ranked = average_rank(ranked, v, f"r{v}", ("chrom_id",))
    return ranked.groupBy("chrom_id").agg(correlation(F.col("rx"), F.col("ry")).alias("value"))


def smoothed(pixels: DataFrame, bins: DataFrame, h: int) -> DataFrame:
    """(chrom_id, i, j, v): each upper-triangle cell's mean over the (2h+1) x (2h+1) box around it, cut
    to the chromosome; cells outside the triangle count as zero.  A stored cell is spread to the boxes
    it lies in: h is a small constant."""
    span = bins.groupBy("chrom_id").agg(F.min("bin_id").alias("lo"), F.max("bin_id").alias("hi"))
    px = with_chroms(pixels, bins).where("chrom_id1 = chrom_id2").select(F.col("chrom_id1").alias("chrom_id"), "bin1_id", "bin2_id", "count")
    px = px.join(F.broadcast(span), "chrom_id")
    steps = F.array(*(F.lit(k) for k in range(-h, h + 1)))
    px = px.withColumn("di", F.explode(steps)).withColumn("dj", F.explode(steps))
    px = px.select("chrom_id", "lo", "hi", (F.col("bin1_id") + F.col("di")).alias("i"), (F.col("bin2_id") + F.col("dj")).alias("j"), "count")
    px = px.where("i between lo and hi and j between lo and hi and j >= i")
    wide = lambda c: F.least(F.col(c) + h, F.col("hi")) - F.greatest(F.col(c) - h, F.col("lo")) + 1
    return px.groupBy("chrom_id", "lo", "hi", "i", "j").agg(F.sum("count").alias("s")).select("chrom_id", "i", "j", (F.col("s") / (wide("i") * wide("j"))).alias("v"))


def stratified(cells: DataFrame, limits: DataFrame) -> DataFrame:
    """(chrom_id, value): the stratum-adjusted correlation, a weighted mean of the diagonals' r.  A
    diagonal without spread has r 0 and keeps its weight."""
    near = cells.join(F.broadcast(limits), "chrom_id").where("d > 0 and d < n_diags")
    n = F.sum(F.when((F.col("x") != 0) | (F.col("y") != 0), 1.0).otherwise(0.0))
    strata = near.groupBy("chrom_id", "d").agg(n.alias("n"), correlation(F.col("x"), F.col("y")).alias("r")).where("n >= 2")
    w = (F.col("n") + 1) / 12.0
    return strata.groupBy("chrom_id").agg((F.sum(F.coalesce("r", F.lit(0.0)) * w) / F.sum(w)).alias("value"))


def scc(a: ContactMatrix, b: ContactMatrix, h: int = 0, max_dist: int = -1, n_diags: int | None = None) -> DataFrame:
    limits = n_diagonals(a.bins, a.bin_size, max_dist)
    if not h:
        return stratified(paired_cells(a, b), limits)
    x, y = (smoothed(near_cells(m, limits), m.bins, h).withColumnRenamed("v", v) for m, v in ((a, "x"), (b, "y")))
    cells = x.join(y, ["chrom_id", "i", "j"], "full").select("chrom_id", "i", "j", (F.col("j") - F.col("i")).alias("d"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return stratified(cells, limits)


def near_cells(m: ContactMatrix, limits: DataFrame) -> DataFrame:
    """Off-diagonal pixels of the compared diagonals, within chromosomes."""
    px = with_chroms(m.pixels, m.bins).where("chrom_id1 = chrom_id2").join(F.broadcast(limits), F.col("chrom_id1") == F.col("chrom_id"))
    d = F.col("bin2_id") - F.col("bin1_id")
    return px.where((d > 0) & (d < F.col("n_diags"))).groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))


def compare(a: ContactMatrix, b: ContactMatrix, metric: str = "scc", h: int = 0, max_dist: int = -1) -> DataFrame:
    """(chrom_id, value) by "scc", "pearson" or "spearman"."""
    check_alike(a, b)
    if metric == "scc":
        return scc(a, b, h, max_dist)
    return {"pearson": pearson, "spearman": spearman}[metric](paired_cells(a, b))


def compare_all(matrices: Mapping[str, ContactMatrix], metric: str = "scc", **options) -> DataFrame:
    """(label_i, label_j, value): the mean over chromosomes of every pair, symmetric, 1 on the diagonal."""
    spark = next(iter(matrices.values())).chroms.sparkSession
    out = spark.createDataFrame([(k, k, 1.0) for k in matrices], "label_i string, label_j string, value double")
    for i, j in combinations(matrices, 2):
        v = compare(matrices[i], matrices[j], metric, **options).agg(F.avg("value").alias("value"))
        out = out.unionByName(v.select(F.lit(i).alias("label_i"), F.lit(j).alias("label_j"), "value")).unionByName(v.select(F.lit(j).alias("label_i"), F.lit(i).alias("label_j"), "value"))
    return out


def uniform(text: Column) -> Column:
    """A number in [0, 1) that a text decides, in SQL as well."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def downsample(pixels: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Each unit of a count stays with probability `share`: a normal draw matched to the binomial's mean
    and spread for large counts, single trials for small ones.  The seed and the cell decide."""
    u = lambda k: uniform(F.concat_ws(":", *cell, F.lit(f"n{k}")))
    c, cell = F.col("count"), (F.lit(str(seed)), F.col("bin1_id").cast("string"), F.col("bin2_id").cast("string"))
    each = lambda i: F.when(uniform(F.concat_ws(":", *cell, i.cast("string"))) < share, 1.0).otherwise(0.0)
    small = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(c, F.lit(64.0))).cast("int")), each), F.lit(0.0), lambda a, x: a + x)
    z = F.sqrt(-2 * F.log(F.greatest(u(1), F.lit(1e-12)))) * F.cos(6.283185307179586 * u(2))
    large = F.greatest(F.lit(0.0), F.least(c, F.round(c * share + z * F.sqrt(c * share * (1 - share)))))
    return pixels.select("bin1_id", "bin2_id", F.when(c < 1, 0.0).when(c <= 64, small).otherwise(large).alias("count")).where("count > 0")


__all__ = ["average_rank", "check_alike", "compare", "compare_all", "correlation", "downsample", "n_diagonals", "near_cells", "paired_cells", "pearson", "scc", "smoothed", "spearman", "stratified"]
