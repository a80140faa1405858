"""Joins of intervals with bins and with each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.ranks import smaller_before
from ..matrix import ContactMatrix
from ..plans.scratch import materialize
from ..schema import MatrixError, ceil_div, floor_div
from .marginals import rows_before


def overlapping_bins(matrix: ContactMatrix, intervals: DataFrame) -> DataFrame:
    """(bin_id) of bins that overlap an interval of (chrom, start, end).  Raises on unknown chromosomes.

    With bins of one size every interval names its bins by arithmetic and the join is an equi-join;
    otherwise chromosomes are joined and the bounds compared."""
    known = intervals.join(matrix.chroms.select(F.col("name").alias("chrom"), "chrom_id"), "chrom", "left")
    bad = known.where("chrom_id is null").first()
    if bad is not None:
        raise MatrixError(f"no chromosome {bad.chrom!r}")
    known = known.select("chrom_id", F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))
    if not matrix.bin_size:
        hit = (F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))
        return matrix.bins.join(known, "chrom_id").where(hit).select("bin_id").distinct()
    size = matrix.bin_size
    last = F.greatest(floor_div(F.col("s"), size), ceil_div(F.col("e"), size) - 1)
    cells = known.where("e > s").select("chrom_id", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), floor_div(F.col("s"), size)), last)).alias("k")).distinct()
    bins = matrix.bins.select("bin_id", "chrom_id", floor_div(F.col("start"), size).alias("k"))
    return bins.join(cells, ["chrom_id", "k"]).select("bin_id")


def local_bins(intervals: DataFrame, bin_size: int) -> DataFrame:
    """(chrom, k): numbers, within the chromosome, of the bins that intervals touch."""
    lo, hi = floor_div(F.col("start"), bin_size), ceil_div(F.col("end"), bin_size) - 1
    return intervals.where(hi >= lo).select("chrom", F.explode(F.sequence(lo, hi)).alias("k")).distinct()


def overlap_ratio(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common stretch over joint span; 0 if apart."""
    inner = F.least(e1, e2) - F.greatest(s1, s2)
    return F.when(inner > 0, F.try_divide(inner.cast("double"), (F.greatest(e1, e2) - F.least(s1, s2)).cast("double"))).otherwise(0.0)


def overlapping_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(chrom, s1, e1, s2, e2) of every interval of a and of b(chrom, start, end) that have a stretch in
    common, each pair once.

    Both are dealt to the cells they touch, as wide as a chromosome's mean interval, so all copies
    together are few times the intervals however long some are; a pair counts in the cell where its
    common stretch starts."""
    both = a.select("chrom", "start", "end").unionByName(b.select("chrom", "start", "end")).where("end > start")
    width = both.groupBy("chrom").agg(F.ceil(F.avg(F.col("end") - F.col("start"))).alias("w"))
    sides = []
    for k, side in ((1, a), (2, b)):
        d = side.where("end > start").join(F.broadcast(width), "chrom")
        cells = F.sequence(floor_div(F.col("start"), F.col("w")), floor_div(F.col("end") - 1, F.col("w")))
        own = [F.col("w")] if k == 1 else []
        sides.append(d.select("chrom", *own, F.explode(cells).alias("cell"), F.col("start").alias(f"s{k}"), F.col("end").alias(f"e{k}")))
    meet = (F.col("s1") < F.col("e2")) & (F.col("s2") < F.col("e1")) & (floor_div(F.greatest("s1", "s2"), F.col("w")) == F.col("cell"))
    return sides[0].join(sides[1], ["chrom", "cell"]).where(meet).select("chrom", "s1", "e1", "s2", "e2")


def overlap_counts(intervals: DataFrame) -> DataFrame:
    """intervals(chrom, start, end), not empty, with n, how many others each has a stretch in common with: those
    that start before its end, less those that end by its start, itself not counted.  Both come from running
    counts over positions, so nothing grows with the pairs."""
    d = intervals.select("chrom", "start", "end").where("end > start")
    before = {}
    for kind in ("start", "end"):
        mark = lambda c: F.struct(F.col(c).alias("pos"), F.lit(int(c == kind)).alias("own"))  # noqa: B023, E731
        marks = d.select("chrom", F.explode(F.array(mark("start"), mark("end"))).alias("m"))
        before[kind] = rows_before(marks.groupBy("chrom", F.col("m.pos").alias("pos")).agg(F.sum("m.own").alias("_n")), "pos", "chrom")
    started = before["start"].select("chrom", F.col("pos").alias("end"), F.col("_before").alias("started"))
    ended = before["end"].select("chrom", F.col("pos").alias("start"), (F.col("_before") + F.col("_n")).alias("ended"))
    return d.join(started, ["chrom", "end"]).join(ended, ["chrom", "start"]).select("chrom", "start", "end", (F.col("started") - F.col("ended") - 1).alias("n"))


def nesting_levels(domains: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """domains(chrom, start, end) with level, the number of other domains that hold them; 0 where one of the three
    is null.

    The holders of a domain are those before it both by (chrom, start, end), ends falling, and by (chrom, end,
    start), chromosomes and ends falling.  Each order is dealt to ranges of about `rows` domains, which ties can't
    make larger.  Holders in a domain's range of the first order are counted in its task, those in an earlier range
    of the first and its own of the second in a task of that, and those in earlier ranges of both by sums over a
    table of ranges by ranges.  So nothing grows with the pairs."""
    d = materialize(domains.select("chrom", "start", "end").distinct(), "nesting-domains")
    null = F.col("chrom").isNull() | F.col("start").isNull() | F.col("end").isNull()
    known = d.where(~null)
    parts = max(1, -(-known.count() // rows))

    def same_first(t: pa.Table) -> np.ndarray:
        chrom, end = t.column("chrom").combine_chunks().dictionary_encode().indices.to_numpy(), t.column("end").to_numpy()
        return np.lexsort((-np.arange(len(t)), end, chrom))[::-1]

    def same_second(t: pa.Table) -> np.ndarray:
        return np.lexsort((-np.arange(len(t)), t.column("_first").to_numpy()))

    placed = _counted_in_ranges(known, parts, ["chrom", "start", F.desc("end")], "_first", same_first)
    placed = _counted_in_ranges(placed, parts, [F.desc("chrom"), F.desc("end"), "start"], "_second", same_second)
    cells = placed.groupBy("_first", "_second").agg(F.count("*").alias("_n"))
    grid = cells.select("_first").distinct().crossJoin(cells.select("_second").distinct()).join(cells, ["_first", "_second"], "left")
    before = lambda x, by, order: F.coalesce(F.sum(x).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grid = grid.withColumn("_along", before("_n", "_first", "_second")).withColumn("_before", before("_along", "_second", "_first"))
    grid = materialize(grid.where("_n is not null").select("_first", "_second", "_before"), "nesting-ranges")
    level = (F.col("_in_first") + F.col("_in_second") + F.col("_before")).alias("level")
    out = placed.join(grid, ["_first", "_second"]).select("chrom", "start", "end", level)
    return out.unionByName(d.where(null).withColumn("level", F.lit(0).cast("long")))


def _counted_in_ranges(d: DataFrame, parts: int, order: list[str | Column], name: str, ranking: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """d in ranges of `order`, written to the shared folder, with the number of its range and, in _in`name`, how many
    are before a row in its range both by `order` and by `ranking`, which sorts a range's rows."""
    ranged = d.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType([*ranged.schema.fields, T.StructField(name, T.IntegerType()), T.StructField(f"_in{name}", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            ranks = np.empty(len(t), np.int64)
            ranks[ranking(t)] = np.arange(len(t))
            part = np.full(len(t), TaskContext.get().partitionId(), np.int32)
            yield from t.append_column(name, pa.array(part)).append_column(f"_in{name}", pa.array(smaller_before(ranks))).to_batches()

    return materialize(ranged.mapInArrow(run, schema), "nesting-order")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges (a, b) whose reverse is there too."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b")).distinct()
    return edges.distinct().join(back, ["a", "b"], "left_semi")


def noise_ratio(pixels: DataFrame, domains: DataFrame, band: int) -> DataFrame:
    """(domain_id, noise) of domains(domain_id, lo, hi): the share of cells off the `band` first diagonals
    that hold no contact.  Domains of one chromosome may overlap; each pixel joins through the stretches
    of `width` bins that a domain covers."""
    width = 64
    d = domains.select("domain_id", "lo", "hi")
    spread = d.select("domain_id", "lo", "hi", F.explode(F.sequence(floor_div(F.col("lo"), width), floor_div(F.col("hi") - 1, width))).alias("cell"))
    px = pixels.where(F.col("bin2_id") - F.col("bin1_id") >= band).where("count <> 0").select("bin1_id", "bin2_id", floor_div(F.col("bin1_id"), width).alias("cell")).distinct()
    hits = spread.join(px, "cell").where("bin1_id >= lo and bin2_id < hi").groupBy("domain_id").agg(F.count("*").alias("n"))
    n = F.greatest(F.col("hi") - F.col("lo") - band, F.lit(0))
    total = (n * (n + 1) / 2).cast("double")
    return d.join(hits, "domain_id", "left").select("domain_id", F.when(total > 0, 1 - F.coalesce("n", F.lit(0)) / total).otherwise(1.0).alias("noise"))
