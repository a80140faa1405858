"""A contact matrix: three DataFrames and the bin size."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .schema import CORE_BIN_COLUMNS, MatrixError, Region, ceil_div, floor_div, weight_is_divisive


@dataclass(frozen=True)
class ContactMatrix:
    """chroms(chrom_id, name, length), bins(bin_id, chrom_id, start, end, weights...) and
    pixels(bin1_id, bin2_id, count), upper triangle.  bin_size None: bins of any width."""

    chroms: DataFrame
    bins: DataFrame
    pixels: DataFrame
    bin_size: int | None

    def with_pixels(self, pixels: DataFrame) -> ContactMatrix:
        return replace(self, pixels=pixels)

    def extent(self, region: Region) -> tuple[int, int, int]:
        """(chrom_id, first bin, bin behind the last) of the bins that overlap a region; none if it is
        empty.  Coordinates are checked, never clamped."""
        row = chrom_offsets(self.chroms, self.bin_size).where(F.col("name") == region.chrom).first() if self.bin_size else None
        if row is None:
            known = self.chroms.where(F.col("name") == region.chrom).first()
            if known is None:
                raise MatrixError(f"no chromosome {region.chrom!r}")
            if region.start is not None:
                raise MatrixError("parts of a chromosome need bins of one size")
            lo, n = self.bins.where(F.col("chrom_id") == known.chrom_id).agg(F.min("bin_id"), F.count("*")).first()
            return known.chrom_id, lo or 0, (lo or 0) + n
        start, end = region.start or 0, row.length if region.end is None else region.end
        if start > row.length or end > row.length or start > end:
            raise MatrixError(f"{region} reaches beyond {row.length}")
        if start == end:
            return row.chrom_id, row.first_bin + start // self.bin_size, row.first_bin + start // self.bin_size
        return row.chrom_id, row.first_bin + start // self.bin_size, row.first_bin - (-end // self.bin_size)

    def bins_in(self, region: Region) -> DataFrame:
        _, lo, hi = self.extent(region)
        return self.bins.where((F.col("bin_id") >= lo) & (F.col("bin_id") < hi))

    def rows_in(self, region: Region) -> DataFrame:
        """Pixels whose first bin lies in the region, whatever the second."""
        _, lo, hi = self.extent(region)
        return row_band(self.pixels, lo, hi)

    def block(self, region: Region) -> DataFrame:
        """Pixels with both bins in the region."""
        _, lo, hi = self.extent(region)
        return cis_block(self.pixels, lo, hi)

    def rows_on_chromosome(self, region: Region) -> DataFrame:
        """Pixels whose first bin lies in the region and whose second on the region's chromosome."""
        _, lo, hi = self.extent(region)
        _, first, last = self.extent(Region(region.chrom))
        return row_band(self.pixels, lo, hi).where((F.col("bin2_id") >= first) & (F.col("bin2_id") < last))

    def bin_columns(self) -> list[str]:
        return [c for c in self.bins.columns if c not in CORE_BIN_COLUMNS]

    def set_bin_column(self, name: str, values: DataFrame, attributes: dict | None = None) -> ContactMatrix:
        """Adds or replaces a weight column from values(bin_id, value); bins without one get null.

        attributes: numbers, texts or lists of them that are kept with the column, on disk as well."""
        if name in CORE_BIN_COLUMNS:
            raise MatrixError(f"{name} is a core column")
        new = values.select("bin_id", F.col("value").cast("double").alias(name, metadata=attributes or {}))
        return replace(self, bins=self.bins.drop(name).join(new, "bin_id", "left"))

    def column_attributes(self, name: str) -> dict:
        """What is known of a column of the bins; nothing of one that isn't there."""
        return dict(self.bins.schema[name].metadata) if name in self.bins.columns else {}

    def divisive(self, name: str) -> bool | None:
        """Whether counts are divided by a weight: its attribute says, or its name; None: neither does."""
        return weight_is_divisive(name, self.column_attributes(name).get("divisive_weights"))

    def drop_bin_column(self, name: str) -> ContactMatrix:
        if name in CORE_BIN_COLUMNS:
            raise MatrixError(f"{name} is a core column")
        if name not in self.bins.columns:
            raise MatrixError(f"no column {name}")
        return replace(self, bins=self.bins.drop(name))

    def rename_chroms(self, names: dict[str, str]) -> ContactMatrix:
        """Renames chromosomes; unknown, empty and repeated names are refused."""
        have = [r.name for r in self.chroms.select("name").collect()]
        unknown = sorted(set(names) - set(have))
        new = [names.get(n, n) for n in have]
        if unknown or "" in new or len(set(new)) < len(new):
            raise MatrixError(f"bad new names: unknown {unknown}, result {new}")
        table = self.chroms.sparkSession.createDataFrame(list(names.items()), "name string, new_name string")
        chroms = self.chroms.join(F.broadcast(table), "name", "left").select("chrom_id", F.coalesce("new_name", "name").alias("name"), "length")
        return replace(self, chroms=chroms)


def chrom_offsets(chroms: DataFrame, bin_size: int) -> DataFrame:
    """chroms with n_bins and first_bin.  One row a chromosome, so one ordered window does."""
    n = chroms.withColumn("n_bins", ceil_div(F.col("length"), bin_size))
    before = F.sum("n_bins").over(Window.orderBy("chrom_id").rowsBetween(Window.unboundedPreceding, -1))
    return n.withColumn("first_bin", F.coalesce(before, F.lit(0)).cast("long"))


def fixed_bins(chroms: DataFrame, bin_size: int) -> DataFrame:
    """Bins of one size that tile each chromosome, the last one cut to its end."""
    off = chrom_offsets(chroms, bin_size).where("n_bins > 0")
    each = off.select("chrom_id", "length", "first_bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bins") - 1)).alias("k"))
    start = (F.col("k") * bin_size).cast("int")
    return each.select((F.col("first_bin") + F.col("k")).alias("bin_id"), "chrom_id", start.alias("start"), F.least(start + bin_size, F.col("length")).cast("int").alias("end"))


def canonical(pixels: DataFrame, merge: bool = True) -> DataFrame:
    """Upper triangle, and one row a pair with the counts summed."""
    out = pixels.select(F.least("bin1_id", "bin2_id").alias("bin1_id"), F.greatest("bin1_id", "bin2_id").alias("bin2_id"), "count")
    return out.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count")) if merge else out


def bin1_offset(bins: DataFrame, pixels: DataFrame, stride: int = 65_536) -> DataFrame:
    """(bin_id, first_row): how many pixels come before each bin's row, and one entry behind the last.
    The running sum goes over strides of bins and then within them."""
    n = pixels.groupBy("bin1_id").agg(F.count("*").alias("n"))
    rows = bins.select("bin_id").join(n, F.col("bin_id") == F.col("bin1_id"), "left").select("bin_id", F.coalesce("n", F.lit(0)).alias("n"))
    rows = rows.unionByName(bins.agg((F.max("bin_id") + 1).alias("bin_id")).where("bin_id is not null").withColumn("n", F.lit(0).cast("long")))
    rows = rows.withColumn("stride", floor_div(F.col("bin_id"), stride))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("stride").orderBy("bin_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("stride").agg(F.sum("n").alias("total"))
    base = sums.select("stride", F.coalesce(F.sum("total").over(Window.orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.withColumn("inner", inner).join(base, "stride").select("bin_id", (F.col("inner") + F.col("base")).alias("first_row"))


def row_band(pixels: DataFrame, lo: int, hi: int) -> DataFrame:
    return pixels.where((F.col("bin1_id") >= lo) & (F.col("bin1_id") < hi))


def cis_block(pixels: DataFrame, lo: int, hi: int) -> DataFrame:
    inside = lambda c: (F.col(c) >= lo) & (F.col(c) < hi)
    return pixels.where(inside("bin1_id") & inside("bin2_id"))


def submatrix(pixels: DataFrame, rows: tuple[int, int], cols: tuple[int, int], fill_lower: bool = True) -> DataFrame:
    """(i, j, count) of the cells of a rectangle, the upper triangle reflected; one count a cell."""
    both = pixels.select(F.col("bin1_id").alias("i"), F.col("bin2_id").alias("j"), "count")
    if fill_lower:
        both = both.unionByName(both.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "count"))
    inside = F.col("i").between(rows[0], rows[1] - 1) & F.col("j").between(cols[0], cols[1] - 1)
    return both.where(inside).groupBy("i", "j").agg(F.max("count").alias("count"))


def dense(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(i, values): the rectangle row by row, zeros filled in; a row is bounded by the columns asked."""
    spark = cells.sparkSession
    grid = spark.range(*rows).select(F.col("id").alias("i"))
    got = cells.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "count"))).alias("m"))
    value = F.transform(F.sequence(F.lit(cols[0]).cast("long"), F.lit(cols[1] - 1).cast("long")), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
    return grid.join(got, "i", "left").select("i", value.alias("values"))


def annotate(matrix: ContactMatrix, pixels: DataFrame | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """pixels with chrom1, start1, end1, chrom2, start2, end2 and the bin columns asked, numbered 1 and 2.

    The bins of a genome are bounded, and Spark broadcasts them only below its size threshold."""
    named = matrix.bins.join(matrix.chroms.select("chrom_id", "name"), "chrom_id")
    out = matrix.pixels if pixels is None else pixels
    for k in (1, 2):
        side = named.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("name").alias(f"chrom{k}"), F.col("chrom_id").alias(f"chrom_id{k}"), F.col("start").alias(f"start{k}"), F.col("end").alias(f"end{k}"), *(F.col(c).alias(f"{c}{k}") for c in columns))
        out = out.join(side, f"bin{k}_id")
    return out


def with_chroms(pixels: DataFrame, bins: DataFrame) -> DataFrame:
    """pixels with chrom_id1 and chrom_id2."""
    for k in (1, 2):
        pixels = pixels.join(bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("chrom_id").alias(f"chrom_id{k}")), f"bin{k}_id")
    return pixels


def masked_positions(bins: DataFrame, weight: str) -> DataFrame:
    """Bins with a finite weight, and pos, their number among those of their chromosome."""
    w = F.col(weight)
    good = bins.where(w.isNotNull() & ~F.isnan(w) & (F.abs(w) != float("inf")))
    return good.withColumn("pos", F.row_number().over(Window.partitionBy("chrom_id").orderBy("bin_id")) - 1)


def enlarged(bins: DataFrame) -> DataFrame:
    """bins that follow each other without gaps: two that don't touch meet half way, and the first of two
    or more begins at 0."""
    w = Window.partitionBy("chrom_id").orderBy("bin_id")
    start, end = F.col("start").cast("long"), F.col("end").cast("long")
    before, after = F.lag(end).over(w), F.lead(start).over(w)
    first = F.when(after.isNotNull(), F.lit(0).cast("long")).otherwise(start)
    moved = bins.withColumns({"_s": F.when(before.isNotNull(), start - floor_div(start - before, 2)).otherwise(first), "_e": F.when(after.isNotNull(), after - floor_div(after - end, 2)).otherwise(end)})
    return moved.withColumns({"start": F.col("_s"), "end": F.col("_e")}).drop("_s", "_e")


def median_bin_size(bins: DataFrame) -> DataFrame:
    """(bin_size): the median distance of following starts, cut to an integer."""
    w = Window.partitionBy("chrom_id").orderBy("bin_id")
    steps = bins.select((F.col("start") - F.lag("start").over(w)).alias("d"))
    return steps.agg(F.median("d").cast("long").alias("bin_size"))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
