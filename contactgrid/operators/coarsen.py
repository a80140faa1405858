"""Coarser resolutions: bins pooled within their chromosome, counts summed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import ContactMatrix, chrom_offsets, fixed_bins
from ..plans.scratch import materialize
from ..schema import MatrixError, floor_div

#: Fixed value: the side of a viewer's tile, which the coarsest automatic level fits into.
TILE = 256
#: Fixed values of the all-against-all overview: bins aimed at, and base pairs a unit.
OVERVIEW_BINS, OVERVIEW_SCALE = 500, 1000


def pow2_resolutions(base: int, most: int) -> list[int]:
    out = [base]
    while out[-1] * 2 <= most:
        out.append(out[-1] * 2)
    return out


def nice_resolutions(base: int, most: int) -> list[int]:
    """base times 1, 2, 5, 10, 20, 50, ... up to `most`."""
    out, decade = [base], 1
    while True:
        for step in (2, 5, 10):
            if base * decade * step > most:
                return out
            out.append(base * decade * step)
        decade *= 10


def targets(genome: int, base: int, wanted: Sequence[int] = (), nice: bool = True, copy_base: bool = True) -> list[int]:
    """The resolutions to write.  None wanted: a progression until the genome fits a tile."""
    if wanted:
        if len(set(wanted)) < len(wanted):
            raise MatrixError("a resolution is named twice")
        bad = [r for r in wanted if r < base or r % base]
        if bad:
            raise MatrixError(f"no multiples of {base}: {bad}")
        steps = sorted(wanted)
    else:
        steps = (nice_resolutions if nice else pow2_resolutions)(base, -(-genome // TILE))
    out = [base] * copy_base + [r for r in steps if r > base]
    if not out:
        raise MatrixError("no resolutions to write")
    return out


def coarse_ids(matrix: ContactMatrix, size: int) -> DataFrame:
    """(bin_id, coarse_id) of the bins `size` wide."""
    if not matrix.bin_size or size % matrix.bin_size:
        raise MatrixError(f"{size} is no multiple of {matrix.bin_size}")
    coarse = chrom_offsets(matrix.chroms, size).select("chrom_id", F.col("first_bin").alias("coarse0"))
    return matrix.bins.join(F.broadcast(coarse), "chrom_id").select("bin_id", (F.col("coarse0") + floor_div(F.col("start"), size)).alias("coarse_id"))


def coarsen(matrix: ContactMatrix, factor: int) -> ContactMatrix:
    """One pass over the pixels: arithmetic through the chromosomes' offsets (a row each, so broadcast),
    then a partial sum before the only shuffle."""
    if not matrix.bin_size:
        raise MatrixError("coarsening needs bins of one size")
    size = matrix.bin_size * factor
    fine = chrom_offsets(matrix.chroms, matrix.bin_size).select("first_bin", (F.col("first_bin") + F.col("n_bins")).alias("behind"), "chrom_id")
    off = fine.join(chrom_offsets(matrix.chroms, size).select("chrom_id", F.col("first_bin").alias("coarse0")), "chrom_id")
    table = off.orderBy(F.desc("first_bin")).collect()  # one row a chromosome

    def pooled(c: str):
        """A chain of cases over the chromosomes, the last first: stays in generated code, no join."""
        out = F.lit(None).cast("long")
        for r in reversed(table):
            out = F.when(F.col(c) >= r.first_bin, r.coarse0 + floor_div(F.col(c) - r.first_bin, factor)).otherwise(out)
        return out.alias(c)

    if len(table) > 64:  # many scaffolds: by the bins' own chromosome instead of a long chain
        ids = coarse_ids(matrix, size)
        px = matrix.pixels
        for k in (1, 2):
            px = px.join(ids.withColumnsRenamed({"bin_id": f"bin{k}_id", "coarse_id": f"c{k}"}), f"bin{k}_id")
        px = px.select(F.col("c1").alias("bin1_id"), F.col("c2").alias("bin2_id"), "count")
    else:
        px = matrix.pixels.select(pooled("bin1_id"), pooled("bin2_id"), "count")
    sums = px.groupBy("bin1_id", "bin2_id").agg(F.sum("count").alias("count"))
    return ContactMatrix(matrix.chroms, fixed_bins(matrix.chroms, size), sums, size)


def zoom(matrix: ContactMatrix, wanted: Sequence[int] = (), nice: bool = True) -> dict[int, ContactMatrix]:
    """A matrix for each resolution; each from the coarsest one below it that divides it.  A level that
    others come from is written to the shared folder, so nothing is aggregated twice."""
    genome = matrix.chroms.agg(F.sum("length")).first()[0] or 0
    out: dict[int, ContactMatrix] = {}
    sizes = list(targets(genome, matrix.bin_size, wanted, nice))
    below = {r: max((b for b in sizes if b < r and r % b == 0), default=None) for r in sizes}
    for r in sorted(sizes):
        source = out[below[r]] if below[r] in out else matrix
        level = coarsen(source, r // source.bin_size)
        out[r] = level.with_pixels(materialize(level.pixels, "zoom")) if r in below.values() else level
    return out


def overview(matrix: ContactMatrix) -> DataFrame:
    """(bin1, bin2, count): all chromosomes in a row, in units of OVERVIEW_SCALE, at about OVERVIEW_BINS bins."""
    genome = matrix.chroms.agg(F.sum("length")).first()[0] or 0
    bin_bp = max(1, genome // OVERVIEW_SCALE // OVERVIEW_BINS) * OVERVIEW_SCALE
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("length").over(Window.orderBy("chrom_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = matrix.chroms.select("chrom_id", before.cast("long").alias("bp0"))
    place = matrix.bins.join(F.broadcast(base), "chrom_id").select("bin_id", floor_div(F.col("bp0") + F.col("start"), bin_bp).alias("cell"))
    px = matrix.pixels
    for k in (1, 2):
        px = px.join(place.withColumnsRenamed({"bin_id": f"bin{k}_id", "cell": f"cell{k}"}), f"bin{k}_id")
    return px.groupBy(F.col("cell1").alias("bin1"), F.col("cell2").alias("bin2")).agg(F.sum("count").alias("count"))
