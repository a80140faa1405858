"""One function for each task a user comes with, over matrices on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matrix import ContactMatrix, fixed_bins
from .operators import balance as B
from .operators import coarsen, compare, intervals, objective, validate
from .operators.tads import blocks, directionality, hierarchy, multires, nested, separation
from .schema import MatrixError, Region
from .sources import contacts, cool, hic, layout

CALLERS = {
    "separation": separation.call_boundaries,
    "hierarchy": hierarchy.call_hierarchy,
    "multires": multires.call_multires,
    "blocks": blocks.call_blocks,
    "directionality": directionality.call_domains,
}


def open_matrix(spark: SparkSession, path: str, resolution: int | None = None, norm: str | None = None) -> ContactMatrix:
    """A .hic, .cool or .mcool file, or a folder of one or many resolutions."""
    if path.endswith((".cool", ".mcool")):
        return cool.open_cool(spark, path, resolution)
    if path.endswith(".hic"):
        have = hic.read_header(path).resolutions
        if resolution is None and len(have) > 1:
            raise MatrixError(f"name one of {have}")
        return hic.open_hic(spark, path, have[0] if resolution is None else resolution, norm)
    return layout.open_matrix(spark, path, resolution)


def load(spark: SparkSession, text: str, out: str, chrom: str, length: int, bin_size: int) -> ContactMatrix:
    """A dense text matrix of one chromosome; its width must be the chromosome's number of bins."""
    lines = spark.read.text(text, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    width = lines.where(F.trim("value") != "").select(F.size(F.split(F.trim("value"), r"\s+")).alias("n")).first()
    n = -(-length // bin_size)
    if width is not None and width.n != n:
        raise MatrixError(f"{width.n} columns for {n} bins")
    chroms = spark.createDataFrame([(0, chrom, length)], "chrom_id int, name string, length int")
    m = ContactMatrix(chroms, fixed_bins(chroms, bin_size), contacts.dense_text_pixels(lines), bin_size)
    layout.write_matrix(m, out)
    return m


def dump(matrix: ContactMatrix, out: str, region: str | None = None, weight: str | None = None, coordinates: bool = False) -> None:
    """Pixels as text, in the order of the bins."""
    pixels = matrix.block(Region.parse(region)) if region else None
    layout.write_pixel_text(layout.pixel_text(matrix, pixels, coordinates, weight), out)


def normalize(matrix: ContactMatrix, method: str = "ice", name: str = "weight", policy: str = "store_final", ignore_dist: int | None = None, blacklist: DataFrame | None = None, **params) -> ContactMatrix:
    """The matrix with a new column of multiplicative weights, with its options and outcome as attributes.
    method: ice, kr, vc, vc_sqrt or objective.

    policy, if balancing doesn't settle: store_final, store_nan, discard or error.  blacklist: (chrom, start,
    end).  ignore_dist: base pairs next to the diagonal left out."""
    known: dict = {"divisive_weights": 0}
    if ignore_dist is not None:
        params["ignore_diags"] = max(params.get("ignore_diags", 0), -(-ignore_dist // matrix.bin_size))
    if method in ("ice", "kr"):
        if method == "kr":
            params = {"ignore_diags": 0, "mad_max": 0, "min_nnz": 0} | params
        black = intervals.overlapping_bins(matrix, blacklist) if blacklist is not None else None
        options = B.BalanceParams(**params)
        out, stats = B.balance(matrix, options, blacklist=black)
        known = B.attributes(options, stats)
        if not all(stats.converged):
            if policy == "error":
                raise MatrixError("balancing did not settle")
            if policy == "discard":
                return matrix
            if policy == "store_nan":
                out = out.withColumn("weight", F.lit(None).cast("double"))
    elif method in ("vc", "vc_sqrt"):
        out = B.vc_weights(matrix, 0.5 if method == "vc" else 0.25).withColumn("weight", 1 / F.col("weight"))
    elif method == "objective":
        out = objective.normalize(matrix, objective.ObjectiveParams(**params))
    else:
        raise MatrixError(f"no method {method}")
    return matrix.set_bin_column(name, out.withColumnRenamed("weight", "value"), known)


def normalized(matrix: ContactMatrix, name: str = "weight") -> bool:
    """Whether the bins have that column."""
    return name in matrix.bin_columns()


def weight_lines(matrix: ContactMatrix, name: str = "weight") -> DataFrame:
    """(bin_id, value): a column as text, a line for each bin, empty where it is masked."""
    if not normalized(matrix, name):
        raise MatrixError(f"no column {name}")
    w = F.col(name)
    return matrix.bins.select("bin_id", F.when(w.isNotNull() & ~F.isnan(w), w.cast("string")).otherwise("").alias("value"))


def similarity(matrices: dict[str, ContactMatrix], metric: str = "scc", **options) -> DataFrame:
    return compare.compare_all(matrices, metric, **options)


def zoomify(spark: SparkSession, path: str, out: str, resolutions: Sequence[int] = (), nice: bool = True, overwrite: bool = False) -> list[int]:
    levels = coarsen.zoom(open_matrix(spark, path), resolutions, nice)
    layout.write_resolutions(levels, out, overwrite)
    return sorted(levels)


def to_hic(levels: dict[int, ContactMatrix], out: str, genome: str = "unknown", weights: Sequence[str] = (), resolutions: Sequence[int] = ()) -> None:
    """Matrices of bins of one size as a .hic file; weight columns become divisive vectors."""
    import numpy as np

    wanted = {r: m for r, m in levels.items() if not resolutions or r in resolutions}
    if not wanted or any(m.bin_size != r for r, m in wanted.items()) or set(resolutions) - set(levels):
        raise MatrixError("resolutions and matrices don't fit")
    norms: dict[str, dict[int, list]] = {}
    for w in weights:
        for r, m in wanted.items():
            rows = m.bins.orderBy("bin_id").select("chrom_id", F.col(w).alias("w")).toPandas()
            v = rows["w"].astype(float)
            v = v if m.divisive(w) else 1 / v
            norms.setdefault(w, {})[r] = [np.asarray(v[rows["chrom_id"] == k]) for k in sorted(rows["chrom_id"].unique())]
    hic.write_hic(wanted, out, genome, None, norms)


def call_tads(matrix: ContactMatrix, method: str, *args, **options):
    if method not in CALLERS:
        raise MatrixError(f"no caller {method}")
    return CALLERS[method](matrix, *args, **options)


def call_nested_domains(matrices: dict[int, ContactMatrix], **options) -> DataFrame:
    return nested.call_nested(matrices, **options)


def check(spark: SparkSession, path: str, max_issues: int = 20) -> DataFrame:
    """(target, check, detail) of every resolution of a folder; empty if all is sound."""
    if path.endswith(".hic"):
        raise MatrixError("folders only")
    targets = {path: path} if layout._exists(spark, f"{path}/meta") else {f"{path}::{r}": f"{path}/resolution={r}" for r in layout.resolutions(spark, path)}
    out = None
    for name, place in targets.items():
        m, meta = layout.read_matrix(spark, place), layout.attributes(spark, place)
        found = validate.at_most(validate.issues(m.chroms, m.bins, m.pixels, {k: meta[k] for k in ("nchroms", "nbins", "nnz")}), max_issues)
        if layout._exists(spark, f"{place}/indexes"):
            found = found.unionByName(validate.at_most(layout.index_issues(spark, place), max_issues))
        found = found.select(F.lit(name).alias("target"), "check", "detail")
        out = found if out is None else out.unionByName(found)
    return out
