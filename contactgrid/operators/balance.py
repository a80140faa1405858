"""Balancing: iterative correction and coverage weights.

Pixels are dealt once to tiles of bins by bins.  A round sends segments of the biases to the tiles, which
stay where they are, and sums what each tile adds to its bins.  Biases are as many as the genome has bins; they
are written to the shared folder each round, so plans don't grow and a lost executor costs a round at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..matrix import ContactMatrix, finite
from ..plans.scratch import Rolling, materialize, shared_dir
from ..schema import MatrixError, floor_div
from .marginals import full_marginal, marginal, nonzero_mean_var, select_pixels


@dataclass(frozen=True)
class BalanceParams:
    """mad_on_normalized: compare the cutoff with the marginals it was derived from; by default it is
    compared with the raw ones, as established tools do."""

    cis_only: bool = False
    trans_only: bool = False
    ignore_diags: int = 2
    mad_max: int = 5
    min_nnz: int = 10
    min_count: int = 0
    tol: float = 1e-5
    max_iters: int = 200
    rescale: bool = True
    mad_on_normalized: bool = False


@dataclass
class BalanceStats:
    """One entry, or one a chromosome for cis_only."""

    scale: list = field(default_factory=list)
    var: list = field(default_factory=list)
    converged: list = field(default_factory=list)


def attributes(p: BalanceParams, stats: BalanceStats) -> dict:
    """What a balanced column is to be kept with: its options and how it went, one value for the genome or, by
    chromosome, a list."""
    one_or_all = lambda v: v[0] if len(v) == 1 else v
    converged = [int(c) for c in stats.converged]
    out = {"tol": p.tol, "min_nnz": p.min_nnz, "min_count": p.min_count, "mad_max": p.mad_max, "cis_only": int(p.cis_only), "ignore_diags": p.ignore_diags, "divisive_weights": 0}
    went = {"scale": one_or_all(stats.scale), "var": one_or_all(stats.var), "converged": converged[0] if len(converged) == 1 else [float(c) for c in converged]}
    return out | {k: v for k, v in went.items() if v != [] and v == v}


def mad_mask(marg: DataFrame, mad_max: int, on_normalized: bool = False) -> DataFrame:
    """(bin_id, low): bins far under the median of the log marginals, each chromosome's by its median."""
    med = marg.where("marg > 0").groupBy("chrom_id").agg(F.median("marg").alias("med"))
    norm = marg.join(F.broadcast(med), "chrom_id", "left").withColumn("norm", F.try_divide("marg", "med"))
    logs = norm.where("norm > 0").select(F.log("norm").alias("l"))
    mid = logs.agg(F.median("l").alias("m"))
    dev = logs.crossJoin(F.broadcast(mid)).agg(F.median(F.abs(F.col("l") - F.col("m"))).alias("dev"), F.first("m").alias("m"))
    cutoff = dev.select(F.exp(F.col("m") - mad_max * F.col("dev")).alias("cutoff"))
    value = F.col("norm") if on_normalized else F.col("marg")
    return norm.crossJoin(F.broadcast(cutoff)).select("bin_id", F.coalesce(value < F.col("cutoff"), F.lit(False)).alias("low"))


def start_biases(matrix: ContactMatrix, p: BalanceParams, x0: DataFrame | None = None, blacklist: DataFrame | None = None) -> DataFrame:
    """(bin_id, chrom_id, bias): 1 or the bin's value in x0(bin_id, value), 0 where filtered out."""
    trans = not p.cis_only
    bias = matrix.bins.select("bin_id", "chrom_id")
    if x0 is not None:
        v = F.col("value")
        bias = bias.join(x0.select("bin_id", F.when(finite(v), v).otherwise(0.0).alias("bias")), "bin_id", "left").fillna({"bias": 0.0})
    else:
        bias = bias.withColumn("bias", F.lit(1.0))
    off: list[DataFrame] = []
    if p.min_nnz:
        nnz = marginal(select_pixels(matrix, p.ignore_diags, trans=trans, binarize=True))
        off.append(full_marginal(matrix.bins, nnz).where(F.col("marg") < p.min_nnz).select("bin_id"))
    if p.min_count or p.mad_max:
        marg = materialize(full_marginal(matrix.bins, marginal(select_pixels(matrix, p.ignore_diags, trans=trans))), "marginal")
        if p.min_count:
            off.append(marg.where(F.col("marg") < p.min_count).select("bin_id"))
        if p.mad_max:
            off.append(mad_mask(marg, p.mad_max, p.mad_on_normalized).where("low").select("bin_id"))
    if blacklist is not None:
        off.append(blacklist.select("bin_id"))
    if off:
        out = off[0]
        for more in off[1:]:
            out = out.unionByName(more)
        out = out.distinct().withColumn("_off", F.lit(True))
        bias = bias.join(out, "bin_id", "left").select("bin_id", "chrom_id", F.when(F.col("_off"), 0.0).otherwise(F.col("bias")).alias("bias"))
    return bias


@dataclass(frozen=True)
class Tiles:
    """Pixels dealt once to tiles of `width` x `width` bins: cells has a row for each part of a tile, (tile, part,
    down, across, cells), partitioned by tile and part; index has the same without the cells."""

    cells: DataFrame
    index: DataFrame
    width: int


def tile(pixels: DataFrame, n_bins: int, blocks: int = 64, most: int = 1 << 18) -> Tiles:
    """At most `blocks` squared tiles, in parts of some `most` cells by a hash of the cell, so that no tile near the
    diagonal is one row.  This is the only exchange of the pixels: what the rounds join stays where it lies, as
    checkpoint() keeps the partitioning."""
    spark = pixels.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    width = max(1, -(-n_bins // blocks))
    down, across = (floor_div(F.col(f"bin{k}_id"), width) for k in (1, 2))
    rows = pixels.select((down * blocks + across).cast("int").alias("tile"), down.cast("int").alias("down"), across.cast("int").alias("across"), (F.col("bin1_id") - down * width).cast("int").alias("x"), (F.col("bin2_id") - across * width).cast("int").alias("y"), F.col("count").cast("double").alias("v"))
    sizes = materialize(rows.groupBy("tile", "down", "across").agg(F.ceil(F.count("*") / most).cast("int").alias("parts")), "tile-sizes")
    part = F.pmod(F.xxhash64("x", "y"), F.col("parts")).cast("int")
    dealt = rows.join(F.broadcast(sizes.select("tile", "parts")), "tile").withColumn("part", part)  # bounded by `blocks`
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = dealt.repartition(n, "tile", "part").groupBy("tile", "part").agg(F.first("down").alias("down"), F.first("across").alias("across"), F.collect_list(F.struct("x", "y", "v")).alias("cells"))
    index = sizes.select("tile", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "down", "across")
    # a plan that adapts doesn't tell its partitioning, which is what the rounds live on
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = packed.checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return Tiles(cells, index, width)


def weighted_marginal(tiles: Tiles, weights: DataFrame) -> DataFrame:
    """(bin_id, marg) of count * w1 * w2, both bins of a pixel getting it, on the diagonal twice.

    Weights go to the tiles in segments of a tile's width, two for each part of a tile, and sums by bin come
    back; cells of a zero weight add nothing."""
    width = tiles.width
    block = floor_div(F.col("bin_id"), width).cast("int")
    some = weights.where("w <> 0").select(block.alias("block"), F.struct((F.col("bin_id") - block * width).cast("int").alias("k"), F.col("w").cast("double").alias("w")).alias("s"))
    segments = some.groupBy("block").agg(F.collect_list("s").alias("s"))
    sent = tiles.index.select("tile", "part", F.col("down").alias("_d"), F.col("across").alias("_a"))
    for side, key in (("left", "_d"), ("right", "_a")):
        sent = sent.join(segments.select(F.col("block").alias(key), F.col("s").alias(side)), key)  # none: all weights there are zero
    met = tiles.cells.join(sent.drop("_d", "_a"), ["tile", "part"]).select("down", "across", "cells", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k in range(b.num_rows):
                down, across = b.column(0)[k].as_py(), b.column(1)[k].as_py()
                x, y, v = (f.to_numpy(zero_copy_only=False) for f in b.column(2)[k].values.flatten())
                ends = []
                for column in (3, 4):
                    at, w = (f.to_numpy(zero_copy_only=False) for f in b.column(column)[k].values.flatten())
                    ends.append(np.zeros(width))
                    ends[-1][at] = w
                v = v * (ends[0][x] * ends[1][y])
                for place, at in ((down, x), (across, y)):
                    sums[place] = sums.get(place, 0.0) + np.bincount(at, weights=v, minlength=width)
        for place, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(at + place * width), pa.array(own[at])], names=["bin_id", "v"])

    return met.mapInArrow(run, "bin_id long, v double").groupBy("bin_id").agg(F.sum("v").alias("marg"))


def balance(matrix: ContactMatrix, p: BalanceParams = BalanceParams(), x0: DataFrame | None = None, blacklist: DataFrame | None = None) -> tuple[DataFrame, BalanceStats]:
    """(bin_id, weight), null where a bin is masked, and how it went."""
    if p.cis_only and p.trans_only:
        raise MatrixError("cis_only and trans_only exclude each other")
    matrix = matrix.with_pixels(materialize(matrix.pixels, "pixels"))
    tiles = tile(select_pixels(matrix, p.ignore_diags, cis=not p.trans_only, trans=not p.cis_only), matrix.bins.agg(F.max("bin_id") + 1).first()[0] or 1)
    written = Rolling()
    bias = written(start_biases(matrix, p, x0, blacklist), "bias")
    share = None
    if p.trans_only:
        n = bias.count()
        share = materialize(bias.groupBy("chrom_id").agg((1.0 / (1.0 - F.count("*") / F.lit(float(n)))).alias("share")), "share")
    by = ["chrom_id"] if p.cis_only else []
    keys = [r.chrom_id for r in bias.select("chrom_id").distinct().orderBy("chrom_id").collect()] if p.cis_only else [None]
    state = {k: {"scale": 1.0, "var": 0.0, "done": False} for k in keys}
    for _ in range(p.max_iters):
        weights = bias.join(F.broadcast(share), "chrom_id").withColumn("w", F.col("bias") * F.col("share")) if share is not None else bias.withColumn("w", F.col("bias"))
        # one table a round holds biases and marginals, which the next biases follow from without a join
        step = bias.join(weighted_marginal(tiles, weights), "bin_id", "left").withColumn("marg", F.coalesce("marg", F.lit(0.0)))
        step = written(step, "marginal")
        table = {(r.chrom_id if by else None): (r.mean, r.var) for r in nonzero_mean_var(step, *by).collect()}
        active = []
        for k in keys:
            if state[k]["done"]:
                continue
            mean, var = table.get(k, (None, None))
            if mean is None:
                state[k] = {"scale": float("nan"), "var": 0.0, "done": True}
            else:
                state[k] = {"scale": mean, "var": var, "done": var < p.tol}
                active.append((k, mean))
        dead = [k for k in keys if state[k]["scale"] != state[k]["scale"]]
        if by:
            means = F.coalesce(*(F.when(F.col("chrom_id") == k, F.lit(m)) for k, m in active), F.lit(None).cast("double"))
        else:
            means = F.lit(active[0][1] if active else None).cast("double")
        rel = F.when(F.col("marg") == 0, 1.0).otherwise(F.col("marg") / F.col("mean"))
        step = step.withColumn("mean", means).withColumn("bias", F.when(F.col("mean").isNotNull(), F.col("bias") / rel).otherwise(F.col("bias")))
        bias = step.select("bin_id", "chrom_id", "bias")
        if dead and (not by or len(dead) == len(keys)) or all(s["done"] for s in state.values()):
            break
    scale: Column = F.lit(1.0)
    if p.rescale:
        scale = F.coalesce(*(F.when(F.col("chrom_id") == k if by else F.lit(True), F.sqrt(F.lit(s["scale"]))) for k, s in state.items() if s["scale"] == s["scale"]), F.lit(1.0))
    lost = [k for k, s in state.items() if s["scale"] != s["scale"]]
    gone = F.col("chrom_id").isin(lost) if by and lost else F.lit(bool(lost))
    out = bias.select("bin_id", F.when((F.col("bias") != 0) & ~gone, F.col("bias") / scale).alias("weight"))
    # a chromosome without any marginal counts as settled, the whole genome doesn't
    stats = BalanceStats([s["scale"] for s in state.values()], [s["var"] for s in state.values()], [s["var"] < p.tol and (bool(by) or s["scale"] == s["scale"]) for s in state.values()])
    return out, stats


def kr_weights(matrix: ContactMatrix, tol: float = 1e-5, max_iters: int = 200) -> tuple[DataFrame, BalanceStats]:
    """Balancing without any filter and with the diagonal."""
    return balance(matrix, BalanceParams(ignore_diags=0, mad_max=0, min_nnz=0, tol=tol, max_iters=max_iters))


def vc_weights(matrix: ContactMatrix, power: float = 0.5) -> DataFrame:
    """(bin_id, weight): the marginal to a power, divisive; null where it is zero."""
    marg = full_marginal(matrix.bins, marginal(matrix.pixels))
    return marg.select("bin_id", F.when(F.col("marg") > 0, F.pow("marg", F.lit(power))).alias("weight"))


def vc_sqrt_weights(matrix: ContactMatrix) -> DataFrame:
    return vc_weights(matrix, 0.25)


def apply_weights(matrix: ContactMatrix, weight: str, divisive: bool, single: str = "") -> DataFrame:
    """(bin1_id, bin2_id, count, balanced).  single: "" in double precision; "ratio" rounds the result
    to single precision and drops masked pixels; "parts" rounds count and weights first and keeps them."""
    w = matrix.bins.select("bin_id", F.col(weight).cast("double").alias("w"))
    px = matrix.pixels
    for k in (1, 2):
        px = px.join(w.withColumnsRenamed({"bin_id": f"bin{k}_id", "w": f"w{k}"}), f"bin{k}_id")
    both = F.col("w1") * F.col("w2")
    if single == "parts":
        value = F.try_divide(F.col("count").cast("float").cast("double"), both.cast("float").cast("double")).cast("float").cast("double")
    else:
        value = F.try_divide(F.col("count"), both) if divisive else F.col("count") * both
        value = value.cast("float").cast("double") if single == "ratio" else value
    out = px.select("bin1_id", "bin2_id", "count", value.alias("balanced"))
    return out.where(finite(F.col("balanced"))) if single == "ratio" else out


def rescaled(weights: DataFrame, target: float) -> DataFrame:
    """Weights whose finite values sum to `target`."""
    total = weights.where(finite(F.col("weight"))).agg(F.sum("weight").alias("_total"))
    return weights.crossJoin(F.broadcast(total)).select("bin_id", F.try_divide(F.col("weight") * target, "_total").alias("weight"))
