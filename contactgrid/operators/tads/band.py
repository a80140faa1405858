"""Bands of chromosomes as numpy arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...matrix import ContactMatrix, finite
from ..bands import cis_cells


def banded(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int, depth: int) -> np.ndarray:
    """out[d, i] = cell (i, i + d) for d < depth."""
    out = np.zeros((depth, n))
    d = j - i
    near = d < depth
    out[d[near], i[near]] = v[near]
    return out


def symmetric(i: np.ndarray, j: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, n))
    out[i, j] = v
    out[j, i] = v
    return out


def chromosome_cells(matrix: ContactMatrix, depth: int | None = None, weight: str | None = None, divisive: bool = False) -> DataFrame:
    """(chrom_id, n, i, j, v): cells within chromosomes nearer than `depth`, weighted, one row at least a
    chromosome (i null if it has no cell)."""
    px = matrix.pixels
    if weight:
        w = matrix.bins.select("bin_id", F.col(weight).cast("double").alias("w"))
        for k in (1, 2):
            px = px.join(w.withColumnsRenamed({"bin_id": f"bin{k}_id", "w": f"w{k}"}), f"bin{k}_id")
        both = F.col("w1") * F.col("w2")
        v = F.try_divide(F.col("count"), both) if divisive else F.col("count") * both
        px = px.select("bin1_id", "bin2_id", v.alias("count")).where(finite(F.col("count")))
    cells = cis_cells(px, matrix.bins)
    if depth is not None:
        cells = cells.where(F.col("d") < depth)
    n = matrix.bins.groupBy("chrom_id").agg(F.count("*").alias("n"))
    return n.join(cells.drop("d"), "chrom_id", "left")


def per_chromosome(cells: DataFrame, call: Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """Runs call(chrom_id, n, i, j, v) for each chromosome; its frame lacks chrom_id, which is added."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        chrom, n = int(f["chrom_id"].iloc[0]), int(f["n"].iloc[0])
        f = f[f["i"].notna()]
        out = call(chrom, n, f["i"].to_numpy(dtype=np.int64), f["j"].to_numpy(dtype=np.int64), f["v"].to_numpy(dtype=np.float64))
        out.insert(0, "chrom_id", chrom)
        return out

    return cells.groupBy("chrom_id").applyInPandas(run, f"chrom_id int, {schema}")
