"""Normalisation by an objective: weights under which the expected contacts of each distance explain the
observed ones with the least absolute error, window by window along the chromosomes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.optimize import anneal
from ..matrix import ContactMatrix, chrom_offsets
from .tads.band import chromosome_cells


@dataclass(frozen=True)
class ObjectiveParams:
    window: int = 200
    max_distance: int = 200
    ignore_diags: int = 0
    min_nnz: int = 10
    rounds: int = 100
    lower: float = 0.001
    upper: float = 1000.0
    widen: int = 10
    least_count: float = 400.0
    top: float = 99.0
    bottom: float = 1.0
    seed: int = 42


def marginal(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row sums with the diagonal counted once."""
    off = i != j
    return np.bincount(i, weights=v, minlength=n) + np.bincount(j[off], weights=v[off], minlength=n)


def start_weights(marg: np.ndarray, included: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, valid): the root of each marginal over their mean; marginals five deviations under the
    median of the logarithms are out."""
    m = np.where(np.isin(np.arange(len(marg)), included), marg, 0.0) if included is not None else marg.copy()
    logs = np.log(m[m > 0])
    if not len(logs):
        return np.zeros(len(m)), np.zeros(len(m), bool)
    mid = np.median(logs)
    m[m < np.exp(mid - 5 * np.median(np.abs(logs - mid)))] = 0
    w = np.sqrt(m / m[m > 0].mean())
    return w, w > 0


def expected(sums: np.ndarray, pairs: np.ndarray, widen: int, least_count: float) -> np.ndarray:
    """Of each distance, by the smallest window of distances around it with over `least_count` contacts;
    NaN without one."""
    out = np.full(len(sums), np.nan)
    s, p = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(pairs)])
    k = np.arange(len(sums))
    for w in range(widen + 1):
        lo, hi = np.maximum(0, k - w), np.minimum(len(sums), k + w + 1)
        total = s[hi] - s[lo]
        fill = np.isnan(out) & (total > least_count)
        out[fill] = total[fill] / (p[hi] - p[lo])[fill]
    return out


def distance_sums(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, valid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Contacts of valid bins, and pairs of them, at each distance."""
    ok = valid[i] & valid[j] & (j - i <= most)
    sums = np.bincount((j - i)[ok], weights=v[ok], minlength=most + 1)
    pairs = np.array([float((valid[: n - d] & valid[d:]).sum()) if d < n else 0.0 for d in range(most + 1)])
    return sums, pairs


def windows(length: int, size: int, width: int) -> list[tuple[int, int]]:
    """Bins [from, to): steps of nine tenths of `width` base pairs; the last window takes up to half as
    much again."""
    out, at = [], 0
    while at < length:
        if length - at <= width // 2 * 3:
            out.append((at // size, -(-length // size)))
            break
        out.append((at // size, (at + width) // size))
        at += width // 10 * 9
    return out


def run_windows(included: np.ndarray, size: int, width: int) -> list[tuple[int, int]]:
    """The same within each run of included bins, which are sorted."""
    out = []
    for run in np.split(included, np.flatnonzero(np.diff(included) > 1) + 1):
        if len(run):
            at, end = int(run[0]) * size, int(run[-1]) * size
            while at < end:
                if end - at <= width // 2 * 3:
                    out.append((at // size, end // size))
                    break
                out.append((at // size, (at + width) // size))
                at += width // 10 * 9
    return out


def combined(found: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
    """Each bin's running average over its windows in order; zero stands for none yet."""
    out = np.zeros(n)
    for (a, b), w in sorted(found.items()):
        out[a:b] = np.where(out[a:b] == 0, w, (out[a:b] + w) / 2)
    return out


def typical(i: np.ndarray, j: np.ndarray, v: np.ndarray, ed: np.ndarray, valid: np.ndarray, p: ObjectiveParams) -> np.ndarray:
    """Cells of valid bins whose contacts over expectation lie strictly between the percentiles."""
    d = j - i
    known = np.flatnonzero(~np.isnan(ed))
    most = known[-1] if len(known) else 0
    ok = (d >= p.ignore_diags) & (d <= most) & (v > 0)
    ok &= valid[i] & valid[j]
    ok[ok] = ~np.isnan(ed[d[ok]])
    if not ok.any():
        return ok
    ratio = v[ok] / ed[d[ok]]
    ok[ok] = (ratio > np.percentile(ratio, p.bottom)) & (ratio < np.percentile(ratio, p.top))
    return ok


def fit_window(n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray, e: np.ndarray, x0: np.ndarray, p: ObjectiveParams) -> np.ndarray:
    """Log10 weights of the least sum of |v - e * 10^(x_i + x_j)|."""
    ln10 = np.log(10.0)

    def value(x: np.ndarray) -> float:
        return float(np.abs(v - e * np.exp(ln10 * (x[i] + x[j]))).sum())

    def both(x: np.ndarray) -> tuple[float, np.ndarray]:
        model = e * np.exp(ln10 * (x[i] + x[j]))
        slope = np.sign(model - v) * model * ln10
        return float(np.abs(v - model).sum()), np.bincount(i, weights=slope, minlength=n) + np.bincount(j, weights=slope, minlength=n)

    low, high = np.full(n, np.log10(p.lower)), np.full(n, np.log10(p.upper))
    return anneal(value, low, high, x0, p.rounds, p.seed, both)[0]


def normalize(matrix: ContactMatrix, p: ObjectiveParams = ObjectiveParams(), chroms: list[str] | None = None, included: dict[str, list[int]] | None = None) -> DataFrame:
    """(bin_id, weight): 10 to minus the fitted weight, null where a bin has too few cells or its window too
    few valid bins, 0 in chromosomes not asked for.

    Sums by distance come from every chromosome as short arrays; the driver makes the expectation of
    them; each chromosome's windows are then fitted in a task of its own."""
    table = {r.chrom_id: r for r in chrom_offsets(matrix.chroms, matrix.bin_size).collect()}
    asked = [k for k, r in table.items() if chroms is None or r.name in chroms]
    only = {k: np.array(sorted(included[r.name])) for k, r in table.items() if included and r.name in included}
    cells = chromosome_cells(matrix).where(F.col("chrom_id").isin(asked)) if asked else chromosome_cells(matrix).limit(0)
    size, most = matrix.bin_size, p.max_distance

    def arrays(f: pd.DataFrame):
        f2 = f[f["i"].notna()]
        return int(f["chrom_id"].iloc[0]), int(f["n"].iloc[0]), f2["i"].to_numpy(np.int64), f2["j"].to_numpy(np.int64), f2["v"].to_numpy(float)

    def first(f: pd.DataFrame) -> pd.DataFrame:
        chrom, n, i, j, v = arrays(f)
        valid = marginal(n, i, j, v) > 0
        if chrom in only:
            valid &= np.isin(np.arange(n), only[chrom])
        sums, pairs = distance_sums(n, i, j, v, valid, most)
        return pd.DataFrame({"d": np.arange(most + 1), "s": sums, "p": pairs})

    total = cells.groupBy("chrom_id").applyInPandas(first, "d int, s double, p double").groupBy("d").agg(F.sum("s").alias("s"), F.sum("p").alias("p")).orderBy("d").toPandas()
    ed = expected(total["s"].to_numpy(), total["p"].to_numpy(), p.widen, p.least_count) if len(total) else np.full(most + 1, np.nan)
    lengths = {k: int(r.length) for k, r in table.items()}
    firsts = {k: int(r.first_bin) for k, r in table.items()}

    def second(f: pd.DataFrame) -> pd.DataFrame:
        chrom, n, i, j, v = arrays(f)
        inside = only.get(chrom)
        w0, valid = start_weights(marginal(n, i, j, v), inside)
        w0 = np.where(w0 > 0, np.log10(np.where(w0 > 0, w0, 1)), w0)
        ok = typical(i, j, v, ed, valid, p)
        i, j, v = i[ok], j[ok], v[ok]
        e = ed[j - i]
        found = {}
        spans = windows(lengths[chrom], size, p.window * size) if inside is None else run_windows(inside, size, p.window * size)
        for a, b in spans:
            if inside is None and valid[a:b].mean() < 0.1:
                found[a, b] = np.full(b - a, np.nan)
                continue
            k = (i >= a) & (j < b)
            found[a, b] = fit_window(b - a, i[k] - a, j[k] - a, v[k], e[k], w0[a:b], p)
        w = combined(found, n)
        w[np.bincount(i, minlength=n) + np.bincount(j, minlength=n) < p.min_nnz] = np.nan
        return pd.DataFrame({"bin_id": firsts[chrom] + np.arange(n), "weight": 10.0**-w})

    got = cells.groupBy("chrom_id").applyInPandas(second, "bin_id long, weight double")
    out = matrix.bins.join(got, "bin_id", "left")
    return out.select("bin_id", F.when(F.col("chrom_id").isin(asked) if asked else F.lit(False), F.when(~F.isnan("weight"), F.col("weight"))).otherwise(0.0).alias("weight"))
