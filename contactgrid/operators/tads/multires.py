"""Domains over a range of resolutions: for each gamma, the best ways to cut a chromosome into domains
that are denser than the average of their size, and a consensus of the domains that persist."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...matrix import ContactMatrix
from .band import banded, chromosome_cells, per_chromosome


@dataclass(frozen=True)
class MultiresParams:
    """max_bins: the longest domain looked at; None: any.  Memory goes with a chromosome's bins times it."""

    gamma_max: float = 0.5
    step: float = 0.05
    top_k: int = 1
    min_mean_samples: int = 100
    just_gamma_max: bool = False
    log: bool = False
    max_bins: int | None = None


def block_sums(band: np.ndarray) -> np.ndarray:
    """s[d, a] of a band: the sum over a <= i <= j <= a + d, from those of the two sizes below."""
    depth, n = band.shape
    s = band.copy()
    for d in range(1, depth):
        k = n - d
        s[d, :k] += s[d - 1, :k] + s[d - 1, 1 : k + 1]
        if d > 1:
            s[d, :k] -= s[d - 2, 1 : k + 1]
        s[d, k:] = 0.0
    return s


def qualities(sums: np.ndarray, gamma: float, min_samples: int) -> np.ndarray:
    """q[d, a] of the domain from bin a to bin a + d: its sum by size ** gamma, less the mean of its size;
    -inf unless positive, and for sizes with under `min_samples` places."""
    depth, n = sums.shape
    out = np.full(sums.shape, -np.inf)
    for d in range(1, depth):
        if n - d >= max(1, min_samples):
            s = sums[d, : n - d] / float(d + 1) ** gamma
            q = s - s.mean()
            out[d, : n - d] = np.where(q > 0, q, -np.inf)
    return out


def best_cuts(q: np.ndarray, top_k: int) -> list[tuple[float, list[tuple[int, int]]]]:
    """The `top_k` best (score, domains) of a band of qualities.  A solution of the first l bins ends in a domain or
    in a stretch without one, and what lies before a stretch ends in a domain.  Of equal ones that counts whose last
    part is longest.  What is carried on from bin to bin are the scores alone."""
    depth, n = q.shape
    score = np.full((n + 1, top_k), -np.inf)  # of the best of the first l bins, by rank
    score[:2, 0] = 0.0
    part = np.ones((n + 1, top_k), dtype=np.int64)  # where their last part begins, counted from 1
    rank = np.zeros((n + 1, top_k), dtype=np.int64)  # of what lies before it
    free: list[tuple[float, int, int]] = []  # the best that end in a stretch behind a domain
    older = newer = [(0.0, 1, 0)]  # those that end in a domain, of the first l - 2 and l - 1 bins
    for length in range(2, n + 1):
        more = [(v, length - 1, r) for r, (v, _, _) in enumerate(older)]
        free = sorted([*free, *more], key=lambda x: -x[0])[:top_k]
        first = np.arange(max(0, length - depth), length - 1)
        gains = score[first] + q[length - 1 - first, first][:, None]
        flat = gains.ravel()
        order = [int(flat.argmax())] if top_k == 1 and len(flat) else np.argsort(-flat, kind="stable")[:top_k].tolist()
        ends = [(float(flat[k]), int(first[k // top_k]) + 1, k % top_k) for k in order]
        ends += [(-np.inf, 1, 0)] * (top_k - len(ends))
        i = j = 0
        for at in range(top_k):
            if j < len(free) and free[j][0] > ends[i][0]:
                score[length, at], part[length, at], rank[length, at] = free[j]
                j += 1
            else:
                score[length, at], part[length, at], rank[length, at] = ends[i]
                i += 1
        older, newer = newer, ends
    out = []
    for start in range(top_k):
        length, r, domains = n, start, []
        while length > 1:
            k, before = int(part[length, r]), int(rank[length, r])
            size = length - k
            if size < depth and q[size, k - 1] > 0:
                domains.append((k - 1, length - 1))
            length, r = k - 1, 0 if start == 0 else min(before, top_k - 1)
        out.append((float(score[n, start]), domains))
    return out


def consensus(weighted: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The set of disjoint domains with the highest total weight."""
    items = sorted(weighted.items(), key=lambda x: (x[0][1], x[0][0]))
    ends = [d[1] for d, _ in items]
    best, take = [0.0], []
    for (start, _), w in items:
        k = int(np.searchsorted(ends, start, side="left"))
        with_it = w + best[min(k, len(best) - 1)]
        take.append(k)
        best.append(max(best[-1], with_it))
    out, j = [], len(items)
    while j:
        if best[j] != best[j - 1]:
            out.append(items[j - 1][0])
            j = take[j - 1]
        else:
            j -= 1
    return sorted(out)


def gammas(p: MultiresParams) -> list[float]:
    if p.just_gamma_max:
        return [p.gamma_max]
    out, g = [], 0.0
    while g <= p.gamma_max + 1e-5:
        out.append(g)
        g += p.step
    return out


def call_multires(matrix: ContactMatrix, p: MultiresParams = MultiresParams()) -> tuple[DataFrame, DataFrame]:
    """(ensemble, domains).  ensemble(chrom_id, gamma, rank, weight, start_bin, end_bin) comes from one task for each
    chromosome, whose sums serve all gammas; domains(chrom_id, start_bin, end_bin, start, end) is their consensus."""
    cells = chromosome_cells(matrix, p.max_bins)

    def call(chrom: int, n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        rows = []
        if n > 1:
            band = banded(i, j, v, n, min(n, p.max_bins or n))
            sums = block_sums(np.where(band > 0, np.log(np.where(band > 0, band, 1)), band) if p.log else band)
            for gamma in gammas(p):
                found = best_cuts(qualities(sums, gamma, p.min_mean_samples), p.top_k)
                top = found[0][0]
                for rank, (score, domains) in enumerate(found):
                    weight = score / top if top else float("nan")
                    rows += [(gamma, rank, weight, a, b) for a, b in domains]
        return pd.DataFrame(rows, columns=["gamma", "rank", "weight", "start_bin", "end_bin"])

    ensemble = per_chromosome(cells, call, "gamma double, rank int, weight double, start_bin long, end_bin long")
    size = matrix.bin_size

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        weights: dict[tuple[int, int], float] = defaultdict(float)
        for a, b, w in zip(f["start_bin"], f["end_bin"], f["weight"], strict=True):
            weights[int(a), int(b)] += w
        rows = [(int(f["chrom_id"].iloc[0]), a, b, a * size, (b + 1) * size - 1) for a, b in consensus(weights)]
        return pd.DataFrame(rows, columns=["chrom_id", "start_bin", "end_bin", "start", "end"])

    persisted = ensemble.groupBy("chrom_id", "start_bin", "end_bin").agg(F.sum("weight").alias("weight"))
    domains = persisted.groupBy("chrom_id").applyInPandas(settle, "chrom_id int, start_bin long, end_bin long, start long, end long")
    return ensemble, domains
