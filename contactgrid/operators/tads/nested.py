"""Hierarchies of domains: bottom domains from directionality, merged where contacts within stand out
against those at the same distance outside, and split again inside by the direction of contacts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ...functions.baum_welch import fit_frame
from ...functions.models import HMM
from ...matrix import ContactMatrix
from ...schema import MatrixError
from .band import banded, chromosome_cells, per_chromosome
from .directionality import MIN_BINS, WINDOW, Track, noise, refined, regions, start_model, training_sequences

Span = tuple[int, int]


@dataclass
class NestedParams:
    max_size: int = 4_000_000
    max_noise: float = 0.2
    weight: str | None = None


def contrast(band: np.ndarray, a: int, b: int, skip: int = 1) -> float:
    """Half the mean of (in - out) / (in + out) over the cells of domain [a, b) beyond `skip` diagonals, each
    against the cells at its distance before and behind that lie across the domain's ends; 0 from fewer
    than four."""
    if b - a < 2:
        return 0.0
    n, depth = band.shape[1], len(band)
    x, y = np.triu_indices(b - a, skip + 1)
    x, y = x + a, y + a
    d = y - x
    ok = d < depth
    x, y, d = x[ok], y[ok], d[ok]
    own = band[d, x]
    total = count = 0.0
    for there, at in ((2 * x - a <= y, x - d), (2 * y - x >= b, y)):
        k = there & (own != 0) & (at >= 0) & (at + d < n)
        other = band[d[k], at[k]]
        some = other != 0
        mine = own[k][some]
        total += float(((mine - other[some]) / (mine + other[some])).sum())
        count += int(some.sum())
    return total * 0.5 / count if count > 3 else 0.0


def best_path(parts: list[Span], scores: dict[Span, float], most: float) -> list[Span]:
    """How runs of `parts` (index pairs) are best merged: every part adds its length times the score of the
    run it is in.  Runs without a score or longer than `most` bins (unless of one part) can't be."""
    n = len(parts)
    best: list[tuple[float, int]] = [(0.0, -1)] + [(-np.inf, -1)] * n
    for j in range(1, n + 1):
        for i in range(j):
            key = (parts[i][0], parts[j - 1][1])
            if key in scores and (i == j - 1 or key[1] - key[0] <= most):
                length = sum(e - s for s, e in parts[i:j])
                value = best[i][0] + length * scores[key]
                if value > best[j][0]:
                    best[j] = (value, i)
    out, j = [], n
    while j > 0 and best[j][1] >= 0:
        out.append((best[j][1], j - 1))
        j = best[j][1]
    return out[::-1]


def separated(track: Track, bottoms: list[Span], p: NestedParams, cache: dict[Span, float]) -> list[Span]:
    """Top domains of one region's bottom domains.  Noisy ones stay alone.  cache: scores by span, which
    callers may share between chromosomes as established tools do."""
    if len(bottoms) < 2:
        return bottoms
    most = p.max_size / track.resolution
    noisy = [noise(track, *b) > p.max_noise for b in bottoms]
    scores: dict[Span, float] = {}
    for i, (a, _) in enumerate(bottoms):
        for j in range(i, len(bottoms)):
            b = bottoms[j][1]
            if j > i and b - a > most:
                break
            if j == i or not noisy[i] and not noisy[j]:
                if (a, b) not in cache:
                    cache[a, b] = contrast(track.band, a, b, track.skip)
                scores[a, b] = cache[a, b]
    return [(bottoms[i][0], bottoms[j][1]) for i, j in best_path(bottoms, scores, most)]


def direction_square(band: np.ndarray, a: int, b: int) -> np.ndarray:
    """[x, y] of domain [a, b): (before - behind) / (before + behind) of row x's cells at distance y - x."""
    size, n = b - a, band.shape[1]
    out = np.zeros((size, size))
    x, y = np.triu_indices(size)
    d, at = y - x, x + a
    ok = d < len(band)
    left = np.where(ok & (at - d >= 0), band[np.minimum(d, len(band) - 1), np.maximum(at - d, 0)], 0.0)
    right = np.where(ok & (at + d < n), band[np.minimum(d, len(band) - 1), at], 0.0)
    both = left + right
    out[x, y] = out[y, x] = np.where(both != 0, (left - right) / np.where(both != 0, both, 1), 0.0)
    return out


def inner_contrast(m: np.ndarray, o: int, e: int, skip: int) -> float:
    """The score of the stretch [o, e) of a direction square: cells that reach over its end from inside
    less those within, by half."""
    n = len(m)
    x, y = np.indices((n, n))
    fine = (y - x > skip) & (np.abs(m) != 1.0)
    over = fine & (y >= e) & (x < e) & (2 * x - o >= y)
    within = fine & (y < e) & (x >= o) & (2 * x >= y) & (2 * x - o <= y)
    count = int(over.sum() + within.sum())
    return 0.5 * float(m[over].sum() - m[within].sum()) / count if count > 3 else 0.0


def split_inside(m: np.ndarray, top: Span, bottoms: list[Span], skip: int, most: float, level: int = 0, out: dict[Span, int] | None = None) -> dict[Span, int]:
    """Levels of the domains inside a top domain."""
    out = {} if out is None else out
    out[top] = level
    inside = sorted(b for b in bottoms if b[0] >= top[0] and b[1] <= top[1])
    if len(inside) > 1:
        scores = {}
        for i in range(len(inside)):
            for j in range(i, len(inside)):
                key = (inside[i][0], inside[j][1])
                scores[key] = inner_contrast(m, key[0] - top[0], key[1] - top[0], skip)
        scores[top] = 0.0
        cuts = [inside[0][0], *(inside[j][1] for _, j in best_path(inside, scores, most)[:-1]), inside[-1][1]]
        if len(cuts) > 2:
            for a, b in zip(cuts, cuts[1:], strict=False):
                lo, hi = a - top[0], b - top[0]
                split_inside(m[lo:hi, lo:hi], (a, b), bottoms, skip, most, level + 1, out)
    return out


def insulation(band: np.ndarray, at: int, width: int = 5) -> float:
    """The mean of the block of `width` bins before bin `at` by as many behind it."""
    n, rows = band.shape[1], np.arange(at - width, at)
    d = np.arange(at + 1, at + width + 1)[None, :] - rows[:, None]
    ok = (rows[:, None] >= 0) & (d < len(band)) & (rows[:, None] + d < n)
    return float(np.where(ok, band[np.minimum(d, len(band) - 1), np.maximum(rows, 0)[:, None]], 0.0).sum()) / width**2


def sharpened(band: np.ndarray, at: int) -> int:
    """The bin among `at` and its neighbours with the least insulation score; the first of equals."""
    near = range(max(0, at - 1), min(band.shape[1], at + 2))
    return min(near, key=lambda k: (insulation(band, k), k))


def levels(spans: list[Span]) -> list[tuple[int, int, int]]:
    """Each span with the number of others that hold it."""
    once = sorted(set(spans))
    return [(a, b, sum(s <= a and b <= e and (s, e) != (a, b) for s, e in once)) for a, b in once]


def snapped(spans: list[tuple[int, int, int]], within: int = 2) -> list[Span]:
    """Ends of a domain go to those of the one just around it where they are at most `within` bins apart."""
    done: dict[Span, Span] = {}
    for a, b, level in sorted(spans, key=lambda s: (s[2], s[0])):
        around = [(s, e) for s, e, lv in spans if lv == level - 1 and s <= a and b <= e]
        new = (a, b)
        if around:
            outer, moved = around[0], done[around[0]]
            new = (moved[0] if a <= outer[0] + within else a, moved[1] if outer[1] <= b + within else b)
        done[a, b] = new
    return sorted(set(done.values()))


def call_track(track: Track, model: HMM, p: NestedParams, cache: dict[Span, float]) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    bottoms, di = refined(track, model)
    found: list[Span] = []
    for a, b in regions(di, track.resolution) or [(0, track.n)]:
        own = [d for d in bottoms if d[0] >= a and d[1] <= b]
        for top in separated(track, own, p, cache):
            if top[1] - top[0] < MIN_BINS:
                continue
            for span in split_inside(direction_square(track.band, *top), top, own, track.skip, p.max_size / track.resolution):
                found.append((sharpened(track.band, span[0]), sharpened(track.band, span[1])))
    kept = levels([s for s in found if s[1] - s[0] >= MIN_BINS])
    return levels(snapped(kept)), di


def call_nested(matrices: dict[int, ContactMatrix], p: NestedParams = NestedParams(), min_chrom_size: int = 0, share_scores: bool = False) -> DataFrame:
    """(chrom_id, start, end, level): each chromosome's domains at the finest of the given resolutions.

    One replicate a resolution.  share_scores: one task goes through all chromosomes in order with one
    table of scores, as established tools do (a score computed for equal positions of an earlier chromosome
    is taken over); otherwise chromosomes are independent tasks."""
    if not matrices:
        raise MatrixError("no datasets")
    size = min(matrices)
    matrix = matrices[size]
    depth = max(3, max(WINDOW, p.max_size) // size)
    big = matrix.bins.groupBy("chrom_id").count().where(f"count * {size} >= {min_chrom_size}").select("chrom_id")
    cells = chromosome_cells(matrix, depth, p.weight).join(big, "chrom_id", "left_semi")
    clip = lambda n: min(depth, max(3, n))

    def first(chrom: int, n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        t = Track(banded(i, j, v, n, clip(n)), size)
        return pd.DataFrame({"x": [s.tolist() for s in training_sequences(t.directionality(t.windows()), size)]})

    model = start_model()
    fit_frame(model, per_chromosome(cells, first, "x array<double>"), stop=1e-5)

    def second(f: pd.DataFrame) -> pd.DataFrame:
        cache: dict[Span, float] = {}
        out = []
        for chrom, g in f.groupby("chrom_id", sort=True):
            n = int(g["n"].iloc[0])
            g = g[g["i"].notna()]
            band = banded(g["i"].to_numpy(np.int64), g["j"].to_numpy(np.int64), g["v"].to_numpy(float), n, clip(n))
            found, _ = call_track(Track(band, size), model, p, cache if share_scores else {})
            out += [(int(chrom), a * size, b * size, level) for a, b, level in found]
        return pd.DataFrame(out, columns=["chrom_id", "start", "end", "level"])

    schema = "chrom_id int, start long, end long, level int"
    return cells.groupBy().applyInPandas(second, schema) if share_scores else cells.groupBy("chrom_id").applyInPandas(second, schema)
