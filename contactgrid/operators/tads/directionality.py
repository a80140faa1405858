"""Domains from the directionality of contacts, decoded by a hidden Markov model."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ...functions.baum_welch import fit_frame
from ...functions.models import HMM, Mixture, Normal
from ...matrix import ContactMatrix
from .alignment import groups
from .band import banded, chromosome_cells, per_chromosome

MIN_BINS = 5
#: The largest window in base pairs, and the longest gap within a region.
WINDOW, GAP = 2_000_000, 100_000


@dataclass
class Track:
    """A chromosome's band, its windows and directionality.  skip: diagonals left out of it."""

    band: np.ndarray
    resolution: int
    skip: int = 1

    def __post_init__(self):
        self.n = self.band.shape[1]
        self.reach = max(2 + self.skip, min(WINDOW // self.resolution, len(self.band)))

    def sides(self, i: int, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Contacts up- and downstream of bin i at the distances skip + 1 .. w - 1; 0 beyond the ends."""
        d = np.arange(self.skip + 1, w)
        up, down = np.zeros(len(d)), np.zeros(len(d))
        ok = i - d >= 0
        up[ok] = self.band[d[ok], i - d[ok]]
        ok = i + d < self.n
        down[ok] = self.band[d[ok], i]
        return up, down

    def windows(self) -> np.ndarray:
        return np.array([self._window(i) for i in range(self.n)])

    def _window(self, i: int) -> int:
        """The first distance at which the bias of a bin peaks and isn't random; the largest window if none
        is, 0 where most of the near cells hold no difference."""
        up, down = self.sides(i, self.reach)
        diff = up - down
        near = diff[:20]
        if not len(near) or (near == 0).mean() > 0.6:
            return 0
        pool: dict[int, np.ndarray] = {}
        for sign in (diff < 0, diff > 0):
            trend = np.cumsum(sign) / np.arange(1, len(sign) + 1)
            for k in trend_peaks(trend, 0.5, 5):
                pool[k] = sign
        for k in sorted(pool):
            size = k + 1 + self.skip + 1
            if size >= MIN_BINS and not looks_random(pool[k][: k + 1]):
                return size
        return self.reach

    def directionality(self, windows: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for i, w in enumerate(windows):
            w = int(w) or self.reach
            out[i] = bias(*self.sides(i, min(w, self.reach)))
            if out[i] == 0 and w < self.reach:
                out[i] = bias(*self.sides(i, self.reach))
        low, high = out[out < 0], out[out > 0]
        return np.clip(out, np.percentile(low, 0.1) if len(low) else 0.0, np.percentile(high, 99.9) if len(high) else 0.0)


def bias(up: np.ndarray, down: np.ndarray) -> float:
    both = (up != 0) & (down != 0)
    if both.sum() >= 5:
        up, down = up[both], down[both]
    n = len(up)
    if n < 2:
        return 0.0
    spread = math.sqrt((up.var() + down.var()) / (n - 1))
    return float((up.mean() - down.mean()) / spread) if spread else 0.0


def trend_peaks(trend: np.ndarray, least: float, apart: int) -> list[int]:
    """Local maxima over `least`, the last place of a trend that is 1 throughout, and a rising end; within
    `apart` places only the highest."""
    if len(trend) < 2:
        return []
    step = np.diff(trend)
    at = [k for k in range(1, len(trend) - 1) if step[k] < 0 < step[k - 1]]
    ones = np.flatnonzero(trend == 1.0)
    at = ([int(ones[-1])] if len(ones) else []) + at + ([len(trend) - 1] if step[-1] > 0 else [])
    at = [k for k in at if trend[k] > least]
    gone: set[int] = set()
    for k in sorted(at, key=lambda k: -trend[k]):
        if k not in gone:
            gone |= {m for m in at if abs(m - k) <= apart and trend[m] < trend[k]}
    return sorted(set(at) - gone)


def looks_random(bits: np.ndarray, p: float = 0.05) -> bool:
    """Whether the four transitions of a 0/1 sequence may be equally frequent (chi-square, 3 degrees)."""
    counts = np.bincount(2 * bits[:-1].astype(int) + bits[1:].astype(int), minlength=4)
    mean = counts.mean()
    if not mean:
        return True
    x = float(((counts - mean) ** 2 / mean).sum()) / 2
    return math.erfc(math.sqrt(x)) + 2 * math.sqrt(x / math.pi) * math.exp(-x) > p


def regions(di: np.ndarray, resolution: int) -> list[tuple[int, int]]:
    """Stretches without long gaps; a single one ends before its last bin."""
    gap = max(GAP // resolution, 5)
    at = np.flatnonzero(di)
    if len(at) < 2:
        return []
    breaks = np.flatnonzero(np.diff(at) > gap + 1)
    first, last = at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]
    behind = last + 1 if len(breaks) else last
    return [(int(a), int(b)) for a, b in zip(first, behind, strict=True) if b - a > 2 * gap]


def start_model() -> HMM:
    """Four states in a ring, from the start of a domain (0) over up- and downstream bias to its end (3)."""
    spread = 3.75
    means = [[-k * spread - 2.5 for k in range(3)], [-k * spread for k in range(3)], [k * spread for k in range(3)], [k * spread + 2.5 for k in range(3)]]
    moves = np.array([[0, 1, 0, 0], [0, 0.5, 0.5, 0], [0, 0, 0.5, 0.5], [1, 0, 0, 0]], float)
    return HMM([Mixture([Normal(m, spread) for m in ms]) for ms in means], moves, np.array([1, 0, 0, 0]), np.array([0, 0, 0, 1]))


def training_sequences(di: np.ndarray, resolution: int) -> list[np.ndarray]:
    found = [di[a:b][di[a:b] != 0] for a, b in regions(di, resolution)]
    return [x for x in found if len(x) > 20]


def decoded(model: HMM, di: np.ndarray, resolution: int) -> list[tuple[int, int]]:
    """Domains between the places where an end state is followed by a start state."""
    out = []
    for a, b in regions(di, resolution):
        _, path = model.viterbi(di[a:b])
        cuts = [0, *(k + 1 for k in range(len(path) - 1) if path[k] == 3 and path[k + 1] == 0), len(path)]
        out += [(a + x, a + y) for x, y in zip(cuts, cuts[1:], strict=False) if y - x >= MIN_BINS]
    return out


def refined(track: Track, model: HMM, rounds: int = 5) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Domains set the windows of their bins, which give a new directionality, until under a twentieth of
    the domains change."""
    windows = track.windows()
    di = track.directionality(windows)
    domains: list[tuple[int, int]] = []
    for _ in range(rounds):
        new = decoded(model, di, track.resolution)
        off = changed(domains, new)
        domains = new
        for a, b in domains:
            k = np.arange(b - a)
            windows[a:b] = np.maximum(k + 1, b - a - k)
        di = track.directionality(windows)
        if off < 0.05:
            break
    return domains, di


def changed(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> float:
    """The share of old domains that no new one is aligned with, one against one."""
    if not old:
        return 1.0
    return 1 - sum(len(a) == len(b) == 1 for a, b in groups(old, new, MIN_BINS)) / len(old)


def noise(track: Track, a: int, b: int) -> float:
    """The share of empty cells of a domain off the diagonals left out."""
    n = b - a
    if n < MIN_BINS:
        return 1.0
    d = np.arange(track.skip + 1, min(n, len(track.band)))
    filled = sum(int((track.band[k, a : b - k] != 0).sum()) for k in d)
    total = n * n - (track.skip + 1) * (2 * n - track.skip) + n
    return 1 - 2 * filled / total if total >= 5 else 1.0


def call_domains(matrix: ContactMatrix, weight: str | None = None, max_noise: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(domains, track).  domains(chrom_id, start, end, noise), track(chrom_id, start, end, di).

    Directionality is computed by chromosome; one model is fitted to the sequences of all of them; chromosomes
    then decode with it."""
    size = matrix.bin_size
    depth = max(3, WINDOW // size)
    cells = chromosome_cells(matrix, depth, weight)

    def first(chrom: int, n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        t = Track(banded(i, j, v, n, min(depth, max(3, n))), size)
        return pd.DataFrame({"x": [s.tolist() for s in training_sequences(t.directionality(t.windows()), size)]})

    model = start_model()
    fit_frame(model, per_chromosome(cells, first, "x array<double>"), stop=1e-5)

    def second(chrom: int, n: int, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        t = Track(banded(i, j, v, n, min(depth, max(3, n))), size)
        domains, di = refined(t, model)
        rows = [("domain", a * size, b * size, noise(t, a, b)) for a, b in domains]
        rows += [("di", k * size, (k + 1) * size, float(x)) for k, x in enumerate(di)]
        return pd.DataFrame(rows, columns=["kind", "start", "end", "value"])

    both = per_chromosome(cells, second, "kind string, start long, end long, value double")
    domains = both.where(f"kind = 'domain' and value <= {max_noise}").select("chrom_id", "start", "end", both.value.alias("noise"))
    return domains, both.where("kind = 'di'").select("chrom_id", "start", "end", both.value.alias("di"))
