"""Blocks of contacts along the diagonal, found window by window from the direction of contacts: a corner
cell scores high if contacts above its diagonal triangle point one way and those beside it the other."""

from __future__ import annotations

import struct
from dataclasses import astuple, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...matrix import ContactMatrix
from .band import chromosome_cells


@dataclass(frozen=True)
class BlockParams:
    width: int = 2000
    gap: int = 7
    min_block: int = 60
    high_var: float | None = 0.2
    high_sign: float = 0.5
    low_sign_from: float = 0.4
    low_sign_step: float = 0.1


@dataclass(frozen=True)
class Block:
    i: int
    j: int
    score: float
    up_var: float
    low_var: float
    up_sign: float
    low_sign: float


def windows(n_bins: int, width: int) -> list[tuple[int, int]]:
    """(first bin, size): steps of half a width.  The last windows are sized as if they began a width
    before the end but read from their own start, so they are padded with zeros."""
    out = []
    for lo in range(0, n_bins, width // 2):
        hi = min(lo + width, n_bins)
        base = max(0, n_bins - width) if hi == n_bins and n_bins > width // 2 else lo
        out.append((lo, hi - base + 1))
    return out


def direction(m: np.ndarray, gap: int) -> np.ndarray:
    """[i, i + d]: (left - right) / (left + right) of row i's cells at distance d >= gap, where both sides
    have it; NaN where both are empty."""
    n = len(m)
    out = np.zeros((n, n))
    for d in range(gap, n):
        i = np.arange(d, n - d + gap) if d >= 2 * gap else np.arange(d, n - d)
        i = i[(i - d >= 0) & (i + d < n)]
        if not len(i):
            continue
        left, right = m[i, i - d], m[i, i + d]
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i, i + d] = (left - right) / (left + right)
    # a row counts only if it reaches twice the gap to both sides
    i = np.arange(n)
    out[np.minimum(n - (i + gap), i - gap) < gap] = 0.0
    return out


def _triangles(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts, at [a, b], over the upper and the lower triangle that the corner (a, b) spans."""
    n = len(m)
    a, c = np.indices((n, n))
    right = c > a
    half = np.where(right, a + -(-(c - a) // 2), 0)
    cols = np.vstack([np.zeros(n), m.cumsum(axis=0)])
    rows = np.hstack([np.zeros((n, 1)), m.cumsum(axis=1)])
    up = np.where(right, cols[half, c] - cols[a, c], 0.0)
    far = np.minimum(2 * c - a, n - 1)
    low = np.where(right, rows[c, np.maximum(far, 0) + 1] - rows[c, c] - (cols[c + 1, c] - cols[half, c]), 0.0)
    n_up = np.where(right, half - a, 0)
    n_low = np.where(right, far - c + 1 - (c - half + 1), 0)
    return up.cumsum(axis=1), n_up.cumsum(axis=1), low.cumsum(axis=1), n_low.cumsum(axis=1)


def _scaled(m: np.ndarray) -> np.ndarray:
    top = m.max()
    return m * (1.0 / top) if top else m


def corner_blocks(m: np.ndarray, gap: int) -> dict[str, np.ndarray]:
    """The matrices that blocks are read from, of one window."""
    d = np.nan_to_num(direction(m, gap), nan=0.0)
    up, n_up, low, n_low = _triangles(d)
    n_up, n_low = np.where(n_up == 0, 1, n_up), np.where(n_low == 0, 1, n_low)
    up, low = up / n_up, low / n_low
    s_up, _, s_low, _ = _triangles(np.sign(d))
    q_up, _, q_low, _ = _triangles(d * d)
    s_up, s_low = s_up / n_up, s_low / n_low
    v_up, v_low = q_up / n_up - up * up, q_low / n_low - low * low
    score = _scaled(low - up) + _scaled(s_low - s_up) - _scaled(v_up + v_low)
    return {"score": score, "up_sign": s_up, "low_sign": s_low, "up_var": v_up, "low_var": v_low}


def components(positive: np.ndarray) -> list[list[tuple[int, int]]]:
    """Cells that touch, corners included."""
    left = set(zip(*map(np.ndarray.tolist, np.nonzero(positive)), strict=True))
    out = []
    for cell in sorted(left):
        if cell not in left:
            continue
        left.discard(cell)
        group, open_ = [], [cell]
        while open_:
            x, y = open_.pop()
            group.append((x, y))
            for near in ((x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)):
                if near in left:
                    left.discard(near)
                    open_.append(near)
        out.append(group)
    return out


def best_corners(c: dict[str, np.ndarray], var: float | None, sign: float, offset: int = 0) -> list[Block]:
    score = np.where((-c["up_sign"] < sign) | (c["low_sign"] < sign), 0.0, c["score"])
    if var is not None:
        score = np.where(c["up_var"] + c["low_var"] > var, 0.0, score)
    out = []
    for group in components(score > 0):
        i, j = max(group, key=lambda x: score[x])
        at = lambda k: float(c[k][i, j])  # noqa: B023, E731
        out.append(Block(i + offset, j + offset, float(score[i, j]), at("up_var"), at("low_var"), -at("up_sign"), at("low_sign")))
    return out


def table_order(blocks: list[Block]) -> list[Block]:
    """The distinct blocks in the order of a hash table of Java's kind, which the merge depends on."""

    def code(b: Block) -> int:
        h = 1
        for v in astuple(b):
            bits = v if isinstance(v, int) else struct.unpack("<Q", struct.pack("<d", v))[0]
            h = (31 * h + ((bits & 0xFFFFFFFF) if isinstance(v, int) else (bits ^ bits >> 32) & 0xFFFFFFFF)) & 0xFFFFFFFF
        return h ^ h >> 16

    places = 16
    while places < -(-len(blocks) * 4 // 3):
        places *= 2
    once = list(dict.fromkeys(blocks))
    return sorted(once, key=lambda b: code(b) & (places - 1))


def merged(low: list[Block], high: list[Block], min_block: int, resolution: int) -> list[Block]:
    """High-confidence blocks, and wide low-confidence ones that no edge falls into; then near ones are
    averaged, twice."""
    known, out = set(high), list(high)
    edges = {e for b in out for e in (b.i, b.j)}
    for b in table_order(low):
        if b in known or b.j - b.i <= min_block or any(b.i <= e <= b.j for e in edges):
            continue
        edges |= {b.i, b.j}
        out.append(b)
    out = [replace(b, i=b.i * resolution, j=b.j * resolution) for b in out]
    for dist in (5 * resolution, 10 * resolution):
        out = _near_averaged(out, dist)
    return sorted(out, key=lambda b: -(b.up_var + b.low_var))


def _near_averaged(blocks: list[Block], dist: int) -> list[Block]:
    groups: list[tuple[list[int], list[Block]]] = []  # [min i, max i, min j, max j], members
    for b in blocks:
        for box, members in groups:
            if min(abs(box[0] - b.i), abs(box[1] - b.i)) < dist and min(abs(box[2] - b.j), abs(box[3] - b.j)) < dist:
                box[:] = [min(box[0], b.i), max(box[1], b.i), min(box[2], b.j), max(box[3], b.j)]
                members.append(b)
                break
        else:
            groups.append(([b.i, b.i, b.j, b.j], [b]))
    mean = lambda members, k: float(sum(getattr(b, k) for b in members) / len(members))
    return [Block(box[1], box[3], *(mean(m, k) for k in ("score", "up_var", "low_var", "up_sign", "low_sign"))) for box, m in groups]


def call_blocks(matrix: ContactMatrix, p: BlockParams = BlockParams(), weight: str | None = None, divisive: bool = True) -> DataFrame:
    """(chrom_id, start, end, score, up_var, low_var, up_sign, low_sign).

    One task for each window of a chromosome finds the corners at every sign threshold; a task for each
    chromosome merges them.  A window holds width ** 2 cells, whatever the genome."""
    cells = chromosome_cells(matrix, p.width + 1, weight, divisive)
    step = p.width // 2
    # a cell is in the windows that hold both its ends: those that start in (j - width - 1, i]
    first = F.greatest(F.lit(0), F.ceil((F.col("j") - p.width) / step))
    last = F.floor(F.col("i") / step)
    spread = cells.where("i is not null").where(last >= first).withColumn("w", F.explode(F.sequence(first, last)))
    signs = [p.low_sign_from - k * p.low_sign_step for k in range(int(round(p.low_sign_from / p.low_sign_step)) + 1)]

    def window(f: pd.DataFrame) -> pd.DataFrame:
        chrom, n, w = int(f["chrom_id"].iloc[0]), int(f["n"].iloc[0]), int(f["w"].iloc[0])
        at, size = windows(n, p.width)[w]
        i, j = f["i"].to_numpy(int) - at, f["j"].to_numpy(int) - at
        ok = (i >= 0) & (j < size)
        m = np.zeros((size, size))
        m[i[ok], j[ok]] = m[j[ok], i[ok]] = f["v"].to_numpy(float)[ok]
        c = corner_blocks(m, p.gap)
        rows = [(chrom, w, k, *astuple(b)) for k, s in enumerate(signs) for b in best_corners(c, None, s, at)]
        rows += [(chrom, w, -1, *astuple(b)) for b in best_corners(c, p.high_var, p.high_sign, at)]
        return pd.DataFrame(rows, columns=["chrom_id", "w", "pass_no", "i", "j", "score", "up_var", "low_var", "up_sign", "low_sign"])

    values = "score double, up_var double, low_var double, up_sign double, low_sign double"
    found = spread.groupBy("chrom_id", "w").applyInPandas(window, f"chrom_id int, w int, pass_no int, i long, j long, {values}")
    resolution = matrix.bin_size

    def chromosome(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["w"], kind="stable")
        block = lambda r: Block(int(r.i), int(r.j), r.score, r.up_var, r.low_var, r.up_sign, r.low_sign)
        passes = {k: [block(r) for r in g.itertuples()] for k, g in f.groupby("pass_no")}
        low = next((passes[k] for k in range(len(signs)) if passes.get(k)), [])
        rows = [(int(f["chrom_id"].iloc[0]), *astuple(b)) for b in merged(low, passes.get(-1, []), p.min_block, resolution)]
        return pd.DataFrame(rows, columns=["chrom_id", "start", "end", "score", "up_var", "low_var", "up_sign", "low_sign"])

    return found.groupBy("chrom_id").applyInPandas(chromosome, f"chrom_id int, start long, end long, {values}")
