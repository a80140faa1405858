"""Rank statistics on small arrays."""

from __future__ import annotations

import math

import numpy as np


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share their mean; NaN last, each of its own rank."""
    values = np.asarray(values, dtype=float)
    order = np.argsort(values, kind="stable")
    s = values[order]
    fresh = np.concatenate([[True], ~(s[1:] == s[:-1])]) if len(s) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    edge = np.concatenate([np.flatnonzero(fresh), [len(s)]])
    out = np.empty(len(s))
    out[order] = 0.5 * (edge[group] + edge[group + 1] + 1)
    return out


def smaller_before(ranks: np.ndarray) -> np.ndarray:
    """How many before each of ranks, 0 to n - 1 in any order, are smaller.

    Bit by bit from the highest, ranks stand in groups that agree in the bits above, each in the order given:
    a rank with the bit set passes those of its group before it without."""
    v = ranks = np.asarray(ranks, dtype=np.int64)
    place, out = np.arange(len(v)), np.zeros(len(v), np.int64)
    for bit in reversed(range(max(len(v) - 1, 0).bit_length())):
        high = (v >> bit & 1).astype(bool)
        group = v >> bit + 1 << bit + 1
        low = np.cumsum(~high) - ~high
        low -= low[group]
        out[v[high]] += low[high]
        v_next = np.empty_like(v)
        v_next[np.where(high, place - low + (1 << bit), group + low)] = v
        v = v_next
    return out[ranks]


def ranksum_p(x: np.ndarray, y: np.ndarray) -> float:
    """Two-sided p of the rank-sum test in normal approximation, without a correction for ties."""
    a, b = len(x), len(y)
    s = average_ranks(np.concatenate([x, y]))[:a].sum()
    spread = math.sqrt(a * b * (a + b + 1) / 12.0)
    return math.erfc(abs((s - a * (a + b + 1) / 2.0) / spread) / math.sqrt(2))
