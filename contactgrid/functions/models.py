"""Gaussian mixtures, discrete emissions and a hidden Markov model with them, in log space."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: Fixed value: the constant of the normal density, as truncated where these models come from.
ROOT_2PI = 2.50662827463


def log_sum(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis=axis) if axis is not None else out.item()


@dataclass
class Normal:
    mean: float
    std: float
    min_std: float = 0.0
    n_statistics = 3

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        return -math.log(self.std * ROOT_2PI) - (np.asarray(x) - self.mean) ** 2 / (2 * self.std**2)

    def statistics(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What a fit needs to know of values; sums over parts of the data are those of the whole."""
        return np.array([w.sum(), (w * x).sum(), (w * x * x).sum()])

    def update(self, sums: np.ndarray) -> None:
        if sums[0] > 0:
            self.mean = float(sums[1] / sums[0])
            var = max(0.0, float(sums[2] / sums[0] - self.mean**2))
            self.std = max(math.sqrt(var), self.min_std) or self.std

    def fit(self, x: np.ndarray, w: np.ndarray) -> None:
        self.update(self.statistics(np.asarray(x, float), w))


@dataclass
class Discrete:
    probability: dict

    @property
    def n_statistics(self) -> int:
        return len(self.probability)

    def log_probability(self, x: Sequence) -> np.ndarray:
        return np.array([math.log(p) if (p := self.probability.get(k, 0.0)) > 0 else -math.inf for k in x])

    def statistics(self, x: Sequence, w: np.ndarray) -> np.ndarray:
        """A sum for each symbol with a probability; others can't be."""
        sums = dict.fromkeys(self.probability, 0.0)
        for k, v in zip(x, w, strict=True):
            if k in sums:
                sums[k] += float(v)
        return np.array(list(sums.values()))

    def update(self, sums: np.ndarray) -> None:
        if sums.sum() > 0:
            self.probability = dict(zip(self.probability, (sums / sums.sum()).tolist(), strict=True))

    def fit(self, x: Sequence, w: np.ndarray) -> None:
        self.update(self.statistics(x, w))


@dataclass
class Mixture:
    parts: list[Normal]
    weights: np.ndarray | None = None

    def __post_init__(self):
        self.weights = np.full(len(self.parts), 1 / len(self.parts)) if self.weights is None else np.asarray(self.weights, float)

    @property
    def n_statistics(self) -> int:
        return sum(p.n_statistics for p in self.parts)

    def _joint(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(self.weights)[:, None] + np.stack([p.log_probability(x) for p in self.parts])

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        return log_sum(self._joint(np.asarray(x, float)), axis=0)

    def statistics(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        joint = self._joint(x)
        share = np.exp(joint - log_sum(joint, axis=0)[None, :]) * w[None, :]
        return np.concatenate([p.statistics(x, s) for p, s in zip(self.parts, share, strict=True)])

    def update(self, sums: np.ndarray) -> None:
        parts = sums.reshape(len(self.parts), -1)
        for p, own in zip(self.parts, parts, strict=True):
            p.update(own)
        if parts[:, 0].sum() > 0:
            self.weights = parts[:, 0] / parts[:, 0].sum()

    def fit(self, x: np.ndarray, w: np.ndarray) -> None:
        """One step of expectation and maximisation with the given weights."""
        self.update(self.statistics(x, w))

    def fit_until(self, x: np.ndarray, w: np.ndarray | None = None, stop: float = 0.1, rounds: int = 1000) -> float:
        w = np.ones(len(x)) if w is None else w
        last = float((self.log_probability(x) * w).sum())
        for _ in range(rounds):
            self.fit(x, w)
            now = float((self.log_probability(x) * w).sum())
            if now - last < stop:
                return now
            last = now
        return last


class HMM:
    """States with emissions, a start and an end.  transitions[s, t], start[s] and end[s] are normalised;
    without any end probability sequences may end anywhere."""

    def __init__(self, emissions: list, transitions: np.ndarray, start: np.ndarray, end: np.ndarray | None = None):
        self.emissions = emissions
        self.start = np.asarray(start, float) / np.sum(start)
        end = np.zeros(len(emissions)) if end is None else np.asarray(end, float)
        total = np.asarray(transitions, float).sum(axis=1) + end
        total = np.where(total > 0, total, 1)
        self.transitions, self.end = np.asarray(transitions, float) / total[:, None], end / total

    def _logs(self):
        with np.errstate(divide="ignore"):
            end = np.log(self.end) if self.end.any() else np.zeros(len(self.end))
            return np.log(self.transitions), np.log(self.start), end

    def _emit(self, x) -> np.ndarray:
        return np.stack([e.log_probability(x) for e in self.emissions], axis=1)

    def forward(self, x) -> tuple[np.ndarray, float]:
        a, start, end = self._logs()
        e = self._emit(x)
        f = np.empty_like(e)
        f[0] = start + e[0]
        for k in range(1, len(e)):
            f[k] = log_sum(f[k - 1][:, None] + a, axis=0) + e[k]
        return f, float(log_sum(f[-1] + end))

    def backward(self, x) -> np.ndarray:
        a, _, end = self._logs()
        e = self._emit(x)
        b = np.empty_like(e)
        b[-1] = end
        for k in range(len(e) - 2, -1, -1):
            b[k] = log_sum(a + (e[k + 1] + b[k + 1])[None, :], axis=1)
        return b

    def log_probability(self, x) -> float:
        return self.forward(x)[1]

    def predict_log_proba(self, x) -> np.ndarray:
        f, total = self.forward(x)
        return f + self.backward(x) - total

    def predict_proba(self, x) -> np.ndarray:
        return np.exp(self.predict_log_proba(x))

    def predict(self, x) -> np.ndarray:
        return self.predict_log_proba(x).argmax(axis=1)

    def viterbi(self, x) -> tuple[float, list[int]]:
        """The likeliest path; of equals the state that comes first.  (-inf, []) if none is possible."""
        a, start, end = self._logs()
        e = self._emit(x)
        v, back = start + e[0], []
        for k in range(1, len(e)):
            step = v[:, None] + a
            back.append(step.argmax(axis=0))
            v = step.max(axis=0) + e[k]
        v = v + end
        best = int(v.argmax())
        if not np.isfinite(v[best]):
            return -math.inf, []
        path = [best]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return float(v[best]), path[::-1]

    def expectations(self, sequences: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(log probabilities, expected transitions, starts, ends, state shares) of sequences: the first by sequence,
        the next three summed up, shares for all their places one behind another.  Those that the model rules out
        have -inf and add nothing.

        All go side by side, the longest first, so a step takes those that reach as far.  Probabilities from either
        side are kept at a sum of one from place to place; what was taken off adds up in logs."""
        sizes = np.array([len(x) for x in sequences])
        by_size = np.argsort(-sizes, kind="stable")
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[by_size]
        active = np.searchsorted(-sizes[by_size], -np.arange(1, sizes.max() + 1), side="right")  # at each place
        logs = self._emit(np.concatenate([np.asarray(x) for x in sequences]))
        top = logs.max(axis=1)
        top = np.where(np.isfinite(top), top, 0.0)
        e, a = np.exp(logs - top[:, None]), self.transitions
        end = self.end if self.end.any() else np.ones(len(self.end))
        # by place, then by sequence: a step reads and writes the head of one plane
        plane = np.arange(sizes.max())[:, None] < sizes[by_size][None, :]
        at = (first[None, :] + np.arange(len(plane))[:, None])[plane]
        emitted = np.zeros((*plane.shape, len(end)))
        emitted[plane] = e[at]
        forth, sums = np.zeros_like(emitted), np.ones(plane.shape)
        now = np.tile(self.start, (len(sizes), 1))
        for k, n in enumerate(active.tolist()):
            now = (now[:n] @ a if k else now) * emitted[k, :n]
            total = now.sum(axis=1)
            sums[k, :n] = total
            now = now / np.maximum(total, 1e-300)[:, None]
            forth[k, :n] = now
        last = forth[sizes[by_size] - 1, np.arange(len(sizes))] @ end
        lean = emitted / np.maximum(sums, 1e-300)[:, :, None]
        backs, turned = np.empty_like(emitted), np.ascontiguousarray(a.T)
        more = 0
        for k in range(len(plane) - 1, -1, -1):
            n = int(active[k])
            backs[k, more:n] = end
            if more:
                backs[k, :more] = (lean[k + 1, :more] * backs[k + 1, :more]) @ turned
            more = n
        ahead, back, weighed, scale = np.empty_like(e), np.empty_like(e), np.empty_like(e), np.empty(len(e))
        ahead[at], back[at], weighed[at], scale[at] = forth[plane], backs[plane], lean[plane], sums[plane]
        who = np.empty(len(e), dtype=np.int64)
        for k, n in enumerate(sizes[by_size].tolist()):
            who[first[k] : first[k] + n] = k
        fine = last > 0
        factor = np.where(fine, 1.0 / np.where(fine, last, 1.0), 0.0)
        share = ahead * back * factor[who][:, None]
        inner = np.setdiff1d(np.arange(len(e)), first, assume_unique=True)  # all but the first places
        moves = a * ((ahead[inner - 1] * factor[who[inner]][:, None]).T @ (weighed[inner] * back[inner]))
        with np.errstate(divide="ignore"):
            found = np.bincount(who, weights=np.log(scale) + top, minlength=len(sizes)) + np.log(np.where(fine, last, 0.0))
        out = np.empty(len(sizes))
        out[by_size] = np.where(fine, found, -np.inf)
        return out, moves, share[first].sum(axis=0), share[first + sizes[by_size] - 1].sum(axis=0), share

    def statistics(self, sequences: list) -> np.ndarray:
        """What a round of fitting needs to know of sequences, one behind another: their log probability, expected
        transitions, starts and ends, and each emission's.  Those that the model rules out add nothing."""
        totals, moves, starts, ends, share = self.expectations(sequences)
        x = np.concatenate([np.asarray(x) for x in sequences])
        own = [e.statistics(x, share[:, k]) for k, e in enumerate(self.emissions)]
        return np.concatenate([[totals[np.isfinite(totals)].sum()], moves.ravel(), starts, ends, *own])

    def update(self, sums: np.ndarray) -> None:
        """A round of Baum-Welch from the sum of all sequences' statistics."""
        n = len(self.start)
        moves, starts, ends, own = np.split(sums[1:], np.cumsum([n * n, n, n]))
        moves = moves.reshape(n, n)
        ends_at = np.cumsum([e.n_statistics for e in self.emissions])
        for emission, part in zip(self.emissions, np.split(own, ends_at[:-1]), strict=True):
            emission.update(part)
        ends = ends if self.end.any() else np.zeros_like(ends)
        row = moves.sum(axis=1) + ends
        ok = row > 0
        self.transitions[ok], self.end[ok] = moves[ok] / row[ok, None], ends[ok] / row[ok]
        if starts.sum() > 0:
            self.start = starts / starts.sum()

    def fit(self, sequences: list, stop: float = 1e-9, rounds: int = 10_000) -> float:
        """Baum-Welch; sequences that the model rules out are passed over.  The log probability at the end."""
        some = [x for x in sequences if len(x)]
        return self.fit_by(lambda: self.statistics(some), stop, rounds) if some else 0.0

    def fit_by(self, statistics: Callable[[], np.ndarray], stop: float, rounds: int) -> float:
        """statistics: gives the sum over all sequences under the model as it stands."""
        last = -math.inf
        for _ in range(rounds):
            sums = statistics()
            if not sums[1:].any() or sums[0] - last < stop:
                return float(sums[0])
            last = float(sums[0])
            self.update(sums)
        return last
