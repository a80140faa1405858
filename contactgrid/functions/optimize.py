"""Minimisation: limited-memory BFGS, and generalised simulated annealing with local searches."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def forward_gradient(f: Callable[[np.ndarray], float]) -> Objective:
    """f with a gradient by steps of the root of the machine's precision, away from zero."""
    h = math.sqrt(np.finfo(float).eps)

    def both(x: np.ndarray) -> tuple[float, np.ndarray]:
        at = f(x)
        steps = np.where(x < 0, -h, h)
        return at, np.array([(f(x + np.eye(1, len(x), k)[0] * s) - at) / s for k, s in enumerate(steps)])

    return both


def lbfgs(both: Objective, x: np.ndarray, rounds: int = 500, memory: int = 10, gtol: float = 1e-5, ftol: float = 2.22e-9) -> tuple[np.ndarray, float]:
    """Quasi-Newton steps from the last `memory` moves, shortened until the value falls enough."""
    x = np.asarray(x, float)
    value, g = both(x)
    moves: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(rounds):
        if np.abs(g).max(initial=0.0) <= gtol * max(1.0, abs(value)):
            break
        d, kept = g.copy(), []
        for s, y, rho in reversed(moves):
            kept.append(rho * (s @ d))
            d -= kept[-1] * y
        if moves:
            s, y, _ = moves[-1]
            d *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(moves, reversed(kept), strict=True):
            d += s * (a - rho * (y @ d))
        step, slope = 1.0, -(g @ d)
        while step > 1e-16:
            new, g_new = both(x - step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, y = -step * d, g_new - g
        if s @ y > 0:
            moves.append((s, y, 1.0 / (s @ y)))
        fell = value - new
        x, value, g = x + s, new, g_new
        if abs(fell) <= ftol * max(1.0, abs(value), abs(value + fell)):
            break
    return x, value


class _Jumps:
    """Steps of the distorted Cauchy-Lorentz distribution of generalised annealing (Tsallis and Stariolo)."""

    q, tail = 2.62, 1e8

    def __init__(self, rng: np.random.Generator):
        q, self.rng = self.q, rng
        scale = math.exp((4 - q) * math.log(q - 1)) / math.exp((2 - q) * math.log(2) / (q - 1))
        self.a = math.sqrt(math.pi) * scale / (3 - q)
        f = 1 / (q - 1) - 0.5
        self.b = math.pi * (1 - f) / math.sin(math.pi * (1 - f)) / math.gamma(2 - f)

    def draw(self, temperature: float, n: int) -> np.ndarray:
        q = self.q
        width = self.a * temperature ** (1 / (q - 1))
        x, y = self.rng.standard_normal((2, n))
        x *= math.exp(-(q - 1) * math.log(self.b / width) / (3 - q))
        out = x / np.exp((q - 1) * np.log(np.abs(y)) / (3 - q))
        return np.where(np.abs(out) > self.tail, np.sign(out) * self.tail * self.rng.random(n), out)


def anneal(f: Callable[[np.ndarray], float], lower: np.ndarray, upper: np.ndarray, x0: np.ndarray, rounds: int = 100, seed: int = 42, both: Objective | None = None, start: float = 5230.0, restart: float = 2e-5, accept: float = -5.0) -> tuple[np.ndarray, float]:
    """The best (x, f(x)) seen.  Each round jumps with all coordinates and then with one at a time, takes
    falls and, by the falling temperature, some rises, and searches locally from new best points.  The
    seed decides; steps that leave the bounds come back in on the other side."""
    rng = np.random.default_rng(seed)
    jumps, both = _Jumps(rng), both or forward_gradient(f)
    lower, span, n = np.asarray(lower, float), np.asarray(upper, float) - lower, len(x0)

    def inside(x: np.ndarray) -> np.ndarray:
        return lower + np.mod(x - lower, span)

    def local(x: np.ndarray, value: float) -> tuple[np.ndarray, float]:
        y, new = lbfgs(both, x)
        ok = np.isfinite(new) and new < value and (y >= lower).all() and (y <= lower + span).all()
        return (y, new) if ok else (x, value)

    x = np.asarray(x0, float).copy()
    value = f(x)
    best, low = x.copy(), value
    scale, k, idle = 2 ** (jumps.q - 1) - 1, 0, 0
    for _ in range(rounds):
        temperature = start * scale / ((k + 2) ** (jumps.q - 1) - 1)
        if temperature < start * restart:
            x, k = lower + rng.random(n) * span, 0
            value = f(x)
            continue
        better = k == 0
        cool = temperature / (k + 1)
        for j in range(2 * n):
            y = inside(x + jumps.draw(temperature, n)) if j < n else x.copy()
            if j >= n:
                y[j - n] = inside(x + jumps.draw(temperature, 1)[0])[j - n]
            new = f(y)
            rise = 1 - (1 - accept) * (new - value) / cool
            if new < value or rise > 0 and rng.random() <= math.exp(math.log(rise) / (1 - accept)):
                x, value = y, new
            if value < low:
                best, low, better = x.copy(), value, True
        idle = 0 if better else idle + 1
        if better or idle > 10:
            y, new = local(best if better else x, low if better else value)
            if new < low:
                best, low, idle = y.copy(), new, 0
            x, value = y, new
        k += 1
    return best, low
