"""Minimisation inside a box by a projected quasi-Newton method.

The objective takes a batch of points at once, so a gradient (central
differences, one-sided at a bound) costs one call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Minimum:
    x: np.ndarray
    value: float
    converged: bool
    steps: int
    #: The estimate of the inverse Hessian at x, for a start nearby.
    inverse: np.ndarray | None = None


def _gradient(f, x, low, high):
    h = 1e-6 * np.maximum(1.0, np.abs(x))
    up, down = np.minimum(x + h, high), np.maximum(x - h, low)
    points = np.repeat(x[None, :], 2 * len(x), axis=0)
    at = np.arange(len(x))
    points[at, at], points[len(x) + at, at] = up, down
    values = f(points)
    width = np.where(up > down, up - down, 1.0)
    return (values[: len(x)] - values[len(x) :]) / width


def minimise(f: Callable[[np.ndarray], np.ndarray], x0, low, high, steps: int = 400, tol: float = 1e-7, inverse: np.ndarray | None = None) -> Minimum:
    """From x0; inverse is an inverse Hessian to start with, such as that of a minimum nearby."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x0, float), low, high)
    value, known = float(f(x[None, :])[0]), inverse is not None
    inverse = inverse.copy() if known else np.eye(len(x))
    g = _gradient(f, x, low, high)
    still = 0
    for step in range(1, steps + 1):
        pinned = ((x <= low) & (g > 0)) | ((x >= high) & (g < 0))
        free = ~pinned
        if not free.any() or np.abs(np.where(free, g, 0.0) * np.minimum(1.0, high - low)).max() < tol:
            return Minimum(x, value, True, step, inverse)
        move = np.zeros_like(x)
        move[free] = -inverse[np.ix_(free, free)] @ g[free]
        if move @ g >= 0:
            inverse = np.eye(len(x))
            move = np.where(free, -g, 0.0)
        # The whole step first, then several shorter ones in one call; the best that decreases enough.
        for lengths in (np.ones(1), 0.5 ** np.arange(1, 12)):
            tried = np.clip(x + lengths[:, None] * move, low, high)
            got = f(tried)
            enough = got <= value + 1e-4 * (tried - x) @ g
            if enough.any():
                break
        if not enough.any():
            if np.array_equal(inverse, np.eye(len(x))):
                return Minimum(x, value, np.abs(np.where(free, g, 0.0)).max() < 1e-3, step, inverse)
            inverse = np.eye(len(x))
            continue
        i = int(np.flatnonzero(enough)[np.argmin(got[enough])])
        after, g_after = tried[i], _gradient(f, tried[i], low, high)
        s, y = after - x, g_after - g
        sy = float(s @ y)
        if sy > 1e-12 * float(np.sqrt((s @ s) * (y @ y))):
            if step == 1 and not known:
                inverse *= sy / float(y @ y)
            hy = inverse @ y
            inverse += (1 + y @ hy / sy) * np.outer(s, s) / sy - (np.outer(hy, s) + np.outer(s, hy)) / sy
        still = still + 1 if value - got[i] < 1e-13 * max(1.0, abs(value)) else 0
        x, value, g = after, float(got[i]), g_after
        if still >= 3:
            return Minimum(x, value, True, step, inverse)
    return Minimum(x, value, False, steps, inverse)
