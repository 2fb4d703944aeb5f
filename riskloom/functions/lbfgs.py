"""L-BFGS with a strong Wolfe line search, as a generator: it yields points and is sent (value, gradient).

Several functions can so be minimized by the same passes over the data.  Steps, constants
and interpolation are those of the optimizer behind Spark's ``LogisticRegression``.
"""

from __future__ import annotations

from collections.abc import Generator

import numpy as np

MEMORY, TRIES, SUFFICIENT, CURVATURE, TOLERANCE = 10, 10, 1e-4, 0.9, 1e-6

Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _between(a: tuple, b: tuple) -> float:
    """The minimum of the cubic through two points (step, value, slope), kept off the ends."""
    d1 = a[2] + b[2] - 3 * (a[1] - b[1]) / (a[0] - b[0])
    width, root = b[0] - a[0], np.sqrt(max(d1 * d1 - a[2] * b[2], 0.0))
    t = b[0] - width * (b[2] + root - d1) / (b[2] - a[2] + 2 * root)
    return float(np.clip(t, a[0] + 0.1 * width, a[0] + 0.9 * width)) if np.isfinite(t) else a[0] + width / 2


def _line(x: np.ndarray, d: np.ndarray, f: float, slope: float, step: float) -> Generator:
    """A step with enough decrease and little slope: (point, value, gradient), or None if none was found."""
    at = lambda t, got: (t, got[0], float(got[1] @ d))
    low, high, t = (0.0, f, slope), None, step
    for i in range(TRIES):
        got = yield (point := x + t * d)
        if not np.isfinite(got[0]):
            t /= 2
            continue
        c = at(t, got)
        if c[1] > f + SUFFICIENT * t * slope or (c[1] >= low[1] and i > 0):
            high = c
            break
        if abs(c[2]) <= CURVATURE * abs(slope):
            return point, *got
        if c[2] >= 0:
            low, high = c, low
            break
        low, t = c, t * 1.5
    for _ in range(TRIES if high else 0):
        t = _between(*sorted((low, high)))
        got = yield (point := x + t * d)
        c = at(t, got)
        if c[1] > f + SUFFICIENT * t * slope or c[1] >= low[1]:
            high = c
        else:
            if abs(c[2]) <= CURVATURE * abs(slope):
                return point, *got
            if c[2] * (high[0] - low[0]) >= 0:
                high = low
            low = c
    return None


def minimize(x: np.ndarray, iterations: int) -> Search:
    """Returns the point after so many iterations, or where the gradient vanishes or no step helps."""
    f, g = yield x
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    done = fresh = 0
    while done < iterations and np.linalg.norm(g) > max(TOLERANCE * abs(f), 1e-8):
        d, used = -g, []
        for s, y, r in reversed(past):
            a = (s @ d) / r
            used.append(a)
            d = d - a * y
        if past:
            s, y, r = past[-1]
            d = d * (r / float(y @ y.astype(float)))
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            d = d + s * (a - (y @ d) / r)
        found = yield from _line(x, d, f, float(g @ d), 1.0 if past else 1 / np.linalg.norm(d))
        if found is None:
            if fresh or not past:
                break
            past, fresh = [], 1  # once more without what was remembered
            continue
        new, value, slope = found
        s, y = (v.astype(np.float32) for v in (new - x, slope - g))  # they only shape the next direction
        if (r := float(s @ y.astype(float))) > 0:
            past = [*past, (s, y, r)][-MEMORY:]
        x, f, g, done, fresh = new, value, slope, done + 1, 0
    return x
