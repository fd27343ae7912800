"""Fitting of linear models."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimum(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int = 100, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function by limited-memory BFGS with step halving."""
    value, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, alphas = g.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d -= alphas[-1] * y
        d *= 1 / (past[-1][2] * (past[-1][1] @ past[-1][1])) if past else 1 / max(1.0, float(np.abs(g).sum()))
        for (s, y, rho), alpha in zip(past, reversed(alphas), strict=True):
            d += s * (alpha - rho * (y @ d))
        step = 1.0
        while step > 1e-10:
            new, new_g = loss(w - step * d)
            if new <= value - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, y = -step * d, new_g - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y, 1 / float(s @ y))]
        done = value - new < 1e-7 * max(1.0, abs(value))
        w, value, g = w + s, new, new_g
        if done:
            break
    return w
