"""Eigenvectors of a symmetric matrix by mixed-precision refinement.

A single-precision decomposition is the start. Each step of Ogita and Aishima
corrects all eigenvectors at once by matrix products in higher precision; errors
shrink quadratically while eigenvalues lie apart. Pairs whose eigenvalues the step
cannot tell apart are only kept orthogonal; their common subspace converges like
the rest, and a decomposition of the small matrix within it (shifted by the
group's mean eigenvalue, so that nothing cancels) then turns the group's vectors.
"""

from __future__ import annotations

import numpy as np

#: Higher than double precision where the platform has it.
WIDE = np.longdouble


def refined_eigenvectors(a: np.ndarray, max_steps: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix in ``WIDE`` precision, as doubles.

    The largest entry of each vector is positive.
    """
    a = np.asarray(a, WIDE)
    d = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(d), np.eye(d)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    norm, tiny = np.sqrt((a * a).sum()), np.finfo(WIDE).eps
    noise = 64 * d * tiny * norm  # differences below it are rounding
    for _ in range(max_steps):
        x, change, groups, values = _step(a, x, norm, noise)
        turned = [_turned(a, x, own, values[own].mean(), noise) for own in groups]
        if change <= 64 * d * tiny and not any(turned):
            break
    x, _, _, values = _step(a, x, norm, noise)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, -1, 1)
    return (values * scale).astype(np.float64), x.astype(np.float64)


def _step(a: np.ndarray, x: np.ndarray, norm: float, noise: float) -> tuple[np.ndarray, float, list[np.ndarray], np.ndarray]:
    """One correction: (vectors, largest change between different groups, groups of close eigenvalues, eigenvalues)."""
    d = len(a)
    r = np.eye(d, dtype=WIDE) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2  # else rounding, divided by a small gap, turns two vectors by different angles
    values = np.diag(s) / (1 - np.diag(r))
    rest = s - np.diag(values)
    apart = max(2 * (np.sqrt((rest * rest).sum()) + norm * np.sqrt((r * r).sum())), noise)
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > apart
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    change = float(np.abs(np.where(far, e, r)).max())
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return x + x @ e, change, [g for g in np.split(order, cuts) if len(g) > 1], values


def _turned(a: np.ndarray, x: np.ndarray, own: np.ndarray, shift: float, noise: float) -> bool:
    """Turns the vectors of one group, in place, to the eigenvectors of the matrix within their span; False if they are already."""
    part = x[:, own]
    within = part.T @ (a @ part - shift * part)
    within = (within + within.T) / 2
    if np.abs(within - np.diag(np.diag(within))).max() <= noise:
        return False
    x[:, own] = part @ np.linalg.eigh((within / np.abs(within).max()).astype(np.float64))[1].astype(WIDE)
    return True
