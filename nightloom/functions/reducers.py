"""Robust values of one pixel's stack, as NumPy kernels on an array of samples.

NaN where too few samples are left, +inf where a fit does not converge, -inf where it is implausible.
"""

from __future__ import annotations

import math

import numpy as np


def sigma_clip(values: np.ndarray, n_sigma: float, min_size: int) -> np.ndarray:
    """The finite samples less those n_sigma or more population deviations off the mean, again and again until none is; empty where fewer than min_size are left."""
    kept = values[np.isfinite(values)]
    while len(kept) >= min_size:
        inside = np.abs(kept - kept.mean()) < n_sigma * kept.std()
        if inside.all():
            return kept
        kept = kept[inside]
    return kept[:0]


def clipped_mean(values: np.ndarray, n_sigma: float = 3.0, min_size: int = 10) -> float:
    kept = sigma_clip(values, n_sigma, min_size)
    return float(kept.mean()) if len(kept) else math.nan


def _levenberg_marquardt(model, jacobian, start: np.ndarray, y: np.ndarray, weight: np.ndarray, far, limit: int = 4000) -> np.ndarray | None:
    """The weighted least-squares parameters, or None where the fit does not converge.

    The first two are the centre and the logarithm of the width. Converged is where a step is under 1e-10 of the parameters; far(p) ends a fit that runs away.
    """
    p, damping = start.astype(float), 1e-3
    r = weight * (model(p) - y)
    cost = r @ r
    for _ in range(limit // (len(p) + 1)):
        j = weight[:, None] * jacobian(p)
        a, g = j.T @ j, j.T @ r
        # A centre on a bin has no slope there; it is damped as one a width off, so it doesn't drift.
        steep = weight * model(p) / math.exp(p[1])
        scale = np.diag(np.maximum([max(a[0, 0], steep @ steep), *np.diag(a)[1:]], 1e-300))
        while damping < 1e12:
            try:
                step = np.linalg.solve(a + damping * scale, -g)
            except np.linalg.LinAlgError:
                damping *= 10
                continue
            trial = weight * (model(p + step) - y)
            small = np.abs(step).max() <= 1e-4 * max(np.abs(p).max(), 1e-12)  # there the cost has no digits left to compare
            if np.isfinite(trial).all() and trial @ trial <= cost * (1 + 1e-9 * small) and abs(step[1]) < 1:
                break
            damping *= 10
        else:
            return None
        p, r, cost, damping = p + step, trial, trial @ trial, max(damping / 10, 1e-7)
        if far(p) or np.abs(step).max() <= 1e-10 * max(np.abs(p).max(), 1e-12) and damping <= 1e-6:
            return p
    return None


def _histogram(kept: np.ndarray, min_size: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    bins = min(len(kept) // 5, min_size)
    if not bins:
        return None
    counts, edges = np.histogram(kept, bins)
    return counts.astype(float), (edges[1:] + edges[:-1]) / 2, edges[1] - edges[0]


def gaussian_centre(values: np.ndarray, n_sigma: float = 3.0, min_size: int = 50, amplitude: bool = False) -> float:
    """The centre of a Gaussian fitted to the histogram of the clipped samples, bins weighted by the root of their height.

    amplitude: the height is a parameter of the fit to raw counts; else the histogram is scaled to unit area.
    """
    kept = sigma_clip(values, n_sigma, min_size)
    made = _histogram(kept, min_size) if len(kept) else None
    if made is None:
        return math.nan
    height, x, width = made
    reach = float(np.ptp(x))
    if not reach:
        return math.inf
    start = [x[int(height.argmax())], math.log(reach / 4)]  # the logarithm of the width keeps it over 0
    shape = lambda p: np.exp(-((x - p[0]) ** 2) / (2 * math.exp(2 * p[1])))
    if amplitude:
        start.append(height.max())
        model = lambda p: p[2] * shape(p)

        def jacobian(p):
            e, z = shape(p), (x - p[0]) / math.exp(p[1])
            return np.stack([p[2] * e * z / math.exp(p[1]), p[2] * e * z**2, e], 1)
    else:
        height = height / (width * height.sum())
        model = lambda p: shape(p) / (math.sqrt(2 * math.pi) * math.exp(p[1]))

        def jacobian(p):
            m, z = model(p), (x - p[0]) / math.exp(p[1])
            return np.stack([m * z / math.exp(p[1]), m * (z**2 - 1)], 1)

    implausible = lambda p: math.exp(min(p[1], 700.0)) > 5 * reach
    with np.errstate(all="ignore"):
        found = _levenberg_marquardt(model, jacobian, np.array(start, float), height, np.sqrt(height), lambda p: p[1] > math.log(5 * reach) + 7)
    if found is None:
        return math.inf
    return -math.inf if implausible(found) else float(found[0])


_ERF = np.vectorize(math.erfc, otypes=[float])


def _log_cdf(z: np.ndarray) -> np.ndarray:
    """ln of the normal distribution function, by its asymptotic series far out."""
    far = z < -30
    near = np.log(0.5 * _ERF(-np.maximum(z, -30) / math.sqrt(2)))
    w = np.minimum(z, -30)
    return np.where(far, -0.5 * w * w - np.log(-w) - 0.5 * math.log(2 * math.pi) + np.log1p(-1 / (w * w)), near)


def skew_location(values: np.ndarray, n_sigma: float = 3.0, min_size: int = 50) -> float:
    """The location of a skew-normal fitted to the clipped samples by maximum likelihood (simplex search)."""
    kept = sigma_clip(values, n_sigma, min_size)
    if not len(kept):
        return math.nan

    def loss(p):
        z = (kept - p[1]) / math.exp(p[2])
        return -(math.log(2) * len(z) - p[2] * len(z) - 0.5 * (z @ z) - 0.5 * math.log(2 * math.pi) * len(z) + _log_cdf(p[0] * z).sum())

    spread = kept.std() or 1e-12
    skew = float(np.clip(((kept - kept.mean()) ** 3).mean() / spread**3, -0.99, 0.99))
    found = _simplex(loss, np.array([2 * np.sign(skew) * abs(skew) ** (1 / 3), kept.mean() - 0.6 * np.sign(skew) * spread, math.log(1.2 * spread)]))
    if found is None:
        return math.inf
    return -math.inf if math.exp(found[2]) > 5 * np.ptp(kept) else float(found[1])


def _simplex(f, start: np.ndarray, limit: int = 4000) -> np.ndarray | None:
    """Nelder and Mead's search for a minimum; None where it isn't reached within the limit."""
    points = [start] + [start + (0.1 if not start[k] else 0.1 * abs(start[k])) * np.eye(len(start))[k] for k in range(len(start))]
    ranked = sorted(((f(p), i, p) for i, p in enumerate(points)), key=lambda t: t[:2])
    for serial in range(len(points), limit):
        if ranked[-1][0] - ranked[0][0] < 1e-9 * (abs(ranked[0][0]) + 1e-9):
            return ranked[0][2]
        middle = np.mean([p for _, _, p in ranked[:-1]], axis=0)
        worst = ranked[-1]
        tries = [(f(p), serial, p) for p in (middle + (middle - worst[2]),)]
        if tries[0][0] < ranked[0][0]:
            p = middle + 2 * (middle - worst[2])
            tries.append((f(p), serial, p))
        elif tries[0][0] >= ranked[-2][0]:
            p = middle + 0.5 * ((worst[2] if tries[0][0] >= worst[0] else tries[0][2]) - middle)
            tries = [(f(p), serial, p)]
        best = min(tries, key=lambda t: t[0])
        if best[0] < worst[0]:
            ranked[-1] = best
        else:
            ranked = [ranked[0]] + [(f(q), serial + k, q) for k, (_, _, p) in enumerate(ranked[1:]) for q in (ranked[0][2] + 0.5 * (p - ranked[0][2]),)]
        ranked.sort(key=lambda t: t[:2])
    return None


KERNELS = {
    "clipped_mean": clipped_mean,
    "gaussian": gaussian_centre,
    "gaussian_amplitude": lambda v, n_sigma=3.0, min_size=50: gaussian_centre(v, n_sigma, min_size, amplitude=True),
    "skew_gaussian": skew_location,
}
