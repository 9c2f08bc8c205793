"""Small dense fits in numpy, for use inside one group."""

from __future__ import annotations

import numpy as np


def quantile_regression(x: np.ndarray, y: np.ndarray, q: float, rounds: int = 60, eps: float = 1e-6) -> np.ndarray:
    """Coefficients of the q-quantile by reweighted least squares on the smoothed check loss."""
    scale = max(np.std(y), 1e-12)
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    for k in range(rounds):
        r = y - x @ beta
        w = np.where(r >= 0, q, 1 - q) / np.maximum(np.abs(r), scale * max(eps, 0.1 * 0.7**k))
        xw = x * w[:, None]
        new = np.linalg.lstsq(xw.T @ x + 1e-10 * np.eye(x.shape[1]), xw.T @ y, rcond=None)[0]
        if np.max(np.abs(new - beta)) < 1e-9 * scale and k > 20:
            break
        beta = new
    return beta


def nonnegative_least_squares(x: np.ndarray, y: np.ndarray, positive: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Least squares with the marked coefficients kept at 0 or above."""
    return bounded_solution(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y, positive)


def bounded_solution(a: np.ndarray, b: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The coefficients that minimise beta' a beta / 2 - b' beta, the marked ones at 0 or above, by active sets; columns of zeros get 0."""
    scale = np.where(np.diag(a) > 0, np.sqrt(np.maximum(np.diag(a), 0)), 1.0)
    a, b = a / np.outer(scale, scale), b / scale
    used = np.diag(a) > 0

    def solved(on: np.ndarray) -> np.ndarray:
        out = np.zeros(len(b))
        if on.any():
            out[on] = np.linalg.lstsq(a[np.ix_(on, on)], b[on], rcond=1e-13)[0]
        return out

    on = used & ~positive
    beta = solved(on)
    for _ in range(10 * len(b)):
        pull = b - a @ beta
        ask = used & positive & ~on & (pull > 1e-12 * max(1.0, np.abs(b).max(initial=0.0)))
        if not ask.any():
            break
        on[np.flatnonzero(ask)[np.argmax(pull[ask])]] = True
        while True:
            z = solved(on)
            low = on & positive & (z <= 0)
            if not low.any():
                beta = z
                break
            # Go towards z until the first bounded coefficient reaches 0, which is then left out.
            step = np.min(beta[low] / np.maximum(beta[low] - z[low], 1e-300))
            beta = np.where(on, beta + step * (z - beta), 0.0)
            on &= ~(positive & (beta <= 1e-15))
            beta[~on] = 0.0
    return beta / scale


def recursive_least_squares(x: np.ndarray, y: np.ndarray, forgetting: float, start: float = 1e4) -> np.ndarray:
    """Coefficients after each row; rows without a finite x and y leave them as they were."""
    p, theta = np.eye(x.shape[1]) * start, np.zeros(x.shape[1])
    out = np.zeros_like(x, dtype=float)
    for t in range(len(x)):
        if np.isfinite(y[t]) and np.isfinite(x[t]).all():
            g = p @ x[t] / (forgetting + x[t] @ p @ x[t])
            theta = theta + g * (y[t] - x[t] @ theta)
            p = (p - np.outer(g, x[t] @ p)) / forgetting
        out[t] = theta
    return out


def density(values: np.ndarray, adjust: float = 3.0, points: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian kernel density on a grid, with the rule-of-thumb width times ``adjust``."""
    v = values[np.isfinite(values)]
    iqr = np.subtract(*np.percentile(v, [75, 25]))
    spread = min(np.std(v, ddof=1), iqr / 1.34) if iqr > 0 else np.std(v, ddof=1)
    h = max(1.06 * spread * len(v) ** -0.2 * adjust, 1e-9)
    grid = np.linspace(v.min() - 3 * h, v.max() + 3 * h, points)
    # Binned first, so the cost doesn't grow with the number of values.
    count, edge = np.histogram(v, bins=2048)
    mid = (edge[1:] + edge[:-1]) / 2
    return grid, (np.exp(-0.5 * ((grid[:, None] - mid) / h) ** 2) @ count) / (len(v) * h * np.sqrt(2 * np.pi))


def density_valleys(values: np.ndarray, adjust: float = 3.0) -> np.ndarray:
    """Where the density has local minima."""
    if np.isfinite(values).sum() < 3:
        return np.zeros(0)
    x, d = density(values, adjust)
    return x[1:-1][(d[1:-1] < d[:-2]) & (d[1:-1] <= d[2:])]


def spline_basis(x: np.ndarray, of: np.ndarray, knots: int = 10) -> np.ndarray:
    """Cubic truncated-power basis at x, with knots at quantiles of ``of``."""
    k = np.unique(np.quantile(of, np.linspace(0, 1, knots + 2)[1:-1]))
    scale = lambda v: (v - of.mean()) / max(of.std(), 1e-12)
    s = scale(x)
    return np.stack([np.ones_like(s), s, s**2, s**3, *[np.maximum(s - q, 0) ** 3 for q in scale(k)]], axis=1)


def spline_slope(x: np.ndarray, y: np.ndarray, at: np.ndarray, knots: int = 10, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fit, slope, standard error of the slope) at ``at`` of a penalised cubic spline of y on x."""
    b = spline_basis(x, x, knots)
    d = np.diag([0.0] * 4 + [penalty] * (b.shape[1] - 4))
    inv = np.linalg.pinv(b.T @ b + d)
    coef = inv @ b.T @ y
    free = max(len(x) - np.trace(inv @ b.T @ b), 1.0)
    var = np.sum((y - b @ coef) ** 2) / free
    h = max(np.ptp(x), 1e-9) * 1e-4
    c = (spline_basis(at + h, x, knots) - spline_basis(at - h, x, knots)) / (2 * h)
    return spline_basis(at, x, knots) @ coef, c @ coef, np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c, inv, c) * var, 0))


def loess(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local linear fit with tricube weights."""
    k = max(3, int(np.ceil(span * len(x))))
    out = np.zeros(len(at))
    for i, a in enumerate(at):
        d = np.abs(x - a)
        h = max(np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1], 1e-12)
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        m = np.stack([np.ones_like(x), x - a], axis=1)
        out[i] = np.linalg.lstsq(m * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0][0]
    return out


def out_of_band_periodogram(ts: np.ndarray, taper: float = 0.1) -> float:
    """Share of the cumulative periodogram outside the band expected of white noise."""
    x = ts[np.isfinite(ts)]
    x = x - x.mean()
    n = len(x)
    m = int(n * taper)
    if m:
        w = 0.5 * (1 - np.cos(np.pi * np.arange(1, 2 * m, 2) / (2 * m)))
        x = x * np.concatenate([w, np.ones(n - 2 * m), w[::-1]])
    p = np.abs(np.fft.fft(x)) ** 2 / n
    p = p[1 : n // 2 + 1]
    c = np.cumsum(p) / max(p.sum(), 1e-300)
    f = np.arange(1, len(p) + 1) / len(p)
    half = len(p) - 1
    band = 1.358 / (np.sqrt(half) + 0.12 + 0.11 / np.sqrt(half))
    return float(np.mean(np.abs(c - f) > band))


def whole_day(curve: list | None, hours: int = 24) -> np.ndarray:
    """A day's values at 24 hours: 23 or 25 are brought to 24 at the hour of the clock change, NULL hours interpolated around the clock. NaN without values."""
    v = np.array([np.nan if x is None else x for x in ([] if curve is None else curve)], float)
    if len(v) == hours - 1:
        v = np.insert(v, 2, np.nan)
    elif len(v) == hours + 1:
        v = np.concatenate([v[:2], [np.nanmean(v[2:4]) if np.isfinite(v[2:4]).any() else np.nan], v[4:]])
    elif len(v) != hours and len(v):
        v = np.interp((np.arange(hours) + 0.5) / hours, (np.arange(len(v)) + 0.5) / len(v), v)
    at = np.flatnonzero(np.isfinite(v))
    if not len(at):
        return np.full(hours, np.nan)
    return v if len(at) == hours else np.interp(np.arange(hours), np.concatenate([at - hours, at, at + hours]), np.tile(v[at], 3))


def spectral_clusters(affinity: np.ndarray, k: int, seed: int = 1, restarts: int = 20) -> np.ndarray:
    """Labels from the leading eigenvectors of the normalised affinity, by seeded k-means."""
    d = affinity.sum(1)
    s = affinity / np.sqrt(np.maximum(d, 1e-12))[:, None] / np.sqrt(np.maximum(d, 1e-12))[None]
    v = np.linalg.eigh(s)[1][:, -k:]
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return kmeans(v, k, seed, restarts)


def kmeans(v: np.ndarray, k: int, seed: int = 1, restarts: int = 20) -> np.ndarray:
    rng = np.random.default_rng(seed)
    best, labels = np.inf, np.zeros(len(v), int)
    for _ in range(restarts):
        centre = v[[rng.integers(len(v))]]
        while len(centre) < k:
            d = ((v[:, None] - centre[None]) ** 2).sum(2).min(1)
            centre = np.concatenate([centre, v[[rng.choice(len(v), p=d / d.sum())] if d.sum() > 0 else [0]]])
        for _ in range(100):
            lab = ((v[:, None] - centre[None]) ** 2).sum(2).argmin(1)
            new = np.stack([v[lab == j].mean(0) if (lab == j).any() else centre[j] for j in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        cost = ((v - centre[lab]) ** 2).sum()
        if cost < best - 1e-12:
            best, labels = cost, lab
    return labels


def eigengap(affinity: np.ndarray, least: int, most: int) -> int:
    """Number of clusters at the largest step in the log of the smallest eigenvalues of the Laplacian."""
    lam = np.sort(np.linalg.eigvalsh(np.diag(affinity.sum(1)) - affinity))
    steps = np.diff(np.log(lam - lam.min() + 1e-12))
    return int(max(least, np.argmax(steps[1:most]) + 2)) if len(steps) > 1 else least
