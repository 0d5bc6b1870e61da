"""Factor loadings of each instrument through time: instruments streamed in order, some at once, numpy inside.

An instrument's history is a few thousand weeks at most, so a block of them is bounded by the calendar; tasks share the instruments.
Input rows are (instrument, date, ret, one column a factor); output rows (instrument, date, factor, loading, se, resid_var, n).
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the estimators.
WINDOW, LEAST, HUBER, MAD = 156, 104, 1.345, 1.4826
DISCOUNTS = (0.97, 0.98, 0.99, 0.995, 0.999)
HALF_LIVES = (13, 26, 52, 104)
NOISE = (0.25, 1.0, 4.0)
RESTARTS, ROUNDS = 10, 100
PEERS, REGIME_WEEKS = 3, 14.0
PRIOR_COV, PRIOR_VAR, PRIOR_WEIGHT = 1e6, 1e-4, 1.0
#: Weeks whose regimes are fitted as one batch, windows solved at once, and instruments of a block.
WEEKS, CHUNK, BLOCK = 16, 256, 64

#: For each week: loadings, their covariance, residual variance, observations used. Weeks without an estimate are nan.
Path = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _padded(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ok, z, y) of instruments (first axis) by row: z with the intercept; unobserved rows are zeros."""
    ok = np.isfinite(y) & np.isfinite(f).all(axis=2)
    z = np.concatenate([np.ones((*y.shape, 1)), f], axis=2)
    return ok, np.where(ok[:, :, None], z, 0.0), np.where(ok, y, 0.0)


def _moments(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The products of (z, y) with themselves, a row each: upper triangle of z z', then z y, then y y."""
    i, j = np.triu_indices(z.shape[-1])
    return np.concatenate([z[..., i] * z[..., j], z * y[..., None], (y * y)[..., None]], axis=-1)


def _unpacked(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``_moments`` rows (n, q) as matrices (n, p, p), vectors (n, p) and numbers (n)."""
    i, j = np.triu_indices(p)
    a = np.empty((len(s), p, p))
    a[:, i, j] = a[:, j, i] = s[:, : len(i)]
    return a, s[:, len(i) : len(i) + p], s[:, -1]


def _window_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last WINDOW rows of x (instrument, row, column), from sums within blocks: nothing is subtracted, so old rows leave no trace."""
    m, n, c = x.shape
    whole = np.zeros((m, -(-n // WINDOW), WINDOW, c))
    whole.reshape(m, -1, c)[:, :n] = x
    out = np.cumsum(whole, axis=2).reshape(m, -1, c)[:, :n]
    rest = np.cumsum(whole[:, :, ::-1], axis=2)[:, :, ::-1].reshape(m, -1, c)
    start = np.arange(n) - WINDOW + 1
    both = (start > 0) & (start % WINDOW > 0)
    out[:, both] += rest[:, start[both]]
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Inverses of many symmetric matrices (n, p, p) by elimination; the pseudo-inverse of those near singular."""
    n, p, _ = a.shape
    x = np.ascontiguousarray(a.transpose(1, 2, 0))
    own = x[np.arange(p), np.arange(p)].copy()
    good, top = np.ones(n, bool), own.max(axis=0)
    with np.errstate(all="ignore"):
        for j in range(p):
            pivot = x[j, j].copy()
            good &= (pivot > 1e-6 * own[j]) & (pivot > 1e-12 * top)
            column, row = x[:, j].copy(), x[j] / pivot
            x -= column[:, None] * row[None]
            x[:, j], x[j], x[j, j] = -column / pivot, row, 1 / pivot
    out = np.ascontiguousarray(x.transpose(2, 0, 1))
    if not good.all():
        out[~good] = np.linalg.pinv(a[~good], hermitian=True)
    return out


def _solved(s: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares from sums of ``_moments`` rows: coefficients, inverse moments, sum of squared residuals, and whether that sum has digits left."""
    a, v, yy = _unpacked(s, p)
    inv = _inverse(a)
    b = (inv @ v[:, :, None])[:, :, 0]
    left = yy - 2 * (b * v).sum(axis=1) + ((a @ b[:, :, None])[:, :, 0] * b).sum(axis=1)
    return b, inv, np.maximum(left, 0.0), left > 1e-7 * yy


def _rolling(y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least squares on the windows of all weeks with enough observations: (due, coefficients, inverse moments, residual variance, count); nan where a week is not due."""
    ok, z, y = _padded(y, f)
    m, n, p = z.shape
    sums = _window_sums(np.concatenate([_moments(z, y), ok[:, :, None]], axis=2))
    count = np.rint(sums[:, :, -1]).astype(int)
    due = count >= LEAST
    b, inv, var = np.full((m, n, p), np.nan), np.full((m, n, p, p), np.nan), np.full((m, n), np.nan)
    b[due], inv[due], left, sure = _solved(sums[due][:, :-1], p)
    i, t = np.nonzero(due)
    for r in np.flatnonzero(~sure):  # a fit with hardly a residual: row by row
        at = slice(max(0, t[r] + 1 - WINDOW), t[r] + 1)
        left[r] = (ok[i[r], at] * (y[i[r], at] - z[i[r], at] @ b[i[r], t[r]]) ** 2).sum()
    var[due] = left / np.maximum(count[due] - p, 1)
    return due, b, inv, var, count


def _least_squares(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted coefficients and inverse moments of many windows: z (t, w, p), y and w (t, w)."""
    zw = z * w[:, :, None]
    inv = np.linalg.pinv(zw.transpose(0, 2, 1) @ z, hermitian=True)
    return (inv @ (zw.transpose(0, 2, 1) @ y[:, :, None]))[:, :, 0], inv


def _ols_of(y: np.ndarray, f: np.ndarray) -> Path:
    _, b, inv, var, count = _rolling(y, f)
    return b[:, :, 1:], inv[:, :, 1:, 1:] * var[:, :, None, None], var, count


def _weighted(q: np.ndarray, w: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted sums of ``_moments`` rows q (n, column, row) as matrices and vectors."""
    a, v, _ = _unpacked((q @ w[:, :, None])[:, :, 0], p)
    return a, v


def _huber_windows(z: np.ndarray, y: np.ndarray, b: np.ndarray, size: np.ndarray, rounds: int = 200) -> Path:
    """Windows of ``size`` observations each, at their end: z (n, p, c), y (n, c), zeros before it, b the least squares. Iteratively
    reweighted with residuals scaled by their median absolute deviation; sandwich covariance, plain residual variance."""
    n, p, c = z.shape
    if (size < c).any():
        y = np.where(np.arange(c) < c - size[:, None], np.nan, y)
    q = np.ascontiguousarray(_moments(z.transpose(0, 2, 1), np.nan_to_num(y)).transpose(0, 2, 1))
    residual = lambda z, y, b: y - (b[:, None, :] @ z)[:, 0]
    b, scale, live = b.copy(), np.ones(n), np.arange(n)
    zl, yl, ql, bl, on = z, y, q, b.copy(), np.ones(n, bool)
    low, high = (c - 1) // 2, c // 2

    def middle(s: np.ndarray) -> np.ndarray:
        k = size[live]
        return (s[np.arange(len(s)), (k - 1) // 2] + s[np.arange(len(s)), k // 2]) / 2

    def middle_of_far(s: np.ndarray) -> np.ndarray:
        """The median distance from the median of sorted rows, nan last. In full rows the nearest k are neighbours, so the k-th distance is a least largest one."""
        far = np.abs(s - middle(s)[:, None])
        if (size[live] < c).any():
            return middle(np.sort(far, axis=1))
        kth = lambda k: np.maximum(far[:, : c - k], far[:, k:]).min(axis=1)
        return kth(low) if low == high else (kth(low) + kth(high)) / 2

    for _ in range(rounds):
        e = residual(zl, yl, bl)
        own = np.maximum(MAD * middle_of_far(np.sort(e, axis=1)), 1e-14)
        w = np.fmin(1, (HUBER * own)[:, None] / np.fmax(np.abs(e), 1e-300))  # rows before a window meet moments of zero
        a, v = _weighted(ql, w, p)
        new = (_inverse(a) @ v[:, :, None])[:, :, 0]
        moved = np.abs(new - bl).max(axis=1) >= 1e-10 * (1 + np.abs(bl).max(axis=1))
        b[live[on]], scale[live[on]] = new[on], own[on]
        on &= moved
        if not on.any():
            break
        bl = new
        if on.sum() < 0.7 * len(on):
            live, bl, zl, yl, ql = (x[on] for x in (live, bl, zl, yl, ql))
            on = np.ones(len(live), bool)
    e = np.nan_to_num(residual(z, y, b))
    u = e / scale[:, None]
    bread = _inverse(_weighted(q, (np.abs(u) <= HUBER) / size[:, None], p)[0])
    meat = _weighted(q, np.clip(u, -HUBER, HUBER) ** 2 / size[:, None], p)[0]
    return b, bread @ meat @ bread * (scale**2 / size)[:, None, None], (e**2).sum(axis=1) / np.maximum(size - p, 1), size


def _huber_of(y: np.ndarray, f: np.ndarray) -> Path:
    """Full windows and shorter ones apart, CHUNK at a time."""
    ok, z, y = _padded(y, f)
    due, b, inv, var, count = _rolling(np.where(ok, y, np.nan), f)
    i, t = np.nonzero(due)
    seen = np.cumsum(ok).reshape(ok.shape)  # observed rows of all instruments, one after the other
    zs, ys, end, size = z[ok], y[ok], seen[i, t], count[i, t]
    out_b, out_c, out_v = (np.full(a.shape, np.nan) for a in (b, inv, var))
    for part in (np.flatnonzero(size == WINDOW), np.flatnonzero(size < WINDOW)):
        for r in np.split(part, range(CHUNK, len(part), CHUNK)) if len(part) else []:
            at = end[r][:, None] - WINDOW + np.arange(WINDOW)
            own = np.arange(WINDOW) >= WINDOW - size[r][:, None]
            at = np.maximum(at, 0)
            zr, yr = np.where(own[:, :, None], zs[at], 0.0), np.where(own, ys[at], 0.0)
            made = _huber_windows(np.ascontiguousarray(zr.transpose(0, 2, 1)), yr, b[i[r], t[r]], size[r])
            out_b[i[r], t[r]], out_c[i[r], t[r]], out_v[i[r], t[r]] = made[:3]
    return out_b[:, :, 1:], out_c[:, :, 1:, 1:], out_v, count


def _observe(m: np.ndarray, c: np.ndarray, s: np.ndarray, nu: np.ndarray, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One observation of many linear models (last axis): state (p, n), scaled covariance (p, p, n), noise variance, and log Student-t scores.

    ``nu`` is a whole number; z (p, n), y and nu (n).
    """
    rz = (c * z).sum(axis=1)
    q = 1 + (rz * z).sum(axis=0)
    e = y - (m * z).sum(axis=0)
    wide = s * q
    score = _gammas(int(nu.max()))[nu.astype(int)] - 0.5 * np.log(nu * np.pi * wide) - (nu + 1) / 2 * np.log1p(e * e / (nu * wide))
    later = s * (nu + e * e / wide) / (nu + 1)
    c = (c - rz[:, None] * rz[None] / q) * (s / later)
    return m + rz * (e / q), (c + c.transpose(1, 0, 2)) / 2, later, score


@functools.lru_cache(16)
def _gammas(n: int) -> np.ndarray:
    """lgamma((nu + 1) / 2) - lgamma(nu / 2) for nu up to ``n``."""
    return np.array([0.0] + [math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) for nu in range(1, n + 1)])


def _discount_of(y: np.ndarray, f: np.ndarray) -> Path:
    """Random-walk loadings whose state noise comes from discounting; each week takes the discount that predicted best up to it, the first one if tied."""
    ok, z, y = _padded(y, f)
    count = _counted(ok)
    due = count >= LEAST
    i, n, p = z.shape
    g = len(DISCOUNTS)
    d = np.tile(DISCOUNTS, i)  # models of an instrument are neighbours on the last axis
    m, c, s, nu = np.zeros((p, i * g)), np.tile(np.eye(p)[:, :, None] * PRIOR_COV, i * g), np.full(i * g, PRIOR_VAR), np.full(i * g, PRIOR_WEIGHT)
    total = np.zeros(i * g)
    beta, cov, var = np.full((i, n, p - 1), np.nan), np.full((i, n, p - 1, p - 1), np.nan), np.full((i, n), np.nan)
    for t in range(n):
        c = c / d
        seen = np.repeat(ok[:, t], g)
        new_m, new_c, new_s, gain = _observe(m, c, s, nu, np.repeat(z[:, t].T, g, axis=1), np.repeat(y[:, t], g))
        m, c, s = np.where(seen, new_m, m), np.where(seen, new_c, c), np.where(seen, new_s, s)
        nu, total = nu + seen, total + np.where(seen, gain, 0.0)
        at = np.flatnonzero(due[:, t])
        own = at * g + total.reshape(i, g)[at].argmax(axis=1)
        beta[at, t], cov[at, t], var[at, t] = m[1:, own].T, (s[own] * c[1:, 1:, own]).transpose(2, 0, 1), s[own]
    return beta, cov, var, np.cumsum(ok, axis=1)


def _counted(ok: np.ndarray) -> np.ndarray:
    """``_in_window`` of instruments by row."""
    total = np.concatenate([np.zeros((len(ok), WINDOW), int), np.cumsum(ok, axis=1)], axis=1)
    return total[:, WINDOW:] - total[:, :-WINDOW]


def _reverting_of(y: np.ndarray, f: np.ndarray) -> Path:
    """Loadings as a constant mean and a deviation that decays, both filtered; a week holds its forecast of the next week's loading.

    The state (intercept, means, deviations) starts at the first window's least squares. A deviation's stationary covariance is
    q times the unscaled covariance of the last window's loadings. Pairs of half-life and q compete by their scores so far.
    """
    due, b, inv, first_var, count = _rolling(y, f)
    ok, z, y = _padded(y, f)
    i, n, k = f.shape
    beta, cov, var = np.full((i, n, k), np.nan), np.full((i, n, k, k), np.nan), np.full((i, n), np.nan)
    half, q = (np.tile(np.array(a, float), i) for a in zip(*((h, x) for h in HALF_LIVES for x in NOISE)))
    phi, g, p = 0.5 ** (1 / half), len(HALF_LIVES) * len(NOISE), 1 + 2 * k
    first = np.where(due.any(axis=1), due.argmax(axis=1), n)
    m, c, s, nu, total = np.zeros((p, i * g)), np.zeros((p, p, i * g)), np.ones(i * g), np.ones(i * g), np.zeros(i * g)
    decay = np.concatenate([np.ones((1 + k, i * g)), np.repeat(phi[None], k, axis=0)])
    known, low, high = np.zeros((k, k, i * g)), slice(1, 1 + k), slice(1 + k, p)
    for t in range(int(first.min()), n):
        seen = np.repeat(ok[:, t] & (t > first), g)
        row = np.repeat(z[:, t].T, g, axis=1)
        new_m, new_c, new_s, gain = _observe(m, c, s, nu, np.concatenate([row, row[1:]]), np.repeat(y[:, t], g))
        m, c, s = np.where(seen, new_m, m), np.where(seen, new_c, c), np.where(seen, new_s, s)
        nu, total = nu + seen, total + np.where(seen, gain, 0.0)
        at = np.flatnonzero(due[:, t])
        cells = (at[:, None] * g + np.arange(g)).ravel()
        known[:, :, cells] = np.repeat(inv[at, t, 1:, 1:].transpose(1, 2, 0), g, axis=2)
        new = np.flatnonzero(first == t)
        if len(new):
            own = (new[:, None] * g + np.arange(g)).ravel()
            m[: 1 + k, own], c[: 1 + k, : 1 + k, own] = np.repeat(b[new, t].T, g, axis=1), np.repeat(inv[new, t].transpose(1, 2, 0), g, axis=2)
            c[high, high, own] = q[own] * known[:, :, own]
            s[own], nu[own] = np.repeat(first_var[new, t], g), np.repeat(np.maximum(count[new, t] - 1 - k, 1), g)
        m, c = decay * m, decay[:, None] * c * decay[None]  # the next week's prior
        c[high, high] += (1 - phi**2) * q * known
        own = at * g + total.reshape(i, g)[at].argmax(axis=1)
        spread = c[low, low][:, :, own] + c[low, high][:, :, own] + c[high, low][:, :, own] + c[high, high][:, :, own]
        beta[at, t], cov[at, t], var[at, t] = (m[low, own] + m[high, own]).T, (s[own] * spread).transpose(2, 0, 1), s[own]
    return beta, cov, var, np.cumsum(ok, axis=1)


def _smoothed(dens: np.ndarray, start: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """Scaled forward and backward passes of many chains: dens (t, chain, 2), mask (t, chain) says which weeks a chain has."""
    n, m, _ = dens.shape
    fwd, back, scale = np.empty((n, m, 2)), np.ones((n, m, 2)), np.ones((n, m))
    for t in range(n):
        u = (start if t == 0 else (fwd[t - 1][:, :, None] * move).sum(axis=1)) * dens[t]
        scale[t] = np.maximum(u[:, 0] + u[:, 1], 1e-300)
        fwd[t] = u / scale[t][:, None]
    for t in range(n - 2, -1, -1):
        u = (move * (dens[t + 1] * back[t + 1])[:, None, :]).sum(axis=2) / scale[t + 1][:, None]
        back[t] = np.where(mask[t + 1][:, None], u, 1.0)
    g = fwd * back
    g /= g.sum(axis=2, keepdims=True)
    nxt = dens[1:] * back[1:] / scale[1:, :, None] * mask[1:, :, None]
    return g * mask[:, :, None], fwd, move * np.einsum("tmi,tmj->mij", fwd[:-1], nxt), np.where(mask, np.log(scale), 0).sum(axis=0)


def regime_fits(x: np.ndarray, counts: list[int], restarts: int = RESTARTS, rounds: int = ROUNDS, seed: int = 20261001) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Two Gaussian states with full covariances on the first ``c`` rows, for each ``c`` of counts, by expectation-maximisation.

    For each: (smoothed probabilities, transitions, probabilities of the next row), the calm state first, of the best of some
    starts, and the share of rows on which each other start, its own calm state first, finds the same state likelier. A start splits the rows at a random quantile of their noisy distance from the mean. All fits run as one batch.
    """
    n, d = max(counts), x.shape[1]
    x = x[:n]
    square = (x[:, :, None] * x[:, None, :]).reshape(n, d * d)
    resp, ridge = np.zeros((n, len(counts), restarts, 2)), np.empty((len(counts), d, d))
    for i, c in enumerate(counts):
        rng = np.random.default_rng(seed)
        sd = x[:c].std(axis=0, ddof=1)
        sd[sd == 0] = 1.0
        far = (((x[:c] - x[:c].mean(axis=0)) / sd) ** 2).sum(axis=1)
        cut = rng.uniform(0.5, 0.95, restarts)
        noisy = far[:, None] + rng.normal(0, 0.5 * far.std(), (c, restarts))
        wild = np.where(noisy > [np.quantile(noisy[:, r], cut[r]) for r in range(restarts)], 0.95, 0.05)
        resp[:c, i], ridge[i] = np.stack([1 - wild, wild], axis=2), 1e-6 * np.diag(sd**2)
    m = len(counts) * restarts
    resp, ridge, mask = resp.reshape(n, m, 2), np.repeat(ridge, restarts, axis=0), np.arange(n)[:, None] < np.repeat(counts, restarts)

    def moments(g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = g.reshape(n, -1).T
        w = np.maximum(flat.sum(axis=1), 1e-12)[:, None]
        mu = flat @ x / w
        cov = (flat @ square / w).reshape(-1, d, d) - mu[:, :, None] * mu[:, None, :] + np.repeat(own, 2, axis=0)
        return mu, cov

    def expect(mu: np.ndarray, cov: np.ndarray, start: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple:
        inv = np.linalg.inv(cov)
        lean = np.einsum("cde,ce->cd", inv, mu)
        quad = square @ inv.reshape(-1, d * d).T - 2 * x @ lean.T + (lean * mu).sum(axis=1)
        logp = (-0.5 * (quad + np.linalg.slogdet(cov)[1] + d * np.log(2 * np.pi))).reshape(n, -1, 2)
        top = logp.max(axis=2, keepdims=True)
        g, fwd, xi, like = _smoothed(np.where(mask[:, :, None], np.exp(logp - top), 1.0), start, move, mask)
        return g, fwd, xi, like + np.where(mask, top[:, :, 0], 0).sum(axis=0)

    mu, cov = moments(resp, ridge)
    start, move, last = resp[0].copy(), np.full((m, 2, 2), 0.5), np.full(m, -np.inf)
    live = np.arange(m)  # chains of the fits that go on: a fit ends when all its starts have settled
    pair = lambda at: (2 * at[:, None] + np.arange(2)).ravel()
    for _ in range(rounds):
        g, _, xi, like = expect(mu[pair(live)], cov[pair(live)], start[live], move[live], mask[:, live])
        move[live] = xi / np.maximum(xi.sum(axis=2, keepdims=True), 1e-300)
        mu[pair(live)], cov[pair(live)] = moments(g, ridge[live])
        start[live] = g[0]
        calm = np.abs(like - last[live]) < 1e-6 * mask[:, live].sum(axis=0)
        last[live] = like
        live = live[np.repeat(~calm.reshape(-1, restarts).all(axis=1), restarts)]
        if not len(live):
            break
    g, fwd, _, like = expect(mu, cov, start, move, mask)
    out = []
    for i, c in enumerate(counts):
        j = i * restarts + int(like[i * restarts : (i + 1) * restarts].argmax())
        order = np.argsort(np.trace(cov[2 * j : 2 * j + 2], axis1=1, axis2=2))  # the calm state first
        own = move[j][np.ix_(order, order)]
        chains = np.arange(i * restarts, (i + 1) * restarts)
        calm = np.trace(cov[pair(chains)].reshape(restarts, 2, d, d), axis1=2, axis2=3).argmin(axis=1)
        wild = np.take_along_axis(g[:c, chains], (1 - calm)[None, :, None], axis=2)[:, :, 0] > 0.5
        same = (wild == wild[:, [j - i * restarts]]).mean(axis=0)
        out.append((g[:c, j][:, order], own, fwd[c - 1, j][order] @ own, np.delete(same, j - i * restarts)))
    return out


def regimes(x: np.ndarray, restarts: int = RESTARTS, rounds: int = ROUNDS, seed: int = 20261001) -> tuple[np.ndarray, np.ndarray]:
    """Two Gaussian states of all rows: (smoothed probabilities, transitions)."""
    return regime_fits(x, [len(x)], restarts, rounds, seed)[0][:2]


def _regime_weeks(x: np.ndarray, at: list[int]) -> list[tuple[int, np.ndarray, float]]:
    """(week, calm probabilities of the weeks up to it, the next week's) of each week in ``at`` that has enough history."""
    at = [t for t in at if t + 1 >= WINDOW]
    return [(t, g[:, 0], float(ahead[0])) for t, (g, _, ahead, _) in _weekly_fits(x, at)]


def _weekly_fits(x: np.ndarray, at: list[int]) -> list[tuple[int, tuple]]:
    return [fit for i in range(0, len(at), WEEKS) for fit in zip(at[i : i + WEEKS], regime_fits(x, [t + 1 for t in at[i : i + WEEKS]]))]


def _path_matrix(path: dict[int, tuple[np.ndarray, float]], weeks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(has, calm, ahead) of a path by week of the calendar: calm (week, week up to it)."""
    has, calm, ahead = np.zeros(weeks, bool), np.zeros((weeks, weeks)), np.zeros(weeks)
    for t, (own, nxt) in path.items():
        has[t], calm[t, : t + 1], ahead[t] = True, own[: t + 1], nxt
    return has, calm, ahead


def _regime_of(y: np.ndarray, f: np.ndarray, place: np.ndarray, has: np.ndarray, calm: np.ndarray, ahead: np.ndarray) -> Path:
    """Weighted least squares in each of two regimes of the factors, mixed by the next week's regime probabilities.

    A regime of fewer than REGIME_WEEKS effective weeks uses all weeks alike. ``place`` is a row's last week in the factors'
    calendar, which ``_path_matrix`` tells the regimes of; the weighted sums of all weeks are one product with its matrix.
    """
    known = np.isfinite(f).all(axis=2)
    ok, z, y = _padded(y, f)
    m, n, p = z.shape
    rows = np.concatenate([_moments(z, y), ok[:, :, None]], axis=2)
    i, t = np.nonzero(ok)
    grid = np.zeros((len(has), m, rows.shape[2]))
    np.add.at(grid, (place[i, t], i), rows[i, t])
    every, own = np.cumsum(grid, axis=0), (calm @ grid.reshape(len(has), -1)).reshape(grid.shape)
    beta, cov, var = np.full((m, n, p - 1), np.nan), np.full((m, n, p - 1, p - 1), np.nan), np.full((m, n), np.nan)
    due = (_counted(ok) >= LEAST) & known & (place >= 0)
    due[due] = has[place[due]]
    i, t = np.nonzero(due)
    at = place[i, t]
    b, c, v = np.zeros((len(i), p - 1)), np.zeros((len(i), p - 1, p - 1)), np.zeros(len(i))
    for share, some in ((ahead[at], own[at, i]), (1 - ahead[at], every[at, i] - own[at, i])):
        s = np.where(some[:, -1:] >= REGIME_WEEKS, some, every[at, i])
        x, inv, left, _ = _solved(s[:, :-1], p)
        noise = left / np.maximum(s[:, -1], 1e-12)
        b, c, v = b + share[:, None] * x[:, 1:], c + (share**2 * noise)[:, None, None] * inv[:, 1:, 1:], v + share * noise
    beta[due], cov[due], var[due] = b, c, v
    return beta, cov, var, np.cumsum(ok, axis=1)


def regime_conditional(y: np.ndarray, f: np.ndarray) -> Path:
    """``_regime_of`` one instrument whose factors are the calendar; regimes are refitted each week on the factors so far."""
    known = np.isfinite(f).all(axis=1)
    path = {t: (calm, ahead) for t, calm, ahead in _regime_weeks(f[known], list(range(int(known.sum()))))}
    return tuple(a[0] for a in _regime_of(y[None], f[None], (np.cumsum(known) - 1)[None], *_path_matrix(path, int(known.sum()))))


def _of_one(many: Callable) -> Callable[[np.ndarray, np.ndarray], Path]:
    return lambda y, f: tuple(a[0] for a in many(y[None], f[None]))


rolling_ols, huber, discount_filter, reverting_filter = (_of_one(many) for many in (_ols_of, _huber_of, _discount_of, _reverting_of))


def _calendar(panel: DataFrame, factors: list[str]) -> pd.DataFrame:
    """The weeks on which all factors are known, in order: bounded by the calendar."""
    known = panel.select("date", *factors).where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in factors))
    return known.groupBy("date").agg(*[F.first(c).alias(c) for c in factors]).orderBy("date").toPandas()


def _by_week(panel: DataFrame, weeks: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over the numbers of the weeks, a few a task."""
    return panel.sparkSession.range(0, weeks, 1, max(1, -(-weeks // WEEKS))).mapInPandas(run, schema)


def regime_path(panel: DataFrame, factors: list[str]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, float]]]:
    """The factors' calendar and its regimes week by week, fitted once for all instruments, a few weeks a task.

    Both are bounded by the calendar: a number for each pair of weeks.
    """
    weeks = _calendar(panel, factors)
    x = weeks[factors].to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            yield pd.DataFrame(_regime_weeks(x, ids["id"].tolist()), columns=["t", "calm", "ahead"])

    rows = _by_week(panel, len(x), run, "t long, calm array<double>, ahead double").collect()
    return pd.to_datetime(weeks["date"]).to_numpy(), {r["t"]: (np.array(r["calm"]), r["ahead"]) for r in rows}


def restart_agreement(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(date, lowest, middle): for each week's fit of the regimes the least and the median share of weeks, over the restarts but the best, on
    which a restart finds the same state likelier as the best one. Weeks before there is enough history have no row."""
    weeks = _calendar(panel, factors)
    x, dates = weeks[factors].to_numpy(float), weeks["date"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            fits = _weekly_fits(x, [t for t in ids["id"].tolist() if t + 1 >= WINDOW])
            yield pd.DataFrame([(dates[t], float(same.min()), float(np.median(same))) for t, (_, _, _, same) in fits], columns=["date", "lowest", "middle"])

    return _by_week(panel, len(x), run, "date date, lowest double, middle double")


ESTIMATORS: dict[str, Callable[..., Path]] = {"ols": rolling_ols, "huber": huber, "discount": discount_filter, "reverting": reverting_filter, "regime": regime_conditional}
_MANY: dict[str, Callable[..., Path]] = {"ols": _ols_of, "huber": _huber_of, "discount": _discount_of, "reverting": _reverting_of, "regime": _regime_of}


def _whole_instruments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of rows in order of instruments as tables of whole instruments, BLOCK of them at most: no more than a batch and an instrument are held."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            one = pa.Table.from_batches([batch])
            held = one if held is None else pa.concat_tables([held, one]).combine_chunks()
        if held is None:
            continue
        code = held["instrument"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(code)) + 1
        ends = [*cuts[BLOCK - 1 :: BLOCK], *cuts[-1:]] if batch is not None else [*cuts[BLOCK - 1 :: BLOCK], held.num_rows]
        start = 0
        for end in sorted(set(int(e) for e in ends)):
            yield held.slice(start, end - start)
            start = end
        held = held.slice(start) if start < held.num_rows else None


Told = Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table]


def _streamed(panel: DataFrame, factors: list[str], method: str, told: Told, schema: str) -> DataFrame:
    """Instruments in order through one of ESTIMATORS. ``told`` makes rows of (a block's rows, which of them begin an instrument, factors, loadings, their covariance, residual variance, count)."""
    spark, k = panel.sparkSession, len(factors)
    shared = spark.sparkContext.broadcast(regime_path(panel, factors)) if method == "regime" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared is not None:
            calendar, path = shared.value
            matrix = _path_matrix(path, len(calendar))
        for rows in _whole_instruments(batches):
            code = rows["instrument"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1])
            inst = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(code))))
            at = inst, np.arange(len(code)) - first[inst]
            shape = len(first), int(at[1].max()) + 1
            number = lambda c: rows[c].to_numpy().astype(float)
            y, f = np.full(shape, np.nan), np.full((*shape, k), np.nan)
            y[at] = number("ret")
            for j, c in enumerate(factors):
                f[(*at, j)] = number(c)
            more = ()
            if shared is not None:
                place = np.full(shape, -1)
                place[at] = np.searchsorted(calendar, rows["date"].to_numpy().astype(calendar.dtype), "right") - 1
                more = (place, *matrix)
            made = (a[at] for a in _MANY[method](y, f, *more))
            yield from told(rows, first, f[at], *made).combine_chunks().to_batches()

    return panel.select("instrument", "date", "ret", *factors).repartition("instrument").sortWithinPartitions("instrument", "date").mapInArrow(run, schema)


def estimated(panel: DataFrame, factors: list[str], method: str, covariance: bool = False) -> DataFrame:
    """Loadings of every instrument by one of ESTIMATORS; weeks before there is enough history give no row.

    With ``covariance``, ``cov`` has the row of the loadings' covariance that belongs to the factor, ``place`` its position.
    """
    k = len(factors)

    def told(rows: pa.Table, first: np.ndarray, f: np.ndarray, beta: np.ndarray, cov: np.ndarray, var: np.ndarray, count: np.ndarray) -> pa.Table:
        se = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
        kept = np.flatnonzero(np.isfinite(beta.ravel()))
        row = pa.array(kept // k)
        out = {"instrument": rows["instrument"].take(row), "date": rows["date"].take(row), "factor": pa.array(factors).take(pa.array(kept % k)), "loading": beta.ravel()[kept], "se": se.ravel()[kept], "resid_var": var[kept // k], "n": count[kept // k].astype(np.int32)}
        if covariance:
            out["cov"] = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * k), pa.array(cov.reshape(-1, k)[kept].ravel()))
            out["place"] = (kept % k).astype(np.int32)
        return pa.table(out)

    schema = "instrument string, date date, factor string, loading double, se double, resid_var double, n int" + (", cov array<double>, place int" if covariance else "")
    return _streamed(panel, factors, method, told, schema)


def predicted(panel: DataFrame, factors: list[str], method: str) -> DataFrame:
    """``fit.predictions`` of ``estimated``, made where the loadings are: (instrument, date, ret, p, contributions), last week's loadings times this week's factors.

    A week meets the instrument's own row before in the task that holds both, so loadings are neither stored nor joined.
    """
    k, order = len(factors), np.argsort(factors)

    def told(rows: pa.Table, first: np.ndarray, f: np.ndarray, beta: np.ndarray, *_: np.ndarray) -> pa.Table:
        was = np.empty_like(beta)
        was[1:], was[first] = beta[:-1], np.nan
        there = lambda c: rows[c].is_valid().to_numpy()
        ok = np.isfinite(was).all(axis=1) & np.logical_and.reduce([there(c) for c in ("ret", *factors)])
        parts, row = (was * f)[ok][:, order], pa.array(np.flatnonzero(ok))
        own = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * k), pa.array(parts.ravel()))
        return pa.table({"instrument": rows["instrument"].take(row), "date": rows["date"].take(row), "ret": rows["ret"].take(row), "p": parts.sum(axis=1), "parts": own})

    made = _streamed(panel, factors, method, told, "instrument string, date date, ret double, p double, parts array<double>")
    return made.select("instrument", "date", "ret", "p", F.map_from_arrays(F.array(*[F.lit(factors[j]) for j in order]), "parts").alias("contributions"))


def moved_by_the_future(panel: DataFrame, factors: list[str], methods: list[str], cut: str) -> DataFrame:
    """(method, moved): how many loadings dated before ``cut`` differ when the weeks from then on are not there. Zero, or a method looks ahead."""
    past = panel.where(F.col("date") < F.lit(cut).cast("date"))
    out = None
    for m in methods:
        whole = estimated(panel, factors, m).where(F.col("date") < F.lit(cut).cast("date")).select("instrument", "date", "factor", F.col("loading").alias("a"))
        part = estimated(past, factors, m).select("instrument", "date", "factor", F.col("loading").alias("b"))
        off = F.coalesce(F.abs(F.col("a") - F.col("b")) > 1e-9 * (1 + F.abs("b")), F.lit(True))
        one = whole.join(part, ["instrument", "date", "factor"], "full").agg(F.count_if(off).alias("moved")).select(F.lit(m).alias("method"), "moved")
        out = one if out is None else out.unionByName(one)
    return out


def with_peer_prior(loadings: DataFrame, peers: DataFrame, least: int = PEERS) -> DataFrame:
    """Loadings mixed with their class's others as a prior, by precision: the whole covariance of the own ones against the
    others' mean and variance of each factor. Classes of fewer than ``least`` others leave loadings alone.

    loadings: rows of ``estimated(..., covariance=True)``; peers: (instrument, class). Leave-one-out moments come from window
    sums, so no instrument pairs are made. Tasks then hold one instrument's weeks.
    """
    w = Window.partitionBy("class", "date", "factor")
    b, n = F.col("loading"), F.count("*").over(w) - 1
    mean = (F.sum("loading").over(w) - b) / n
    var = F.greatest((F.sum(b * b).over(w) - b * b) / n - mean * mean, F.lit(0.0)) * n / (n - 1)
    j = loadings.join(peers, "instrument").withColumn("_m", F.when(n >= least, mean)).withColumn("_v", F.when(n >= least, F.greatest(var, F.lit(1e-12))))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k = len(rows["cov"].iloc[0])
        rows = rows.iloc[np.lexsort((rows["place"], rows["date"]))].reset_index(drop=True)
        at = np.flatnonzero(rows["_m"].notna().to_numpy().reshape(-1, k).all(axis=1))
        if len(at):
            own, cov = rows["loading"].to_numpy().reshape(-1, k)[at], np.stack(rows["cov"]).reshape(-1, k, k)[at]
            sure, prior = np.linalg.pinv(cov, hermitian=True), 1 / rows["_v"].to_numpy(float).reshape(-1, k)[at]
            post = np.linalg.inv(sure + prior[:, :, None] * np.eye(k))
            mixed = post @ (sure @ own[:, :, None] + (prior * rows["_m"].to_numpy(float).reshape(-1, k)[at])[:, :, None])
            flat = (at[:, None] * k + np.arange(k)).ravel()
            rows.loc[flat, "loading"], rows.loc[flat, "se"] = mixed.ravel(), np.sqrt(np.diagonal(post, axis1=1, axis2=2)).ravel()
        return rows[["instrument", "date", "factor", "loading", "se"]]

    return j.groupBy("instrument").applyInPandas(run, "instrument string, date date, factor string, loading double, se double")


def predicted_losses(loadings: DataFrame, panel: DataFrame, factors: list[str]) -> DataFrame:
    """(instrument, date, loss): Huber loss of next week's return against last week's loadings times this week's factors."""
    from ..functions.scalars import huber as loss

    long = panel.unpivot(["instrument", "date", "ret"], factors, "factor", "f")
    w = Window.partitionBy("instrument", "factor").orderBy("date")
    lagged = long.join(loadings.select("instrument", "date", "factor", "loading"), ["instrument", "date", "factor"], "left").withColumn("was", F.lag("loading").over(w))
    per = lagged.groupBy("instrument", "date").agg(F.first("ret").alias("ret"), F.sum(F.col("was") * F.col("f")).alias("p"), F.count("was").alias("n"))
    return per.where((F.col("n") == len(factors)) & F.col("ret").isNotNull()).select("instrument", "date", loss(F.col("ret") - F.col("p")).alias("loss"))
