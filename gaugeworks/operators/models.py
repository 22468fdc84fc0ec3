"""Forecast models as recursions that are linear in their start state.

For given parameters the one-step errors of exponential smoothing and of ARMA models depend
linearly on the state they start from. A chunk of a series can therefore be summed up without
knowing what came before: run it once with the real input from a zero state and once per unit
state; the Gram matrix of the error rows and the end states describe the chunk for any start. The
summaries of all chunks are combined in order, so a series of any length is fitted from chunks that
different tasks worked on, and the start state itself can be solved for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

DAY_US = 86_400_000_000.0
ROUNDS = 6
CANDIDATES = 40


@dataclass(frozen=True)
class Smoothing:
    """Additive trend and season; parameters in the unit cube: level, trend share, season share."""

    name: str = "holt_winters"
    period: int = 7
    halo: int = 0

    @property
    def dim(self) -> int:
        return 2 + self.period

    n_params = 3
    center = (0.3, 0.1, 0.2)
    radius = 0.5
    low, high = 1e-4, 0.9999
    free_start = True  # the start state is estimated

    def min_rows(self) -> int:
        return 2 * self.period

    def errors(self, y, halo, first, params):
        """First: position of y[0] in the series. Returns error rows (P, 1 + dim, T) and end states."""
        p, d, m, n = len(params), self.dim, self.period, len(y)
        level, trend = params[:, 0:1], params[:, 0:1] * params[:, 1:2]
        season = (1.0 - params[:, 0:1]) * params[:, 2:3]
        state = np.zeros((p, 1 + d, d))
        state[:, 1:, :] = np.eye(d)
        out = np.empty((p, 1 + d, n))
        for t in range(n):
            s = 2 + (first + t) % m
            base = state[:, :, 0] + state[:, :, 1]
            e = -(base + state[:, :, s])
            e[:, 0] += y[t]
            state[:, :, 0] = base + level * e
            state[:, :, 1] += trend * e
            state[:, :, s] += season * e
            out[:, :, t] = e
        return out, state

    def forecast(self, params, state, tail, n, horizon, sigma):
        steps = np.arange(1, horizon + 1)
        season = np.array([state[2 + (n + i) % self.period] for i in range(horizon)])
        point = state[0] + steps * state[1] + season
        return point, 1.96 * sigma * np.sqrt(steps)


@dataclass(frozen=True)
class Arma:
    """ARIMA(p, d, q) x (P, D, Q, s) by conditional sum of squares."""

    name: str
    order: tuple[int, int, int]
    seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)
    bounded: bool = True  # keep the plain AR and MA parts stationary and invertible

    n_rows = 30
    radius = 0.9
    low, high = -0.98, 0.98
    free_start = False

    @property
    def n_params(self) -> int:
        return self.order[0] + self.order[2] + self.seasonal[0] + self.seasonal[2]

    @property
    def center(self):
        return (0.0,) * self.n_params

    @property
    def dim(self) -> int:
        return self.order[2] + self.seasonal[2] * self.seasonal[3]

    def _difference(self):
        poly = np.array([1.0])
        for _ in range(self.order[1]):
            poly = np.convolve(poly, [1.0, -1.0])
        lag = np.zeros(self.seasonal[3] + 1)
        lag[0], lag[-1] = 1.0, -1.0
        for _ in range(self.seasonal[1]):
            poly = np.convolve(poly, lag)
        return poly

    @property
    def ar_lags(self) -> int:
        return self.order[0] + self.seasonal[0] * self.seasonal[3]

    @property
    def halo(self) -> int:
        return self.ar_lags + len(self._difference()) - 1

    def min_rows(self) -> int:
        return self.n_rows

    def _plain(self, part):
        if not self.bounded or len(part) < 2:
            return np.asarray(part)
        r1, r2 = part  # partial autocorrelations to coefficients
        return np.array([r1 * (1.0 - r2), r2])

    def polynomials(self, params):
        """Full AR and MA polynomials; both start with 1 and carry minus signs on the lags."""
        p, _, q = self.order
        sp, _, sq, s = self.seasonal
        cut = np.cumsum([p, q, sp])
        ar, ma, sar, sma = np.split(np.asarray(params), cut)

        def lagged(coef, step, sign):
            out = np.zeros(len(coef) * step + 1)
            out[0] = 1.0
            out[step::step] = sign * np.asarray(coef) if len(coef) else []
            return out

        full_ar = np.convolve(lagged(self._plain(ar), 1, -1), lagged(sar, s, -1))
        full_ma = np.convolve(lagged(self._plain(ma), 1, -1), lagged(sma, s, -1))
        return full_ar, full_ma

    def errors(self, y, halo, first, params):
        z = np.concatenate([halo, y])
        w = np.convolve(z, self._difference())[: len(z)]
        p, d, n = len(params), self.dim, len(y)
        polys = [self.polynomials(x) for x in params]
        offset = len(z) - n
        drive = np.zeros((p, n))
        for i, (ar, _) in enumerate(polys):
            drive[i] = np.convolve(w, ar)[offset : offset + n]
        skip = max(0, self.halo - first)  # rows whose lags reach before the series
        drive[:, :skip] = 0.0
        ma = np.stack([m[1:] for _, m in polys])
        lags = np.flatnonzero(np.any(ma != 0.0, axis=0))
        past = np.zeros((p, 1 + d, d + n))  # errors in time order, the start state in front
        past[:, 1:, :d] = np.eye(d)[:, ::-1]
        for t in range(n):
            e = np.zeros((p, 1 + d))
            e[:, 0] = drive[:, t]
            if t >= skip:
                for j in lags:
                    e -= ma[:, j : j + 1] * past[:, :, d + t - 1 - j]
            past[:, :, d + t] = e
        return past[:, :, d:], past[:, :, n:][:, :, ::-1]

    def forecast(self, params, state, tail, n, horizon, sigma):
        ar, ma = self.polynomials(params)
        full = np.convolve(ar, self._difference())
        y, e = list(tail), list(state[::-1])  # errors in time order
        for _ in range(horizon):
            value = -sum(full[k] * y[-k] for k in range(1, len(full)))
            value += sum(ma[k] * e[-k] for k in range(1, len(ma)))
            y.append(value)
            e.append(0.0)
        psi = np.zeros(horizon)
        for h in range(horizon):
            psi[h] = (ma[h] if h < len(ma) else 0.0) - sum(full[k] * psi[h - k] for k in range(1, min(h, len(full) - 1) + 1))
        return np.array(y[len(tail) :]), 1.96 * sigma * np.sqrt(np.cumsum(psi**2))


@dataclass(frozen=True)
class Additive:
    """Piecewise linear trend with weekly and yearly Fourier terms, ridge least squares."""

    name: str = "prophet"
    changepoints: int = 12
    weekly: int = 3
    yearly: int = 6

    halo = 0
    dim = 0
    n_params = 0
    center = ()
    radius = 0.0
    low, high = 0.0, 0.0
    free_start = False

    def min_rows(self) -> int:
        return 20

    def design(self, t, t0, t1):
        tau = (t - t0) / max(t1 - t0, 1.0)
        knots = np.linspace(0.0, 0.8, self.changepoints + 1)[1:]
        cols = [np.ones_like(tau), tau, *[np.maximum(tau - k, 0.0) for k in knots]]
        days = t / DAY_US
        for period, orders in ((7.0, self.weekly), (365.25, self.yearly)):
            for k in range(1, orders + 1):
                a = 2.0 * math.pi * k * days / period
                cols += [np.sin(a), np.cos(a)]
        return np.stack(cols, axis=1)

    def gram(self, y, t, t0, t1):
        z = np.column_stack([self.design(t, t0, t1), y])
        return z.T @ z

    def solve(self, gram):
        k = len(gram) - 1
        n = gram[0, 0]
        penalty = np.full(k, 1e-3 * n / 100.0)
        penalty[:2] = 1e-9 * n
        penalty[2 : 2 + self.changepoints] = 0.05 * n / 100.0
        beta = np.linalg.solve(gram[:k, :k] + np.diag(penalty), gram[:k, k])
        sse = gram[k, k] - 2.0 * beta @ gram[:k, k] + beta @ gram[:k, :k] @ beta
        return beta, max(sse, 0.0)


def candidate_points(model, center, radius: float) -> np.ndarray:
    """Fixed quasi-random points around ``center``; the centre itself comes first."""
    steps = np.random.default_rng(7).uniform(-1.0, 1.0, (CANDIDATES, model.n_params))
    steps[0] = 0.0
    return np.clip(np.asarray(center) + radius * steps, model.low, model.high)


def summarize_chunk(model, y, halo, first, params):
    """(P, 1+dim, 1+dim) Gram matrices and (P, 1+dim, dim) end states of one chunk."""
    with np.errstate(all="ignore"):  # a candidate that diverges gets an infinite error in combine
        err, end = model.errors(y, halo, first, params)
        return err @ err.transpose(0, 2, 1), end


def combine(model, parts):
    """Fold chunk summaries in order; returns SSE, start and end state per candidate."""
    p, width = parts[0][0].shape[:2]
    bad = np.zeros(p, dtype=bool)
    for gram, end in parts:
        bad |= ~(np.isfinite(gram).all(axis=(1, 2)) & np.isfinite(end).all(axis=(1, 2)))
    parts = [(np.where(bad[:, None, None], 0.0, g), np.where(bad[:, None, None], 0.0, e)) for g, e in parts]
    move = np.tile(np.eye(width), (p, 1, 1))  # [1, start] -> [1, state before the chunk]
    total = np.zeros((p, width, width))
    for gram, end in parts:
        total += move @ gram @ move.transpose(0, 2, 1)
        step = np.zeros((p, width, width))
        step[:, 0, 0] = 1.0
        step[:, :, 1:] = end
        move = move @ step
    start = np.zeros((p, width - 1))
    if model.free_start:
        ridge = 1e-9 * np.trace(total[:, 1:, 1:], axis1=1, axis2=2)[:, None, None] * np.eye(width - 1)
        ridge = ridge + bad[:, None, None] * np.eye(width - 1)
        start = -np.linalg.solve(total[:, 1:, 1:] + ridge, total[:, 1:, 0:1])[:, :, 0]
    v = np.concatenate([np.ones((p, 1)), start], axis=1)
    sse = np.einsum("pa,pab,pb->p", v, total, v)
    state = np.einsum("pa,pab->pb", v, move)[:, 1:]
    return np.where(bad | ~np.isfinite(sse), np.inf, np.maximum(sse, 0.0)), state


def candidate_models(names=None) -> dict:
    """Models by name; an unknown name, or none left, is an error."""
    known = {
        m.name: m
        for m in (
            Arma("arima", (2, 1, 2)),
            Arma("sarima", (1, 1, 1), (1, 1, 1, 7), bounded=False),
            Smoothing(),
            Additive(),
        )
    }
    chosen = known if names is None else {k: m for k, m in known.items() if k in names}
    if not chosen:
        raise ValueError(f"no forecasting model among {names}")
    return chosen
