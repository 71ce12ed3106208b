"""The estimator once more, one session at a time and with differences for derivatives: what the batched one is held against."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plumbline.operators.estimate import closed_form, euler_rotation, kept, rotation, rotvec, spherical, wrapped
from plumbline.schemas import Params


@dataclass
class Solution:
    """Outcome for one group; cov is 6x6 on (rotation vector, translation)."""

    r: np.ndarray
    t: np.ndarray
    offset: np.ndarray
    cov: np.ndarray
    offset_sigma: np.ndarray
    inliers: np.ndarray
    rms_sigma: float
    converged: bool
    rank: int


class Problem:
    """Residuals of captures in the sensor's own measures, with priors as further rows."""

    def __init__(self, p, rb, tb, params: Params, elevation: bool, solve_offset: bool, priors: bool, offset) -> None:
        self.rb, self.tb, self.measured = rb, tb, spherical(p)
        self.k = 3 if elevation else 2
        self.sigma = np.array([params.sigma_range_m, np.radians(params.sigma_az_deg), np.radians(params.sigma_el_deg)])[: self.k]
        self.solve_offset, self.offset = solve_offset, np.asarray(offset, float)
        self.offset_sigma = params.offset_prior_sigma_m if solve_offset and params.offset_prior_sigma_m > 0 else None
        self.prior = None
        if priors and params.prior_rot_sigma_deg > 0 and params.prior_t_sigma_m > 0:
            self.prior = euler_rotation(params.prior_rpy_deg), np.radians(params.prior_rot_sigma_deg), np.asarray(params.prior_t, float), params.prior_t_sigma_m

    def parts(self, x):
        return rotation(x[:3]), x[3:6], x[6:9] if self.solve_offset else self.offset

    def errors(self, x, rows=slice(None)) -> np.ndarray:
        """(captures, k) differences over sigma."""
        r, t, a = self.parts(x)
        d = self.measured[rows] - spherical((self.rb[rows] @ a + self.tb[rows] - t) @ r)
        d[:, 1:] = wrapped(d[:, 1:])
        return d[:, : self.k] / self.sigma

    def misfits(self, x) -> np.ndarray:
        """Root mean square of each capture's errors, in sigmas."""
        return np.sqrt((self.errors(x) ** 2).mean(axis=1))

    def residuals(self, x, rows) -> np.ndarray:
        out = [self.errors(x, rows).ravel()]
        if self.offset_sigma:
            out.append((x[6:9] - self.offset) / self.offset_sigma)
        if self.prior:
            r0, rot_sigma, t0, t_sigma = self.prior
            out += [rotvec(r0.T @ rotation(x[:3])) / rot_sigma, (x[3:6] - t0) / t_sigma]
        return np.concatenate(out)

    def jacobian(self, x, rows, f0) -> np.ndarray:
        out = np.empty((len(f0), len(x)))
        for i in range(len(x)):
            step = np.zeros_like(x)
            step[i] = 1e-6
            out[:, i] = (self.residuals(x + step, rows) - self.residuals(x - step, rows)) / 2e-6
        return out


def _huber(f: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """(cost, weights): square up to the scale, linear beyond, of each residual."""
    z = np.abs(f) / scale
    far = z > 1
    return 0.5 * scale**2 * float(np.sum(np.where(far, 2 * z - 1, z**2))), np.where(far, 1 / np.where(far, z, 1), 1.0)


def _minimise(problem: Problem, x: np.ndarray, rows: np.ndarray, scale: float, most: int = 200) -> np.ndarray:
    f = problem.residuals(x, rows)
    cost, weight = _huber(f, scale)
    damp = 1e-3
    for _ in range(most):
        j = problem.jacobian(x, rows, f)
        a, b = j.T @ (weight[:, None] * j), j.T @ (weight * f)
        while True:
            step = -np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), b, rcond=None)[0]
            f_new = problem.residuals(x + step, rows)
            new, w_new = _huber(f_new, scale)
            if new <= cost or damp > 1e12:
                break
            damp *= 10
        if new > cost:
            break
        done = cost - new <= 1e-12 * (1 + cost) and np.linalg.norm(step) <= 1e-10 * (1 + np.linalg.norm(x))
        x, f, cost, weight, damp = x + step, f_new, new, w_new, max(damp / 10, 1e-12)
        if done:
            break
    return x


def _settled(problem: Problem, x: np.ndarray, params: Params, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(solution, captures it was made from, captures it leaves): refits to what the last fit left
    until that is what it was made from, or the rounds are over."""
    left, basis = np.full(len(problem.tb), True), None
    while rounds and (basis is None or (left != basis).any()):
        basis, rounds = left, rounds - 1
        x = _minimise(problem, x, np.flatnonzero(basis), params.huber)
        left = kept(problem.misfits(x), params.reject_sigma)
    return x, basis, left


def maximum_likelihood(p, rb, tb, params: Params, elevation: bool, offset=None, solve_offset: bool | None = None, priors: bool | None = None, max_iter: int | None = None) -> Solution:
    """Robust fit from the priors or, without them, from the closed form; wild captures are left out."""
    offset = params.offset if offset is None else offset
    solve_offset = params.solve_offset if solve_offset is None else solve_offset
    problem = Problem(p, rb, tb, params, elevation, solve_offset, params.use_prior if priors is None else priors, offset)
    start = (problem.prior[0], problem.prior[2]) if problem.prior else closed_form(p, rb @ problem.offset + tb)
    x = np.concatenate([rotvec(start[0]), start[1], problem.offset if solve_offset else []])
    x, basis, left = _settled(problem, x, params, max(1, params.max_iter if max_iter is None else max_iter))
    rows = np.flatnonzero(basis)
    f = problem.residuals(x, rows)
    j = problem.jacobian(x, rows, f) * (np.abs(f) <= params.huber)[:, None]  # the robust loss is flat in curvature beyond its scale
    cov = np.linalg.pinv(j.T @ j)
    offset_sigma = np.zeros(3)
    offset_sigma[: len(x) - 6] = np.sqrt(np.maximum(cov.diagonal()[6:], 0))
    r, t, a = problem.parts(x)
    rms = float(np.sqrt(np.mean(problem.misfits(x)[left] ** 2)))
    return Solution(r, t, np.asarray(a), cov[:6, :6], offset_sigma, left, rms, bool((left == basis).all()), int(np.linalg.matrix_rank(j)))


def cost(p, rb, tb, params: Params, found: dict, want: Solution) -> float:
    """How much the robust cost of the two solutions differs, on the captures that both keep."""
    problem = Problem(p, rb, tb, params, found["elevation_used"], params.solve_offset, params.use_prior, params.offset)
    rows = np.flatnonzero(want.inliers)
    pack = lambda r, t, a: np.concatenate([rotvec(np.array(r).reshape(3, 3)), t, a if params.solve_offset else []])
    a, b = (_huber(problem.residuals(pack(*x), rows), params.huber)[0] for x in ((found["r"], found["t"], found["offset"]), (want.r, want.t, want.offset)))
    return abs(a - b)
