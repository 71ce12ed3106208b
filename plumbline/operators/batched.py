"""The maximum-likelihood fit of many groups of captures at once.

Groups (sessions, folds, bootstraps) are one array, padded to the largest; every step
of the fit is a numpy operation over all groups that aren't done. Derivatives are
closed forms. A group's captures, (n, 3) sensor points, (n, 3, 3) rotations and (n, 3)
translations of the target, give k residuals each, in sigmas of range, azimuth and
elevation; priors on the offset and on the pose are further residuals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plumbline.schemas import Params

# ---- rotations, (..., 3) vectors and (..., 3, 3) matrices ---------------------------------------


def skew(v: np.ndarray) -> np.ndarray:
    out = np.zeros((*v.shape, 3))
    out[..., 0, 1], out[..., 0, 2], out[..., 1, 2] = -v[..., 2], v[..., 1], -v[..., 0]
    out[..., 1, 0], out[..., 2, 0], out[..., 2, 1] = v[..., 2], -v[..., 1], v[..., 0]
    return out


def _series(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sin(a)/a, (1-cos(a))/a**2 and (a-sin(a))/a**3 of the angle, by their series near 0."""
    a = np.linalg.norm(v, axis=-1)[..., None, None]
    near = a < 1e-4
    x = np.where(near, 1.0, a)
    return (
        np.where(near, 1 - a**2 / 6, np.sin(x) / x),
        np.where(near, 0.5 - a**2 / 24, (1 - np.cos(x)) / x**2),
        np.where(near, 1 / 6 - a**2 / 120, (x - np.sin(x)) / x**3),
    )


def rotations(v: np.ndarray) -> np.ndarray:
    k = skew(v)
    one, two, _ = _series(v)
    return np.eye(3) + one * k + two * (k @ k)


def turn_of_change(v: np.ndarray) -> np.ndarray:
    """The matrix that takes a small change of the rotation vector to the turn that follows the rotation."""
    k = skew(v)
    _, two, three = _series(v)
    return np.eye(3) + two * k + three * (k @ k)


def change_of_turn(v: np.ndarray) -> np.ndarray:
    """Its inverse."""
    a = np.linalg.norm(v, axis=-1)[..., None, None]
    near = a < 1e-3
    x = np.where(near, 1.0, a)
    k = skew(v)
    return np.eye(3) - k / 2 + np.where(near, 1 / 12 + a**2 / 720, 1 / x**2 - (1 + np.cos(x)) / (2 * x * np.where(np.abs(np.sin(x)) < 1e-12, 1e-12, np.sin(x)))) * (k @ k)


def _davenport(m: np.ndarray) -> np.ndarray:
    """(..., 4, 4) symmetric ones, whose top eigenvectors are the quaternions x, y, z, w nearest to matrices."""
    s = np.empty((*m.shape[:-2], 4, 4))
    trace = np.trace(m, axis1=-2, axis2=-1)
    s[..., :3, :3] = m + np.swapaxes(m, -1, -2) - trace[..., None, None] * np.eye(3)
    axis = np.stack([m[..., 2, 1] - m[..., 1, 2], m[..., 0, 2] - m[..., 2, 0], m[..., 1, 0] - m[..., 0, 1]], axis=-1)
    s[..., :3, 3] = s[..., 3, :3] = axis
    s[..., 3, 3] = trace
    return s


def _vectors_of_quaternions(q: np.ndarray) -> np.ndarray:
    q = q * np.where(q[..., 3:] >= 0, 1, -1)
    size = np.linalg.norm(q[..., :3], axis=-1, keepdims=True)
    tiny = size < 1e-12
    return np.where(tiny, 2.0, 2 * np.arctan2(size, q[..., 3:]) / np.where(tiny, 1, size)) * q[..., :3]


def rotation_vectors(m: np.ndarray) -> np.ndarray:
    """By the quaternion that is nearest to each matrix: the top eigenvector of a symmetric one."""
    return _vectors_of_quaternions(np.linalg.eigh(_davenport(m))[1][..., -1])


def vectors_of_rotations(m: np.ndarray) -> np.ndarray:
    """The same of matrices that are rotations: there the symmetric one is 4 q q' - 1, and its longest column shows q."""
    s = _davenport(m) + np.eye(4)
    most = np.einsum("...ii->...i", s).argmax(axis=-1)
    q = np.take_along_axis(s, most[..., None, None], axis=-1)[..., 0]
    return _vectors_of_quaternions(q / np.linalg.norm(q, axis=-1, keepdims=True))


def spherical(p: np.ndarray) -> np.ndarray:
    """(..., 3, N) of such points: range, azimuth, elevation; zeros at the origin."""
    x, y, z = np.moveaxis(p, -2, 0)
    r = np.sqrt(x * x + y * y + z * z)
    far = r >= 1e-9
    return np.stack([r, np.arctan2(y, x), np.arcsin(np.clip(z / np.where(far, r, 1), -1, 1))], axis=-2) * far[..., None, :]


def _matvec(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _across(v: np.ndarray) -> np.ndarray:
    """(G, N, ...) as (G, ..., N): numpy runs along a group's captures."""
    return np.ascontiguousarray(np.moveaxis(v, 1, -1))


# ---- the fit ------------------------------------------------------------------------------------

#: Fixed values of the method: captures that always stay, the share below which too few pass, the share kept then.
LEAST, ENOUGH, QUOTA = 4, 0.5, 0.6
#: Most steps of one fit; damping at which it gives up.
STEPS, STUCK = 200, 1e12
#: Length of a step (radians, metres) from which on the residuals' own curvature counts.
NEAR = 0.05


@dataclass
class Solutions:
    """A row for each group; cov is 6x6 on (rotation vector, translation), inliers (groups, captures)."""

    r: np.ndarray
    t: np.ndarray
    offset: np.ndarray
    cov: np.ndarray
    offset_sigma: np.ndarray
    inliers: np.ndarray
    rms_sigma: np.ndarray
    converged: np.ndarray
    rank: np.ndarray


class Groups:
    """Captures of G groups, padded to N each, and what their residuals are made of. ``there`` (G, N)
    says which captures there are; ``elevation`` (G,) which groups use it; ``offset`` (G, 3).
    Inside, captures are the last axis."""

    def __init__(self, p, rb, tb, there, params: Params, elevation, solve_offset: bool, priors: bool, offset) -> None:
        self.rb, self.tb, self.there, self.measured = _across(np.swapaxes(rb, 2, 3)), _across(tb), there, spherical(_across(p))
        self.sigma = np.array([params.sigma_range_m, np.radians(params.sigma_az_deg), np.radians(params.sigma_el_deg)])
        self.used = np.stack([np.ones_like(elevation), np.ones_like(elevation), elevation], axis=-1).astype(float)
        self.scale = (self.used / self.sigma)[:, :, None] * there[:, None]
        self.solve_offset, self.offset, self.params = solve_offset, offset, params
        self.apexes = None if solve_offset else self.placed(offset)
        self.offset_sigma = params.offset_prior_sigma_m if solve_offset and params.offset_prior_sigma_m > 0 else None
        self.prior = None
        if priors and params.prior_rot_sigma_deg > 0 and params.prior_t_sigma_m > 0:
            r, p, y = np.radians(params.prior_rpy_deg)
            turn = rotations(np.array([0, 0, y])) @ rotations(np.array([0, p, 0])) @ rotations(np.array([r, 0, 0]))
            self.prior = turn, np.radians(params.prior_rot_sigma_deg), np.asarray(params.prior_t, float), params.prior_t_sigma_m

    def only(self, which) -> Groups:
        out = object.__new__(Groups)
        out.__dict__ = {n: v[which] if n in ("rb", "tb", "there", "measured", "used", "scale", "offset") or n == "apexes" and v is not None else v for n, v in self.__dict__.items()}
        return out

    def parts(self, x):
        return rotations(x[:, :3]), x[:, 3:6], x[:, 6:9] if self.solve_offset else self.offset

    def placed(self, a) -> np.ndarray:
        """(G, 3, N) targets in the camera's frame."""
        return sum((self.rb[:, k] * a[:, k, None, None] for k in range(3)), self.tb)

    def sensed(self, r, t, a) -> np.ndarray:
        """(G, 3, N) targets as the sensor has them."""
        return np.swapaxes(r, 1, 2) @ ((self.placed(a) if self.apexes is None else self.apexes) - t[:, :, None])

    def errors(self, x) -> np.ndarray:
        """(G, 3, N) differences over sigma; zeros for an elevation that isn't used and for captures that aren't there."""
        d = self.measured - spherical(self.sensed(*self.parts(x)))
        d[:, 1:] -= 2 * np.pi * np.rint(d[:, 1:] / (2 * np.pi))
        return d * self.scale

    def misfits(self, x) -> np.ndarray:
        """(G, N) root mean square of each capture's errors."""
        return np.sqrt((self.errors(x) ** 2).sum(axis=1) / self.used.sum(axis=1)[:, None])

    def residuals(self, x, basis) -> np.ndarray:
        """(G, R) of the captures in ``basis``, by measure, then of the priors."""
        out = [(self.errors(x) * basis[:, None]).reshape(len(x), -1)]
        if self.offset_sigma:
            out.append((x[:, 6:9] - self.offset) / self.offset_sigma)
        if self.prior:
            r0, rot_sigma, t0, t_sigma = self.prior
            out += [vectors_of_rotations(r0.T @ rotations(x[:, :3])) / rot_sigma, (x[:, 3:6] - t0) / t_sigma]
        return np.concatenate(out, axis=1)

    def slopes(self, x, basis) -> np.ndarray:
        """(G, R, unknowns): derivatives of the residuals."""
        r, t, a = self.parts(x)
        turn = turn_of_change(x[:, :3])
        u, v, w = np.moveaxis(self.sensed(r, t, a), 1, 0)
        flat2 = np.maximum(u * u + v * v, 1e-18)
        flat, far2 = np.sqrt(flat2), flat2 + w * w
        by_r, by_az, by_el = np.moveaxis(self.scale * basis[:, None], 1, 0)
        g, n = u.shape
        # of (range, azimuth, elevation) by moves of the point along its axes, and by turns of it
        shift, spin = np.zeros((2, g, 3, 3, n))
        k = by_r / np.sqrt(far2)
        shift[:, 0, 0], shift[:, 1, 0], shift[:, 2, 0] = k * u, k * v, k * w
        k = by_az / flat2
        shift[:, 0, 1], shift[:, 1, 1] = -k * v, k * u
        spin[:, 0, 1], spin[:, 1, 1], spin[:, 2, 1] = k * u * w, k * v * w, -k * (u * u + v * v)
        k = by_el / flat
        spin[:, 0, 2], spin[:, 1, 2] = -k * v, k * u
        k = by_el / far2
        shift[:, 0, 2], shift[:, 1, 2], shift[:, 2, 2] = -k * u * w / flat, -k * v * w / flat, k * flat
        out = np.zeros((g, x.shape[1], 3 * n + 3 * bool(self.offset_sigma) + 6 * bool(self.prior)))
        out[:, :3, : 3 * n] = -np.swapaxes(turn, 1, 2) @ r @ spin.reshape(g, 3, -1)
        moved = r @ shift.reshape(g, 3, -1)
        out[:, 3:6, : 3 * n] = moved
        if self.solve_offset:
            moved = moved.reshape(g, 3, 3, n)
            for k in range(3):
                out[:, 6 + k, : 3 * n] = -sum(moved[:, i] * self.rb[:, k, i, None] for i in range(3)).reshape(g, -1)
        if self.offset_sigma:
            out[:, 6:, 3 * n : 3 * n + 3] = np.eye(3) / self.offset_sigma
        if self.prior:
            r0, rot_sigma, _, t_sigma = self.prior
            out[:, :3, -6:-3] = np.swapaxes(change_of_turn(vectors_of_rotations(r0.T @ r)) @ r0.T @ turn, 1, 2) / rot_sigma
            out[:, 3:6, -3:] = np.eye(3) / t_sigma
        return np.swapaxes(out, 1, 2)


def _huber(f: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(cost of each group, weights of each residual): square up to the scale, linear beyond."""
    z = np.abs(f) / scale
    far = z > 1
    return 0.5 * scale**2 * np.where(far, 2 * z - 1, z**2).sum(axis=1), np.where(far, 1 / np.where(far, z, 1), 1.0)


def _solved(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(m, v[..., None])[..., 0]
    except np.linalg.LinAlgError:  # one of them is singular
        return _matvec(np.linalg.pinv(m, hermitian=True), v)


def _bent(bend: np.ndarray, step: np.ndarray, change: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The estimate of the curvature that the residuals' own bends add (G, U, U), by what a step has shown: ``change``
    of the slope, and the part of it that is not the slopes' product. The structured secant rule of Dennis, Gay and Welsch."""
    along = np.einsum("gi,gi->g", change, step)
    was = _matvec(bend, step)
    size = np.abs(np.einsum("gi,gi->g", step, was))
    shrink = np.minimum(1, np.abs(np.einsum("gi,gi->g", step, own)) / np.where(size > 0, size, 1))[:, None]
    rest = own - was * shrink
    along = np.where(along > 0, along, np.inf)[:, None]
    y = change / along
    cross = rest[:, :, None] * y[:, None, :]
    return bend * shrink[..., None] + cross + np.swapaxes(cross, 1, 2) - np.einsum("gi,gi->g", step, rest)[:, None, None] * y[:, :, None] * y[:, None, :]


def _minimised(groups: Groups, x: np.ndarray, basis: np.ndarray, scale: float, bends: bool = False) -> np.ndarray:
    """Damped steps on weighted residuals, each group with its own damping, until none moves. With ``bends``, near the end
    the curvature of the residuals themselves is estimated, too, so that the last steps aren't many; the
    very last is without, as a wrong estimate makes steps small anywhere."""
    out, at = x.copy(), np.arange(len(x))
    x, damp, steps, busy = x.copy(), np.full(len(x), 1e-3), np.zeros(len(x), int), np.ones(len(x), bool)
    f = groups.residuals(x, basis)
    cost, weight = _huber(f, scale)
    j = np.swapaxes(groups.slopes(x, basis), 1, 2)
    slope, bend = _matvec(j, f * weight), np.zeros((len(x), x.shape[1], x.shape[1]))
    eye = np.eye(x.shape[1])
    while len(x):
        normal = (j * weight[:, None]) @ np.swapaxes(j, 1, 2)
        diagonal = np.einsum("gii->gi", normal)
        step = -_solved(normal + bend + (damp[:, None] * (diagonal + 1e-12))[:, :, None] * eye, slope)
        moved = x + step
        f_new = groups.residuals(moved, basis)
        cost_new, weight_new = _huber(f_new, scale)
        better = (cost_new <= cost) & busy
        length = np.linalg.norm(step, axis=1)
        small = (cost - cost_new <= 1e-12 * (1 + cost)) & (length <= 1e-10 * (1 + np.linalg.norm(x, axis=1)))
        near, plain = better & ~small & (length <= NEAR), ~bend.any(axis=(1, 2))
        x_new = np.where(better[:, None], moved, x)
        j_new = np.swapaxes(groups.slopes(x_new, basis), 1, 2)
        pull = f_new * weight_new
        slope_new = _matvec(j_new, pull)
        if bends:
            bend = np.where(near[:, None, None], _bent(bend, step, slope_new - slope, slope_new - _matvec(j, pull)), 0.0)
        f, cost, weight, slope = (np.where(better.reshape(-1, *[1] * (a.ndim - 1)), b, a) for a, b in ((f, f_new), (cost, cost_new), (weight, weight_new), (slope, slope_new)))
        x, j = x_new, j_new
        steps += better
        damp = np.where(better, np.maximum(damp / 10, 1e-12), np.minimum(damp * 10, 10 * STUCK))
        busy &= ~(better & small & plain) & (damp <= STUCK) & (steps < STEPS)
        if busy.sum() <= 0.8 * len(busy):  # those that are done are put away
            out[at[~busy]] = x[~busy]
            groups, at, x, f, cost, weight, basis, damp, steps, j, slope, bend, busy = groups.only(busy), *(a[busy] for a in (at, x, f, cost, weight, basis, damp, steps, j, slope, bend, busy))
    return out


def kept(errors: np.ndarray, there: np.ndarray, limit: float) -> np.ndarray:
    """(G, N): which captures stay: those under the limit or, where these are too few, the quota with the smallest errors (ties all)."""
    n = there.sum(axis=1)
    under = (errors < limit) & there
    enough = under.sum(axis=1) >= np.maximum(LEAST, (ENOUGH * n).astype(int))
    quota = np.maximum(LEAST, (QUOTA * n).astype(int))
    order = np.sort(np.where(there, errors, np.inf), axis=1)
    bound = np.where(quota < n, order[np.arange(len(n)), np.minimum(quota, order.shape[1]) - 1], np.inf)
    return np.where(enough[:, None], under, (errors <= bound[:, None]) & there)


def closed_forms(p: np.ndarray, q: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation vectors and translations of p to q, (G, N, 3), by the rotation nearest to their sum of products."""
    w = there[..., None] / there.sum(axis=1)[:, None, None]
    mp, mq = (p * w).sum(axis=1), (q * w).sum(axis=1)
    h = np.swapaxes((q - mq[:, None]) * w, 1, 2) @ (p - mp[:, None])
    v = rotation_vectors(h)
    return v, mq - _matvec(rotations(v), mp)


def maximum_likelihood(
    p, rb, tb, there, params: Params, elevation, offset=None, solve_offset: bool | None = None, priors: bool | None = None, max_iter: int | None = None, sure: bool = True, bends: bool = False
) -> Solutions:
    """Robust fits from the priors or, without them, from the closed form; wild captures are left out:
    refits to what the last fit left until that is what it was made from, or the rounds are over.
    Without ``sure`` what only tells how sure the solutions are (cov, offset_sigma, rank) is zero; ``bends`` saves steps."""
    offset = np.broadcast_to(np.asarray(params.offset if offset is None else offset, float), (len(p), 3))
    solve_offset = params.solve_offset if solve_offset is None else solve_offset
    groups = Groups(p, rb, tb, there, params, np.asarray(elevation), solve_offset, params.use_prior if priors is None else priors, offset)
    if groups.prior:
        x = np.broadcast_to(np.concatenate([vectors_of_rotations(groups.prior[0]), groups.prior[2]]), (len(p), 6))
    else:
        x = np.concatenate(closed_forms(p, _matvec(rb, offset[:, None]) + tb, there), axis=1)
    x = np.concatenate([x, offset], axis=1) if solve_offset else x.copy()
    left, basis = there.copy(), np.zeros_like(there)
    moving = np.arange(len(p))
    for _ in range(max(1, params.max_iter if max_iter is None else max_iter)):
        basis[moving] = left[moving]
        some = groups.only(moving)
        x[moving] = _minimised(some, x[moving], basis[moving], params.huber, bends)
        left[moving] = kept(some.misfits(x[moving]), there[moving], params.reject_sigma)
        moving = moving[(left[moving] != basis[moving]).any(axis=1)]
        if not len(moving):
            break
    cov, rank = np.zeros((len(p), *x.shape[1:] * 2)), np.zeros(len(p), int)
    if sure:
        f = groups.residuals(x, basis)
        j = groups.slopes(x, basis) * (np.abs(f) <= params.huber)[..., None]  # the robust loss is flat in curvature beyond its scale
        cov, rank = np.linalg.pinv(np.swapaxes(j, 1, 2) @ j), np.linalg.matrix_rank(j)
    offset_sigma = np.zeros((len(p), 3))
    offset_sigma[:, : x.shape[1] - 6] = np.sqrt(np.maximum(np.einsum("gii->gi", cov)[:, 6:], 0))
    r, t, a = groups.parts(x)
    rms = np.sqrt((groups.misfits(x) ** 2 * left).sum(axis=1) / np.maximum(left.sum(axis=1), 1))
    return Solutions(r, t, np.array(a), cov[:, :6, :6], offset_sigma, left, rms, (left == basis).all(axis=1), rank)


def held_out_errors(x: Solutions, p, rb, tb, there, params: Params, elevation) -> np.ndarray:
    """(G, N) misfits of captures under the solutions, with their own offsets."""
    groups = Groups(p, rb, tb, there, params, np.asarray(elevation), False, False, x.offset)
    return groups.misfits(np.concatenate([vectors_of_rotations(x.r), x.t], axis=1))


def has_elevation(p: np.ndarray, there: np.ndarray, params: Params) -> np.ndarray:
    """(G,): whether the points' elevations spread enough to use them. The published rule takes abs(z),
    so targets alternating above and below look flat; ``signed_elevation`` takes z."""
    r = np.maximum(np.linalg.norm(p, axis=2), 1e-6)
    s = (p[..., 2] if params.signed_elevation else np.abs(p[..., 2])) / r
    n = np.maximum(there.sum(axis=1), 1)
    mean = (s * there).sum(axis=1) / n
    spread = np.sqrt((((s - mean[:, None]) * there) ** 2).sum(axis=1) / n)
    return (spread > 0.01) & (not params.force_2d)
