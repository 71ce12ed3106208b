"""Estimators on scenes of known truth."""

import math

import numpy as np
import pytest
import second_solver

from plumbline.operators import batched
from plumbline.operators import estimate as e
from plumbline.schemas import Params
from plumbline.sources.scenes import capture_scene, truth


def sessions(spark, n):
    return spark.range(n).withColumnRenamed("id", "session")


def angle(a, b):
    return math.degrees(np.linalg.norm(e.rotvec(a.T @ b)))


def test_closed_form_recovers_a_rigid_transform():
    rng = np.random.default_rng(1)
    r, t = e.rotation(np.array([0.4, -1.1, 0.7])), np.array([0.3, -2, 1])
    p = rng.normal(size=(9, 3))
    got_r, got_t = e.closed_form(p, p @ r.T + t)
    assert np.allclose(got_r, r, atol=1e-9) and np.allclose(got_t, t, atol=1e-9)
    flat = p * [1, 1, 0]  # a reflection fits a plane as well; it must not be chosen
    assert np.linalg.det(e.closed_form(flat, flat @ r.T + t)[0]) > 0


def test_rotation_vectors_round_trip():
    rng = np.random.default_rng(2)
    for _ in range(50):
        v = rng.normal(size=3)
        v *= rng.uniform(0, 3.1) / np.linalg.norm(v)
        assert np.allclose(e.rotation(e.rotvec(e.rotation(v))), e.rotation(v), atol=1e-9)


def test_solution_is_near_the_truth_and_rejects_wild_captures(spark):
    r, t = truth(Params())
    for scene in ({"noise": 0.05}, {"noise": 0.3, "outliers": 0.15}):
        captures = capture_scene(sessions(spark, 6), **scene)
        got = e.solved(captures, Params()).collect()
        assert len(got) == 6
        for row in got:
            assert angle(np.array(row.r).reshape(3, 3), r) < 3 and np.linalg.norm(np.array(row.t) - t) < 0.1
        if "outliers" in scene:
            assert sum(x.n_rejected for x in got) > 0


def test_too_few_captures_are_named(spark):
    got = e.solved(capture_scene(sessions(spark, 2), n=3), Params()).collect()
    assert {row.status for row in got} == {"insufficient"} and all(row.n_captures == 3 and row.r is None for row in got)


def test_kept_by_limit_or_quota():
    few = np.array([0.1, 9, 9.5, 8, 7, 0.2, 30, 6, 5, 40])
    assert e.kept(few, 10).sum() == 8  # enough under the limit
    assert sorted(few[e.kept(few, 1)]) == sorted(few)[:6]  # the best six of ten
    assert e.kept(np.array([5.0, 6, 7]), 1).all() and e.kept(np.array([5.0, 6, 7, 8]), 1).all()  # four always stay
    assert e.kept(np.array([1.0, 2, 2, 2, 2, 9, 9, 9]), 0.5).sum() == 5  # ties at the quota stay all


def published(spark, params, solve, n=24, **scene):
    """Median rotation error in degrees and translation error in mm over seeded scenes."""
    r, t = truth(params)
    rows = solve(capture_scene(sessions(spark, n), params=params, **scene), params)
    errors = np.array([(angle(np.array(x.r).reshape(3, 3), r), 1000 * np.linalg.norm(np.array(x.t) - t), 1000 * np.linalg.norm(np.array(x.offset) - OFFSET)) for x in rows])
    return np.median(errors, axis=0)


OFFSET = np.array(Params().offset)


def by_likelihood(captures, params):
    return e.solved(captures, params).collect()


def by_closed_form(captures, params):
    from collections import namedtuple

    row = namedtuple("row", "r t offset")
    out = []
    for _, some in captures.toPandas().groupby("session"):
        p, rb, tb = (np.array(some[c].tolist()) for c in ("p", "rb", "tb"))
        rb = rb.reshape(-1, 3, 3)
        r, t = e.closed_form(p, rb @ np.array(params.offset) + tb)
        out.append(row(r.ravel(), t, params.offset))
    return out


def test_published_accuracy(spark):
    """The published order, on scenes of our own, which are nearer and fewer: maximum likelihood is better
    than the closed form (published: 1.0 against 1.7 degrees, 38 against 120 mm); wild captures leave the
    robust fit near that; an offset that is 44 mm off is corrected when it is solved for as well."""
    plain = Params().with_values(use_prior=False, solve_offset=False, sigma_az_deg=1.0, sigma_el_deg=5.0)
    closed, likely = (published(spark, plain, how) for how in (by_closed_form, by_likelihood))
    print("closed form", closed, "likelihood", likely)
    assert likely[0] < 0.85 * closed[0] and likely[1] < 0.85 * closed[1] and likely[0] < 3 and likely[1] < 60
    wild = published(spark, plain, by_likelihood, outliers=0.1)
    print("with wild captures", wild)
    assert wild[0] < 4 and wild[1] < 80
    near = plain.with_values(offset_prior_sigma_m=0.05)
    fixed = published(spark, near, by_likelihood, offset_error=0.044)
    joint = published(spark, near.with_values(solve_offset=True), by_likelihood, offset_error=0.044)
    print("offset 44 mm off: fixed", fixed, "joint", joint)
    assert joint[1] < fixed[1]


def test_observability_names_and_parameters_in_order():
    p = Params().with_values(min_snr=60.0).with_values(min_snr=150)
    assert p.min_snr == 150 and Params().min_snr == 100.0
    for bad in ({"no_such": 1}, {"min_snr": "y"}, {"solve_offset": 1}):
        with pytest.raises((ValueError, TypeError)):
            Params().with_values(**bad)


@pytest.mark.parametrize("params", [Params(), Params().with_values(use_prior=False), Params().with_values(use_prior=False, solve_offset=False), Params().with_values(use_prior=False, force_2d=True)])
def test_batched_fits_are_those_of_the_second_solver(spark, params):
    """Sessions of 4 to 20 captures with noise, wild captures and a wrong offset, solved together, against one at a time with numeric derivatives."""
    groups = []
    for n, scene in ((4, {}), (5, {"noise": 0.5}), (12, {"outliers": 0.2}), (20, {"outliers": 0.15, "offset_error": 0.02})):
        for _, some in capture_scene(sessions(spark, 4), n=n, **scene).toPandas().sort_values("capture_no").groupby("session"):
            groups.append(some[["capture_no", "p", "rb", "tb"]].to_dict("records"))
    got = e.solutions_of(groups, params)
    same = 0
    for g, found in zip(groups, got, strict=True):
        p, rb, tb = (np.array([c[k] for c in g]) for k in ("p", "rb", "tb"))
        want = second_solver.maximum_likelihood(p, rb.reshape(-1, 3, 3), tb, params, found["elevation_used"])
        if second_solver.cost(p, rb.reshape(-1, 3, 3), tb, params, found, want) > 1e-9:
            continue  # another minimum of a fit that four captures leave open
        same += 1
        close = lambda a, b, by: np.allclose(a, b, atol=by, rtol=by)
        assert close(found["r"], want.r.ravel(), 1e-7) and close(found["t"], want.t, 1e-7) and close(found["offset"], want.offset, 1e-7)
        assert found["inliers"] == [c["capture_no"] for c, good in zip(g, want.inliers) if good] and found["rank"] == want.rank and found["converged"] == want.converged
        assert close(found["sigma"], np.sqrt(np.diag(want.cov)), 1e-5) and close(found["offset_sigma"], want.offset_sigma, 1e-5) and abs(found["rms_sigma"] - want.rms_sigma) < 1e-7
    assert same >= 0.9 * len(groups)


def test_slopes_are_derivatives():
    rng = np.random.default_rng(3)
    p, rb, tb = rng.normal(size=(5, 6, 3)) + [2, 0, 0], batched.rotations(rng.normal(size=(5, 6, 3))), rng.normal(size=(5, 6, 3))
    there = rng.random((5, 6)) < 0.8
    groups = batched.Groups(p, rb, tb, there, Params(), np.array([True, False, True, True, False]), True, True, np.tile([0.1, 0.2, 0.0], (5, 1)))
    x = rng.normal(size=(5, 9)) * 0.5
    x[0, :3] = 0
    j = groups.slopes(x, there)
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-6
        assert np.allclose(j[:, :, i], (groups.residuals(x + step, there) - groups.residuals(x - step, there)) / 2e-6, atol=1e-5)
