"""Row shapes of the sensor tables and the calibration's parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

POINTS = "frame_id long, stamp_ns long, point_idx int, x double, y double, z double, snr double, doppler double"
CORNERS = "frame_id long, stamp_ns long, corner_id int, u double, v double"
BOARD_CORNERS = "corner_id int, x double, y double, z double"
POSES = "frame_id long, stamp_ns long, rb array<double>, tb array<double>, reproj_l2_over_n double, n_corners int"
CAPTURES = "session string, capture_no int, p_radar array<double>, snr double, dop double, rb array<double>, tb array<double>"


@dataclass(frozen=True)
class Params:
    """Defaults of the calibration. Values of 0 or less switch the optional gates off."""

    # fixed values: the published defaults of the method
    squares_x: int = 9
    squares_y: int = 7
    square_len: float = 0.020
    marker_len: float = 0.015
    min_corners: int = 6
    max_reproj_px: float = 1.5
    offset: tuple[float, float, float] = (0.10, 0.23, -0.05)
    solve_offset: bool = True
    offset_prior_sigma_m: float = 0.05
    select_by: str = "snr"
    min_range: float = 0.5
    max_range: float = 2.5
    max_abs_doppler: float = -1.0
    min_abs_doppler: float = -1.0
    gate_radius: float = 0.5
    range_gate_margin_m: float = 0.5
    bg_accum_frames: int = 15
    bg_match_dist: float = 0.2
    require_background: bool = False
    range_scale: float = 1.0
    range_bias_m: float = 0.0
    sigma_range_m: float = 0.05
    sigma_az_deg: float = 3.0
    sigma_el_deg: float = 10.0
    force_2d: bool = False
    signed_elevation: bool = False  # ours: spread of z/r instead of abs(z)/r
    huber: float = 1.5
    reject_sigma: float = 4.0
    max_iter: int = 5
    use_prior: bool = True
    prior_t: tuple[float, float, float] = (0.207, 0.016, 0.020)
    prior_rpy_deg: tuple[float, float, float] = (-90.0, -90.0, 0.0)
    prior_t_sigma_m: float = 0.05
    prior_rot_sigma_deg: float = 15.0
    min_snr: float = 100.0
    capture_mode: str = "continuous"
    stable_window: int = 12
    stable_std: float = 0.01
    stable_std_radar: float = 0.08
    min_baseline: float = 0.10
    min_points: int = 20
    sync_slop: float = 0.08
    pass_reproj_px: float = 200.0
    pass_3d_mm: float = 150.0
    pass_bias_mm: float = 50.0
    measured_baseline_m: float = -1.0
    baseline_tol_m: float = 0.03
    watchdog_s: float = 3.0
    # camera-to-camera pairs
    pool_cap: int = 400
    conv_window: int = 15
    conv_hold: int = 20
    conv_t_std: float = 0.003
    conv_rot_std_deg: float = 0.2
    conv_pool: int = 60

    def with_values(self, **given: object) -> Params:
        """Later values win; unknown names and wrong kinds are refused."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        for name, value in given.items():
            if name not in kinds:
                raise ValueError(f"no parameter {name}")
            if not isinstance(value, kinds[name]) and not (kinds[name] is float and type(value) is int):
                raise TypeError(f"{name} must be {kinds[name].__name__}")
        return replace(self, **given)


#: The two published presets: a still target, and one that is carried about.
STATIC = Params().with_values(capture_mode="auto", min_baseline=0.12, min_points=15, stable_window=16, stable_std=0.01, stable_std_radar=0.05, min_snr=100.0)
DYNAMIC = Params().with_values(capture_mode="continuous", min_baseline=0.08, min_points=20, min_snr=60.0, min_abs_doppler=0.1)
