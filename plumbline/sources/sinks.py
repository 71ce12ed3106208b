"""What a calibration writes: result documents, transforms, overlays and one-row reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as g
from plumbline.schemas import Params


def transform_command(t: g.Vec, q: g.Vec, parent: Column, child: Column) -> Column:
    """Runnable command that publishes a static transform."""
    numbers = [F.format_string("%.6f", c) for c in (*t, *q)]
    names = ("--x", "--y", "--z", "--qx", "--qy", "--qz", "--qw")
    parts = [x for n, v in zip(names, numbers, strict=True) for x in (F.lit(n), v)]
    return F.concat_ws(" ", F.lit("static_transform_publisher"), *parts, F.lit("--frame-id"), parent, F.lit("--child-frame-id"), child)


def transforms_table(poses: DataFrame) -> DataFrame:
    """(parent, child, tx, ty, tz, qx, qy, qz, qw, bx, by_, bz): each transform and its inverse's translation."""
    _, back = g.inverted(g.matrix_of_quaternion(g.vec("qx", "qy", "qz", "qw")), g.vec("tx", "ty", "tz"))
    return poses.select("parent", "child", "tx", "ty", "tz", "qx", "qy", "qz", "qw", *[b.alias(n) for b, n in zip(back, ("bx", "by_", "bz"), strict=True)])


def result_document(row: DataFrame, parent: str, child: str) -> DataFrame:
    """One text per solution: sorted ``key: value`` lines beside the same as JSON."""
    command = transform_command(g.vec("tx", "ty", "tz"), g.vec("qx", "qy", "qz", "qw"), F.lit(parent), F.lit(child))
    full = row.withColumns({"parent_frame": F.lit(parent), "child_frame": F.lit(child), "static_tf_cmd": command})
    names = sorted(full.columns)
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in names]
    return full.select("session", F.concat_ws("\n", *lines).alias("text"), F.to_json(F.struct(*names)).alias("json"))


def extrinsic_document(report: DataFrame, p: Params, names: dict[str, str], stamp_ns: int) -> DataFrame:
    """The 37 keys of a solve's result document, a row for each session that was solved, beside session.

    ``report`` is the validation report; ``names`` has parent_frame, child_frame,
    camera_name and radar_name.
    """
    r, t = g.items("r", 9), g.items("t", 3)
    q, (_, back) = g.quaternion_of_matrix(r), g.inverted(r, t)
    q_back = [-q[0], -q[1], -q[2], q[3]]
    numbers = lambda xs: F.array(*[F.lit(x).cast("double") if isinstance(x, (int, float)) else x for x in xs])
    scaled = lambda c, size, by, first=0: numbers([F.get(c, F.lit(first + i)) * by for i in range(size)])
    command = [F.format_string("%.6f", c) for c in (*t, *q)]
    keys = {  # fixed values: the document's keys and its method's name
        **{n: F.lit(names[n]) for n in ("parent_frame", "child_frame", "camera_name", "radar_name")},
        "method": F.lit("measurement_space_ML_robust"), "elevation_used": F.col("elevation_used"), "n_captures": F.col("n_captures"), "n_inliers": F.col("n_inliers"), "n_rejected": F.col("n_rejected"),
        "verdict_pass": F.col("passes"), "planar_warning": F.col("planar"), "unobservable_dof": F.col("unobservable_dof"),
        "in_sample_rms_mm": F.col("rms_mm"), "residual_rms_sigma": F.col("rms_sigma"), "loo_cv_rms_sigma": F.col("loo_rms_sigma"),
        "sigma_1_rot_deg_xyz": F.transform(F.slice("sigma", 1, 3), F.degrees), "sigma_1_t_mm_xyz": scaled("sigma", 3, 1000, 3),
        "radar_noise_sigma_range_m": F.lit(p.sigma_range_m), "radar_noise_sigma_az_deg": F.lit(p.sigma_az_deg), "radar_noise_sigma_el_deg": F.lit(p.sigma_el_deg),
        "mean_reproj_px": F.col("mean_px"), "mean_3d_mm": F.col("mean_3d_mm"), "residual_bias_mm_xyz": numbers([F.col(f"bias_{a}_mm") for a in "xyz"]), "condition_number": F.col("condition_number"),
        "radar_range_scale": F.lit(p.range_scale), "radar_range_bias_m": F.lit(p.range_bias_m),
        "T_cam_radar_translation": numbers(t), "T_cam_radar_quaternion_xyzw": numbers(q), "T_cam_radar_rpy_deg": numbers([F.degrees(x) for x in g.euler_of_matrix(r)]),
        "T_radar_cam_translation": numbers(back), "T_radar_cam_quaternion_xyzw": numbers(q_back),
        "apex_offset_in_board_m": F.col("offset"), "apex_offset_solved": F.lit(p.solve_offset), "apex_offset_1sigma_mm_xyz": scaled("offset_sigma", 3, 1000), "apex_offset_measured_prior_m": numbers(p.offset),
        "static_tf_cmd": F.concat_ws(" ", F.lit("ros2 run tf2_ros static_transform_publisher"), *command, F.lit(names["parent_frame"]), F.lit(names["child_frame"])),
        "stamp": F.lit(stamp_ns).cast("long"),
    }
    return report.where("status = 'solved'").select("session", *[c.alias(n) for n, c in keys.items()])


def pair_document(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The keys of a pair's result document beside session, of rows (session, seq, stage, pose, reproj_a, reproj_b, stamp)
    and, where the world is known, the pose in it (wtx.., wqx..).

    ``names`` has parent_frame, child_frame, camera_a_name, camera_b_name and world_frame.
    """
    pose = lambda p: (F.array(*[F.col(f"{p}t{a}") for a in "xyz"]), F.array(*[F.col(f"{p}q{a}") for a in "xyzw"]), F.array(*[F.degrees(x) for x in g.euler_of_matrix(g.matrix_of_quaternion(g.vec(*[f"{p}q{a}" for a in "xyzw"])))]))
    keys = {n: F.lit(names[n]) for n in ("parent_frame", "child_frame", "camera_a_name", "camera_b_name")}
    keys |= dict(zip(("translation", "quaternion_xyzw", "rpy_deg"), pose(""), strict=True))
    keys |= {"reproj_a_px": F.col("reproj_a"), "reproj_b_px": F.col("reproj_b"), "stage": F.col("stage"), "stamp": F.col("stamp")}
    known = F.col("wtx").isNotNull()
    keys |= {"world_frame": F.when(known, names["world_frame"])}
    keys |= {f"pose_in_map_{n}": F.when(known, x) for n, x in zip(("translation", "quaternion_xyzw", "rpy_deg"), pose("w"), strict=True)}
    return rows.select("session", "seq", *[c.alias(n) for n, c in keys.items()])


def as_documents(rows: DataFrame, key: str) -> DataFrame:
    """(key, text, json): each row as ``name: value`` lines and as JSON with all its columns."""
    lines = [F.concat(F.lit(f"{n}: "), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in rows.columns]
    return rows.select(key, F.concat_ws("\n", *lines).alias("text"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def report_lines(report: DataFrame) -> DataFrame:
    """(session, line): what a solve says of itself, in one line."""
    size = g.norm(g.items("t", 3)) * 1000
    verdict = F.when(F.col("passes"), "PASS").otherwise("SUSPECT")
    loo = F.coalesce(F.format_string("%.2f sigma", "loo_rms_sigma"), F.lit("not available"))
    solved = F.format_string(
        "session %d: %s, %d captures, %d rejected, |t| %.1f mm, 3-D %.1f mm, bias %.1f mm, residual %.2f sigma, leave-one-out %s",
        "session", verdict, "n_captures", "n_rejected", size, "mean_3d_mm", "worst_bias_mm", "rms_sigma", loo,
    )
    few = F.format_string("session %d: only %d captures", "session", "n_captures")
    return report.select("session", F.when(F.col("status") == "solved", solved).otherwise(few).alias("line"))


def written_documents(documents: DataFrame, path: str) -> None:
    """Texts and JSON in separate folders, each solve over the last."""
    documents.select("text").write.mode("overwrite").text(f"{path}/text", lineSep="\n---\n")
    documents.select("json").write.mode("overwrite").text(f"{path}/json")


def overlay(points: DataFrame, r: g.Mat, t: g.Vec, k: g.Mat, d: g.Vec, width: int, height: int) -> DataFrame:
    """Pixels of the points that fall inside the image, with their depth."""
    cam = g.rigid(r, t, g.vec("x", "y", "z"))
    rows = points.withColumns(dict(zip(("cx", "cy", "depth"), cam, strict=True))).where("depth > 0")
    rows = g.with_pixels(rows, g.vec("cx", "cy", "depth"), k, d)
    return rows.where(F.col("u").between(0, width - 1) & F.col("v").between(0, height - 1)).drop("cx", "cy")
