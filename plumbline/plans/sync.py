"""Queries of time pairing, lookups by time, stability windows and captures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.operators import capture as cap
from plumbline.operators import long
from plumbline.operators import sync as o
from plumbline.operators.gating import background_ready
from plumbline.plans import common as c
from plumbline.sources import tables as s

SLOP = 300_000_000
WINDOW, STD_CAM, STD_SENSOR, BASELINE = 4, 0.45, 0.5, 0.4


def rule(mode: str) -> cap.Captures:
    return cap.Captures(mode, WINDOW, STD_CAM, STD_SENSOR, BASELINE)


def tracks_and_commands(spark, d):
    """Errors reset a session and signups ask for a capture; the other events are its pairs."""
    rows = s.tracks(spark, d, "event_type")
    cmd = F.when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "signup", "capture")
    rows = rows.withColumn("cmd", cmd)
    return rows.where("cmd is null").drop("event_type", "cmd"), rows.where("cmd is not null").select("session", "stamp_us", "id", "cmd")


def _views_clicks(spark, d):
    return s.stream(spark, d, "view"), s.stream(spark, d, "click")


def sync_interval(spark, d):
    a, b = _views_clicks(spark, d)
    return o.pairs_within(a, b, SLOP).select("left_id", "right_id", "dt_us")


def sync_nearest(spark, d):
    a, b = _views_clicks(spark, d)
    return o.nearest_pairs(a, b, SLOP).select("left_id", "right_id", "dt_us")


def sync_pose(spark, d):
    """Images with poses that come from another host."""
    return o.nearest_pairs(s.stream(spark, d, "view"), s.stream(spark, d, "purchase"), SLOP).select("left_id", "right_id", "dt_us", "r_value")


def extrinsic_asof(spark, d):
    """Each image with the newest solution (a purchase) at or before it."""
    facts = s.stream(spark, d, "purchase").select("stamp_us", F.col("id").alias("solve_id"), "value")
    return o.as_of(s.stream(spark, d, "view").select("id", "stamp_us"), facts, ["solve_id", "value"], 3_600_000_000)


def watchdog_gaps(spark, d):
    return o.silences(s.stream(spark, d, "click"), 2_000_000_000)


def rolling_stability(spark, d):
    return c.rounded_all(cap.rolling_stability(s.tracks(spark, d), WINDOW).select("session", "id", "n", "std_cam", "std_sensor"), [])


def long_stability(spark, d):
    """The spreads of all pairs as one session, cut into spans with halos."""
    rows = long.rolling_stability(s.tracks(spark, d).withColumn("session", F.lit(0).cast("long")), WINDOW, 700)
    return c.rounded_all(rows.select("session", "id", F.col("n").cast("long").alias("n"), "std_cam", "std_sensor"), [])


def stable_rows(spark, d):
    return c.rounded_all(cap.stable(s.tracks(spark, d), WINDOW, STD_CAM, STD_SENSOR).select("session", "id", "std_cam"), [])


def _captured(df, *more):
    return c.rounded_all(df.select("session", *more, "capture_no", "id", "cx", "cy", "cz", "px", "py", "pz", "n_pairs"), [])


def capture_sweep(spark, d):
    return _captured(cap.captures(s.tracks(spark, d), rule('continuous')))


def capture_still(spark, d):
    return _captured(cap.captures(s.tracks(spark, d), rule('auto')))


def capture_commands(spark, d):
    """Still captures, captures on command and resets."""
    pairs, commands = tracks_and_commands(spark, d)
    return _captured(cap.captures(pairs, rule("auto"), commands), "segment")


def movement_gate(spark, d):
    """Distance of each pair from its session's last capture, and whether it is far enough."""
    tracks = s.tracks(spark, d)
    got = cap.captures(tracks, rule('continuous'))
    return cap.movement(tracks, got, BASELINE).select("session", "id", c.rounded("moved").alias("moved"), "passes")


def capture_counts(spark, d):
    got = cap.captures(s.tracks(spark, d), rule('continuous'))
    return got.groupBy("session").agg(F.count("*").alias("n_captures"), F.sum("n_pairs").alias("n_pairs"))


def image_scan(spark, d):
    return s.stream(spark, d, "view").select("id", "stamp_us")


def raw_tap(spark, d):
    """The unsynchronised clouds: messages and the newest stamp a day."""
    day = F.floor(F.col("stamp_us") / 86_400_000_000).alias("day")
    return s.stream(spark, d, "click").groupBy(day).agg(F.count("*").alias("n"), F.max("stamp_us").alias("newest_us"))


#: The five control topics, by the events that stand for their messages.
COMMANDS = {"signup": "solve", "error": "reset", "click": "capture", "view": "background", "purchase": "save"}


def command_union(spark, d):
    """The messages of the five control topics in one stream."""
    topics = [s.stream(spark, d, kind).select("stamp_us", "id", F.lit(cmd).alias("cmd")) for kind, cmd in COMMANDS.items()]
    return reduce(lambda a, b: a.unionByName(b), topics)


def frame_preconditions(spark, d):
    """Images at or after the first intrinsics (the first purchase) and at or after the background
    asked for by the first command (a signup) is whole, with the range in mm and degrees."""
    first = s.stream(spark, d, "purchase").agg(F.min("stamp_us").alias("locked_us"))
    ready = background_ready(s.stream(spark, d, "click"), s.stream(spark, d, "signup"), 15)
    rows = s.stream(spark, d, "view").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(ready)).where("stamp_us >= locked_us and stamp_us >= ready_us")  # one row each
    return rows.select("id", c.rounded(F.col("value") * 1000).alias("mm"), c.rounded(F.degrees(F.col("value") / 100)).alias("deg"))


def intrinsics_lock(spark, d):
    rows = s.table(spark, d, "customer")
    k = F.array(*[(F.col("c_custkey") * x).cast("double") for x in (1.5, 0, 0.5, 0, 1.25, 0.75, 0, 0, 1)])
    dist = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array(*[F.col("c_custkey") / x for x in (100.0, 200.0, 400.0, 500.0, 800.0)]))
    infos = rows.select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("camera"), F.col("c_custkey").alias("stamp_ns"), k.alias("k"), dist.alias("d"))
    out = s.first_intrinsics(infos)
    return out.select("camera", "stamp_ns", c.rounded(F.get("k", F.lit(0))).alias("fx"), c.rounded(F.get("k", F.lit(4))).alias("fy"), *[c.rounded(F.get("d", F.lit(i))).alias(f"d{i}") for i in range(5)])


def latest_tf(spark, d):
    """Every nation's newest transform (by supplier key), null where there is none."""
    tf = s.table(spark, d, "supplier").select(F.col("s_nationkey").alias("child"), F.col("s_suppkey").alias("stamp"), F.col("s_acctbal").alias("tx"))
    return s.table(spark, d, "nation").select(F.col("n_nationkey").alias("child")).join(s.latest(tf, "child", "stamp", "tx"), "child", "left")


QUERIES = {
    f.__name__: f
    for f in (sync_interval, sync_nearest, sync_pose, extrinsic_asof, watchdog_gaps, rolling_stability, long_stability, stable_rows, capture_sweep, capture_still, capture_commands, movement_gate, capture_counts, image_scan, raw_tap, command_union, frame_preconditions, intrinsics_lock, latest_tf)
}


def _pairs(b: str, slop: int = SLOP) -> str:
    return f"""{c.stream('a', 'view')}, {c.stream('b', b)},
        p AS (SELECT a.id AS left_id, b.id AS right_id, a.stamp_us AS l, b.stamp_us AS r, b.stamp_us - a.stamp_us AS dt_us, b.value AS r_value FROM a, b WHERE abs(a.stamp_us - b.stamp_us) <= {slop}),
        k AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY abs(dt_us), r, right_id) AS i, row_number() OVER (PARTITION BY right_id ORDER BY abs(dt_us), l, left_id) AS j FROM p)"""


_SPREAD = "sqrt(var_pop({0}x) OVER w + var_pop({0}y) OVER w + var_pop({0}z) OVER w)"
_STABILITY = f"""{c.TRACKS}, s AS (
    SELECT session, id, count(*) OVER w AS n, {_SPREAD.format('c')} AS std_cam, {_SPREAD.format('p')} AS std_sensor
    FROM tracks WINDOW w AS (PARTITION BY session ORDER BY stamp_us, id ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))"""


def _mean(i: str) -> str:
    return f"list_avg(list_transform(win, lambda e: e.{i}))"


_WITH_COMMANDS = """n AS (SELECT t.*, CASE event_type WHEN 'error' THEN 'reset' WHEN 'signup' THEN 'capture' END AS cmd, row_number() OVER (PARTITION BY session ORDER BY stamp_us, id) AS i
            FROM tracks t JOIN events ON event_id = id)"""
_WITHOUT = "n AS (SELECT *, NULL::VARCHAR AS cmd, row_number() OVER (PARTITION BY session ORDER BY stamp_us, id) AS i FROM tracks)"


def _captures(mode: str, rows: str = _WITHOUT) -> str:
    """The fold as recursion over each session's rows: state is the window, the last capture, what was asked for and the segment."""
    size = 3 if mode == "continuous" else WINDOW
    spread = lambda p: "sqrt(" + " + ".join(f"list_var_pop(list_transform(win, lambda e: e.{p}{a}))" for a in "xyz") + ")"
    far = lambda p: f"(lx IS NULL OR sqrt(({p}x - lx) ** 2 + ({p}y - ly) ** 2 + ({p}z - lz) ** 2) >= {BASELINE})"
    still = f"coalesce(len(win) >= {WINDOW} AND {spread('c')} < {STD_CAM} AND {spread('p')} < {STD_SENSOR}, false)"
    new = "{'cx': n.cx, 'cy': n.cy, 'cz': n.cz, 'px': n.px, 'py': n.py, 'pz': n.pz}"
    means = ", ".join(f"{_mean(v)} AS m{v}" for v in ("cx", "cy", "cz", "px", "py", "pz"))
    if mode == "continuous":
        judged = f"SELECT *, cmd IS NULL AND {far('u')} AS got, false AS served FROM (SELECT *, {means} FROM fed)"
    else:
        judged = f"""SELECT *, cmd IS NULL AND CASE WHEN still THEN {far('mc')} ELSE served END AS got
            FROM (SELECT *, cmd IS NULL AND NOT still AND asked AND len(win) >= {max(3, WINDOW // 2)} AS served FROM (SELECT *, {still} AS still, {means} FROM fed))"""
    return f"""WITH RECURSIVE {c.TRACKS},
        {rows},
        f AS (
            SELECT session, 0::BIGINT AS i, NULL::BIGINT AS id, []::STRUCT(cx DOUBLE, cy DOUBLE, cz DOUBLE, px DOUBLE, py DOUBLE, pz DOUBLE)[] AS win, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, NULL::DOUBLE AS lz,
                   0 AS no, 0 AS segment, false AS asked, false AS got, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::DOUBLE AS cz, NULL::DOUBLE AS px, NULL::DOUBLE AS py, NULL::DOUBLE AS pz, 0 AS n_pairs FROM (SELECT DISTINCT session FROM n)
            UNION ALL
            (WITH fed AS (
                SELECT f.session, n.i, n.id, n.cmd, n.cx AS ux, n.cy AS uy, n.cz AS uz,
                       CASE WHEN n.cmd = 'reset' THEN [] WHEN n.cmd IS NULL THEN list_slice(list_append(f.win, {new}), -{size}, -1) ELSE f.win END AS win,
                       CASE WHEN n.cmd = 'reset' THEN NULL ELSE f.lx END AS lx, f.ly, f.lz, CASE WHEN n.cmd = 'reset' THEN 0 ELSE f.no END AS no,
                       CASE WHEN n.cmd = 'reset' THEN f.segment + 1 ELSE f.segment END AS segment, f.asked OR coalesce(n.cmd = 'capture', false) AS asked
                FROM f JOIN n ON n.session = f.session AND n.i = f.i + 1)
            SELECT session, i, id, CASE WHEN got THEN [] ELSE win END, CASE WHEN got THEN mcx ELSE lx END, CASE WHEN got THEN mcy ELSE ly END, CASE WHEN got THEN mcz ELSE lz END,
                   CASE WHEN got THEN no + 1 ELSE no END, segment, asked AND NOT served, got, mcx, mcy, mcz, mpx, mpy, mpz, len(win)::INTEGER
            FROM ({judged}))),
        out AS (SELECT * FROM f WHERE got)"""


def _captured_sql(more: str = "") -> str:
    return f"SELECT session, {more}no AS capture_no, id, {', '.join(f'{c.r(v)} AS {v}' for v in ('cx', 'cy', 'cz', 'px', 'py', 'pz'))}, n_pairs FROM out"


ORACLES = {
    "sync_interval": f"WITH {_pairs('click')} SELECT left_id, right_id, dt_us FROM p",
    "sync_nearest": f"WITH {_pairs('click')} SELECT left_id, right_id, dt_us FROM k WHERE i = 1 AND j = 1",
    "sync_pose": f"WITH {_pairs('purchase')} SELECT left_id, right_id, dt_us, r_value FROM k WHERE i = 1 AND j = 1",
    "extrinsic_asof": f"WITH {c.stream('a', 'view')}, {c.stream('b', 'purchase')} SELECT a.id, a.stamp_us, b.id AS solve_id, b.value FROM a ASOF LEFT JOIN b ON a.stamp_us >= b.stamp_us",
    "watchdog_gaps": f"WITH {c.stream('a', 'click')}, g AS (SELECT stamp_us, lead(stamp_us) OVER (ORDER BY stamp_us) - stamp_us AS silent_us FROM a) SELECT * FROM g WHERE silent_us > 2000000000",
    "rolling_stability": f"WITH {_STABILITY} SELECT session, id, n, {c.r('std_cam')} AS std_cam, {c.r('std_sensor')} AS std_sensor FROM s",
    "long_stability": f"""WITH {c.TRACKS}, s AS (SELECT 0::BIGINT AS session, id, count(*) OVER w AS n, {_SPREAD.format('c')} AS std_cam, {_SPREAD.format('p')} AS std_sensor
            FROM tracks WINDOW w AS (ORDER BY stamp_us, id ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW))
        SELECT session, id, n, {c.r('std_cam')} AS std_cam, {c.r('std_sensor')} AS std_sensor FROM s""",
    "stable_rows": f"WITH {_STABILITY} SELECT session, id, {c.r('std_cam')} AS std_cam FROM s WHERE n >= {WINDOW} AND std_cam < {STD_CAM} AND std_sensor < {STD_SENSOR}",
    "capture_sweep": f"{_captures('continuous')} {_captured_sql()}",
    "capture_still": f"{_captures('auto')} {_captured_sql()}",
    "capture_commands": f"{_captures('auto', _WITH_COMMANDS)} {_captured_sql('segment, ')}",
    "movement_gate": f"""{_captures('continuous')}, l AS (
            SELECT t.session, t.id, t.cx, t.cy, t.cz, last_value(o.cx IGNORE NULLS) OVER w AS x, last_value(o.cy IGNORE NULLS) OVER w AS y, last_value(o.cz IGNORE NULLS) OVER w AS z
            FROM tracks t LEFT JOIN out o ON o.session = t.session AND o.id = t.id WINDOW w AS (PARTITION BY t.session ORDER BY t.stamp_us, t.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        m AS (SELECT session, id, sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2) AS moved FROM l)
        SELECT session, id, {c.r('moved')} AS moved, moved IS NULL OR moved >= {BASELINE} AS passes FROM m""",
    "capture_counts": f"{_captures('continuous')} SELECT session, count(*) AS n_captures, sum(n_pairs)::BIGINT AS n_pairs FROM out GROUP BY session",
    "image_scan": f"WITH {c.stream('a', 'view')} SELECT id, stamp_us FROM a",
    "raw_tap": f"WITH {c.stream('a', 'click')} SELECT stamp_us // 86400000000 AS day, count(*) AS n, max(stamp_us) AS newest_us FROM a GROUP BY 1",
    "command_union": f"SELECT epoch_us(ts) AS stamp_us, event_id AS id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())} END AS cmd FROM events WHERE event_type IN ({', '.join(f"'{k}'" for k in COMMANDS)})",
    "frame_preconditions": f"""WITH {c.stream('a', 'view')}, {c.stream('b', 'purchase')}, {c.stream('cloud', 'click')}, {c.stream('cmd', 'signup')},
        r AS (SELECT stamp_us FROM cloud WHERE stamp_us >= (SELECT min(stamp_us) FROM cmd) ORDER BY stamp_us LIMIT 15),
        q AS (SELECT max(stamp_us) AS ready FROM r HAVING count(*) = 15)
        SELECT id, {c.r('value * 1000')} AS mm, {c.r('degrees(value / 100)')} AS deg FROM a, q WHERE stamp_us >= (SELECT min(stamp_us) FROM b) AND stamp_us >= ready""",
    "intrinsics_lock": f"""WITH k AS (SELECT concat_ws('-', c_mktsegment, c_nationkey) AS camera, min(c_custkey) AS stamp_ns FROM customer GROUP BY 1)
        SELECT camera, stamp_ns, {c.r('stamp_ns * 1.5::DOUBLE')} AS fx, {c.r('stamp_ns * 1.25::DOUBLE')} AS fy,
        {', '.join(f"CASE WHEN stamp_ns % 3 = 0 THEN 0.0::DOUBLE ELSE {c.r(f'stamp_ns / {x}::DOUBLE')} END AS d{i}" for i, x in enumerate((100, 200, 400, 500, 800)))} FROM k""",
    "latest_tf": "WITH t AS (SELECT s_nationkey, max(s_suppkey) AS stamp FROM supplier GROUP BY 1) SELECT n_nationkey AS child, stamp, s_acctbal AS tx FROM nation LEFT JOIN t ON s_nationkey = n_nationkey LEFT JOIN supplier ON s_suppkey = stamp",
}
