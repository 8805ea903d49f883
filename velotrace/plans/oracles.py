"""DuckDB SQL for the registered queries, written from the operators' definitions and not from their plans."""

from __future__ import annotations

from velotrace.plans.fixtures import LANE_SQL, REGIME_SQL, SIGNAL_SQL, TRAJ_SQL

PI = "pi()"
WRAP = lambda x: f"(({x}) + {PI} - floor((({x}) + {PI}) / (2 * {PI})) * (2 * {PI}) - {PI})"
R = lambda e, name, d=6: f"round({e}, {d}) AS {name}"


def interactions(other: str, d: float, fov: float = 360, min_speed: float = 0.0, prefix: str = "") -> str:
    """CTEs ending in {prefix}found: interactions of bicycles with tracks whose category meets `other`."""
    p = prefix
    mask = [f"dx * dx + dy * dy <= {d * d}e0"]
    if fov < 360:
        mask.append(f"abs({WRAP('atan2(-dy, -dx) - h1')}) <= radians({fov}e0 / 2)")
    if min_speed:
        mask += [f"u1 * u1 + v1 * v1 >= {min_speed}e0 * {min_speed}e0", f"u2 * u2 + v2 * v2 >= {min_speed}e0 * {min_speed}e0"]
    return f"""{p}near AS (SELECT DISTINCT a.track_id, b.track_id AS other_id FROM traj a JOIN traj b ON a.frame = b.frame AND a.track_id <> b.track_id
  WHERE a.category = 3 AND b.category {other} AND (a.translation_x - b.translation_x) ** 2 + (a.translation_y - b.translation_y) ** 2 <= {d * d}e0),
{p}joint AS (SELECT n.track_id, n.other_id, a.frame, a.timestamp AS ts, a.translation_x - b.translation_x AS dx, a.translation_y - b.translation_y AS dy,
  a.velocity_x AS u1, a.velocity_y AS v1, b.velocity_x AS u2, b.velocity_y AS v2, a.rotation_z AS h1, b.rotation_z AS h2
  FROM {p}near n JOIN traj a ON a.track_id = n.track_id JOIN traj b ON b.track_id = n.other_id AND b.frame = a.frame),
{p}flag AS (SELECT *, {' AND '.join(mask)} AS ok, row_number() OVER (PARTITION BY track_id, other_id ORDER BY frame) AS rn FROM {p}joint),
{p}isle AS (SELECT *, rn - row_number() OVER (PARTITION BY track_id, other_id ORDER BY frame) AS grp FROM {p}flag WHERE ok),
{p}found AS (SELECT track_id, other_id, min(ts) AS t_start, max(ts) AS t_end, round(max(ts) - min(ts), 2) AS duration, round(sqrt(min(dx * dx + dy * dy)), 3) AS dist_min,
  round(avg(sqrt(dx * dx + dy * dy)), 3) AS dist_mean, round(avg(sqrt((u1 - u2) ** 2 + (v1 - v2) ** 2)), 3) AS rel_speed,
  round(degrees(avg(CASE WHEN abs(h1 - h2) > {PI} THEN 2 * {PI} - abs(h1 - h2) ELSE abs(h1 - h2) END)), 2) AS rel_heading,
  CAST(min(sign(dx * v2 - dy * u2)) <> max(sign(dx * v2 - dy * u2)) AS INT) AS is_crossing
  FROM {p}isle GROUP BY track_id, other_id, grp HAVING max(ts) > min(ts))"""


FOUND = "track_id, other_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, duration, dist_min, dist_mean, rel_speed, rel_heading, is_crossing"
K = "track_id, other_id, t_start, t_end"


def clean(src: str, dst: str, h: str, name: str, keys: str, order: str) -> str:
    """CTEs that add a cleaned heading: unwrapped, anchored to the median of its first half, steps reduced by multiples of pi."""
    return f"""{dst}1 AS (SELECT *, coalesce({h} - lag({h}) OVER w, 0) AS d_, row_number() OVER w - 1 AS i_, count(*) OVER (PARTITION BY {keys}) AS n_, first_value({h}) OVER w AS f_ FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {order})),
{dst}2 AS (SELECT *, f_ + sum(d_ - round_even(d_ / (2 * {PI}), 0) * 2 * {PI}) OVER w AS u_, sum(d_ - round_even(d_ / {PI}, 0) * {PI}) OVER w AS c_ FROM {dst}1 WINDOW w AS (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)),
{dst}3 AS (SELECT *, quantile_cont(u_, 0.5) FILTER (WHERE i_ < greatest(25, n_ // 2)) OVER (PARTITION BY {keys}) AS m_ FROM {dst}2),
{dst} AS (SELECT * EXCLUDE (d_, i_, n_, f_, u_, c_, m_), f_ - round_even((f_ - m_) / {PI}, 0) * {PI} + c_ AS {name} FROM {dst}3)"""


def kernel(name: str, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    return f"{name} AS (SELECT j, exp(-0.5e0 * (j / {sigma}e0) ** 2) / sum(exp(-0.5e0 * (j / {sigma}e0) ** 2)) OVER () AS w FROM generate_series(-{r}, {r}) AS t(j))"


def smooth(src: str, dst: str, signals: list[tuple[str, str, str]], keys: list[str], keep: str = "*") -> str:
    """CTEs that add smoothed columns (kernel, signal, name) to rows with i and n."""
    on = " AND ".join(f"q.{k} = p.{k}" for k in keys)
    ctes, joins, cols = [], [], []
    for g, k in enumerate(dict.fromkeys(s[0] for s in signals)):
        own = [s for s in signals if s[0] == k]
        sums = ", ".join(f"sum(w * q.{s}) AS {n}" for _, s, n in own)
        ctes.append(f"""{dst}_{g} AS (SELECT {', '.join(f'p.{c}' for c in keys)}, p.i, {sums} FROM {src} p CROSS JOIN {k} JOIN {src} q ON {on}
  AND q.i = CASE WHEN ((p.i + j) % (2 * p.n) + 2 * p.n) % (2 * p.n) >= p.n THEN 2 * p.n - 1 - ((p.i + j) % (2 * p.n) + 2 * p.n) % (2 * p.n) ELSE ((p.i + j) % (2 * p.n) + 2 * p.n) % (2 * p.n) END GROUP BY ALL)""")
        joins.append(f"JOIN {dst}_{g} USING ({', '.join(keys)}, i)")
        cols.append(f"")
    return ",\n".join(ctes) + f",\n{dst} AS (SELECT {keep} FROM {src} {' '.join(joins)})"


def pair_frames(pad: float, found: str = "long_ones", speeds: bool = True) -> str:
    """CTEs ending in pf: smoothed pair frames of {found}."""
    lists = K.split(", ")
    both = ", ".join(f"{s}.{c} AS {s}_{c}" for s in "ab" for c in ("translation_x", "translation_y", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y", "rotation_z"))
    side = []
    for s, k in (("a", ""), ("b", "-")):
        dx, dy, h = f"{k}(b_translation_x - a_translation_x)", f"{k}(b_translation_y - a_translation_y)", f"{s}_heading"
        side.append(f"{dx} * cos({h}) + {dy} * sin({h}) AS {s}_long, -({dx}) * sin({h}) + {dy} * cos({h}) AS {s}_lat, sqrt({s}_velocity_x ** 2 + {s}_velocity_y ** 2) AS {s}_speed, sqrt({s}_acceleration_x ** 2 + {s}_acceleration_y ** 2) AS {s}_acc, {s}_velocity_x * cos({s}_rotation_z) + {s}_velocity_y * sin({s}_rotation_z) AS {s}_vlong")
    signals = [("k50", f"{s}_{c}", f"{s}_{c}_s") for s in "ab" for c in ("lat", "long")] + [("k20", f"{s}_vlong", f"{s}_vlong_s") for s in "ab"] * speeds
    return f"""pf0 AS (SELECT f.track_id, f.other_id, f.t_start, f.t_end, a.frame, a.timestamp, {both}, row_number() OVER (PARTITION BY f.track_id, f.other_id, f.t_start, f.t_end ORDER BY a.frame) - 1 AS i,
  count(*) OVER (PARTITION BY f.track_id, f.other_id, f.t_start, f.t_end) AS n FROM {found} f JOIN traj a ON a.track_id = f.track_id AND a.timestamp BETWEEN f.t_start - {pad}e0 AND f.t_end + {pad}e0 JOIN traj b ON b.track_id = f.other_id AND b.frame = a.frame),
{clean('pf0', 'pa', 'a_rotation_z', 'a_heading', K, 'i')},
{clean('pa', 'pb', 'b_rotation_z', 'b_heading', K, 'i')},
pc AS (SELECT {K}, i, n, frame, timestamp, a_heading, b_heading, {', '.join(side)} FROM pb),
{kernel('k50', 6.25)}, {kernel('k20', 2.5)},
{smooth('pc', 'pf', signals, lists)}"""


FOLLOWING = f"""flip AS (SELECT *, coalesce((CASE WHEN lead(a_long_s) OVER w < 0 THEN -1 ELSE 1 END) <> (CASE WHEN a_long_s < 0 THEN -1 ELSE 1 END) AND lead(a_long_s) OVER w IS NOT NULL, false) AS fl, coalesce(lead(timestamp) OVER w, timestamp) AS nt FROM pf WINDOW w AS (PARTITION BY {K} ORDER BY i)),
cutr AS (SELECT *, coalesce(sum(CAST(fl AS INT)) OVER (PARTITION BY {K} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM flip),
parted AS (SELECT *, avg(a_long_s) OVER (PARTITION BY {K}, part) > 0 AS af, max(timestamp) OVER (PARTITION BY {K}, part) - min(timestamp) OVER (PARTITION BY {K}, part) AS span FROM cutr WHERE NOT fl),
sided AS (SELECT {K}, part, i, timestamp, nt, CASE WHEN af THEN track_id ELSE other_id END AS ego_id, CASE WHEN af THEN other_id ELSE track_id END AS leader_id, CASE WHEN af THEN a_long_s ELSE b_long_s END AS lo, CASE WHEN af THEN a_lat_s ELSE b_lat_s END AS la,
  CASE WHEN af THEN a_long_s / (a_vlong_s + 1e-6) ELSE b_long_s / (b_vlong_s + 1e-6) END AS thw, CASE WHEN af THEN a_speed ELSE b_speed END AS vf, CASE WHEN af THEN b_speed ELSE a_speed END AS vl, abs(degrees(a_heading - b_heading)) AS rel FROM parted WHERE span >= 1.0 - 1e-9),
runs AS (SELECT *, row_number() OVER (PARTITION BY {K}, part ORDER BY i) AS rn, abs(la) < 2 AND abs(lo) > 1 AND abs(lo) < 35 AND abs(thw) < 6 AND rel < 30 AS ok FROM sided),
grp AS (SELECT *, rn - row_number() OVER (PARTITION BY {K}, part ORDER BY i) AS g FROM runs WHERE ok),
fol AS (SELECT ego_id, leader_id AS other_id, min(timestamp) AS m0, max(nt) AS m1, min(lo) AS a1, avg(lo) AS a2, avg(abs(la)) AS a3, avg(abs(thw)) AS a4, min(thw) AS a5, avg(vf) AS a6, avg(vl) AS a7, avg(abs(vf - vl)) AS a8, stddev_pop(rel) AS a9
  FROM grp GROUP BY {K}, part, g, ego_id, leader_id HAVING max(timestamp) - min(timestamp) >= 1.0 - 1e-9),
once AS (SELECT *, row_number() OVER (PARTITION BY ego_id, other_id, m0, m1 ORDER BY a1, a2) AS k FROM fol)
SELECT ego_id, other_id, round(m0, 6) AS t_start, round(m1, 6) AS t_end, round(m1 - m0, 6) AS duration, {R('a1', 'long_distance_min')}, {R('a2', 'long_distance_mean')}, {R('a3', 'lateral_offset_mean')}, {R('a4', 'thw_mean')}, {R('a5', 'thw_min')},
  {R('a6', 'follower_speed_mean')}, {R('a7', 'leader_speed_mean')}, {R('a8', 'speed_diff_mean')}, {R('a9', 'rel_heading_std')} FROM once WHERE k = 1"""

_CROSS = lambda s: f"(lag({s}_long_s) OVER w > 0 AND {s}_long_s < 0 AND min(sign({s}_long_s)) OVER f = max(sign({s}_long_s)) OVER f)"
OVERTAKE_WINDOWS = f"""crs AS (SELECT *, {_CROSS('a')} OR {_CROSS('b')} AS hit FROM pf WINDOW w AS (PARTITION BY {K} ORDER BY i), f AS (PARTITION BY {K} ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING)),
gap AS (SELECT {K}, i, n, CASE WHEN i - lag(i) OVER (PARTITION BY {K} ORDER BY i) > 15 THEN 1 ELSE 0 END AS fresh FROM crs WHERE hit),
ses AS (SELECT *, sum(fresh) OVER (PARTITION BY {K} ORDER BY i) AS grp FROM gap),
grps AS (SELECT {K}, n, grp, min(i) AS z, max(i) AS last FROM ses GROUP BY ALL),
edg AS (SELECT *, coalesce(lag(last) OVER w, 0) AS prev, coalesce(lead(z) OVER w, n - 1) AS nxt FROM grps WINDOW w AS (PARTITION BY {K} ORDER BY grp)),
pov AS (SELECT e.*, CASE WHEN p.a_long_s > 0 THEN 'a' ELSE 'b' END AS pov FROM edg e JOIN pf p USING ({K}) WHERE p.i = e.z - 1),
ext AS (SELECT {K}, o.n, grp, z, pov, arg_max(p.i, (abs(CASE WHEN pov = 'a' THEN a_long_s ELSE b_long_s END), -p.i)) FILTER (WHERE p.i <= z) AS lo, arg_max(p.i, (abs(CASE WHEN pov = 'a' THEN a_long_s ELSE b_long_s END), -p.i)) FILTER (WHERE p.i >= z) AS hi
  FROM pov o JOIN pf p USING ({K}) WHERE p.i BETWEEN prev AND nxt GROUP BY ALL),
win AS (SELECT {K}, n, grp, z, greatest(lo, z - 31, 0) AS from_i, least(hi, z + 31, n - 1) AS to_i, pov FROM ext)"""
THRESHOLDS = "[0.05e0 * pow(least(greatest(abs(lat_z), 0.05e0), 1.2e0) / 0.05e0, k / 4e0) FOR k IN range(0, CASE WHEN abs(lat_z) < 1.2e0 THEN 4 ELSE 5 END)]"
OVERTAKING = f"""cand AS (SELECT w.track_id, w.other_id, w.t_start, w.t_end, grp, w.n, z, s.a_long > 0 AS af, CASE WHEN s.a_long > 0 THEN c.a_lat_s ELSE c.b_lat_s END AS lat_z FROM win w
  JOIN pf s ON s.track_id = w.track_id AND s.other_id = w.other_id AND s.t_start = w.t_start AND s.t_end = w.t_end AND s.i = w.from_i
  JOIN pf e ON e.track_id = w.track_id AND e.other_id = w.other_id AND e.t_start = w.t_start AND e.t_end = w.t_end AND e.i = w.to_i
  JOIN pf c ON c.track_id = w.track_id AND c.other_id = w.other_id AND c.t_start = w.t_start AND c.t_end = w.t_end AND c.i = w.z
  WHERE CASE WHEN s.a_long > 0 THEN s.a_long_s > 0 AND e.a_long_s < 0 ELSE s.b_long_s > 0 AND e.b_long_s < 0 END),
ths AS (SELECT *, {THRESHOLDS} AS ths FROM cand WHERE abs(lat_z) BETWEEN 0.3e0 AND 3e0),
orow AS (SELECT c.*, p.i, p.timestamp, CASE WHEN af THEN a_long_s ELSE b_long_s END AS lo, CASE WHEN af THEN a_lat_s ELSE b_lat_s END AS la, CASE WHEN af THEN a_speed ELSE b_speed END AS vf, CASE WHEN af THEN b_speed ELSE a_speed END AS vl, CASE WHEN af THEN a_acc ELSE b_acc END AS acc FROM ths c JOIN pf p USING ({K})),
th AS (SELECT {K}, grp, th, max(i) FILTER (WHERE i BETWEEN greatest(z - 125, 0) AND z - 10 AND abs(la) <= th) AS b, min(i) FILTER (WHERE i BETWEEN z + 10 AND z + 125 AND abs(la) <= th) AS f FROM (SELECT {K}, grp, z, i, la, unnest(ths) AS th FROM orow) GROUP BY {K}, grp, th),
edges AS (SELECT {K}, grp, arg_min(b, th) FILTER (WHERE b IS NOT NULL) AS b, arg_min(f, th) FILTER (WHERE f IS NOT NULL) AS f FROM th GROUP BY {K}, grp),
chk AS (SELECT {K}, grp, CASE WHEN any_value(z) - any_value(b) > 10 AND coalesce(bool_and(abs(la) < 3 AND lo > 0) FILTER (WHERE i BETWEEN b AND z - 2), true) THEN any_value(b) END AS b,
  CASE WHEN any_value(f) - any_value(z) > 10 AND coalesce(bool_and(abs(la) < 3 AND lo < 0) FILTER (WHERE i BETWEEN z + 1 AND f - 1), true) THEN any_value(f) END AS f FROM orow JOIN edges USING ({K}, grp) GROUP BY {K}, grp),
feat AS (SELECT {K}, grp, z, af, lat_z, c.b, c.f, max(timestamp) FILTER (WHERE i = c.b) AS m0, max(timestamp) FILTER (WHERE i = z) AS mz, max(timestamp) FILTER (WHERE i = c.f) AS m1, min(lo) AS lmin, max(lo) AS lmax, max(la) FILTER (WHERE i = coalesce(c.b, z)) AS las, max(la) FILTER (WHERE i = coalesce(c.f, z)) AS lae,
  max(abs(la)) AS lam, avg(vf) AS vf, avg(vl) AS vl, avg(abs(vf - vl)) AS dv, max(acc) AS acc FROM orow JOIN chk c USING ({K}, grp) WHERE (c.b IS NOT NULL OR c.f IS NOT NULL) AND i BETWEEN coalesce(c.b, z) AND coalesce(c.f, z) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN b IS NOT NULL AND f IS NOT NULL THEN 0 ELSE 1 END, z) AS k FROM feat)
SELECT CASE WHEN af THEN track_id ELSE other_id END AS ego_id, CASE WHEN af THEN other_id ELSE track_id END AS other_id, round(m0, 6) AS t_start, round(mz, 6) AS t_cross, round(m1, 6) AS t_end, round(m1 - m0, 6) AS duration, lat_z > 0 AS left_side,
  {R('lmin', 'long_distance_min')}, {R('lmax', 'long_distance_max')}, {R('las', 'lateral_offset_start')}, {R('lae', 'lateral_offset_end')}, {R('lam', 'lateral_offset_max')}, {R('lat_z', 'lateral_offset_cross')}, {R('vf', 'follower_speed_mean')}, {R('vl', 'leader_speed_mean')}, {R('dv', 'speed_diff_mean')}, {R('acc', 'follower_acc_max')}
  FROM best WHERE k = 1"""

BIKE_BIKE = interactions("= 3", 10)
SOME = "long_ones AS (SELECT * FROM found WHERE duration > 1)"

# Windows: the maneuvers are bicycle-car interactions within 10 m that last over a second.
MANEUVERS = f"{interactions('= 1', 10)}, man AS (SELECT track_id AS ego_id, other_id, t_start, t_end FROM found WHERE duration > 1)"
SLICE = "slc AS (SELECT m.*, t.* FROM man m JOIN traj t ON t.track_id IN (m.ego_id, m.other_id) AND t.timestamp BETWEEN m.t_start - 1e-9 AND m.t_end + 1e-9)"
_N = "CAST(floor((l - s - 1.0e0 + 1e-8) / 0.5e0) AS INT) + 1"
BOUNDS = f"""spn AS (SELECT ego_id, other_id, t_start, t_end, min(timestamp) AS s, max(timestamp) AS l FROM slc GROUP BY ALL),
fullw AS (SELECT ego_id, other_id, t_start, t_end, w, s, l, CAST(round_even((s + w * 0.5e0) / 0.08e0, 0) AS BIGINT) AS f0, CAST(round_even((s + w * 0.5e0 + 1.0e0) / 0.08e0, 0) AS BIGINT) AS f1 FROM spn, unnest(generate_series(0, {_N} - 1)) AS u(w)),
lastw AS (SELECT ego_id, other_id, t_start, t_end, max(w) + 1 AS w, CAST(round_even((l - 1.0e0) / 0.08e0, 0) AS BIGINT) AS f0, CAST(round_even(l / 0.08e0, 0) AS BIGINT) AS f1 FROM fullw GROUP BY ego_id, other_id, t_start, t_end, l HAVING max(f1) < CAST(round_even(l / 0.08e0, 0) AS BIGINT)),
bnd AS (SELECT ego_id, other_id, t_start, t_end, w, f0, f1 FROM fullw UNION ALL SELECT * FROM lastw)"""
M = "ego_id, other_id, t_start, t_end"
ROWS = f"rws AS (SELECT s.*, b.w, b.f0, b.f1 FROM slc s JOIN bnd b USING ({M}) WHERE s.frame BETWEEN f0 AND f1)"
WINDOWED = f"{TRAJ_SQL}, {MANEUVERS}, {SLICE}, {BOUNDS}, {ROWS}"
OUT = "ego_id, other_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, CAST(w AS INT) AS w"


def stats(x: str, names: list[str], out: str) -> str:
    e = {
        "min": f"min({x})", "max": f"max({x})", "mean": f"avg({x})", "std": f"stddev_pop({x})", "mad": f"avg(abs({x} - m_{x}))", "cv": f"stddev_pop({x}) / nullif(avg({x}), 0)",
        "qcv": f"CASE WHEN abs(quantile_cont({x}, 0.75)) + abs(quantile_cont({x}, 0.25)) > 1e-8 THEN (quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) / (abs(quantile_cont({x}, 0.75)) + abs(quantile_cont({x}, 0.25))) END",
        "p90": f"quantile_cont({x}, 0.9)", "p90_abs": f"quantile_cont(abs({x}), 0.9)", "max_abs": f"max(abs({x}))",
    }
    return ", ".join(R(e[n], f"{out}_{n}") for n in names)


WINDOW_STATS = f"""WITH {WINDOWED}, v AS (SELECT *, sqrt(velocity_x ** 2 + velocity_y ** 2) AS x FROM rws), m AS (SELECT *, avg(x) OVER (PARTITION BY {M}, w) AS m_x FROM v)
SELECT {OUT}, {stats('x', ['min', 'max', 'mean', 'std', 'mad', 'cv', 'qcv', 'p90', 'p90_abs', 'max_abs'], 'speed')} FROM m GROUP BY {M}, w"""
RIDING = f"""WITH {TRAJ_SQL}, {MANEUVERS}, slc0 AS (SELECT m.*, t.* FROM man m JOIN traj t ON t.track_id IN (m.ego_id, m.other_id) AND t.timestamp BETWEEN m.t_start - 1e-9 AND m.t_end + 1e-9),
stp AS (SELECT *, coalesce({WRAP('rotation_z - lag(rotation_z) OVER (PARTITION BY ego_id, other_id, t_start, t_end, track_id ORDER BY frame)')}, 0) AS st FROM slc0),
slc AS (SELECT *, st - avg(st) OVER (PARTITION BY ego_id, other_id, t_start, t_end, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS rot_fluc FROM stp), {BOUNDS}, {ROWS},
v AS (SELECT *, sqrt(velocity_x ** 2 + velocity_y ** 2) AS speed, acceleration_x * cos(rotation_z) + acceleration_y * sin(rotation_z) AS acc FROM rws),
m AS (SELECT *, avg(speed) OVER p AS m_speed, avg(acc) OVER p AS m_acc, avg(rot_fluc) OVER p AS m_rot_fluc FROM v WINDOW p AS (PARTITION BY {M}, w))
SELECT {OUT}, {stats('speed', ['max', 'min', 'mean', 'std', 'mad', 'qcv'], 'speed')}, {stats('acc', ['max', 'min', 'mean', 'std', 'mad', 'qcv'], 'acc')}, {stats('rot_fluc', ['mad', 'std', 'max_abs'], 'rot_fluc')} FROM m GROUP BY {M}, w"""

ENCOUNTERS = """tgt AS (SELECT DISTINCT ego_id, t_start, t_end FROM man),
own AS (SELECT g.*, t.frame, t.timestamp, t.translation_x AS ex, t.translation_y AS ey, t.velocity_x AS eu, t.velocity_y AS ev FROM tgt g JOIN traj t ON t.track_id = g.ego_id AND t.timestamp BETWEEN g.t_start AND g.t_end),
prs AS (SELECT DISTINCT o.ego_id, o.t_start, o.t_end, c.track_id AS other_id FROM own o JOIN traj c ON floor(c.translation_x / 20) BETWEEN floor(ex / 20) - 1 AND floor(ex / 20) + 1 AND c.track_id <> o.ego_id AND c.timestamp BETWEEN o.t_start AND o.t_end WHERE (c.translation_x - ex) ** 2 + (c.translation_y - ey) ** 2 <= 400),
enc0 AS (SELECT o.ego_id, o.t_start, o.t_end, p.other_id, o.frame, c.category, c.translation_x - ex AS dx, c.translation_y - ey AS dy, c.velocity_x - eu AS vx, c.velocity_y - ev AS vy, sqrt(c.velocity_x ** 2 + c.velocity_y ** 2) AS velocity FROM own o JOIN prs p USING (ego_id, t_start, t_end) JOIN traj c ON c.track_id = p.other_id AND c.frame = o.frame),
enc AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance FROM enc0 WHERE sqrt(dx * dx + dy * dy) BETWEEN 0.5 AND 30 AND sqrt(vx * vx + vy * vy) >= 0.1 AND velocity >= 0.5)"""
SAFETY = """geo AS (SELECT *, vx * vx + vy * vy AS dv2, dx * vx + dy * vy AS dot, CASE category WHEN 1 THEN 3.5e0 WHEN 2 THEN 1.2e0 ELSE 1.8e0 END AS r FROM enc),
tm AS (SELECT *, CASE WHEN dv2 > 1e-6 THEN (-dot - sqrt(greatest(dot * dot - dv2 * (dx * dx + dy * dy - r * r), 0))) / dv2 END AS t0, CASE WHEN dv2 > 1e-6 THEN least(greatest(-dot / dv2, 0), 6) ELSE 0 END AS ts, -dot / distance AS vr FROM geo),
saf AS (SELECT *, CASE WHEN t0 > 0 THEN least(t0, 6e0) ELSE 6e0 END AS ttc, sqrt((dx + vx * ts) ** 2 + (dy + vy * ts) ** 2) AS dca, CASE WHEN vr > 0 AND distance > r THEN least(vr * vr / (2 * greatest(distance - r, 0.2e0)), 15e0) END AS drac FROM tm)"""
_CAT = {"car": (1, 20, 5.0), "pedestrian": (2, 5, 0.5), "bicycle": (3, 10, 2.0)}
_LIM = {"1_5": 1.5, "2": 2.0, "3": 3.0}
FRAME_SAFETY = "fs AS (SELECT ego_id, t_start, t_end, frame, " + ", ".join(
    f"count(*) FILTER (WHERE category = {c} AND distance <= {r} AND velocity >= {v}) AS {n}_count, min(ttc) FILTER (WHERE category = {c}) AS {n}_min_ttc, min(dca) FILTER (WHERE category = {c}) AS {n}_min_dca, max(drac) FILTER (WHERE category = {c}) AS {n}_max_drac, "
    + ", ".join(f"count(*) FILTER (WHERE category = {c} AND ttc < {t}) AS {n}_num_ttc_below_{k}s" for k, t in _LIM.items())
    for n, (c, r, v) in _CAT.items()
) + " FROM saf GROUP BY ego_id, t_start, t_end, frame)"
E_KEY = "ego_id, round(t_start, 6) AS t_start, round(t_end, 6) AS t_end, frame"
TRAFFIC = f"WITH {WINDOWED}, {ENCOUNTERS}, {SAFETY}, {FRAME_SAFETY}, j AS (SELECT r.*, fs.* EXCLUDE (ego_id, t_start, t_end, frame) FROM rws r LEFT JOIN fs USING (ego_id, t_start, t_end, frame)) SELECT {OUT}, " + ", ".join(
    ", ".join([
        R(f"avg(coalesce({n}_count, 0))", f"{n}_count_mean"), f"CAST(max(coalesce({n}_count, 0)) AS DOUBLE) AS {n}_count_max", R(f"min(coalesce({n}_min_ttc, 6e0))", f"{n}_min_ttc_min"), R(f"quantile_cont(coalesce({n}_min_ttc, 6e0), 0.1)", f"{n}_min_ttc_p10"),
        R(f"max(coalesce({n}_max_drac, 0e0))", f"{n}_max_drac"), R(f"quantile_cont(coalesce({n}_max_drac, 0e0), 0.9)", f"{n}_max_drac_p90"), f"coalesce(round(min({n}_min_dca), 6), 1e9) AS {n}_min_dca_min", R(f"coalesce(quantile_cont({n}_min_dca, 0.1), 0)", f"{n}_min_dca_p10"),
        R(f"avg(CAST(coalesce({n}_min_dca < 5, false) AS INT))", f"{n}_fraction_dca_below_th"),
        *[x for k, t in _LIM.items() for x in (R(f"avg(CAST(coalesce({n}_num_ttc_below_{k}s, 0) > 0 AS INT))", f"{n}_fraction_ttc_below_{k}s"), f"CAST(max(coalesce({n}_num_ttc_below_{k}s, 0)) AS DOUBLE) AS {n}_max_num_ttc_below_{k}s", R(f"sum(greatest({t}e0 - coalesce({n}_min_ttc, 6e0), 0e0))", f"{n}_ttc_exposure_{k}s"))],
    ]) for n in _CAT
) + f" FROM j GROUP BY {M}, w"
SIGNALS = "".join(f", d_{k} AS (SELECT t.track_id, t.frame, CASE WHEN min(sqrt((t.translation_x - s.x) ** 2 + (t.translation_y - s.y) ** 2)) <= {r} THEN min(sqrt((t.translation_x - s.x) ** 2 + (t.translation_y - s.y) ** 2)) END AS dist_{k} FROM traj t CROSS JOIN sig s WHERE s.name = '{k}' GROUP BY t.track_id, t.frame)" for k, r in (("TrafficLight", 60), ("RegulatorySign", 30), ("WarningSign", 20)))
LANES = "lc AS (SELECT track_id, frame, inner_dist, lane_width, CAST(lane_type = 'biking' AS INT) AS on_bikelane, CAST(lane_type = 'sidewalk' AS INT) AS on_sidewalk, CAST(lane_type IN ('driving', 'shoulder', 'parking', 'tram') AS INT) AS on_motorway, inner_dist - lane_width / 2 AS offset_lane_center, abs((inner_dist - lane_width / 2) / lane_width) AS rel_offset_lane_center, inner_dist / lane_width AS rel_position_lane, least(inner_dist, outer_dist) AS min_lateral_clearance, greatest(inner_dist, outer_dist) AS max_lateral_clearance FROM lane)"
INFRA = f"""WITH {WINDOWED}, {SIGNAL_SQL}, {LANE_SQL}, {LANES}{SIGNALS},
j AS (SELECT r.*, lc.* EXCLUDE (track_id, frame), dist_TrafficLight, dist_RegulatorySign, dist_WarningSign FROM rws r JOIN lc USING (track_id, frame) LEFT JOIN d_TrafficLight USING (track_id, frame) LEFT JOIN d_RegulatorySign USING (track_id, frame) LEFT JOIN d_WarningSign USING (track_id, frame))
SELECT {OUT}, """ + ", ".join(R(f"avg({c})", n) for n, c in {"p_on_motorway": "on_motorway", "p_on_bikelane": "on_bikelane", "p_on_sidewalk": "on_sidewalk", "offset_lane_center": "offset_lane_center", "rel_offset_lane_center": "rel_offset_lane_center", "rel_position_lane": "rel_position_lane", "left_clearance": "inner_dist", "min_lateral_clearance": "min_lateral_clearance", "max_lateral_clearance": "max_lateral_clearance", "lane_width": "lane_width", "distance_traffic_light": "dist_TrafficLight", "distance_regulatory_sign": "dist_RegulatorySign", "distance_warning_sign": "dist_WarningSign"}.items()) + f" FROM j GROUP BY {M}, w"
REGIMES = f"""WITH {REGIME_SQL}, s AS (SELECT *, local_regime = 1 AS v, row_number() OVER (PARTITION BY maneuver_id ORDER BY w) - 1 AS i FROM seq),
c AS (SELECT *, CAST(lag(v) OVER (PARTITION BY maneuver_id ORDER BY i) <> v AS INT) AS ch FROM s),
t AS (SELECT maneuver_id, count(*) AS n, avg(CAST(v AS INT)) AS p, coalesce(sum(ch), 0) AS ch FROM c GROUP BY maneuver_id),
g AS (SELECT maneuver_id, i, i - row_number() OVER (PARTITION BY maneuver_id ORDER BY i) AS g FROM s WHERE v),
r AS (SELECT maneuver_id, min(i) AS a, max(i) AS b FROM g GROUP BY maneuver_id, g),
d AS (SELECT *, a - lag(b) OVER (PARTITION BY maneuver_id ORDER BY a) - 1 AS gap FROM r),
q AS (SELECT maneuver_id, avg(b - a + 1) AS mr, stddev_pop(b - a + 1) AS sr, avg(gap) AS gap FROM d GROUP BY maneuver_id)
SELECT maneuver_id, n AS n_windows, p > 0 AND p < 1 AS is_active, {R('p', 'p_volatile')}, {R('ch / greatest(n - 1, 1)', 'transition_rate')}, {R('coalesce(mr, 0)', 'mean_run_volatile')}, {R('coalesce(sr, 0)', 'std_run_volatile')}, {R('coalesce(gap / n, 1)', 'mean_volatile_gap')} FROM t LEFT JOIN q USING (maneuver_id)"""
