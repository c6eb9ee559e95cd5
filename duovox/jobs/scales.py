"""Registered queries of features at several scales and of the health of a series, with SQL of the same rows."""

from __future__ import annotations

from duovox.jobs.registry import _G, query
from duovox.jobs.shapes import QUERIES, SQL  # noqa: F401
from duovox.jobs.smooth import _LOCKED, _locked
from duovox.operators import features, health, smoothing
from duovox.operators.spatial import _table
from duovox.sources.paired import grid_events


def _kernels(sigmas: list[float], sizes: str) -> str:
    """SQL of mw: for each sigma s, axis a and place i, the places j that its stencil meets (mirrored at the border), with the weights of orders 0 to 2."""
    values = ", ".join(f"({s}::DOUBLE)" for s in sigmas)
    return f"""sz(a, n) AS ({sizes}), sg(s) AS (VALUES {values}), kg AS (SELECT s, d, exp(-0.5 * d * d / (s * s)) AS g FROM sg, range(-{int(4 * max(sigmas) + 0.5)}, {int(4 * max(sigmas) + 0.5) + 1}) r(d) WHERE abs(d) <= floor(4 * s + 0.5)),
kw AS (SELECT s, d, g / sum(g) OVER (PARTITION BY s) AS w FROM kg), pl AS (SELECT a, n, unnest(range(0, n)) AS i FROM sz), mp AS (SELECT s, a, n, i, ((i + d) % (2 * n) + 2 * n) % (2 * n) AS m, d, w FROM pl, kw),
mv AS (SELECT s, a, i, CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END AS j, sum(w) AS w0, sum(-d / (s * s) * w) AS w1, sum((d * d / (s * s * s * s) - 1 / (s * s)) * w) AS w2 FROM mp GROUP BY ALL), mw AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY s, a, i) AS need FROM mv)"""


_PLANE = "VALUES ('y', 20), ('x', 20)"


def _slices(rows: str, sigmas: list[float]) -> str:
    """SQL of g0 (smooth) and lp (Laplacian) of rows (z, y, x, v) for each sigma; null where the stencil meets a missing value."""
    return f"""{_kernels(sigmas, _PLANE)}, py AS MATERIALIZED (SELECT s, z, i AS y, x, CASE WHEN count(v) = any_value(need) THEN sum(w0 * v) END AS a0, CASE WHEN count(v) = any_value(need) THEN sum(w2 * v) END AS a2 FROM {rows} JOIN mw ON a = 'y' AND j = y GROUP BY s, z, i, x),
px AS MATERIALIZED (SELECT s, z, y, i AS x, CASE WHEN count(a0) = any_value(need) THEN sum(w0 * a0) END AS g0, CASE WHEN count(a0) = any_value(need) THEN sum(w2 * a0 + w0 * a2) END AS lp FROM py JOIN mw ON mw.s = py.s AND a = 'x' AND j = x GROUP BY ALL)""".replace("SELECT s, z, y, i AS x", "SELECT py.s, z, y, i AS x")


def _tops(rows: str, cells: str, share: float, window: int, columns: str) -> str:
    """SQL of the features among rows (z, y, x, r): above a quantile of the slice, none larger around; cells: those that exist."""
    low, high = window // 2, window - window // 2 - 1
    return f"""rs AS MATERIALIZED (SELECT o.* FROM {rows} o SEMI JOIN {cells} e ON e.z = o.z AND e.y = o.y AND e.x = o.x), th AS (SELECT z, quantile_cont(r, {share}) AS q FROM rs GROUP BY z),
mx AS (SELECT a.z, a.y, a.x, max(b.r) AS m FROM rs a JOIN {rows} b ON b.z = a.z AND b.y BETWEEN a.y - {low} AND a.y + {high} AND b.x BETWEEN a.x - {low} AND a.x + {high} GROUP BY ALL)
SELECT 0 AS t, rs.z, rs.y::INTEGER AS y, rs.x::INTEGER AS x, {columns} FROM rs JOIN mx ON mx.z = rs.z AND mx.y = rs.y AND mx.x = rs.x JOIN th ON th.z = rs.z WHERE rs.r = mx.m AND rs.r > th.q"""


_ONE = "sm AS (SELECT z, y, x, g0 AS r FROM px)"
_RESPONSE = "round(rs.r, 5) AS response"


@query("peaks", f"WITH {_G}, sv AS (SELECT z, y, x, neutron AS v FROM g), {_slices('sv', [2.0])}, {_ONE}, {_tops('sm', 'g', 0.9, 10, _RESPONSE)}", 5)
def peaks(spark, sf_dir):
    return features.peaks(grid_events(spark, sf_dir))


@query("valleys", f"WITH {_G}, sv AS (SELECT z, y, x, -neutron AS v FROM g), {_slices('sv', [2.0])}, {_ONE}, {_tops('sm', 'g', 0.9, 10, 'round(-rs.r, 5) AS response')}", 5)
def valleys(spark, sf_dir):
    return features.valleys(grid_events(spark, sf_dir))


_SCALES = [1.0, 1.5, 2.0, 2.5, 3.0]
_UNIT = "sv AS (SELECT z, y, x, (xray - min(xray) OVER (PARTITION BY z)) / (max(xray) OVER (PARTITION BY z) - min(xray) OVER (PARTITION BY z) + 1e-10) AS v FROM g)"
_BEST = "lr AS (SELECT z, y, x, s, -lp * s * s AS r FROM px), sm AS MATERIALIZED (SELECT z, y, x, CASE WHEN count(r) = count(*) THEN max(r) END AS r, arg_max(s, r) AS radius FROM (FROM lr ORDER BY s) GROUP BY z, y, x)"


@query("blobs", f"WITH {_G}, {_UNIT}, {_slices('sv', _SCALES)}, {_BEST}, {_tops('sm', 'g', 0.8, 3, 'round(rs.r, 5) AS response, rs.radius')}", 5)
def blobs(spark, sf_dir):
    return features.blobs(grid_events(spark, sf_dir), "xray", (_SCALES[0], _SCALES[-1]), len(_SCALES))


_BOTH = "w AS (PARTITION BY z)"
_SCORES = "(neutron - avg(neutron) OVER w) / (stddev_pop(neutron) OVER w + 1e-10) * (xray - avg(xray) OVER w) / (stddev_pop(xray) OVER w + 1e-10)"
_SHARES = "(neutron / nullif(max(neutron) OVER w, 0)) * (xray / nullif(max(xray) OVER w, 0))"


def _bivariate(name: str, value: str) -> None:
    sql = f"WITH {_G}, sv AS (SELECT z, y, x, {value} AS v FROM g WINDOW {_BOTH}), {_slices('sv', [2.0])}, {_ONE}, {_tops('sm', 'g', 0.9, 10, _RESPONSE)}"
    query(f"joint_peaks_{name}", sql, 5)(lambda spark, sf_dir: features.bivariate_features(grid_events(spark, sf_dir), name))


_bivariate("correlation", _SCORES)
_bivariate("product", _SHARES)
_bivariate("both", f"({_SCORES}) * ({_SHARES})")


_AXES = "SELECT 'z', max(z) + 1 FROM g UNION ALL SELECT 'y', 20 UNION ALL SELECT 'x', 20"
_FULL = "CASE WHEN count({0}) = any_value(need) THEN sum({1}) END AS {2}"


def _pass(name: str, before: str, axis: str, rest: str, sums: dict[str, str], on: str = "") -> str:
    one = next(iter(sums.values())).split(" * ")[1]
    made = ", ".join(_FULL.format(one, e, n) for n, e in sums.items())
    return f"{name} AS MATERIALIZED (SELECT mw.s, c, i AS {axis}, {rest}, {made} FROM {before} p JOIN mw ON a = '{axis}' AND j = p.{axis} {on} GROUP BY mw.s, c, i, {rest})"


_BANK = ", ".join([
    "ch AS (SELECT 'neutron' AS c, z, y, x, neutron AS v FROM g UNION ALL SELECT 'xray', z, y, x, xray FROM g)", _kernels([0.7, 1.0, 1.6, 3.5], _AXES),
    _pass("pz", "ch", "z", "y, x", {"b0": "w0 * v", "b1": "w1 * v", "b2": "w2 * v"}),
    _pass("py", "pz", "y", "z, x", {"d0": "w0 * b0", "dz": "w0 * b1", "dy": "w1 * b0", "ez": "w0 * b2", "ey": "w2 * b0"}, "AND mw.s = p.s"),
    _pass("px", "py", "x", "z, y", {"g0": "w0 * d0", "gz": "w0 * dz", "gy": "w0 * dy", "gx": "w1 * d0", "lp": "w2 * d0 + w0 * (ez + ey)"}, "AND mw.s = p.s"),
])
_PICK = ", ".join(f"round(max({e}) FILTER (s = {s} AND c = '{c}'), 4) AS {c}_{n}" for c in ("neutron", "xray") for n, s, e in (("smooth_1", 0.7, "g0"), ("smooth_2", 1.6, "g0"), ("smooth_3", 3.5, "g0"), ("gradient", 1.0, "sqrt(gz * gz + gy * gy + gx * gx)"), ("laplace", 1.6, "lp")))


@query("filter_bank", f"WITH {_G}, {_BANK}, pk AS (SELECT z, y, x, {_PICK} FROM px GROUP BY z, y, x) SELECT g.t, g.z, g.y, g.x, round(neutron, 4) AS neutron, round(xray, 4) AS xray, pk.* EXCLUDE (z, y, x) FROM g JOIN pk ON pk.z = g.z AND pk.y = g.y AND pk.x = g.x", 4)
def filter_bank(spark, sf_dir):
    """Smoothed values, sizes of gradients and Laplacians of both channels, as features of each cell."""
    return features.filter_bank(grid_events(spark, sf_dir))


_HEALTH = f"""{_LOCKED}, h_ct AS MATERIALIZED (SELECT t, label, coalesce(cells, 0) AS cells, coalesce(plain_cells, 0) AS plain FROM cs FULL JOIN ps USING (t, label)), h_ft AS (SELECT min(t) AS t0, max(t) AS t9 FROM h_ct),
h_fu AS MATERIALIZED (SELECT d.t, k AS label, coalesce(cells, 0) AS cells, coalesce(plain, 0) AS plain, CASE WHEN k = 3 THEN (SELECT t0 + 1 FROM h_ft) ELSE (SELECT t0 FROM h_ft) END AS since FROM (SELECT DISTINCT t FROM h_ct) d CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k) kk LEFT JOIN h_ct ON h_ct.t = d.t AND h_ct.label = k),
h_gn AS (SELECT label, min(t) AS t, arg_min(plain, t) AS plain FROM h_fu WHERE cells = 0 AND t >= since GROUP BY label), h_st AS (SELECT label, coalesce(stddev_pop(cells) / nullif(abs(avg(cells)), 0), 0) AS change FROM h_fu WHERE label IN (1, 2) GROUP BY label), h_bt AS (SELECT t, sum(cells) AS n, sum(plain) AS p, coalesce(sum(cells) FILTER (label = 0), 0) AS u FROM h_ct GROUP BY t),
h_fd AS (SELECT CASE WHEN plain > 0 THEN 'lost by smoothing' ELSE 'lost' END AS finding, 'fail' AS status, label AS class_id, t, plain::DOUBLE AS value FROM h_gn UNION ALL SELECT 'classes present', 'pass', NULL, NULL, 4 WHERE NOT EXISTS (FROM h_gn)
UNION ALL SELECT 'appears', 'pass', label, any_value(since), count(*) FILTER (t < since AND cells = 0) FROM h_fu, h_ft WHERE since > t0 GROUP BY label
UNION ALL SELECT 'controls', 'fail', label, NULL, change FROM h_st WHERE change > 0.02 UNION ALL SELECT 'controls', 'pass', NULL, NULL, max(change) FROM h_st HAVING max(change) <= 0.02
UNION ALL (SELECT 'unclassified', CASE WHEN u / n > 0.05 THEN 'fail' ELSE 'pass' END, NULL, t, u / n FROM h_bt ORDER BY u / n DESC, t LIMIT 1)
UNION ALL (SELECT 'budget', 'fail', NULL, t, n - p FROM h_bt WHERE n <> p ORDER BY t LIMIT 1) UNION ALL SELECT 'budget', 'pass', NULL, NULL, 0 WHERE NOT EXISTS (FROM h_bt WHERE n <> p) UNION ALL SELECT 'usable data', 'pass', NULL, NULL, 1
UNION ALL SELECT 'smoothing strength', 'pass', NULL, NULL, 0.3)"""


@query("health_check", f"{_HEALTH} SELECT finding, status, class_id::INTEGER AS class_id, t::INTEGER AS t, round(value, 6) AS value FROM h_fd")
def health_check(spark, sf_dir):
    """What speaks against the smoothed locked series: four classes are expected, one of them from the second timepoint on, and one that no region defines."""
    counts = smoothing.smooth_report(_table(_locked(spark, sf_dir)))[0]
    first = counts.agg({"t": "min"}).first()[0]
    return health.health(counts, [1, 2, 3, 4], controls=[1, 2], born={3: first + 1}, smoothing=(0.3, True))
