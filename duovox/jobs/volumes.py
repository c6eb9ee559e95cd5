"""Registered queries on cells with coordinates, boxes, scores and the locked mode's accounts, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from duovox.jobs.registry import _B, _CLASS, _G, _MATCH, _P, _R, _V, BINS, QUERIES, REGIONS, SQL, lineitem_grid, lineitem_hist, query
from duovox.operators import boxes, clusters, histograms, islands, materials, spatial, statistics, stencils
from duovox.sources.paired import grid_events, grid_series, paired_lineitem, with_labels

BOX = boxes.Box((0, 4), (3, 17), (5, 12))
FLOORS = (3.0, 2000.0)

_S = f"{_G}, s AS (SELECT (z // 5)::INTEGER AS t, (z % 5)::INTEGER AS z, y, x, neutron, xray, label FROM c)"
_SF = f"{_S}, faces AS (SELECT a.t, a.label AS a, b.label AS b FROM s a JOIN s b ON b.t = a.t AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1)))"
_O3 = "o AS (SELECT dz, dy, dx FROM range(-1, 2) a(dz), range(-1, 2) b(dy), range(-1, 2) c(dx))"
_E = "e AS (SELECT max(z) AS mz, max(y) AS my, max(x) AS mx FROM g)"
_N = f"{_G}, {_O3}, {_E}, w AS (SELECT g.z, g.y, g.x, dz, dy, dx, greatest(0, least(mz, g.z + dz)) AS tz, greatest(0, least(my, g.y + dy)) AS ty, greatest(0, least(mx, g.x + dx)) AS tx FROM g, o, e), n AS (SELECT w.*, v.neutron, v.xray FROM w JOIN g v ON v.z = tz AND v.y = ty AND v.x = tx)"
_COMPONENTS = "lab(id, comp) USING KEY (id) AS (SELECT id, id FROM m UNION SELECT e.b, min(l.comp) FROM lab l JOIN e ON e.a = l.id JOIN recurring.lab c ON c.id = e.b WHERE l.comp < c.comp GROUP BY e.b)"
_NEXT = "((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))"


def series(spark, sf_dir):
    return with_labels(grid_series(spark, sf_dir))


@query("local_moments", f"WITH {_N} SELECT 0 AS t, z, y, x, round(avg(neutron), 4) AS mean, round(sqrt(greatest(avg(neutron * neutron) - avg(neutron) * avg(neutron), 0)), 4) AS std FROM n GROUP BY z, y, x", 4)
def local_moments(spark, sf_dir):
    return stencils.local_moments(grid_events(spark, sf_dir))


def _sobel(v: str) -> list[str]:
    weight = {a: f"(2 - abs({a}))" for a in ("dz", "dy", "dx")}
    return [f"sum({v} * {a} * " + " * ".join(weight[b] for b in weight if b != a) + ")" for a in weight]


_SLOPES = ", ".join(f"{e} AS {c}{k}" for c, v in (("n", "neutron"), ("x", "xray")) for k, e in enumerate(_sobel(v)))
_NORM = {c: f"sqrt({c}0 * {c}0 + {c}1 * {c}1 + {c}2 * {c}2)" for c in "nx"}


@query("gradients", f"WITH {_N}, d AS (SELECT z, y, x, {_SLOPES} FROM n GROUP BY z, y, x) SELECT 0 AS t, z, y, x, round({_NORM['n']}, 3) AS gradient_n, round({_NORM['x']}, 3) AS gradient_x, round(abs(n0 * x0 + n1 * x1 + n2 * x2) / ({_NORM['n']} * {_NORM['x']} + 1e-6), 3) AS coherence FROM d", 3)
def gradients(spark, sf_dir):
    return stencils.gradients(grid_events(spark, sf_dir))


@query("structure_tensor")
def structure_tensor(spark, sf_dir):
    return stencils.structure(grid_events(spark, sf_dir))


_SIX = "(abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x)) = 1"
_ERODE = ", ".join(f"e{k + 1} AS (SELECT a.t, a.z, a.y, a.x FROM e{k} a JOIN e{k} b ON b.t = a.t AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND {_SIX} GROUP BY ALL HAVING count(*) = 6)" for k in range(4))
_LEFT = ", ".join(f"(SELECT count(*) FROM e{k} WHERE e{k}.t = ts.t) AS c{k}" for k in range(5))


@query("erosion_survival", f"WITH {_S}, e0 AS (SELECT t, z, y, x FROM s WHERE (xray >= 5) <> (neutron < 2)), {_ERODE}, w AS (SELECT t, {_LEFT} FROM (SELECT DISTINCT t FROM s) ts) SELECT t, c0 AS n, {', '.join(f'round(c{k} / nullif(c0, 0), 6) AS survival_{k}' for k in range(1, 5))}, coalesce(round(1 - c2 / nullif(c0, 0), 6), 1.0) AS f_rind FROM w")
def erosion_survival(spark, sf_dir):
    return stencils.survival(grid_series(spark, sf_dir), F.col("xray") >= 5, F.col("neutron") < 2)


_SHAPE = f"""WITH {_S}, m AS (SELECT t, z, y, x, label = 2 AS m FROM s),
k AS (SELECT a.t, a.z, a.y, a.x, a.m, count(b.m) FILTER (b.m) AS hits FROM m a LEFT JOIN m b ON b.t = a.t AND b.z = a.z AND ((b.y = a.y AND abs(b.x - a.x) = 1) OR (b.x = a.x AND abs(b.y - a.y) = 1)) GROUP BY ALL),
u AS (SELECT t, z, count(*) FILTER (m) AS area, count(*) FILTER (NOT m AND hits > 0) AS perimeter, count(*) FILTER (m AND hits < 4) AS inn, min(y) FILTER (m) AS min_y, max(y) FILTER (m) AS max_y, min(x) FILTER (m) AS min_x, max(x) FILTER (m) AS max_x,
  avg(y) FILTER (m) AS centre_y, avg(x) FILTER (m) AS centre_x, var_pop(y) FILTER (m) AS vy, var_pop(x) FILTER (m) AS vx, covar_pop(y, x) FILTER (m) AS cv FROM k GROUP BY t, z),
l AS (SELECT *, (vy + vx + sqrt(4 * cv * cv + (vy - vx) * (vy - vx))) / 2 AS l1, (vy + vx - sqrt(4 * cv * cv + (vy - vx) * (vy - vx))) / 2 AS l2 FROM u WHERE area > 0)
SELECT t, z, area, perimeter, min_y, max_y, min_x, max_x, round(centre_y, 5) AS centre_y, round(centre_x, 5) AS centre_x, round(CASE WHEN perimeter = 0 THEN 0 ELSE 4 * pi() * area / (perimeter * perimeter) END, 5) AS circularity,
  round(perimeter * perimeter / area, 5) AS compactness, round((perimeter + inn) / area, 5) AS roughness, round(CASE WHEN abs(vy - vx) < 1e-12 THEN 0 ELSE 0.5 * atan2(2 * cv, vy - vx) END, 5) AS orientation,
  round(CASE WHEN l1 > 1e-12 THEN sqrt(greatest(1 - l2 / l1, 0)) ELSE 0 END, 5) AS eccentricity, round(CASE WHEN l2 <= 1e-12 THEN 1 ELSE sqrt(l1 / l2) END, 5) AS aspect_ratio FROM l"""


@query("slice_shapes", _SHAPE, 5)
def slice_shapes(spark, sf_dir):
    return stencils.slice_shapes(series(spark, sf_dir), F.col("label") == 2)


_ROWS = f"""WITH {_SF}, q AS (SELECT t, label, count(*) AS n, avg(z) AS cz, avg(y) AS cy, avg(x) AS cx, sqrt(var_pop(z) + var_pop(y) + var_pop(x)) AS gyration FROM s GROUP BY ALL),
fs AS (SELECT t, label, count(*) AS faces FROM (SELECT t, a AS label FROM faces WHERE a <> b UNION ALL SELECT t, b FROM faces WHERE a <> b) GROUP BY ALL)
SELECT q.t, q.label, n, round(cz, 5) AS centre_z, round(cy, 5) AS centre_y, round(cx, 5) AS centre_x, round(gyration, 5) AS gyration, round(coalesce(faces, 0) / n, 5) AS surface_share,
  round(sqrt(power(cz - first(cz) OVER w, 2) + power(cy - first(cy) OVER w, 2) + power(cx - first(cx) OVER w, 2)), 5) AS drift FROM q LEFT JOIN fs ON fs.t = q.t AND fs.label = q.label WINDOW w AS (PARTITION BY q.label ORDER BY q.t)"""


@query("spatial_rows", _ROWS, 5)
def spatial_rows(spark, sf_dir):
    return spatial.label_rows(series(spark, sf_dir))


@query("interface_rows", f"WITH {_SF} SELECT t, least(a, b) AS first, greatest(a, b) AS second, count(*) AS faces FROM faces WHERE a <> b GROUP BY ALL")
def interface_rows(spark, sf_dir):
    return spatial.interface_rows(series(spark, sf_dir))


_PARTS = f"WITH RECURSIVE {_S}, m AS (SELECT *, ((t * 5 + z) * 20 + y) * 20 + x AS id FROM s WHERE label IS NOT NULL), f AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.t = a.t AND b.label = a.label AND {_NEXT}), e AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f), {_COMPONENTS}, p AS (SELECT t, label, comp, count(*) AS n FROM lab JOIN m USING (id) GROUP BY ALL)"


@query("label_components", f"{_PARTS} SELECT t, label, count(*) AS components, round(max(n) / sum(n), 6) AS largest_share FROM p GROUP BY t, label")
def label_components(spark, sf_dir):
    return spatial.label_components(series(spark, sf_dir))


def _grown(near: str, step: str) -> str:
    return f"WITH RECURSIVE {_G}, seed AS (SELECT * FROM g WHERE z = 0 AND y = 10 AND x = 10), k AS (SELECT g.z, g.y, g.x FROM g, seed WHERE {near}), r AS (SELECT k.z, k.y, k.x FROM k, seed WHERE k.z = seed.z AND k.y = seed.y AND k.x = seed.x UNION SELECT k.z, k.y, k.x FROM r JOIN k ON abs(k.z - r.z) <= 1 AND abs(k.y - r.y) <= 1 AND abs(k.x - r.x) <= 1 AND {step}) SELECT 0 AS t, z, y, x FROM r"


SQL["region_grow"] = _grown("abs(g.xray - seed.xray) <= 30", "abs(k.z - r.z) + abs(k.y - r.y) + abs(k.x - r.x) = 1").replace("WHERE z = 0 AND y = 10", "WHERE z = 1 AND y = 10")
SQL["connected_components"] = f"WITH RECURSIVE {_G}, m AS (SELECT *, (z * 20 + y) * 20 + x AS id FROM g WHERE xray >= 60), f AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON {_NEXT}), e AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f), {_COMPONENTS} SELECT 0 AS t, comp::BIGINT AS component, count(*) AS n FROM lab GROUP BY comp"


@query("grow_bivariate", _grown("abs(g.neutron - seed.neutron) <= 6 AND abs(g.xray - seed.xray) <= 30", "TRUE"))
def grow_bivariate(spark, sf_dir):
    return spatial.grown(grid_events(spark, sf_dir), (0, 0, 10, 10), ("neutron", "xray"), (6.0, 30.0), reach=3)


@query("grow_edges", _grown("abs(g.xray - seed.xray) <= 15", "abs(k.z - r.z) + abs(k.y - r.y) + abs(k.x - r.x) <= 2"))
def grow_edges(spark, sf_dir):
    return spatial.grown(grid_events(spark, sf_dir), (0, 0, 10, 10), "xray", 15.0, reach=2)


_GAP = "sqrt(power((b.neutron - a.neutron) / sn, 2) + power((b.xray - a.xray) / sx, 2))"
_WEIGHTS = f"""WITH {_S}, k AS (SELECT t, stddev_pop(neutron) AS sn, stddev_pop(xray) AS sx, max(z) - min(z) + 1 AS nz, max(y) - min(y) + 1 AS ny, max(x) - min(x) + 1 AS nx FROM s GROUP BY t),
p AS (SELECT a.t, a.z, a.y, a.x, CASE WHEN b.z > a.z THEN 'z' WHEN b.y > a.y THEN 'y' ELSE 'x' END AS axis, {_GAP} AS gap, CASE WHEN nz > 1 THEN ny * nx ELSE 0 END + CASE WHEN ny > 1 THEN nz * nx ELSE 0 END + CASE WHEN nx > 1 THEN nz * ny ELSE 0 END AS last
  FROM s a JOIN k ON k.t = a.t JOIN s b ON b.t = a.t AND ((b.z = a.z + 1 AND b.y = a.y AND b.x = a.x) OR (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x) OR (b.z = a.z AND b.y = a.y AND b.x = a.x + 1))),
q AS (SELECT t, sum(gap) / (count(gap) + first(last)) AS sigma FROM p GROUP BY t)
SELECT p.t, z, y, x, axis, round(coalesce(exp(-0.5 * power(gap / sigma, 2)), 0), 5) AS weight FROM p JOIN q ON q.t = p.t"""


@query("edge_weights", _WEIGHTS, 5)
def edge_weights(spark, sf_dir):
    return spatial.edge_weights(grid_series(spark, sf_dir))


_IN = "z >= 0 AND z < 4 AND y >= 3 AND y < 17 AND x >= 5 AND x < 12"


@query("crop_embed", f"WITH {_S} SELECT t, z, y, x, CASE WHEN {_IN} THEN xray ELSE -1 END AS xray FROM s")
def crop_embed(spark, sf_dir):
    cells = grid_series(spark, sf_dir)
    return boxes.embedded(cells, cells.where(BOX.holds()), ["xray"], -1.0)


@query("shifted_whole", f"WITH {_S} SELECT a.t, a.z, a.y, a.x, b.xray FROM s a LEFT JOIN s b ON b.t = a.t AND b.z = a.z - 1 AND b.y = a.y + 2 AND b.x = a.x")
def shifted_whole(spark, sf_dir):
    return boxes.shifted(grid_series(spark, sf_dir), (1.0, -2.0, 0.0))


@query("shifted_fraction", f"WITH {_S} SELECT a.t, a.z, a.y, a.x, round(0.75 * (0.5 * b.xray + 0.5 * c.xray) + 0.25 * (0.5 * d.xray + 0.5 * f.xray), 6) AS xray FROM s a LEFT JOIN s b ON b.t = a.t AND b.z = a.z AND b.y = a.y AND b.x = a.x LEFT JOIN s c ON c.t = a.t AND c.z = a.z AND c.y = a.y - 1 AND c.x = a.x LEFT JOIN s d ON d.t = a.t AND d.z = a.z AND d.y = a.y AND d.x = a.x - 1 LEFT JOIN s f ON f.t = a.t AND f.z = a.z AND f.y = a.y - 1 AND f.x = a.x - 1")
def shifted_fraction(spark, sf_dir):
    return boxes.shifted(grid_series(spark, sf_dir), (0.0, 0.5, 0.25))


@query("upscaled_mask", f"WITH {_S}, b AS (SELECT t, z // 3 AS qz, y // 3 AS qy, x // 3 AS qx, bool_or(xray >= 95) AS hit FROM s WHERE z < 3 AND y < 18 AND x < 18 GROUP BY ALL) SELECT s.t, s.z, s.y, s.x, hit FROM s JOIN b ON b.t = s.t AND qz = least(s.z // 3, 0) AND qy = least(s.y // 3, 5) AND qx = least(s.x // 3, 5)")
def upscaled_mask(spark, sf_dir):
    cells = grid_series(spark, sf_dir)
    whole = cells.where("z < 3 AND y < 18 AND x < 18")
    return boxes.upscaled(cells, spatial.block_mask(whole, 3, F.col("xray") >= 95), 3, "hit")


@query("strided_hist", f"WITH {_S}, f AS (SELECT * FROM s), {_R}, {_B}, w AS (SELECT * FROM s WHERE t % 2 = 0 AND z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0) SELECT greatest(0, least(63, floor((xray - x0) / (x1 - x0) * 64)))::INTEGER AS iy, greatest(0, least(63, floor((neutron - n0) / (n1 - n0) * 64)))::INTEGER AS ix, count(*) AS count FROM w, r GROUP BY ALL")
def strided_hist(spark, sf_dir):
    cells = grid_series(spark, sf_dir)
    return histograms.histogram(boxes.strided(cells, 2), histograms.plane_grid(cells, BINS), by=())


@query("slice_rectangle", f"WITH {_G}, k AS (SELECT * FROM g WHERE z = 1 AND y >= 4 AND y < 12 AND x >= 2 AND x < 9), m AS (SELECT min(neutron) AS a, max(neutron) AS b, min(xray) AS c, max(xray) AS d FROM k) SELECT round(a - (b - a) * 0.05, 6) AS n0, round(b + (b - a) * 0.05, 6) AS n1, round(c - (d - c) * 0.05, 6) AS x0, round(d + (d - c) * 0.05, 6) AS x1 FROM m")
def slice_rectangle(spark, sf_dir):
    return boxes.value_rectangle(grid_events(spark, sf_dir).where(boxes.Box((1, 2), (4, 12), (2, 9)).holds()))


@query("overlay", f"WITH {_S}, e AS (SELECT t, z, min(xray) AS lo, max(xray) AS hi FROM s GROUP BY ALL), p AS (SELECT s.t, s.z, y, x, label = 2 AS m, floor((xray - lo) / (hi - lo) * 255) AS grey FROM s JOIN e ON e.t = s.t AND e.z = s.z) SELECT t, z, y, x, {', '.join(f'(CASE WHEN m THEN floor(grey * 0.7 + {c} * 0.3 + 1e-9) ELSE grey END)::INTEGER AS {n}' for n, c in zip('rgb', (255, 0, 0)))} FROM p")
def overlay(spark, sf_dir):
    return boxes.overlay(series(spark, sf_dir), F.col("label") == 2, "xray")


_SC = f"{_S}, p AS (SELECT t, label AS truth, (neutron >= 2)::INTEGER + (neutron >= 8)::INTEGER AS prediction FROM s), d AS (SELECT t, k AS class_id, count(*) AS n, count(*) FILTER (truth = k) AS a, count(*) FILTER (prediction = k) AS b, count(*) FILTER (truth = k AND prediction = k) AS c FROM p, range(0, 3) r(k) GROUP BY ALL), v AS (SELECT t, class_id::INTEGER AS class_id, CASE WHEN a + b = 0 THEN 1 ELSE 2 * c / (a + b) END AS dice, (b - a) / n AS volume_error FROM d)"


def scored(spark, sf_dir):
    labels = series(spark, sf_dir).withColumn("prediction", (F.col("neutron") >= 2).cast("int") + (F.col("neutron") >= 8).cast("int"))
    return materials.scores(labels, "label", "prediction", [0, 1, 2])


@query("score_series", f"WITH {_SC} SELECT t, class_id, round(dice, 6) AS dice, round(volume_error, 6) AS volume_error FROM v")
def score_series(spark, sf_dir):
    return scored(spark, sf_dir)


@query("score_summary", f"WITH {_SC}, m AS (SELECT class_id, avg(dice) AS dice FROM v GROUP BY class_id) SELECT class_id, round(dice, 6) AS dice FROM m UNION ALL SELECT NULL, round(avg(dice), 6) FROM m")
def score_summary(spark, sf_dir):
    return materials.summary(scored(spark, sf_dir))


@query("volume_fractions", f"WITH {_S} SELECT t, label, round(count(*) / sum(count(*)) OVER (PARTITION BY t), 6) AS fraction FROM s GROUP BY t, label")
def volume_fractions(spark, sf_dir):
    sizes = series(spark, sf_dir).groupBy("t", "label").agg(F.count("*").alias("n"))
    total = sizes.groupBy("t").agg(F.sum("n").alias("total"))
    return sizes.join(total, "t").select("t", "label", (F.col("n") / F.col("total")).alias("fraction"))


_MATCHING = f"{_S}, w AS (SELECT (neutron >= 2)::INTEGER + (neutron >= 8)::INTEGER AS p, (label + 1) % 3 AS k, count(*) AS n FROM s GROUP BY ALL), f AS (SELECT p, k, coalesce(n, 0) AS n FROM range(0, 3) a(p) CROSS JOIN range(0, 3) b(k) LEFT JOIN w USING (p, k)), o AS (SELECT a.k AS k0, b.k AS k1, c.k AS k2, a.n + b.n + c.n AS total FROM f a, f b, f c WHERE a.p = 0 AND b.p = 1 AND c.p = 2 AND a.k <> b.k AND b.k <> c.k AND a.k <> c.k ORDER BY total DESC, k0, k1, k2 LIMIT 1)"


@query("cluster_matching", f"WITH {_MATCHING} SELECT f.p::INTEGER AS prediction, f.k::INTEGER AS truth, f.n FROM f, o WHERE (p = 0 AND k = k0) OR (p = 1 AND k = k1) OR (p = 2 AND k = k2)")
def cluster_matching(spark, sf_dir):
    labels = series(spark, sf_dir).select(((F.col("label") + 1) % 3).alias("truth"), ((F.col("neutron") >= 2).cast("int") + (F.col("neutron") >= 8).cast("int")).alias("prediction"))
    return materials.best_matching(materials.confusion(labels, "truth", "prediction"))


_LIB = f"{_V}, lib AS (SELECT {_CLASS} AS k, avg(neutron) AS mn, avg(xray) AS mx, var_samp(neutron) AS a, var_samp(xray) AS d, covar_samp(neutron, xray) AS o FROM f WHERE t = 0 AND {_CLASS} > 0 GROUP BY 1)"
_PAIRS = f"""WITH {_LIB}, l AS (SELECT *, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + o * o) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + o * o) AS l2 FROM lib),
p AS (SELECT u.k AS first, v.k AS second, u.l1, u.l2, u.a, u.o, u.d, u.mn - v.mn AS dn, u.mx - v.mx AS dx, (u.a + v.a) / 2 AS m, (u.d + v.d) / 2 AS w, (u.o + v.o) / 2 AS c, (u.a * u.d - u.o * u.o) * (v.a * v.d - v.o * v.o) AS dets FROM l u JOIN l v ON u.k <> v.k),
q AS (SELECT *, m * w - c * c AS det, sqrt(o * o + (l1 - a) * (l1 - a)) AS norm FROM p)
SELECT first, second, round(exp(-greatest(((w * dn * dn - 2 * c * dn * dx + m * dx * dx) / det) / 8 + ln(det / sqrt(dets)) / 2, 0)), 4) AS overlap, round(sqrt(l1 / l2), 4) AS elongation,
  round(degrees(acos(least(abs(o * dn + (l1 - a) * dx) / norm / sqrt(dn * dn + dx * dx), 1))), 4) AS angle FROM q"""


@query("class_pairs", _PAIRS, 4)
def class_pairs(spark, sf_dir):
    return materials.class_pairs(materials.class_library(paired_lineitem(spark, sf_dir).where("t = 0"), REGIONS))


_OK = "coalesce(isfinite(neutron) AND isfinite(xray) AND neutron <> 0 AND xray <> 0 AND neutron >= 3 AND xray >= 2000, FALSE)"
_BUDGET = _MATCH.replace("f AS (SELECT * FROM v WHERE isfinite(neutron) AND isfinite(xray))", f"f AS (SELECT * FROM v WHERE {_OK}), a AS (SELECT min(neutron) AS n0, max(neutron) AS n1, min(xray) AS x0, max(xray) AS x1 FROM v WHERE isfinite(neutron) AND isfinite(xray))").replace(
    _R, "r AS (SELECT * FROM a)"
) + f", bud AS (SELECT t, label::INTEGER AS label, sum(c)::BIGINT AS cells FROM best GROUP BY ALL UNION ALL SELECT t, -1, count(*) FROM v WHERE NOT {_OK} GROUP BY t)"


def budget(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    return materials.locked_budget(cells, REGIONS, grid, statistics.valid(floors=FLOORS))


@query("locked_validity", f"WITH {_BUDGET} SELECT t, label, cells FROM bud")
def locked_validity(spark, sf_dir):
    return budget(spark, sf_dir)


_REPORT = f"{_BUDGET}, rep AS (SELECT t, sum(cells)::BIGINT AS total, sum(cells) FILTER (label <> -1)::BIGINT AS valid, coalesce(sum(cells) FILTER (label = -1), 0)::BIGINT AS excluded, coalesce(sum(cells) FILTER (label = 0), 0)::BIGINT AS unclassified, count(*) FILTER (label > 0) AS classes FROM bud GROUP BY t)"


@query("locked_budget", f"WITH {_REPORT} SELECT t, total, valid, excluded, unclassified, round(unclassified / valid, 6) AS unclassified_share, classes FROM rep")
def locked_budget(spark, sf_dir):
    return materials.budget_report(budget(spark, sf_dir))


@query("locked_guards", f"WITH {_REPORT} SELECT t, 'unclassified' AS finding, round(unclassified / valid, 6) AS value FROM rep WHERE unclassified / valid > 0.0001")
def locked_guards(spark, sf_dir):
    return materials.guards(materials.budget_report(budget(spark, sf_dir)), most_unclassified=0.0001)


@query("middle_slice_series", f"WITH {_S} SELECT t, label, count(*) AS n, round(avg(neutron), 5) AS neutron_mean, round(stddev_pop(neutron), 5) AS neutron_std, round(avg(xray), 5) AS xray_mean, round(stddev_pop(xray), 5) AS xray_std, round(CASE WHEN avg(xray) > 0 THEN avg(neutron) / avg(xray) ELSE 0 END, 5) AS ratio FROM s WHERE z = 2 GROUP BY ALL", 5)
def middle_slice_series(spark, sf_dir):
    means = [f(c).alias(f"{c}_{n}") for c in ("neutron", "xray") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    out = series(spark, sf_dir).where("z = 2").groupBy("t", "label").agg(F.count("*").alias("n"), *means)
    return out.withColumn("ratio", F.when(F.col("xray_mean") > 0, F.col("neutron_mean") / F.col("xray_mean")).otherwise(0.0))


@query("series_wide", f"WITH {_S} SELECT t, " + ", ".join(f"count(*) FILTER (label = {k}) AS n_{k}, round(avg(xray) FILTER (label = {k}), 5) AS xray_{k}" for k in range(3)) + " FROM s GROUP BY t", 5)
def series_wide(spark, sf_dir):
    cells = series(spark, sf_dir)
    return cells.groupBy("t").agg(*[c for k in range(3) for c in (F.count_if(F.col("label") == k).alias(f"n_{k}"), F.avg(F.when(F.col("label") == k, F.col("xray"))).alias(f"xray_{k}"))])


@query("transient_labels", f"WITH {_V}, n AS (SELECT count(DISTINCT t) AS ts FROM f), k AS (SELECT floor(xray / 10000)::INTEGER AS band, t, count(*) AS c FROM f GROUP BY ALL), h AS (SELECT band, t FROM k JOIN (SELECT t, sum(c) AS total FROM k GROUP BY t) USING (t) WHERE c / total >= 0.001) SELECT band, list(t ORDER BY t) AS present, count(*) < any_value(ts) AS transient FROM h, n GROUP BY band")
def transient_labels(spark, sf_dir):
    """Bands of the second channel that hold at least a thousandth of a timepoint's cells: when, and whether at some timepoints only."""
    cells = paired_lineitem(spark, sf_dir).where("abs(neutron) < double('infinity') AND abs(xray) < double('infinity')")
    counts = cells.groupBy("t", F.floor(F.col("xray") / 10000).cast("int").alias("band")).agg(F.count("*").alias("c"))
    totals = counts.groupBy("t").agg(F.sum("c").alias("total"))  # a row for each t
    held = counts.join(totals, "t").where("c / total >= 0.001").groupBy("band").agg(F.array_sort(F.collect_list("t")).alias("present"))
    return held.crossJoin(totals.agg(F.count("*").alias("ts"))).select("band", "present", (F.size("present") < F.col("ts")).alias("transient"))


@query("volume_cv", f"WITH {_S}, n AS (SELECT t, label, count(*) AS n FROM s GROUP BY ALL) SELECT label, round(stddev_pop(n) / abs(avg(n)), 6) AS cv FROM n GROUP BY label")
def volume_cv(spark, sf_dir):
    sizes = series(spark, sf_dir).groupBy("t", "label").agg(F.count("*").alias("n"))
    return sizes.groupBy("label").agg((F.stddev_pop("n") / F.abs(F.avg("n"))).alias("cv"))


_SEASONS = "v AS (SELECT (year(l_shipdate) - 1995)::INTEGER AS t, CASE WHEN l_linenumber % 2 = 0 THEN -dayofyear(l_shipdate) ELSE (year(l_shipdate) - 1994) * 2000.0 + dayofyear(l_shipdate) END AS neutron, l_extendedprice AS xray FROM lineitem), f AS (SELECT * FROM v WHERE isfinite(neutron) AND isfinite(xray))"
_MIRROR = "k AS (SELECT o, exp(-0.5 * o * o) AS u FROM range(-4, 5) r(o)), kn AS (SELECT o, u / (SELECT sum(u) FROM k) AS w FROM k), km AS (SELECT j, CASE WHEN j + o < 0 THEN -1 - j - o WHEN j + o > 127 THEN 255 - j - o ELSE j + o END AS i, w FROM range(0, 128) a(j), kn)"
_GROW = ", ".join(f"g{n + 1} AS (SELECT DISTINCT iy + dy AS iy, ix + dx AS ix FROM g{n}, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE iy + dy BETWEEN 0 AND 127 AND ix + dx BETWEEN 0 AND 127 AND (iy + dy, ix + dx) NOT IN (SELECT (iy, ix) FROM shut))" for n in range(4))
_ISLANDS = f"""WITH RECURSIVE {_SEASONS}, {_R}, b AS (SELECT t, greatest(0, least(127, floor((xray - x0) / (x1 - x0) * 128)))::INTEGER AS iy, greatest(0, least(127, floor((neutron - n0) / (n1 - n0) * 128)))::INTEGER AS ix FROM f, r),
h AS (SELECT t, iy, ix, count(*) AS count FROM b GROUP BY t, iy, ix), {_MIRROR},
sy AS (SELECT h.t, km.j AS iy, h.ix, sum(h.count * w) AS v FROM h JOIN km ON km.i = h.iy GROUP BY h.t, km.j, h.ix), sx AS (SELECT sy.t, sy.iy, km.j AS ix, sum(sy.v * w) AS v FROM sy JOIN km ON km.i = sy.ix GROUP BY sy.t, sy.iy, km.j),
nt AS (SELECT count(DISTINCT t) AS ts FROM h), sh AS (SELECT iy, ix, count(*) / (SELECT ts FROM nt) AS share FROM sx WHERE v >= 0.5 GROUP BY iy, ix), shut AS (SELECT iy, ix FROM sh WHERE share >= 0.5), g0 AS (SELECT iy, ix FROM sh WHERE share < 0.5), {_GROW},
p AS (SELECT iy, ix, iy - row_number() OVER (PARTITION BY ix ORDER BY iy) AS run FROM g4), m AS MATERIALIZED (SELECT min(iy)::BIGINT * 128 + ix AS id, ix, min(iy) AS lo, max(iy) AS hi FROM p GROUP BY ix, run),
e AS MATERIALIZED (SELECT u.id AS a, w.id AS b FROM m u JOIN (SELECT * FROM m, (SELECT unnest([-1, 1]) AS dx)) w ON u.ix = w.ix + w.dx AND u.lo <= w.hi + 1 AND w.lo <= u.hi + 1), {_COMPONENTS},
c AS (SELECT comp, d.t, coalesce(sum(h.count), 0)::BIGINT AS n FROM lab JOIN m ON m.id = lab.id CROSS JOIN (SELECT DISTINCT t FROM h) d LEFT JOIN h ON h.t = d.t AND h.ix = m.ix AND h.iy BETWEEN m.lo AND m.hi GROUP BY comp, d.t),
q AS (SELECT comp, max(n) AS peak, min(n) AS least, median(n) AS typical FROM c GROUP BY comp), z AS (SELECT comp, row_number() OVER (ORDER BY peak DESC, comp) - 1 AS island FROM q WHERE peak >= 10 AND peak >= typical + 5 * sqrt(typical + 1) AND least <= 0.2 * peak)
SELECT z.island::INTEGER AS island, c.t, c.n AS cells FROM z JOIN c ON c.comp = z.comp"""


def seasons(spark, sf_dir):
    """Cells of a series whose first channel, for every other line, moves on by 2000 a year, so each year has its own place in the plane; and their histogram."""
    year, day = F.year("l_shipdate") - 1995, F.dayofyear("l_shipdate")
    moving = F.when(F.col("l_linenumber") % 2 == 0, -day.cast("double")).otherwise((year + 1) * 2000.0 + day)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(year.cast("int").alias("t"), moving.alias("neutron"), F.col("l_extendedprice").cast("double").alias("xray"))
    grid = histograms.plane_grid(rows, 128)
    return rows, grid, spatial._table(histograms.histogram(rows, grid))


@query("transient_islands", _ISLANDS)
def transient_islands(spark, sf_dir):
    _, grid, hist = seasons(spark, sf_dir)
    return islands.island_counts(hist, *islands.transient_islands(hist, grid.bins))


@query("kmeans_islands")
def kmeans_islands(spark, sf_dir):
    """Cells of each cluster, islands included, from the label of every cell."""
    rows, grid, hist = seasons(spark, sf_dir)
    return clusters.label_cells(rows, clusters.series_plane(hist, grid, 2)).groupBy("t", "cluster").agg(F.count("*").alias("cells"))


@query("hist_correlation", f"WITH {_P} SELECT t, round((sum(p * q) - sum(p) * sum(q) / 4096) / sqrt((sum(p * p) - sum(p) * sum(p) / 4096) * (sum(q * q) - sum(q) * sum(q) / 4096)), 6) AS pearson FROM q GROUP BY t")
def hist_correlation(spark, sf_dir):
    return histograms.correlation(lineitem_hist(spark, sf_dir)[0], BINS)


_ENDS = f"{_V}, r AS (SELECT quantile_cont(neutron, 0.0005) AS n0, quantile_cont(neutron, 0.9995) AS n1, quantile_cont(xray, 0.0005) AS x0, quantile_cont(xray, 0.9995) AS x1 FROM f)"


@query("hist_robust", f"WITH {_ENDS} SELECT t, greatest(0, least(63, floor((xray - x0) / (x1 - x0) * 64)))::INTEGER AS iy, greatest(0, least(63, floor((neutron - n0) / (n1 - n0) * 64)))::INTEGER AS ix, count(*) AS count FROM f, r WHERE neutron BETWEEN n0 AND n1 AND xray BETWEEN x0 AND x1 GROUP BY ALL")
def hist_robust(spark, sf_dir):
    cells = paired_lineitem(spark, sf_dir)
    return histograms.histogram(cells, histograms.robust_grid(cells, BINS), outside="drop")
