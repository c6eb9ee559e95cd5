"""Registered queries of alignment, hulls and mixed cells, with SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from duovox.functions.plane import class_of
from duovox.jobs.adaptive import _FIT, ROUNDS, fit
from duovox.jobs.registry import _CLASS, _H, _V, REGIONS, lineitem_hist, query
from duovox.jobs.smooth import QUERIES, SQL  # noqa: F401
from duovox.jobs.volumes import _S
from duovox.operators import alignment, factors, hulls, mixels, mixtures, validation
from duovox.operators.spatial import _table, block_ids
from duovox.sources.paired import grid_series, paired_lineitem, with_labels

_BINNED = f"{_S}, en AS (SELECT t, min(neutron) AS n0, max(neutron) AS n1, min(xray) AS x0, max(xray) AS x1 FROM s GROUP BY t), q AS (SELECT s.t, z, y, x, least(floor((neutron - n0) / (n1 - n0) * 8), 7)::INTEGER AS a, least(floor((xray - x0) / (x1 - x0) * 8), 7)::INTEGER AS b FROM s JOIN en ON en.t = s.t)"


@query("shift_information", f"""WITH {_BINNED}, j AS (SELECT p.t, d.s, p.a, o.b, count(*) AS n FROM q p, (SELECT unnest(range(-3, 4)) AS s) d, q o WHERE o.t = p.t AND o.z = p.z AND o.y = p.y - d.s AND o.x = p.x AND p.z BETWEEN 1 AND 3 AND p.y BETWEEN 5 AND 14 AND p.x BETWEEN 5 AND 14 GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY t, s) AS total, sum(n) OVER (PARTITION BY t, s, a) AS ra, sum(n) OVER (PARTITION BY t, s, b) AS cb FROM j) SELECT t, s::INTEGER AS shift, round(sum(n / total * ln(n * total / (ra * cb))), 6) AS information FROM k GROUP BY t, s""")
def shift_information(spark, sf_dir):
    """What both channels tell of each other at shifts along y, in one pass."""
    return alignment.shift_information(_table(alignment.prepared(grid_series(spark, sf_dir), 8, 0.0)), 1, 3, (1, 5, 5))


@query("alignment")
def aligned(spark, sf_dir):
    return alignment.alignment(grid_series(spark, sf_dir), most=3, bins=16)


def _hull(rows: str, by: str) -> str:
    """SQL of the corners (u, v) of hulls of rows (by, u, v): points that no other pair of points has on a line or inside; by way of edges: a pair of points with all
    others on its left, or beyond neither end of it."""
    keys = by.split(", ")
    same = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys)
    cross = "(q.u - p.u) * (o.v - p.v) - (q.v - p.v) * (o.u - p.u)"
    return f"""pt AS MATERIALIZED (SELECT DISTINCT {by}, u, v FROM {rows}), lo AS MATERIALIZED (SELECT {by}, u, min(v) AS v FROM pt GROUP BY ALL UNION SELECT {by}, u, max(v) FROM pt GROUP BY ALL),
eg AS MATERIALIZED (SELECT {', '.join('p.' + k for k in keys)}, p.u AS pu, p.v AS pv, q.u AS qu, q.v AS qv FROM lo p JOIN lo q ON {same.format('p', 'q')} AND (p.u <> q.u OR p.v <> q.v) WHERE NOT EXISTS (SELECT 1 FROM lo o WHERE {same.format('o', 'p')} AND ({cross} < 0 OR ({cross} = 0 AND ((o.u - p.u) * (o.u - q.u) + (o.v - p.v) * (o.v - q.v) > 0)))))"""


_SLICES = f"WITH {_S}, pz AS (SELECT t, z, y::DOUBLE AS u, x::DOUBLE AS v FROM s WHERE xray >= 90), {_hull('pz', 't, z')}"


@query("slice_hulls", f"""{_SLICES}, ar AS (SELECT t, z, count(*) AS area FROM pz GROUP BY ALL), m AS (SELECT t, z, count(*) AS corners, sum(pu * qv - qu * pv) / 2 AS hull, sum(sqrt(power(qu - pu, 2) + power(qv - pv, 2))) AS length FROM eg GROUP BY ALL)
SELECT ar.t, ar.z, area, corners, round(CASE WHEN hull > 0 THEN hull ELSE area END, 5) AS convex_area, round(CASE WHEN hull > 0 THEN area / hull ELSE 1 END, 5) AS solidity, round(length, 5) AS convex_length FROM ar JOIN m ON m.t = ar.t AND m.z = ar.z""", 5)
def slice_hulls(spark, sf_dir):
    return hulls.slice_hulls(grid_series(spark, sf_dir), F.col("xray") >= 90)


_OUTLINE = f"WITH {_V}, pc AS (SELECT {_CLASS} AS k, neutron AS u, xray AS v FROM f WHERE {_CLASS} > 0), {_hull('pc', 'k')}, co AS (SELECT DISTINCT k, pu, pv FROM eg)"


@query("class_outlines", f"{_OUTLINE} SELECT k AS class_id, round(avg(pu) OVER w + (pu - avg(pu) OVER w) * 1.05, 4) AS u, round(avg(pv) OVER w + (pv - avg(pv) OVER w) * 1.05, 4) AS v FROM co WINDOW w AS (PARTITION BY k)", 4)
def class_outlines(spark, sf_dir):
    """A polygon around the pairs of each class."""
    rows = paired_lineitem(spark, sf_dir).withColumn("class_id", class_of(REGIONS)).where("class_id > 0")
    return hulls.outline(rows, ["class_id"]).select("class_id", "u", "v")


_LAST = f"p{ROUNDS}"
_LADDER = f"""al AS (SELECT (i + 0.5) / 10 AS s FROM range(0, 10) r(i)), pr AS (SELECT f.t, f.mn AS fn, f.mx AS fx, f.a AS fa, f.d AS fd, f.o AS fo, g.mn AS gn, g.mx AS gx, g.a AS ga, g.d AS gd, g.o AS go, 0.25 * least((f.a + f.d) / 2, (g.a + g.d) / 2) AS noise FROM {_LAST} f JOIN {_LAST} g ON g.t = f.t AND f.k = 3 AND g.k = 1),
la AS (SELECT t, s, s * fn + (1 - s) * gn AS n, s * fx + (1 - s) * gx AS x, s * s * fa + (1 - s) * (1 - s) * ga + noise AS va, s * s * fd + (1 - s) * (1 - s) * gd + noise AS vd, s * s * fo + (1 - s) * (1 - s) * go AS vo FROM pr, al),
dn AS (SELECT bm.t, iy, ix, c, s, -0.5 * (2 * ln(2 * pi()) + ln(va * vd - vo * vo) + (vd * (sn / c - n) * (sn / c - n) - 2 * vo * (sn / c - n) * (sx / c - x) + va * (sx / c - x) * (sx / c - x)) / (va * vd - vo * vo)) AS l FROM bm JOIN la ON la.t = bm.t),
tp AS (SELECT *, max(l) OVER (PARTITION BY t, iy, ix) AS top FROM dn), fr AS (SELECT t, iy, ix, any_value(c) AS c, sum(exp(l - top) * s) / sum(exp(l - top)) AS fraction, any_value(top) + ln(sum(exp(l - top))) - ln(10) AS ld FROM tp GROUP BY t, iy, ix)"""
MIXELS = [mixels.Mixel(2, 3, 1)]


@query("mixel_fractions", f"WITH {_FIT}, {_LADDER} SELECT t, 2 AS class_id, round(sum(c * fraction) / sum(c), 5) AS fraction, round(sum(c * ld) / sum(c), 5) AS log_density, sum(c) FILTER (fraction >= 0.5)::BIGINT AS more_first FROM fr GROUP BY t", 5)
def mixel_fractions(spark, sf_dir):
    """The middle class as a mixture of the two others: mean fraction of cells, by the fraction of each bin."""
    bins, model, parameters = fit(spark, sf_dir)
    rows = mixels.fractions(bins, parameters, model, MIXELS)
    mean = lambda c: (F.sum(F.col("c") * F.col(c)) / F.sum("c")).alias(c)
    return rows.groupBy("t", "class_id").agg(mean("fraction"), mean("log_density"), F.sum(F.when(F.col("fraction") >= 0.5, F.col("c"))).alias("more_first"))


_ANGLES = f"""ax AS (SELECT t, k, mn, mx, (a + d) / 2 + sqrt((a - d) * (a - d) / 4 + o * o) AS l1, (a + d) / 2 - sqrt((a - d) * (a - d) / 4 + o * o) AS l2, a, o FROM {_LAST}),
an AS (SELECT c.t, c.k AS class_id, f.k AS first, g.k AS second, sqrt(c.l1 / c.l2) AS elongation, degrees(acos(least(abs(c.o * (f.mn - g.mn) + (c.l1 - c.a) * (f.mx - g.mx)) / sqrt(c.o * c.o + (c.l1 - c.a) * (c.l1 - c.a)) / sqrt(power(f.mn - g.mn, 2) + power(f.mx - g.mx, 2)), 1))) AS angle,
  ((c.mn - g.mn) * (f.mn - g.mn) + (c.mx - g.mx) * (f.mx - g.mx)) / (power(f.mn - g.mn, 2) + power(f.mx - g.mx, 2)) AS position FROM ax c JOIN ax f ON f.t = c.t JOIN ax g ON g.t = c.t WHERE f.k < g.k AND c.k <> f.k AND c.k <> g.k)"""


@query("mixing_lines", f"WITH {_FIT}, {_ANGLES} SELECT t, class_id, first, second, round(elongation, 3) AS elongation, round(angle, 3) AS angle, round(position, 3) AS position FROM an WHERE elongation >= 1.5 AND angle <= 15 AND position BETWEEN 0 AND 1", 3)
def mixing_lines(spark, sf_dir):
    _, model, parameters = fit(spark, sf_dir)
    return mixels.mixing_lines(mixels.line_angles(mixtures.class_rows(parameters, model)))


@query("mixel_checks", f"WITH {_FIT}, {_ANGLES} SELECT t, class_id, first, second, round(elongation, 3) AS elongation, round(angle, 3) AS angle, angle <= 0.001 AS accepted, CASE WHEN angle <= 0.001 THEN 'aligned' ELSE 'off the line' END AS reason FROM an WHERE class_id = 2", 3)
def mixel_checks(spark, sf_dir):
    _, model, parameters = fit(spark, sf_dir)
    return mixels.verified(mixels.line_angles(mixtures.class_rows(parameters, model)), MIXELS, tolerance=0.001)


_RANK, _UPDATES = 3, 4


def _update(r: int) -> str:
    return f"""g{r} AS (SELECT a.k, b.k AS j, sum(a.v * b.v) AS v FROM w{r} a JOIN w{r} b ON b.t = a.t GROUP BY ALL), n{r} AS (SELECT x.b, w.k, sum(x.v * w.v) AS v FROM x JOIN w{r} w ON w.t = x.t GROUP BY ALL), d{r} AS (SELECT h.b, g.k, sum(g.v * h.v) AS v FROM h{r} h JOIN g{r} g ON g.j = h.k GROUP BY ALL),
h{r + 1} AS MATERIALIZED (SELECT h.b, h.k, h.v * n.v / (d.v + 1e-12) AS v FROM h{r} h JOIN n{r} n ON n.b = h.b AND n.k = h.k JOIN d{r} d ON d.b = h.b AND d.k = h.k), c{r} AS (SELECT x.t, h.k, sum(x.v * h.v) AS v FROM x JOIN h{r + 1} h ON h.b = x.b GROUP BY ALL), o{r} AS (SELECT a.k, b.k AS j, sum(a.v * b.v) AS v FROM h{r + 1} a JOIN h{r + 1} b ON b.b = a.b GROUP BY ALL),
e{r} AS (SELECT w.t, o.k, sum(w.v * o.v) AS v FROM w{r} w JOIN o{r} o ON o.j = w.k GROUP BY ALL), w{r + 1} AS MATERIALIZED (SELECT w.t, w.k, w.v * c.v / (e.v + 1e-12) AS v FROM w{r} w JOIN c{r} c ON c.t = w.t AND c.k = w.k JOIN e{r} e ON e.t = w.t AND e.k = w.k)"""


_FACTORS = f"""WITH {_H}, x AS MATERIALIZED (SELECT t, iy * 64 + ix AS b, count / sum(count) OVER (PARTITION BY t) AS v FROM h), tk AS (SELECT t, least((row_number() OVER (ORDER BY t) - 1) * {_RANK} // count(*) OVER (), {_RANK - 1}) AS part FROM (SELECT DISTINCT t FROM h)), ks AS (SELECT unnest(range(0, {_RANK})) AS k),
w0 AS MATERIALIZED (SELECT t, k, CASE WHEN k = part THEN 1 ELSE 0.1 END::DOUBLE AS v FROM tk, ks), h0 AS MATERIALIZED (SELECT b.b, k, coalesce((SELECT sum(x.v) FROM x JOIN tk ON tk.t = x.t WHERE x.b = b.b AND tk.part = k), 0) / (SELECT count(*) FROM tk WHERE part = k) + 1e-12 AS v FROM (SELECT DISTINCT b FROM x) b, ks), {', '.join(map(_update, range(_UPDATES)))}"""


def _factors(spark, sf_dir):
    return factors.histogram_factors(lineitem_hist(spark, sf_dir)[0], _RANK, _UPDATES)


@query("factor_weights", f"{_FACTORS} SELECT t, k::INTEGER AS component, round(v, 5) AS weight FROM w{_UPDATES}", 5)
def factor_weights(spark, sf_dir):
    """How much of each of three non-negative components every year's histogram holds."""
    return _factors(spark, sf_dir).weight_rows()


@query("factor_components", f"{_FACTORS} SELECT (b // 64)::INTEGER AS iy, (b % 64)::INTEGER AS ix, k::INTEGER AS component, round(v * 1000, 5) AS value FROM h{_UPDATES}", 5)
def factor_components(spark, sf_dir):
    """The components, in thousandths."""
    return _factors(spark, sf_dir).component_rows().withColumn("value", F.col("value") * 1000)


_BLOCKED = f"{_S}, vb AS MATERIALIZED (SELECT s.t, s.z, y, x, (least(s.z * 2 // 5, 1) * 2 + least(y * 2 // 20, 1)) * 2 + least(x * 2 // 20, 1) AS block, neutron, xray + 40 * (neutron >= 3)::INTEGER AS xray, label FROM s)"
_FOLDS = f"""{_BLOCKED}, ow AS (SELECT block, label, count(*) AS c, sum(neutron) AS sn, sum(xray) AS sx, sum(neutron * neutron) AS snn, sum(xray * xray) AS sxx, sum(neutron * xray) AS snx FROM vb GROUP BY ALL),
rs AS (SELECT b.block, o.label, sum(c) AS c, sum(sn) AS sn, sum(sx) AS sx, sum(snn) AS snn, sum(sxx) AS sxx, sum(snx) AS snx FROM (SELECT DISTINCT block FROM ow) b JOIN ow o ON o.block <> b.block GROUP BY ALL),
fm AS MATERIALIZED (SELECT block, label, c / sum(c) OVER (PARTITION BY block) AS w, sn / c AS n, sx / c AS x, (snn - sn * sn / c) / (c - 1) AS a, (sxx - sx * sx / c) / (c - 1) AS d, (snx - sn * sx / c) / (c - 1) AS o FROM rs)"""


def _judge(cells: str) -> str:
    return f"(SELECT v.t, v.z, v.y, v.x, v.block, any_value(v.label) AS truth, arg_max(m.label, ln(w) - 0.5 * (2 * ln(2 * pi()) + ln(a * d - o * o) + (d * (v.neutron - n) * (v.neutron - n) - 2 * o * (v.neutron - n) * (v.xray - m.x) + a * (v.xray - m.x) * (v.xray - m.x)) / (a * d - o * o))) AS prediction FROM {cells} v JOIN fm m ON m.block = v.block GROUP BY v.t, v.z, v.y, v.x, v.block)"


def _blocks(spark, sf_dir):
    cells = with_labels(grid_series(spark, sf_dir))
    return block_ids(cells.withColumn("xray", F.col("xray") + 40 * (F.col("neutron") >= 3).cast("int")), (5, 20, 20), (2, 2, 2))


_KAPPA = "SELECT {0} count(*) AS cells, avg((truth = prediction)::INTEGER) AS accuracy, (SELECT sum(r * c) FROM (SELECT l, (SELECT count(*) FROM {1} q WHERE q.truth = l {2}) AS r, (SELECT count(*) FROM {1} q WHERE q.prediction = l {2}) AS c FROM range(0, 3) z(l))) / (count(*) * count(*)) AS chance FROM {1} p {3}"


@query("block_validation", f"WITH {_FOLDS}, jd AS MATERIALIZED {_judge('vb')}, k AS ({_KAPPA.format('p.block,', 'jd', 'AND q.block = p.block', 'GROUP BY p.block')} UNION ALL {_KAPPA.format('NULL,', 'jd', '', '')}) SELECT block::INTEGER AS block, cells, round(accuracy, 6) AS accuracy, round((accuracy - chance) / (1 - chance), 6) AS kappa FROM k")
def block_validation(spark, sf_dir):
    """Labels judged by classes that were fitted without the cell's block."""
    return validation.block_validation(_blocks(spark, sf_dir))


_DEAL = "(SELECT a.t, a.z, a.y, a.x, a.block, a.label, {0} FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY t, z, y, x) AS k FROM vb) a JOIN (SELECT *, row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws(',', t, z, y, x)), t, z, y, x) AS k FROM vb) b ON b.block = a.block AND b.k = a.k)"
_RIGHT = "SELECT '{0}' AS feature, avg((truth = prediction)::INTEGER) AS accuracy FROM {1}"


@query("permutation_importance", f"WITH {_FOLDS}, dn AS MATERIALIZED {_DEAL.format('b.neutron, a.xray')}, dx AS MATERIALIZED {_DEAL.format('a.neutron, b.xray')}, im AS ({_RIGHT.format('none', _judge('vb'))} UNION ALL {_RIGHT.format('neutron', _judge('dn'))} UNION ALL {_RIGHT.format('xray', _judge('dx'))}) SELECT feature, round(accuracy, 6) AS accuracy, round((SELECT accuracy FROM im WHERE feature = 'none') - accuracy, 6) AS drop FROM im")
def permutation_importance(spark, sf_dir):
    """What the folds lose when a channel's values are dealt anew within blocks, by hashed places."""
    return validation.importance(_blocks(spark, sf_dir), F.md5(F.concat_ws(",", "t", "z", "y", "x")))
