"""Registered queries of the adaptive mode: mixtures, drift and series that carry state, with SQL of the same rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from duovox.jobs.registry import _B, _CLASS, _R, _V, REGIONS, lineitem_grid, query
from duovox.jobs.volumes import QUERIES, SQL  # noqa: F401
from duovox.operators import materials, mixtures
from duovox.operators.histograms import moments
from duovox.operators.spatial import _table
from duovox.streaming import following

ROUNDS = 4

_BINS = f"""{_V}, {_R}, {_B},
bm AS MATERIALIZED (SELECT t, iy, ix, count(*) AS c, sum(neutron) AS sn, sum(xray) AS sx, sum(neutron * neutron) AS snn, sum(xray * xray) AS sxx, sum(neutron * xray) AS snx FROM b GROUP BY t, iy, ix),
lib AS (SELECT {_CLASS} AS k, avg(neutron) AS mn, avg(xray) AS mx, var_samp(neutron) AS a, var_samp(xray) AS d, covar_samp(neutron, xray) AS o, count(*) AS n FROM f WHERE t = 0 AND {_CLASS} > 0 GROUP BY 1),
anc AS MATERIALIZED (SELECT k, mn, mx, a + greatest(1e-6 * (a + d) / 2, 1e-6) * 1e-3 AS a, d + greatest(1e-6 * (a + d) / 2, 1e-6) * 1e-3 AS d, o, n AS kappa, n / sum(n) OVER () AS w FROM lib)"""


def _expect(name: str, parameters: str, where: str = "TRUE") -> str:
    """SQL of responsibilities: a row for each bin and class, 0 for the outlier class."""
    return f"""{name}j AS (SELECT bm.*, k, w, -0.5 * (2 * ln(2 * pi()) + ln(a * d - o * o) + (d * (sn / c - mn) * (sn / c - mn) - 2 * o * (sn / c - mn) * (sx / c - mx) + a * (sx / c - mx) * (sx / c - mx)) / (a * d - o * o)
    + greatest((d * (snn - sn * sn / c) - 2 * o * (snx - sn * sx / c) + a * (sxx - sx * sx / c)) / (a * d - o * o) / c, 0)) + ln(w) AS j FROM bm JOIN {parameters} p ON p.t = bm.t WHERE {where}
  UNION ALL SELECT bm.*, 0, wu, ln(wu) - ln((n1 - n0) * (x1 - x0)) FROM bm JOIN (SELECT DISTINCT t, wu FROM {parameters}) u ON u.t = bm.t, r WHERE {where}),
{name}t AS (SELECT *, max(j) OVER (PARTITION BY t, iy, ix) AS top FROM {name}j),
{name} AS MATERIALIZED (SELECT *, exp(j - top) / sum(exp(j - top)) OVER g AS r, top + ln(sum(exp(j - top)) OVER g) AS log_all FROM {name}t WINDOW g AS (PARTITION BY t, iy, ix))"""


def _maximise(name: str, rows: str, anchors: str = "anc", keyed: str = "") -> str:
    """SQL of the next parameters; anchors by k, or by t and k."""
    return f"""{name}s AS (SELECT t, k, sum(r * c) AS n, sum(r * sn) AS sn, sum(r * sx) AS sx, sum(r * snn) AS snn, sum(r * sxx) AS sxx, sum(r * snx) AS snx FROM {rows} GROUP BY t, k),
{name}a AS (SELECT t, sum(n) AS total, greatest(sum(n) FILTER (k = 0) / sum(n), 1e-8) AS wu FROM {name}s GROUP BY t),
{name}m AS (SELECT s.t, s.k, greatest(s.n / total, 1e-12) AS raw, wu, (kappa * mn + sn) / (kappa + n) AS un, (kappa * mx + sx) / (kappa + n) AS ux, sn / n - mn AS dn, sx / n - mx AS dx, kappa * n / (kappa + n) AS pull, kappa + n + 3 AS size,
    (kappa + 3) * a + snn - sn * sn / n AS pa, (kappa + 3) * d + sxx - sx * sx / n AS pd, (kappa + 3) * o + snx - sn * sx / n AS po FROM {name}s s JOIN {anchors} anc ON anc.k = s.k {keyed} JOIN {name}a g ON g.t = s.t),
{name}v AS (SELECT *, (pa + pull * dn * dn) / size AS va, (pd + pull * dx * dx) / size AS vd, (po + pull * dn * dx) / size AS vo FROM {name}m),
{name} AS MATERIALIZED (SELECT t, k, un AS mn, ux AS mx, va + greatest(1e-6 * (va + vd) / 2, 1e-6) * 1e-3 AS a, vd + greatest(1e-6 * (va + vd) / 2, 1e-6) * 1e-3 AS d, vo AS o, raw * (1 - wu) / sum(raw) OVER (PARTITION BY t) AS w, wu FROM {name}v)"""


_FIT = f"{_BINS}, p0 AS MATERIALIZED (SELECT t, k, mn, mx, a, d, o, w * 0.999 AS w, 0.001 AS wu FROM anc, (SELECT DISTINCT t FROM bm)), " + ", ".join(
    f"{_expect(f'q{r}', f'p{r}')}, {_maximise(f'p{r + 1}', f'q{r}')}" for r in range(ROUNDS)
)
_FITTED = f"{_FIT}, {_expect('q', f'p{ROUNDS}')}"


def fit(spark, sf_dir):
    """Bins of lineitem, the model of the regions at t = 0, and the parameters of each t."""
    cells, grid = lineitem_grid(spark, sf_dir)
    library = materials.materials(materials.class_library(cells.where("t = 0"), REGIONS), REGIONS)
    model = mixtures.Anchored(library, grid.area)
    bins = _table(moments(cells, grid))
    return bins, model, mixtures.fitted(bins, model, ROUNDS)


@query("mixture_classes", f"""WITH {_FIT} SELECT p.t, p.k AS class_id, round(p.w, 4) AS weight, round(p.mn, 4) AS neutron, round(p.mx, 4) AS xray, round(sqrt(p.a), 4) AS sigma_n, round(sqrt(p.d), 4) AS sigma_x, round(p.o, 4) AS cov, round(sqrt(power((p.mn - anc.mn) / sqrt(anc.a), 2) + power((p.mx - anc.mx) / sqrt(anc.d), 2)), 4) AS moved
FROM p{ROUNDS} p JOIN anc USING (k) UNION ALL SELECT DISTINCT t, 0, round(wu, 4), NULL, NULL, NULL, NULL, NULL, NULL FROM p{ROUNDS}""", 4)
def mixture_classes(spark, sf_dir):
    _, model, parameters = fit(spark, sf_dir)
    return mixtures.class_rows(parameters, model)


@query("mixture_scores", f"""WITH {_FITTED}, e AS (SELECT t, sum(c * r) AS cells, sum(c * r * log_all) AS ll, sum(-c * r * ln(greatest(r, 1e-300))) AS h FROM q GROUP BY t)
SELECT t, round(cells)::BIGINT AS cells, round(ll, 3) AS log_likelihood, round(-2 * ll + 18 * ln(cells), 3) AS bic, round(h, 3) AS entropy, round(-2 * ll + 18 * ln(cells) + 2 * h, 3) AS icl FROM e""", 3)
def mixture_scores(spark, sf_dir):
    bins, model, parameters = fit(spark, sf_dir)
    return mixtures.fit_scores(mixtures.responsibilities(bins, parameters, model), model)


@query("mixture_labels", f"WITH {_FITTED}, l AS (SELECT t, iy, ix, any_value(c) AS c, arg_max(k, r) AS label FROM q GROUP BY t, iy, ix) SELECT t, label, sum(c)::BIGINT AS cells, count(*) AS bins FROM l GROUP BY ALL")
def mixture_labels(spark, sf_dir):
    bins, model, parameters = fit(spark, sf_dir)
    labels = mixtures.bin_labels(mixtures.responsibilities(bins, parameters, model), model)
    return labels.groupBy("t", "label").agg(F.sum("c").alias("cells"), F.count("*").alias("bins"))


STEPS = 4


def _mean_shift(r: int) -> str:
    return f"""f{r} AS (SELECT b.t, s.k, c, b.mn, b.mx, wn, wx, s.n, s.x, -0.5 * (power((b.mn - s.n) / wn, 2) + power((b.mx - s.x) / wx, 2)) AS f FROM me b JOIN s{r} s ON s.t = b.t),
u{r} AS (SELECT t, k, sum(w * mn) / sum(w) AS un, sum(w * mx) / sum(w) AS ux FROM (SELECT *, c * exp(f - max(f) OVER (PARTITION BY t, k)) AS w FROM f{r}) GROUP BY t, k),
s{r + 1} AS MATERIALIZED (SELECT s.t, s.k, wn, wx, CASE WHEN done THEN n ELSE un END AS n, CASE WHEN done THEN x ELSE ux END AS x, done OR greatest(abs(un - n) / wn, abs(ux - x) / wx) < 1e-4 AS done FROM s{r} s JOIN u{r} u ON u.t = s.t AND u.k = s.k)"""


_MODES = f"{_BINS}, me AS (SELECT t, c, sn / c AS mn, sx / c AS mx FROM bm), s0 AS (SELECT t, k, 1.5 * sqrt(a) AS wn, 1.5 * sqrt(d) AS wx, mn AS n, mx AS x, FALSE AS done FROM lib, (SELECT DISTINCT t FROM bm)), " + ", ".join(map(_mean_shift, range(STEPS)))
#: The most that an anchor of these tables may move, in its deviations: some do, so that both outcomes occur.
MOST = 0.05
_DRIFT = f"""{_MODES}, m AS (SELECT s.t, s.k, s.n AS yn, s.x AS yx, mn, mx, sqrt(a) AS sa, sqrt(d) AS sd, lib.n AS c, abs(s.n - mn) <= {MOST} * sqrt(a) AND abs(s.x - mx) <= {MOST} * sqrt(d) AS ok FROM s{STEPS} s JOIN lib USING (k)),
us AS (SELECT m.*, ok AND NOT EXISTS (SELECT 1 FROM m o WHERE o.t = m.t AND o.k <> m.k AND o.ok AND abs(o.yn - m.yn) < greatest(o.sa, m.sa) AND abs(o.yx - m.yx) < greatest(o.sd, m.sd)) AS used FROM m),
g AS (SELECT t, count(*) FILTER (used) AS k, sum(c) FILTER (used) AS w, list(CASE k WHEN 1 THEN 'low' WHEN 2 THEN 'middle' ELSE 'high' END ORDER BY k) FILTER (NOT used) AS rejected,
  sum(c * mn) FILTER (used) / sum(c) FILTER (used) AS an, sum(c * mx) FILTER (used) / sum(c) FILTER (used) AS ax, sum(c * yn) FILTER (used) / sum(c) FILTER (used) AS bn, sum(c * yx) FILTER (used) / sum(c) FILTER (used) AS bx FROM us GROUP BY t),
h AS (SELECT us.t, any_value(g.k) AS k, any_value(rejected) AS rejected, any_value(an) AS an, any_value(ax) AS ax, any_value(bn) AS bn, any_value(bx) AS bx, sum(c * (mn - an) * (mn - an)) FILTER (used) AS vn, sum(c * (mx - ax) * (mx - ax)) FILTER (used) AS vx,
  sum(c * (mn - an) * (yn - bn)) FILTER (used) AS cn, sum(c * (mx - ax) * (yx - bx)) FILTER (used) AS cx FROM us JOIN g ON g.t = us.t GROUP BY us.t),
sc AS (SELECT *, CASE WHEN k >= 2 AND vn > 0 THEN cn / vn ELSE 1 END AS gn, CASE WHEN k >= 2 AND vx > 0 THEN cx / vx ELSE 1 END AS gx FROM h),
sh AS (SELECT *, coalesce(bn - gn * an, 0) AS dn, coalesce(bx - gx * ax, 0) AS dx FROM sc)"""


def anchors_found(spark, sf_dir):
    cells, grid = lineitem_grid(spark, sf_dir)
    inert = materials.materials(materials.class_library(cells.where("t = 0"), REGIONS), REGIONS)
    return _table(mixtures.modes(_table(moments(cells, grid)), inert, STEPS)), inert


@query("drift_series", f"""WITH {_DRIFT} SELECT sh.t, round(dn, 4) AS shift_n, round(dx, 4) AS shift_x, round(sqrt(dn * dn + dx * dx), 4) AS magnitude, round(gn, 4) AS scale_n, round(gx, 4) AS scale_x,
round((SELECT avg(sqrt(power(yn - gn * mn - dn, 2) + power(yx - gx * mx - dx, 2))) FROM us WHERE us.t = sh.t AND used), 4) AS residual, coalesce(rejected, []) AS rejected FROM sh""", 4)
def drift_series(spark, sf_dir):
    found, inert = anchors_found(spark, sf_dir)
    return mixtures.drift(found, inert, scaled=True, most=MOST)


@query("process_noise", f"WITH {_DRIFT}, e AS (SELECT yn - mn - dn AS n, yx - mx - dx AS x FROM us JOIN sh ON sh.t = us.t WHERE used) SELECT round(greatest(var_pop(n), 1e-6), 4) AS var_n, round(greatest(var_pop(x), 1e-6), 4) AS var_x FROM e", 4)
def process_noise(spark, sf_dir):
    found, inert = anchors_found(spark, sf_dir)
    return mixtures.process_noise(found, mixtures.drift(found, inert, scaled=True, most=MOST), inert)


_TIMES, _EACH = 7, 3


def _follow(t: int) -> str:
    """SQL of timepoint t: half of its prior from the anchors, half from the fit before."""
    rounds = ", ".join(f"{_expect(f'q{t}_{r}', f'p{t}_{r}', f'bm.t = {t}')}, {_maximise(f'p{t}_{r + 1}', f'q{t}_{r}', f'anc{t}')}" for r in range(_EACH))
    if not t:
        return f"anc0 AS (SELECT * FROM anc), p0_0 AS (SELECT 0 AS t, k, mn, mx, a, d, o, w * 0.999 AS w, 0.001 AS wu FROM anc), {rounds}"
    last = f"p{t - 1}_{_EACH}"
    return f"""anc{t} AS MATERIALIZED (SELECT k, (anc.mn + p.mn) / 2 AS mn, (anc.mx + p.mx) / 2 AS mx, (anc.a + p.a) / 2 AS a, (anc.d + p.d) / 2 AS d, (anc.o + p.o) / 2 AS o, kappa, p.w FROM anc JOIN {last} p USING (k)),
p{t}_0 AS MATERIALIZED (SELECT {t} AS t, k, mn, mx, a, d, o, w * 0.999 / sum(w) OVER () AS w, 0.001 AS wu FROM {last}), {rounds}"""


_CHAIN = ", ".join(map(_follow, range(_TIMES)))
_SEQUENCE = f"""WITH {_BINS}, {_CHAIN}, {', '.join(_expect(f'z{t}', f'p{t}_{_EACH}', f'bm.t = {t}') for t in range(_TIMES))},
lb AS (SELECT t, label, sum(c)::BIGINT AS cells FROM (SELECT t, iy, ix, any_value(c) AS c, arg_max(k, r) AS label FROM ({' UNION ALL '.join(f'SELECT t, iy, ix, c, k, r FROM z{t}' for t in range(_TIMES))}) GROUP BY t, iy, ix) GROUP BY ALL),
ps AS ({' UNION ALL '.join(f'SELECT t, k, mn, mx, a, d, w FROM p{t}_{_EACH} UNION ALL SELECT DISTINCT t, 0, NULL, NULL, NULL, NULL, wu FROM p{t}_{_EACH}' for t in range(_TIMES))})
SELECT ps.t, ps.k AS class_id, round(mn, 4) AS neutron, round(mx, 4) AS xray, round(sqrt(a), 4) AS sigma_n, round(sqrt(d), 4) AS sigma_x, round(w, 4) AS weight, coalesce(cells, 0) AS cells FROM ps LEFT JOIN lb ON lb.t = ps.t AND lb.label = ps.k"""


@query("adaptive_series", _SEQUENCE, 4)
def adaptive_series(spark, sf_dir):
    """Each year's fit starts from the one before; drift, dormant classes and limits on steps are in the tests."""
    cells, grid = lineitem_grid(spark, sf_dir)
    library = materials.materials(materials.class_library(cells.where("t = 0"), REGIONS), REGIONS)
    how = following.Following(mixtures.Anchored(library, grid.area), rounds=_EACH)
    bins = moments(cells, grid).withColumn("series", F.lit("lineitem"))
    return following.follow(following.packed(bins), how).select("t", "class_id", "neutron", "xray", "sigma_n", "sigma_x", "weight", "cells")
