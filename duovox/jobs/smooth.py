"""Registered queries of smoothing with costs and edges, the locked mode with it, and thin parts, with SQL of the same sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from duovox.functions.plane import Region
from duovox.jobs.adaptive import QUERIES, SQL  # noqa: F401
from duovox.jobs.registry import _ADJ, labelled_grid, query
from duovox.jobs.volumes import _COMPONENTS, _NEXT, _S
from duovox.operators import smoothing, spatial
from duovox.operators.histograms import plane_grid
from duovox.sources.paired import grid_events, grid_series

CENTRES = (17.0, 50.0, 83.0)
BETA, SWEEPS = 0.15, 3
#: Classes of the locked mode on the events' plane.
BANDS = [Region("low", 1, rectangle=(-1e9, 1e9, 0.0, 28.0)), Region("middle", 2, rectangle=(-1e9, 1e9, 36.0, 64.0)), Region("high", 3, rectangle=(-1e9, 1e9, 72.0, 90.0))]

_COST = "ks AS (SELECT unnest([0, 1, 2]) AS k), fu AS (SELECT a.k, b.k AS l, coalesce(ad.n, 0) + 1 AS n FROM ks a CROSS JOIN ks b LEFT JOIN ad ON ad.k = a.k AND ad.l = b.k), ra AS (SELECT k, l, -ln(n / sum(n) OVER (PARTITION BY k)) AS c FROM fu), rb AS (SELECT k, l, c - max(CASE WHEN k = l THEN c END) OVER (PARTITION BY k) AS c FROM ra), lc AS (SELECT x.k, x.l, CASE WHEN x.k = x.l THEN 0 ELSE greatest(0, least(5, (x.c + y.c) / 2)) END AS cost FROM rb x JOIN rb y ON y.k = x.l AND y.l = x.k)"
_GAP = "sqrt(power((b.neutron - a.neutron) / sn, 2) + power((b.xray - a.xray) / sx, 2))"


def _edges(cells: str) -> str:
    """Faces of full grids (t, z, y, x) with their weights, from the lower cell (id) to the upper one (up)."""
    return f"""sz AS (SELECT t, stddev_pop(neutron) AS sn, stddev_pop(xray) AS sx, max(z) - min(z) + 1 AS nz, max(y) - min(y) + 1 AS ny, max(x) - min(x) + 1 AS nx FROM {cells} GROUP BY t),
gp AS MATERIALIZED (SELECT a.t, a.id, b.id AS up, {_GAP} AS gap, CASE WHEN nz > 1 THEN nz * ny * nx / nz ELSE 0 END + CASE WHEN ny > 1 THEN nz * ny * nx / ny ELSE 0 END + CASE WHEN nx > 1 THEN nz * ny * nx / nx ELSE 0 END AS last FROM {cells} a JOIN sz ON sz.t = a.t JOIN {cells} b ON b.t = a.t AND {_NEXT}),
sg AS (SELECT t, sum(gap) / (count(gap) + first(last)) AS sigma FROM gp GROUP BY t), ed AS MATERIALIZED (SELECT id, up, exp(-0.5 * power(gap / sigma, 2)) AS w FROM gp JOIN sg ON sg.t = gp.t), nb AS MATERIALIZED (SELECT id, up AS o, w FROM ed UNION ALL SELECT up, id, w FROM ed)"""


def _soft(name: str, rows: str) -> str:
    return f"{name}t AS (SELECT id, k, v - max(v) OVER (PARTITION BY id) AS v FROM {rows}), {name} AS MATERIALIZED (SELECT id, k, exp(v) / sum(exp(v)) OVER (PARTITION BY id) AS r FROM {name}t)"


def _mean_field(beta: float, sweeps: int) -> str:
    """SQL of the shares r after the sweeps, from sc (id, k, s), nb and lc, and of labels lb (id, k)."""
    out = [_soft("h0", "(SELECT id, k, s AS v FROM sc)")]
    for n in range(sweeps):
        out.append(f"m{n} AS MATERIALIZED (SELECT nb.id, h.k, sum(w * r) AS m FROM nb JOIN h{n} h ON h.id = nb.o GROUP BY nb.id, h.k), v{n} AS (SELECT sc.id, sc.k, any_value(s) - {beta} * coalesce(sum(m * cost), 0) AS v FROM sc LEFT JOIN m{n} ON m{n}.id = sc.id LEFT JOIN lc ON lc.k = sc.k AND lc.l = m{n}.k GROUP BY sc.id, sc.k)")
        out.append(_soft(f"u{n}", f"v{n}"))
        out.append(f"h{n + 1} AS MATERIALIZED (SELECT u.id, u.k, 0.5 * u.r + 0.5 * h.r AS r FROM u{n} u JOIN h{n} h ON h.id = u.id AND h.k = u.k)")
    return ", ".join(out) + f", lb AS MATERIALIZED (SELECT id, arg_max(k, r) AS k FROM h{sweeps} GROUP BY id)"


def _icm(beta: float, sweeps: int) -> str:
    out = ["l0 AS (SELECT id, arg_max(k, s) AS k FROM sc GROUP BY id)"]
    for n in range(sweeps):
        out.append(f"m{n} AS MATERIALIZED (SELECT nb.id, h.k, sum(w) AS m FROM nb JOIN l{n} h ON h.id = nb.o GROUP BY nb.id, h.k), l{n + 1} AS MATERIALIZED (SELECT id, arg_max(k, v) AS k FROM (SELECT sc.id, sc.k, any_value(s) - {beta} * coalesce(sum(m * cost), 0) AS v FROM sc LEFT JOIN m{n} ON m{n}.id = sc.id LEFT JOIN lc ON lc.k = sc.k AND lc.l = m{n}.k GROUP BY sc.id, sc.k) GROUP BY id)")
    return ", ".join(out) + f", lb AS (SELECT id, k FROM l{sweeps})"


_ENERGY = f"en AS (SELECT lb.id, lb.k, -any_value(s) + {BETA} * coalesce(sum(w * cost), 0) AS e FROM lb JOIN sc ON sc.id = lb.id AND sc.k = lb.k LEFT JOIN ed ON ed.id = lb.id LEFT JOIN lb b ON b.id = ed.up LEFT JOIN lc ON lc.k = lb.k AND lc.l = b.k GROUP BY lb.id, lb.k)"
_GRID = f"{_ADJ}, {_COST}, n AS MATERIALIZED (SELECT *, (z * 20 + y) * 20 + x AS id FROM g), {_edges('n')}, sc AS MATERIALIZED (SELECT id, k, -abs(xray - (17 + 33 * k)) / 33 AS s FROM n, ks)"
_ROWS = "SELECT 0 AS t, (en.id // 400)::INTEGER AS z, k AS label, count(*) AS n, round(sum(e), 4) AS energy FROM en GROUP BY ALL"


def _smoothed(spark, sf_dir, method):
    cells = grid_events(spark, sf_dir).withColumns({f"s{k}": -F.abs(F.col("xray") - centre) / 33 for k, centre in enumerate(CENTRES)})
    cost = smoothing.learned_cost(labelled_grid(spark, sf_dir), "label", len(CENTRES))
    out = smoothing.smoothed(cells, ["s0", "s1", "s2"], BETA, SWEEPS, method, cost, edges=True)
    return out.groupBy("t", "z", "label").agg(F.count("*").alias("n"), F.sum("energy").alias("energy"))


@query("mean_field", f"WITH {_GRID}, {_mean_field(BETA, SWEEPS)}, {_ENERGY} {_ROWS}", 4)
def mean_field(spark, sf_dir):
    """Labels and energy by slab after soft sweeps with learned costs and edge weights."""
    return _smoothed(spark, sf_dir, "mean_field")


@query("icm_costs", f"WITH {_GRID}, {_icm(BETA, SWEEPS)}, {_ENERGY} {_ROWS}", 4)
def icm_costs(spark, sf_dir):
    return _smoothed(spark, sf_dir, "icm")


_OPEN = "o6 AS (SELECT a.id FROM m a JOIN m b ON b.t = a.t AND abs(b.z - a.z) + abs(b.y - a.y) + abs(b.x - a.x) = 1 AND b.z BETWEEN a.z - 1 AND a.z + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY a.id HAVING count(*) = 6), op AS (SELECT id FROM o6 UNION SELECT b FROM e JOIN o6 ON o6.id = e.a)"


@query("thin_parts", f"WITH RECURSIVE {_S}, m AS MATERIALIZED (SELECT *, ((t * 5 + z) * 20 + y) * 20 + x AS id FROM s WHERE xray >= 45), f AS (SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON b.t = a.t AND {_NEXT}), e AS MATERIALIZED (SELECT a, b FROM f UNION ALL SELECT b, a FROM f), {_COMPONENTS}, {_OPEN}, p AS (SELECT t, comp, count(*) AS n, count(op.id) AS o FROM lab JOIN m USING (id) LEFT JOIN op USING (id) GROUP BY ALL) SELECT t, comp::BIGINT AS component, n FROM p WHERE n >= 4 AND o = 0")
def thin_parts(spark, sf_dir):
    cells = grid_series(spark, sf_dir).withColumn("m", F.col("xray") >= 45)
    return smoothing.thin_parts(cells, "m", least=4).groupBy("t", "component").agg(F.count("*").alias("n"))


_PLANE = "r AS (SELECT min(neutron) AS n0, max(neutron) AS n1, min(xray) AS x0, max(xray) AS x1 FROM s)"
_BAND = "CASE WHEN xray BETWEEN 72 AND 90 THEN 2 WHEN xray BETWEEN 36 AND 64 THEN 1 WHEN xray BETWEEN 0 AND 28 THEN 0 END"
_LOCKED = f"""WITH {_S}, {_PLANE}, n AS MATERIALIZED (SELECT s.*, {_BAND} AS band, ((t * 5 + z) * 20 + y) * 20 + x AS id, greatest(0, least(63, floor((xray - x0) / (x1 - x0) * 64)))::INTEGER AS iy, greatest(0, least(63, floor((neutron - n0) / (n1 - n0) * 64)))::INTEGER AS ix FROM s, r),
bm AS (SELECT t, iy, ix, count(*) AS c, sum(neutron) AS sn, sum(xray) AS sx, sum(neutron * neutron) AS snn, sum(xray * xray) AS sxx, sum(neutron * xray) AS snx FROM n GROUP BY ALL),
lib AS (SELECT band AS k, avg(neutron) AS mn, avg(xray) AS mx, var_samp(neutron) AS a, var_samp(xray) AS d, covar_samp(neutron, xray) AS o, count(*) / sum(count(*)) OVER () AS w FROM n WHERE t = 0 AND band IS NOT NULL GROUP BY 1),
bs AS MATERIALIZED (SELECT t, iy, ix, k, -0.5 * (2 * ln(2 * pi()) + ln(a * d - o * o) + (d * (sn / c - mn) * (sn / c - mn) - 2 * o * (sn / c - mn) * (sx / c - mx) + a * (sx / c - mx) * (sx / c - mx)) / (a * d - o * o)
  + greatest((d * (snn / c - sn / c * sn / c) - 2 * o * (snx / c - sn / c * sx / c) + a * (sxx / c - sx / c * sx / c)) / (a * d - o * o), 0)) + ln(w) AS s FROM bm, lib UNION ALL SELECT t, iy, ix, 3, -ln((n1 - n0) * (x1 - x0)) + ln(1e-4) FROM bm, r),
sc AS MATERIALIZED (SELECT id, k, bs.s FROM n JOIN bs ON bs.t = n.t AND bs.iy = n.iy AND bs.ix = n.ix),
fc AS (SELECT a.band AS a, b.band AS b FROM n a JOIN n b ON b.t = a.t AND {_NEXT} WHERE a.t = 0 AND a.band IS NOT NULL AND b.band IS NOT NULL), ad AS (SELECT k, l, count(*) AS n FROM (SELECT a AS k, b AS l FROM fc UNION ALL SELECT b, a FROM fc) GROUP BY ALL),
{_COST.replace("lc AS", "l3 AS")}, lc AS MATERIALIZED (SELECT k, l, cost FROM l3 UNION ALL SELECT k, l, CASE WHEN k = l THEN 0 ELSE (SELECT median(cost) FROM l3 WHERE k <> l) END FROM (SELECT unnest([0, 1, 2, 3, 3, 3, 3]) AS k, unnest([3, 3, 3, 3, 0, 1, 2]) AS l)),
{_edges('n')}, {_mean_field(0.3, SWEEPS)}, pl AS (SELECT id, arg_max(k, s) AS k FROM sc GROUP BY id), al AS (SELECT n.t, (lb.k + 1) % 4 AS label, (pl.k + 1) % 4 AS plain FROM n JOIN lb ON lb.id = n.id JOIN pl ON pl.id = n.id),
cs AS (SELECT t, label, count(*) AS cells FROM al GROUP BY ALL), ps AS (SELECT t, plain AS label, count(*) AS plain_cells FROM al GROUP BY ALL)"""


def _locked(spark, sf_dir):
    cells = spatial._table(grid_series(spark, sf_dir))  # properties are parsed once
    return smoothing.locked_smooth(cells, BANDS, plane_grid(cells), 0.3, sweeps=SWEEPS)


@query("locked_smooth", f"{_LOCKED} SELECT t, label, coalesce(cells, 0) AS cells, coalesce(plain_cells, 0) AS plain_cells, round(coalesce(cells, 0) / nullif(plain_cells, 0), 6) AS kept FROM cs FULL JOIN ps USING (t, label)")
def locked_smooth(spark, sf_dir):
    """The locked mode's cells with smoothing and without it, and what each class keeps."""
    return smoothing.smooth_report(spatial._table(_locked(spark, sf_dir)))[0]


@query("auto_smoothing")
def auto_smoothing(spark, sf_dir):
    """Every strength of the whole search at every timepoint, with the guards' figures: up to 8, and doubled while labels still change; the choice is tested in pytest."""
    cells = spatial._table(grid_series(spark, sf_dir))
    return smoothing.auto_smoothing(cells, BANDS, plane_grid(cells))[2]
