"""Anchored mixtures: Gaussian classes that start at regions drawn at one timepoint and follow the histogram of every other one.

Everything works on bin moments (at most bins x bins rows for each t, see histograms.moments). The rounds of expectation and maximisation run on
one timepoint's bins in a task, all timepoints at once; scores and labels are Column expressions over the bins and the fitted parameters. The number
of rounds is fixed, so a result depends on the data alone. A uniform outlier class takes what no class explains.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duovox.operators.materials import UNCLASSIFIED, Material
from duovox.operators.ship import shipped

LOG_2PI = math.log(2 * math.pi)
FROZEN = 1e12
#: The parameters of a class: means, variances, covariance, weight.
PARTS = ("n", "x", "a", "d", "o", "w")


def pseudo_count(strength: float, cells: float) -> float:
    """Cells that an anchor counts as: none at strength 0, as many as its class at 0.5, and beyond any data at 1."""
    strength = min(max(strength, 0.0), 1.0)
    return FROZEN if strength >= 1 else max(cells, 1.0) * strength / (1 - strength)


@dataclass(frozen=True)
class Anchored:
    """Classes with the strength of their anchors, by class_id where it differs, those that never move, and the outlier class.

    dirichlet: how many cells the anchors' weights count as. area: of the plane over which the outlier class is uniform.
    """

    library: list[Material]
    area: float
    strength: float = 0.5
    strengths: dict[int, float] = field(default_factory=dict)
    fixed: frozenset[int] = frozenset()
    outlier: float = 1e-3
    dirichlet: float = 0.0
    ridge: float = 1e-6

    def kappa(self, m: Material) -> float:
        return pseudo_count(self.strengths.get(m.class_id, self.strength), m.n)

    def covariance(self, m: Material) -> tuple[float, float, float]:
        """Variances and covariance of an anchor, kept away from singular ones."""
        scale = max((m.var_n + m.var_x) / 2, 0.0)
        floor = max(1e-6 * scale, 1e-6)
        singular = m.var_n * m.var_x - m.cov**2 <= 0 or m.var_n <= 0 or m.var_x <= 0
        more = floor if singular else floor * 1e-3
        return m.var_n + more, m.var_x + more, m.cov

    def anchors(self) -> np.ndarray:
        """The anchors as an array (class, part)."""
        return np.array([(m.neutron, m.xray, *self.covariance(m), m.weight) for m in self.library])


MOMENTS = ["c", "sn", "sx", "snn", "sxx", "snx"]


def shares(b: dict[str, np.ndarray], classes: np.ndarray, outlier: float, model: Anchored) -> np.ndarray:
    """Responsibilities (class, bin), the outlier class last, of bins given as arrays; classes: an array (class, part)."""
    n, x, a, d, o, w = classes.T[:, :, None]
    det = a * d - o * o
    mn, mx = b["sn"] / b["c"], b["sx"] / b["c"]
    quadratic = (d * (mn - n) ** 2 - 2 * o * (mn - n) * (mx - x) + a * (mx - x) ** 2) / det
    within = (d * (b["snn"] - b["sn"] * mn) - 2 * o * (b["snx"] - b["sn"] * mx) + a * (b["sxx"] - b["sx"] * mx)) / det / b["c"]
    joint = -0.5 * (2 * LOG_2PI + np.log(det) + quadratic + np.maximum(within, 0)) + np.log(w)
    if model.outlier:
        joint = np.vstack([joint, np.full(len(mn), np.log(outlier) - np.log(model.area))])
    e = np.exp(joint - np.maximum(joint.max(0), -1e300))
    return e / e.sum(0)


def rounds_of(b: dict[str, np.ndarray], prior: np.ndarray, classes: np.ndarray, model: Anchored, rounds: int) -> tuple[np.ndarray, float]:
    """Classes and the outlier class's weight after so many rounds from classes, under prior (both (class, part)): data and prior, weighed by their
    cells. Without cells a class goes to its prior; fixed ones stay."""
    k, classes, outlier = len(prior), classes.copy(), model.outlier
    kappa = np.array([model.kappa(m) for m in model.library])
    still = np.array([m.class_id in model.fixed for m in model.library])
    classes[:, 5] = np.maximum(prior[:, 5], 1e-12)
    classes[:, 5] *= (1 - outlier) / classes[:, 5].sum()
    alpha, total = model.dirichlet * prior[:, 5], b["c"].sum()
    data = np.array([b[c] for c in MOMENTS], float)
    for _ in range(rounds):
        r = shares(b, classes, outlier, model)
        c, sn, sx, snn, sxx, snx = data @ r[:k].T
        size = kappa + c + 3
        with np.errstate(divide="ignore", invalid="ignore"):
            mn, mx = sn / c, sx / c
            dn, dx, pull = mn - prior[:, 0], mx - prior[:, 1], kappa * c / (kappa + c)
            a = ((kappa + 3) * prior[:, 2] + snn - c * mn * mn + pull * dn * dn) / size
            d = ((kappa + 3) * prior[:, 3] + sxx - c * mx * mx + pull * dx * dx) / size
            o = ((kappa + 3) * prior[:, 4] + snx - c * mn * mx + pull * dn * dx) / size
            floor = np.maximum(model.ridge * np.maximum((a + d) / 2, 0), model.ridge)
            more = np.where((a * d - o * o <= 0) | (a <= 0) | (d <= 0), floor, floor * 1e-3)
            new = np.array([(kappa * prior[:, 0] + c * mn) / (kappa + c), (kappa * prior[:, 1] + c * mx) / (kappa + c), a + more, d + more, o]).T
        new = np.where((c > 0)[:, None], new, prior[:, :5])
        classes[~still, :5] = new[~still]
        outlier = max(float((b["c"] * r[k]).sum() / max(total, 1)), 1e-8) if model.outlier else 0.0
        raw = np.maximum((alpha + c) / (alpha.sum() + total), 1e-12)
        classes[:, 5] = raw * (1 - outlier) / raw.sum()
    return classes, outlier


def settle(at: np.ndarray, weight: np.ndarray, start: np.ndarray, width: np.ndarray, steps: int, settled: float = 1e-4) -> np.ndarray:
    """The mode near start: weighted means under a kernel of the given widths, until a step is less than `settled` of them. The nearest point's
    weight keeps far kernels from vanishing."""
    for _ in range(steps):
        f = -0.5 * (((at - start) / width) ** 2).sum(1)
        w = weight * np.exp(f - f.max())
        new = (w[:, None] * at).sum(0) / w.sum()
        move, start = np.abs(new - start) / width, new
        if move.max() < settled:
            break
    return start


def log_density(k: int) -> Column:
    """The mean log density of a bin's pairs under class k of the row, by the bin's moments."""
    a, d, o = (F.col(f"{p}{k}") for p in "ado")
    det = a * d - o * o
    c, sn, sx = F.col("c"), F.col("sn"), F.col("sx")
    mn, mx = sn / c, sx / c
    dn, dx = mn - F.col(f"n{k}"), mx - F.col(f"x{k}")
    quadratic = (d * dn * dn - 2 * o * dn * dx + a * dx * dx) / det
    within = (d * (F.col("snn") - sn * mn) - 2 * o * (F.col("snx") - sn * mx) + a * (F.col("sxx") - sx * mx)) / det / c
    return -0.5 * (2 * LOG_2PI + F.log(det) + quadratic + F.greatest(within, F.lit(0.0)))


def responsibilities(bins: DataFrame, parameters: DataFrame, model: Anchored) -> DataFrame:
    """bins with r0, r1... of each class, ru of the outlier class (0 without one), and the log of the sum of the joint densities."""
    names = [*map(str, range(len(model.library))), *(["u"] if model.outlier else [])]
    joint = {f"j{k}": log_density(int(k)) + F.log(F.col(f"w{k}")) if k != "u" else F.log("wu") - math.log(model.area) for k in names}
    # a row of parameters for each t goes to all tasks; its number is that of timepoints
    rows = bins.join(F.broadcast(parameters), "t").withColumns(joint)
    rows = rows.withColumn("top", F.greatest(*[F.col(f"j{k}") for k in names], F.lit(-1e300)))
    rows = rows.withColumns({f"e{k}": F.exp(F.col(f"j{k}") - F.col("top")) for k in names})
    rows = rows.withColumn("all", sum((F.col(f"e{k}") for k in names), F.lit(0.0)))
    made = {f"r{k}": F.col(f"e{k}") / F.col("all") for k in names}
    if not model.outlier:
        made["ru"] = F.lit(0.0)
    return rows.withColumns(made | {"log_all": F.col("top") + F.log("all")}).select(*bins.columns, *made, "log_all")


def fitted(bins: DataFrame, model: Anchored, rounds: int = 8) -> DataFrame:
    """t and, in one row for each t, the parameters after so many rounds: n0, x0, a0, d0, o0, w0, n1... and wu, the outlier class's weight. A group is
    the bins of one timepoint; empty classes go back to their anchors."""
    shipped(bins.sparkSession)
    names = [f"{p}{k}" for k in range(len(model.library)) for p in PARTS] + ["wu"]
    prior = model.anchors()

    def one(f: pd.DataFrame) -> pd.DataFrame:
        classes, outlier = rounds_of({c: f[c].to_numpy() for c in MOMENTS}, prior, prior, model, rounds)
        return pd.DataFrame([[f["t"].iloc[0], *classes.ravel(), outlier]], columns=["t", *names])

    return bins.select("t", *MOMENTS).groupBy("t").applyInPandas(one, "t int, " + ", ".join(f"{n} double" for n in names))


def class_rows(parameters: DataFrame, model: Anchored) -> DataFrame:
    """t, class_id, weight, neutron, xray, sigma_n, sigma_x, cov, moved: the latter in deviations of the anchor; class 0 is the outlier class, with a weight alone."""
    rows = []
    for k, m in enumerate(model.library):
        a0, d0, _ = model.covariance(m)
        moved = F.hypot((F.col(f"n{k}") - m.neutron) / math.sqrt(a0), (F.col(f"x{k}") - m.xray) / math.sqrt(d0))
        values = (F.col(f"w{k}"), F.col(f"n{k}"), F.col(f"x{k}"), F.sqrt(f"a{k}"), F.sqrt(f"d{k}"), F.col(f"o{k}"), moved)
        rows.append(F.struct(F.lit(m.class_id).alias("class_id"), *[v.alias(n) for n, v in zip(("weight", "neutron", "xray", "sigma_n", "sigma_x", "cov", "moved"), values)]))
    rows.append(F.struct(F.lit(UNCLASSIFIED).alias("class_id"), F.col("wu").alias("weight"), *[F.lit(None).cast("double").alias(n) for n in ("neutron", "xray", "sigma_n", "sigma_x", "cov", "moved")]))
    return parameters.select("t", F.inline(F.array(*rows)))


def fit_scores(rows: DataFrame, model: Anchored) -> DataFrame:
    """t, cells, log_likelihood, bic, entropy, icl from responsibilities. The criteria count cells, not bins; icl adds twice the entropy of the assignment."""
    k = len(model.library)
    free = 5 * k + k - 1 + (1 if model.outlier else 0)
    each = [F.col(f"r{i}") for i in [*range(k), *(["u"] if model.outlier else [])]]
    entropy = sum(-r * F.log(F.greatest(r, F.lit(1e-300))) for r in each)
    s = rows.groupBy("t").agg(F.sum("c").alias("cells"), F.sum(F.col("c") * F.col("log_all")).alias("log_likelihood"), F.sum(F.col("c") * entropy).alias("entropy"))
    bic = -2 * F.col("log_likelihood") + free * F.log(F.greatest("cells", F.lit(2)))
    return s.select("t", "cells", "log_likelihood", bic.alias("bic"), "entropy", (bic + 2 * F.col("entropy")).alias("icl"))


def bin_labels(rows: DataFrame, model: Anchored, reject: float | None = None) -> DataFrame:
    """The bins with label and share: the likeliest class, the first of equals; 0 where the outlier class is likelier than each, or none reaches `reject`."""
    options = [F.struct(F.col(f"r{k}").alias("share"), F.lit(-k).alias("order"), F.lit(m.class_id).alias("label")) for k, m in enumerate(model.library)]
    best = F.array_max(F.array(*options))
    out = rows.withColumn("best", best)
    known = F.col("best.share") >= F.col("ru")
    if reject is not None:
        known = known & (F.col("best.share") >= reject)
    kept = [c for c in rows.columns if not c.startswith("r") and c != "log_all"]
    return out.select(*kept, F.when(known, F.col("best.label")).otherwise(UNCLASSIFIED).alias("label"), F.col("best.share").alias("share"))


# drift


def spread(m: Material) -> tuple[float, float]:
    """Deviations of an anchor that give its kernel a width; a constant one takes a hundredth of its size."""
    s = [math.sqrt(max(v, 0.0)) for v in (m.var_n, m.var_x)]
    if max(s) <= 0:
        s = [0.01 * (max(abs(m.neutron), abs(m.xray)) or 1.0)] * 2
    return max(s[0], 1e-9), max(s[1], 1e-9)


def modes(bins: DataFrame, inert: list[Material], rounds: int = 12, kernel: float = 1.5) -> DataFrame:
    """t and n0, x0, n1...: where each anchor's mode lies at t, by at most so many steps of mean shift on the bins from its place."""
    shipped(bins.sparkSession)
    names = [f"{p}{k}" for k in range(len(inert)) for p in "nx"]

    def one(f: pd.DataFrame) -> pd.DataFrame:
        at = np.array([f["sn"] / f["c"], f["sx"] / f["c"]]).T
        found = [settle(at, f["c"].to_numpy(float), np.array([m.neutron, m.xray]), kernel * np.array(spread(m)), rounds) for m in inert]
        return pd.DataFrame([[f["t"].iloc[0], *np.ravel(found)]], columns=["t", *names])

    return bins.select("t", *MOMENTS).groupBy("t").applyInPandas(one, "t int, " + ", ".join(f"{n} double" for n in names))


def drift(found: DataFrame, inert: list[Material], scaled: bool = False, most: float = 4.0, apart: float = 1.0) -> DataFrame:
    """t, shift_n, shift_x, magnitude, scale_n, scale_x, residual, rejected of each t's modes (see modes) against the anchors.

    Rejected: anchors that moved more than `most` of their deviations, and all that lie within `apart` of another (both found one mode, and
    which of them is wrong can't be told). Shift: mean of the others, weighted by cells; with scaled and two anchors or more, least squares with a gain
    for each channel whose anchors differ. Without anchors the drift is 0 and the residual null.
    """
    every = range(len(inert))
    here = [{"n": F.col(f"n{k}"), "x": F.col(f"x{k}")} for k in every]
    own = [{"n": m.neutron, "x": m.xray} for m in inert]
    near = {}
    for k in every:
        s = spread(inert[k])
        near[f"ok{k}"] = (F.abs(here[k]["n"] - own[k]["n"]) / s[0] <= most) & (F.abs(here[k]["x"] - own[k]["x"]) / s[1] <= most)
    rows = found.withColumns(near)
    use = {}
    for k in every:
        alone = F.col(f"ok{k}")
        for i in every:
            if i != k:
                s = [max(u, v) for u, v in zip(spread(inert[k]), spread(inert[i]))]
                met = (F.abs(here[k]["n"] - here[i]["n"]) / s[0] < apart) & (F.abs(here[k]["x"] - here[i]["x"]) / s[1] < apart)
                alone = alone & ~(F.col(f"ok{i}") & met)
        use[f"use{k}"] = alone
    rows = rows.withColumns(use)
    part = lambda value: sum((F.when(F.col(f"use{k}"), F.lit(float(inert[k].n)) * value(k)).otherwise(0.0) for k in every), F.lit(0.0))
    rows = rows.withColumns({"total": F.nullif(part(lambda k: F.lit(1.0)), F.lit(0.0)), "used": sum((F.col(f"use{k}").cast("int") for k in every), F.lit(0))})
    for c in "nx":
        mean_x, mean_y = part(lambda k: F.lit(own[k][c])) / F.col("total"), part(lambda k: here[k][c]) / F.col("total")
        rows = rows.withColumns({f"mx_{c}": mean_x, f"my_{c}": mean_y})
        spread_ = part(lambda k: (F.lit(own[k][c]) - F.col(f"mx_{c}")) ** 2) / F.col("total")
        both = part(lambda k: (F.lit(own[k][c]) - F.col(f"mx_{c}")) * (here[k][c] - F.col(f"my_{c}"))) / F.col("total")
        gain = F.when((F.col("used") >= 2) & (spread_ > 0), both / spread_).otherwise(1.0) if scaled else F.lit(1.0)
        rows = rows.withColumn(f"scale_{c}", gain).withColumn(f"shift_{c}", F.coalesce(F.col(f"my_{c}") - F.col(f"scale_{c}") * F.col(f"mx_{c}"), F.lit(0.0)))
    left = sum((F.when(F.col(f"use{k}"), F.hypot(here[k]["n"] - F.col("scale_n") * own[k]["n"] - F.col("shift_n"), here[k]["x"] - F.col("scale_x") * own[k]["x"] - F.col("shift_x"))).otherwise(0.0) for k in every), F.lit(0.0))
    rejected = F.array_compact(F.array(*[F.when(~F.col(f"use{k}"), inert[k].name) for k in every]))
    return rows.select("t", "shift_n", "shift_x", F.hypot("shift_n", "shift_x").alias("magnitude"), "scale_n", "scale_x", F.try_divide(left, F.col("used")).alias("residual"), rejected.alias("rejected"))


def process_noise(found: DataFrame, drifts: DataFrame, inert: list[Material], floor: float = 1e-6) -> DataFrame:
    """var_n, var_x: what the accepted anchors still move after the common shift; the least step that a class should be allowed."""
    moves = F.array(*[F.struct(F.lit(m.name).alias("name"), (F.col(f"n{k}") - m.neutron).alias("n"), (F.col(f"x{k}") - m.xray).alias("x")) for k, m in enumerate(inert)])
    rows = found.select("t", F.inline(moves)).join(F.broadcast(drifts), "t").where(~F.array_contains("rejected", F.col("name")))
    least = lambda c: F.when(F.count("*") < 2, floor).otherwise(F.greatest(F.var_pop(F.col(c) - F.col(f"shift_{c}")), F.lit(floor)))
    return rows.agg(least("n").alias("var_n"), least("x").alias("var_x"))


def drifted(cells: DataFrame, drifts: DataFrame) -> DataFrame:
    """cells with both channels in the frame of the anchors. For exports that compare values over time; fits move the model instead."""
    rows = cells.join(F.broadcast(drifts.select("t", "shift_n", "shift_x", "scale_n", "scale_x")), "t")
    return rows.withColumns({"neutron": (F.col("neutron") - F.col("shift_n")) / F.col("scale_n"), "xray": (F.col("xray") - F.col("shift_x")) / F.col("scale_x")}).select(*cells.columns)
