"""Classes that follow a series: what one timepoint's fit leaves is the prior of the next, alike for tables and for streams.

A timepoint arrives as one row, its bin moments packed into arrays (at most bins x bins entries). The state of a series is a few numbers for each
class; a table is worked on in order of t within a series, a stream keeps the state between batches. Series are independent tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duovox.operators.mixtures import MOMENTS, Anchored, rounds_of, settle, shares, spread
from duovox.operators.ship import shipped

FIELDS = ["iy", "ix", *MOMENTS]
STATE = "t int, classes array<double>, dormant array<double>, drift array<double>"
CLASSES = "series string, t int, class_id int, neutron double, xray double, sigma_n double, sigma_x double, weight double, cells long, dormant boolean, resurrected boolean, clipped double, shift_n double, shift_x double, scale_n double, scale_x double, rejected array<string>"
LABELS = "series string, t int, iy int, ix int, c long, label int"


@dataclass(frozen=True)
class Following:
    """How classes follow a series.

    inert: ids of the classes that measure the drift (none: no drift). memory: the share of a prior that comes from the timepoint before, the rest from the
    anchors. least: a class below this weight is dormant and keeps its place until it comes back. noise: variances of a step, of which a class
    may take `limit` deviations, a reactive one `factor` times as many; longer steps are cut and reported.
    """

    model: Anchored
    inert: tuple[int, ...] = ()
    rounds: int = 8
    steps: int = 12
    memory: float = 0.5
    least: float = 0.0
    noise: tuple[float, float] | None = None
    limit: float = 6.0
    reactive: frozenset[int] = frozenset()
    factor: float = 4.0
    scaled: bool = False
    most: float = 4.0
    apart: float = 1.0
    kernel: float = 1.5


def packed(moments: DataFrame, series: str = "series") -> DataFrame:
    """series, t and the bins of each timepoint as arrays, by bin."""
    one = moments.groupBy(F.col(series).cast("string").alias("series"), "t").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("b"))
    return one.select("series", "t", *[F.col(f"b.{c}").alias(c) for c in FIELDS])


class Series:
    """The classes of one series as arrays (class, part), parts as in mixtures.PARTS, and what earlier timepoints left."""

    def __init__(self, how: Following, state: tuple | None = None):
        self.how, k = how, len(how.model.library)
        self.anchors = how.model.anchors()
        self.kappa = np.array([how.model.kappa(m) for m in how.model.library])
        self.t, self.classes, self.drift = None, None, None
        self.dormant = np.full((k, 5), np.nan)
        if state is not None:
            self.t, self.classes, self.dormant = state[0], np.array(state[1]).reshape(k, 6), np.array(state[2]).reshape(k, 5)
            self.drift = np.array(state[3]) if len(state[3]) else None

    def state(self) -> tuple:
        return self.t, self.classes.ravel().tolist(), self.dormant.ravel().tolist(), [] if self.drift is None else self.drift.tolist()

    def moved_by(self, b: dict[str, np.ndarray]) -> tuple[np.ndarray, list[str]]:
        """shift_n, shift_x, scale_n, scale_x of this timepoint against the anchors, found from where they were last; and the anchors left out."""
        how, inert = self.how, [m for m in self.how.model.library if m.class_id in self.how.inert]
        before = np.array([0.0, 0.0, 1.0, 1.0]) if self.drift is None else self.drift
        own = np.array([(m.neutron, m.xray) for m in inert])
        width = np.array([spread(m) for m in inert])
        expected = before[2:] * own + before[:2]
        at = np.array([b["sn"] / b["c"], b["sx"] / b["c"]]).T
        found = np.array([settle(at, b["c"], e, how.kernel * w, how.steps) for e, w in zip(expected, width)])
        ok = (np.abs(found - expected) / width <= how.most).all(1)
        met = (np.abs(found[:, None] - found[None]) / np.maximum(width[:, None], width[None]) < how.apart).all(2) & ok[None] & ok[:, None]
        np.fill_diagonal(met, False)
        use = ok & ~met.any(1)
        rejected = [m.name for m, u in zip(inert, use) if not u]
        if not use.any():
            return before, rejected
        weight = np.array([m.n for m in inert], float)[use]
        x, y = own[use], found[use]
        mx, my = np.average(x, 0, weight), np.average(y, 0, weight)
        scale = np.ones(2)
        if how.scaled and use.sum() >= 2:
            var, cov = np.average((x - mx) ** 2, 0, weight), np.average((x - mx) * (y - my), 0, weight)
            scale = np.where(var > 0, cov / np.where(var > 0, var, 1), 1.0)
        return np.concatenate([my - scale * mx, scale]), rejected

    def step(self, t: int, b: dict[str, np.ndarray]) -> dict:
        """Take in one timepoint; what it gave."""
        how, rejected = self.how, []
        prior = self.anchors.copy()
        if how.inert:
            self.drift, rejected = self.moved_by(b)
            s = self.drift[2:]
            prior[:, :2] = s * prior[:, :2] + self.drift[:2]
            prior[:, 2:5] *= [s[0] ** 2, s[1] ** 2, s[0] * s[1]]
        first = self.classes is None
        if not first and how.memory > 0:
            pulled = (self.kappa > 0)[:, None]
            prior[:, :5] = np.where(pulled, (1 - how.memory) * prior[:, :5] + how.memory * self.classes[:, :5], prior[:, :5])
            prior[:, 5] = np.where(self.kappa > 0, self.classes[:, 5], prior[:, 5])
        classes, outlier = rounds_of(b, prior, prior if first else self.classes, how.model, how.rounds)
        r = shares(b, classes, outlier, how.model)
        asleep = ~np.isnan(self.dormant[:, 0])
        resting = classes[:, 5] < how.least
        resurrected = asleep & ~resting
        self.dormant[resting & ~asleep] = classes[resting & ~asleep, :5]
        self.dormant[~resting] = np.nan
        classes[resting, :5] = self.dormant[resting]
        clipped = np.full(len(classes), np.nan)
        if not first and how.noise:
            sigma = np.sqrt(np.maximum(how.noise, 1e-30))
            move = classes[:, :2] - self.classes[:, :2]
            far = np.hypot(*(move / sigma).T)
            limit = np.array([how.limit * (how.factor if m.class_id in how.reactive else 1.0) for m in how.model.library])
            cut = far > limit
            classes[cut, :2] = self.classes[cut, :2] + move[cut] * (limit[cut] / far[cut])[:, None]
            clipped[cut] = far[cut]
        k = len(classes)
        best = r[:k].argmax(0)
        known = r[:k].max(0) >= (r[k] if how.model.outlier else 0)
        ids = np.array([m.class_id for m in how.model.library])
        self.t, self.classes = t, classes
        return {"classes": classes, "outlier": outlier, "label": np.where(known, ids[best], 0), "dormant": resting, "resurrected": resurrected, "clipped": clipped, "rejected": rejected}

    def rows(self, series: str, t: int, b: dict[str, np.ndarray], what: str) -> pd.DataFrame:
        out = self.step(t, b)
        if what == "labels":
            return pd.DataFrame({"series": series, "t": t, "iy": b["iy"], "ix": b["ix"], "c": b["c"], "label": out["label"]})
        ids = [*(m.class_id for m in self.how.model.library), 0]
        drift = [0.0, 0.0, 1.0, 1.0] if self.drift is None else self.drift.tolist()
        rows = []
        for k, i in enumerate(ids):
            cells = int(b["c"][out["label"] == i].sum())
            if i:
                n, x, a, d, _, w = out["classes"][k].tolist()
                rows.append((series, t, i, n, x, a**0.5, d**0.5, w, cells, bool(out["dormant"][k]), bool(out["resurrected"][k]), None if np.isnan(out["clipped"][k]) else float(out["clipped"][k]), *drift, out["rejected"]))
            else:
                rows.append((series, t, 0, None, None, None, None, float(out["outlier"]), cells, False, False, None, *drift, out["rejected"]))
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in CLASSES.split(", ")])
        return frame.astype({c: float for c in ("neutron", "xray", "sigma_n", "sigma_x", "clipped")})


def follow(timepoints: DataFrame, how: Following, what: str = "classes") -> DataFrame:
    """One row for each series, timepoint and class (0: the outlier class), or with what="labels" for each of their bins, of packed timepoints.

    A table's timepoints come in order of t, a stream's in order within each batch; a timepoint that isn't after its series' last (late or
    repeated) is left out. cells: by the likeliest class of each bin. A class without cells goes back to its prior.
    """
    schema = CLASSES if what == "classes" else LABELS
    shipped(timepoints.sparkSession)

    def arrays(row) -> dict[str, np.ndarray]:
        return {c: np.array(row[c], float if c.startswith("s") else np.int64) for c in FIELDS}

    def stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        one = Series(how, state.get if state.exists else None)
        got = pd.concat(frames).sort_values("t", kind="stable")
        for row in got.to_dict("records"):
            if one.t is None or row["t"] > one.t:
                yield one.rows(key[0], row["t"], arrays(row), what)
        if one.t is not None:
            state.update(one.state())

    def table(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, one = None, None
        for f in frames:
            for row in f.to_dict("records"):
                if one is None or row["series"] != name:
                    name, one = row["series"], Series(how)
                if one.t is None or row["t"] > one.t:
                    yield one.rows(name, row["t"], arrays(row), what)

    if timepoints.isStreaming:
        return timepoints.groupBy("series").applyInPandasWithState(stream, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return timepoints.repartition("series").sortWithinPartitions("series", "t").mapInPandas(table, schema)
