import math

import numpy as np
from pyspark.sql import functions as F

from duovox.operators import validation


def cells():
    rng = np.random.default_rng(8)
    rows = []
    for z in range(8):
        for y in range(6):
            for x in range(6):
                label = int(rng.integers(0, 3)) if z < 7 else 0
                n, v = rng.normal((10, 14, 10)[label], 2), rng.normal((5, 5, 11)[label], 2)
                rows.append((0, z, y, x, float(n), float(v), label, z // 2))
    rows += [(0, 9, 9, 9, float("nan"), 1.0, 1, 0), (0, 9, 9, 8, 1.0, 1.0, None, 1)]
    return rows


def plain(rows, values=None):
    """Predictions by the classes of the other blocks."""
    rows = [r for r in rows if r[6] is not None and math.isfinite(r[4])]
    out = []
    for i, r in enumerate(rows):
        train = [q for q in rows if q[7] != r[7]]
        point, best = np.array(values[i] if values else r[4:6]), None
        for k in sorted({q[6] for q in train}):
            p = np.array([q[4:6] for q in train if q[6] == k])
            c, d = np.cov(p.T), point - p.mean(0)
            s = math.log(len(p) / len(train)) - 0.5 * (2 * math.log(2 * math.pi) + math.log(np.linalg.det(c)) + d @ np.linalg.solve(c, d))
            if best is None or s > best[0]:
                best = (s, k)
        out.append((r[7], r[6], best[1]))
    return out


def kappa(pairs):
    n = len(pairs)
    hit = sum(a == b for _, a, b in pairs) / n
    chance = sum(sum(a == k for _, a, _ in pairs) * sum(b == k for _, _, b in pairs) for k in range(3)) / n**2
    return hit, (hit - chance) / (1 - chance) if chance < 1 else None


def test_folds_against_loops(spark):
    rows = cells()
    df = spark.createDataFrame(rows, "t int, z int, y int, x int, neutron double, xray double, label int, block int").repartition(4)
    got = {r.block: r for r in validation.block_validation(df).collect()}
    told = plain(rows)
    for block in (None, 0, 1, 2, 3):
        mine = [p for p in told if block is None or p[0] == block]
        accuracy, k = kappa(mine)
        assert got[block].cells == len(mine) and math.isclose(got[block].accuracy, accuracy) and math.isclose(got[block].kappa, k)
    assert validation.block_validation(df.where("block = 1")).where("block IS NOT NULL").count() == 0  # nothing to learn from
    order = F.md5(F.concat_ws(",", "z", "y", "x"))
    drops = {r.feature: r for r in validation.importance(df, order).collect()}
    assert drops["none"].drop == 0 and math.isclose(drops["none"].accuracy, kappa(told)[0])
    mixed = validation.permuted(df.where("z < 8"), "neutron", order).collect()
    before = {(r[1], r[2], r[3]): r for r in rows}
    for b in range(4):
        own = [r for r in mixed if r.block == b]
        assert sorted(r.neutron for r in own) == sorted(before[r.z, r.y, r.x][4] for r in own) and any(r.neutron != before[r.z, r.y, r.x][4] for r in own)
        assert all(r.xray == before[r.z, r.y, r.x][5] for r in own)
    values = {(r.z, r.y, r.x): (r.neutron, r.xray) for r in mixed}
    fine = [r for r in rows if r[6] is not None and math.isfinite(r[4])]
    want = kappa(plain(rows, [values[r[1], r[2], r[3]] for r in fine]))[0]
    assert math.isclose(drops["neutron"].accuracy, want) and drops["neutron"].drop > 0.03
