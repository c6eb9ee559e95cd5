"""Region and selection files: round trips, old layouts, statistics of masks against numpy."""

import itertools
import json

import numpy as np
import pytest

from duovox.functions.plane import Region
from duovox.sources import regions


def test_region_files(spark, tmp_path):
    file = regions.RegionFile(regions.Shape((0.0, 2.0, 5.0, 9.0)), (regions.Shape(points=((0.0, 0.0), (1.0, 0.0), (0.0, 1.0))),), (
        Region("a", 1, rectangle=(1.0, 4.0, 10.0, 20.0)), Region("b", 7, points=((0.0, 0.0), (2.0, 0.0), (2.0, 3.0)), visible=False), Region("ç", 8, rectangle=(0.0, 1.0, 0.0, 1.0), layer_only=True),
    ))
    regions.write_regions(spark, file, str(tmp_path / "r"))
    assert regions.read_regions(spark, str(tmp_path / "r")) == file
    assert json.loads(regions.written(file))["named_rois"][0]["rectangle"] == [1.0, 10.0, 4.0, 20.0]
    # one shape alone is the old layout; what isn't named has defaults; other keys are ignored
    assert regions.parsed('{"type": "rectangle", "bounds": [0, 5, 2, 9]}') == regions.RegionFile(regions.Shape((0.0, 2.0, 5.0, 9.0)))
    assert regions.parsed('{"type": null}') == regions.RegionFile() == regions.parsed("{}")
    old = regions.parsed('{"active": {"type": null}, "named_rois": [{"name": "q", "class_id": 3, "roi_type": "rectangle", "rectangle": [0, 0, 1, 1], "color": "#fff"}]}')
    assert old.regions == (Region("q", 3, rectangle=(0.0, 1.0, 0.0, 1.0)),)
    (tmp_path / "empty.json").write_text(" ")
    with pytest.raises(ValueError):
        regions.read_regions(spark, str(tmp_path / "empty.json"))


def test_selections(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, x, mask = rng.normal(0, 1, (2, 4, 5)), rng.normal(5, 2, (2, 4, 5)), rng.random((2, 4, 5)) < 0.4
    items = [
        {"name": "one", "cluster_id": 4, "visible": False, "spatial_mask": mask.tolist(), "histogram_roi": [[0, 0], [1, 0], [1, 1]], "color": {"format": "rgb", "value": [1, 2, 3]}},
        {"name": "none", "spatial_mask": np.zeros((2, 4, 5), bool).tolist()}, {"name": "small", "spatial_mask": np.ones((1, 4, 5), bool).tolist()},
        {"name": "outline", "spatial_mask": None, "histogram_roi": [[0, 0], [1, 0], [1, 1]]}, {"name": "flat", "spatial_mask": mask[0].tolist()},
    ]
    path = tmp_path / "s.bits"
    path.write_text(json.dumps({"version": "1.1", "num_selections": 5, "selections": items}))
    got = regions.read_selections(spark, str(path))
    rows = got.orderBy("selection").collect()
    assert [(r.name, r.cluster_id, r.visible) for r in rows] == [("one", 4, False), ("none", None, True), ("small", None, True), ("outline", None, True), ("flat", None, True)]
    assert rows[0].roi == [[0, 0], [1, 0], [1, 1]] and json.loads(rows[0].color)["value"] == [1, 2, 3] and rows[3].mask is None
    assert {(r.z, r.y, r.x) for r in regions.selection_cells(got).where("selection = 0").collect()} == set(map(tuple, np.argwhere(mask)))
    at = list(itertools.product(range(2), range(4), range(5)))
    cells = spark.createDataFrame([(*p, float(n[p]), float(x[p])) for p in at], "z int, y int, x int, neutron double, xray double")
    stats, skipped = regions.selection_statistics(cells, got)
    (one,) = stats.collect()
    assert (one.name, one.cells, one.percent) == ("one", mask.sum(), 100 * mask.mean())
    assert np.allclose([one.neutron_mean, one.neutron_std, one.xray_min, one.xray_max], [n[mask].mean(), n[mask].std(), x[mask].min(), x[mask].max()])
    assert sorted(r.name for r in skipped.collect()) == ["flat", "small"]
    slice_stats = regions.selection_statistics(cells.where("z = 0"), got)[0].collect()
    assert sorted((r.name, r.cells) for r in slice_stats) == [("flat", mask[0].sum()), ("small", 20)]
    path.write_text("{}")
    with pytest.raises(Exception, match="no list of selections"):
        regions.read_selections(spark, str(path)).collect()
