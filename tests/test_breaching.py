"""Breaching, bounded filling, lines, the functions called by name, and the command line."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus import api
from talus.__main__ import COMMANDS, main
from talus.functions import flood as K
from talus.operators import accumulate
from talus.raster import Raster
from talus.sources import grids

#: A pit of two cells behind a ridge of two: the way out is to the left.
VALLEY = np.array([[9, 9, 9, 9, 9, 9], [0, 5, 7, 3, 2, 9], [9, 9, 9, 9, 9, 9]], dtype=float)


def row(z):
    return z[1].tolist()


def test_complete():
    assert row(K.breached(VALLEY)) == [0, 3, 3, 3, 3, 9]


def test_pit_of_one_cell_is_raised_first():
    z = np.full((5, 5), 8.0)
    z[2, 2] = 1.0
    assert np.array_equal(K.breached(z), np.full((5, 5), 8.0))


def test_epsilon_falls_all_the_way():
    out = K.breached(VALLEY, epsilon=True)[1]
    assert out[0] == 0 and all(a < b for a, b in zip(out[:4], out[1:5]))


@pytest.mark.parametrize("limit", [{"max_length": 2}, {"max_depth": 1.0}])
def test_selective_leaves_what_is_too_long_or_deep(limit):
    assert row(K.breached(VALLEY, "selective", **limit)) == [0, 5, 7, 3, 3, 9]
    assert row(K.breached(VALLEY, "selective", fill=True, **limit)) == [0, 5, 7, 7, 7, 9]


def test_selective_carves_what_is_not():
    assert np.array_equal(K.breached(VALLEY, "selective", max_length=10, max_depth=10.0), K.breached(VALLEY))


def test_constrained_lowers_by_the_depth():
    out = row(K.breached(VALLEY, "constrained", max_depth=1.0))
    assert out[0] == 0 and out[2] == 3 and out[5] == 9


def test_unknown_mode():
    with pytest.raises(ValueError):
        K.breached(VALLEY, "other")


def test_no_data_is_an_outlet():
    z = np.full((5, 5), 6.0)
    z[2, 2], z[2, 3], z[1, 1] = 1.0, 2.0, np.nan
    out = K.breached(z)
    assert np.isnan(out[1, 1]) and np.array_equal(out[~np.isnan(z)], z[~np.isnan(z)])


@pytest.mark.parametrize("neighbours", [4, 8])
def test_bounded_filling(neighbours):
    z = np.random.default_rng(8).integers(0, 12, (21, 24)).astype(float)
    full = K.filled(z, neighbours)
    assert np.array_equal(K.filled_up_to(z, 0, neighbours), z)
    assert np.array_equal(K.filled_up_to(z, z.size, neighbours), full)
    before = z
    for most in (1, 2, 5, 20):  # more and more cells are filled, each to its level or not at all
        out = K.filled_up_to(z, most, neighbours)
        assert ((out == z) | (out == full)).all() and (out >= before).all()
        before = out
    pond, level = K.ponds(z, neighbours)
    assert np.array_equal(level, full) and np.array_equal(pond >= 0, full > z)
    size = np.bincount(pond[pond >= 0])
    assert np.array_equal(K.filled_up_to(z, 2, neighbours) > z, (pond >= 0) & (size[np.maximum(pond, 0)] <= 2))


def test_ponds_of_one_door_count_together():
    z = np.full((5, 7), 9.0)
    z[2, 1:6] = [2, 9, 5, 9, 1]
    z[2, 2] = z[2, 4] = 6.0
    z[0:2, 3] = 5.0
    assert np.array_equal(K.filled_up_to(z, 2), K.filled(z))


def test_no_data_drains_ponds():
    z = np.full((6, 6), 7.0)
    z[2, 2], z[2, 3] = np.nan, 3.0
    assert K.filled_up_to(z, 5)[2, 3] == 3.0


def test_lines():
    assert accumulate.line_cells(2, 5, 2, 3) == [(2, 3), (2, 4), (2, 5)]
    assert accumulate.line_cells(0, 1, 3, 1) == [(0, 1), (1, 1), (2, 1), (3, 1)]
    assert accumulate.line_cells(4, 2, 0, 0) == accumulate.line_cells(0, 0, 4, 2)
    found = accumulate.line_cells(0, 0, 4, 2)
    assert found[0] == (0, 0) and (4, 2) in found and all(abs(y - x / 2) <= 1 for x, y in found)


@pytest.fixture(scope="module")
def dem(spark):
    z = np.random.default_rng(4).integers(0, 40, (18, 20)).astype(float)
    return Raster.from_numpy(spark, z, -9999.0)


def test_functions_by_name(spark, dem):
    full = api.FillDepressions(dem)
    assert (full.to_numpy() >= dem.to_numpy()).all()
    assert (api.FillDepressions(dem, epsilon=True).to_numpy() >= full.to_numpy()).all()
    assert (api.BreachDepressions(dem).to_numpy() <= full.to_numpy()).all()
    a = api.FlowAccumulation(full, "Freeman", 1.1).to_numpy()
    ones = dem.map(lambda z: F.lit(1.0))
    assert np.allclose(a, api.FlowAccumFromProps(api.FlowProportions(full, "Freeman", 1.1), ones).to_numpy(), rtol=1e-5)
    assert api.ResolveFlats(full).to_numpy().shape == (18, 20)
    assert api.TerrainAttribute(dem, "aspect").meta.width == 20
    for wrong in (lambda: api.FlowAccumulation(dem, "Freeman"), lambda: api.FlowAccumulation(dem, "D8", 2.0), lambda: api.FillDepressions(dem, topology="D6")):
        with pytest.raises(ValueError):
            wrong()


def test_perlin(spark):
    one, again, other = (api.generate_perlin_terrain(spark, 20, s).to_numpy() for s in (1, 1, 2))
    assert np.array_equal(one, again) and not np.array_equal(one, other) and np.abs(one).max() <= 1
    # noise is smooth: a fifth of a lattice step changes little
    fine = api.generate_perlin_terrain(spark, 200, 1).to_numpy()
    assert np.abs(np.diff(fine, axis=0)).max() < 0.2 and np.allclose(fine[::10, ::10], one)


def test_water_by_name(spark, dem):
    labels = api.get_new_depression_hierarchy_labels(spark, 20, 18)
    labels = labels.with_z(F.when(dem.is_edge, 0.0).otherwise(F.col("z")), "rim")
    forest, label, direction = api.get_depression_hierarchy(dem, labels)
    assert label.to_numpy().max() == sum(not d.parts for d in forest.depressions[1:])
    wet, after = api.fill_spill_merge(dem, labels, dem.map(lambda z: F.lit(0.5)))
    assert (wet.to_numpy()[1:-1, 1:-1] >= 0).all() and any(d.water > 0 for d in after.depressions)


def test_command_line(spark, dem, tmp_path, capsys):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    grids.write_ascii(dem, source)
    assert main(["fill", source, target], spark) == 0
    assert np.array_equal(grids.read_ascii(spark, target).to_numpy(), api.FillDepressions(dem).to_numpy())
    for command in ("info", "histogram", "depressions", "depression-hierarchy", "geotransform"):
        assert main([command, source], spark) == 0
    assert main(["compare", source, "--other", target], spark) == 0
    assert "width=20" in capsys.readouterr().out
    assert main(["fill", source], spark) == 2
    assert len(COMMANDS) > 20
