"""Depression hierarchy and water in it, against plain definitions on random grids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions.hierarchy import Depression, Forest
from talus.operators import hierarchy
from talus.raster import Raster

AROUND = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def filled(z):
    """Lowest level over all paths to the rim, by repeated relaxation."""
    out = np.full(z.shape, np.inf)
    out[[0, -1]], out[:, [0, -1]] = z[[0, -1]], z[:, [0, -1]]
    while True:
        before = out.copy()
        padded = np.pad(out, 1, constant_values=np.inf)
        low = np.min([padded[1 + dy : 1 + dy + z.shape[0], 1 + dx : 1 + dx + z.shape[1]] for dx, dy in AROUND], axis=0)
        out = np.minimum(out, np.maximum(z, low))
        if np.array_equal(out, before):
            return out


def rim(dem):
    w, h = dem.meta.width, dem.meta.height
    return (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == w - 1) | (F.col("y") == h - 1)


def lower_rim(z):
    """The rim is the ocean, below all land."""
    z = z.copy()
    z[[0, -1]], z[:, [0, -1]] = -1.0, -1.0
    return z


@pytest.fixture(params=[1, 2])
def z(request):
    return lower_rim(np.random.default_rng(request.param).integers(0, 9, (14, 17)).astype(float))


def test_seeds(spark, z):
    dem = Raster.from_numpy(spark, z, -9999.0)
    got = {(r.x, r.y): r.kind for r in hierarchy.seeds(dem, rim(dem)).collect()}
    h, w = z.shape
    for y in range(h):
        for x in range(w):
            sea = x in (0, w - 1) or y in (0, h - 1)
            near = [(x + dx, y + dy) for dx, dy in AROUND if 0 <= x + dx < w and 0 <= y + dy < h]
            if sea:
                want = int(any(0 < a < w - 1 and 0 < b < h - 1 for a, b in near))
            else:
                want = 2 * int(all(z[b, a] >= z[y, x] for a, b in near))
            assert got.get((x, y), 0) == want


def test_volumes_are_what_filling_adds(spark, z):
    dem = Raster.from_numpy(spark, z, -9999.0)
    _, forest = hierarchy.hierarchy(dem, rim(dem))
    whole = sum(d.volume for d in forest.depressions[1:] if d.to_ocean)
    assert whole == pytest.approx((filled(z) - z).sum())
    for d in forest.depressions[1:]:
        assert d.to_ocean != (d.parent > 0)
        for p in d.parts or ():
            assert forest.depressions[p].parent == d.label and forest.depressions[p].out_elevation <= d.out_elevation
    assert forest.text().count("\n") + 1 == len(forest.depressions) - 1
    assert hierarchy.table(spark, forest).count() == len(forest.depressions) - 1


@pytest.mark.parametrize("rain", [0.0, 0.05, 0.4, 1.5, 50.0])
def test_water(spark, z, rain):
    dem = Raster.from_numpy(spark, z, -9999.0)
    wet, forest = hierarchy.fill_spill_merge(dem, dem.map(lambda c: F.lit(rain)), rim(dem))
    stands = wet.to_numpy()
    level = z + stands
    assert (stands >= 0).all() and (level <= filled(z) + 1e-9).all()
    assert stands.sum() == pytest.approx(sum(v for v in {top: v for _, top, v in forest.surfaces()}.values()))
    assert stands.sum() <= rain * z.size + 1e-9
    if rain == 50.0:
        assert np.allclose(level, filled(z))
    # a water surface is level: wet neighbours stand alike
    for y in range(1, z.shape[0] - 1):
        for x in range(1, z.shape[1] - 1):
            for dx, dy in AROUND:
                if stands[y, x] > 1e-9 and stands[y + dy, x + dx] > 1e-9:
                    assert level[y, x] == pytest.approx(level[y + dy, x + dx])


def test_deficits_take_their_part(spark):
    z = lower_rim(np.full((5, 9), 5.0))
    z[2, 2:7] = [1, 2, 3, 2, 1]
    dem = Raster.from_numpy(spark, z, -9999.0)
    water = np.zeros(z.shape)
    water[2, 2], water[2, 6] = 6.0, -0.5
    wet, forest = hierarchy.fill_spill_merge(dem, Raster.from_numpy(spark, water, -9999.0), rim(dem))
    got = wet.to_numpy()[2, 2:7]
    # the left pit holds 2 + 1 up to the pass at 3; the rest goes over into the right one, less what the ground takes there
    assert got[0] == pytest.approx(2.0) and got[1] == pytest.approx(1.0)
    assert got[2:].sum() + got[:2].sum() == pytest.approx(5.5)


def test_worked_forest():
    """Two basins that meet at 4 and spill at 6."""
    forest = Forest.merged(2, [(4.0, 1, 2, 5, 5), (6.0, 0, 1, 1, 1), (7.0, 0, 2, 9, 9)])
    forest.measure({1: (3, 6.0), 2: (2, 7.0), 3: (4, 20.0)})
    one, two, both = forest.depressions[1:]
    assert (one.volume, two.volume, both.volume) == (3 * 4 - 6, 2 * 4 - 7, 9 * 6 - 33)
    assert both.to_ocean and both.lands_in == 0 and one.neighbour == 2 and one.lands_in == 2
    assert forest.pour(1, 6.5) == 0 and (one.water, two.water) == (6.0, 0.5)
    assert forest.pour(1, 2.5) == 0 and both.water == 9.0
    assert forest.surfaces() == [(1, 3, 9.0), (2, 3, 9.0)]
    assert forest.pour(2, 100.0) == pytest.approx(88.0) and both.water == both.volume


def test_no_land(spark):
    dem = Raster.from_numpy(spark, np.full((3, 3), -9999.0), -9999.0)
    _, forest = hierarchy.hierarchy(dem)
    assert len(forest.depressions) == 1 and forest.surfaces() == [] and isinstance(forest.depressions[0], Depression)
