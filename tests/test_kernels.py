"""Kernels and tiled operators against plain definitions on random grids."""

import heapq

import numpy as np
import pytest

from talus.functions import flats as flat_kernels
from talus.functions import flood as K
from talus.functions import stencil
from talus.operators import accumulate, flats, flood, flow
from talus.raster import Raster
from talus.sources import grids, layout

AROUND = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def minimax(z):
    """Dijkstra: the least over all paths to the rim of the greatest elevation."""
    h, w = z.shape
    best = np.full(z.shape, np.inf)
    heap = [(z[y, x], y, x) for y in range(h) for x in range(w) if y in (0, h - 1) or x in (0, w - 1)]
    for v, y, x in heap:
        best[y, x] = v
    heapq.heapify(heap)
    while heap:
        v, y, x = heapq.heappop(heap)
        if v > best[y, x]:
            continue
        for dx, dy in AROUND:
            b, a = y + dy, x + dx
            if 0 <= b < h and 0 <= a < w and max(v, z[b, a]) < best[b, a]:
                best[b, a] = max(v, z[b, a])
                heapq.heappush(heap, (best[b, a], b, a))
    return best


@pytest.fixture
def z():
    return np.random.default_rng(5).integers(0, 30, (37, 45)).astype(float)


def test_fill_kernel(z):
    assert np.array_equal(K.filled(z), minimax(z))


def test_fill_in_tiles(spark, z):
    r = Raster.from_numpy(spark, z, -9999.0)
    assert np.array_equal(flood.fill(r, tile=16).to_numpy(), minimax(z))


def test_breached_drains(spark, z):
    r = Raster.from_numpy(spark, z, -9999.0)
    cut = flood.breach(r).to_numpy()
    assert (cut <= np.maximum(z, minimax(z))).all()
    assert not flood.has_depressions(Raster.from_numpy(spark, cut, -9999.0))


def test_epsilon_fill_leaves_no_inner_flat(spark, z):
    out = flood.fill_epsilon(Raster.from_numpy(spark, z, -9999.0)).to_numpy()
    for y in range(1, z.shape[0] - 1):
        for x in range(1, z.shape[1] - 1):
            assert min(out[y + dy, x + dx] for dx, dy in AROUND) < out[y, x]
    assert (out >= z).all()


def test_accumulation_keeps_the_total(spark, z):
    r = Raster.from_numpy(spark, minimax(z), -9999.0)
    for method, exponent in (("D8", None), ("Freeman", 1.1), ("Dinfinity", None)):
        edges = flow.edges(r, method, exponent)
        a = accumulate.accumulation(r, method, exponent, tile=16).to_numpy()
        gone = {(e.x, e.y) for e in edges.collect()}
        ends = sum(a[y, x] for y in range(z.shape[0]) for x in range(z.shape[1]) if (x, y) not in gone)
        assert ends == pytest.approx(z.size)


@pytest.mark.parametrize("tile", [1, 5, 16, 64])
def test_area_of_any_directions(spark, tile):
    """Random directions have loops, in tiles and across them; loops keep what comes from outside."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 9, (21, 34)).astype(float)
    codes[rng.random(codes.shape) < 0.05] = -9999.0
    codes[4, 3:30], codes[5, 4:31], codes[4, 30], codes[5, 3] = 5, 1, 7, 3  # a long ring
    step = {1: (-1, 0), 2: (-1, -1), 3: (0, -1), 4: (1, -1), 5: (1, 0), 6: (1, 1), 7: (0, 1), 8: (-1, 1)}
    cells = {(x, y) for y in range(21) for x in range(34) if codes[y, x] >= 0}
    to = {(x, y): (x + step[codes[y, x]][0], y + step[codes[y, x]][1]) for x, y in cells if codes[y, x] > 0}
    to = {c: t for c, t in to.items() if t in cells}

    def way(c):
        seen = [c]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        return seen

    ring = {c for c in cells if c in to and to.get(way(c)[-1]) == c}
    assert len(ring) >= 54
    want = dict.fromkeys(cells, 0)
    for c in cells:
        for d in way(c):
            want[d] += 1
            if d in ring:
                break
    r = Raster.from_numpy(spark, codes, -9999.0)
    found = {(c.x, c.y): c.z for c in accumulate.d8_area(r, tile).cells.where("z IS NOT NULL").collect()}
    assert found == want


def test_flats_resolve(spark, z):
    r = Raster.from_numpy(spark, np.floor(z / 6), -9999.0)
    level = flood.fill(r)
    out = flats.resolve_epsilon(level).to_numpy()
    assert (out >= level.to_numpy()).all() and (out - level.to_numpy()).max() < 1e-9


def test_no_data_drains(spark):
    z = np.full((7, 7), 5.0)
    z[2:5, 2:5] = 1.0
    z[3, 3] = -9999.0
    out = flood.fill(Raster.from_numpy(spark, z, -9999.0)).to_numpy()
    assert np.array_equal(out, z)


def test_empty_and_single(spark):
    one = Raster.from_numpy(spark, np.array([[4.0]]), -1.0)
    assert flood.fill(one).to_numpy().tolist() == [[4.0]]
    assert accumulate.accumulation(one, "D8").to_numpy().tolist() == [[1.0]]


def test_ascii_round_trip(spark, tmp_path, z):
    r = Raster.from_numpy(spark, z, -9999.0)
    grids.write_ascii(r, str(tmp_path / "grid"))
    assert np.array_equal(grids.read_ascii(spark, str(tmp_path / "grid")).to_numpy(), z)


def test_tiles_round_trip(spark, tmp_path, z):
    r = Raster.from_numpy(spark, z, -9999.0)
    grids.write_tiles(r, str(tmp_path / "tiles"), 16)
    assert np.array_equal(grids.read_tiles(spark, str(tmp_path / "tiles"), r.meta, tile=16).to_numpy(), z)


def test_largest_square():
    assert layout.largest_square([[True, True, False], [True, True, True], [False, True, True]])[0] == 2


def test_mismatched_sizes(spark):
    a, b = Raster.filled(spark, 3, 3, 1.0), Raster.filled(spark, 4, 3, 1.0)
    assert not a.equals(b)
    with pytest.raises(ValueError):
        a.diff_stats(b)


def test_flood_directions_lead_out(spark, z):
    """Each cell's way leads to the rim, never over a cell that is filled higher than itself."""
    r = Raster.from_numpy(spark, z, -9999.0)
    code, level = flood.flood_directions(r).to_numpy(), minimax(z)
    step = dict(enumerate([(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)], 1))
    h, w = z.shape
    for y in range(h):
        for x in range(w):
            a, b, n = x, y, 0
            while 0 < a < w - 1 and 0 < b < h - 1:
                dx, dy = step[int(code[b, a])]
                assert level[b + dy, a + dx] <= level[b, a]
                a, b, n = a + dx, b + dy, n + 1
                assert n < z.size


def test_watersheds_are_whole(spark, z):
    """Each label is one connected area with the cell that names it on the rim."""
    label = flood.watersheds(Raster.from_numpy(spark, z, -9999.0)).to_numpy().astype(int)
    h, w = z.shape
    for k in np.unique(label):
        y0, x0 = divmod(int(k), w)
        seen, todo = {(y0, x0)}, [(y0, x0)]
        while todo:
            y, x = todo.pop()
            for dx, dy in AROUND:
                q = (y + dy, x + dx)
                if 0 <= q[0] < h and 0 <= q[1] < w and label[q] == k and q not in seen:
                    seen.add(q)
                    todo.append(q)
        assert len(seen) == (label == k).sum()


@pytest.mark.parametrize("method", ["Rho8", "Rho4"])
def test_rho(spark, z, method):
    """One way for each inner cell with lower ground beside it, to lower ground, the same for a seed and not for all seeds."""
    r = Raster.from_numpy(spark, z, -9999.0)
    found = [{(e.x, e.y): (e.nx, e.ny, e.p) for e in flow.edges(r, method, seed=s).collect()} for s in (1, 1, 2)]
    assert found[0] == found[1] and found[0] != found[2]
    near = [s for s in AROUND if method == "Rho8" or 0 in s]
    for y in range(1, z.shape[0] - 1):
        for x in range(1, z.shape[1] - 1):
            lower = {(x + dx, y + dy) for dx, dy in near if z[y + dy, x + dx] < z[y, x]}
            way = found[0].get((x, y))
            assert (way is None) == (not lower) and (way is None or (way[:2] in lower and way[2] == 1.0))


def walked(starts, inside, same):
    """Steps from the starts (1 there) through the inside cells of the same group."""
    out, front = {q: 1 for q in starts}, list(starts)
    while front:
        new = []
        for x, y in front:
            for dx, dy in AROUND:
                q = (x + dx, y + dy)
                if q in inside and q not in out and same[q] == same[x, y]:
                    out[q] = out[x, y] + 1
                    new.append(q)
        front = new
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_flat_mask(spark, seed):
    """Gradients by walks from the edges of each flat."""
    z = np.random.default_rng(seed).integers(0, 3, (13, 15)).astype(float)
    h, w = z.shape
    cells = [(x, y) for y in range(h) for x in range(w)]
    near = {(x, y): [(x + dx, y + dy) for dx, dy in AROUND if 0 <= x + dx < w and 0 <= y + dy < h] for x, y in cells}
    height = {(x, y): z[y, x] for x, y in cells}
    flat = {q for q in cells if len(near[q]) == 8 and not any(height[n] < height[q] for n in near[q])}
    low = {q for q in cells if q not in flat and any(n in flat and height[n] == height[q] for n in near[q])}
    high = {q for q in flat if any(height[n] > height[q] for n in near[q])}
    group = {}
    for q in cells:
        if q not in group:
            group[q], todo = q[1] * w + q[0], [q]
            while todo:
                for n in near[todo.pop()]:
                    if n not in group and height[n] == height[q]:
                        group[n] = group[q]
                        todo.append(n)
    drained = {group[q] for q in low}
    away = walked({q for q in high if group[q] in drained}, flat, group)
    towards = walked(low, flat, group)
    top = {}
    for q, k in away.items():
        top[group[q]] = max(top.get(group[q], 0), k)
    want = {}
    for q in cells:
        inside = group[q] in drained
        lift = top[group[q]] - away[q] if q in away else 0
        want[q] = (lift + 2 * towards[q] if q in towards else -away.get(q, 0), group[q] if inside else None)
    got = {(r.x, r.y): (r["mask"], r.label) for r in flats.flat_mask(Raster.from_numpy(spark, z, -9999.0)).collect()}
    assert got == want


@pytest.fixture
def flat_ground(spark):
    """Plateaus with holes; the raster, and mask and label of each cell."""
    rng = np.random.default_rng(3)
    z = np.floor(rng.random((26, 31)) * 2.2) + (np.arange(31) > 15)
    z[rng.random(z.shape) < 0.02] = -9999.0
    z[10:14, 4:12] = 1
    r = Raster.from_numpy(spark, z, -9999.0)
    return r, {(c.x, c.y): (c.mask, c.label) for c in flats.flat_mask(r).collect()}


def _values(raster):
    return {(c.x, c.y): c.z for c in raster.cells.collect()}


def test_directions_in_flats(spark, flat_ground):
    """D8: the neighbour of the same flat with the least mask; straight before diagonal, then by code."""
    r, of = flat_ground
    before, after, changed = _values(flow.d8_directions(r)), _values(flats.d8_with_flats(r)), 0
    codes = {step: k for k, step in zip((2, 3, 4, 1, 5, 8, 7, 6), AROUND)}
    for (x, y), z in before.items():
        want = z
        if z == 0 and 0 < x < 30 and 0 < y < 25:
            mask, label = of[x, y]
            near = [(of[x + dx, y + dy][0], k % 2 == 0, k) for (dx, dy), k in codes.items() if of[x + dx, y + dy][1] == label]
            lower = [n for n in near if n[0] < mask]
            want = min(lower)[2] if lower else 0
            changed += want > 0
        assert after[x, y] == want
    assert changed > 50


def test_dinf_directions_in_flats(spark, flat_ground):
    """What flows within a flat stays in it and goes down the mask."""
    r, of = flat_ground
    before, found = _values(flow.dinf_directions(r)), flats.dinf_with_flats(r)
    after, to = _values(found), {}
    for e in flow.edges_of_dinf(found).collect():
        to.setdefault((e.x, e.y), []).append((e.nx, e.ny, e.p))
    changed = 0
    for c, z in before.items():
        if after[c] == z:
            continue
        assert z == 0
        changed += 1
        mask, label = of[c]
        ends = [of[nx, ny] for nx, ny, p in to[c] if p > 1e-9]
        assert ends and all(b == label for _, b in ends) and all(a <= mask for a, _ in ends) and min(a for a, _ in ends) < mask
    assert changed > 50


@pytest.mark.parametrize("tile", [3, 8, 64])
def test_flat_mask_in_tiles(spark, flat_ground, tile):
    """As on the whole array at once."""
    r, _ = flat_ground
    z = r.to_numpy()
    z[z == -9999.0] = np.nan
    off = np.pad(np.zeros(z.shape, dtype=bool), 1, constant_values=True)
    mask, label = flat_kernels.mask(z, stencil.flats(np.pad(z, 1, constant_values=np.nan), off))
    found = flats.flat_mask(r, tile).collect()
    assert len(found) == z.size
    for c in found:
        assert (c.mask, -1 if c.label is None else c.label) == (mask[c.y, c.x], label[c.y, c.x])
