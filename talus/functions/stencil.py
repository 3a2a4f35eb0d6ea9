"""NumPy kernels over a cell and its eight neighbours. Arrays are padded by one, with NaN for NoData."""

from __future__ import annotations

import math

import numpy as np

from talus.functions.topology import DIAGONAL, DX, DY, RUN, codes
from talus.plans.halo import Box, shifted

QUARTER = math.pi / 4


def around(z: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells, and their neighbours by code (entry 0 is the cells)."""
    return shifted(z, 0, 0), [shifted(z, dx, dy) for dx, dy in zip(DX, DY)]


# --- terrain attributes -----------------------------------------------------


def attributes(z: np.ndarray, names: tuple[str, ...], lx: float, ly: float, zscale: float = 1.0) -> dict[str, np.ndarray]:
    """Slope, aspect and curvature of cells; a missing neighbour counts as the cell itself."""
    e, n = around(z * zscale)
    d, a, b, c, f, i, h, g = (np.where(np.isnan(v), e, v) for v in n[1:])
    dzdx = ((c + 2 * f + i) - (a + 2 * d + g)) / 8 / lx
    dzdy = ((g + 2 * h + i) - (a + 2 * b + c)) / 8 / ly
    rise = np.sqrt(dzdx**2 + dzdy**2)
    cd, ce = ((d + f) / 2 - e) / lx / lx, ((b + h) / 2 - e) / lx / lx
    cf, cg, ch = (-a + c + g - i) / 4 / lx / lx, (-d + f) / 2 / lx, (b - h) / 2 / lx
    level = (cg == 0) & (ch == 0)
    squares = np.where(level, 1.0, cg**2 + ch**2)
    out = {}
    for name in names:
        if name == "slope_riserun":
            v = rise
        elif name == "slope_percentage":
            v = rise * 100
        elif name == "slope_radians":
            v = np.arctan(rise)
        elif name == "slope_degrees":
            v = np.arctan(rise) * 180 / math.pi
        elif name == "aspect":
            theta = np.arctan2(dzdy, 0.0 - dzdx) * 180 / math.pi
            v = np.where(theta > 90, 450 - theta, 90 - theta)
            v = np.where((dzdx == 0) & (dzdy == 0), 270.0, v)
        elif name == "curvature":
            v = -2 * (cd + ce) * 100
        elif name == "planform_curvature":
            v = np.where(level, 0.0, -2 * (cd * ch**2 + ce * cg**2 - cf * cg * ch) / squares * 100)
        elif name == "profile_curvature":
            v = np.where(level, 0.0, 2 * (cd * cg**2 + ce * ch**2 + cf * cg * ch) / squares * 100)
        else:
            raise ValueError(f"no such attribute: {name}")
        out[name] = v
    return out


def surface_area(z: np.ndarray, lx: float, ly: float, zscale: float = 1.0) -> np.ndarray:
    """Area of each cell's surface: eight triangles to the midpoints around it."""
    e, n = around(z * zscale)
    n = [np.where(np.isnan(v), e, v) for v in n]
    total = np.zeros_like(e)
    for k in range(1, 9):
        dn, sn = (k, k % 8 + 1) if DIAGONAL[k] else (k % 8 + 1, k)
        to_straight, between = (lx, ly) if DY[sn] == 0 else (ly, lx)
        p = np.hypot(math.hypot(lx, ly), n[dn] - e) / 2
        q = np.hypot(to_straight, n[sn] - e) / 2
        r = np.hypot(between, n[sn] - n[dn]) / 2
        s = (p + q + r) / 2
        total += np.sqrt(np.maximum(s * (s - p) * (s - q) * (s - r), 0))
    if np.any(total < lx * ly - 1e-4):
        raise ValueError("a cell's surface is smaller than its plane")
    return np.maximum(total, lx * ly)


# --- flow metrics: shares by code --------------------------------------------


def lowest(z: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """All to the lowest strictly lower neighbour, the smallest code of equals."""
    e, n = around(z)
    best, code = e.copy(), np.zeros(e.shape, dtype=np.int8)
    for k in codes(neighbours):
        lower = n[k] < best
        best, code = np.where(lower, n[k], best), np.where(lower, k, code).astype(np.int8)
    return np.stack([code == k for k in range(9)]).astype(float)


def spread(z: np.ndarray, exponent: float, contour: bool) -> np.ndarray:
    """Shares by a power of the slope (times the contour length) to each lower neighbour."""
    e, n = around(z)
    share = np.zeros((9, *e.shape))
    for k in range(1, 9):
        with np.errstate(invalid="ignore"):
            drop = np.where(n[k] < e, (e - n[k]) / RUN[k], 0.0)
        # contour lengths of straight and diagonal neighbours
        drop = drop * (0.354 if DIAGONAL[k] else 0.5) if contour else drop
        share[k] = np.where(drop > 0, np.power(np.maximum(drop, 1e-300), exponent), 0.0)
    total = share.sum(axis=0)
    return share / np.where(total > 0, total, 1.0)


def _random(seed: int, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Uniform numbers in (0, 1) by place, the same in every run."""
    h = (x.astype(np.uint64) << np.uint64(32)) ^ y.astype(np.uint64) ^ (np.uint64(n) << np.uint64(60)) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


def randomised(z: np.ndarray, box: Box, neighbours: int, seed: int) -> np.ndarray:
    """All to the steepest of drops with random run lengths, so that long flows keep their bearing on average."""
    e, n = around(z)
    x = np.broadcast_to(np.arange(box.x0, box.x0 + box.width), e.shape)
    y = np.broadcast_to(np.arange(box.y0, box.y0 + box.height)[:, None], e.shape)
    best, code = np.zeros(e.shape), np.zeros(e.shape, dtype=np.int8)
    for k in codes(neighbours):
        with np.errstate(invalid="ignore"):
            drop = np.where(n[k] < e, e - n[k], 0.0)
        u = _random(seed, x, y, k)
        if neighbours == 8 and DIAGONAL[k]:
            drop = drop / (2 - u)
        elif neighbours == 4 and DX[k] == 0:
            drop = drop / (1 / u - 1)
        code = np.where(drop > best, k, code).astype(np.int8)
        best = np.maximum(best, drop)
    return np.stack([code == k for k in range(9)]).astype(float)


#: Facets: the straight and the diagonal neighbour, clockwise from the west.
FACETS = [(1, 2), (3, 2), (3, 4), (5, 4), (5, 6), (7, 6), (7, 8), (1, 8)]


def facets(z: np.ndarray) -> np.ndarray:
    """Shares of the two neighbours that bound the steepest of eight triangular facets."""
    e, n = around(z)
    top, which, angle = np.zeros(e.shape), np.full(e.shape, -1), np.zeros(e.shape)
    with np.errstate(invalid="ignore"):
        for k, (straight, diagonal) in enumerate(FACETS):
            s1, s2 = e - n[straight], n[straight] - n[diagonal]
            r = np.arctan2(s2, s1)
            s = np.where(r < 1e-7, s1, np.where(r > QUARTER - 1e-7, (e - n[diagonal]) / math.sqrt(2), np.hypot(s1, s2)))
            r = np.where(r < 1e-7, 0.0, np.where(r > QUARTER - 1e-7, QUARTER, r))
            better = s > top  # never for NaN
            top, which, angle = np.where(better, s, top), np.where(better, k, which), np.where(better, r, angle)
    share = np.zeros((9, *e.shape))
    # between the two, the straight neighbour's share grows with the angle; on either, that one takes all
    part = np.where(angle == 0, 1.0, np.where(angle == QUARTER, 0.0, angle / QUARTER))
    for k, (straight, diagonal) in enumerate(FACETS):
        own = which == k
        share[straight] += np.where(own, part, 0.0)
        share[diagonal] += np.where(own, 1 - part, 0.0)
    return share


# --- flow directions --------------------------------------------------------


def d8_directions(z: np.ndarray, box: Box) -> np.ndarray:
    """The way to the lowest neighbour, straight ones before diagonal ones; off the grid at its edge. NoData draws flow."""
    e, n = around(np.where(np.isnan(z), -np.inf, z))
    best, code = e.copy(), np.zeros(e.shape, dtype=np.int16)
    for k in range(1, 9):
        better = (n[k] < best) | ((n[k] == best) & (code > 0) & (code % 2 == 0) & (k % 2 == 1))
        best, code = np.where(better, n[k], best), np.where(better, k, code).astype(np.int16)
    out = box.outward()
    return np.where(out > 0, out, code).astype(np.int16)


#: Angle at which each code points, counter-clockwise from the east, in eighths of a turn.
EIGHTH = [0, 4, 3, 2, 1, 0, 7, 6, 5]


def dinf_directions(z: np.ndarray, box: Box) -> np.ndarray:
    """Angle of the steepest facet in [0, 2 pi), off the grid at its edge; 0 also where there is no way down."""
    e, n = around(np.where(np.isnan(z), -1e30, z))
    # counter-clockwise from the east: the straight neighbour's eighth, and which way the angle runs
    order = [(5, 4, 1), (3, 4, -1), (3, 2, 1), (1, 2, -1), (1, 8, 1), (7, 8, -1), (7, 6, 1), (5, 6, -1)]
    top, angle = np.zeros(e.shape), np.zeros(e.shape)
    for straight, diagonal, way in order:
        s1, s2 = e - n[straight], n[straight] - n[diagonal]
        r = np.arctan2(s2, s1)
        s = np.where(r < 0, s1, np.where(r > QUARTER, (e - n[diagonal]) / math.sqrt(2), np.hypot(s1, s2)))
        r = np.clip(r, 0.0, QUARTER)
        base = 8 if (straight, way) == (5, -1) else EIGHTH[straight]
        better = s > top
        top, angle = np.where(better, s, top), np.where(better, way * r + base * QUARTER, angle)
    out = box.outward()
    return np.where(out > 0, np.take(np.array(EIGHTH) * QUARTER, out), angle)


# --- flats ---------------------------------------------------------------


def flats(z: np.ndarray, off_grid: np.ndarray) -> np.ndarray:
    """1 where no neighbour is lower or NoData, 0 else and on the grid's edge; NaN for NoData. off_grid is padded like z."""
    e, n = around(z)
    edge = np.zeros(e.shape, dtype=bool)
    drains = np.zeros(e.shape, dtype=bool)
    with np.errstate(invalid="ignore"):
        for k in range(1, 9):
            edge |= shifted(off_grid, DX[k], DY[k])
            drains |= np.isnan(n[k]) | (n[k] < e)
    return np.where(np.isnan(e), np.nan, np.where(edge | drains, 0.0, 1.0))
