"""Kernels for flats on whole arrays: groups of equal height and gradients away from high and towards low ground."""

from __future__ import annotations

import numpy as np

from talus.functions.topology import DX, DY
from talus.plans.halo import shifted


def edge_kinds(z: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """1: drains and has a flat neighbour of its height; 2: flat with a higher neighbour; 0: neither. Both padded by one."""
    e, f = shifted(z, 0, 0), shifted(flat, 0, 0)
    low, high = np.zeros(e.shape, dtype=bool), np.zeros(e.shape, dtype=bool)
    with np.errstate(invalid="ignore"):
        for n in range(1, 9):
            nz, nf = shifted(z, DX[n], DY[n]), shifted(flat, DX[n], DY[n])
            low |= (f == 0) & (nf == 1) & (nz == e)
            high |= (f == 1) & (e < nz)
    return np.where(low, 1, np.where(high, 2, 0))


def equal_groups(z: np.ndarray) -> np.ndarray:
    """The smallest flat id among the cells of the same height that a cell is joined to."""
    h, w = z.shape
    label = np.arange(h * w).reshape(h, w)
    zp = np.pad(z, 1, constant_values=np.nan)
    while True:
        new = label
        lp = np.pad(label, 1, constant_values=h * w)
        for n in range(1, 9):
            same = shifted(zp, DX[n], DY[n]) == z
            new = np.where(same, np.minimum(new, shifted(lp, DX[n], DY[n])), new)
        flat = new.ravel()
        flat = flat[flat]  # pointer jumping
        new = flat[flat].reshape(h, w)
        if np.array_equal(new, label):
            return label
        label = new


def _distance(start: np.ndarray, flat: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Steps from the start cells (1 there) through flat cells of the same group; 0 where none lead."""
    h, w = start.shape
    out = np.zeros((h, w), dtype=np.int64)
    front, k = np.flatnonzero(start), 1
    flat, label, seen = flat.ravel(), label.ravel(), out.ravel()
    while len(front):
        seen[front] = k
        y, x = np.divmod(front, w)
        nexts = []
        for n in range(1, 9):
            ny, nx = y + DY[n], x + DX[n]
            ok = (ny >= 0) & (nx >= 0) & (ny < h) & (nx < w)
            to = ny[ok] * w + nx[ok]
            nexts.append(to[flat[to] & (seen[to] == 0) & (label[to] == label[front[ok]])])
        front, k = np.unique(np.concatenate(nexts)), k + 1
    return seen.reshape(h, w)


def mask(z: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, label): increments that make each flat drain, and the group of each cell (-1: none that drains)."""
    kinds = edge_kinds(np.pad(z, 1, constant_values=np.nan), np.pad(flat, 1, constant_values=np.nan))
    low = kinds == 1
    if not low.any():
        return np.zeros(z.shape, dtype=np.int64), np.full(z.shape, -1)
    label = equal_groups(z)
    drained = np.isin(label, np.unique(label[low]))
    label = np.where(drained, label, -1)
    is_flat = flat == 1
    away = _distance((kinds == 2) & drained, is_flat, label)
    height = np.zeros(z.size, dtype=np.int64)
    np.maximum.at(height, np.where(label >= 0, label, 0).ravel(), np.where(label >= 0, away, 0).ravel())
    towards = _distance(low, is_flat, label)
    lift = np.where(away > 0, height[np.maximum(label, 0)] - away, 0)
    return np.where(towards > 0, lift + 2 * towards, -away), label


def raised(z: np.ndarray, by: np.ndarray) -> np.ndarray:
    """z moved up by so many floating-point numbers."""
    bits = (z + 0.0).view(np.int64)
    ordered = np.where(bits < 0, np.int64(-(2**63)) - bits, bits) + by
    return np.where(ordered < 0, np.int64(-(2**63)) - ordered, ordered).view(np.float64)
