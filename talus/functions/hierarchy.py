"""Kernels of the depression hierarchy: basins on one array, and the forest of depressions over their outlets."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

from talus.functions.flood import Grid
from talus.functions.topology import codes

OCEAN = 0


def seeds(z: np.ndarray, ocean: np.ndarray, neighbours: int = 8) -> np.ndarray:
    """1: ocean beside land; 2: land with no lower neighbour on land or in the ocean; 0: neither. NoData is ocean."""
    g = Grid(np.where(ocean | np.isnan(z), np.nan, z))
    sea = ~g.data & g.inside
    height = np.where(sea, -np.inf, np.where(g.data, g.z, np.inf))
    lowest = np.full(len(height), np.inf)
    coast = np.zeros(len(height), dtype=bool)
    for s in g.steps(neighbours):
        lowest = np.minimum(lowest, np.roll(height, -s))
        coast |= np.roll(g.data, -s)
    return g.core(np.where(sea & coast, 1, np.where(g.data & (lowest >= g.z), 2, 0)))


def basins(z: np.ndarray, ocean: np.ndarray, neighbours: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, direction, rank): 0 for the ocean and what drains to it, 1, 2, ... for basins in the order of their pits.

    A direction is the code of the neighbour that a cell drains to, 0 in pits and
    in the ocean. Cells drain to ones of a lower rank.
    """
    kind = np.pad(seeds(z, ocean, neighbours), 1).ravel()
    g = Grid(np.where(ocean | np.isnan(z), -np.inf, z))
    land = np.pad(~(ocean | np.isnan(z)), 1).ravel()
    height, label = g.z.tolist(), np.where(land | ~g.inside, -1, OCEAN).tolist()
    direction, rank = [0] * len(height), [-1] * len(height)
    queue = [(height[i], k, i) for k, i in enumerate(np.flatnonzero(kind).tolist())]
    heapq.heapify(queue)
    arrived, done, pits = len(queue), 0, 0
    around = [(s, 1 + (n + 3) % 8) for n, s in zip(codes(neighbours), g.steps(neighbours))]  # and the code of the way back
    free = land.tolist()
    while queue:
        _, _, i = heapq.heappop(queue)
        if label[i] < 0:
            pits += 1
            label[i] = pits
        rank[i], done = done, done + 1
        for s, back in around:
            j = i + s
            if free[j] and label[j] < 0 and not (kind[j] and rank[j] < 0 and height[j] < height[i]):
                label[j], direction[j] = label[i], back
                if not kind[j]:
                    heapq.heappush(queue, (height[j], arrived, j))
                    arrived += 1
    return tuple(g.core(np.array(a)) for a in (label, direction, rank))


def into_pits(z: np.ndarray, label: np.ndarray, direction: np.ndarray, rank: np.ndarray, water: np.ndarray, steps: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(what stays on the cells, water of each label): surpluses move down, deficits on the way take their part of them."""
    held = water.astype(float).copy().ravel()
    w = z.shape[1]
    flat, way, order = label.ravel(), direction.ravel(), np.argsort(rank.ravel())[::-1]
    arrived = np.zeros(int(label.max()) + 1 if label.size else 1)
    for i in order[rank.ravel()[order] >= 0].tolist():
        if held[i] > 0:
            if way[i]:
                dx, dy = steps[int(way[i])]
                held[i + dy * w + dx] += held[i]
            else:
                arrived[max(flat[i], 0)] += held[i]
            held[i] = 0.0
    held[(flat == OCEAN) & (way == 0)] = 0.0
    return held.reshape(z.shape), arrived


@dataclass
class Depression:
    """A basin, or two depressions under one water level. Volumes hold what its parts hold as well."""

    label: int
    parent: int = -1
    parts: tuple[int, int] | None = None
    out_elevation: float = float("inf")
    out_x: int = -1
    out_y: int = -1
    #: The depression that it spills into, and the basin in it where that water lands.
    neighbour: int = -1
    lands_in: int = -1
    to_ocean: bool = False
    cells: int = 0
    elevation: float = 0.0
    volume: float = 0.0
    water: float = 0.0


@dataclass
class Forest:
    depressions: list[Depression] = field(default_factory=list)

    @staticmethod
    def merged(basins: int, outlets: list[tuple[float, int, int, int, int]]) -> Forest:
        """outlets: (elevation, label, label, x, y) of the lowest pass between two basins each. Lower ones join first."""
        made = [Depression(k) for k in range(basins + 1)]
        top = list(range(basins + 1))

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        for elevation, a, b, x, y in sorted(outlets):
            one, two = find(a), find(b)
            if one == two:
                continue
            if OCEAN in (one, two):
                inner, lands = (two, a) if one == OCEAN else (one, b)
                d = made[inner]
                d.to_ocean, d.parent, d.neighbour, d.lands_in = True, OCEAN, OCEAN, lands
                joined = [d]
                top[inner] = OCEAN
            else:
                new = Depression(len(made), parts=(one, two))
                made.append(new)
                top.append(new.label)
                for own, other, lands in ((one, two, b), (two, one, a)):
                    made[own].parent, made[own].neighbour, made[own].lands_in = new.label, other, lands
                    top[own] = new.label
                joined = [made[one], made[two]]
            for d in joined:
                d.out_elevation, d.out_x, d.out_y = elevation, x, y
        return Forest(made)

    def home(self, label: int, elevation: float) -> int:
        """The lowest depression around a cell of a basin whose outlet isn't below the cell; the ocean if there is none."""
        k = label
        while k != OCEAN and elevation > self.depressions[k].out_elevation:
            k = OCEAN if self.depressions[k].to_ocean else self.depressions[k].parent
        return max(k, OCEAN)

    def measure(self, own: dict[int, tuple[int, float]]) -> None:
        """own: number and sum of elevations of the cells at home in each depression. Parts come before what they make up."""
        for d in self.depressions[1:]:
            n, total = own.get(d.label, (0, 0.0))
            inner = [self.depressions[p] for p in d.parts or ()]
            d.cells = n + sum(p.cells for p in inner)
            d.elevation = total + sum(p.elevation for p in inner)
            d.volume = d.cells * d.out_elevation - d.elevation if d.cells else 0.0

    def full(self, k: int) -> bool:
        return self.depressions[k].water >= self.depressions[k].volume

    def pour(self, k: int, amount: float) -> float:
        """Water into a basin, and over its outlets where it doesn't hold it; what reaches the ocean."""
        while amount > 0:
            if k == OCEAN:
                return amount
            d = self.depressions[k]
            if d.parts:  # reached only when both parts are full
                d.water = max(d.water, sum(self.depressions[p].water for p in d.parts))
            held = min(max(d.volume - d.water, 0.0), amount)
            # what rounds away leaves no outlet half open
            d.water = d.volume if held < amount else d.water + held
            amount -= held
            if amount > 0:
                k = d.lands_in if d.to_ocean or not self.full(d.neighbour) else d.parent
                if k < 0:
                    return amount
        return 0.0

    def surfaces(self) -> list[tuple[int, int, float]]:
        """(basin, depression, water) of every basin: the largest depression around it that has one water level."""
        out, todo = [], [(d.label, d.label) for d in self.depressions[1:] if d.to_ocean or d.parent < 0]
        while todo:
            k, top = todo.pop()
            d = self.depressions[k]
            level = top if top != k or not d.parts or (all(map(self.full, d.parts)) and d.water > 0) else None
            if not d.parts:
                out.append((k, top, self.depressions[top].water))
            else:
                todo += [(p, p if level is None else level) for p in d.parts]
        return sorted(out)

    def text(self) -> str:
        """The forest as an indented list."""
        lines, todo = [], [(d.label, 0) for d in reversed(self.depressions[1:]) if d.to_ocean or d.parent < 0]
        while todo:
            k, depth = todo.pop()
            d = self.depressions[k]
            lines.append(f"{'  ' * depth}{k}: out at {d.out_elevation:g} to {d.neighbour}, {d.cells} cells, volume {d.volume:g}, water {d.water:g}")
            todo += [(p, depth + 1) for p in reversed(d.parts or ())]
        return "\n".join(lines)
