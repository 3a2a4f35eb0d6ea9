"""Flow accumulation and traversals of the flow graph.

Accumulation is linear, so each tile sums its own cells in order of flow and
hands on what leaves it, and what comes in is passed down the same way. Edges
are dealt to tiles once and stay there.

Where a cell flows to one other (D8, D4 and their random forms) there are two
passes: the first also tells through which border cell a tile lets out what
comes in at each of its own, so that only cells at borders are left to solve,
by pointer doubling in log2 of their number rounds. Where flow divides, tiles
that got something pass it on until nothing crosses a border: rounds are the
tiles along the longest path, not its cells.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talus.functions.topology import DX, DY, codes
from talus.operators import flow
from talus.plans.checkpoints import cut
from talus.plans.halo import TILE, over_tiles, shifted
from talus.raster import Raster

MAX_ROUNDS = 10_000


SWEPT = "x int, y int, w double, kind int, next long"


def _swept(ids: np.ndarray, w: np.ndarray, kind: np.ndarray, after: np.ndarray, width: int) -> pa.Table:
    return pa.table({"x": (ids % width).astype(np.int32), "y": (ids // width).astype(np.int32), "w": w, "kind": kind.astype(np.int32), "next": pa.array(after, pa.int64(), mask=after < 0)})


def _links(edges: pa.Table, width: int, tile: int) -> pa.Table:
    """kind 2: border cells of a tile whose flow, to one cell each, leaves it, and where to."""
    x, y, nx, ny, inner = (edges.column(c).to_numpy() for c in ("x", "y", "nx", "ny", "nx_in"))
    source, target = y.astype(np.int64) * width + x, ny.astype(np.int64) * width + nx
    cells = np.unique(np.concatenate((source, target[inner])))
    at, out = np.arange(len(cells)), np.full(len(cells), -1, dtype=np.int64)
    s = np.searchsorted(cells, source)
    at[s[inner]] = np.searchsorted(cells, target[inner])
    out[s[~inner]] = target[~inner]
    for _ in range(len(cells).bit_length()):
        at = at[at]
    out = out[at]  # cells on a loop in the tile have no way out
    cx, cy = cells % width % tile, cells // width % tile
    rim = ((cx == 0) | (cy == 0) | (cx == tile - 1) | (cy == tile - 1)) & (out >= 0)
    return _swept(cells[rim], np.zeros(rim.sum()), np.full(rim.sum(), 2), out[rim], width)


def _sweep(edges: pa.Table, given: pa.Table, width: int) -> pa.Table:
    """Passes what is given down the tile's edges; kind 0: what each cell passed or kept, 1: what left the tile."""
    if not len(given):
        none = np.zeros(0, dtype=np.int64)
        return _swept(none, none.astype(float), none, none, width)
    names = ["x", "y", "nx", "ny", "p", "nx_in"]
    x, y, nx, ny, p, inner = (edges.column(c).to_numpy() for c in names)
    gx, gy, gw = (given.column(c).to_numpy() for c in ("x", "y", "w"))
    source, target, start = y.astype(np.int64) * width + x, ny.astype(np.int64) * width + nx, gy.astype(np.int64) * width + gx
    cells = np.unique(np.concatenate((source, target[inner], start)))
    total = np.zeros(len(cells))
    np.add.at(total, np.searchsorted(cells, start), gw)
    s = np.searchsorted(cells, source)
    inside = np.flatnonzero(inner)
    t = np.searchsorted(cells, target[inside])
    waits = np.bincount(t, minlength=len(cells))
    order = np.argsort(s, kind="stable")
    inside_order = inside[np.argsort(s[inside], kind="stable")]
    first = np.searchsorted(s[inside_order], np.arange(len(cells) + 1))
    ready = np.flatnonzero(waits == 0)
    where = np.full(len(edges), -1, dtype=np.int64)
    where[inside] = t
    done = np.zeros(len(cells), dtype=bool)
    while len(ready):
        done[ready] = True
        counts = first[ready + 1] - first[ready]
        picks = inside_order[np.repeat(first[ready] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())]
        to = where[picks]
        np.add.at(total, to, total[s[picks]] * p[picks])
        np.subtract.at(waits, to, 1)
        touched = np.unique(to)
        ready = touched[waits[touched] == 0]
    leaves = order[~inner[order] & done[s[order]]]
    keep = total != 0
    ids, w = np.concatenate((cells[keep], target[leaves])), np.concatenate((total[keep], total[s[leaves]] * p[leaves]))
    return _swept(ids, w, np.repeat([0, 1], [keep.sum(), len(leaves)]), np.full(len(ids), -1), width)


def _at_borders(amounts: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What comes in at each border cell (id, s), and the cells (id) on loops across tiles, if any; then the first is void.

    amounts: id, w, what tiles give of their own; links: id, next. After k rounds s holds all from less than 2**k steps above.
    """
    now = cut(amounts.join(links, "id", "left").select("id", "next", F.col("w").alias("s")))
    n, steps = now.count(), 1
    while not now.where("next IS NOT NULL").isEmpty():
        if steps > n:
            return now, now.where("next IS NOT NULL").select(F.col("next").alias("id")).distinct()
        above = now.where("next IS NOT NULL").groupBy(F.col("next").alias("id")).agg(F.sum("s").alias("more"))
        hop = now.select(F.col("id").alias("next"), F.col("next").alias("after"))
        now = cut(now.join(above, "id", "left").join(hop, "next", "left").select("id", F.col("after").alias("next"), (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s")))
        steps *= 2
    return now, None


def _in_tile(c: str, tile: int) -> Column:
    return F.floor(F.col(c) / tile).cast("int")


def _over(dealt: DataFrame, given: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str, tile: int) -> DataFrame:
    """kernel(edges, given) of each tile."""
    at = given.withColumn("tx", _in_tile("x", tile)).withColumn("ty", _in_tile("y", tile))
    return cut(dealt.groupBy("tx", "ty").cogroup(at.groupBy("tx", "ty")).applyInArrow(lambda a, b: kernel(a, b), schema))


def _two_passes(dealt: DataFrame, given: DataFrame, width: int, tile: int) -> DataFrame:
    """x, y, w, in parts to be added up, where each cell flows to one other."""

    def first(edges: pa.Table, own: pa.Table) -> pa.Table:
        return pa.concat_tables((_sweep(edges, own, width), _links(edges, width, tile)))

    made = _over(dealt, given, first, SWEPT, tile)
    here, out = made.where("kind = 0").select("x", "y", "w"), made.where("kind = 1")
    if out.isEmpty():
        return here
    cell = (F.col("y").cast("long") * width + F.col("x")).alias("id")
    place = lambda df, *more: df.select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"), *more)
    came, on_loops = _at_borders(out.groupBy(cell).agg(F.sum("w").alias("w")), made.where("kind = 2").select(cell, "next"))
    if on_loops is not None:
        # a loop's cells don't pass anything on, in whatever tile they lie
        ring = _over(dealt, place(on_loops), lambda a, b: _walk(a, b, width), "x int, y int, kind int", tile).where("kind = 0")
        return _two_passes(cut(dealt.join(ring.select("x", "y").distinct(), ["x", "y"], "left_anti")), given, width, tile)
    passed = _over(dealt, place(came.where("s <> 0"), F.col("s").alias("w")), lambda a, b: _sweep(a, b, width), SWEPT, tile)
    return here.unionByName(passed.where("kind = 0").select("x", "y", "w"))


def _rounds(dealt: DataFrame, given: DataFrame, width: int, tile: int) -> DataFrame:
    """x, y, w, in parts to be added up, where flow may divide."""
    total = None
    for _ in range(MAX_ROUNDS):
        made = _over(dealt, given, lambda a, b: _sweep(a, b, width), SWEPT, tile)
        here = made.where("kind = 0").select("x", "y", "w")
        total = here if total is None else total.unionByName(here)
        given = made.where("kind = 1 AND w <> 0").groupBy("x", "y").agg(F.sum("w").alias("w"))
        if given.isEmpty():
            return total
    raise RuntimeError("flow crosses tiles without end: the directions have loops")


def flow_accumulation(edges: DataFrame, weights: Raster, tile: int = TILE, single: bool = False) -> Raster:
    """Each cell's weight with what flows into it from above. weights: z is the cell's own; NoData stays NoData.

    single: each cell has one edge at most, of share 1. Then cells on a loop keep what reaches them from outside it.
    Where flow divides, cells on a loop within a tile, and below one, keep what reached them before it; a loop across tiles is an error.
    """
    width = weights.meta.width
    tx, ty, ntx, nty = (_in_tile(c, tile) for c in ("x", "y", "nx", "ny"))
    live = edges.join(weights.cells.where("z IS NOT NULL").select(F.col("x").alias("nx"), F.col("y").alias("ny")), ["nx", "ny"], "left_semi")
    dealt = cut(live.select("x", "y", "nx", "ny", "p", tx.alias("tx"), ty.alias("ty"), ((tx == ntx) & (ty == nty)).alias("nx_in")).repartition("tx", "ty"))
    given = weights.cells.where("z IS NOT NULL").select("x", "y", F.col("z").cast("double").alias("w"))
    total = (_two_passes if single else _rounds)(dealt, given, width, tile).groupBy("x", "y").agg(F.sum("w").alias("w"))
    cells = weights.cells.join(total, ["x", "y"], "left").select("x", "y", F.when(F.col("z").isNotNull(), F.coalesce("w", F.lit(0.0))).alias("z"))
    return weights.with_cells(cells, "flow accumulation", no_data=-1)


def accumulation(dem: Raster, method: str, exponent: float | None = None, weights: Raster | None = None, seed: int = 0, tile: int = TILE) -> Raster:
    """Accumulation by one of the flow metrics; weights are 1 unless given."""
    own = weights or dem.map(lambda z: F.when(z.isNotNull(), F.lit(1.0)))
    if weights is not None:
        dem._same_size(weights)
    return flow_accumulation(flow.edges(dem, method, exponent, seed), own, tile, single=method[-1] in "48")


def d8_area(directions: Raster, tile: int = TILE) -> Raster:
    """How many cells drain through each cell, itself included."""
    return flow_accumulation(flow.edges_of_d8(directions), directions.map(lambda z: F.when(z.isNotNull(), F.lit(1.0))), tile, single=True)


def dinf_area(directions: Raster, tile: int = TILE) -> Raster:
    """Area that drains through each cell; cells without a direction that nothing flows into have 0."""
    edges = flow.edges_of_dinf(directions)
    own = directions.map(lambda z: F.when(z.isNotNull(), F.lit(1.0)))
    below = edges.select(F.col("nx").alias("x"), F.col("ny").alias("y")).distinct()
    fed = directions.cells.join(below.withColumn("fed", F.lit(True)), ["x", "y"], "left")
    none = fed.where("z = 0 AND fed IS NULL").select("x", "y", F.lit(True).alias("none"))
    area = flow_accumulation(edges, own, tile)
    return area.with_cells(area.cells.join(none, ["x", "y"], "left").select("x", "y", F.when(F.col("none"), 0.0).otherwise(F.col("z")).alias("z")), "d-infinity area")


def line_cells(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Cells under a line, from the left: in each column the cell that the line comes in at and, where it rounds to another row in it, that row's next cell.

    After k columns the line has moved by k * slope rows, rounded, but by one row a column at most; an upright line has all its rows.
    """
    (x0, y0), (x1, y1) = sorted([(x0, y0), (x1, y1)], key=lambda p: p[0])
    if x0 == x1:
        return [(x0, y) for y in range(min(y0, y1), max(y0, y1) + 1)]
    k = np.arange(x1 - x0 + 2)
    rows_done = np.minimum(k, np.floor(k * abs(y1 - y0) / (x1 - x0) + 0.5).astype(int))
    y = y0 + np.sign(y1 - y0) * rows_done[:-1]
    own, turn = np.stack((x0 + k[:-1], y), axis=1), np.diff(rows_done) > 0
    both = np.concatenate((own, own[turn] + [1, 0]))
    order = np.argsort(np.concatenate((2 * k[:-1], 2 * k[:-1][turn] + 1)), kind="stable")
    return list(dict.fromkeys(map(tuple, both[order].tolist())))


def _walk(links: pa.Table, given: pa.Table, width: int) -> pa.Table:
    """Cells reached from the given ones over the tile's links (kind 0), and those reached beyond the tile (kind 1)."""
    x, y, nx, ny, inner = (links.column(c).to_numpy() for c in ("x", "y", "nx", "ny", "nx_in"))
    source, target = y.astype(np.int64) * width + x, ny.astype(np.int64) * width + nx
    start = given.column("y").to_numpy().astype(np.int64) * width + given.column("x").to_numpy()
    cells = np.unique(np.concatenate((source, target, start)))
    order = np.argsort(source, kind="stable")
    s, t, stays = np.searchsorted(cells, source[order]), np.searchsorted(cells, target[order]), inner[order]
    first = np.searchsorted(s, np.arange(len(cells) + 1))
    seen, beyond = np.zeros(len(cells), dtype=bool), np.zeros(len(cells), dtype=bool)
    front = np.unique(np.searchsorted(cells, start))
    while len(front):
        seen[front] = True
        counts = first[front + 1] - first[front]
        picks = np.repeat(first[front] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        beyond[t[picks[~stays[picks]]]] = True
        front = np.unique(t[picks[stays[picks]]])
        front = front[~seen[front]]
    ids = np.concatenate((cells[seen], cells[beyond]))
    kind = np.concatenate((np.zeros(seen.sum()), np.ones(beyond.sum()))).astype(np.int32)
    return pa.table({"x": (ids % width).astype(np.int32), "y": (ids // width).astype(np.int32), "kind": kind})


def reached(links: DataFrame, starts: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """x, y of all cells that links (x, y to nx, ny) lead to from the starts, these included. Rounds are tiles crossed."""
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    dealt = cut(links.select("x", "y", "nx", "ny", at("x").alias("tx"), at("y").alias("ty"), ((at("x") == at("nx")) & (at("y") == at("ny"))).alias("nx_in")).repartition("tx", "ty"))
    front, found = starts.select("x", "y").distinct(), None
    for _ in range(MAX_ROUNDS):
        given = front.select("x", "y", at("x").alias("tx"), at("y").alias("ty"))
        made = cut(dealt.groupBy("tx", "ty").cogroup(given.groupBy("tx", "ty")).applyInArrow(lambda a, b: _walk(a, b, width), "x int, y int, kind int"))
        here = made.where("kind = 0").select("x", "y")
        found = here if found is None else found.unionByName(here)
        front = made.where("kind = 1").select("x", "y").distinct().join(found, ["x", "y"], "left_anti")
        if front.isEmpty():
            return found.distinct()
    raise RuntimeError("the walk does not end")


def _stepped(links: pa.Table, given: pa.Table, width: int) -> pa.Table:
    """Fewest steps d to cells reached from the given ones (x, y, d) over the tile's links (kind 0), and to those beyond the tile (kind 1)."""
    if not len(given):
        return pa.table({"x": pa.array([], pa.int32()), "y": pa.array([], pa.int32()), "d": pa.array([], pa.int64()), "kind": pa.array([], pa.int32())})
    x, y, nx, ny, inner = (links.column(c).to_numpy() for c in ("x", "y", "nx", "ny", "nx_in"))
    source, target = y.astype(np.int64) * width + x, ny.astype(np.int64) * width + nx
    start, begin = given.column("y").to_numpy().astype(np.int64) * width + given.column("x").to_numpy(), given.column("d").to_numpy()
    cells = np.unique(np.concatenate((source, target, start)))
    order = np.argsort(source, kind="stable")
    s, t, stays = np.searchsorted(cells, source[order]), np.searchsorted(cells, target[order]), inner[order]
    first = np.searchsorted(s, np.arange(len(cells) + 1))
    far = np.iinfo(np.int64).max
    d, beyond = np.full(len(cells), far), np.full(len(cells), far)
    late = np.argsort(begin, kind="stable")
    seeds, begin = np.searchsorted(cells, start[late]), begin[late]
    np.minimum.at(d, seeds, begin)
    front, k, at = np.zeros(0, dtype=np.int64), int(begin[0]), 0
    while True:
        to = int(np.searchsorted(begin, k, side="right"))
        due = seeds[at:to]
        front, at = np.unique(np.concatenate((front, due[d[due] == k]))), to
        if not len(front):
            if at == len(seeds):
                break
            k = int(begin[at])
            continue
        counts = first[front + 1] - first[front]
        picks = np.repeat(first[front] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
        out = t[picks[~stays[picks]]]
        beyond[out] = np.minimum(beyond[out], k + 1)
        front, k = np.unique(t[picks[stays[picks]]]), k + 1
        front = front[d[front] > k]
        d[front] = k
    here, there = d < far, beyond < far
    ids = np.concatenate((cells[here], cells[there]))
    return pa.table({"x": (ids % width).astype(np.int32), "y": (ids // width).astype(np.int32), "d": np.concatenate((d[here], beyond[there])), "kind": np.repeat([0, 1], [here.sum(), there.sum()]).astype(np.int32)})


def distances(links: DataFrame, starts: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """x, y, d: the fewest cells on a way over links from a start (1 there). Rounds are tiles crossed; only what is nearer than known goes on."""
    tx, ty, ntx, nty = (_in_tile(c, tile) for c in ("x", "y", "nx", "ny"))
    dealt = cut(links.select("x", "y", "nx", "ny", tx.alias("tx"), ty.alias("ty"), ((tx == ntx) & (ty == nty)).alias("nx_in")).repartition("tx", "ty"))
    rim = (F.col("x") % tile).isin(0, tile - 1) | (F.col("y") % tile).isin(0, tile - 1)
    least = lambda df: df.groupBy("x", "y").agg(F.min("d").alias("d"))
    given, found, known = starts.select("x", "y", F.lit(1).cast("long").alias("d")).distinct(), None, None
    for _ in range(MAX_ROUNDS):
        made = _over(dealt, given, lambda a, b: _stepped(a, b, width), "x int, y int, d long, kind int", tile)
        here = made.where("kind = 0").select("x", "y", "d")
        found = here if found is None else found.unionByName(here)
        known = cut(least(here.where(rim) if known is None else known.unionByName(here.where(rim))))
        given = cut(least(made.where("kind = 1")).join(known.withColumnRenamed("d", "old"), ["x", "y"], "left").where("old IS NULL OR d < old").select("x", "y", "d"))
        if given.isEmpty():
            return least(found)
    raise RuntimeError("the walk does not end")


def upslope_cells(directions: Raster, x0: int, y0: int, x1: int, y1: int, tile: int = TILE) -> Raster:
    """2 on the line, 1 for cells whose flow reaches it, NoData elsewhere."""
    on_line = [(x, y) for x, y in line_cells(x0, y0, x1, y1) if 0 <= x < directions.meta.width and 0 <= y < directions.meta.height]
    line = directions.cells.sparkSession.createDataFrame(on_line, "x int, y int")
    up = flow.edges_of_d8(directions).select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    found = reached(up, line, directions.meta.width, tile).withColumn("up", F.lit(1.0)).join(line.withColumn("line", F.lit(2.0)), ["x", "y"], "left")
    cells = directions.cells.select("x", "y").join(found, ["x", "y"], "left").select("x", "y", F.coalesce("line", "up").alias("z"))
    return directions.with_cells(cells, "upslope cells", no_data=255)


def loops(directions: Raster) -> DataFrame:
    """x, y of cells whose flow never ends: those on a loop or above one. Pointer doubling: log2(cells) rounds at most."""
    jump = flow.edges_of_d8(directions).select((F.col("y").cast("long") * directions.meta.width + F.col("x")).alias("i"), (F.col("ny").cast("long") * directions.meta.width + F.col("nx")).alias("j"))
    jump = cut(jump)
    n, steps = directions.meta.width * directions.meta.height, 1
    while steps < n and not jump.isEmpty():
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.j") == F.col("b.i")).select(F.col("a.i").alias("i"), F.col("b.j").alias("j")))
        steps *= 2
    return jump.select((F.col("i") % directions.meta.width).cast("int").alias("x"), F.floor(F.col("i") / directions.meta.width).cast("int").alias("y"))


def flood_from(check: Raster, value: float, seeds: DataFrame, neighbours: int = 8, tile: int = TILE) -> DataFrame:
    """x, y of cells with the value that are joined to a seed (x, y) through cells with the value."""

    def kernel(box, present, z):
        here = present & (shifted(z, 0, 0) == value)
        parts = []
        for n in codes(neighbours):
            y, x = np.nonzero(here & (shifted(z, DX[n], DY[n]) == value))
            parts.append((x + box.x0, y + box.y0, x + box.x0 + DX[n], y + box.y0 + DY[n]))
        x, y, nx, ny = (np.concatenate(p) for p in zip(*parts))
        return {"x": x, "y": y, "nx": nx, "ny": ny}

    links = over_tiles(check, kernel, "x int, y int, nx int, ny int", tile=tile)
    starts = seeds.join(check.cells.where(F.col("z") == value), ["x", "y"], "left_semi")
    return reached(links, starts, check.meta.width, tile)


def bucket_fill(check: Raster, target: Raster, value: float, new: float, seeds: DataFrame, neighbours: int = 8) -> Raster:
    """Sets `new` in the target where the flood from the seeds reaches."""
    reached = flood_from(check, value, seeds, neighbours).withColumn("hit", F.lit(True))
    cells = target.cells.join(reached, ["x", "y"], "left").select("x", "y", F.when(F.col("hit"), F.lit(float(new))).otherwise(F.col("z")).alias("z"))
    return target.with_cells(cells, "bucket fill")


def bucket_fill_from_edges(check: Raster, target: Raster, value: float, new: float, neighbours: int = 8) -> Raster:
    return bucket_fill(check, target, value, new, check.cells.where(check.is_edge).select("x", "y"), neighbours)


