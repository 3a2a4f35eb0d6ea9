"""Command line: python -m talus COMMAND INPUT [OUTPUT] [options]. Grids are ASCII grid folders or files."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus import api
from talus.operators import accumulate, flats, flood, flow, hierarchy, terrain
from talus.raster import Raster
from talus.sources import grids


def _told(df: DataFrame) -> str:
    return "\n".join("\t".join(f"{k}={v}" for k, v in r.asDict().items()) for r in df.collect())


def _rim(r: Raster):
    return r.is_edge


def _info(r: Raster, a: argparse.Namespace) -> str:
    m = r.meta
    return f"width={m.width}\theight={m.height}\tno_data={m.no_data}\tgeotransform={m.geotransform}\n" + _told(r.stats())


def _hierarchy(r: Raster, a: argparse.Namespace) -> str:
    return hierarchy.hierarchy(r, _rim(r))[1].text()


def _water(r: Raster, a: argparse.Namespace) -> Raster:
    return hierarchy.fill_spill_merge(r, r.map(lambda z: F.lit(a.amount)), _rim(r))[0]


#: What each command makes: a raster to be written, or text to be printed.
COMMANDS = {
    "fill": lambda r, a: api.FillDepressions(r, a.epsilon, a.topology),
    "breach": lambda r, a: flood.breach(r, a.mode, api.NEIGHBOURS[a.topology], max_length=a.max_length, max_depth=a.max_depth, fill=a.fill),
    "depressions": lambda r, a: f"has_depressions={flood.has_depressions(r)}",
    "pit-mask": lambda r, a: flood.pit_mask(r),
    "flats": lambda r, a: flats.find_flats(r),
    "resolve-flats": lambda r, a: api.ResolveFlats(r),
    "flow-directions": lambda r, a: flow.d8_directions(r),
    "flood-for-directions": lambda r, a: flats.flood_for_directions(r),
    "taudem-to-d8": lambda r, a: flow.from_taudem(r),
    "loop-check": lambda r, a: _told(accumulate.loops(r)),
    "flow-accumulation": lambda r, a: api.FlowAccumulation(r, a.method, a.exponent),
    "terrain-attribute": lambda r, a: api.TerrainAttribute(r, a.attribute, a.zscale),
    "surface-area": lambda r, a: _told(terrain.surface_area(r, a.zscale)),
    "depression-hierarchy": _hierarchy,
    "fill-spill-merge": _water,
    "info": _info,
    "histogram": lambda r, a: _told(r.histogram()),
    "show": lambda r, a: r.show(),
    "expand": lambda r, a: r.expand(a.width, a.height, a.value),
    "compare": lambda r, a: _told(r.diff_stats(grids.read_ascii(r.cells.sparkSession, a.other))),
    "geotransform": lambda r, a: " ".join(map(str, r.meta.geotransform)),
    "projection": lambda r, a: r.meta.projection,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("talus", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("input")
    p.add_argument("output", nargs="?", help="where a raster is written; text goes to standard output")
    p.add_argument("--topology", choices=sorted(api.NEIGHBOURS), default="D8")
    p.add_argument("--epsilon", action="store_true")
    p.add_argument("--fill", action="store_true")
    p.add_argument("--mode", default="complete", choices=("complete", "selective", "constrained"))
    p.add_argument("--max-length", type=int, default=1 << 31)
    p.add_argument("--max-depth", type=float, default=float("inf"))
    p.add_argument("--method", default="D8")
    p.add_argument("--exponent", type=float)
    p.add_argument("--attribute", default="slope_riserun", choices=terrain.ATTRIBUTES)
    p.add_argument("--zscale", type=float, default=1.0)
    p.add_argument("--amount", type=float, default=1.0)
    p.add_argument("--width", type=int)
    p.add_argument("--height", type=int)
    p.add_argument("--value", type=float)
    p.add_argument("--other", help="the grid to compare with")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("talus").getOrCreate()
    made = COMMANDS[a.command](grids.read_ascii(spark, a.input), a)
    if isinstance(made, str):
        print(made)
        return 0
    if a.output is None:
        print("this command writes a raster: name an output", file=sys.stderr)
        return 2
    grids.write_ascii(made, a.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
