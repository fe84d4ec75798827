"""Clusters of markers at every zoom, from the finest to the coarsest, whatever the order of the rows.

Each zoom starts from the clusters of the next finer one. Those whose centres lie in one cell of a grid, small
enough that no two points of it are further apart than the radius, become one. A cell then looks at the cells
within two of it whose centres lie within the radius, and at itself: the one with the most markers, of equals
the one with the smallest marker id, is its choice. A cell that is its own choice is a centre, and takes in the
cells that chose it; a cell whose choice is no centre stays as it is. Places are whole numbers, so nothing
depends on the order of sums either.

Markers in one place meet in a sum before anything is compared, and a cell is compared with 24 others at most.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geo
from terrafold.sources.store import staged

RADIUS, REACH = 80, 2
#: Places count sixteenths of a pixel of the finest zoom, from the upper left corner of the world.
UNIT_ZOOM, FINEST, COARSEST = 22, 18, 5
#: In pixels: the diagonal of a cell is within the radius, and REACH cells are further than it.
CELL = 56


def placed(markers: DataFrame) -> DataFrame:
    """(n, sx, sy, low) of markers with (id, latitude, longitude): each on its own. Places that are not finite are left out."""
    whole = lambda meters: (F.floor(geo.pixel(meters, UNIT_ZOOM)) + F.lit(1 << UNIT_ZOOM + 7)).cast("long")
    rows = markers.where(geo.finite(F.col("latitude")) & geo.finite(F.col("longitude")))
    return rows.select(F.lit(1).cast("long").alias("n"), whole(geo.mercator_x(F.col("longitude"))).alias("sx"), whole(-geo.mercator_y(F.col("latitude"))).alias("sy"), F.col("id").cast("long").alias("low"))


def coarser(clusters: DataFrame, zoom: int) -> DataFrame:
    """(n, sx, sy, low) of the clusters of a zoom, from those of a finer one or from markers."""
    side, radius = CELL << UNIT_ZOOM - zoom, RADIUS << UNIT_ZOOM - zoom
    x, y = (F.expr(f"{s} div n") for s in ("sx", "sy"))
    cells = clusters.select("n", "sx", "sy", "low", x.alias("x"), y.alias("y")).withColumns({"cx": F.expr(f"x div {side}"), "cy": F.expr(f"y div {side}")})
    cells = cells.groupBy("cx", "cy").agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy")), F.min("low").alias("low"))
    # Every cell goes where it may be looked at; what comes to a place without a cell is dropped.
    own = F.struct("cx", "cy", "n", "sx", "sy", "low", x.alias("x"), y.alias("y")).alias("c")
    steps = range(-REACH, REACH + 1)
    around = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in steps for j in steps))).alias("to")
    met = cells.select(own, around).groupBy("to").agg(F.collect_list("c").alias("seen"), F.max(F.when((F.col("c.cx") == F.col("to.cx")) & (F.col("c.cy") == F.col("to.cy")), F.col("c"))).alias("c")).where("c is not null")
    near = F.filter("seen", lambda s: (s["x"] - F.col("c.x")) * (s["x"] - F.col("c.x")) + (s["y"] - F.col("c.y")) * (s["y"] - F.col("c.y")) <= radius * radius)
    choice = F.array_max(F.transform(near, lambda s: F.struct(s["n"].alias("n"), (-s["low"]).alias("low"))))
    chosen = met.select("c", (-choice["low"]).alias("choice"))
    sums = F.struct("c.n", "c.sx", "c.sy", "c.low").alias("c")
    is_centre = F.col("choice") == F.col("c.low")
    gathered = chosen.select("choice", sums, is_centre.alias("centre"))
    # Those who chose the same cell: with it, if it is a centre, one cluster; else each on its own.
    groups = gathered.groupBy("choice").agg(F.collect_list("c").alias("all"), F.bool_or("centre").alias("centre"))
    total = lambda k: F.aggregate("all", F.lit(0).cast("long"), lambda s, c: s + c[k])
    one = F.array(F.struct(*(total(k).alias(k) for k in ("n", "sx", "sy")), F.array_min(F.transform("all", lambda c: c["low"])).alias("low")))
    return groups.select(F.inline(F.when(F.col("centre"), one).otherwise(F.col("all"))))


def clusters(markers: DataFrame, finest: int = FINEST, coarsest: int = COARSEST) -> DataFrame:
    """(zoom, x, y, n, low): clusters of markers with (id, latitude, longitude) at each zoom: centre in pixels of it, number of markers, smallest id.

    Each zoom is written before the next is made of it."""
    found, level = [], placed(markers)
    for zoom in range(finest, coarsest - 1, -1):
        level = staged(coarser(level, zoom))
        found.append(level.select(F.lit(zoom).alias("zoom"), *(F.expr(f"{s} div n div {1 << UNIT_ZOOM - zoom}").alias(c) for s, c in (("sx", "x"), ("sy", "y"))), "n", "low"))
    return reduce(DataFrame.union, found)
