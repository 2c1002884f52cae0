"""Which grid cells a basin has.

The map from cells to basins is made once and then joined to every time step.  It
is a scanline: polygon edges become rows, meet the grid's rows by an equi-join, and
leave a crossing each; a basin's crossings of a row, sorted, bound by twos the spans
of cell centres inside (even-odd rule).  Spans meet the row's cells by another
equi-join.  No step sees a whole polygon, so its number of points is no limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(basins: DataFrame) -> DataFrame:
    """BASIN_ID, _order, _part (tells records of one id apart), x1, y1, x2, y2 of every edge of every ring.

    Rings are closed (last point = first).
    """
    order = "position" if "position" in basins.columns else "BASIN_ID"
    rings = basins.select("BASIN_ID", F.col(order).alias("_order"), F.xxhash64("rings").alias("_part"), F.explode("rings").alias("_ring")).where(F.size("_ring") > 1)
    n = F.size("_ring") - 1
    pairs = F.arrays_zip(F.slice("_ring", F.lit(1), n).alias("a"), F.slice("_ring", F.lit(2), n).alias("b"))
    each = rings.select("BASIN_ID", "_order", "_part", F.inline(pairs))
    return each.select("BASIN_ID", "_order", "_part", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def _bands(low: Column, high: Column, width: Column) -> Column:
    """Numbers of the stretches of that width from low to high."""
    return F.sequence(F.floor(low / width), F.floor(high / width))


def cell_basin(cells: DataFrame, basins: DataFrame, overlap: str = "all", all_touched: bool = False, half: float = 0.25, columns: float = 16.0, mark_contained: bool = False) -> DataFrame:
    """cells (lat_idx, lon_idx, lat, lon), basins (BASIN_ID, rings) -> BASIN_ID, lat_idx, lon_idx.

    A basin has the cells whose centre it contains: the even-odd rule over all
    rings, so holes and several parts work alike.  A centre on a lower or left edge
    is inside, on an upper or right edge outside, so neighbours share no cell.  With
    all_touched it has also those it touches: whose square of half-width `half` an
    edge meets.  overlap "all": a cell counts for each basin that has it; "last":
    for the last basin only, by `position` if there is one, else by id.
    mark_contained adds `contained`, whether the centre itself is inside.

    Rows of the grid are found by their height, cells of a row by stretches of
    `columns` cells' width; grids of uneven spacing are right, too.
    """
    if overlap not in ("all", "last"):
        raise ValueError("overlap must be 'all' or 'last'")
    spacing = lambda c, i: F.coalesce(F.when(F.count_distinct(i) > 1, (F.max(c) - F.min(c)) / (F.count_distinct(i) - 1)), F.lit(1.0))
    about = F.broadcast(cells.agg(spacing("lat", "lat_idx").alias("_dy"), (spacing("lon", "lon_idx") * columns).alias("_dx")))  # one row
    rows = cells.select("lat_idx", "lat").distinct().crossJoin(about).withColumn("_band", F.floor(F.col("lat") / F.col("_dy"))).drop("_dy", "_dx")
    grid = cells.select("lat_idx", "lon_idx", "lat", "lon").crossJoin(about).withColumn("_stretch", F.floor(F.col("lon") / F.col("_dx"))).drop("_dy", "_dx")
    each = edges(basins).crossJoin(about)
    out = _contained(each, rows, grid)
    if all_touched:
        touched = _touched(each, rows, grid, half)
        out = out.unionByName(touched).groupBy("BASIN_ID", "_order", "lat_idx", "lon_idx").agg(F.max("contained").alias("contained"))
    if overlap == "last":
        last = Window.partitionBy("lat_idx", "lon_idx").orderBy(F.col("_order").desc(), F.col("BASIN_ID").desc())
        out = out.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return out.select("BASIN_ID", "lat_idx", "lon_idx", *(["contained"] if mark_contained else []))


def _contained(each: DataFrame, rows: DataFrame, grid: DataFrame) -> DataFrame:
    """BASIN_ID, _order, lat_idx, lon_idx, contained: cells between a row's first and second crossing, third and fourth, ..."""
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    placed = each.where("y1 <> y2").withColumn("_band", F.explode(_bands(low, high, F.col("_dy"))))
    y = F.col("lat")
    met = placed.join(rows, "_band").where((F.col("y1") > y) != (F.col("y2") > y))
    x = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = met.select("BASIN_ID", "_order", "_part", "lat_idx", "_dx", x.alias("_x"))
    along = Window.partitionBy("BASIN_ID", "_order", "_part", "lat_idx").orderBy("_x")
    spans = crossings.withColumns({"_end": F.lead("_x").over(along), "_nth": F.row_number().over(along)}).where("_nth % 2 = 1 AND _x < _end")
    spans = spans.withColumn("_stretch", F.explode(_bands(F.col("_x"), F.col("_end"), F.col("_dx"))))
    inside = spans.join(grid.drop("lat"), ["lat_idx", "_stretch"]).where("lon >= _x AND lon < _end")
    return inside.select("BASIN_ID", "_order", "lat_idx", "lon_idx", F.lit(True).alias("contained"))


def _touched(each: DataFrame, rows: DataFrame, grid: DataFrame, half: float) -> DataFrame:
    """The same for cells whose square an edge meets; contained is false."""
    low, high = F.least("y1", "y2") - half, F.greatest("y1", "y2") + half
    placed = each.withColumn("_band", F.explode(_bands(low, high, F.col("_dy"))))
    met = placed.join(rows, "_band").where((F.col("lat") >= low) & (F.col("lat") <= high))
    # Where the edge runs within the row's height, so that long edges meet few cells.
    at = lambda y: F.col("x1") + (F.col("x2") - F.col("x1")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - F.col("y1")) / (F.col("y2") - F.col("y1"))))
    slack = half + 1e-9 + 1e-12 * F.greatest(F.abs("x1"), F.abs("x2"))
    ends = [F.when(F.col("y1") == F.col("y2"), F.col(c)).otherwise(at(F.col("lat") + s * (half + 1e-9))) for c, s in (("x1", -1), ("x2", 1))]
    spans = met.withColumns({"_from": F.least(*ends) - slack, "_to": F.greatest(*ends) + slack})
    spans = spans.withColumn("_stretch", F.explode(_bands(F.col("_from"), F.col("_to"), F.col("_dx")))).drop("lat")
    near = spans.join(grid, ["lat_idx", "_stretch"]).where("lon >= _from AND lon <= _to")
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("lon", "lat", "x1", "y1", "x2", "y2"))
    boxes = (F.least(x1, x2) <= x + half) & (F.greatest(x1, x2) >= x - half) & (F.least(y1, y2) <= y + half) & (F.greatest(y1, y2) >= y - half)
    side = lambda cx, cy: (x2 - x1) * (cy - y1) - (y2 - y1) * (cx - x1)
    corners = [side(x + a * half, y + b * half) for a in (-1, 1) for b in (-1, 1)]
    meets = boxes & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
    return near.where(meets).select("BASIN_ID", "_order", "lat_idx", "lon_idx", F.lit(False).alias("contained")).distinct()


def with_weights(mapped: DataFrame, area: DataFrame | None, factor: float = 1.0) -> DataFrame:
    """The map with weight = area * factor (area missing: 0); without areas, the factor alone.

    Folding both into the map leaves one multiplication for each cell and step.
    """
    if area is None:
        return mapped.withColumn("weight", F.lit(float(factor)))
    joined = mapped.join(area, ["lat_idx", "lon_idx"], "left")
    return joined.select("BASIN_ID", "lat_idx", "lon_idx", (F.coalesce(F.nanvl("area_m2", F.lit(0.0)), F.lit(0.0)) * F.lit(float(factor))).alias("weight"))
