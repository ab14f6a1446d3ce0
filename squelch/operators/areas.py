"""Positions in areas: a grid over the areas' rings, and a ray test only where a cell is on an edge.

A ring is a closed array of points (x, y). Cells of a grid are keys of an
equi-join, so a position meets only areas whose cells it lies in. A cell
without any edge is all inside or all outside; a cell on an edge keeps the
edges that can decide for its positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells are widened by this share of their size, so that rounding can't put an edge outside the cell of a position on it.
_MARGIN = 1e-9


def edges(ring: Column) -> Column:
    """Array of structs x1, y1, x2, y2 from a ring; fewer than two points give none."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i - 1)["x"].alias("x1"), F.get(ring, i - 1)["y"].alias("y1"), F.get(ring, i)["x"].alias("x2"), F.get(ring, i)["y"].alias("y2")))
    return F.when(F.size(ring) > 1, pairs).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def inside(x: Column, y: Column, ring_edges: Column) -> Column:
    """Whether a ray to the right crosses an odd number of edges."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(ring_edges, crosses)) % 2 == 1


def edge_distance(x: Column, y: Column, ring_edges: Column) -> Column:
    """Distance to the nearest edge; null for no edges."""

    def to(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        off_x, off_y = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
        return F.sqrt(off_x * off_x + off_y * off_y)

    return F.array_min(F.transform(ring_edges, to))


def cells(areas: DataFrame, size: float) -> DataFrame:
    """area_id, cx, cy and ``deciding`` of every cell that an area touches: the edges that decide there, null where all of it is inside.

    ``size`` should leave an area some hundred cells; an area without three
    points touches none.
    """
    rows = areas.filter(F.size("ring") > 3).select("area_id", edges(F.col("ring")).alias("es"), *[getattr(F, f"array_{m}")(F.col("ring")[c]).alias(f"{m}_{c}") for m in ("min", "max") for c in ("x", "y")])
    for c in ("x", "y"):
        rows = rows.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"min_{c}") / size), F.floor(F.col(f"max_{c}") / size))))
    margin = size * _MARGIN
    west, south = F.col("cx") * size - margin, F.col("cy") * size - margin
    east, north = (F.col("cx") + 1) * size + margin, (F.col("cy") + 1) * size + margin

    def touches(e: Column) -> Column:
        boxes = (F.least(e["x1"], e["x2"]) <= east) & (F.greatest(e["x1"], e["x2"]) >= west) & (F.least(e["y1"], e["y2"]) <= north) & (F.greatest(e["y1"], e["y2"]) >= south)
        side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        corners = [side(x, y) for x in (west, east) for y in (south, north)]
        return boxes & (F.least(*corners) <= margin * size) & (F.greatest(*corners) >= -margin * size)

    # An edge that ends left of the cell, or lies above or below it, can't cross a ray from a position in it.
    decides = lambda e: (F.greatest(e["x1"], e["x2"]) >= west) & (F.greatest(e["y1"], e["y2"]) >= south) & (F.least(e["y1"], e["y2"]) <= north)
    middle = inside((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, F.col("es"))
    on_edge = F.exists("es", touches)
    return rows.filter(on_edge | middle).select("area_id", "cx", "cy", F.when(on_edge, F.filter("es", decides)).alias("deciding"))


def located(points: DataFrame, areas: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each position with each area that holds it: the points' columns and ``area_id``.

    points: any columns and x, y; areas: area_id, ring. Positions without
    coordinates are in no area. Many positions in one cell are a skewed join of
    a few rows on the other side, which Spark splits.
    """
    spare = {"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)}
    asked = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns(spare)
    grid = cells(areas, size)
    met = asked.join(grid.withColumnsRenamed({"cx": "_cx", "cy": "_cy"}), ["_cx", "_cy"])
    return met.filter(F.col("deciding").isNull() | inside(F.col(x), F.col(y), F.col("deciding"))).select(*points.columns, "area_id")


def projected(lat: Column, lon: Column, lat0: Column, lon0: Column, range_nm: float, width: float, height: float) -> tuple[Column, Column]:
    """x and y in a frame around (lat0, lon0) that shows ``range_nm`` to its nearer edge; y points down."""
    scale = min(width, height) / 2 / range_nm
    return F.lit(width / 2) + (lon - lon0) * 60 * F.cos(F.radians(lat0)) * scale, F.lit(height / 2) - (lat - lat0) * 60 * scale


def label_points(areas: DataFrame, width: float, height: float, margin: float = 18, least_room: float = 11, steps: int = 20) -> DataFrame:
    """area_id, x, y and room of the place for each area's label; areas without room for one have no row.

    Of a grid over the part of the area in the frame: the place inside the ring
    and outside the rings of ``exclude`` that is farthest from all edges, the
    first one of equals, and farther than ``least_room``.
    areas: area_id, ring, exclude (array of rings, may be null or empty).
    """
    inner = areas.select(
        "area_id", edges(F.col("ring")).alias("es"), F.transform(F.coalesce("exclude", F.array().cast(areas.schema["exclude"].dataType)), edges).alias("others"),
        *[F.greatest(F.array_min(F.col("ring")[c]), F.lit(float(margin))).alias(f"{c}0") for c in ("x", "y")],
        *[F.least(F.array_max(F.col("ring")[c]), F.lit(float(most - margin))).alias(f"{c}1") for c, most in (("x", width), ("y", height))],
    ).filter("x0 < x1 and y0 < y1")
    tried = inner.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    tried = tried.withColumns({"x": F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("i") / steps, "y": F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("j") / steps})
    x, y = F.col("x"), F.col("y")
    free = tried.filter(inside(x, y, F.col("es")) & ~F.exists("others", lambda o: inside(x, y, o)))
    room = F.least(edge_distance(x, y, F.col("es")), F.array_min(F.transform("others", lambda o: edge_distance(x, y, o))))  # least() passes over null
    best = free.withColumn("room", room).filter(F.col("room") > least_room).groupBy("area_id").agg(F.max(F.struct("room", (-F.col("i")).alias("a"), (-F.col("j")).alias("b"), "x", "y")).alias("r"))
    return best.select("area_id", "r.x", "r.y", "r.room")
