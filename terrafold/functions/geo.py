"""Geometry on columns of degrees: spherical distances, Mercator areas, labels and validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions.text import fixed, rounded

#: Sphere of distances, sphere of the projection, its latitude limit, tile zoom limit.
SPHERE, MERCATOR, LATITUDE, ZOOM = 6371000.0, 6378137.0, 85.0511287798, 19


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres by the haversine."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return F.lit(2 * SPHERE) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator_x(lng: Column) -> Column:
    return F.lit(MERCATOR) * F.radians(lng)


def mercator_y(lat: Column) -> Column:
    s = F.sin(F.radians(F.greatest(F.least(lat, F.lit(LATITUDE)), F.lit(-LATITUDE))))
    return F.lit(MERCATOR) * F.log((1 + s) / (1 - s)) / 2


def pixel(meters: Column, zoom: int) -> Column:
    """A projected coordinate in pixels of 256-pixel tiles."""
    return meters * F.lit(256.0 * 2**zoom / (2 * 3.141592653589793 * MERCATOR))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """From a point to a segment, by the clamped projection."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def ray_crosses(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Whether an edge is crossed by the ray to the right; an odd number of them means inside."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by != ay, by - ay) + ax)


def valid_coordinate(lat: Column, lng: Column) -> Column:
    return lat.between(-90, 90) & lng.between(-180, 180)


def in_study_area(lat: Column, lng: Column) -> Column:
    return lat.between(20.25, 45.55) & lng.between(122.56, 153.59)


def valid_tile(z: Column, x: Column, y: Column) -> Column:
    side = F.pow(F.lit(2.0), z.cast("double"))
    return z.between(0, ZOOM) & (x >= 0) & (y >= 0) & (x < side) & (y < side)


def tile_row(x: Column) -> Column:
    """The number in 'n.png'; else null."""
    return F.regexp_extract(x, r"^(\d+)\.png$", 1).try_cast("bigint")


def parsed_pair(x: Column) -> Column:
    """'(lat, lng)', brackets and spaces aside, as a struct; null unless it has exactly two numbers."""
    parts = F.filter(F.split(F.regexp_replace(x, r"[()\s]", ""), ","), lambda p: p != "")
    ok = (F.size(F.split(F.regexp_replace(x, r"[()\s]", ""), ",")) == 2) & (F.size(parts) == 2)
    lat, lng = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(ok & lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def distance_label(m: Column, even: bool = False) -> Column:
    """What is not finite is a dash. even: of two equally near texts the even one, as printf's."""
    return F.when(~finite(m), "-").when(m >= 1000, F.concat(fixed(m / 1000, 2, even), F.lit(" km"))).when(m >= 100, F.concat(rounded(m, even), F.lit(" m"))).otherwise(F.concat(fixed(m, 1, even), F.lit(" m")))


def area_label(a: Column, even: bool = False) -> Column:
    """What is not finite is a dash. even: of two equally near texts the even one, as printf's."""
    return F.when(~finite(a), "-").when(a >= 1e6, F.concat(fixed(a / 1e6, 2, even), F.lit(" km²"))).otherwise(F.concat(rounded(a, even), F.lit(" m²")))


def usable_radius(x: Column) -> Column:
    """A circle's radius: finite and above 0, else null."""
    return F.when(finite(x) & (x > 0), x)


def circle_area(radius: Column) -> Column:
    return F.when(F.isnan(radius) | (F.abs(radius) == float("inf")), 0.0).otherwise(F.pi() * radius * radius)


def open_ring(v: Column) -> Column:
    """An array of vertices without a last one that repeats the first."""
    return F.when((F.size(v) >= 2) & (F.get(v, F.lit(0)) == F.element_at(v, -1)), F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def first_ring(kind: Column, coordinates: Column) -> Column:
    """The [lng, lat] points of a GeoJSON line, or of the first ring of a polygon or of the first of several polygons; coordinates as JSON text."""
    ring = F.from_json(F.when(kind == "Polygon", coordinates), "array<array<array<double>>>")
    several = F.from_json(F.when(kind == "MultiPolygon", coordinates), "array<array<array<array<double>>>>")
    line = F.from_json(F.when(kind == "LineString", coordinates), "array<array<double>>")
    return F.coalesce(line, F.get(ring, F.lit(0)), F.get(F.get(several, F.lit(0)), F.lit(0)))
