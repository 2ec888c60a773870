"""Distances, boxes, centroids and other geometry as Column expressions.  Geometry is plain lon and lat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: WGS84 semi-major axis (m) and flattening; metres of a mile; Mercator radius.  Fixed values.
A, FLAT, MILE, MERCATOR_R = 6378137.0, 1 / 298.257223563, 1609.344, 6378137.0


def reduced_sql(lat: str) -> str:
    """The reduced latitude."""
    return f"atan({1 - FLAT!r}E0 * tan(radians({lat})))"


def arc_sql(lon1: str, lon2: str, b1: str, b2: str) -> str:
    """The angle between two points of given reduced latitudes."""
    return f"(2E0 * asin(sqrt(least(1E0, pow(sin(({b2} - {b1}) / 2E0), 2E0) + cos({b1}) * cos({b2}) * pow(sin(radians({lon2} - {lon1}) / 2E0), 2E0)))))"


def arc_metres_sql(s: str, b1: str, b2: str) -> str:
    """Lambert's formula, from that angle and the reduced latitudes."""
    p, q = f"(({b1} + {b2}) / 2E0)", f"(({b2} - {b1}) / 2E0)"
    x = f"({s} - sin({s})) * pow(sin({p}) * cos({q}) / cos({s} / 2E0), 2E0)"
    y = f"({s} + sin({s})) * pow(cos({p}) * sin({q}) / sin({s} / 2E0), 2E0)"
    return f"CASE WHEN {s} = 0E0 THEN 0E0 ELSE {A!r}E0 * ({s} - {FLAT / 2!r}E0 * ({x} + {y})) END"


def geodesic_metres_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Lambert's formula on reduced latitudes, as text that Spark and other engines read alike; errs by about 1e-6 in a region."""
    b1, b2 = reduced_sql(lat1), reduced_sql(lat2)
    return arc_metres_sql(arc_sql(lon1, lon2, b1, b2), b1, b2)


def geodesic_miles_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"({geodesic_metres_sql(lon1, lat1, lon2, lat2)}) / {MILE!r}E0"


def geodesic_miles(lon1: str, lat1: str, lon2: str, lat2: str) -> Column:
    """Ellipsoidal miles between points in named columns; null if any is null.  Not for nearly opposite points."""
    return F.expr(geodesic_miles_sql(lon1, lat1, lon2, lat2))


def mercator_metres(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar Web Mercator distance; null if a point is missing."""
    def y(lat):
        return F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * MERCATOR_R

    return F.sqrt(F.pow(F.radians(lon1 - lon2) * MERCATOR_R, 2) + F.pow(y(lat1) - y(lat2), 2))


def point(lon: Column, lat: Column) -> Column:
    """struct(x, y), null unless both are given."""
    return F.when(lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("x"), lat.alias("y")))


def connector_line(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """The line of two points, as an array."""
    return F.array(F.struct(lon1.alias("x"), lat1.alias("y")), F.struct(lon2.alias("x"), lat2.alias("y")))


def line_wkt(line: Column) -> Column:
    return F.concat(F.lit("LINESTRING ("), F.array_join(F.transform(line, lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), ", "), F.lit(")"))


def point_wkt(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT (%.6f %.6f)", lon, lat)


def bad_latlon(lat: Column, lon: Column) -> Column:
    """Missing, out of range, or at the origin of both axes."""
    return F.coalesce(lat.isNull() | lon.isNull() | (F.abs(lat) > 90) | (F.abs(lon) > 180) | ((F.abs(lat) < 1e-4) & (F.abs(lon) < 1e-4)), F.lit(True))


def polygon_centroid(rings: Column) -> Column:
    """struct(lon, lat) of the area's centre; rings are arrays of struct(x, y), the first the outline, others holes, closed or not."""
    def sums(ring):
        turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
        parts = F.zip_with(ring, turned, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("w"), (a["x"] + b["x"]).alias("sx"), (a["y"] + b["y"]).alias("sy")))
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
        return F.aggregate(parts, zero, lambda s, p: F.struct((s["a"] + p["w"]).alias("a"), (s["x"] + p["w"] * p["sx"]).alias("x"), (s["y"] + p["w"] * p["sy"]).alias("y")))

    each = F.transform(rings, lambda ring, i: F.struct(F.when(i == 0, 1.0).otherwise(-1.0).alias("sign"), sums(ring).alias("s")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    # orientation does not matter: each ring counts with the sign of its place
    # the sums are finished inside, as their every mention outside would be worked out anew
    add = lambda t, r: F.struct((t["a"] + r["sign"] * F.abs(r["s"]["a"])).alias("a"), (t["x"] + r["sign"] * F.signum(r["s"]["a"]) * r["s"]["x"]).alias("x"), (t["y"] + r["sign"] * F.signum(r["s"]["a"]) * r["s"]["y"]).alias("y"))
    return F.aggregate(each, zero, add, lambda t: F.when(t["a"] != 0, F.struct((t["x"] / (3 * t["a"])).alias("lon"), (t["y"] / (3 * t["a"])).alias("lat"))))


def extent(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.agg(F.min(lon).alias("west"), F.min(lat).alias("south"), F.max(lon).alias("east"), F.max(lat).alias("north"))


def expand_bbox(df: DataFrame, miles: float, max_miles: float | None = None, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row (west, south, east, north): the extent padded by miles (with max_miles: at least that and 3, and at least 5)."""
    pad = miles if max_miles is None else max(miles, max_miles + 3.0, 5.0)
    box = extent(df, lon, lat)
    dy = F.lit(pad / 69.0)
    dx = F.lit(pad) / (69.0 * F.greatest(F.lit(0.2), F.cos(F.radians((F.col("south") + F.col("north")) / 2))))
    return box.select((F.col("west") - dx).alias("west"), (F.col("south") - dy).alias("south"), (F.col("east") + dx).alias("east"), (F.col("north") + dy).alias("north"))


def layer_extent(df: DataFrame, pad: float = 0.1, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The extent of markers, padded by a share of its width and height on each side."""
    w, h = (F.col("east") - F.col("west")) * pad, (F.col("north") - F.col("south")) * pad
    return extent(df, lon, lat).select((F.col("west") - w).alias("west"), (F.col("south") - h).alias("south"), (F.col("east") + w).alias("east"), (F.col("north") + h).alias("north"))
