"""Points in polygons and limits by zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring of [x, y] corners, by the parity of edges that a ray crosses."""
    n = F.size(ring)

    def crossed(corner: Column, i: Column) -> Column:
        x1, y1 = corner[0], corner[1]
        after = F.element_at(ring, ((i + 1) % n) + 1)
        x2, y2 = after[0], after[1]
        return ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / F.nullif(y2 - y1, F.lit(0.0)))

    hits = F.size(F.filter(F.transform(ring, lambda c, i: F.coalesce(crossed(c, i), F.lit(False))), lambda b: b))
    return hits % 2 == 1


def lowest_limit(points: DataFrame, zones: DataFrame, key: str, site: str, x: str, y: str, ring: str, limit: str, name: str) -> DataFrame:
    """Points with the lowest limit of the zones of their site that they are in, and that zone's name.

    Zones travel with their site as an array; a site has few of them.
    """
    each = zones.where(F.col(limit).isNotNull()).groupBy(site).agg(F.collect_list(F.struct(F.col(limit).alias("limit"), F.col(name).alias("name"), F.col(ring).alias("ring"))).alias("_zones"))
    joined = points.join(each, site, "left")
    inside = F.array_min(F.transform(F.filter("_zones", lambda z: in_ring(F.col(x), F.col(y), z["ring"])), lambda z: F.struct(z["limit"].alias("limit"), z["name"].alias("name"))))
    return joined.withColumn("zone_limit", inside["limit"]).withColumn("zone", inside["name"]).drop("_zones")
