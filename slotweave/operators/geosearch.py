"""Members within a radius of centres: an equi-join on grid cells, then the exact distance.

The grid is as coarse as the radius.  A centre looks at the cells its circle can touch: a few bands of latitude, and
in each the longitudes that the circle reaches there, around the date line and at the poles too.  Both sides are
shuffled by cell: Spark doesn't foresee how often centres are repeated for their cells, and would take them for a table
small enough to go through the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.functions.geo import EARTH, UNITS, distance

SALTS = 8
SLACK = 1e-12


def _vector(lon: str, lat: str, names: list[str]) -> dict[str, Column]:
    """The point as a vector of length 1."""
    a, b = F.radians(lon), F.radians(lat)
    return dict(zip(names, (F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)), strict=True))


def members_within(centres: DataFrame, members: DataFrame, radius: float, unit: str = "m", few: bool = False) -> DataFrame:
    """centre, member, distance (in ``unit``) for ``centres`` (centre, lon, lat) and ``members`` (member, lon, lat).

    A radius that is not positive is an error.  Points with a null coordinate match nothing; a member that lies on
    a centre has distance 0.  With ``few``, the caller says that the centres with all their cells fit into the driver
    and each task: they are broadcast, and the members stay where they are.
    """
    metres = radius * UNITS[unit]
    if not metres > 0:
        raise ValueError("radius must be positive")
    angle = min(math.degrees(metres / EARTH), 180.0)
    size = max(angle, 0.0005)
    columns = max(1, math.floor(360 / size))
    width = 360 / columns
    salts = 1 if few else SALTS  # the members of a dense cell are spread over several tasks
    band = lambda lat: F.floor((lat + 90) / F.lit(size)).cast("int")
    cell = lambda column, salt: (F.col("_band").cast("bigint") * columns + F.pmod(column, F.lit(columns))) * salts + salt
    points = members.select("member", F.col("lon").alias("m_lon"), F.col("lat").alias("m_lat")).dropna().withColumn("_band", band(F.col("m_lat")))
    points = points.select("member", "m_lon", "m_lat", cell(F.floor((F.col("m_lon") + 180) / width), F.pmod(F.xxhash64("member"), F.lit(salts))).alias("_place"))

    c = centres.select("centre", F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat")).dropna()
    top = F.greatest(F.abs(F.col("c_lat") + angle), F.abs(F.col("c_lat") - angle))
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(math.radians(min(angle, 90.0)))) / F.cos(F.radians("c_lat")))))
    reach = F.when((top >= 89.999) | F.lit(angle >= 90), 180.0).otherwise(reach + 1e-6)
    west, east = F.floor((F.col("c_lon") - F.col("_reach") + 180) / width), F.floor((F.col("c_lon") + F.col("_reach") + 180) / width)
    last = F.when(F.col("_reach") >= 180, west + columns - 1).otherwise(F.least(east, west + columns - 1))
    c = c.withColumn("_reach", reach).withColumn("_band", F.explode(F.sequence(band(F.col("c_lat") - angle - 1e-6), band(F.col("c_lat") + angle + 1e-6))))
    c = c.withColumn("_column", F.explode(F.sequence(west.cast("int"), last.cast("int")))).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    c = c.select("centre", "c_lon", "c_lat", cell(F.col("_column"), F.col("_salt")).alias("_cell"))
    if not few:
        c, points = c.repartition("_cell"), points.repartition("_place")
    c, points = c.withColumns(_vector("c_lon", "c_lat", ["_x", "_y", "_z"])), points.withColumns(_vector("m_lon", "m_lat", ["_u", "_v", "_w"]))

    # of the pairs in a cell, only those that lie on the circle but for the slack need the formula to be told apart
    gap, limit = 1 - (F.col("_x") * F.col("_u") + F.col("_y") * F.col("_v") + F.col("_z") * F.col("_w")), 2 * math.sin(math.radians(angle) / 2) ** 2
    exact = distance(F.col("c_lon"), F.col("c_lat"), F.col("m_lon"), F.col("m_lat"), unit)
    within = (gap <= limit - SLACK) | ((gap <= limit + SLACK) & (exact <= radius))
    return c.hint("broadcast" if few else "merge").join(points, (F.col("_cell") == F.col("_place")) & within).select("centre", "member", exact.alias("distance"))
