"""Geospatial operators (O-08, J-05, J-07 helpers) on top of ``functions.geo``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiloqueue.functions import geo


def filter_by_radius(df: DataFrame, centre_lat: float, centre_lng: float, radius_km: float,
                     lat: str = "lat", lng: str = "lng", sort: bool = True) -> DataFrame:
    """O-08: rows within ``radius_km`` of a point, nearest first, distance dropped.

    The bounding box (X-16) is applied first as a plain range predicate, which
    parquet can push down and which prunes row groups before the exact test.
    """
    d = geo.haversine_km(F.lit(centre_lat), F.lit(centre_lng), F.col(lat), F.col(lng))
    out = (df.where(geo.in_box(F.col(lat), F.col(lng), centre_lat, centre_lng, radius_km))
           .withColumn("_dist_km", d).where(F.col("_dist_km") <= radius_km))
    if sort:
        out = out.orderBy("_dist_km")
    return out.drop("_dist_km")


def stations_within(points: DataFrame, stations: DataFrame, radius_km: float,
                    point_lat: str = "lat", point_lng: str = "lng") -> DataFrame:
    """J-07 generalised: every (point, station) pair within ``radius_km`` via the grid join."""
    st = stations.select(*[F.col(c).alias(f"st_{c}") for c in stations.columns])
    pairs = geo.within_radius_pairs(points, st, point_lat, point_lng, "st_lat", "st_lng", radius_km)
    return pairs.where(F.col("distance_km") <= radius_km)
