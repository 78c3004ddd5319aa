"""Dimension lookups (J1): attach attributes of a small table by key.

How the dimension reaches the facts is left to the planner, which broadcasts
it by its measured size.  Keys missing from the dimension
are dropped (inner join), as the map view drops unknown countries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

# Map coordinates (latitude, longitude) of the country codes the
# dashboard knows.
COUNTRY_COORDS = {
    "US": (37.09, -95.71), "UK": (55.37, -3.43), "FR": (46.22, 2.21),
    "MA": (31.79, -7.09), "JP": (36.20, 138.25), "BR": (-14.23, -51.92),
    "DE": (51.16, 10.45), "IN": (20.59, 78.96), "CA": (56.13, -106.34),
    "AU": (-25.27, 133.77),
}

COORDS_SCHEMA = StructType([StructField("location", StringType(), False),
                            StructField("lat", DoubleType(), False),
                            StructField("lng", DoubleType(), False)])


def coords_frame(spark: SparkSession, coords: dict | None = None) -> DataFrame:
    items = sorted((coords or COUNTRY_COORDS).items())
    return spark.createDataFrame([(k, v[0], v[1]) for k, v in items], COORDS_SCHEMA)


def attach(facts: DataFrame, dimension: DataFrame, key: str = "location") -> DataFrame:
    """Inner join ``facts`` with ``dimension`` on ``key``."""
    return facts.join(dimension, key, "inner")
