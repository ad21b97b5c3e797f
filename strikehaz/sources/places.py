"""Airport and weather scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.functions.coerce import number
from strikehaz.schemas import AIRPORTS, WEATHER
from strikehaz.sources.monitoring import padded
from strikehaz.sources.strikes import read_text_csv


def airports_from_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Feature collection of points; coordinates come from the geometry when the properties lack them.

    A collection is one JSON value, so it is read whole by one task; large
    layers should be newline-delimited features, which also work here.
    """
    raw = spark.read.json(path, multiLine=not path.endswith("l"))
    feature = raw.select(F.explode("features").alias("f")).select("f.*") if "features" in raw.columns else raw
    spot = F.col("geometry.coordinates")
    flat = feature.select("properties.*", F.get(spot, F.lit(0)).alias("_lon"), F.get(spot, F.lit(1)).alias("_lat"))
    if not {"latitude", "longitude"} <= set(flat.columns):
        flat = flat.drop("latitude", "longitude").withColumnsRenamed({"_lon": "longitude", "_lat": "latitude"})
    return padded(flat.drop("_lon", "_lat"), AIRPORTS)


def scan_airports(spark: SparkSession, path: str) -> DataFrame:
    """Airports from GeoJSON or CSV in the canonical schema."""
    name = path.lower()
    if name.endswith((".geojson", ".geojsonl")):
        return airports_from_geojson(spark, path)
    if name.endswith(".csv"):
        return padded(read_text_csv(spark, path), AIRPORTS)
    raise ValueError(f"Unsupported airport format: {path} (expected .geojson or .csv)")


def world_airports(raw: DataFrame) -> DataFrame:
    """Public world-airport columns to the canonical schema; runway columns are not in that source."""
    renamed = raw.select(
        F.col("ident").alias("airport_id"), F.col("icao_code").alias("icao"), F.col("iata_code").alias("iata"),
        F.col("local_code").alias("faa_lid"), F.col("name").alias("airport_name"),
        F.col("latitude_deg").alias("latitude"), F.col("longitude_deg").alias("longitude"), "elevation_ft",
        F.col("type").alias("airport_type"), F.regexp_replace("iso_region", "^US-", "").alias("state"),
        F.col("iso_country").alias("country"),
    )
    return padded(renamed, AIRPORTS)


def with_airport(df: DataFrame, airports: DataFrame, on: str = "airport_id") -> DataFrame:
    """Attributes of each row's airport; the join strategy is left to measured sizes."""
    known = airports.select(*AIRPORTS.names)
    if on != "airport_id":
        known = known.withColumnRenamed("airport_id", on)
    return df.join(known, on)


def unknown_airports(df: DataFrame, airports: DataFrame) -> DataFrame:
    """Query rows whose airport does not exist."""
    return df.join(airports.select("airport_id"), "airport_id", "left_anti")


def scan_weather(spark: SparkSession, path: str) -> DataFrame:
    """Hourly station weather from Parquet or CSV, instants in UTC."""
    name = path.lower()
    if name.endswith(".parquet"):
        raw = spark.read.parquet(path)
    elif name.endswith(".csv"):
        raw = read_text_csv(spark, path)
    else:
        raise ValueError(f"Unsupported weather format: {path} (expected .parquet or .csv)")
    if dict(raw.dtypes)["timestamp_utc"] == "string":
        raw = raw.withColumn("timestamp_utc", F.try_to_timestamp("timestamp_utc"))
    return padded(raw, WEATHER)


def habitat_cells_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gridded habitat layer: longitude, latitude, area_km2 per cell centre."""
    raw = read_text_csv(spark, path)
    return raw.select(*[number(F.col(c)).alias(c) for c in ("longitude", "latitude", "area_km2")])
