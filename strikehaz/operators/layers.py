"""Map layers: metadata stamp, Esri-shaped features and the publishability check."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.functions import geo
from strikehaz.operators.spatial import spread


@dataclass(frozen=True)
class LayerStamp:
    """What every exported row carries (K6)."""

    source: str
    sample_data_flag: bool
    model_version: str = "n/a"
    crs: str = "EPSG:4326"


def stamped(df: DataFrame, stamp: LayerStamp, generated_at: Column | None = None) -> DataFrame:
    """Adds source, generated_at, crs, sample_data_flag and model_version (K6)."""
    now = generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return df.withColumns({
        "source": F.lit(stamp.source), "generated_at": now, "crs": F.lit(stamp.crs),
        "sample_data_flag": F.lit(stamp.sample_data_flag), "model_version": F.lit(stamp.model_version),
    })


def _geometry(kind: str, lon: str, lat: str, shape: str) -> Column:
    ref = F.struct(F.lit(4326).alias("wkid")).alias("spatialReference")
    if kind == "point":
        present = F.col(lon).isNotNull() & F.col(lat).isNotNull()
        return F.when(present, F.struct(F.col(lon).alias("x"), F.col(lat).alias("y"), ref))
    corners = F.transform(F.col(shape), lambda c: F.array(c["lon"], c["lat"]))
    name = {"polygon": "rings", "line": "paths"}[kind]
    return F.when(F.col(shape).isNotNull(), F.struct(F.array(corners).alias(name), ref))


def esri_features(df: DataFrame, kind: str = "point", lon: str = "longitude", lat: str = "latitude", shape: str = "ring") -> DataFrame:
    """(geometry, attributes) JSON per row; a missing geometry is null and keeps its attributes (K9).

    `kind` is point, polygon or line; the latter two read an array of
    struct(lon, lat) from `shape`.
    """
    attributes = [c for c in df.columns if kind == "point" or c != shape]
    return df.select(
        F.to_json(_geometry(kind, lon, lat, shape)).alias("geometry"),
        F.to_json(F.struct(*attributes), {"ignoreNullFields": "false"}).alias("attributes"),
    )


def layer_check(df: DataFrame, crs: str | None = "EPSG:4326", lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One row of publishability checks: CRS, null geometries, name length, case collisions."""
    lowered = [c.lower() for c in df.columns]
    too_long = [c for c in df.columns if len(c) > 31]
    clash = sorted({c for c in lowered if lowered.count(c) > 1})
    nulls = F.count_if(F.col(lon).isNull() | F.col(lat).isNull()) if {lon, lat} <= set(df.columns) else F.count("*")
    return df.agg(nulls.alias("n_null_geometry")).select(
        F.lit(crs is not None).alias("has_crs"),
        "n_null_geometry",
        (F.col("n_null_geometry") == 0).alias("no_null_geometry"),
        F.lit(not too_long).alias("field_names_valid_length"),
        F.lit(not clash).alias("no_case_insensitive_collisions"),
        (F.lit(crs is not None and not too_long and not clash) & (F.col("n_null_geometry") == 0)).alias("passed"),
    )


def publishable_features(df: DataFrame, layer_name: str, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Point features of a layer that passed its check, no rows otherwise (K9)."""
    passed = layer_check(df, lon=lon, lat=lat).select("passed").scalar()
    return esri_features(df, lon=lon, lat=lat).where(passed).withColumn("layer_name", F.lit(layer_name))


def geojson_features(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """One GeoJSON Feature text per row (K3)."""
    point = F.when(
        F.col(lon).isNotNull() & F.col(lat).isNotNull(),
        F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates")),
    )
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*df.columns).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value"))


def geo_table(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Adds the point as WKT."""
    return df.withColumn("geometry_wkt", geo.point_wkt(lon, lat))


def buffer_layer(airports: DataFrame, radius_km: float, corners: int = 64) -> DataFrame:
    """Airports with their planar buffer as WKT; outside the regions a null polygon and the reason."""
    # placed before the exchange, else each corner works its airport's position out anew
    located = spread(airports.withColumn("_p", geo.placed("longitude", "latitude")), "longitude", "latitude", *airports.columns[:1])
    ring = located.withColumn("ring", geo.buffer_ring(F.col("_p"), radius_km, corners))
    return ring.select(
        *airports.columns, "ring", geo.ring_wkt(F.col("ring")).alias("geometry_wkt"),
        geo.buffer_reason(F.col("_p")).alias("buffer_unavailable_reason"), F.lit(float(radius_km)).alias("buffer_radius_km"),
    )
