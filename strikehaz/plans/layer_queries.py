"""Export-shaped queries: features, layer checks, stamps, catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikehaz.operators import layers
from strikehaz.plans.registry import query
from strikehaz.plans.views import table, view, with_views
from strikehaz.sources import reports

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
COLUMNS = {
    "region": "r_regionkey, r_name", "nation": "n_nationkey, n_name, n_regionkey", "labels": "doc_id, quality, toxic",
}


def _holed(spark, sf_dir):
    """Airports, every 13th without coordinates."""
    gone = F.col("airport_id") % 13 == 0
    return view(spark, sf_dir, "airports").withColumns({c: F.when(~gone, F.col(c)) for c in ("latitude", "longitude")})


@query("esri_features", with_views("airports") + """ SELECT airport_id, CASE WHEN airport_id % 13 <> 0 THEN longitude END AS x, CASE WHEN airport_id % 13 <> 0 THEN latitude END AS y,
  CASE WHEN airport_id % 13 <> 0 THEN 4326 END AS wkid, airport_name FROM v_airports""")
def esri_features(spark, sf_dir):
    """Feature records flattened back; rows without geometry keep their attributes (K9)."""
    made = layers.esri_features(_holed(spark, sf_dir))
    g = F.from_json("geometry", "x double, y double, spatialReference struct<wkid: int>")
    a = F.from_json("attributes", "airport_id bigint, airport_name string")
    return made.select(g.alias("g"), a.alias("a")).select(
        "a.airport_id", F.col("g.x").alias("x"), F.col("g.y").alias("y"), F.col("g.spatialReference.wkid").alias("wkid"), "a.airport_name"
    )


@query("layer_check", with_views("airports") + """ SELECT true AS has_crs, count(*) FILTER (WHERE airport_id % 13 = 0) AS n_null_geometry, count(*) FILTER (WHERE airport_id % 13 = 0) = 0 AS no_null_geometry,
  true AS field_names_valid_length, true AS no_case_insensitive_collisions, count(*) FILTER (WHERE airport_id % 13 = 0) = 0 AS passed FROM v_airports""")
def layer_check(spark, sf_dir):
    """Publishability checks of a layer."""
    return layers.layer_check(_holed(spark, sf_dir))


@query("publishable_features", with_views("airports") + """ SELECT 'airport_activity' AS layer_name, CAST(count(*) AS BIGINT) AS n FROM v_airports""")
def publishable_features(spark, sf_dir):
    """Features of a clean layer; a layer that fails its check yields none."""
    clean = layers.publishable_features(view(spark, sf_dir, "airports"), "airport_activity")
    withheld = layers.publishable_features(_holed(spark, sf_dir), "withheld")
    return clean.unionByName(withheld).groupBy("layer_name").agg(F.count("*").alias("n"))


@query("geojson_layer", with_views("airports") + """ SELECT airport_id, 'Point' AS kind, longitude AS x, latitude AS y, 'synthetic' AS source, true AS sample_data_flag FROM v_airports""")
def geojson_layer(spark, sf_dir):
    """Stamped GeoJSON features read back (K3, K6)."""
    stamp = layers.LayerStamp("synthetic", True)
    made = layers.geojson_features(layers.stamped(view(spark, sf_dir, "airports"), stamp))
    f = F.from_json("value", "geometry struct<type: string, coordinates: array<double>>, properties struct<airport_id: bigint, source: string, sample_data_flag: boolean>")
    return made.select(f.alias("f")).select(
        "f.properties.airport_id", F.col("f.geometry.type").alias("kind"), F.get("f.geometry.coordinates", F.lit(0)).alias("x"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("y"), "f.properties.source", "f.properties.sample_data_flag",
    )


@query("stamped_layer", with_views("sites") + """ SELECT site_id, 'synthetic' AS source, 'EPSG:4326' AS crs, true AS sample_data_flag, 'n/a' AS model_version, '2024-01-01' AS generated_at,
  concat('POINT(', CAST(longitude AS VARCHAR), ' ', CAST(latitude AS VARCHAR), ')') AS geometry_wkt FROM v_sites""")
def stamped_layer(spark, sf_dir):
    """Metadata on every row and the point as WKT."""
    out = layers.geo_table(layers.stamped(view(spark, sf_dir, "sites"), layers.LayerStamp("synthetic", True), F.lit("2024-01-01")))
    return out.select("site_id", "source", "crs", "sample_data_flag", "model_version", "generated_at", "geometry_wkt")


@query("catalog_metadata", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, (SELECT count(*) FROM (DESCRIBE {t})) AS column_count FROM {t}" for t in TABLES
))
def catalog_metadata(spark, sf_dir):
    """Rows and columns of every table (K7)."""
    out = None
    for name in TABLES:
        row = reports.table_entry(table(spark, sf_dir, name), name, f"{name}.parquet", name).select("table_name", "row_count", "column_count")
        out = row if out is None else out.unionByName(row)
    return out


@query("quality_sections", with_views("strikes", "counts") + """ SELECT 'strikes' AS section, 'rows' AS "key", CAST(count(*) AS VARCHAR) AS value FROM v_strikes
UNION ALL SELECT 'count_types', count_type, CAST(count(*) AS VARCHAR) FROM v_counts GROUP BY 2""")
def quality_sections(spark, sf_dir):
    """Report sections stacked as (section, key, value) (K8)."""
    strikes = view(spark, sf_dir, "strikes").agg(F.count("*").alias("n")).withColumn("k", F.lit("rows"))
    types = view(spark, sf_dir, "counts").groupBy("count_type").agg(F.count("*").alias("n"))
    return reports.quality_rows("strikes", strikes, "k", "n").unionByName(reports.quality_rows("count_types", types, "count_type", "n"))
