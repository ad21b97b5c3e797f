"""Sources and lookups over columns of the given tables: padded schemas, airport attributes, renamed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikehaz.plans.registry import query
from strikehaz.plans.views import table, view, with_views
from strikehaz.schemas import SITES, WEATHER
from strikehaz.sources import monitoring, places

_ASKED = "q AS (SELECT query_id, CASE WHEN query_id % 17 = 0 THEN -query_id ELSE query_id % 1500 END AS airport_id FROM v_queries)"


def _asked(spark, sf_dir):
    """Query rows with an airport id, some of them unknown."""
    k = F.col("query_id")
    return view(spark, sf_dir, "queries").select("query_id", F.when(k % 17 == 0, -k).otherwise(k % 1500).alias("airport_id"))


def _airports(spark, sf_dir):
    return monitoring.padded(view(spark, sf_dir, "airports").withColumn("airport_id", F.col("airport_id").cast("string")), places.AIRPORTS)


@query("airport_attributes", with_views("queries", "airports") + f""", {_ASKED}
SELECT query_id, CAST(q.airport_id AS VARCHAR) AS airport_id, airport_name, state, round(latitude, 6) AS latitude FROM q JOIN v_airports a ON a.airport_id = q.airport_id""")
def airport_attributes(spark, sf_dir):
    """Attributes of each query's airport."""
    asked = _asked(spark, sf_dir).withColumn("airport_id", F.col("airport_id").cast("string"))
    return places.with_airport(asked, _airports(spark, sf_dir)).select("query_id", "airport_id", "airport_name", "state", F.round("latitude", 6).alias("latitude"))


@query("unknown_airports", with_views("queries", "airports") + f""", {_ASKED}
SELECT query_id, CAST(airport_id AS VARCHAR) AS airport_id FROM q WHERE airport_id NOT IN (SELECT airport_id FROM v_airports)""")
def unknown_airports(spark, sf_dir):
    """Query rows whose airport does not exist."""
    asked = _asked(spark, sf_dir).withColumn("airport_id", F.col("airport_id").cast("string"))
    return places.unknown_airports(asked, _airports(spark, sf_dir)).select("query_id", "airport_id")


@query("world_airports", """
SELECT CAST(c_custkey AS VARCHAR) AS airport_id, c_mktsegment AS airport_type, c_name AS airport_name, round(c_custkey % 90 + 25e-2, 6) AS latitude,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey * 3e0 END AS elevation_ft, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) ELSE 'X-' || c_nationkey END AS state,
  CAST(c_nationkey AS VARCHAR) AS country, CAST(NULL AS DOUBLE) AS runway_count FROM customer""")
def world_airports(spark, sf_dir):
    """Public world-airport columns renamed, typed and padded."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    raw = table(spark, sf_dir, "customer").select(
        k.cast("string").alias("ident"), F.lit(None).cast("string").alias("icao_code"), F.lit(None).cast("string").alias("iata_code"), nation.alias("local_code"),
        F.col("c_name").alias("name"), (k % 90 + 0.25).cast("string").alias("latitude_deg"), F.lit("0").alias("longitude_deg"),
        F.when(k % 9 == 0, "unknown").otherwise((k * 3).cast("string")).alias("elevation_ft"), F.col("c_mktsegment").alias("type"),
        F.concat(F.when(F.col("c_nationkey") % 2 == 0, "US-").otherwise("X-"), nation).alias("iso_region"), nation.alias("iso_country"))
    return places.world_airports(raw).select(
        "airport_id", "airport_type", "airport_name", F.round("latitude", 6).alias("latitude"), "elevation_ft", "state", "country", "runway_count")


@query("typed_sites", with_views("sites") + """
SELECT CAST(site_id AS VARCHAR) AS site_id, site_name, CAST(NULL AS VARCHAR) AS country, CASE WHEN site_id % 7 = 0 THEN NULL ELSE round(latitude, 6) END AS latitude,
  timezone, CASE WHEN site_id % 3 = 0 THEN NULL ELSE strftime(DATE '2021-06-01' + CAST(site_id % 20 AS INT), '%Y-%m-%d') END AS site_active_from FROM v_sites""")
def typed_sites(spark, sf_dir):
    """Sites as text in the declared types; bad values are null, absent columns added."""
    k = F.col("site_id")
    text = view(spark, sf_dir, "sites").select(
        k.cast("string").alias("site_id"), "site_name", F.when(k % 7 == 0, "north").otherwise(F.col("latitude").cast("string")).alias("latitude"), "timezone",
        F.when(k % 3 == 0, "06-2021").otherwise(F.date_format(F.date_add(F.lit("2021-06-01").cast("date"), (k % 20).cast("int")), "M/d/yyyy")).alias("site_active_from"))
    return monitoring.padded(text, SITES).select(
        "site_id", "site_name", "country", F.round("latitude", 6).alias("latitude"), "timezone", F.date_format("site_active_from", "yyyy-MM-dd").alias("site_active_from"))


@query("typed_counts", with_views("counts") + """
SELECT CAST(count_id AS VARCHAR) AS count_id, CASE WHEN count_id % 19 = 0 THEN NULL ELSE "count" END AS n, CAST(count_date AS VARCHAR) AS count_date, CAST(NULL AS VARCHAR) AS species_code FROM v_counts""")
def typed_counts(spark, sf_dir):
    """Long counts as text in the declared types; a count beyond 32 bits is null."""
    rows = view(spark, sf_dir, "counts")
    text = rows.select(
        F.col("count_id").cast("string").alias("count_id"), F.col("count_date").cast("string").alias("count_date"),
        F.when(F.col("count_id") % 19 == 0, "3000000000").otherwise(F.col("count").cast("string")).alias("count"), "species_common_name")
    return monitoring.long_counts(text).select("count_id", F.col("count").alias("n"), F.col("count_date").cast("string").alias("count_date"), "species_code")


@query("typed_weather", with_views("weather") + """
SELECT CAST(obs_id AS VARCHAR) AS obs_id, CAST(station_id AS VARCHAR) AS station_id, round(temperature_c, 6) AS temperature_c, CAST(NULL AS DOUBLE) AS wind_speed_knots,
  epoch_us(timestamp_utc) AS at FROM v_weather""")
def typed_weather(spark, sf_dir):
    """Station weather in the declared types, absent measures null."""
    rows = view(spark, sf_dir, "weather").withColumns({
        "obs_id": F.col("obs_id").cast("string"), "station_id": F.col("station_id").cast("string"),
        "timestamp_utc": F.try_to_timestamp(F.col("timestamp_utc").cast("string"))})
    return monitoring.padded(rows, WEATHER).select(
        "obs_id", "station_id", F.round("temperature_c", 6).alias("temperature_c"), "wind_speed_knots", F.unix_micros("timestamp_utc").alias("at"))


@query("text_fingerprints", """
SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents""")
def text_fingerprints(spark, sf_dir):
    """Length and SHA-256 of every text."""
    content = F.coalesce("text", F.lit("")).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(content).cast("bigint").alias("n_bytes"), F.sha2(content, 256).alias("sha256"))
