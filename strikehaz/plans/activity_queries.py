"""Activity queries: instants, look-back totals, features, index, weather, time features."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strikehaz.functions import times
from strikehaz.operators import activity, temporal, weather
from strikehaz.plans import geosql
from strikehaz.plans.registry import query
from strikehaz.plans.strike_queries import _GROUP
from strikehaz.plans.views import view, with_views

# counts with the instant of their session, in microseconds
_INSTANTS = """
c AS (SELECT c.*, s.timezone, CASE WHEN s.timezone = 'Not/AZone' THEN NULL ELSE epoch_us(CAST(count_date AS TIMESTAMP)
  + to_minutes(CAST(CASE WHEN start_time_local IS NULL THEN 0 ELSE CAST(split_part(start_time_local, ':', 1) AS INT) * 60 + CAST(split_part(start_time_local, ':', 2) AS INT) END AS BIGINT)))
  + CASE s.timezone WHEN 'Etc/GMT+5' THEN 18000000000 WHEN 'Etc/GMT-1' THEN -3600000000 ELSE 0 END END AS us
  FROM v_counts c LEFT JOIN v_sites s USING (site_id))
"""
_WINDOWS = with_views("queries", "sites", "counts") + "," + _INSTANTS + """,
k AS (SELECT DISTINCT longitude, latitude FROM v_queries), """ + geosql.placed_cte("a", "k", "longitude", "latitude", "longitude AS qlon, latitude AS qlat") + ", " \
    + geosql.placed_cte("s", "v_sites", "longitude", "latitude", "site_id") + ", " + geosql.pair_distance_ctes("a", "s") + f""",
q AS (SELECT query_id, longitude, latitude, epoch_us(query_timestamp_utc) AS us FROM v_queries),
n AS (SELECT qlon, qlat, min_by(site_id, (distance_km, site_id)) AS nid, min(distance_km) AS nd, count(*) FILTER (WHERE distance_km <= 50) AS n50,
  count(*) FILTER (WHERE distance_km <= 100) AS n100, count(*) FILTER (WHERE distance_km <= 250) AS n250 FROM pairs GROUP BY 1, 2),
h AS (SELECT q.query_id, q.us - c.us AS age, c.*, {_GROUP} AS grp, coalesce(species_scientific_name, species_common_name) AS sp,
  row_number() OVER (PARTITION BY q.query_id, c.site_id, c.count_date, c.start_time_local ORDER BY c.count_id) AS rn
  FROM q JOIN pairs p ON p.qlon = q.longitude AND p.qlat = q.latitude AND p.distance_km <= 250 JOIN c ON c.site_id = p.site_id AND c.us >= q.us - 1209600000000 AND c.us < q.us)
"""
_DAY = 86400000000


@query("local_to_utc", with_views("counts", "sites") + "," + _INSTANTS + "SELECT count_id, us FROM c")
def local_to_utc(spark, sf_dir):
    """Session instants from local date, clock and the site's zone; bad zones give null."""
    counts = activity.with_count_instants(view(spark, sf_dir, "counts"), view(spark, sf_dir, "sites"))
    return counts.select("count_id", times.micros(F.col("count_timestamp_utc")).alias("us"))


@query("lookback_totals", _WINDOWS + f"""SELECT query_id, CAST(sum("count") FILTER (WHERE age <= {_DAY}) AS DOUBLE) AS total_birds_previous_24h, CAST(sum("count") FILTER (WHERE age <= {3 * _DAY}) AS DOUBLE) AS total_birds_previous_3d,
  CAST(sum("count") FILTER (WHERE age <= {7 * _DAY}) AS DOUBLE) AS total_birds_previous_7d, CAST(sum("count") AS DOUBLE) AS total_birds_previous_14d FROM q LEFT JOIN h USING (query_id) GROUP BY 1""")
def lookback_totals(spark, sf_dir):
    """Birds in the four look-back windows around every strike's airport; null without a session."""
    sites = view(spark, sf_dir, "sites")
    counts = activity.with_count_instants(view(spark, sf_dir, "counts"), sites)
    return activity.lookback_totals(view(spark, sf_dir, "queries"), sites, counts, id_col="query_id")


_FEATURES = _WINDOWS + f""",
w AS (SELECT query_id, count(*) AS r14, count(*) FILTER (WHERE age <= {7 * _DAY}) AS r7, count(*) FILTER (WHERE age <= {3 * _DAY}) AS r3,
  sum("count") FILTER (WHERE age <= {_DAY}) AS b1, sum("count") FILTER (WHERE age <= {3 * _DAY}) AS b3, sum("count") FILTER (WHERE age <= {7 * _DAY}) AS b7, sum("count") AS b14,
  sum(observation_hours) FILTER (WHERE age <= {7 * _DAY} AND rn = 1) AS hours, count(DISTINCT sp) FILTER (WHERE age <= {7 * _DAY}) AS rich,
  sum("count") FILTER (WHERE age <= {7 * _DAY} AND grp = 'large_bird') AS g1, sum("count") FILTER (WHERE age <= {7 * _DAY} AND grp = 'waterfowl') AS g2,
  sum("count") FILTER (WHERE age <= {7 * _DAY} AND grp = 'gull') AS g3, sum("count") FILTER (WHERE age <= {7 * _DAY} AND grp = 'raptor') AS g4,
  sum("count") FILTER (WHERE age <= {3 * _DAY} AND count_type = 'nocturnal_flight_call') AS t1, sum("count") FILTER (WHERE age <= {7 * _DAY} AND count_type = 'visible_migration') AS t2,
  sum("count") FILTER (WHERE age <= {7 * _DAY} AND count_type = 'capture') AS t3, bool_or(observer_effort_available) FILTER (WHERE age <= {7 * _DAY}) AS eff,
  sum(greatest("count", 0)) FILTER (WHERE age <= {7 * _DAY} AND dir IS NOT NULL) AS dw, sum(greatest("count", 0) * cos(radians(dir))) FILTER (WHERE age <= {7 * _DAY}) AS dx,
  sum(greatest("count", 0) * sin(radians(dir))) FILTER (WHERE age <= {7 * _DAY}) AS dy
  FROM (SELECT *, CASE flight_direction WHEN 'N' THEN 0 WHEN 'NE' THEN 45 WHEN 'E' THEN 90 WHEN 'SE' THEN 135 WHEN 'S' THEN 180 WHEN 'SW' THEN 225 WHEN 'W' THEN 270 WHEN 'NW' THEN 315 END AS dir FROM h) GROUP BY 1),
l AS (SELECT q.query_id, (q.us - max(c.us)) / 3600000000e0 AS age_h FROM q JOIN n ON n.qlon = q.longitude AND n.qlat = q.latitude JOIN c ON c.site_id = n.nid AND c.us < q.us GROUP BY q.query_id, q.us),
f AS (SELECT q.query_id, true AS monitoring_available, nid AS nearest_site_id, nd, n50, n100, n250, age_h, b1, b3, b7, b14, CASE WHEN hours > 0 THEN b7 / hours END AS rate, CASE WHEN r7 > 0 THEN rich END AS rich,
  CASE WHEN r7 > 0 THEN coalesce(g1, 0) END AS g1, CASE WHEN r7 > 0 THEN coalesce(g2, 0) END AS g2, CASE WHEN r7 > 0 THEN coalesce(g3, 0) END AS g3, CASE WHEN r7 > 0 THEN coalesce(g4, 0) END AS g4, t1, t2, t3,
  CASE WHEN dw > 0 THEN sqrt(pow(dx / dw, 2) + pow(dy / dw, 2)) END AS cons, coalesce(eff, false) AS eff, nd > 250 AS far, n250 < 2 AS low,
  round((pow(5e-1, nd / 50) + least(1, n250 / 5e0) + coalesce(pow(5e-1, age_h / 24), 0)) / 3, 4) AS score
  FROM q LEFT JOIN n ON n.qlon = q.longitude AND n.qlat = q.latitude LEFT JOIN w USING (query_id) LEFT JOIN l USING (query_id))
"""


@query("activity_features", _FEATURES + """SELECT query_id, monitoring_available, nearest_site_id, round(nd, 3) AS distance_to_nearest_site_km, n50 AS number_of_sites_within_50_km, n100 AS number_of_sites_within_100_km,
  n250 AS number_of_sites_within_250_km, round(age_h, 6) AS nearest_site_observation_age_hours, CAST(b1 AS DOUBLE) AS total_birds_previous_24h, CAST(b3 AS DOUBLE) AS total_birds_previous_3d, CAST(b7 AS DOUBLE) AS total_birds_previous_7d,
  CAST(b14 AS DOUBLE) AS total_birds_previous_14d, round(rate, 6) AS birds_per_observation_hour_previous_7d, rich AS species_richness_previous_7d, CAST(g1 AS DOUBLE) AS large_bird_count_previous_7d, CAST(g2 AS DOUBLE) AS waterfowl_count_previous_7d,
  CAST(g3 AS DOUBLE) AS gull_count_previous_7d, CAST(g4 AS DOUBLE) AS raptor_count_previous_7d, CAST(t1 AS DOUBLE) AS nocturnal_flight_call_count_previous_3d, CAST(t2 AS DOUBLE) AS migration_count_previous_7d,
  CAST(t3 AS DOUBLE) AS capture_count_previous_7d, round(cons, 6) AS directional_consistency, eff AS observation_effort_available, far AS distance_warning, low AS low_coverage_warning, score AS data_coverage_score FROM f""")
def activity_features(spark, sf_dir):
    """All 24 activity features for every strike's airport and instant."""
    out = feature_rows(spark, sf_dir)
    rounded = {"distance_to_nearest_site_km": 3, "nearest_site_observation_age_hours": 6, "birds_per_observation_hour_previous_7d": 6, "directional_consistency": 6}
    return out.withColumns({c: F.round(c, n) for c, n in rounded.items()})


def feature_rows(spark, sf_dir):
    sites = view(spark, sf_dir, "sites")
    counts = activity.with_count_instants(view(spark, sf_dir, "counts"), sites)
    return activity.activity_features(view(spark, sf_dir, "queries"), sites, counts, id_col="query_id")


@query("activity_index", _FEATURES + """SELECT query_id, CASE WHEN b7 IS NOT NULL AND rate IS NOT NULL THEN round(tanh(ln(1 + greatest(rate, 0)) / 4) * (5e-1 + 5e-1 * score), 4) END AS activity_index,
  CASE WHEN b7 IS NULL OR rate IS NULL THEN 'no_recent_observations' ELSE 'effort_normalized_7d_rate_with_coverage_adjustment' END AS activity_index_basis,
  CASE WHEN b7 IS NULL OR rate IS NULL THEN 'No Trektellen observation session occurred in the previous 7 days within the configured radius - absence of data, not zero activity.'
  WHEN far THEN 'Nearest monitoring site is farther than the configured coverage radius.' WHEN low THEN 'Fewer than the recommended number of monitoring sites are within range.' END AS coverage_caveat FROM f""")
def activity_index(spark, sf_dir):
    """Coverage-adjusted index with basis and caveat for every query."""
    return activity.with_activity_index(feature_rows(spark, sf_dir)).select("query_id", "activity_index", "activity_index_basis", "coverage_caveat")


@query("effort_rate_richness", with_views("counts") + """,
s AS (SELECT site_id, count_date, start_time_local, sum("count") AS b, min_by(coalesce(observation_hours, -99), count_id) AS h FROM v_counts GROUP BY 1, 2, 3),
r AS (SELECT site_id, sum(b) AS birds, sum(nullif(h, -99)) AS hours FROM s GROUP BY 1),
d AS (SELECT site_id, count(DISTINCT coalesce(species_scientific_name, species_common_name)) AS rich FROM v_counts GROUP BY 1)
SELECT site_id, CAST(birds AS BIGINT) AS birds, hours, CASE WHEN hours > 0 THEN round(birds / hours, 6) END AS birds_per_hour, rich AS species_richness FROM r JOIN d USING (site_id)""")
def effort_rate_richness(spark, sf_dir):
    """Rate per observation hour and species richness per site."""
    return activity.effort_rate_and_richness(view(spark, sf_dir, "counts")).withColumn("birds_per_hour", F.round("birds_per_hour", 6))


@query("directional_consistency", with_views("counts") + """,
a AS (SELECT site_id, greatest("count", 0) AS w, radians((list_position(['N','NE','E','SE','S','SW','W','NW'], flight_direction) - 1) * 45e0) AS t FROM v_counts WHERE flight_direction IN ('N','NE','E','SE','S','SW','W','NW')),
s AS (SELECT site_id, sum(w) AS w, sum(w * cos(t)) AS x, sum(w * sin(t)) AS y FROM a GROUP BY 1)
SELECT site_id, CASE WHEN w > 0 THEN round(sqrt(pow(x / w, 2) + pow(y / w, 2)), 6) END AS directional_consistency FROM (SELECT DISTINCT site_id FROM v_counts) LEFT JOIN s USING (site_id)""")
def directional_consistency(spark, sf_dir):
    """Resultant length of flight directions per site."""
    return activity.directional_consistency(view(spark, sf_dir, "counts")).withColumn("directional_consistency", F.round("directional_consistency", 6))


def _weather_sql(future: bool) -> str:
    age = "abs(q.us - o.us)" if future else "q.us - o.us"
    keep = "abs(q.us - o.us) <= 10800000000" if future else "o.us <= q.us AND q.us - o.us <= 10800000000"
    return with_views("queries", "weather") + """,
st AS (SELECT station_id, min_by(longitude, timestamp_utc) AS longitude, min_by(latitude, timestamp_utc) AS latitude FROM v_weather GROUP BY 1),
k AS (SELECT DISTINCT longitude, latitude FROM v_queries), """ + geosql.placed_cte("a", "k", "longitude", "latitude", "longitude AS qlon, latitude AS qlat") + ", " \
        + geosql.placed_cte("s", "st", "longitude", "latitude", "station_id") + ", " + geosql.pair_distance_ctes("a", "s") + f""",
q AS (SELECT query_id, longitude, latitude, epoch_us(query_timestamp_utc) AS us FROM v_queries),
o AS (SELECT station_id, epoch_us(timestamp_utc) AS us, min_by(temperature_c, obs_id) AS temperature_c FROM v_weather GROUP BY 1, 2),
r AS (SELECT q.query_id, p.station_id, p.distance_km, {age} AS age, o.temperature_c, row_number() OVER (PARTITION BY q.query_id ORDER BY p.distance_km, p.station_id, {age}, o.us) AS rn
  FROM q JOIN pairs p ON p.qlon = q.longitude AND p.qlat = q.latitude AND p.distance_km <= 100 JOIN o ON o.station_id = p.station_id AND {keep})
SELECT q.query_id, r.station_id IS NOT NULL AS weather_available, r.station_id, round(r.distance_km, 6) AS weather_station_distance_km, r.age AS weather_observation_age_us, r.temperature_c
FROM q LEFT JOIN (SELECT * FROM r WHERE rn = 1) r USING (query_id)"""


def _weather(spark, sf_dir, future):
    out = weather.asof_weather(
        view(spark, sf_dir, "queries"), view(spark, sf_dir, "weather"), id_col="query_id", measures=["temperature_c"], tie_break="obs_id",
        allow_future=future,
    )
    age = F.round(F.col("weather_observation_age_minutes") * 60_000_000).cast("bigint").alias("weather_observation_age_us")
    return out.select(
        "query_id", "weather_available", "station_id", F.round("weather_station_distance_km", 6).alias("weather_station_distance_km"), age, "temperature_c"
    )


@query("asof_weather", _weather_sql(False).replace("timestamp_utc) AS longitude", "obs_id) AS longitude").replace("timestamp_utc) AS latitude", "obs_id) AS latitude"))
def asof_weather(spark, sf_dir):
    """Freshest prior observation of the nearest station that has one, within 100 km and 3 hours."""
    return _weather(spark, sf_dir, False)


@query("asof_weather_symmetric", _weather_sql(True).replace("timestamp_utc) AS longitude", "obs_id) AS longitude").replace("timestamp_utc) AS latitude", "obs_id) AS latitude"))
def asof_weather_symmetric(spark, sf_dir):
    """The opt-in window on both sides of the query instant."""
    return _weather(spark, sf_dir, True)


@query("counts_before_instant", with_views("counts", "sites") + "," + _INSTANTS + f"""SELECT count_id FROM c WHERE us >= epoch_us(TIMESTAMP '2024-01-20 12:00:00') - {7 * _DAY} AND us < epoch_us(TIMESTAMP '2024-01-20 12:00:00')""")
def counts_before_instant(spark, sf_dir):
    """Counts of the seven days strictly before one instant."""
    counts = activity.with_count_instants(view(spark, sf_dir, "counts"), view(spark, sf_dir, "sites"))
    at = F.lit("2024-01-20 12:00:00").cast("timestamp")
    return counts.where(temporal.in_lookback(F.col("count_timestamp_utc"), at, 168)).select("count_id")


_TWO_PI = repr(2 * math.pi)


@query("cyclic_time", with_views("queries") + f"""
SELECT query_id, year(t) AS year, month(t) AS month, dayofyear(t) AS day_of_year, hour(t) AS hour_local, round(sin({_TWO_PI} * month(t) / 12), 9) AS month_sin, round(cos({_TWO_PI} * month(t) / 12), 9) AS month_cos,
  round(sin({_TWO_PI} * dayofyear(t) / 365.25e0), 9) AS day_of_year_sin, round(cos({_TWO_PI} * dayofyear(t) / 365.25e0), 9) AS day_of_year_cos, round(sin({_TWO_PI} * hour(t) / 24), 9) AS hour_sin, round(cos({_TWO_PI} * hour(t) / 24), 9) AS hour_cos,
  CASE WHEN month(t) IN (12, 1, 2) THEN 'winter' WHEN month(t) <= 5 THEN 'spring' WHEN month(t) <= 8 THEN 'summer' ELSE 'fall' END AS season, month(t) IN (3, 4, 5, 8, 9, 10) AS is_migration_season
FROM (SELECT query_id, query_timestamp_utc + to_days(CAST(query_id % 366 AS INT)) AS t FROM v_queries)""")
def cyclic_time(spark, sf_dir):
    """Calendar parts with sine-cosine pairs, season and migration flag."""
    shifted = view(spark, sf_dir, "queries").select(
        "query_id", (F.col("query_timestamp_utc") + F.make_dt_interval((F.col("query_id") % 366).cast("int"))).alias("t")
    )
    columns = times.time_features(F.col("t"))
    out = shifted.select("query_id", *[c.alias(n) for n, c in columns.items() if not n.startswith(("is_d", "is_n"))])
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c.endswith(("_sin", "_cos"))})


_SUN = """
g AS (SELECT *, {p} / 365 * (dayofyear(t + to_seconds(CAST(trunc(lon * 240) AS BIGINT))) - 1) AS g, (((hour(t) * 60 + minute(t) + lon * 4) % 1440) + 1440) % 1440 AS solar FROM x),
e AS (SELECT *, 229.18e0 * (0.000075e0 + 0.001868e0 * cos(g) - 0.032077e0 * sin(g) - 0.014615e0 * cos(2 * g) - 0.040849e0 * sin(2 * g)) AS eq,
  0.006918e0 - 0.399912e0 * cos(g) + 0.070257e0 * sin(g) - 0.006758e0 * cos(2 * g) + 0.000907e0 * sin(2 * g) - 0.002697e0 * cos(3 * g) + 0.00148e0 * sin(3 * g) AS d FROM g),
h AS (SELECT *, 720 - eq AS noon, cos(radians(90.833e0)) / (cos(radians(lat)) * cos(d)) - tan(radians(lat)) * tan(d) AS c1, cos(radians(96e0)) / (cos(radians(lat)) * cos(d)) - tan(radians(lat)) * tan(d) AS c2 FROM e),
s AS (SELECT *, CASE WHEN abs(c1) <= 1 THEN degrees(acos(greatest(-1, least(1, c1)))) * 4 END AS h1, CASE WHEN abs(c2) <= 1 THEN degrees(acos(greatest(-1, least(1, c2)))) * 4 END AS h2 FROM h)
""".replace("{p}", _TWO_PI)


@query("sun_phase", with_views("queries") + ", x AS (SELECT query_id, query_timestamp_utc + to_days(CAST(query_id % 366 AS INT)) AS t, longitude AS lon, latitude AS lat FROM v_queries)," + _SUN + """
SELECT query_id, CASE WHEN h1 + h2 IS NOT NULL THEN solar >= noon - h2 AND solar < noon - h1 END AS is_dawn, CASE WHEN h1 + h2 IS NOT NULL THEN solar >= noon + h1 AND solar < noon + h2 END AS is_dusk,
  CASE WHEN h1 + h2 IS NOT NULL THEN solar < noon - h2 OR solar >= noon + h2 END AS is_night FROM s""")
def sun_phase(spark, sf_dir):
    """Dawn, dusk and night from solar position at date and place."""
    t = F.col("query_timestamp_utc") + F.make_dt_interval((F.col("query_id") % 366).cast("int"))
    rows = view(spark, sf_dir, "queries").select("query_id", t.alias("t"), "latitude", "longitude")
    return rows.select("query_id", *[c.alias(n) for n, c in times.sun_phase(F.col("t"), F.col("latitude"), F.col("longitude")).items()])
