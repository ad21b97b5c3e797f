"""As-of weather with spatial fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.fixed_values import WEATHER_MAX_AGE_HOURS, WEATHER_MAX_KM
from strikehaz.functions.times import micros
from strikehaz.operators.around import around, nearest_fresh
from strikehaz.operators.spatial import within_radius
from strikehaz.operators.temporal import HOUR
from strikehaz.session import durable


def asof_weather(
    queries: DataFrame, weather: DataFrame, *, id_col: str, at_col: str = "query_timestamp_utc",
    measures: list[str], tie_break: str | None = None, max_distance_km: float = WEATHER_MAX_KM,
    max_age_hours: float = WEATHER_MAX_AGE_HOURS, allow_future: bool = False,
) -> DataFrame:
    """Nearest station (within range) that has a fresh observation, and that observation.

    Stations are tried by distance, then id; `allow_future` is the opt-in
    symmetric window.  Queries without a match keep a row with
    weather_available = false and nulls.  A station's position is that of its
    lowest `tie_break` row; of several observations of one station and instant
    the lowest `tie_break` row counts.
    """
    order = tie_break or "timestamp_utc"
    obs = weather.groupBy("station_id", micros(F.col("timestamp_utc")).alias("ts")).agg(
        F.min_by(F.struct(*measures), F.col(order)).alias("measured")
    )
    stations = weather.groupBy("station_id").agg(
        F.min_by(F.struct("longitude", "latitude"), F.struct(order)).alias("spot")
    ).select("station_id", "spot.longitude", "spot.latitude")

    asked = queries.select(
        id_col, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), micros(F.col(at_col)).alias("at")
    )
    instants = asked.select("lon", "lat", "at").distinct()
    pairs = within_radius(instants.select("lon", "lat").distinct(), stations, max_distance_km)
    types = dict(obs.dtypes)
    age = int(max_age_hours * HOUR)
    found = around(
        instants, durable(pairs.select("lon", "lat", "station_id", "distance_km")), obs,
        nearest_fresh("station_id", types["station_id"], "measured", types["measured"], age, allow_future),
        key="station_id", ts="ts", radius_km=max_distance_km, back=age, ahead=age if allow_future else 0, step=max(age, 24 * HOUR))
    best = found.groupBy("lon", "lat", "at").agg(
        F.min_by(F.struct("station_id", "distance_km", "age", "hit"), F.struct("distance_km", "station_id")).alias("best")
    )
    return asked.join(best, ["lon", "lat", "at"], "left").select(
        id_col, F.col("best").isNotNull().alias("weather_available"), F.col("best.station_id").alias("station_id"),
        F.col("best.distance_km").alias("weather_station_distance_km"),
        (F.col("best.age") / F.lit(HOUR // 60)).alias("weather_observation_age_minutes"),
        *[F.col(f"best.hit.{m}").alias(m) for m in measures],
    )
