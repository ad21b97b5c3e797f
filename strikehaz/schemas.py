"""Declared logical schemas.  Fixed values: field names, order and types."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

from strikehaz.fixed_values import STRIKE_ALIASES

_STRIKE_DOUBLES = [
    "latitude", "longitude", "height_agl_ft", "speed_ias_knots", "engine_count", "repair_cost",
    "other_cost", "injuries", "fatalities",
]


_TYPES = {
    "STRING": StringType(), "DOUBLE": DoubleType(), "INT": IntegerType(), "BOOLEAN": BooleanType(), "DATE": DateType(),
    "TIMESTAMP": TimestampType(), "TIMESTAMP_NTZ": TimestampNTZType(),
}


def _struct(text: str) -> StructType:
    """'name TYPE, ...' -> StructType, without needing a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


STRIKES = _struct(", ".join(
    f"{f} {'TIMESTAMP_NTZ' if f == 'incident_date' else 'DOUBLE' if f in _STRIKE_DOUBLES else 'STRING'}"
    for f in STRIKE_ALIASES
))

SITES = _struct(
    "site_id STRING, site_name STRING, country STRING, latitude DOUBLE, longitude DOUBLE, count_type STRING, "
    "timezone STRING, site_active_from DATE, site_active_to DATE"
)

COUNTS = _struct(
    "count_id STRING, site_id STRING, count_date DATE, start_time_local STRING, end_time_local STRING, "
    "observation_hours DOUBLE, species_common_name STRING, species_scientific_name STRING, species_code STRING, "
    "count INT, flight_direction STRING, count_type STRING, weather_notes STRING, observer_effort_available BOOLEAN"
)

AIRPORTS = _struct(
    "airport_id STRING, icao STRING, iata STRING, faa_lid STRING, airport_name STRING, latitude DOUBLE, "
    "longitude DOUBLE, elevation_ft DOUBLE, airport_type STRING, runway_count DOUBLE, longest_runway_ft DOUBLE, "
    "state STRING, country STRING"
)

WEATHER = _struct(
    "station_id STRING, timestamp_utc TIMESTAMP, latitude DOUBLE, longitude DOUBLE, temperature_c DOUBLE, "
    "dewpoint_c DOUBLE, relative_humidity_pct DOUBLE, wind_speed_knots DOUBLE, wind_direction_deg DOUBLE, "
    "wind_gust_knots DOUBLE, visibility_km DOUBLE, precipitation_mm DOUBLE, pressure_hpa DOUBLE, "
    "cloud_ceiling_ft DOUBLE, present_weather_code STRING, quality_flag STRING"
)

ENVIRONMENT = _struct(
    "distance_to_water_km DOUBLE, water_area_within_5km DOUBLE, wetland_area_within_10km DOUBLE, "
    "agricultural_area_within_10km DOUBLE, urban_area_within_10km DOUBLE, landfill_distance_km DOUBLE, "
    "habitat_data_available BOOLEAN"
)

# One row per airport and date.  Cell columns hold this package's own equal-area cell keys.
AIRPORT_DAY = _struct(
    "airport_id STRING, date TIMESTAMP_NTZ, observation_id STRING, "
    "latitude DOUBLE, longitude DOUBLE, elevation_ft DOUBLE, cell_r5 STRING, cell_r7 STRING, "
    "distance_to_water_km DOUBLE, distance_to_wetland_km DOUBLE, distance_to_coastline_km DOUBLE, "
    "distance_to_landfill_km DOUBLE, distance_to_migration_corridor_km DOUBLE, habitat_data_available BOOLEAN, "
    "timestamp_utc TIMESTAMP, timestamp_local TIMESTAMP_NTZ, hour_local DOUBLE, month INT, day_of_year INT, "
    "season STRING, is_migration_season BOOLEAN, daylight_category STRING, hours_from_sunrise DOUBLE, "
    "hours_from_sunset DOUBLE, "
    "species_or_group STRING, estimated_abundance DOUBLE, relative_abundance_index DOUBLE, "
    "seasonal_presence STRING, migration_intensity DOUBLE, observation_effort_hours DOUBLE, "
    "distance_from_bird_observation_to_airport_km DOUBLE, bird_data_source STRING, bird_data_resolution STRING, "
    "bird_data_available BOOLEAN, "
    "temperature_c_mean DOUBLE, precipitation_mm_total DOUBLE, visibility_km_min DOUBLE, "
    "wind_speed_knots_mean DOUBLE, wind_direction_deg_mean DOUBLE, cloud_ceiling_ft_min DOUBLE, "
    "severe_weather_flag BOOLEAN, weather_station_distance_km DOUBLE, weather_available BOOLEAN, "
    "departures DOUBLE, arrivals DOUBLE, total_movements DOUBLE, predominant_aircraft_class STRING, "
    "exposure_data_available BOOLEAN, "
    "strike_count DOUBLE, strike_count_basis STRING, damage_rate_given_strike DOUBLE, injury_flag BOOLEAN, "
    "species_involved STRING, relative_hazard_index DOUBLE, relative_hazard_index_basis STRING, "
    "activity_index DOUBLE"
)
AIRPORT_DAY_REQUIRED = ["airport_id", "date", "observation_id", "latitude", "longitude"]
AIRPORT_DAY_COMPANIONS = [
    ("estimated_abundance", "bird_data_resolution"),
    ("relative_abundance_index", "bird_data_resolution"),
    ("migration_intensity", "bird_data_resolution"),
]
