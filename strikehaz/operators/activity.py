"""Bird activity around a place before an instant, for whole tables of queries in one plan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.functions import geo
from strikehaz.functions.coerce import number
from strikehaz.functions.names import species_group
from strikehaz.functions.times import local_to_utc, micros
from strikehaz.operators.around import around, window_distinct, window_sums
from strikehaz.operators.spatial import nearest, within_radius
from strikehaz.operators.temporal import HOUR, latest_before
from strikehaz.session import durable

GROUPS = ["large_bird", "waterfowl", "gull", "raptor"]
TYPED = {"nocturnal_flight_call": "3d", "visible_migration": "7d", "capture": "7d"}
DAY = 24 * HOUR


def with_count_instants(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """Counts with their site's coordinates, zone and `count_timestamp_utc`.

    Unknown sites keep the row; an unreadable date, clock or zone leaves the
    instant null, so the row can never count as recent.
    """
    place = sites.select("site_id", "latitude", "longitude", "timezone")
    joined = counts.drop("latitude", "longitude", "timezone").join(place, "site_id", "left")
    return joined.withColumn(
        "count_timestamp_utc", local_to_utc(F.col("count_date"), F.col("start_time_local"), F.col("timezone"))
    )


def session_measures(counts: DataFrame, tie_break: str = "count_id") -> DataFrame:
    """One row per (site_id, ts): everything later sums need, pre-aggregated before any join.

    A session is (site, date, start time); its hours are counted once, from its
    lowest `tie_break` row.
    """
    c, kind = F.col("count").cast("double"), F.col("count_type")
    group = species_group(F.col("species_scientific_name"))
    weight = F.greatest(c, F.lit(0.0))
    heading = F.col("flight_direction")

    def signed(plus: str, minus: str) -> Column:
        return F.sum(F.when(heading == plus, weight).when(heading == minus, -weight))

    axes = [(fv.COMPASS[i], fv.COMPASS[i + 4]) for i in range(4)]  # N-S, NE-SW, E-W, SE-NW
    facing = heading.isin(fv.COMPASS)
    per_session = counts.where(F.col("count_timestamp_utc").isNotNull()).groupBy(
        "site_id", micros(F.col("count_timestamp_utc")).alias("ts"), "count_date", "start_time_local"
    ).agg(
        F.count("*").alias("rows"),
        F.sum(c).alias("birds"),
        *[F.sum(F.when(group == g, c)).alias(f"birds_{g}") for g in GROUPS],
        *[F.sum(F.when(kind == t, c)).alias(f"birds_{t}") for t in TYPED],
        *[F.count_if(kind == t).alias(f"rows_{t}") for t in TYPED],
        F.sum(F.when(facing, weight)).alias("heading_weight"),
        *[signed(a, b).alias(f"axis_{i}") for i, (a, b) in enumerate(axes)],
        F.count_if(F.coalesce(F.col("observer_effort_available"), F.lit(False))).alias("effort_rows"),
        # whole millionths of an hour: sums and differences of them are exact
        F.round(F.min_by(number(F.col("observation_hours")), F.col(tie_break)) * 1e6).alias("hours"),
    )
    sums = [n for n in per_session.columns if n not in ("site_id", "ts", "count_date", "start_time_local")]
    return per_session.groupBy("site_id", "ts").agg(*[F.sum(n).alias(n) for n in sums])


def _query_frame(queries: DataFrame, id_col: str, at_col: str) -> DataFrame:
    return queries.select(
        id_col, F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"),
        micros(F.col(at_col)).alias("at"),
    )


def lookback_totals(
    queries: DataFrame, sites: DataFrame, counts: DataFrame, *, id_col: str, at_col: str = "query_timestamp_utc",
    radius_km: float = fv.COVERAGE_RADIUS_KM, windows_hours: dict[str, int] | None = None,
) -> DataFrame:
    """Birds in each look-back window around each query; null where no session happened."""
    windows_hours = windows_hours or fv.WINDOWS_HOURS
    asked = _query_frame(queries, id_col, at_col)
    instants = asked.select("lon", "lat", "at").distinct()
    pairs = within_radius(instants.select("lon", "lat").distinct(), sites.select("site_id", "longitude", "latitude"), radius_km)
    labels = list(windows_hours)
    sums = sums_around(
        instants, durable(pairs.select("lon", "lat", "site_id", "distance_km")), durable(session_measures(counts).select("site_id", "ts", "rows", "birds")),
        radius_km, values={"rows": labels, "birds": labels}, windows={k: h * HOUR for k, h in windows_hours.items()},
    )
    found = asked.join(sums, ["lon", "lat", "at"], "left")
    return found.select(
        id_col, *[F.when(F.col(f"rows_{k}") > 0, F.col(f"birds_{k}")).alias(f"total_birds_previous_{k}") for k in labels]
    )


def sums_around(
    instants: DataFrame, pairs: DataFrame, measures: DataFrame, radius_km: float, *, values: dict[str, list[str]], windows: dict[str, int],
) -> DataFrame:
    """Sums of measures over [at - window, at) per (lon, lat, at), over all sites of `pairs`; no rows where nothing can be near."""
    span = max(windows.values())
    found = around(
        instants, pairs, measures.select("site_id", "ts", *values), window_sums(values, windows),
        key="site_id", ts="ts", radius_km=radius_km, back=span, step=span)
    return found.groupBy("lon", "lat", "at").agg(*[F.sum(c).alias(c) for c in found.columns if c not in ("lon", "lat", "at")])


def species_richness(instants: DataFrame, pairs: DataFrame, counts: DataFrame, radius_km: float, hours: int = 168) -> DataFrame:
    """Distinct species over the look-back window per (lon, lat, at).

    A species of a site and day (or window, if that is shorter) is met by its first and last instant only:
    between these it never leaves a window.
    """
    span = hours * HOUR
    key = F.coalesce("species_scientific_name", "species_common_name")
    ts = micros(F.col("count_timestamp_utc"))
    daily = counts.where(F.col("count_timestamp_utc").isNotNull() & key.isNotNull()).groupBy(
        "site_id", F.floor(ts / F.lit(min(DAY, span))).alias("_day"), key.alias("species")
    ).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    edges = daily.select("site_id", "species", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("ts"))
    found = around(
        instants, pairs, durable(edges), window_distinct("species", span, "richness"),
        key="site_id", ts="ts", radius_km=radius_km, back=span, step=2 * span, deal="species")
    return found.groupBy("lon", "lat", "at").agg(F.sum("richness").alias("richness"))


def activity_features(
    queries: DataFrame, sites: DataFrame, counts: DataFrame, *, id_col: str, at_col: str = "query_timestamp_utc",
    radii=fv.RADII_KM, coverage_radius_km: float = fv.COVERAGE_RADIUS_KM, half_life_km: float = fv.HALF_LIFE_KM,
    low_coverage_sites: int = fv.LOW_COVERAGE_SITES,
) -> DataFrame:
    """All activity features per query row (G12); `counts` carry `count_timestamp_utc`.

    Only sessions strictly before the query instant are used.  Queries are
    reduced to distinct places and instants, the work is done once for each,
    and the result is joined back.
    """
    asked = _query_frame(queries, id_col, at_col)
    instants = asked.select("lon", "lat", "at").distinct()
    places = instants.select("lon", "lat").distinct()
    stations = sites.select("site_id", "longitude", "latitude")
    # read twice or more below, so their lineage is cut once
    pairs = durable(within_radius(places, stations, float(max([*radii, coverage_radius_km]))))
    covered = F.col("distance_km") <= coverage_radius_km
    density = pairs.groupBy("lon", "lat").agg(
        *[F.count_if(F.col("distance_km") <= r).alias(f"number_of_sites_within_{r}_km") for r in radii],
        F.count_if(covered).alias("_covered"),
    )
    closest = durable(nearest(places, stations)).withColumnRenamed("distance_km", "distance_to_nearest_site_km")

    reach = pairs.where(covered).select("lon", "lat", "site_id", "distance_km")
    measures = durable(session_measures(counts))
    week = ["effort_rows", "hours", "heading_weight", *[f"axis_{i}" for i in range(4)], *[f"birds_{g}" for g in GROUPS]]
    values = {"rows": list(fv.WINDOWS_HOURS), "birds": list(fv.WINDOWS_HOURS)}
    values |= {v: ["7d"] for v in week}
    for kind, label in TYPED.items():
        values |= {f"birds_{kind}": [label], f"rows_{kind}": [label]}
    sums = sums_around(
        instants, reach, measures, coverage_radius_km, values=values, windows={k: h * HOUR for k, h in fv.WINDOWS_HOURS.items()})
    richness = species_richness(instants, reach, counts, coverage_radius_km)
    ages = latest_before(
        instants.join(closest.select("lon", "lat", F.col("nearest_site_id").alias("site_id")), ["lon", "lat"]),
        measures.select("site_id", "ts"), key="site_id", at="at", ts="ts",
    ).select("lon", "lat", "at", ((F.col("at") - F.col("latest")) / F.lit(HOUR)).alias("nearest_site_observation_age_hours"))

    by_instant = ["lon", "lat", "at"]
    per_instant = (
        instants.join(closest, ["lon", "lat"], "left").join(density, ["lon", "lat"], "left")
        .join(sums, by_instant, "left").join(richness, by_instant, "left").join(ages, by_instant, "left")
    )
    per_instant = per_instant.select(
        *by_instant, *_feature_columns(radii, coverage_radius_km, half_life_km, low_coverage_sites)
    )
    features = [c for c in per_instant.columns if c not in by_instant]
    return asked.join(per_instant, by_instant, "left").select(id_col, *features)


def _feature_columns(radii, coverage_radius_km, half_life_km, low_coverage_sites) -> list[Column]:
    distance, age = F.col("distance_to_nearest_site_km"), F.col("nearest_site_observation_age_hours")
    available = F.col("nearest_site_id").isNotNull()
    near = F.coalesce("_covered", F.lit(0))
    had = {k: F.coalesce(F.col(f"rows_{k}") > 0, F.lit(False)) for k in fv.WINDOWS_HOURS}
    week, three = had["7d"], had["3d"]
    diagonal = math.sqrt(0.5)
    axis = [F.col(f"axis_{i}_7d") for i in range(4)]
    north = axis[0] + (axis[1] - axis[3]) * diagonal
    east = axis[2] + (axis[1] + axis[3]) * diagonal
    weight = F.col("heading_weight_7d")
    typed = {
        kind: F.when(had[label] & (F.col(f"rows_{kind}_{label}") > 0), F.col(f"birds_{kind}_{label}"))
        for kind, label in TYPED.items()
    }
    score = (
        F.when(available, geo.decay(distance, half_life_km)).otherwise(0.0)
        + F.least(F.lit(1.0), near / 5.0)
        + F.coalesce(geo.decay(age, 24.0), F.lit(0.0))
    ) / 3
    counted = [f"number_of_sites_within_{r}_km" for r in radii]
    return [
        available.alias("monitoring_available"), F.col("nearest_site_id"), distance,
        *[F.when(available, F.coalesce(n, F.lit(0))).alias(n) for n in counted],
        age,
        *[F.when(had[k], F.col(f"birds_{k}")).alias(f"total_birds_previous_{k}") for k in fv.WINDOWS_HOURS],
        F.when(week & (F.col("hours_7d") > 0), F.col("birds_7d") / (F.col("hours_7d") / 1e6))
        .alias("birds_per_observation_hour_previous_7d"),
        F.when(week, F.coalesce("richness", F.lit(0))).alias("species_richness_previous_7d"),
        *[F.when(week, F.col(f"birds_{g}_7d")).alias(f"{g}_count_previous_7d") for g in GROUPS],
        typed["nocturnal_flight_call"].alias("nocturnal_flight_call_count_previous_3d"),
        typed["visible_migration"].alias("migration_count_previous_7d"),
        typed["capture"].alias("capture_count_previous_7d"),
        F.when(week & (weight > 0), F.hypot(north, east) / weight).alias("directional_consistency"),
        (week & F.coalesce(F.col("effort_rows_7d") > 0, F.lit(False))).alias("observation_effort_available"),
        F.coalesce(distance > coverage_radius_km, F.lit(True)).alias("distance_warning"),
        (near < low_coverage_sites).alias("low_coverage_warning"),
        F.when(available, F.round(score, 4)).otherwise(0.0).alias("data_coverage_score"),
    ]


def with_activity_index(features: DataFrame) -> DataFrame:
    """Adds activity_index, activity_index_basis and coverage_caveat.

    No coverage or no recent session gives a null index, never 0.
    """
    rate = F.col("birds_per_observation_hour_previous_7d")
    no_sites = ~F.coalesce("monitoring_available", F.lit(False))
    no_recent = F.col("total_birds_previous_7d").isNull() | rate.isNull()
    raw = F.tanh(F.log1p(F.greatest(rate, F.lit(0.0))) / 4)
    index = F.round(raw * (F.coalesce("data_coverage_score", F.lit(0.0)) * 0.5 + 0.5), 4)
    return features.withColumns({
        "activity_index": F.when(~no_sites & ~no_recent, index),
        "activity_index_basis": F.when(no_sites, fv.BASIS_NO_COVERAGE).when(no_recent, fv.BASIS_NO_RECENT).otherwise(fv.BASIS_RATE),
        "coverage_caveat": F.when(no_sites, fv.CAVEAT_NO_COVERAGE).when(no_recent, fv.CAVEAT_NO_RECENT)
        .when(F.col("distance_warning"), fv.CAVEAT_DISTANCE).when(F.col("low_coverage_warning"), fv.CAVEAT_LOW),
    })


def effort_rate_and_richness(counts: DataFrame, by: str = "site_id", tie_break: str = "count_id") -> DataFrame:
    """Birds per observation hour (hours once per session) and species richness per site."""
    sessions = counts.groupBy(by, "count_date", "start_time_local").agg(
        F.sum("count").alias("birds"), F.min_by(number(F.col("observation_hours")), F.col(tie_break)).alias("hours")
    )
    rates = sessions.groupBy(by).agg(F.sum("birds").alias("birds"), F.sum("hours").alias("hours"))
    species = counts.groupBy(by).agg(
        F.count_distinct(F.coalesce("species_scientific_name", "species_common_name")).alias("species_richness")
    )
    return rates.join(species, by).select(
        by, "birds", "hours", F.when(F.col("hours") > 0, F.col("birds") / F.col("hours")).alias("birds_per_hour"),
        "species_richness",
    )


def directional_consistency(counts: DataFrame, by: str = "site_id") -> DataFrame:
    """Count-weighted mean resultant length of flight directions, 0 to 1; null without usable weight."""
    weight = F.greatest(F.col("count").cast("double"), F.lit(0.0))
    # degrees clockwise from north, 45 apart
    turn = F.array_position(F.array(*[F.lit(d) for d in fv.COMPASS]), F.col("flight_direction")) - 1
    angle = F.radians(turn * 45.0)
    usable = F.col("flight_direction").isin(fv.COMPASS)
    sums = counts.groupBy(by).agg(
        F.sum(F.when(usable, weight)).alias("w"),
        F.sum(F.when(usable, weight * F.cos(angle))).alias("x"),
        F.sum(F.when(usable, weight * F.sin(angle))).alias("y"),
    )
    return sums.select(by, F.when(F.col("w") > 0, F.hypot(F.col("x") / F.col("w"), F.col("y") / F.col("w"))).alias("directional_consistency"))
