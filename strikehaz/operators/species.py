"""Species risk, pooled local activity and the provenance-carrying incident join."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.functions import geo
from strikehaz.functions.names import join_key, plain_names


def species_risk(strikes: DataFrame, species_col: str = "species", severity_col: str = "predicted_severity", fold_case: bool = False) -> DataFrame:
    """Per species: strikes, mean severity and mean * log1p(n).

    Keyed on the exact spelling; `fold_case` merges spellings first, which is
    what a case-insensitive join wants.
    """
    key = F.upper(species_col) if fold_case else F.col(species_col)
    return strikes.where(F.col(species_col).isNotNull()).groupBy(key.alias("species")).agg(
        F.count(severity_col).alias("n_strikes"), F.avg(severity_col).alias("mean_predicted_severity")
    ).withColumn("risk_score", F.col("mean_predicted_severity") * F.log1p("n_strikes"))


def pooled_activity(long: DataFrame, by: str = "species") -> DataFrame:
    """Count, hours and rate over the monitored periods only, per species."""
    return long.where(F.col("observation_hours") > 0).groupBy(by).agg(
        F.sum("count").alias("total_count"), F.sum("observation_hours").alias("total_hours"),
        F.count("*").alias("n_source_rows"),
    ).withColumn("local_activity", F.col("total_count") / F.col("total_hours"))


def local_risk(local: DataFrame, risk: DataFrame) -> DataFrame:
    """Local activity with national risk, joined on upper-cased species.

    Every local species stays, in its own spelling; `matched_species` says
    whether a risk was found.
    """
    national = risk.select(
        F.upper("species").alias("_key"), "n_strikes", "mean_predicted_severity", "risk_score"
    )
    joined = local.withColumn("_key", F.upper("species")).join(national, "_key", "left").drop("_key")
    return joined.withColumns({
        "matched_species": F.col("risk_score").isNotNull(),
        "local_risk_contribution": F.col("risk_score") * F.col("local_activity"),
    })


def top(df: DataFrame, by: str, k: int, tie_break: list[str], ascending: bool = False) -> DataFrame:
    """First k rows by a column, nulls last, ties by `tie_break`."""
    first = F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)
    return df.orderBy(first, *tie_break).limit(k)


def expand_species(long: DataFrame, column: str = "species") -> DataFrame:
    """One row per plain name; counts are repeated, not split."""
    others = [c for c in long.columns if c != column]
    return long.withColumn("_name", F.explode(plain_names(F.col(column)))).select(
        F.col("_name").alias(column), *others
    )


def month_column(month: Column) -> Column:
    names = F.create_map(*chain.from_iterable((F.lit(i + 1), F.lit(m)) for i, m in enumerate(fv.MONTHS)))
    return F.try_element_at(names, month.cast("int"))


def activity_lookup(long: DataFrame, order_col: str) -> DataFrame:
    """One rate per (species, month); the row last in `order_col` wins, conflicts are counted."""
    return long.groupBy(join_key(F.col("species")).alias("_species"), F.col("month").alias("_month")).agg(
        F.max_by("count_per_hour", order_col).alias("count_per_hour"), F.count("*").alias("n_candidates")
    )


def incidents_with_activity(
    incidents: DataFrame, lookup: DataFrame, *, station_lon: float, station_lat: float, season_year: int,
    source_dataset: str, id_col: str = "INDEX_NR", lat_col: str = "LATITUDE", lon_col: str = "LONGITUDE",
    year_col: str = "INCIDENT_YEAR", month_col: str = "INCIDENT_MONTH", species_col: str = "SPECIES",
) -> DataFrame:
    """Incidents with one station's monthly activity and full provenance on every row.

    Incidents without coordinates are left out (the report counts them).  A
    missing year counts as the season's; a missing month or species matches
    nothing.  `value_type` is 'observed' only when the species is listed and the
    month was monitored.
    """
    lon, lat = F.col(lon_col).cast("double"), F.col(lat_col).cast("double")
    rows = incidents.where(lon.isNotNull() & lat.isNotNull()).select(
        F.col(id_col).alias("record_id"), lon.alias("_lon"), lat.alias("_lat"),
        F.col(year_col).cast("int").alias("_year"),
        F.when(F.trim(species_col) != "", join_key(F.col(species_col))).alias("_species"),
        month_column(F.col(month_col)).alias("_month"),
    )
    found = rows.join(lookup, ["_species", "_month"], "left")
    matched = F.col("n_candidates").isNotNull()
    monitored = F.col("count_per_hour").isNotNull()
    distance = geo.geodesic_km("_lon", "_lat", f"({float(station_lon)}D)", f"({float(station_lat)}D)")
    return found.select(
        "record_id",
        F.lit(source_dataset).alias("source_dataset"),
        F.lit("single_station_point").alias("spatial_resolution"),
        F.lit("monthly").alias("temporal_resolution"),
        F.lit("nearest_available_station_same_species_same_calendar_month").alias("join_method"),
        F.round(distance, 1).alias("distance_km"),
        F.abs(F.coalesce("_year", F.lit(season_year)) - season_year).alias("time_diff_years"),
        matched.alias("species_matched"),
        monitored.alias("month_monitored"),
        F.when(matched & monitored, "observed").otherwise("unavailable").alias("value_type"),
        F.col("count_per_hour").alias("local_activity_count_per_hour"),
    )


def join_quality(joined: DataFrame, incidents: DataFrame, distances=fv.DISTANCE_LADDER_KM, years=fv.YEAR_LADDER) -> DataFrame:
    """(section, key, n, pct) rows: drops, matches and the two tolerance ladders.

    Percentages are of all incidents, so rows dropped for coordinates stay in
    the denominator.  One pass over each input.
    """
    observed = F.col("value_type") == "observed"
    counts = joined.agg(
        F.count("*").alias("joined"), F.count_if("species_matched").alias("matched"), F.count_if(observed).alias("observed"),
        *[F.count_if(observed & (F.col("distance_km") <= d)).alias(f"d{d}") for d in distances],
        *[F.count_if(observed & (F.col("time_diff_years") <= y)).alias(f"y{y}") for y in years],
    )
    total = incidents.agg(F.count("*").alias("total")).scalar()
    row = counts.withColumn("total", total)
    entries = [
        ("overall", "n_incidents_total", F.col("total")),
        ("overall", "n_dropped_missing_coordinates", F.col("total") - F.col("joined")),
        ("overall", "n_species_matched_any_month", F.col("matched")),
        ("overall", "n_fully_observed_species_and_month", F.col("observed")),
        *[("spatial", f"within_{d}km", F.col(f"d{d}")) for d in distances],
        *[("temporal", f"within_{y}yr", F.col(f"y{y}")) for y in years],
    ]
    lines = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), n.alias("n")) for s, k, n in entries])
    return row.select("total", F.inline(lines)).select(
        "section", "key", "n", F.round(F.col("n") * 100 / F.col("total"), 2).alias("pct_of_all_incidents")
    )
