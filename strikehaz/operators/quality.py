"""Validation reports: everything is counted, nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType, ByteType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType,
    StructType, TimestampNTZType, TimestampType,
)

from strikehaz.fixed_values import COUNT_TYPES
from strikehaz.functions.coerce import (
    end_not_before_start, nonnegative, number, valid_coordinates, valid_timestamp,
)

_INTEGRAL = (ByteType, ShortType, IntegerType, LongType)
_ACCEPTS = {
    StringType: (StringType,),
    DoubleType: (DoubleType, FloatType, DecimalType, *_INTEGRAL),
    IntegerType: _INTEGRAL,
    LongType: _INTEGRAL,
    BooleanType: (BooleanType,),
    DateType: (DateType, TimestampType, TimestampNTZType, StringType),
    TimestampType: (DateType, TimestampType, TimestampNTZType, StringType),
    TimestampNTZType: (DateType, TimestampType, TimestampNTZType, StringType),
}


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once with their row counts; nulls are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def duplicate_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows involved in duplicates (all copies) and number of duplicated keys."""
    return duplicate_keys(df, keys).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_duplicate_rows"), F.count("*").alias("n_duplicate_keys")
    )


def missingness(df: DataFrame) -> DataFrame:
    """(column, n_missing, pct_missing) over all columns in one pass."""
    row = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return row.unpivot(["_n"], df.columns, "column", "n_missing").select(
        "column", "n_missing", F.when(F.col("_n") > 0, F.round(F.col("n_missing") * 100 / F.col("_n"), 2)).alias("pct_missing")
    )


def value_counts(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """Most frequent values including null, ties in value order."""
    return (
        df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(top_n)
    )


def unresolved_ids(records: DataFrame, known: DataFrame, column: str, known_column: str | None = None) -> DataFrame:
    """Distinct ids referenced but unknown, compared as text."""
    ids = records.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias(column)).distinct()
    have = known.select(F.col(known_column or column).cast("string").alias(column)).distinct()
    return ids.join(have, column, "left_anti")


def sites_with_counts_in_range(sites: DataFrame, links: DataFrame) -> DataFrame:
    """Sites linked to at least one airport."""
    return sites.join(links.select("site_id"), "site_id", "left_semi")


def counts_report(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """(metric, n) rows of the count-export checks; no row is dropped.

    Unresolved sites are counted once per id, everything else per row; a time
    range is only bad when both ends are present.
    """
    place = sites.select(F.col("site_id").cast("string").alias("_site"), "latitude", "longitude").dropDuplicates(["_site"])
    rows = counts.drop("latitude", "longitude").join(place, F.col("site_id").cast("string") == F.col("_site"), "left")
    hours = number(F.col("observation_hours"))
    both = F.col("start_time_local").isNotNull() & F.col("end_time_local").isNotNull()
    unknown_site = F.when(F.col("_site").isNull(), F.col("site_id").cast("string"))
    checks = rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(~valid_coordinates(F.col("latitude"), F.col("longitude"))).alias("n_invalid_coordinates"),
        F.count_if(~nonnegative(F.col("count"))).alias("n_negative_counts"),
        F.count_if(both & ~end_not_before_start(F.col("start_time_local"), F.col("end_time_local"))).alias("n_invalid_time_ranges"),
        F.count_if(hours <= 0).alias("n_nonpositive_effort"),
        F.count_distinct(unknown_site).alias("n_unresolved_site_ids"),
    )
    names = checks.columns
    report = checks.unpivot([], names, "metric", "n")
    repeated = duplicate_summary(counts, ["site_id", "count_date", "start_time_local", "species_scientific_name"])
    return report.unionByName(repeated.select(F.lit("duplicate_sessions").alias("metric"), F.col("n_duplicate_rows").alias("n")))


def count_type_report(counts: DataFrame) -> DataFrame:
    """(count_type, n, recognised); unknown types are kept and flagged."""
    return counts.groupBy("count_type").agg(F.count("*").alias("n")).withColumn(
        "recognised", F.coalesce(F.col("count_type").isin(COUNT_TYPES), F.lit(False))
    )


def dtype_mismatches(df: DataFrame, schema: StructType) -> dict[str, str]:
    """Declared columns whose actual type is not acceptable (part of G19; looks at types only)."""
    out = {}
    for field in schema.fields:
        if field.name in df.columns:
            actual = df.schema[field.name].dataType
            if not isinstance(actual, _ACCEPTS.get(type(field.dataType), (object,))):
                out[field.name] = actual.simpleString()
    return out


def validate(
    df: DataFrame, schema: StructType, *, required: list[str] = (), lat: str | None = None, lon: str | None = None,
    timestamps: list[str] = (), keys: list[str] = (), companions: list[tuple[str, str]] = (),
) -> DataFrame:
    """(check, subject, value) rows describing how `df` meets `schema`.

    A null timestamp is missing, not invalid.  `is_clean` is 1 unless there are
    missing columns, bad coordinates, unreadable timestamps, duplicate keys or
    values without their companion; missingness and types do not count.
    """
    have = set(df.columns)
    absent = [c for c in required if c not in have]
    wrong = dtype_mismatches(df, schema)
    checks: list[tuple[str, str, Column]] = []
    if lat in have and lon in have:
        checks.append(("invalid_coordinates", "rows", F.count_if(~valid_coordinates(F.col(lat), F.col(lon)))))
    for ts in timestamps:
        if ts in have:
            checks.append(("invalid_timestamp", ts, F.count_if(F.col(ts).isNotNull() & ~valid_timestamp(F.col(ts)))))
    for value, companion in companions:
        if {value, companion} <= have:
            checks.append(("companion_violation", value, F.count_if(F.col(value).isNotNull() & F.col(companion).isNull())))
    structural = len(checks)
    for c in schema.names:
        if c in have:
            share = F.round(F.count_if(F.col(c).isNull()) / F.count("*"), 4)
            checks.append(("missing_fraction", c, share))
    row = df.agg(F.count("*").cast("double").alias("_n"), *[e.cast("double").alias(f"_c{i}") for i, (_, _, e) in enumerate(checks)])
    if keys and set(keys) <= have:
        row = row.withColumn("_dup", duplicate_summary(df, list(keys)).select(F.col("n_duplicate_rows").cast("double")).scalar())
    else:
        row = row.withColumn("_dup", F.lit(0.0))
    bad = F.col("_dup") + F.lit(float(len(absent)))
    for i in range(structural):
        bad = bad + F.col(f"_c{i}")
    lines = [("n_rows", "rows", F.col("_n")), ("duplicate_keys", "rows", F.col("_dup"))]
    lines += [("missing_column", c, F.lit(1.0)) for c in absent]
    lines += [("unexpected_dtype", f"{c}:{t}", F.lit(1.0)) for c, t in wrong.items()]
    lines += [(name, subject, F.col(f"_c{i}")) for i, (name, subject, _) in enumerate(checks)]
    lines += [("is_clean", "all", F.when(bad == 0, 1.0).otherwise(0.0))]
    table = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(s).alias("subject"), v.alias("value")) for c, s, v in lines])
    return row.select(F.inline(table))


def airport_days(strikes: DataFrame, airports: DataFrame | None = None) -> DataFrame:
    """One row per airport and calendar day with strike facts, never a probability.

    Input columns: airport_id, incident_date, damage, injuries, species.
    """
    day = F.to_date("incident_date")
    rows = strikes.where(F.col("airport_id").isNotNull() & day.isNotNull()).groupBy("airport_id", day.alias("date")).agg(
        F.count("*").cast("double").alias("strike_count"),
        F.avg("damage").alias("damage_rate_given_strike"),
        F.bool_or(F.col("injuries") > 0).alias("injury_flag"),
        F.array_join(F.array_sort(F.collect_set("species")), ",").alias("species_involved"),
    )
    rows = rows.withColumns({
        "observation_id": F.concat_ws("_", F.col("airport_id").cast("string"), F.date_format("date", "yyyy-MM-dd")),
        "strike_count_basis": F.lit("reported_count"),
        "species_involved": F.nullif("species_involved", F.lit("")),
    })
    if airports is not None:
        rows = rows.join(airports.select("airport_id", "latitude", "longitude"), "airport_id", "left")
    return rows
