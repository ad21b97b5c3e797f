"""Wide-to-long reshaping with effort, crosstabs and version merging."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz import fixed_values as fv
from strikehaz.functions.coerce import number


def is_wide(columns) -> bool:
    """Long exports carry species_common_name and count; otherwise any non-metadata column means wide."""
    names = set(columns)
    return not {"species_common_name", "count"} <= names and bool(names - set(fv.WIDE_METADATA))


def wide_counts_to_long(wide: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """One row per session and species seen; blank and 0 mean 'not seen' and go.

    Scientific name and code stay null.  Missing count ids become 'WIDE%06d' in
    (species column, input order); `order_by` names the columns giving the
    input order (default: all metadata columns).
    """
    meta = [c for c in wide.columns if c in fv.WIDE_METADATA]
    species = [c for c in wide.columns if c not in fv.WIDE_METADATA]
    values = wide.select(*meta, *[F.coalesce(number(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in species])
    long = values.unpivot(meta, species, "species_common_name", "count").where("count > 0")
    long = long.withColumns({
        "species_scientific_name": F.lit(None).cast("string"), "species_code": F.lit(None).cast("string")
    })
    if "count_id" in meta:
        return long
    # Numbered inside small groups (species column, first and second ordering value); the groups before
    # each one are summed level by level, so neither a busy site nor a busy species is numbered in one task.
    position = F.create_map(*chain.from_iterable((F.lit(c), F.lit(i)) for i, c in enumerate(species)))
    order = order_by or meta
    levels = ["_pos", *order[:2]]
    long = long.withColumn("_pos", position[F.col("species_common_name")])
    sizes = long.groupBy(*levels).agg(F.count("*").alias("_n"))
    keys = [f"_k{i}" for i in range(len(levels))]
    shifts = sizes.select(*[F.col(c).alias(k) for c, k in zip(levels, keys)], "_n")
    for depth in range(len(keys)):
        part, last = keys[:depth], keys[depth]
        groups = shifts.groupBy(*[F.col(k).alias(f"_j{k}") for k in (*part, last)]).agg(F.sum("_n").alias("_t"))
        before = Window.partitionBy(*[f"_j{k}" for k in part]).orderBy(f"_j{last}").rowsBetween(Window.unboundedPreceding, -1)
        totals = groups.withColumn(f"_shift{depth}", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
        same = [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in (*part, last)]
        shifts = shifts.join(totals, same).drop(*[f"_j{k}" for k in (*part, last)])
    shift = sum((F.col(f"_shift{d}") for d in range(len(keys))), F.lit(0))
    shifts = shifts.select(*keys, shift.alias("_shift"))
    inside = Window.partitionBy(*levels).orderBy(*(order[2:] or order[:1]))
    numbered = long.withColumn("_row", F.row_number().over(inside) - 1)
    return (
        numbered.join(shifts, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(levels, keys)])
        .withColumn("count_id", F.format_string("WIDE%06d", F.col("_row") + F.col("_shift")))
        .drop("_pos", "_row", "_shift", *keys)
    )


def with_rates(wide: DataFrame, effort: DataFrame, key_cols: list[str], periods: list[str], period: str) -> DataFrame:
    """Long (key, period, count, observation_hours, monitored, count_per_hour).

    `effort` is (period, observation_hours) with one row per period column; the join strategy
    is left to measured sizes.  No effort means no rate, not a zero rate.
    """
    long = wide.select(*key_cols, *periods).unpivot(key_cols, periods, period, "count")
    joined = long.join(effort, period, "left")
    monitored = F.coalesce(F.col("observation_hours") > 0, F.lit(False))
    return joined.select(
        *key_cols, period, F.col("count").cast("double").alias("count"), "observation_hours",
        monitored.alias("monitored"),
        F.when(monitored, F.col("count") / F.col("observation_hours")).alias("count_per_hour"),
    )


def metric_code(label):
    """Block label -> metric code, null for any other row."""
    codes = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fv.CROSSTAB_METRICS.items()))
    return F.try_element_at(codes, label)


def crosstab_to_long(sheet: DataFrame, years: list[str], index: DataFrame) -> DataFrame:
    """Sheet rows (Metric, Species, years..., period_label, source_file) -> species/year/period/metric facts.

    Total rows, rows without a species and empty cells are skipped; sheets not
    in the index are dropped rather than given a code.
    """
    rows = sheet.withColumn("metric", metric_code(F.col("Metric"))).where(F.col("metric").isNotNull() & F.col("Species").isNotNull())
    long = rows.select(
        F.col("Species").alias("species"), "metric", "period_label", "source_file",
        *[number(F.col(f"`{y}`")).alias(y) for y in years],
    ).unpivot(["species", "metric", "period_label", "source_file"], years, "year", "count").where(F.col("count").isNotNull())
    return long.join(index.select("period_label", "period_code"), "period_label").select(
        "species", F.col("year").cast("int").alias("year"), "period_code", "period_label", "metric", "count", "source_file"
    )


def crosstab_mismatches(long: DataFrame, index: DataFrame) -> DataFrame:
    """Per period and metric: summed facts beside the index total; `matches` tells them apart."""
    sums = long.groupBy("period_code", "metric").agg(F.sum("count").alias("counted"))
    listed = index.unpivot(
        ["period_code"], ["total_combined", "total_newly_ringed", "total_retraps"], "_total", "listed"
    ).select("period_code", F.regexp_replace("_total", "^total_", "").alias("metric"), "listed")
    return listed.join(sums, ["period_code", "metric"], "left").select(
        "period_code", "metric", "listed", F.coalesce("counted", F.lit(0.0)).alias("counted"),
        (F.col("listed") == F.coalesce("counted", F.lit(0.0))).alias("matches"),
    )


def newest_version(facts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in `order` (newest file) wins."""
    rest = [c for c in facts.columns if c not in keys]
    best = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, "_row.*").select(*facts.columns)


def version_conflicts(facts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys reported with more than one distinct value."""
    return facts.groupBy(*keys).agg(F.count_distinct(value).alias("n_distinct_values")).where("n_distinct_values > 1")


def distinct_hours(facts: DataFrame, period: str = "year", hours: str = "observation_hours") -> DataFrame:
    """Total effort with each (period, hours) counted once."""
    return facts.where(F.col(hours) > 0).select(period, hours).distinct().agg(
        F.sum(hours).alias("pooled_hours"), F.count_distinct(period).alias("monitored_periods")
    )
