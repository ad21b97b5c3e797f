"""Scenarios, risk bands and score classes, for whole tables of scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.functions.coerce import number

TEXT_FIELDS = [f for f in fv.SCENARIO_RAW if f not in fv.SCENARIO_NUMERIC]


def preset_scenarios(spark: SparkSession) -> DataFrame:
    """The six named scenarios, one row each."""
    types = ", ".join(f"{f} {'double' if f in fv.SCENARIO_NUMERIC else 'string'}" for f in fv.SCENARIO_RAW)
    rows = [
        (name, *[float(v) if f in fv.SCENARIO_NUMERIC else v for f, v in zip(fv.SCENARIO_RAW, values)])
        for name, values in fv.PRESETS.items()
    ]
    return spark.createDataFrame(rows, f"scenario_id string, {types}")


def scenario_to_raw(scenarios: DataFrame) -> DataFrame:
    """Engineered names to raw strike columns; a secondary engine of 'NONE' is no engine."""
    return scenarios.withColumn(
        "engine_position_secondary", F.nullif(F.col("engine_position_secondary"), F.lit("NONE"))
    ).withColumnsRenamed(fv.SCENARIO_RAW)


def check_fields(columns, id_col: str = "scenario_id") -> None:
    """Scenario tables must have exactly the scenario fields (part of P18)."""
    have = set(columns) - {id_col}
    missing, unknown = sorted(set(fv.SCENARIO_RAW) - have), sorted(have - set(fv.SCENARIO_RAW))
    if missing or unknown:
        raise ValueError(f"Scenario fields missing: {missing}; not recognised: {unknown}")


def scenario_violations(
    scenarios: DataFrame, seen: DataFrame, ranges: DataFrame, id_col: str = "scenario_id", checked: list[str] = TEXT_FIELDS,
) -> DataFrame:
    """(id, is_valid, n_violations, violations) per scenario.

    A number must be present, numeric and inside the training range (`ranges`,
    one row per restricted field); a category of a `checked` field must have
    been seen in training, null being allowed.  All fields are checked in one
    pass and one join.
    """
    check_fields(scenarios.columns, id_col)
    limits = ranges.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("m")).scalar()
    with_limits = scenarios.withColumn("_limits", limits)

    def numeric_problem(f: str) -> Column:
        value, limit = number(f), F.try_element_at(F.col("_limits"), F.lit(f))
        return (
            F.when(F.col(f).isNull(), f"{f}: missing").when(value.isNull(), f"{f}: not numeric")
            .when((value < limit["low"]) | (value > limit["high"]), f"{f}: outside training range")
        )

    numeric = with_limits.select(
        id_col, F.explode(F.array(*[numeric_problem(f) for f in fv.SCENARIO_NUMERIC])).alias("problem")
    ).where(F.col("problem").isNotNull())
    cells = F.array(*[F.struct(F.lit(f).alias("column"), F.col(f).cast("string").alias("value")) for f in checked])
    long = scenarios.select(id_col, F.inline(cells)).where(F.col("value").isNotNull())
    # check each distinct value once, however many scenarios repeat it
    unseen = long.select("column", "value").distinct().join(seen, ["column", "value"], "left_anti")
    categorical = long.join(unseen, ["column", "value"], "left_semi").select(
        id_col, F.concat("column", F.lit(": never seen in training")).alias("problem")
    )
    problems = numeric.unionByName(categorical).groupBy(id_col).agg(F.array_sort(F.collect_list("problem")).alias("_p"))
    found = F.col("_p")
    return scenarios.select(id_col).join(problems, id_col, "left").select(
        id_col, found.isNull().alias("is_valid"),
        F.when(found.isNull(), 0).otherwise(F.size(found)).alias("n_violations"),
        F.when(found.isNull(), "").otherwise(F.array_join(found, "; ")).alias("violations"),
    )


def risk_band(probability: Column) -> Column:
    """First band whose bound exceeds the probability."""
    out = F
    for bound, label in fv.RISK_BANDS:
        out = out.when(probability < bound, label)
    return out.when(probability.isNotNull(), fv.RISK_BANDS[-1][1])


def score_class(probability: Column, threshold: float | Column) -> Column:
    """'ELEVATED' at or above the threshold, else 'LOWER' (P20)."""
    return F.when(probability >= threshold, "ELEVATED").when(probability.isNotNull(), "LOWER")
