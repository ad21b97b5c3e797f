"""Three-valued damage and severity targets, raw-column normalisation and population filters."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.functions.coerce import moment, number, tidy_upper


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Trim and upper-case the text columns, coerce the numeric ones and the date; others untouched (P5)."""
    have = set(raw.columns)
    changes = {c: tidy_upper(c) for c in fv.RAW_TEXT if c in have}
    changes |= {c: number(c) for c in fv.RAW_NUMERIC if c in have}
    if "INCIDENT_DATE" in have:
        changes["INCIDENT_DATE"] = moment(F.col("INCIDENT_DATE"))
    return raw.withColumns(changes)


def populations() -> dict[str, Column]:
    """The four nested populations; null attributes are outside."""
    private = F.col("OPERATOR").isin(fv.OPERATORS_BUSINESS_PRIVATE)
    fixed_wing = private & (F.col("AC_CLASS") == "A")
    light = fixed_wing & F.col("AC_MASS").isin("1", "2")
    masks = {
        "confirmed_business_or_private": private,
        "confirmed_business_or_private_fixed_wing": fixed_wing,
        "light_fixed_wing_ga": light,
        "light_piston_ga": light & (F.col("TYPE_ENG") == "A"),
    }
    return {name: F.coalesce(mask, F.lit(False)) for name, mask in masks.items()}


def principal_population(normalised: DataFrame) -> DataFrame:
    return normalised.where(populations()["confirmed_business_or_private_fixed_wing"])


def population_counts(normalised: DataFrame) -> DataFrame:
    """(population, n) for all four populations from one pass."""
    row = normalised.agg(*[F.count_if(mask).alias(name) for name, mask in populations().items()])
    names = row.columns
    return row.unpivot([], names, "population", "n")


def damage_target(df: DataFrame, positive=fv.DAMAGE_POSITIVE, negative=fv.DAMAGE_NEGATIVE) -> DataFrame:
    """Adds `damage` (1/0/null) and `damage_target_status` from damage_flag alone.

    A value listed on both sides is ambiguous; damage_level is never consulted.
    """
    positive = {str(v).strip().upper() for v in positive}
    negative = {str(v).strip().upper() for v in negative}
    flag = tidy_upper(F.col("damage_flag"))
    yes, no = flag.isin(sorted(positive - negative)), flag.isin(sorted(negative - positive))
    return df.withColumns({
        "damage": F.when(yes, 1).when(no, 0),
        "damage_target_status": F.when(yes, fv.STATUS_POSITIVE).when(no, fv.STATUS_NEGATIVE).otherwise(fv.STATUS_UNKNOWN),
    })


def damage_binary_target(df: DataFrame) -> DataFrame:
    """Adds damage_binary, its status and the indicated-versus-level conflict flag.

    The conflict is reported and never changes the label; a missing level reads
    as blank.
    """
    indicated = F.col("INDICATED_DAMAGE").cast("string")
    level = F.coalesce(F.col("DAMAGE_LEVEL").cast("string"), F.lit("")) if "DAMAGE_LEVEL" in df.columns else F.lit("")
    yes, no = indicated.isin(fv.INDICATED_YES), indicated.isin(fv.INDICATED_NO)
    conflict = (yes & level.isin(fv.LEVEL_UNDAMAGED)) | (no & level.isin(fv.LEVEL_DAMAGED))
    return df.withColumns({
        "damage_binary": F.when(yes, 1).when(no, 0),
        "damage_target_status": F.when(yes, fv.STATUS_POSITIVE).when(no, fv.STATUS_NEGATIVE).otherwise(fv.STATUS_UNKNOWN),
        "damage_level_inconsistent": F.coalesce(conflict, F.lit(False)),
    })


def severity_target(df: DataFrame) -> DataFrame:
    """Adds damage_severity_score: 0 undamaged, 1-3 by level, null unless flag and level agree (P10)."""
    agrees = ~F.col("damage_level_inconsistent")
    scale = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in fv.LEVEL_SEVERITY.items()))
    status = F.col("damage_target_status")
    return df.withColumn(
        "damage_severity_score",
        F.when(agrees & (status == fv.STATUS_NEGATIVE), 0.0)
        .when(agrees & (status == fv.STATUS_POSITIVE), F.try_element_at(scale, F.col("DAMAGE_LEVEL"))),
    )


def target_summary(df: DataFrame) -> DataFrame:
    """Positive, negative, excluded and conflicting rows and the rate over labelled rows."""
    status = F.col("damage_target_status")
    conflict = F.count_if("damage_level_inconsistent") if "damage_level_inconsistent" in df.columns else F.lit(0).cast("bigint")
    counted = df.agg(
        F.count_if(status == fv.STATUS_POSITIVE).alias("n_positive"),
        F.count_if(status == fv.STATUS_NEGATIVE).alias("n_negative"),
        F.count_if(status == fv.STATUS_UNKNOWN).alias("n_excluded_unknown"),
        conflict.alias("n_inconsistent"),
    )
    labelled = F.col("n_positive") + F.col("n_negative")
    return counted.withColumn("positive_rate", F.when(labelled > 0, F.col("n_positive") / labelled))


def eligible_and_excluded(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a label and rows without one; both are kept."""
    return df.where(F.col(target).isNotNull()), df.where(F.col(target).isNull())
