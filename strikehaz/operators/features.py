"""Feature frames of the damage and severity models; each is guarded before anything is read (M1-M4)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.functions.coerce import number
from strikehaz.functions.times import cyclic, date_plus_clock, season, time_features
from strikehaz.operators.policy import MODES, allowed_feature_columns, assert_mode_inputs, assert_no_leakage

_TEXT = {
    "aircraft_type": "AIRCRAFT", "aircraft_mass_class": "AC_MASS", "engine_type": "TYPE_ENG",
    "engine_position_primary": "ENG_1_POS", "engine_position_secondary": "ENG_2_POS", "state": "STATE",
    "faa_region": "FAAREGION", "sky_condition": "SKY", "precipitation": "PRECIPITATION",
}
_PREFLIGHT_NUMERIC = ["engine_count", "month", "month_sin", "month_cos"]
_PREFLIGHT_CATEGORICAL = [*_TEXT, "season"]


@dataclass(frozen=True)
class FeatureSet:
    """Engineered frame (kept columns first) with its numeric and categorical feature names."""

    mode: str
    frame: DataFrame
    numeric: list[str]
    categorical: list[str]


def _raw(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _preflight(df: DataFrame) -> dict[str, Column]:
    out = {name: _raw(df, raw).cast("string") for name, raw in _TEXT.items()}
    out["engine_position_secondary"] = F.coalesce(out["engine_position_secondary"], F.lit("NONE"))
    month = number(_raw(df, "INCIDENT_MONTH"))
    out["engine_count"], out["month"] = number(_raw(df, "NUM_ENGS")), month
    # a missing month is placed in June on the circle; month and season stay null
    out["month_sin"], out["month_cos"] = cyclic(F.coalesce(month, F.lit(6.0)), 12)
    out["season"] = F.upper(season(month))
    return out


def _encounter(df: DataFrame) -> dict[str, Column]:
    return {
        "phase_of_flight": _raw(df, "PHASE_OF_FLIGHT"), "height_agl_ft": number(_raw(df, "HEIGHT")),
        "speed_ias_knots": number(_raw(df, "SPEED")), "light_condition": _raw(df, "TIME_OF_DAY"),
        "bird_warned": _raw(df, "WARNED"),
    }


def _frame(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[c.alias(n) for n, c in columns.items()])


def operational_core(df: DataFrame, keep: list[str] = ()) -> FeatureSet:
    """Everything known before or during the encounter, 19 features (M1)."""
    assert_mode_inputs(MODES["operational_core"], "operational_core")
    return FeatureSet(
        "operational_core", _frame(df, _preflight(df) | _encounter(df), list(keep)),
        [*_PREFLIGHT_NUMERIC, "height_agl_ft", "speed_ias_knots"],
        [*_PREFLIGHT_CATEGORICAL, "phase_of_flight", "light_condition", "bird_warned"],
    )


def reduced_preflight(df: DataFrame, keep: list[str] = ()) -> FeatureSet:
    """Only what is known before the flight, 14 features (M2)."""
    assert_mode_inputs(MODES["reduced_preflight"], "reduced_preflight")
    return FeatureSet(
        "reduced_preflight", _frame(df, _preflight(df), list(keep)), list(_PREFLIGHT_NUMERIC), list(_PREFLIGHT_CATEGORICAL)
    )


def severity_with_species(df: DataFrame, keep: list[str] = ()) -> FeatureSet:
    """Operational core plus the struck species: a retrospective ranking model, not a forecast (M3)."""
    core = operational_core(df, keep)
    columns = _preflight(df) | _encounter(df) | {"species": _raw(df, "SPECIES")}
    return FeatureSet("severity_with_species", _frame(df, columns, list(keep)), core.numeric, [*core.categorical, "species"])


def canonical_features(df: DataFrame, keep: list[str] = (), utc: Column | None = None) -> DataFrame:
    """Allowed canonical columns with time features (M4).

    Sun phase is only computed when the caller supplies the instant in UTC
    (`utc`); a local clock is never read as UTC.
    """
    allowed = allowed_feature_columns(df.columns)
    out = df.select(*keep, *allowed)
    if "incident_date" in allowed:
        clock = F.col("incident_time_local") if "incident_time_local" in allowed else F.lit(None).cast("string")
        local = date_plus_clock(F.col("incident_date"), clock)
        lat = F.col("latitude") if "latitude" in allowed else None
        lon = F.col("longitude") if "longitude" in allowed else None
        extra = time_features(local, lat, lon, utc)
        out = df.select(*keep, *allowed, *[c.alias(n) for n, c in extra.items()])
    assert_no_leakage([c for c in out.columns if c not in keep])
    return out


#: mode -> builder, for `builder(df)` (F2)
BUILDERS = {
    "operational_core": operational_core, "reduced_preflight": reduced_preflight,
    "severity_with_species": severity_with_species,
}
