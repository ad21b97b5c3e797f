"""Calendar, clock, time-zone and sun-phase expressions."""

from __future__ import annotations

import math
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from strikehaz.fixed_values import MIGRATION_MONTHS
from strikehaz.functions.coerce import clock_minutes, day, moment

#: Region ids the JVM also knows; pseudo entries of the tz database are left out.
ZONES = sorted(zoneinfo.available_timezones() - {"Factory", "localtime", "posixrules"})


def hours_from_clock(c: Column) -> Column:
    """'55:30' or '1,018:12' -> hours as DOUBLE; hours may exceed 24."""
    text = F.regexp_replace(F.trim(c.cast("string")), ",", "")
    pattern = r"^(\d+):(\d{2})$"
    return F.when(
        text.rlike(pattern),
        F.regexp_extract(text, pattern, 1).try_cast("double")
        + F.regexp_extract(text, pattern, 2).try_cast("double") / 60,
    )


def date_plus_clock(date: Column, clock: Column) -> Column:
    """Date and 'HH:MM' -> TIMESTAMP_NTZ; a missing or bad clock means midnight."""
    minutes = F.coalesce(clock_minutes(clock), F.lit(0))
    return moment(date) + F.make_dt_interval(mins=minutes)


def local_to_utc(date: Column, clock: Column, zone: Column) -> Column:
    """Local date + 'HH:MM' in the row's zone -> instant.

    A missing clock is 00:00 and a missing zone is UTC; an unreadable date or
    clock and an unknown zone give null, since a guess would look recent.
    """
    minutes = F.when(clock.isNull(), F.lit(0)).otherwise(clock_minutes(clock))
    midnight = day(date).cast("timestamp_ntz")
    local = F.when(minutes < 24 * 60, midnight + F.make_dt_interval(mins=minutes))
    zone = F.coalesce(zone, F.lit("UTC"))
    known = zone.isin(ZONES)
    return F.when(known, F.to_utc_timestamp(local.cast("timestamp"), F.when(known, zone).otherwise("UTC")))


def micros(ts: Column) -> Column:
    """Instant (TIMESTAMP or TIMESTAMP_NTZ read as UTC) -> microseconds since the epoch."""
    return F.unix_micros(ts.cast("timestamp"))


def season(month: Column) -> Column:
    return (
        F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer").when(month.isNotNull(), "fall")
    )


def migration_flag(month: Column, months=None) -> Column:
    """True inside the migration months; a missing month is false (X11)."""
    return F.coalesce(month.isin(list(months or MIGRATION_MONTHS)), F.lit(False))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi) / period
    return F.sin(angle), F.cos(angle)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Year/month/day-of-year/hour with their sine-cosine pairs and season."""
    out = {"year": F.year(ts), "month": F.month(ts), "day_of_year": F.dayofyear(ts), "hour_local": F.hour(ts)}
    for name, part, period in (("month", "month", 12), ("day_of_year", "day_of_year", 365.25), ("hour", "hour_local", 24)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclic(out[part].cast("double"), period)
    out["season"] = season(out["month"])
    return out


def sun_phase(utc: Column, lat: Column, lon: Column) -> dict[str, Column]:
    """is_dawn / is_dusk / is_night from the NOAA solar formulas.

    Each event is placed on the solar day of the longitude, so an evening past
    00:00 UTC in the Americas belongs to the right day.  Unknown inputs and
    latitudes where the sun does not cross the horizon that day give null.
    """
    utc = utc.cast("timestamp")
    usable = lat.between(-90, 90) & lon.between(-180, 180)
    # solar clock: minutes since local mean solar midnight
    minute_utc = F.hour(utc) * 60.0 + F.minute(utc) + F.second(utc) / 60.0
    solar = F.pmod(minute_utc + lon * 4.0, F.lit(1440.0))
    solar_day = F.dayofyear(F.timestamp_add("SECOND", (lon * 240).cast("bigint"), utc))
    g = F.lit(2 * math.pi / 365) * (solar_day - 1)
    eqtime = F.lit(229.18) * (
        F.lit(0.000075) + F.cos(g) * 0.001868 - F.sin(g) * 0.032077 - F.cos(g * 2) * 0.014615 - F.sin(g * 2) * 0.040849
    )
    decl = (
        F.lit(0.006918) - F.cos(g) * 0.399912 + F.sin(g) * 0.070257 - F.cos(g * 2) * 0.006758
        + F.sin(g * 2) * 0.000907 - F.cos(g * 3) * 0.002697 + F.sin(g * 3) * 0.00148
    )
    phi = F.radians(lat)

    def half_day(zenith: float) -> Column:
        cos_h = F.lit(math.cos(math.radians(zenith))) / (F.cos(phi) * F.cos(decl)) - F.tan(phi) * F.tan(decl)
        return F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(cos_h)) * 4)

    noon = F.lit(720.0) - eqtime  # on the same solar clock
    rise_set, civil = half_day(90.833), half_day(96.0)
    dawn, sunrise, sunset, dusk = noon - civil, noon - rise_set, noon + rise_set, noon + civil
    known = usable & rise_set.isNotNull() & civil.isNotNull()
    return {
        "is_dawn": F.when(known, (solar >= dawn) & (solar < sunrise)),
        "is_dusk": F.when(known, (solar >= sunset) & (solar < dusk)),
        "is_night": F.when(known, (solar < dawn) | (solar >= dusk)),
    }


def time_features(ts: Column, lat: Column | None = None, lon: Column | None = None, utc: Column | None = None):
    """All time features of one local timestamp.

    Sun phase needs the instant in UTC; without it (zone unknown) it stays null.
    """
    out = calendar_columns(ts)
    out["is_migration_season"] = migration_flag(out["month"])
    if utc is not None and lat is not None and lon is not None:
        out |= sun_phase(utc, lat, lon)
    else:
        out |= {name: F.lit(None).cast("boolean") for name in ("is_dawn", "is_dusk", "is_night")}
    return out
