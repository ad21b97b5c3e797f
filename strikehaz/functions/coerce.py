"""Safe coercions and row predicates: a bad value becomes null or false, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_CLOCK = r"^\s*0*(\d{1,6}):([0-5]?\d)\s*$"  # more hours than fit are malformed
_MONTH_FIRST = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?\s*$"


def number(c: Column | str) -> Column:
    """Text or number -> DOUBLE; unparseable text and NaN -> null (S4).  A plain name is a column."""
    if isinstance(c, str):
        t = f"CAST(`{c}` AS STRING)"
        return F.expr(f"CASE WHEN {t} RLIKE r'{_NUMBER}' THEN nanvl(TRY_CAST(trim({t}) AS DOUBLE), NULL) END")
    as_text = c.cast("string")
    value = F.when(as_text.rlike(_NUMBER), F.trim(as_text).try_cast("double"))
    return F.when(~F.isnan(value), value)


def moment(c: Column) -> Column:
    """Text, date or timestamp -> TIMESTAMP_NTZ, null when it does not parse.

    ISO dates and times, and the exported month-first form `6/1/2021` with or without a clock.
    """
    text = c.cast("string")
    parts = [F.regexp_extract(text, _MONTH_FIRST, k) for k in range(1, 5)]
    clock = F.when(parts[3] == "", F.lit("0:00")).otherwise(parts[3])
    iso = F.concat_ws("-", parts[2], F.lpad(parts[0], 2, "0"), F.lpad(parts[1], 2, "0"))
    turned = F.concat(iso, F.lit(" "), F.when(F.instr(clock, ":") == 2, F.concat(F.lit("0"), clock)).otherwise(clock))
    return F.when(text.rlike(_MONTH_FIRST), turned.try_cast("timestamp_ntz")).otherwise(c.try_cast("timestamp_ntz"))


def day(c: Column) -> Column:
    return moment(c).cast("date")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(c.cast("string"), F.lit(" \t\n\r\f\x0b\u00a0"))


def tidy_upper(c: Column | str) -> Column:
    """Trim and upper-case; null stays null (X1).  A plain name is a column."""
    if isinstance(c, str):
        return F.expr(f"upper(trim(BOTH ' \\t\\n\\r\\f\\u000b\\u00a0' FROM CAST(`{c}` AS STRING)))")
    return F.upper(strip(c))


def valid_coordinates(lat: Column, lon: Column) -> Column:
    """Present, numeric and inside [-90, 90] x [-180, 180], bounds included."""
    return F.coalesce(number(lat).between(-90, 90) & number(lon).between(-180, 180), F.lit(False))


def on_globe(lat: Column, lon: Column) -> Column:
    """The same test for columns that are numbers already, without the way through text."""
    return F.coalesce(lat.try_cast("double").between(-90, 90) & lon.try_cast("double").between(-180, 180), F.lit(False))


def valid_timestamp(c: Column) -> Column:
    """Parses as a date or timestamp."""
    return moment(c).isNotNull()


def nonnegative(c: Column) -> Column:
    """Numeric and >= 0; null is false."""
    return F.coalesce(number(c) >= 0, F.lit(False))


def positive(c: Column) -> Column:
    """Numeric and > 0; null is false."""
    return F.coalesce(number(c) > 0, F.lit(False))


def clock_minutes(c: Column) -> Column:
    """'HH:MM' -> minutes since midnight, null when malformed."""
    text = c.cast("string")
    return F.when(
        text.rlike(_CLOCK),
        F.regexp_extract(text, _CLOCK, 1).try_cast("int") * 60 + F.regexp_extract(text, _CLOCK, 2).try_cast("int"),
    )


def end_not_before_start(start: Column, end: Column) -> Column:
    """Same-day 'HH:MM' range; crossing midnight or missing -> false."""
    return F.coalesce(clock_minutes(end) >= clock_minutes(start), F.lit(False))
