"""Monitoring scans: sites, counts, provenance, season and annual totals, crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikehaz.fixed_values import PROVENANCE_FIELDS, SEASON_NON_MONTH
from strikehaz.functions.coerce import day, number
from strikehaz.functions.times import hours_from_clock
from strikehaz.operators.reshape import is_wide, newest_version, wide_counts_to_long, with_rates
from strikehaz.schemas import COUNTS, SITES
from strikehaz.sources.strikes import read_text_csv


def padded(df: DataFrame, schema: StructType) -> DataFrame:
    """Schema columns typed safely, absent ones null, other columns kept."""
    have = set(df.columns)

    def typed(f) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType).alias(f.name)
        kind, c = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind in ("double", "integer"):
            return number(c).try_cast(f.dataType).alias(f.name)
        if kind == "date":
            return day(c).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return df.select(*[typed(f) for f in schema.fields], *[F.col(f"`{c}`") for c in df.columns if c not in schema.names])


def scan_sites(spark: SparkSession, path: str) -> DataFrame:
    """Sites CSV."""
    return padded(read_text_csv(spark, path), SITES)


def long_counts(raw: DataFrame) -> DataFrame:
    """Counts in the canonical long schema from a long or wide table; nothing is dropped beyond 'not seen' (S6)."""
    return padded(wide_counts_to_long(raw) if is_wide(raw.columns) else raw, COUNTS)


def scan_counts(spark: SparkSession, path: str) -> DataFrame:
    return long_counts(read_text_csv(spark, path))


def scan_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Provenance sidecar; refuses one without all required fields."""
    record = spark.read.json(path, multiLine=True)
    missing = [f for f in PROVENANCE_FIELDS if f not in record.columns]
    if missing:
        raise ValueError(f"Provenance file {path} lacks required fields: {missing}")
    return record.select(*PROVENANCE_FIELDS, *[c for c in record.columns if c not in PROVENANCE_FIELDS])


# --- season totals (discriminated rows) ---------------------------------------

def month_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in SEASON_NON_MONTH]


def season_species(table: DataFrame) -> DataFrame:
    """Species rows with numeric counts."""
    numeric = {"rank", "total", "newly_ringed", "retraps", "maximum_count", "presence_percent", "presence_days"}
    numeric |= set(month_columns(table))
    return table.where("row_type = 'species'").withColumns({c: number(F.col(c)) for c in table.columns if c in numeric})


def season_effort(table: DataFrame) -> DataFrame:
    """(month, observation_hours) from the effort row."""
    months = month_columns(table)
    return table.where("row_type = 'observation_hours'").unpivot([], months, "month", "hhmm").select(
        "month", hours_from_clock(F.col("hhmm")).alias("observation_hours")
    )


def season_long(table: DataFrame) -> DataFrame:
    """Species x month with effort-normalised rates (R2)."""
    return with_rates(season_species(table), season_effort(table), ["species"], month_columns(table), "month")


# --- annual totals text ---------------------------------------------------------

YEARS = list(range(2016, 2026))  # fixed column set of the layout
def read_annual_text(spark: SparkSession, path: str, pattern: str = "*annual*.txt") -> DataFrame:
    """Extracted text files as (line, source_file, modified), newest file last when ordered."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    return lines.select(
        F.col("value").alias("line"), F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def _words(line: Column) -> Column:
    """The words of a line; an opening bracket starts a new one."""
    return F.split(F.trim(F.regexp_replace(line, r"\(", " (")), r"\s+")


def _all_whole(words: Column) -> Column:
    return F.forall(words, lambda w: w.rlike(r"^\d+$"))


def _from_right(words: Column, back: int) -> Column:
    """The word `back` places before the end, 1 for the last."""
    return F.get(words, F.size(words) - back)


def annual_species(lines: DataFrame) -> DataFrame:
    """Species rows of the annual text, wide: one column per year plus career figures.

    Number, name, one count for each year, then total, average, newly ringed, retraps, best count
    and its year in brackets.  The figures are read from the right, what is left is number and name.
    """
    w, tail, years = F.col("_w"), 6, len(YEARS)
    carried = [c for c in lines.columns if c != "line"]
    named = F.greatest(F.size(w) - tail - years, F.lit(1))  # words of number and name
    figures = F.array_append(F.slice(w, named + 1, years + 1), _from_right(w, 4))
    whole = _all_whole(F.concat(figures, F.array(_from_right(w, 3), _from_right(w, 2))))
    fits = (named > 1) & F.get(w, F.lit(0)).rlike(r"^\d+$") & _from_right(w, 1).rlike(r"^\(\d{4}\)$") & _from_right(w, 5).rlike(r"^[\d.]+$")
    # through `inline` the words are a column of their own; as an expression every reading of them would split the line again
    split = lines.select("*", F.inline(F.array(F.struct(_words(F.col("line")).alias("_w")))))
    rows = split.where(F.when(fits, whole))
    return rows.select(
        F.array_join(F.slice(w, 2, named - 1), " ").alias("species"),
        *[_from_right(w, tail + years - i).try_cast("bigint").alias(f"year_{y}") for i, y in enumerate(YEARS)],
        _from_right(w, 6).try_cast("bigint").alias("total"), _from_right(w, 5).try_cast("double").alias("average"),
        _from_right(w, 4).try_cast("bigint").alias("newly_ringed"), _from_right(w, 3).try_cast("bigint").alias("retraps"),
        _from_right(w, 2).try_cast("bigint").alias("year_max_count"), F.substring(_from_right(w, 1), 2, 4).try_cast("int").alias("year_max_year"), *carried,
    )


def annual_totals(lines: DataFrame) -> DataFrame:
    """The totals row of each file: its label, one count for each year, total, average, newly ringed, retraps."""
    w, years = F.col("_w"), len(YEARS)
    carried = [c for c in lines.columns if c != "line"]
    fits = (F.size(w) == years + 5) & (F.get(w, F.lit(0)) == "Totals") & F.get(w, F.lit(years + 2)).rlike(r"^[\d.]+$")
    whole = _all_whole(F.concat(F.slice(w, 2, years + 1), F.slice(w, years + 4, 2)))
    return lines.withColumn("_w", _words(F.col("line"))).where(F.when(fits, whole)).select(
        *[F.get(w, F.lit(i + 1)).try_cast("bigint").alias(f"year_{y}") for i, y in enumerate(YEARS)],
        F.get(w, F.lit(years + 1)).try_cast("bigint").alias("total"), F.get(w, F.lit(years + 2)).try_cast("double").alias("average"),
        F.get(w, F.lit(years + 3)).try_cast("bigint").alias("newly_ringed"), F.get(w, F.lit(years + 4)).try_cast("bigint").alias("retraps"), *carried,
    )


def annual_effort(lines: DataFrame) -> DataFrame:
    """(year, observation_hours, source_file) of each file.

    The row lists only monitored years, then total and average, so tokens are
    aligned from the right: the last year sits third from the end.
    """
    words = _words(F.col("line"))
    tokens = F.filter(words, lambda w: w.rlike(r"^[\d,]+:\d{2}$"))
    rows = lines.where((F.get(words, F.lit(0)) == "Observation") & (F.get(words, F.lit(1)) == "hours")).select(
        "source_file", F.posexplode(F.reverse(tokens)).alias("back", "token")
    )
    return rows.where(F.col("back").between(2, len(YEARS) + 1)).select(
        (F.lit(YEARS[-1] + 2) - F.col("back")).cast("int").alias("year"), hours_from_clock(F.col("token")).alias("observation_hours"),
        "source_file",
    )


def annual_long(lines: DataFrame) -> DataFrame:
    """Species x year per file with effort; years without effort are unmonitored, not zero."""
    names = [f"year_{y}" for y in YEARS]
    carried = [c for c in lines.columns if c != "line"]
    long = annual_species(lines).select("species", *names, *carried).unpivot(["species", *carried], names, "_year", "count")
    long = long.withColumn("year", F.regexp_extract("_year", r"(\d+)", 1).cast("int"))
    joined = long.join(annual_effort(lines), ["source_file", "year"], "left")
    monitored = F.coalesce(F.col("observation_hours") > 0, F.lit(False))
    return joined.select(
        "species", "year", "count", "observation_hours", monitored.alias("monitored"),
        F.when(monitored, F.col("count") / F.col("observation_hours")).alias("count_per_hour"), *carried,
    )


def merge_annual(long: DataFrame) -> DataFrame:
    """One row per (species, year) across files, the most recently modified file wins."""
    return newest_version(long, ["species", "year"], ["modified", "source_file"])


def career_summary(lines: DataFrame) -> DataFrame:
    """Career figures per (species, file), one row each."""
    keep = ["total", "average", "newly_ringed", "retraps", "year_max_count", "year_max_year"]
    return annual_species(lines).groupBy("species", "source_file").agg(F.min(F.struct(*keep)).alias("_r")).select(
        "species", "_r.*", "source_file"
    )


# --- crosstab sheets, one CSV per period preset ---------------------------------

def read_crosstab_index(spark: SparkSession, path: str) -> DataFrame:
    """Index sheet as CSV; the header is the line starting with 'Period code' (S15)."""
    cells = spark.read.csv(path, header=False, inferSchema=False)
    names = ["period_code", "period_label", "months_included", "species_recorded", "total_combined", "total_newly_ringed", "total_retraps"]
    rows = cells.toDF(*names[: len(cells.columns)], *[f"_x{i}" for i in range(len(cells.columns) - len(names))])
    return rows.where(F.col("period_code").rlike(r"^\s*\d+\s*$")).select(
        F.trim("period_code").cast("int").alias("period_code"), "period_label", "months_included",
        *[number(F.col(c)).cast("bigint").alias(c) for c in names[3:]],
    )


def read_crosstab_sheets(spark: SparkSession, path: str, columns: list[str], pattern: str = "*.csv") -> DataFrame:
    """Preset sheets as CSV files named '<period label>.csv' with header columns `columns`.

    Title, blank and header lines are recognised by their label and skipped
    later, with the total rows.
    """
    cells = spark.read.option("pathGlobFilter", pattern).csv(path, header=False, inferSchema=False, schema=", ".join(f"`{c}` string" for c in columns))
    return cells.select(
        "*", F.regexp_replace(F.col("_metadata.file_name"), r"(%20|\.csv$)", " ").alias("_n"), F.col("_metadata.file_name").alias("source_file")
    ).withColumn("period_label", F.trim("_n")).drop("_n")
