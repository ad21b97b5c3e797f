"""Chronological cuts, hold-outs and train-only encoders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz import fixed_values as fv
from strikehaz.functions.coerce import moment, number
from strikehaz.functions.times import micros
from strikehaz.operators.ordered import null_safe, running_totals


def chronological_split(
    df: DataFrame, date_col: str, id_col: str, train_fraction: float = fv.TRAIN_FRACTION,
    validation_fraction: float = fv.VALIDATION_FRACTION,
) -> DataFrame:
    """`df` with `split`, cut by row count in date order at floor(n * fraction).

    Rows without a date are left out.  A histogram of instants decides every row
    except those on the two instants where a cut falls; only these are ordered
    by id.  No global sort.
    """
    for f in (train_fraction, validation_fraction):
        if not 0 < f < 1:
            raise ValueError("train_fraction and validation_fraction must each be in (0, 1)")
    if train_fraction + validation_fraction >= 1:
        raise ValueError("train_fraction + validation_fraction must be below 1; the test split takes the rest")
    dated = df.withColumn("_at", micros(moment(F.col(date_col)))).where(F.col("_at").isNotNull())
    hist = running_totals(dated.groupBy("_at").agg(F.count("*").alias("n")), ["_at"], ["n"])
    cut1 = F.floor(F.col("all_n") * F.lit(train_fraction))
    cut2 = F.floor(F.col("all_n") * F.lit(train_fraction + validation_fraction))
    edges = hist.select("_at", "n", "below_n", cut1.alias("_c1"), cut2.alias("_c2"))
    first, last = F.col("below_n"), F.col("below_n") + F.col("n")

    def inside(cut: str) -> Column:
        return (first < F.col(cut)) & (F.col(cut) < last)

    whole = edges.withColumn("_tied", inside("_c1") | inside("_c2"))
    label = (
        F.when(last <= F.col("_c1"), "train").when((first >= F.col("_c1")) & (last <= F.col("_c2")), "validation")
        .when(first >= F.col("_c2"), "test")
    )
    placed = dated.join(whole.withColumn("_label", label), "_at")
    settled = placed.where(~F.col("_tied")).select(*df.columns, F.col("_label").alias("split"))
    # the cut rows: one instant can hold very many, so they are ordered by (id % 4096, id) in slices
    tied = placed.where("_tied").withColumn("_id", _sortable(df, id_col))
    spread = tied.withColumn("_part", F.coalesce(F.pmod("_id", F.lit(4096)), F.lit(-1)))  # rows without an id come first
    sizes = spread.groupBy("_at", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_at").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_at", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    row = F.row_number().over(Window.partitionBy("_at", "_part").orderBy("_id")) - 1
    position = F.col("below_n") + F.col("_row") + F.col("_shift")
    cut = spread.withColumn("_row", row).join(sizes, ["_at", "_part"]).select(
        *df.columns,
        F.when(position < F.col("_c1"), "train").when(position < F.col("_c2"), "validation").otherwise("test").alias("split"),
    )
    return settled.unionByName(cut)


def _sortable(df: DataFrame, id_col: str) -> Column:
    """Integer ids order as they are, other ids by a hash."""
    integral = df.schema[id_col].dataType.typeName() in ("long", "integer", "short", "byte")
    return F.col(id_col).cast("bigint") if integral else F.xxhash64(F.col(id_col).cast("string"))


def split_boundaries(split_df: DataFrame, date_col: str) -> DataFrame:
    """(split, n, first_date, last_date) of a split result."""
    return split_df.groupBy("split").agg(
        F.count("*").alias("n"), F.min(date_col).alias("first_date"), F.max(date_col).alias("last_date")
    )


def year_split(df: DataFrame, year_col: str, train_end: int = fv.TRAIN_END_YEAR, validation_end: int = fv.VALIDATION_END_YEAR) -> DataFrame:
    """`df` with `split` by calendar year, bounds inclusive; rows without a year are left out."""
    year = number(F.col(year_col))
    return df.where(year.isNotNull()).withColumn(
        "split", F.when(year <= train_end, "train").when(year <= validation_end, "validation").otherwise("test")
    )


def holdout_by_values(df: DataFrame, column: str, held_out: list) -> DataFrame:
    """`df` with `held_out`: every row of the listed airports or regions, whole groups only."""
    return df.withColumn("held_out", F.coalesce(F.col(column).isin(held_out), F.lit(False)))


def holdout_latest_year(df: DataFrame, date_col: str) -> DataFrame:
    """`df` with `held_out` for the most recent calendar year present."""
    year = F.year(moment(F.col(date_col)))
    latest = df.agg(F.max(year).alias("y")).scalar()
    return df.withColumn("held_out", F.coalesce(year == latest, F.lit(False)))


def holdout_by_coverage(df: DataFrame, column: str = "monitoring_available") -> DataFrame:
    """`df` with `held_out` where monitoring was not available."""
    return df.withColumn("held_out", ~F.coalesce(F.col(column).cast("boolean"), F.lit(False)))


def stratified_split(df: DataFrame, label_col: str, id_col: str, train_fraction: float, seed: int = 42) -> DataFrame:
    """`df` with `split`, the same fraction of each label, order fixed by a seeded hash of the id (U8); null is a label.

    The cut is the hash value below which floor(n * fraction) rows of the label
    fall, found on the histogram of hash prefixes; only rows sharing the prefix
    at the cut are numbered.
    """
    hashed = df.withColumn("_h", F.xxhash64(F.col(id_col), F.lit(seed))).withColumn("_prefix", F.shiftright("_h", 40))
    hist = hashed.groupBy(F.col(label_col).alias("_label"), F.col("_prefix").alias("_at")).agg(F.count("*").alias("n"))
    cut = F.floor(F.col("all_n") * F.lit(train_fraction))
    totals = running_totals(hist, ["_at"], ["n"], by=["_label"]).select("_label", "_at", "below_n", cut.alias("_cut"))
    # 2^24 prefixes: a label of 1e12 rows still numbers only ~60,000 rows per group
    inside = Window.partitionBy(label_col, "_prefix").orderBy("_h", id_col)
    numbered = hashed.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(totals, null_safe(numbered, totals, {label_col: "_label", "_prefix": "_at"})).select(
        *[numbered[c] for c in df.columns], F.when(F.col("_row") + F.col("below_n") < F.col("_cut"), "train").otherwise("test").alias("split"))


# --- encoders fitted on the training split only -------------------------------------

def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull())


def frequent_categories(train: DataFrame, columns: list[str], threshold: int = fv.RARE_THRESHOLD) -> DataFrame:
    """(column, value) seen at least `threshold` times in training, all columns in one pass."""
    return _long(train, columns).groupBy("column", "value").agg(F.count("*").alias("n")).where(
        F.col("n") >= threshold
    ).select("column", "value")


def bucket_rare(df: DataFrame, frequent: DataFrame, columns: list[str]) -> DataFrame:
    """Values not in `frequent` become 'rare_other'; null stays null (G31).  Each column meets its values in a join."""
    for c in columns:
        words = frequent.where(F.col("column") == c).select(F.col("value").alias("_value"))
        text = F.col(c).cast("string")
        df = df.join(words, text == F.col("_value"), "left").withColumn(
            c, F.when(text.isNull() | F.col("_value").isNotNull(), text).otherwise(fv.RARE_TOKEN)
        ).drop("_value")
    return df


def seen_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct (column, value) of training plus validation rows."""
    return _long(df, columns).distinct()


def numeric_ranges(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, low, high) over the training rows."""
    row = train.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__lo") for c in columns],
                    *[F.max(F.col(c).cast("double")).alias(f"{c}__hi") for c in columns])
    lines = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"{c}__lo").alias("low"), F.col(f"{c}__hi").alias("high")) for c in columns
    ])
    return row.select(F.inline(lines))


def standardised(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """(x - train mean) / train std, a zero spread divides by 1."""
    stats = train.agg(F.struct(
        *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
    ).alias("s")).scalar()
    with_stats = df.withColumn("_s", stats)
    spread = {c: F.when(F.col(f"_s.s_{c}") > 0, F.col(f"_s.s_{c}")).otherwise(1.0) for c in columns}
    return with_stats.withColumns({c: (F.col(c) - F.col(f"_s.m_{c}")) / spread[c] for c in columns}).drop("_s")
