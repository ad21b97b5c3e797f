"""Exploratory tables: roll-ups, confounding, rank correlation, leakage smoke test, histograms."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.functions.coerce import number
from strikehaz.operators.ordered import running_totals


def seasonal_rollup(df: DataFrame, month: str, target: str) -> DataFrame:
    """Labelled strikes and damage rate per month."""
    return df.where(F.col(month).isNotNull()).groupBy(F.col(month).alias("month")).agg(
        F.count(target).alias("n_strikes"), F.avg(target).alias("damage_rate")
    )


def rate_by(df: DataFrame, key: str, target: str, minimum: int = 30) -> DataFrame:
    """(key, n, rate) of groups with enough labelled rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(target).alias("n"), F.avg(target).alias("rate")
    ).where(F.col("n") >= minimum)


def extremes(df: DataFrame, key: str, target: str, minimum: int = 30, k: int = 5) -> DataFrame:
    """The k highest and k lowest groups by rate."""
    rates = rate_by(df, key, target, minimum)
    text = F.col(key).cast("string").alias("group")
    high = rates.orderBy(F.desc("rate"), key).limit(k).select(F.lit("highest").alias("end"), text, "n", "rate")
    low = rates.orderBy("rate", F.desc(key)).limit(k).select(F.lit("lowest").alias("end"), text, "n", "rate")
    return high.unionByName(low)


def rate_range(df: DataFrame, key: str, target: str, minimum: int = 0) -> DataFrame:
    """Lowest and highest group rate."""
    return rate_by(df, key, target, minimum).agg(
        F.lit(key).alias("key"), F.count("*").alias("n_groups"), F.min("rate").alias("low"), F.max("rate").alias("high")
    )


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, n, rho): rank correlation of every column pair over rows where both are present.

    Ranks are averages over ties, read from value histograms; value pairs are
    counted before they meet their ranks.
    """
    pairs = list(combinations(columns, 2))
    values = df.select(*[number(F.col(c)).alias(c) for c in columns])
    rows = values.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)
    ]))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    joint = rows.groupBy("pair", "x", "y").agg(F.count("*").alias("n"))

    def ranks(side: str) -> DataFrame:
        hist = joint.groupBy("pair", side).agg(F.sum("n").alias("n"))
        totals = running_totals(hist, [side], ["n"], ["pair"])
        return totals.select("pair", side, (F.col("below_n") + (F.col("n") + 1) / 2).alias(f"r{side}"))

    scored = joint.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    sums = scored.groupBy("pair").agg(
        F.sum(n).alias("n"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"),
        F.sum(n * rx * rx).alias("sxx"), F.sum(n * ry * ry).alias("syy"), F.sum(n * rx * ry).alias("sxy"),
    )
    vx = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    vy = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return sums.select(
        F.get(names, F.col("pair"))["a"].alias("a"), F.get(names, F.col("pair"))["b"].alias("b"), "n",
        F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("rho"),
    )


def leakage_smoke(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, kind, present_rate, absent_rate, correlation) per forbidden column, one pass."""
    numeric = [c for c in columns if df.schema[c].dataType.typeName() != "string"]
    text = [c for c in columns if c not in numeric]
    row = df.agg(
        F.count("*").alias("_n"),
        *[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(f"r_{c}") for c in numeric],
        *[F.avg(F.when(F.col(c).isNotNull(), F.col(target))).alias(f"p_{c}") for c in text],
        *[F.avg(F.when(F.col(c).isNull(), F.col(target))).alias(f"a_{c}") for c in text],
    )
    none = F.lit(None).cast("double")

    def line(c: str):
        kind = "numeric" if c in numeric else "categorical"
        present, absent, r = (none, none, F.round(f"r_{c}", 3)) if c in numeric else (F.col(f"p_{c}"), F.col(f"a_{c}"), none)
        return F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("kind"), present.alias("present_rate"),
            absent.alias("absent_rate"), r.alias("correlation"),
        )

    return row.select(F.inline(F.array(*[line(c) for c in columns])))


def class_histogram(df: DataFrame, value: str, target: str, bins: int = 30) -> DataFrame:
    """(class, bin, n, density): equal-width bins over the pooled range, top edge included."""
    rows = df.select(number(F.col(value)).alias("v"), F.col(target).alias("class")).where(
        F.col("v").isNotNull() & F.col("class").isNotNull()
    )
    limits = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    placed = rows.withColumn("_s", limits)
    width = (F.col("_s.hi") - F.col("_s.lo")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("_s.lo")) / width), F.lit(bins - 1))).otherwise(0)
    per_bin = placed.groupBy("class", (index + 1).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.max(width).alias("_w"))
    totals = rows.groupBy("class").agg(F.count("*").alias("_total"))
    return per_bin.join(totals, "class").select(
        "class", "bin", "n", F.when(F.col("_w") > 0, F.col("n") / (F.col("_total") * F.col("_w"))).alias("density")
    )
