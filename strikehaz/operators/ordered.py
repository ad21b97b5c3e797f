"""Global order without a global sort: running totals over a histogram.

Rank metrics, quantile cuts and curves only need, for each distinct value, how
much lies below it.  The data is first reduced to one row per distinct value,
dealt out by sorted range; totals run inside each slice and the slice offsets
(one row per group and slice) are added.  There is one path for every size, and
null groups, keys and ids are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz.session import durable

#: Distinct values summed in one task; the number of slices follows from the measured histogram.
SLICE_ROWS = 200_000


def null_safe(left: DataFrame, right: DataFrame, on: dict[str, str]) -> Column:
    """Equality of column pairs where null equals null."""
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in on.items()])


def running_totals(
    hist: DataFrame, order: list[str], values: list[str], by: list[str] | None = None, slice_rows: int | None = None,
) -> DataFrame:
    """`hist` with `below_<v>` (sum over strictly smaller keys of the group) and `all_<v>` (group total).

    `order` is unique per `by` group; null keys come first, a null group is a
    group.  Group totals come from the same slices, so nothing is gathered in one
    task beyond a slice and the slices' own totals.
    """
    by = by or []
    hist = durable(hist)
    slices = max(1, -(-hist.count() // (slice_rows or SLICE_ROWS)))
    sliced = durable(hist.repartitionByRange(slices, *by, *order).withColumn("_slice", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sliced.groupBy(*by, "_slice").agg(*[F.sum(v).alias(f"_s_{v}") for v in values]).select(
        *[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col("_slice").alias("_of"),
        *[F.coalesce(F.sum(f"_s_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_s_{v}").over(whole).alias(f"all_{v}") for v in values],
    )
    summed = sliced.withColumns({f"_w_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    same = null_safe(summed, offsets, {"_slice": "_of", **{c: f"_by_{i}" for i, c in enumerate(by)}})
    return summed.join(offsets, same).select(
        *[summed[c] for c in hist.columns],
        *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"below_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )


def ranked(df: DataFrame, order_col: str, id_col: str, salt_parts: int = 4096) -> DataFrame:
    """`df` with `rank` (0-based) and `n_total` in the order (order_col, id % salt_parts, id), nulls first.

    Rows sharing one value are spread over `salt_parts` groups by id, so a value
    held by a third of all rows never has to be numbered in one task.
    """
    spread = df.withColumn("_part", F.coalesce(F.pmod(F.col(id_col), F.lit(salt_parts)), F.lit(-1)))
    hist = spread.groupBy(F.col(order_col).alias("_value"), F.col("_part").alias("_salt")).agg(F.count("*").alias("n"))
    below = running_totals(hist, ["_value", "_salt"], ["n"])
    inside = Window.partitionBy(order_col, "_part").orderBy(id_col)
    numbered = spread.withColumn("_row", F.row_number().over(inside) - 1)
    return numbered.join(below, null_safe(numbered, below, {order_col: "_value", "_part": "_salt"})).select(
        *[numbered[c] for c in df.columns], (F.col("_row") + F.col("below_n")).alias("rank"), F.col("all_n").alias("n_total"))
