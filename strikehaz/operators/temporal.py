"""Look-back and as-of joins without query-observation pairs.

Look-back sums are differences of running totals that each key and time chunk packs into one
sorted array; as-of joins merge observations and query instants into one ordered stream and ask
for equal (key, instant) pairs once.  A chunk is one maximal window longer than its step, observations are copied
to the few chunks they can matter in, so a busy key splits by time and no state crosses chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz.session import durable

HOUR = 3_600_000_000  # microseconds


def _chunk(at: Column, step: int) -> Column:
    return F.floor(at / F.lit(step))


def in_lookback(ts: Column, at: Column, hours: float) -> Column:
    """at - hours <= ts < at, false for a missing timestamp."""
    return F.coalesce((ts >= at - F.expr(f"INTERVAL '{int(hours * 3600)}' SECOND")) & (ts < at), F.lit(False))


def _copied(observations: DataFrame, ts: str, span: int, step: int) -> DataFrame:
    copies = math.ceil(span / step) + 1
    home = _chunk(F.col(ts), step)
    return observations.withColumn("_chunk", F.explode(F.sequence(home - (copies - 1), home)))


def _below(sorted_values: Column, halvings: Column, bound: Column) -> Column:
    """How many entries of a sorted array are below `bound`, by binary search; `halvings` holds falling powers of two."""
    def step(found: Column, width: Column) -> Column:
        last = F.get(sorted_values, found + width - 1)  # null beyond the end
        return F.when(last < bound, found + width).otherwise(found)

    return F.aggregate(halvings, F.lit(0), step)


BLOCK = 1 << 14  # asked instants that meet one packed line at once, at most


def in_blocks(instants: DataFrame) -> DataFrame:
    """`instants` with `_block`, a number that at most BLOCK rows share, written down so that a lost task cannot renumber them."""
    numbered = instants.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), int(math.log2(BLOCK))))
    return durable(numbered)


def lookback_sums(
    instants: DataFrame, measures: DataFrame, *, key: str, at: str, ts: str, values: dict[str, list[str]],
    windows: dict[str, int], group_by: list[str], step: int | None = None,
) -> DataFrame:
    """Sums of measures over [at - window, at) per instant, over all its keys.

    `measures` holds one row per (key, ts); `values` names for each measure the
    window labels wanted; `windows` gives their lengths in microseconds.  Output:
    one row per `group_by` with `<value>_<label>`; instants that meet nothing
    still appear, with zeros, so callers decide between null and 0 by a row count.

    Each key and chunk packs its instants and running totals into one sorted array, and the asked instants
    meet it a block (`in_blocks`) at once: the edges of the windows are found by binary search, and a sum is the difference of
    two totals.  However many places ask for one busy key, no block grows; no array is longer than the distinct instants of `span + step` of
    one key, a bound of the clock and not of the data.  A smaller `step` shortens it at the price of more copies of
    the (already aggregated) measures.
    """
    span = max(windows.values())
    step = step or span
    order = Window.partitionBy("_key", "_chunk").orderBy("_ts").rowsBetween(Window.unboundedPreceding, 0)
    seen = _copied(measures.where(F.col(ts).isNotNull()), ts, span, step).select(
        F.col(key).alias("_key"), "_chunk", F.col(ts).alias("_ts"), *[F.col(v).cast("double").alias(v) for v in values])
    running = seen.select("_key", "_chunk", "_ts", F.struct(*[F.coalesce(F.sum(v).over(order), F.lit(0.0)).alias(v) for v in values]).alias("_sums"))
    packed = running.groupBy("_key", "_chunk").agg(F.sort_array(F.collect_list(F.struct("_ts", "_sums"))).alias("_line")).select(
        F.col("_key").alias("_of"), F.col("_chunk").alias("_part"), F.col("_line._ts").alias("_times"), F.col("_line._sums").alias("_totals"))

    if "_block" not in instants.columns:
        instants = in_blocks(instants)
    pair = F.struct(F.col(at).alias("_at"), *group_by)
    asked = instants.groupBy(F.col(key).alias("_key"), _chunk(F.col(at) - span, step).alias("_chunk"), "_block").agg(F.collect_list(pair).alias("_asked"))
    met = asked.join(packed, F.col("_key").eqNullSafe(F.col("_of")) & (F.col("_chunk") == F.col("_part")), "left")
    bits = F.ceil(F.log2(F.coalesce(F.size("_times"), F.lit(0)) + 1)).cast("int")
    met = met.withColumn("_halvings", F.when(bits > 0, F.transform(
        F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda b: F.pow(F.lit(2.0), b).cast("int"))).otherwise(F.array().cast("array<int>")))

    def edges(pair: Column) -> Column:
        ends = {"now": 0, **windows}
        return F.struct(*[pair[c].alias(c) for c in group_by], *[
            _below(F.col("_times"), F.col("_halvings"), pair["_at"] - length).alias(f"_{name}") for name, length in ends.items()])

    def sums(edge: Column) -> Column:
        def total(value: str, name: str) -> Column:
            return F.coalesce(F.get(F.col("_totals"), edge[f"_{name}"] - 1)[value], F.lit(0.0))

        return F.struct(*[edge[c].alias(c) for c in group_by], *[
            (total(v, "now") - total(v, label)).alias(f"{v}_{label}") for v, labels in values.items() for label in labels])

    names = [f"{v}_{label}" for v, labels in values.items() for label in labels]
    hits = met.select(F.explode(F.transform(F.transform("_asked", edges), sums)).alias("_hit")).select("_hit.*")
    return hits.groupBy(*group_by).agg(*[F.sum(n).alias(n) for n in names])


def latest_before(
    instants: DataFrame, events: DataFrame, *, key: str, at: str, ts: str, step: int = 7 * 24 * HOUR,
) -> DataFrame:
    """Instants with `latest`: the last event of the key strictly before `at`, however old.

    Running maximum inside a chunk, plus the maximum of all earlier chunks taken
    from one row per (key, chunk).
    """
    cols = instants.columns
    happened = events.where(F.col(ts).isNotNull()).select(key, F.col(ts).alias("_ts")).distinct().withColumn(
        "_chunk", _chunk(F.col("_ts"), step)
    )
    marks = instants.withColumn("_ts", F.col(at)).withColumn("_chunk", _chunk(F.col(at), step))
    both = happened.withColumn("_kind", F.lit(1)).unionByName(marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(key, "_chunk").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_in", F.max(F.when(F.col("_kind") == 1, F.col("_ts"))).over(order)).where("_kind = 0")
    chunks = both.groupBy(key, "_chunk").agg(F.max(F.when(F.col("_kind") == 1, F.col("_ts"))).alias("_top"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(key, "_chunk", F.max("_top").over(earlier).alias("_before"))
    return inside.join(chunks, [key, "_chunk"], "left").select(
        *cols, F.coalesce("_in", "_before").alias("latest")
    )


def asof_within(
    instants: DataFrame, observations: DataFrame, *, key: str, at: str, ts: str, payload: list[str],
    max_age: int, either_side: bool = False, step: int | None = None,
) -> DataFrame:
    """Instants with `hit` (struct of payload) and `age`: the freshest observation of the key at or before `at`.

    At most `max_age` microseconds old; with `either_side` the closest in time
    on either side, the earlier one on equal gaps.  Instants without one have
    null.  `observations` holds one row per (key, ts).
    """
    step = step or max(max_age, 24 * HOUR)
    cols = instants.columns
    reach = max_age * (2 if either_side else 1)
    asked = instants
    instants = asked.select(key, at).distinct()  # the answer depends on these alone
    seen = _copied(observations.where(F.col(ts).isNotNull()), ts, reach, step).select(
        key, "_chunk", F.col(ts).alias("_ts"), F.lit(0).alias("_kind"),
        F.struct(F.col(ts).alias("_at"), *payload).alias("_seen"),
    )
    marks = instants.withColumn("_ts", F.col(at)).withColumn("_chunk", _chunk(F.col(at) - max_age, step)).withColumn("_kind", F.lit(1))
    both = seen.unionByName(marks, allowMissingColumns=True)
    back = Window.partitionBy(key, "_chunk").orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_prior", F.last("_seen", ignorenulls=True).over(back))
    best, age = F.col("_prior"), F.col(at) - F.col("_prior._at")
    if either_side:
        ahead = Window.partitionBy(key, "_chunk").orderBy(F.desc("_ts"), F.desc("_kind")).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_next", F.last("_seen", ignorenulls=True).over(ahead))
        gap = F.col("_next._at") - F.col(at)
        later = F.coalesce(gap < age, age.isNull())
        best, age = F.when(later, F.col("_next")).otherwise(F.col("_prior")), F.when(later, gap).otherwise(age)
    found = both.where("_kind = 1").withColumn("hit", best).withColumn("age", age)
    fresh = F.col("age") <= max_age
    answers = found.select(
        F.col(key).alias("_of"), F.col(at).alias("_when"), F.when(fresh, F.col("hit")).alias("hit"), F.when(fresh, F.col("age")).alias("age"))
    return asked.join(answers, F.col(key).eqNullSafe(F.col("_of")) & F.col(at).eqNullSafe(F.col("_when"))).select(*cols, "hit", "age")
