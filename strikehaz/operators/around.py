"""Instants at places meet the events of all stations in range, cell by cell, without a row per instant and station.

Places keep one wide grid cell; a station's events are copied to the few cells whose places have it in range and to the time
chunks they can matter in.  One group is a cell and a chunk, dealt further into parts of the stations (or of another
column) and blocks of the instants by counted rows; inside it numpy walks place by place.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strikehaz.operators.spatial import _home_cell, exchanged
from strikehaz.operators.temporal import _chunk, _copied

EVENTS, INSTANTS = 1 << 19, 1 << 17  # rows of one group, about
GROUP = ["_cell", "_chunk", "_part", "_block"]


def around(
    instants: DataFrame, pairs: DataFrame, events: DataFrame, walk: tuple[Callable, Callable, str], *, key: str, ts: str,
    radius_km: float, back: int, step: int, ahead: int = 0, deal: str | None = None,
) -> DataFrame:
    """What `walk` finds for each asked instant of each place that has events in its cell: lon, lat, at and the columns of the walk.

    `instants`: distinct lon, lat, at; `pairs`: lon, lat, key, distance_km, read several times (`durable`); `events`: key, ts and what
    the walk reads.  A walk is (prepare, answer, columns): `prepare` sees the events of a group by time with their station numbers,
    `answer` the stations of one place by distance and id and its instants.  Groups that have too many events are dealt by
    key, or by the column `deal` of the events; each part gives rows of its own, which the caller brings together.
    """
    prepare, answer, schema = walk
    homes = pairs.withColumn("_cell", _home_cell("lon", "lat", 2 * radius_km))
    crossing = homes.select(key, "_cell").distinct()
    seen = _copied(events.where(F.col(ts).isNotNull()).withColumn("_ts", F.col(ts)), "_ts", back + ahead, step)
    places = homes.select("lon", "lat", "_cell").distinct()
    asked = instants.where(F.col("at").isNotNull()).join(places, ["lon", "lat"]).withColumn("_chunk", _chunk(F.col("at") - back, step))

    def rounds(loads: DataFrame, limit: int, name: str) -> DataFrame:
        top = loads.groupBy("_cell", "_chunk").agg(F.sum("n").alias("n")).groupBy("_cell").agg(F.max("n").alias("n"))
        return top.select("_cell", F.ceil(F.col("n") / limit).alias(name))

    parts = rounds(seen.groupBy(key, "_chunk").agg(F.count("*").alias("n")).join(crossing, key), EVENTS, "_parts")
    blocks = rounds(asked.groupBy("_cell", "_chunk").agg(F.count("*").alias("n")), INSTANTS, "_blocks")
    dealt = parts.join(blocks, "_cell")

    def slot(column: str):
        return F.pmod(F.xxhash64(column), F.col("_parts"))

    all_blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    right = seen.join(crossing.join(dealt, "_cell"), key).withColumn("_part", slot(deal or key)).withColumn("_block", all_blocks)
    one = F.struct("distance_km", F.col(key).alias("id"))
    near = homes.join(dealt, "_cell")
    near = near.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)) if deal else slot(key))
    near = near.groupBy("lon", "lat", "_part").agg(F.sort_array(F.collect_list(one)).alias("_near"))
    left = asked.join(dealt, "_cell").withColumn("_block", F.pmod(F.xxhash64("lon", "lat", "at"), F.col("_blocks")))
    left = left.groupBy("lon", "lat", "_cell", "_chunk", "_block").agg(F.collect_list("at").alias("_ats")).join(exchanged(near), ["lon", "lat"])
    left = left.select("lon", "lat", *GROUP, "_ats", F.col("_near.id").alias("_ids"), F.col("_near.distance_km").alias("_km"))
    right = right.select(*[F.col(c).alias(c) for c in GROUP], key, "_ts", *[c for c in events.columns if c not in (key, ts)])

    spark = instants.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = StructType.fromDDL(f"lon double, lat double, at bigint, {schema}")
    arrow = to_arrow_schema(out)

    def met(places: pa.Table, found: pa.Table) -> pa.Table:
        # all of this goes to the workers by value: nothing here may name a function of this package
        if not places.num_rows or not found.num_rows:
            return arrow.empty_table()
        found = found.combine_chunks().sort_by("_ts")
        coded = found[key].combine_chunks().dictionary_encode()
        view = prepare(found, coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))
        pieces = []
        for lon, lat, ats, ids, km in zip(*[places[c] for c in ("lon", "lat", "_ats", "_ids", "_km")]):
            number = pc.index_in(ids.values, coded.dictionary)
            known = number.is_valid()
            at = ats.values.to_numpy(zero_copy_only=False)
            kept, columns = answer(view, number.drop_null().to_numpy(zero_copy_only=False), ids.values.filter(known), km.values.filter(known), at)
            k = len(at) if kept is None else len(kept)
            spot = [pa.array(np.full(k, lon.as_py())), pa.array(np.full(k, lat.as_py())), pa.array(at if kept is None else at[kept])]
            pieces.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip([*spot, *columns], arrow)], schema=arrow))
        return pa.concat_tables(pieces)

    return left.repartition(n, *GROUP).groupBy(*GROUP).cogroup(right.repartition(n, *GROUP).groupBy(*GROUP)).applyInArrow(met, out)


def window_sums(values: dict[str, list[str]], windows: dict[str, int]) -> tuple[Callable, Callable, str]:
    """Sums of each value over [at - window, at) as `<value>_<label>`: differences of running totals."""
    names = list(values)

    def prepare(found, codes, n):
        table = np.stack([pc.fill_null(found[v].cast(pa.float64()), 0.0).to_numpy() for v in names], axis=1)
        return found["_ts"].to_numpy(), codes, n, table

    def answer(view, near, ids, km, at):
        ts, codes, n, table = view
        here = np.zeros(n, dtype=bool)
        here[near] = True
        rows = np.flatnonzero(here[codes])
        ts = ts[rows]
        totals = np.zeros((len(rows) + 1, len(names)))
        np.cumsum(table[rows], axis=0, out=totals[1:])
        now = totals[np.searchsorted(ts, at)]
        then = {label: totals[np.searchsorted(ts, at - length)] for label, length in windows.items()}
        return None, [pa.array(now[:, i] - then[label][:, i]) for i, v in enumerate(names) for label in values[v]]

    return prepare, answer, ", ".join(f"{v}_{label} double" for v, labels in values.items() for label in labels)


def window_distinct(column: str, span: int, name: str) -> tuple[Callable, Callable, str]:
    """Distinct values of `column` over [at - span, at): stretches of time in which a value stays in the window, begun less ended."""

    def prepare(found, codes, n):
        ts, value = found["_ts"].to_numpy(), found[column].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((ts, value))
        return ts[order], codes[order], n, value[order]

    def answer(view, near, ids, km, at):
        ts, codes, n, value = view
        here = np.zeros(n, dtype=bool)
        here[near] = True
        rows = np.flatnonzero(here[codes])
        ts, value = ts[rows], value[rows]
        new = np.ones(len(rows) + 1, dtype=bool)  # a stretch begins at the row, or the rows are over
        new[1:-1] = (value[1:] != value[:-1]) | (ts[1:] - ts[:-1] > span)
        begun, ended = np.sort(ts[new[:-1]]), np.sort(ts[new[1:]]) + span
        return None, [pa.array(np.searchsorted(begun, at) - np.searchsorted(ended, at))]

    return prepare, answer, f"{name} bigint"


def nearest_fresh(key: str, key_type: str, payload: str, payload_type: str, max_age: int, either_side: bool) -> tuple[Callable, Callable, str]:
    """The first station by distance and id with an event at most `max_age` old, and its freshest event.

    With `either_side` the event closest in time on either side, the earlier one on equal gaps.  Instants without one give no row.
    """

    def prepare(found, codes, n):
        return found["_ts"].to_numpy(), codes, n, found[payload].combine_chunks()

    def answer(view, near, ids, km, at):
        ts, codes, n, seen = view
        rank = np.full(n, -1, dtype=np.int64)
        rank[near] = np.arange(len(near))
        rows = np.flatnonzero(rank[codes] >= 0)
        t, r = ts[rows], rank[codes[rows]]
        first, past = np.searchsorted(t, at - max_age), np.searchsorted(t, at + (max_age if either_side else 0), side="right")
        kept = np.flatnonzero(past > first)
        first, past, asked = first[kept], past[kept], at[kept]
        if not len(kept):
            return kept, [pa.array([], type=f) for f in (ids.type, pa.float64(), pa.int64(), seen.type)]
        # least rank of each window: minima over stretches of 2^level events
        level, best, least = np.frexp((past - first).astype(float))[1] - 1, np.empty(len(kept), dtype=np.int64), r
        for i in range(level.max() + 1):
            of = level == i
            best[of] = np.minimum(least[first[of]], least[past[of] - (1 << i)])
            least = np.minimum(least[:-(1 << i)], least[1 << i:])
        # that station's last event at or before the instant, and the next one
        start = min(t[0], asked.min())
        span = max(t[-1], asked.max()) - start + 1
        line = r * span + (t - start)
        order = np.argsort(line, kind="stable")
        line = line[order]
        following = np.searchsorted(line, best * span + (asked - start), side="right")
        row, never = np.maximum(following - 1, 0), np.int64(1) << 62
        age = np.where((following > 0) & (line[row] // span == best), asked - t[order[row]], never)
        if either_side:
            after = np.minimum(following, len(line) - 1)
            gap = np.where((following < len(line)) & (line[after] // span == best), t[order[after]] - asked, never)
            row, age = np.where(gap < age, after, row), np.minimum(gap, age)
        return kept, [ids.take(pa.array(best)), km.take(pa.array(best)), pa.array(age), seen.take(pa.array(rows[order[row]]))]

    return prepare, answer, f"{key} {key_type}, distance_km double, age bigint, hit {payload_type}"
