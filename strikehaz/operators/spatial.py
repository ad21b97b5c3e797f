"""Distance joins over grid cells: every pair meets in exactly one cell, the exact distance decides.

Left rows stay where they are (one cell each); the right side, normally the
smaller site table, is copied to each cell its search cap touches.  Cells use
integer arithmetic so both sides always compute the same key, wrap at the
antimeridian and widen to whole rows near the poles.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz.fixed_values import COVERAGE_RADIUS_KM, HALF_LIFE_KM, RADII_KM
from strikehaz.functions import geo
from strikehaz.session import durable
from strikehaz.functions.coerce import on_globe


def _bands(radius_km: float) -> int:
    return max(1, int(180 / (geo.MARGIN * radius_km / geo.KM_PER_DEGREE)))


def _columns_in(band: str, bands: int) -> str:
    """Cells in a latitude band: a parabola in the band number, close to cos(lat) and exact in integers."""
    return f"greatest(1L, CAST(floor(2 * ({bands * bands} - pow(2 * {band} + 1 - {bands}, 2)) / {bands}) AS BIGINT))"


def _home_cell(lon: str, lat: str, radius_km: float) -> Column:
    bands = _bands(radius_km)
    band = f"least(floor(({lat} + 90) * {bands / 180}D), {bands - 1})"
    columns = _columns_in(band, bands)
    return F.expr(f"{band} * 10000000L + pmod(floor(({lon} + 180) / 360 * {columns}), {columns})")


def _cap_cells(lon: str, lat: str, radius_km: float) -> Column:
    """Array of every cell touched by the cap of MARGIN * radius around the point."""
    bands = _bands(radius_km)
    angle = geo.MARGIN * radius_km / geo.EARTH_KM
    degrees = math.degrees(angle)
    reach = (
        f"CASE WHEN abs({lat}) + {degrees}D >= 89.9D THEN 180D "
        f"ELSE degrees(asin(least({math.sin(min(angle, math.pi / 2))}D / cos(radians({lat})), 1D))) + 1e-9D END"
    )
    low = f"greatest(floor(({lat} - {degrees}D + 90) * {bands / 180}D), 0)"
    high = f"least(floor(({lat} + {degrees}D + 90) * {bands / 180}D), {bands - 1})"
    columns = _columns_in("b", bands)
    first = f"floor(({lon} - ({reach}) + 180) / 360 * {columns})"
    last = f"least(floor(({lon} + ({reach}) + 180) / 360 * {columns}), {first} + {columns} - 1)"
    return F.expr(f"flatten(transform(sequence({low}, {high}), b -> transform(sequence({first}, {last}), c -> b * 10000000L + pmod(c, {columns}))))")


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Narrow rows over all cores before heavy per-row work; small shuffles would otherwise be merged into one task.

    Hashing the hash keeps this exchange from being dropped as a repeat of an earlier one on the same columns.
    """
    return df.repartition(spread_parts(df.sparkSession), F.xxhash64(*by))


def spread_parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def exchanged(df: DataFrame) -> DataFrame:
    """The side of a join that may be far larger than its files or its lineage suggest: always shuffled and sorted.

    Spark's own estimate knows neither how many rows an explode makes nor how far a file unpacks, and would
    send such a side whole through the driver.
    """
    return df.hint("merge")


def within_radius(
    left: DataFrame, right: DataFrame, radius_km: float, *,
    left_lon: str = "lon", left_lat: str = "lat", right_lon: str = "longitude", right_lat: str = "latitude",
) -> DataFrame:
    """Every left-right pair at most `radius_km` apart, with `distance_km`.

    Rows without usable coordinates pair with nothing.  Callers reduce repeated
    left locations to distinct ones first, so a busy place costs one row here.
    """
    l = spread(left.where(on_globe(F.col(left_lat), F.col(left_lon))), left_lon, left_lat)
    r = right.where(on_globe(F.col(right_lat), F.col(right_lon)))
    cells = spread_parts(l.sparkSession)
    l = l.withColumn("_p", geo.placed(left_lon, left_lat)).withColumn("_u", _unit(left_lon, left_lat)).withColumn(
        "_cell", _home_cell(left_lon, left_lat, radius_km)
    ).repartition(cells, "_cell")
    r = r.withColumn("_q", geo.placed(right_lon, right_lat)).withColumn("_v", _unit(right_lon, right_lat)).withColumn(
        "_cell", F.explode(_cap_cells(right_lon, right_lat, radius_km))
    ).repartition(cells, "_cell")  # by number: few bytes make very many pairs, so no partitions are merged by their size
    keep = [c for c in l.columns if not c.startswith("_")] + [c for c in right.columns]
    met = l.join(exchanged(r), "_cell").where(_close(radius_km))
    # the join tests plain expressions only; a column of the task keeps Spark from moving the exact distance, which has
    # lambdas, into the join, where it would be worked out twice and the join no longer compiled
    exact = met.withColumns({"distance_km": geo.distance_km("_p", "_q"), "_task": F.spark_partition_id()})
    return exact.where((F.col("distance_km") <= radius_km) & (F.col("_task") >= 0)).select(*keep, "distance_km")


def _close(radius_km: float) -> Column:
    """Pairs in one plane by their distance there, others by a great-circle bound that no pair in range can miss: no trigonometry for each pair."""
    least = math.cos(min((radius_km * geo.MARGIN + 0.001) / geo.EARTH_KM, math.pi))
    limit = radius_km * 1000 * (1 + 1e-9) + 0.001
    return F.expr(
        f"CASE WHEN _p.region = _q.region THEN (_p.x - _q.x) * (_p.x - _q.x) + (_p.y - _q.y) * (_p.y - _q.y) <= {limit * limit!r}D "
        f"ELSE _u.x * _v.x + _u.y * _v.y + _u.z * _v.z >= {least!r}D END")


def site_links(airports: DataFrame, sites: DataFrame, radius_km: float = COVERAGE_RADIUS_KM) -> DataFrame:
    """(airport_id, site_id, distance_km) for every pair in range."""
    left = airports.select("airport_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    right = sites.select("site_id", "longitude", "latitude")
    return within_radius(left, right, radius_km).select("airport_id", "site_id", "distance_km")


def sites_within_radii(queries: DataFrame, sites: DataFrame, id_col: str, radii=RADII_KM) -> DataFrame:
    """Number of sites within each radius per query row; 0 where there is none."""
    spots = queries.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).distinct()
    pairs = within_radius(spots, sites.select("site_id", "longitude", "latitude"), max(radii))
    counts = pairs.groupBy("lon", "lat").agg(
        *[F.count_if(F.col("distance_km") <= r).alias(f"number_of_sites_within_{r}_km") for r in radii]
    )
    names = [f"number_of_sites_within_{r}_km" for r in radii]
    located = queries.select(id_col, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return located.join(counts, ["lon", "lat"], "left").select(
        id_col, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in names]
    )


def distance_weighted_total(
    queries: DataFrame, site_values: DataFrame, id_col: str, value_col: str = "value",
    radius_km: float = COVERAGE_RADIUS_KM, half_life_km: float = HALF_LIFE_KM,
) -> DataFrame:
    """Sum of value * 0.5^(distance/half-life) over the sites in range.

    No site in range: null total, 0 sites, weight 0.0.  A null value adds
    nothing to the total but its site's weight still counts.
    """
    spots = queries.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).distinct()
    pairs = within_radius(spots, site_values.select("site_id", "longitude", "latitude", value_col), radius_km)
    weight = geo.decay(F.col("distance_km"), half_life_km)
    totals = pairs.groupBy("lon", "lat").agg(
        F.coalesce(F.sum(F.col(value_col) * weight), F.lit(0.0)).alias("weighted_total"),
        F.count("*").alias("n_sites_used"),
        F.sum(weight).alias("total_weight"),
    )
    located = queries.select(id_col, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return located.join(totals, ["lon", "lat"], "left").select(
        id_col, "weighted_total",
        F.coalesce("n_sites_used", F.lit(0)).alias("n_sites_used"),
        F.coalesce("total_weight", F.lit(0.0)).alias("total_weight"),
    )


# --- nearest neighbour (J7) ------------------------------------------------------

def _depth(n_spots: int) -> tuple[float, ...]:
    """Cell sizes in degrees: deeper trees for more spots, so the last cells stay small even where spots crowd."""
    steps = [(200, 10.0), (20_000, 1.0), (2_000_000, 0.1), (200_000_000, 0.01)]
    return (*[size for i, (_, size) in enumerate(steps) if i == 0 or n_spots > steps[i - 1][0]], *([0.001] if n_spots > steps[-1][0] else []))


REGION_KM = 7000.0  # no two points of a region are that far apart
KIND = 10 ** 12  # root keys of one kind of spots are below that
SPHERE = 1.006  # margin of great circles against the ellipsoid


def _tree_key(lon: Column, lat: Column, size: float) -> Column:
    return F.floor((lat + 90) / size) * int(360 / size + 1) + F.floor((lon + 180) / size)


def _axes(lon: str, lat: str) -> tuple[str, str, str]:
    """Unit vector of a point; arcs between these need no further trigonometry than one acos."""
    return f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"


def _unit(lon: str, lat: str) -> Column:
    x, y, z = _axes(lon, lat)
    return F.expr(f"named_struct('x', {x}, 'y', {y}, 'z', {z})")


def _arc(v: str) -> str:
    """Great-circle kilometres from the row's point to a unit vector, to about 10 cm."""
    return f"{geo.EARTH_KM}D * acos(greatest(least(_ux * {v}.x + _uy * {v}.y + _uz * {v}.z, 1D), -1D))"


def _tree_center(key: Column, size: float) -> tuple[Column, Column]:
    width = int(360 / size + 1)
    row, column = F.floor(key / width), key % width
    return (column + 0.5) * size - 180, F.least((row + 0.5) * size - 90, F.lit(90.0))


def nearest(
    points: DataFrame, sites: DataFrame, *, lon: str = "lon", lat: str = "lat", id_col: str = "site_id",
) -> DataFrame:
    """(lon, lat, nearest_<id>, distance_km) per distinct location, exact at any distance.

    Equal distances go to the smallest id.
    """
    spots = (
        sites.where(on_globe(F.col("latitude"), F.col("longitude")))
        .groupBy(F.col("longitude").alias("_slon"), F.col("latitude").alias("_slat")).agg(F.min(id_col).alias("_sid"))
    )
    spots = spots.withColumn("_q", geo.placed("_slon", "_slat"))

    def exact(pairs: DataFrame) -> DataFrame:
        here = pairs.withColumn("_p", geo.placed("lon", "lat"))
        return here.withColumn("_d", geo.distance_km("_p", "_q"))

    hits = branch_and_bound(points.select(F.col(lon).alias("lon"), F.col(lat).alias("lat")), spots, exact)
    return hits.select("lon", "lat", F.col("_hit.id").alias(f"nearest_{id_col}"), F.col("_hit.d").alias("distance_km"))


def branch_and_bound(
    points: DataFrame, spots: DataFrame, exact: Callable[[DataFrame], DataFrame], *,
    sees: Callable[[Column, Column], Column] | None = None, levels: tuple[float, ...] | None = None,
) -> DataFrame:
    """(lon, lat, _hit struct(d, id)): the spot with the least `exact` distance per distinct point.

    Branch and bound over nested degree cells.  Per level each surviving cell
    offers an upper bound (distance to one spot in it) and a lower bound
    (distance to its far side); cells whose lower bound exceeds the best upper
    bound are dropped before their spots are ever paired.  A cell has at most
    100 children (648 at the root), so no array here grows with the data.  The
    tree depth follows the number of spots.

    `spots`: _slon, _slat, _sid and whatever `exact` reads to add `_d`.  Optional: `_half`, the kilometres a spot can be
    nearer or farther than its anchor (_slon, _slat), which widens the bounds of its own cells only; and `_kind`, a small number:
    each kind has its own root cells, and a point meets the kinds for which `sees(region of the point, kind)` is true.
    """
    p = spread(points.where(on_globe(F.col("lat"), F.col("lon"))).distinct(), "lon", "lat")
    absent = {n: F.lit(v) for n, v in (("_half", 0.0), ("_kind", 0)) if n not in spots.columns}
    spots = durable(spots.withColumns(absent) if absent else spots)  # read for the depth and once per level
    levels = levels or _depth(spots.count())
    keys = [f"_k{i}" for i in range(len(levels))]
    for key, size in zip(keys, levels):
        spots = spots.withColumn(key, _tree_key(F.col("_slon"), F.col("_slat"), size))
    spots = spots.withColumn(keys[0], F.col("_kind").cast("long") * KIND + F.col(keys[0]))

    def children(level: int) -> DataFrame:
        cells = spots.groupBy(*keys[: level + 1]).agg(F.min(F.struct("_slon", "_slat")).alias("_rep"), F.max("_half").alias("_s"))
        clon, clat = _tree_center(F.col(keys[level]) % KIND, levels[level])
        cells = cells.withColumns({"_clon": clon, "_clat": clat}).withColumns({"_c": _unit("_clon", "_clat"), "_r": _unit("_rep._slon", "_rep._slat")})
        member = F.struct(F.col(keys[level]).alias("key"), F.col("_c").alias("c"), F.col("_r").alias("r"), F.col("_s").alias("s"))
        return cells.groupBy(*keys[:level]).agg(F.collect_list(member).alias("_cells"))

    def bounded(size: float) -> Column:
        inner = geo.KM_PER_DEGREE * size * 0.7072
        # planar distances occur inside a region only, so far pairs and points outside the regions have the narrow margin
        reach = f"named_struct('key', m.key, 'c', {_arc('m.c')} - {inner}D - m.s, 'r', {_arc('m.r')}, 's', m.s)"
        margin = f"CASE WHEN _inside AND b.%s < {REGION_KM}D THEN {geo.MARGIN}D ELSE {SPHERE}D END"
        low, high = f"b.c / ({margin % 'c'}) - 0.001D", f"b.r * ({margin % 'r'}) + b.s + 0.001D"
        return F.expr(f"transform(transform(_cells, m -> {reach}), b -> named_struct('key', b.key, 'low', {low}, 'high', {high}))")

    here = Window.partitionBy("lon", "lat")
    own = ["_ux", "_uy", "_uz", "_inside"]  # plain columns: struct fields would be recomputed per cell
    state = p.withColumns({n: F.expr(e) for n, e in zip(own, _axes("lon", "lat"))}).withColumn("_region", geo.region("lon", "lat"))
    state = state.withColumn("_inside", F.col("_region").isNotNull()).withColumn("_cells", children(0).scalar())
    if sees:
        state = state.withColumn("_cells", F.filter("_cells", lambda m: sees(F.col("_region"), F.floor(m["key"] / F.lit(KIND)))))
    for level, size in enumerate(levels):
        if level:
            state = state.join(exchanged(children(level)), keys[:level])
        state = state.withColumn("_cells", bounded(size)).withColumn("_best", F.expr("array_min(_cells.high)"))
        if level:
            state = state.withColumn("_best", F.min("_best").over(here))
        alive = F.expr("filter(_cells, c -> c.low <= _best)")
        state = state.select("lon", "lat", *own, *keys[:level], F.explode(alive).alias("_cell"))
        state = state.select("lon", "lat", *own, *keys[:level], F.col("_cell.key").alias(keys[level]))
    pairs = exact(state.join(exchanged(spots), keys))
    return pairs.groupBy("lon", "lat").agg(F.min(F.struct(F.col("_d").alias("d"), F.col("_sid").alias("id"))).alias("_hit"))


def nearest_site(queries: DataFrame, sites: DataFrame, id_col: str) -> DataFrame:
    """Closest site per query row; null when there are no sites."""
    hits = nearest(queries, sites, lon="longitude", lat="latitude")
    located = queries.select(id_col, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return located.join(hits, ["lon", "lat"], "left").select(id_col, "nearest_site_id", "distance_km")


def cell_totals(df: DataFrame, value_cols: list[str], cell_col: str, agg: str = "sum") -> DataFrame:
    """One row per cell with the named aggregate of each value; rows without a cell are left out."""
    allowed = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median}
    if agg not in allowed:
        raise ValueError(f"Unknown aggregate '{agg}'; expected one of {sorted(allowed)}")
    return df.where(F.col(cell_col).isNotNull()).groupBy(cell_col).agg(*[allowed[agg](c).alias(c) for c in value_cols])
