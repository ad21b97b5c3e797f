"""Environmental context from polygon layers given as edge and cell tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.fixed_values import REGIONS
from strikehaz.functions import geo
from strikehaz.operators.spatial import branch_and_bound, exchanged, spread, within_radius
from strikehaz.schemas import ENVIRONMENT
from strikehaz.session import durable


def _along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Position (0 to 1) on a segment of its point nearest to p, in a plane."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - ax) * dx + (py - ay) * dy) / F.greatest(length, F.lit(1e-12))).otherwise(0.0)
    return F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))


PLANE_PIECE_KM = 10.0  # longest piece of an edge in the plane of its region
FREE_PIECE_KM = 200.0  # longest piece of an edge in longitude and latitude


def _side(kind_region: Column, flat: bool) -> Column:
    """Number of a kind of pieces: 0 for edges without a common region, else odd in the plane of a region and even outside it."""
    known = [F.when(kind_region == name, 2 * i + (1 if flat else 2)) for i, name in enumerate(REGIONS)]
    return F.coalesce(*known, F.lit(0))


def _sees(region: Column, kind: Column) -> Column:
    """Points of a region meet its edges in the plane; all others meet them in longitude and latitude."""
    seen = kind == 0
    for i, name in enumerate(REGIONS):
        here = F.coalesce(region == name, F.lit(False))
        seen = seen | ((kind == 2 * i + 1) & here) | ((kind == 2 * i + 2) & ~here)
    return seen


def edge_pieces(edges: DataFrame) -> DataFrame:
    """Pieces of bounded length with their anchor (_slon, _slat), half length `_half` and `_kind`, as the search wants them.

    An edge with both ends in one region is cut twice: along its straight line in the plane of the region, for
    points of that region, and along its line in longitude and latitude for all others.  A piece in the plane
    keeps its projected ends (ax, ay)-(bx, by), any other its ends lon1, lat1, lon2, lat2.  Repeated edges count once; edges that lack a
    coordinate have no pieces.
    """
    c = F.col
    ends = ("lon1", "lat1", "lon2", "lat2")
    known = edges.select(*[c(n).cast("double").alias(n) for n in ends]).dropna().distinct()
    known = known.withColumns({"_a": geo.placed("lon1", "lat1"), "_b": geo.placed("lon2", "lat2")})
    shared = F.when(c("_a.region") == c("_b.region"), c("_a.region"))
    sides = known.withColumn("_in", shared).withColumn("_flat", F.explode(F.when(
        shared.isNotNull(), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))))
    # a line of constant slope is at most as long as its longitudes measured where it is nearest to the equator
    nearest = F.when(c("lat1") * c("lat2") <= 0, 0.0).otherwise(F.least(F.abs("lat1"), F.abs("lat2")))
    free = F.hypot(c("lat2") - c("lat1"), (c("lon2") - c("lon1")) * F.cos(F.radians(nearest))) * geo.KM_PER_DEGREE
    flat = F.hypot(c("_b.x") - c("_a.x"), c("_b.y") - c("_a.y")) / 1000
    sides = sides.withColumn("_km", F.when(c("_flat"), flat).otherwise(free))
    sides = sides.withColumn("_n", F.greatest(F.ceil(c("_km") / F.when(c("_flat"), PLANE_PIECE_KM).otherwise(FREE_PIECE_KM)), F.lit(1)))
    cut = sides.withColumn("_i", F.explode(F.sequence(F.lit(1), c("_n")))).withColumns({"_t0": (c("_i") - 1) / c("_n"), "_t1": c("_i") / c("_n")})

    def at(first: Column, last: Column, t: Column) -> Column:
        return first + (last - first) * t

    out = {}
    for end, t in (("a", c("_t0")), ("b", c("_t1")), ("m", (c("_t0") + c("_t1")) / 2)):
        out |= {f"{end}x": at(c("_a.x"), c("_b.x"), t), f"{end}y": at(c("_a.y"), c("_b.y"), t)}
        out |= {f"{end}lon": at(c("lon1"), c("lon2"), t), f"{end}lat": at(c("lat1"), c("lat2"), t)}
    cut = cut.withColumns(out).withColumn("_m", geo.lonlat(c("_in"), c("mx"), c("my")))
    return cut.select(
        F.when(c("_flat"), c("_m.lon")).otherwise(c("mlon")).alias("_slon"), F.when(c("_flat"), c("_m.lat")).otherwise(c("mlat")).alias("_slat"),
        F.lit(0).alias("_sid"), (c("_km") / c("_n") * (geo.MARGIN / 2)).alias("_half"),
        F.when(c("_flat"), _side(c("_in"), True)).otherwise(_side(c("_in"), False)).alias("_kind"), c("_flat").alias("flat"), "ax", "ay", "bx", "by",
        c("alon").alias("lon1"), c("alat").alias("lat1"), c("blon").alias("lon2"), c("blat").alias("lat2"))


def with_edge_distance_km(pairs: DataFrame) -> DataFrame:
    """Adds `_d`, the distance of (lon, lat) to a piece of `edge_pieces`.

    Planar inside one region, else geodesic to the point of the piece nearest in a local plane.
    """
    c = F.col
    placed = pairs.withColumn("_p", geo.placed("lon", "lat"))
    p, shrink = c("_p"), F.cos(F.radians("lat"))
    t = F.when(c("flat"), _along(p["x"], p["y"], c("ax"), c("ay"), c("bx"), c("by"))).otherwise(
        _along(c("lon") * shrink, c("lat"), c("lon1") * shrink, c("lat1"), c("lon2") * shrink, c("lat2"))
    )
    planar = F.hypot(p["x"] - (c("ax") + (c("bx") - c("ax")) * c("_t")), p["y"] - (c("ay") + (c("by") - c("ay")) * c("_t"))) / 1000
    free = geo.geodesic_km("lon", "lat", "(lon1 + (lon2 - lon1) * _t)", "(lat1 + (lat2 - lat1) * _t)")
    return placed.withColumn("_t", t).withColumn("_d", F.when(c("flat"), planar).otherwise(free))


def nearest_edge_distance(points: DataFrame, edges: DataFrame, id_col: str) -> DataFrame:
    """Kilometres from each point to the nearest polygon or line edge, at any distance.

    `edges`: lon1, lat1, lon2, lat2, one row per edge.  Edges are cut into pieces of bounded length, so a long
    edge widens no bound beyond half a piece, and only those of the cells it crosses.  Points
    without usable coordinates, and all points of an empty layer, have null.
    """
    located = points.select(id_col, F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"))
    hits = branch_and_bound(located.select("lon", "lat"), edge_pieces(edges), with_edge_distance_km, sees=_sees)
    return located.join(hits, ["lon", "lat"], "left").select(id_col, F.col("_hit.d").alias("distance_km"))


def area_within(points: DataFrame, cells: DataFrame, id_col: str, radius_km: float) -> DataFrame:
    """Square kilometres of a gridded layer inside the buffer; 0.0 for none, null outside the regions.

    `cells`: longitude, latitude (cell centre), area_km2.  A cell counts whole
    when its centre is in range, so the error is bounded by the cells on the rim.
    """
    spots = points.select(F.col("longitude").alias("lon"), F.col("latitude").alias("lat")).distinct()
    centres = cells.groupBy("longitude", "latitude").agg(F.sum("area_km2").alias("area_km2"))
    areas = within_radius(spots, centres, radius_km).groupBy("lon", "lat").agg(
        F.sum("area_km2").alias("area")
    )
    located = points.select(id_col, F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return located.join(areas, ["lon", "lat"], "left").select(
        id_col, F.when(geo.region("lon", "lat").isNotNull(), F.coalesce("area", F.lit(0.0))).alias("area_km2")
    )


def polygon_edges(rings: DataFrame) -> DataFrame:
    """Directed edges (polygon_id, lon1, lat1, lon2, lat2) of rings (polygon_id, ring, hole).

    `ring` is an array of struct(lon, lat) in either direction, closed or not.  Outer rings come out
    counter-clockwise and holes clockwise, which is what `clipped_area` asks for; rings
    with fewer than three corners have no area and give no edges.
    """
    ring = F.col("ring")
    open_ended = F.get(ring, F.lit(0)) != F.element_at(ring, -1)
    closed = F.when(open_ended, F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    steps = F.transform(F.sequence(F.lit(0), F.size("_c") - 2), lambda i: F.struct(F.get("_c", i).alias("a"), F.get("_c", i + 1).alias("b")))
    doubled = F.aggregate("_steps", F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    turned = (F.col("_doubled") < 0) != F.coalesce(F.col("hole"), F.lit(False))
    rows = (
        rings.where(F.size("ring") >= 3).select("polygon_id", "hole", closed.alias("_c")).withColumn("_steps", steps)
        .withColumn("_doubled", doubled).select("polygon_id", turned.alias("_turned"), F.explode("_steps").alias("_e"))
    )
    first, second = F.when(F.col("_turned"), F.col("_e.b")).otherwise(F.col("_e.a")), F.when(F.col("_turned"), F.col("_e.a")).otherwise(F.col("_e.b"))
    return rows.select("polygon_id", first.alias("_a"), second.alias("_b")).select(
        "polygon_id", F.col("_a.lon").alias("lon1"), F.col("_a.lat").alias("lat1"), F.col("_b.lon").alias("lon2"), F.col("_b.lat").alias("lat2"))


def with_disc_part(edges: DataFrame, radius: float) -> DataFrame:
    """Adds `part`: the signed area that the triangle (origin, a, b) of an edge (ax, ay)-(bx, by) shares with the disc around the origin.

    Summed over the directed edges of a polygon this is the area of polygon and disc together: the
    stretch of the edge inside the disc bounds a triangle, what lies before and behind it a sector.
    """
    c, square = F.col, radius * radius
    steps = edges.withColumns({"_dx": c("bx") - c("ax"), "_dy": c("by") - c("ay")})
    steps = steps.withColumns({
        "_along": c("ax") * c("_dx") + c("ay") * c("_dy"), "_length": F.greatest(c("_dx") * c("_dx") + c("_dy") * c("_dy"), F.lit(1e-12))})
    outside = c("ax") * c("ax") + c("ay") * c("ay") - square
    steps = steps.withColumn("_room", F.sqrt(F.greatest(c("_along") * c("_along") - c("_length") * outside, F.lit(0.0))))
    clamped = lambda t: F.greatest(F.least(t, F.lit(1.0)), F.lit(0.0))
    steps = steps.withColumns({"_t0": clamped((-c("_along") - c("_room")) / c("_length")), "_t1": clamped((-c("_along") + c("_room")) / c("_length"))})
    steps = steps.withColumns({
        "_ex": c("ax") + c("_t0") * c("_dx"), "_ey": c("ay") + c("_t0") * c("_dy"),
        "_lx": c("ax") + c("_t1") * c("_dx"), "_ly": c("ay") + c("_t1") * c("_dy")})

    def turn(ux: str, uy: str, vx: str, vy: str) -> Column:
        return F.atan2(c(ux) * c(vy) - c(uy) * c(vx), c(ux) * c(vx) + c(uy) * c(vy))

    sectors = turn("ax", "ay", "_ex", "_ey") + turn("_lx", "_ly", "bx", "by")
    part = (sectors * square + (c("_t1") - c("_t0")) * (c("ax") * c("by") - c("ay") * c("bx"))) / 2
    return steps.withColumn("part", part).select(*edges.columns, "part")


WIDEST = 2e7  # metres; a polygon wider than this in the plane of a region has no usable image there


def clipped_area(points: DataFrame, edges: DataFrame, id_col: str, radius_km: float) -> DataFrame:
    """Square kilometres of polygons inside the buffer, exact; 0.0 for none, null outside the regions.

    `edges`: polygon_id, lon1, lat1, lon2, lat2 as `polygon_edges` gives them; straight in the plane of
    the point's region.  Overlapping polygons count once each.  Polygons with an edge that lacks a coordinate, or without
    an id, are left out whole; repeated points each get their row.

    A polygon is held by its box, widened by the radius, in the nested grid whose cells are as wide as
    the box: four cells at most, however large it is.  A distinct point asks one cell of each
    grid.  Only polygons whose box holds the point meet it, all their edges with it, for a polygon may enclose the disc.
    """
    radius = radius_km * 1000.0
    span = 2 * radius
    known = F.col("lon1") + F.col("lat1") + F.col("lon2") + F.col("lat2")
    sides = spread(edges.where(F.col("polygon_id").isNotNull()), "polygon_id", "lon1", "lat1").select(
        "polygon_id", "lon1", "lat1", "lon2", "lat2", F.explode(F.array(*[F.lit(r) for r in REGIONS])).alias("region"))
    sides = sides.select(
        "polygon_id", "region", known.isNotNull().alias("known"), geo.planar("region", "lon1", "lat1").alias("a"), geo.planar("region", "lon2", "lat2").alias("b"))
    sides = durable(sides)  # projected once, read for the boxes and for the pairs
    boxes = sides.groupBy("polygon_id", "region").agg(
        F.bool_and("known").alias("known"), (F.min("a.x") - radius).alias("west"), (F.max("a.x") + radius).alias("east"),
        (F.min("a.y") - radius).alias("south"), (F.max("a.y") + radius).alias("north"))
    wide = F.greatest(F.col("east") - F.col("west"), F.col("north") - F.col("south"))
    boxes = boxes.where(F.col("known") & (wide <= WIDEST + span)).withColumn("level", F.greatest(F.ceil(F.log2(wide / span)), F.lit(0)).cast("int"))
    size = F.lit(span) * F.pow(F.lit(2.0), F.col("level"))

    def cells(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size)))

    held = boxes.withColumn("cx", cells("west", "east")).withColumn("cy", cells("south", "north"))
    deepest = math.ceil(math.log2((WIDEST + span) / span)) + 1
    spots = points.select(F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat")).distinct()
    spots = durable(spots.select("lon", "lat", geo.placed("lon", "lat").alias("p")))
    asked = spots.where("p.region IS NOT NULL").select(
        "lon", "lat", F.col("p.region").alias("region"), F.col("p.x").alias("px"), F.col("p.y").alias("py"),
        F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("level"))
    asked = asked.withColumn("cx", F.floor(F.col("px") / size)).withColumn("cy", F.floor(F.col("py") / size))
    pairs = asked.join(exchanged(held), ["region", "level", "cx", "cy"]).where("px BETWEEN west AND east AND py BETWEEN south AND north").select(
        "lon", "lat", "px", "py", "polygon_id", "region")
    moved = pairs.join(exchanged(sides), ["polygon_id", "region"]).select(
        "lon", "lat", (F.col("a.x") - F.col("px")).alias("ax"), (F.col("a.y") - F.col("py")).alias("ay"),
        (F.col("b.x") - F.col("px")).alias("bx"), (F.col("b.y") - F.col("py")).alias("by"))
    areas = with_disc_part(moved, radius).groupBy("lon", "lat").agg((F.sum("part") / 1e6).alias("area"))
    located = points.select(id_col, F.col("longitude").cast("double").alias("lon"), F.col("latitude").cast("double").alias("lat"))
    return located.join(areas, ["lon", "lat"], "left").select(
        id_col, F.when(geo.region("lon", "lat").isNotNull(), F.coalesce("area", F.lit(0.0))).alias("area_km2"))


def environment(
    airports: DataFrame, id_col: str = "airport_id", *, water_edges: DataFrame | None = None, water: DataFrame | None = None,
    wetland: DataFrame | None = None, agriculture: DataFrame | None = None, urban: DataFrame | None = None,
    landfill_edges: DataFrame | None = None,
) -> DataFrame:
    """Environmental columns from the layers that were given; the others stay null.

    Area layers are polygon edges (see `clipped_area`) or gridded cells (see `area_within`).
    habitat_data_available is true only when at least one real layer was used.
    """
    out = airports.select(id_col)
    for layer, name in ((water_edges, "distance_to_water_km"), (landfill_edges, "landfill_distance_km")):
        if layer is not None:
            out = out.join(nearest_edge_distance(airports, layer, id_col).withColumnRenamed("distance_km", name), id_col)
    for layer, name, radius in (
        (water, "water_area_within_5km", 5.0), (wetland, "wetland_area_within_10km", 10.0),
        (agriculture, "agricultural_area_within_10km", 10.0), (urban, "urban_area_within_10km", 10.0),
    ):
        if layer is not None:
            measure = clipped_area if "polygon_id" in layer.columns else area_within
            out = out.join(measure(airports, layer, id_col, radius).withColumnRenamed("area_km2", name), id_col)
    used = any(layer is not None for layer in (water_edges, water, wetland, agriculture, urban, landfill_edges))
    have = set(out.columns)
    absent = {f.name: F.lit(None).cast(f.dataType) for f in ENVIRONMENT.fields if f.name not in have}
    return out.withColumns(absent).withColumn("habitat_data_available", F.lit(used)).select(id_col, *ENVIRONMENT.names)


def abundance_placeholder(requests: DataFrame, source: str = "modelled_abundance") -> DataFrame:
    """Bird columns of an abundance source that was not loaded: nulls and bird_data_available = false."""
    empty = {
        "estimated_abundance": "double", "relative_abundance_index": "double", "seasonal_presence": "string",
        "migration_intensity": "double", "observation_effort_hours": "double",
        "distance_from_bird_observation_to_airport_km": "double",
    }
    return requests.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()}).withColumns({
        "bird_data_source": F.lit(source), "bird_data_resolution": F.lit("weekly_3km_modeled"),
        "bird_data_available": F.lit(False),
    })
