"""Distance queries: pair distances, links, nearest site, radii, weighted totals, cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikehaz.functions import geo
from strikehaz.operators import habitat, layers, quality, spatial
from strikehaz.plans import geosql
from strikehaz.plans.registry import query
from strikehaz.plans.views import table, view, with_views
from strikehaz.session import durable

PLACED = (
    with_views("airports", "sites") + ", "
    + geosql.placed_cte("a", "v_airports", "longitude", "latitude", "airport_id") + ", "
    + geosql.placed_cte("s", "v_sites", "longitude", "latitude", "site_id")
)
PAIRS = PLACED + ", " + geosql.pair_distance_ctes("a", "s")


@query("pair_distance", PLACED + """,
m AS (SELECT DISTINCT o_custkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey), am AS (SELECT m.l_suppkey, a.* FROM m JOIN a ON a.airport_id = m.o_custkey),
""" + geosql.pair_distance_ctes("am", "s", on="l.l_suppkey = r.site_id") + """
SELECT airport_id, site_id, round(distance_km, 3) AS distance_km, CASE WHEN reg1 = reg2 THEN 'projected' ELSE 'geodesic' END AS method,
  CASE WHEN reg1 = reg2 THEN CASE reg1 WHEN 'conus' THEN 'EPSG:5070' ELSE 'EPSG:3035' END END AS crs FROM pairs""")
def pair_distance(spark, sf_dir):
    """Distance, method and CRS of every airport-site pair that occurs in the orders."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
    airports = view(spark, sf_dir, "airports").select("airport_id", geo.placed("longitude", "latitude").alias("_a"))
    sites = view(spark, sf_dir, "sites").select("site_id", geo.placed("longitude", "latitude").alias("_s"))
    pairs = met.join(airports, met.o_custkey == airports.airport_id).join(sites, met.l_suppkey == sites.site_id)
    return pairs.select(
        "airport_id", "site_id", F.round(geo.distance_km("_a", "_s"), 3).alias("distance_km"),
        geo.distance_method("_a", "_s").alias("method"), geo.distance_crs("_a", "_s").alias("crs"),
    )


@query("airport_site_links", PAIRS + " SELECT airport_id, site_id, round(distance_km, 6) AS distance_km FROM pairs WHERE distance_km <= 250")
def airport_site_links(spark, sf_dir):
    """Every airport-site pair within 250 km."""
    links = spatial.site_links(view(spark, sf_dir, "airports"), view(spark, sf_dir, "sites"))
    return links.withColumn("distance_km", F.floor(F.col("distance_km") * 1e6 + 0.5) / 1e6)  # plain arithmetic: F.round makes a decimal of each pair


@query("linked_sites", PAIRS + " SELECT site_id, site_name FROM v_sites WHERE site_id IN (SELECT site_id FROM pairs WHERE distance_km <= 100)")
def linked_sites(spark, sf_dir):
    """Sites within 100 km of some airport."""
    sites = view(spark, sf_dir, "sites")
    return quality.sites_with_counts_in_range(sites, spatial.site_links(view(spark, sf_dir, "airports"), sites, 100.0)).select("site_id", "site_name")


@query("nearest_site", PAIRS + """ SELECT airport_id, min_by(site_id, (distance_km, site_id)) AS nearest_site_id, round(min(distance_km), 3) AS distance_km FROM pairs GROUP BY 1""")
def nearest_site(spark, sf_dir):
    """Closest site of every airport, at any distance."""
    return spatial.nearest_site(view(spark, sf_dir, "airports"), view(spark, sf_dir, "sites"), "airport_id").withColumn("distance_km", F.round("distance_km", 3))


@query("sites_within_radii", PAIRS + """ SELECT airport_id, count(*) FILTER (WHERE distance_km <= 50) AS number_of_sites_within_50_km,
  count(*) FILTER (WHERE distance_km <= 100) AS number_of_sites_within_100_km, count(*) FILTER (WHERE distance_km <= 250) AS number_of_sites_within_250_km FROM pairs GROUP BY 1""")
def sites_within_radii(spark, sf_dir):
    """Sites within 50, 100 and 250 km, zero where there is none."""
    return spatial.sites_within_radii(view(spark, sf_dir, "airports"), view(spark, sf_dir, "sites"), "airport_id")


@query("distance_weighted_total", with_views("airports", "sites", "counts") + ", "
       + geosql.placed_cte("a", "v_airports", "longitude", "latitude", "airport_id") + ", "
       + geosql.placed_cte("s", "v_sites", "longitude", "latitude", "site_id") + ", " + geosql.pair_distance_ctes("a", "s") + """,
b AS (SELECT site_id, CASE WHEN min("count") >= 0 THEN sum("count") END AS v FROM v_counts GROUP BY 1)
SELECT airport_id, CASE WHEN count(distance_km) > 0 THEN round(coalesce(sum(v * pow(5e-1, distance_km / 50)), 0), 5) END AS weighted_total, count(distance_km) AS n_sites_used,
  round(coalesce(sum(pow(5e-1, distance_km / 50)), 0), 6) AS total_weight
FROM v_airports LEFT JOIN (SELECT airport_id, site_id, distance_km FROM pairs WHERE distance_km <= 250) USING (airport_id) LEFT JOIN b USING (site_id) GROUP BY 1""")
def distance_weighted_total(spark, sf_dir):
    """Site totals weighted by half-life decay around every airport."""
    # a site with a negative count has no usable total: its value is null, its weight still counts
    total = F.when(F.min("count") >= 0, F.sum("count"))
    totals = view(spark, sf_dir, "counts").groupBy("site_id").agg(total.alias("value"))
    values = view(spark, sf_dir, "sites").join(totals, "site_id", "left")
    out = spatial.distance_weighted_total(view(spark, sf_dir, "airports"), values, "airport_id")
    return out.withColumns({"weighted_total": F.round("weighted_total", 5), "total_weight": F.round("total_weight", 6)})


def _cell_sql(lat: str, lon: str, rows: int, cols: int, r: int) -> str:
    return (
        f"concat('r{r}_', CAST(least(CAST(floor((sin(radians({lat})) + 1) / 2 * {rows}) AS BIGINT), {rows - 1}) AS VARCHAR), '_', "
        f"CAST(CAST(floor(({lon} + 180) / 360 * {cols}) AS BIGINT) % {cols} AS VARCHAR))"
    )


@query("grid_cells", with_views("airports") + f""" SELECT airport_id, {_cell_sql('latitude', 'longitude', 1024, 2048, 5)} AS cell_r5, {_cell_sql('latitude', 'longitude', 6144, 16384, 7)} AS cell_r7,
  round(degrees(asin((CAST(floor((sin(radians(latitude)) + 1) / 2 * 1024) AS BIGINT) + 5e-1) / 1024 * 2 - 1)), 6) AS center_lat FROM v_airports""")
def grid_cells(spark, sf_dir):
    """Cell keys at both resolutions and a cell centre."""
    cells = view(spark, sf_dir, "airports").select("airport_id", geo.cell("latitude", "longitude", 5).alias("cell_r5"), geo.cell("latitude", "longitude", 7).alias("cell_r7"))
    return cells.select("*", F.round(geo.cell_center("cell_r5")[0], 6).alias("center_lat"))


@query("cell_totals", with_views("counts", "sites") + f""" SELECT {_cell_sql('latitude', 'longitude', 1024, 2048, 5)} AS cell_r5, CAST(sum("count") AS BIGINT) AS "count"
  FROM v_counts JOIN v_sites USING (site_id) GROUP BY 1""")
def cell_totals(spark, sf_dir):
    """Counts summed per cell, rows without a place left out."""
    per_site = view(spark, sf_dir, "counts").groupBy("site_id").agg(F.sum("count").alias("count"))
    located = per_site.join(view(spark, sf_dir, "sites"), "site_id", "left")
    return spatial.cell_totals(located.withColumn("cell_r5", geo.cell("latitude", "longitude", 5)), ["count"], "cell_r5")


def _center_sql(cell: str, i: int) -> str:
    lat = f"degrees(asin((CAST(split_part({cell}, '_', 2) AS DOUBLE) + 5e-1) / 1024 * 2 - 1))"
    lon = f"((CAST(split_part({cell}, '_', 3) AS DOUBLE) + 5e-1) / 2048 * 360 - 180)"
    return f"{lat} AS lat{i}, {lon} AS lon{i}"


@query("cell_distances", with_views("airports", "sites") + f""", ca AS (SELECT airport_id, {_cell_sql('latitude', 'longitude', 1024, 2048, 5)} AS cell_a FROM v_airports),
cb AS (SELECT site_id, {_cell_sql('latitude', 'longitude', 1024, 2048, 5)} AS cell_b FROM v_sites),
m AS (SELECT DISTINCT cell_a, cell_b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN ca ON airport_id = o_custkey JOIN cb ON site_id = l_suppkey),
e AS (SELECT cell_a, cell_b, {_center_sql('cell_a', 1)}, {_center_sql('cell_b', 2)} FROM m), {geosql.geodesic_ctes('e', 'g')}
SELECT cell_a, cell_b, round(geodesic_km, 3) AS distance_km FROM g""")
def cell_distances(spark, sf_dir):
    """Geodesic kilometres between the cells of each order's airport and supplier site."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    a = view(spark, sf_dir, "airports").select(F.col("airport_id").alias("o_custkey"), geo.cell("latitude", "longitude").alias("cell_a"))
    s = view(spark, sf_dir, "sites").select(F.col("site_id").alias("l_suppkey"), geo.cell("latitude", "longitude").alias("cell_b"))
    met = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(a, "o_custkey").join(s, "l_suppkey")
    cells = met.select("cell_a", "cell_b").distinct()
    return cells.select("cell_a", "cell_b", F.round(geo.cell_distance_km("cell_a", "cell_b"), 3).alias("distance_km"))


@query("buffer_polygons", PLACED + """ SELECT airport_id, reg IS NOT NULL AS has_polygon, CASE WHEN reg IS NULL THEN 'outside supported CRS regions (conus, europe)' END AS buffer_unavailable_reason,
  CASE WHEN reg IS NOT NULL THEN 65 END AS n_corners, 50e0 AS buffer_radius_km FROM a""")
def buffer_polygons(spark, sf_dir):
    """50 km planar buffers, null with a reason outside the regions."""
    rings = layers.buffer_layer(view(spark, sf_dir, "airports"), 50.0)
    return rings.select(
        "airport_id", F.col("geometry_wkt").startswith("POLYGON((").alias("_w"), "buffer_unavailable_reason",
        F.when(F.col("ring").isNotNull(), F.size("ring")).alias("n_corners"), "buffer_radius_km",
    ).select("airport_id", F.coalesce("_w", F.lit(False)).alias("has_polygon"), "buffer_unavailable_reason", "n_corners", "buffer_radius_km")


@query("buffer_corners", PLACED + """ SELECT airport_id, CAST(i AS INT) AS corner, round(50000 * cos(2 * pi() * (i % 64) / 64)) + 0e0 AS east_m, round(50000 * sin(2 * pi() * (i % 64) / 64)) + 0e0 AS north_m
FROM a CROSS JOIN range(65) t(i) WHERE reg IS NOT NULL""")
def buffer_corners(spark, sf_dir):
    """Every corner of the 50 km buffers, projected back: metres east and north of its airport in the plane of the region."""
    rings = layers.buffer_layer(view(spark, sf_dir, "airports"), 50.0).select("airport_id", "ring", geo.placed("longitude", "latitude").alias("p"))
    rings = durable(rings)  # else each corner is worked out anew from its airport's coordinates
    corners = rings.select("airport_id", "p", F.posexplode("ring").alias("corner", "c")).select("airport_id", "p", "corner", "c.lon", "c.lat")
    corners = corners.withColumn("region", F.col("p.region")).withColumn("back", geo.planar("region", "lon", "lat"))
    return corners.select("airport_id", "corner", *[(F.round(F.col(f"back.{a}") - F.col(f"p.{a}")) + 0.0).alias(n) for a, n in (("x", "east_m"), ("y", "north_m"))])


def habitat_cells(spark, sf_dir):
    """A gridded layer: one patch per part, its area following the part size."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (-125 + (k * 29 % 590) / 10).alias("longitude"), (24 + (k * 43 % 260) / 10).alias("latitude"), (F.col("p_size") * 1.0).alias("area_km2")
    )


@query("habitat_area", PLACED + ", h AS (SELECT p_partkey, p_size * 1e0 AS area, -125 + ((p_partkey * 29) % 590) / 10e0 AS hlon, 24 + ((p_partkey * 43) % 260) / 10e0 AS hlat FROM part), "
       + geosql.placed_cte("p", "h", "hlon", "hlat", "p_partkey, area") + """,
n AS (SELECT a.airport_id, sum(area) AS area FROM a JOIN p ON a.reg = p.reg AND sqrt(pow(a.x - p.x, 2) + pow(a.y - p.y, 2)) / 1000 <= 100 GROUP BY 1)
SELECT airport_id, CASE WHEN reg IS NOT NULL THEN round(coalesce(area, 0), 6) END AS area_km2 FROM a LEFT JOIN n USING (airport_id)""")
def habitat_area(spark, sf_dir):
    """Habitat area around every airport from a gridded layer; 0 for none, null outside the regions."""
    out = habitat.area_within(view(spark, sf_dir, "airports"), habitat_cells(spark, sf_dir), "airport_id", 100.0)
    return out.withColumn("area_km2", F.round("area_km2", 6))


_EDGE_DISTANCE = PLACED + """, h AS (SELECT DISTINCT -125 + ((p_partkey * 29) % 590) / 10e0 AS hlon, 24 + ((p_partkey * 43) % 260) / 10e0 AS hlat, p_size FROM part),
h2 AS (SELECT hlon AS lon_a, hlat AS lat_a, least(hlon + p_size / 100e0, -66) AS lon_b, least(hlat + p_size / 50e0, 50) AS lat_b FROM h), """ + (
    geosql.placed_cte("pa", "h2", "lon_a", "lat_a", "lon_a, lat_a, lon_b, lat_b") + ", "
    + geosql.placed_cte("pb", "h2", "lon_b", "lat_b", "lon_a, lat_a, lon_b, lat_b") + """,
e AS (SELECT lon_a, lat_a, lon_b, lat_b, pa.x AS ax, pa.y AS ay, pb.x AS bx, pb.y AS b_y FROM pa JOIN pb USING (lon_a, lat_a, lon_b, lat_b)),
d AS (SELECT airport_id, ax, ay, bx, b_y, a.x AS px, a.y AS py, CASE WHEN pow(bx - ax, 2) + pow(b_y - ay, 2) > 0 THEN
  greatest(least(((a.x - ax) * (bx - ax) + (a.y - ay) * (b_y - ay)) / (pow(bx - ax, 2) + pow(b_y - ay, 2)), 1), 0) ELSE 0 END AS t FROM a CROSS JOIN e WHERE a.reg = 'conus'),
f0 AS (SELECT airport_id, lon, lat, lon_a, lat_a, lon_b, lat_b, cos(radians(lat)) AS shrink FROM a CROSS JOIN e WHERE a.reg IS DISTINCT FROM 'conus'),
f1 AS (SELECT *, (lon_b - lon_a) * shrink AS dx, lat_b - lat_a AS dy FROM f0),
f2 AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(least((((lon - lon_a) * shrink) * dx + (lat - lat_a) * dy) / (dx * dx + dy * dy), 1), 0) ELSE 0 END AS t FROM f1),
f3 AS (SELECT airport_id, lon AS lon1, lat AS lat1, lon_a + (lon_b - lon_a) * t AS lon2, lat_a + (lat_b - lat_a) * t AS lat2 FROM f2), """
    + geosql.geodesic_ctes("f3", "f") + """,
water AS (SELECT airport_id, min(sqrt(pow(px - (ax + (bx - ax) * t), 2) + pow(py - (ay + (b_y - ay) * t), 2))) / 1000 AS distance_km FROM d GROUP BY 1
  UNION ALL SELECT airport_id, min(geodesic_km) FROM f GROUP BY 1)""")


def habitat_edges(spark, sf_dir):
    """A linear layer: one edge per part, its length following the part size."""
    k, size = F.col("p_partkey"), F.col("p_size")
    lon, lat = -125 + (k * 29 % 590) / 10, 24 + (k * 43 % 260) / 10
    return table(spark, sf_dir, "part").select(
        lon.alias("lon1"), lat.alias("lat1"), F.least(lon + size / 100, F.lit(-66.0)).alias("lon2"), F.least(lat + size / 50, F.lit(50.0)).alias("lat2")
    )


@query("habitat_distance", _EDGE_DISTANCE + " SELECT airport_id, round(distance_km, 3) AS distance_km FROM water")
def habitat_distance(spark, sf_dir):
    """Kilometres to the nearest edge of a linear layer for every airport, inside the layer's region or not."""
    out = habitat.nearest_edge_distance(view(spark, sf_dir, "airports"), habitat_edges(spark, sf_dir), "airport_id")
    return out.withColumn("distance_km", F.round("distance_km", 3))


def habitat_polygons(spark, sf_dir):
    """A polygon layer: one kite per part as wide as the part is large, every fifth with a hole, every second ring clockwise."""
    k = F.col("p_partkey")
    lon, lat, wide = -125 + (k * 29 % 590) / 10, 24 + (k * 43 % 260) / 10, F.lit(0.02) + F.col("p_size") / 100
    part = table(spark, sf_dir, "part").select(
        k.alias("polygon_id"), lon.alias("x"), lat.alias("y"),
        F.explode(F.array(F.struct(wide.alias("w"), F.lit(False).alias("hole")), F.struct((wide / 2).alias("w"), F.lit(True).alias("hole")))).alias("r"))
    x, y, w = F.col("x"), F.col("y"), F.col("r.w")
    corners = [F.struct(a.alias("lon"), b.alias("lat")) for a, b in ((x - w, y), (x, y - w), (x + w, y), (x, y + w))]
    ring = F.when(F.col("polygon_id") % 2 == 0, F.array(*corners[::-1])).otherwise(F.array(*corners))
    rings = part.where(~F.col("r.hole") | (F.col("polygon_id") % 5 == 0)).select("polygon_id", F.col("r.hole").alias("hole"), ring.alias("ring"))
    return habitat.polygon_edges(rings)


def _clipped_sql(radius_km: float) -> str:
    """CTE chain that ends in clipped(airport_id, area_km2) for the airports of the polygons' region."""
    (x1, y1), (x2, y2) = geosql.albers("lon_1", "lat_1"), geosql.albers("lon_2", "lat_2")
    square = f"{(radius_km * 1000) ** 2!r}"
    return f"""
k0 AS (SELECT p_partkey, -125 + ((p_partkey * 29) % 590) / 10e0 AS x, 24 + ((p_partkey * 43) % 260) / 10e0 AS y, 2e-2 + p_size / 100e0 AS w FROM part),
k1 AS (SELECT x + u1 * w AS lon_1, y + v1 * w AS lat_1, x + u2 * w AS lon_2, y + v2 * w AS lat_2 FROM k0
    CROSS JOIN (VALUES (-1, 0, 0, -1), (0, -1, 1, 0), (1, 0, 0, 1), (0, 1, -1, 0)) AS o(u1, v1, u2, v2)
  UNION ALL SELECT x + u1 * w / 2, y + v1 * w / 2, x + u2 * w / 2, y + v2 * w / 2 FROM k0
    CROSS JOIN (VALUES (0, -1, -1, 0), (1, 0, 0, -1), (0, 1, 1, 0), (-1, 0, 0, 1)) AS o(u1, v1, u2, v2) WHERE p_partkey % 5 = 0),
k2 AS (SELECT {x1} AS x1, {y1} AS y1, {x2} AS x2, {y2} AS y2 FROM k1),
k3 AS (SELECT airport_id, x1 - x AS ax, y1 - y AS ay, x2 - x AS bx, y2 - y AS b_y FROM a CROSS JOIN k2 WHERE reg = 'conus'),
k4 AS (SELECT *, bx - ax AS dx, b_y - ay AS dy FROM k3),
k5 AS (SELECT *, ax * dx + ay * dy AS along, dx * dx + dy * dy AS len2 FROM k4),
k6 AS (SELECT *, sqrt(greatest(along * along - len2 * (ax * ax + ay * ay - {square}), 0)) AS room FROM k5),
k7 AS (SELECT *, greatest(least((-along - room) / len2, 1), 0) AS t0, greatest(least((-along + room) / len2, 1), 0) AS t1 FROM k6),
k8 AS (SELECT *, ax + t0 * dx AS ex, ay + t0 * dy AS ey, ax + t1 * dx AS lx, ay + t1 * dy AS ly FROM k7),
clipped AS (SELECT airport_id, sum(({square} * (atan2(ax * ey - ay * ex, ax * ex + ay * ey) + atan2(lx * b_y - ly * bx, lx * bx + ly * b_y))
  + (t1 - t0) * (ax * b_y - ay * bx)) / 2) / 1e6 AS area_km2 FROM k8 GROUP BY 1)"""


@query("habitat_clipped_area", PLACED + "," + _clipped_sql(100.0) + """
SELECT airport_id, CASE WHEN reg IS NOT NULL THEN abs(round(coalesce(area_km2, 0), 3)) END AS area_km2 FROM a LEFT JOIN clipped USING (airport_id)""")
def habitat_clipped_area(spark, sf_dir):
    """Exact area of polygons with holes inside the buffer of every airport."""
    out = habitat.clipped_area(view(spark, sf_dir, "airports"), habitat_polygons(spark, sf_dir), "airport_id", 100.0)
    return out.withColumn("area_km2", F.abs(F.round("area_km2", 3)))


@query("environment_layers", _EDGE_DISTANCE + "," + _clipped_sql(10.0) + """
SELECT airport_id, round(distance_km, 3) AS distance_to_water_km, CASE WHEN reg IS NOT NULL THEN abs(round(coalesce(area_km2, 0), 3)) END AS wetland_area_within_10km,
  CAST(NULL AS DOUBLE) AS urban_area_within_10km, true AS habitat_data_available FROM a LEFT JOIN water USING (airport_id) LEFT JOIN clipped USING (airport_id)""")
def environment_layers(spark, sf_dir):
    """Environmental values from a linear and a polygon layer; layers that were not given stay null."""
    made = habitat.environment(
        view(spark, sf_dir, "airports"), water_edges=habitat_edges(spark, sf_dir), wetland=habitat_polygons(spark, sf_dir))
    return made.select(
        "airport_id", F.round("distance_to_water_km", 3).alias("distance_to_water_km"),
        F.abs(F.round("wetland_area_within_10km", 3)).alias("wetland_area_within_10km"), "urban_area_within_10km", "habitat_data_available")


@query("environment_features", with_views("airports") + """
SELECT airport_id, CAST(NULL AS DOUBLE) AS distance_to_water_km, CAST(NULL AS DOUBLE) AS urban_area_within_10km, false AS habitat_data_available FROM v_airports""")
def environment_features(spark, sf_dir):
    """Without layers every environmental value is null and flagged unavailable."""
    return habitat.environment(view(spark, sf_dir, "airports")).select(
        "airport_id", "distance_to_water_km", "urban_area_within_10km", "habitat_data_available"
    )
