"""Distance, look-back and as-of joins against brute force."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strikehaz.functions import geo
from strikehaz.operators import activity, around, habitat, spatial, species, temporal, weather

START = datetime(2024, 5, 1)


def _points(n, seed, kind="world"):
    rng = random.Random(seed)
    lon = (lambda: rng.uniform(-180, 180)) if kind == "world" else (lambda: rng.choice([179.5, -179.7, rng.uniform(-180, 180)]))
    return [(i, round(lon(), 3), round(rng.choice([rng.uniform(-89.9, 89.9), rng.uniform(84, 89.9), rng.uniform(30, 40)]), 3)) for i in range(n)]


def _brute(spark, queries, sites):
    q = spark.createDataFrame(queries, "qid long, lon double, lat double").withColumn("p", geo.placed("lon", "lat"))
    s = spark.createDataFrame(sites, "site_id long, longitude double, latitude double").withColumn("q", geo.placed("longitude", "latitude"))
    return {(r.qid, r.site_id): r.d for r in q.crossJoin(s).select("qid", "site_id", geo.distance_km("p", "q").alias("d")).collect()}


@pytest.mark.parametrize("radius", [60.0, 700.0, 4000.0])
def test_grid_join_equals_all_pairs(spark, radius):
    queries, sites = _points(80, 1, "edge"), _points(120, 2, "edge")
    queries += [(900, -100.0, 40.0), (901, 10.0, 50.0)]
    sites += [(900, -100.0, 40.0), (901, -100.3, 40.2), (902, 10.4, 50.3)]
    truth = {k for k, d in _brute(spark, queries, sites).items() if d <= radius}
    q = spark.createDataFrame(queries, "qid long, lon double, lat double")
    s = spark.createDataFrame(sites, "site_id long, longitude double, latitude double")
    got = [(r.qid, r.site_id) for r in spatial.within_radius(q, s, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


@pytest.mark.parametrize("levels", [None, (10.0,), (10.0, 1.0, 0.1)])
def test_nearest_equals_all_pairs(spark, levels):
    queries, sites = _points(60, 3, "edge"), _points(150, 4, "edge")
    truth = {}
    for (q, s), d in _brute(spark, queries, sites).items():
        if q not in truth or (d, s) < truth[q]:
            truth[q] = (d, s)
    points = spark.createDataFrame(queries, "qid long, lon double, lat double")
    stations = spark.createDataFrame(sites, "site_id long, longitude double, latitude double")
    original = spatial._depth
    spatial._depth = (lambda n: levels) if levels else original
    try:
        hits = spatial.nearest(points, stations)
        got = {r.qid: (r.distance_km, r.nearest_site_id) for r in points.join(hits, ["lon", "lat"]).collect()}
    finally:
        spatial._depth = original
    assert {q: s for q, (_, s) in got.items()} == {q: s for q, (_, s) in truth.items()}


def test_no_sites_means_null_not_zero(spark):
    q = spark.createDataFrame([(1, -100.0, 40.0)], "qid long, longitude double, latitude double")
    none = spark.createDataFrame([], "site_id long, longitude double, latitude double")
    assert spatial.nearest_site(q, none, "qid").collect()[0][1:] == (None, None)
    assert spatial.sites_within_radii(q, none, "qid").collect()[0][1:] == (0, 0, 0)
    values = none.withColumn("value", F.lit(1.0))
    assert spatial.distance_weighted_total(q, values, "qid").collect()[0][1:] == (None, 0, 0.0)


def _count(site, at, n, species="Larus marinus", kind="visible_migration", hours=2.0, heading="N", effort=True, count_id=0):
    return (count_id, site, at, at.date() if at else None, at.strftime("%H:%M") if at else None, hours, species, None, n, kind, heading, effort)


COUNTS = (
    "count_id long, site_id string, count_timestamp_utc timestamp, count_date date, start_time_local string, observation_hours double, "
    "species_scientific_name string, species_common_name string, count long, count_type string, flight_direction string, observer_effort_available boolean"
)
SITES = "site_id string, longitude double, latitude double"


def _activity(spark, counts, at, sites=(("A", -100.0, 40.0),)):
    q = spark.createDataFrame([(1, -100.0, 40.0, at)], "qid long, longitude double, latitude double, query_timestamp_utc timestamp")
    rows = spark.createDataFrame(counts, COUNTS)
    return activity.with_activity_index(
        activity.activity_features(q, spark.createDataFrame(list(sites), SITES), rows, id_col="qid")
    ).first()


def test_activity_is_strictly_past_and_keeps_null_apart_from_zero(spark):
    at = datetime(2024, 5, 5)
    counts = [
        _count("A", datetime(2024, 5, 1, 8), 1, count_id=1), _count("A", datetime(2024, 5, 3, 8), 2, kind="capture", count_id=2),
        _count("A", at, 50, count_id=3), _count("A", datetime(2024, 5, 10, 8), 3, count_id=4), _count("A", None, 9, count_id=5),
        _count("B", datetime(2024, 5, 4, 23), 70, count_id=6),
    ]
    row = _activity(spark, counts, at, (("A", -100.0, 40.0), ("B", -80.0, 30.0)))
    assert (row.total_birds_previous_24h, row.total_birds_previous_3d, row.total_birds_previous_7d) == (None, 2.0, 3.0)
    assert row.nearest_site_id == "A" and row.number_of_sites_within_50_km == 1
    assert row.nearest_site_observation_age_hours == 40.0
    assert row.birds_per_observation_hour_previous_7d == pytest.approx(3 / 4)
    assert (row.gull_count_previous_7d, row.raptor_count_previous_7d) == (3.0, 0.0)  # window seen, no raptor: zero
    assert row.nocturnal_flight_call_count_previous_3d is None  # window seen, no such session: unknown
    assert row.capture_count_previous_7d == 2.0 and row.species_richness_previous_7d == 1
    assert row.directional_consistency == pytest.approx(1.0) and row.low_coverage_warning and not row.distance_warning
    assert row.activity_index_basis.startswith("effort_normalized")


def test_activity_without_sessions_or_sites(spark):
    row = _activity(spark, [_count("A", datetime(2024, 5, 1), 0, count_id=1)], datetime(2024, 5, 2))
    assert row.total_birds_previous_24h == 0.0 and row.activity_index == 0.0
    row = _activity(spark, [_count("A", datetime(2024, 1, 1), 4, count_id=1)], datetime(2024, 5, 2))
    assert row.total_birds_previous_14d is None and row.activity_index is None
    assert row.activity_index_basis == "no_recent_observations" and row.nearest_site_observation_age_hours == 122 * 24
    q = spark.createDataFrame([(1, -100.0, 40.0, datetime(2024, 5, 2))], "qid long, longitude double, latitude double, query_timestamp_utc timestamp")
    row = activity.with_activity_index(activity.activity_features(
        q, spark.createDataFrame([], SITES), spark.createDataFrame([], COUNTS), id_col="qid"
    )).first()
    assert row.monitoring_available is False and row.data_coverage_score == 0.0
    assert row.activity_index_basis == "no_trektellen_coverage" and row.number_of_sites_within_50_km is None


@pytest.mark.parametrize("step_days", [14, 1])
def test_lookback_equals_brute_force(spark, step_days):
    rng = random.Random(5)
    day = 24 * temporal.HOUR
    sessions = [(rng.choice("AAAAB"), rng.randrange(0, 60 * 24) * temporal.HOUR, rng.randrange(0, 9)) for _ in range(300)]
    merged = {}
    for k, t, v in sessions:
        merged[k, t] = merged.get((k, t), 0) + v
    asked = [(i, rng.choice("AB"), rng.randrange(0, 60 * 24) * temporal.HOUR) for i in range(60)]
    m = spark.createDataFrame([(k, t, float(v), 1.0) for (k, t), v in merged.items()], "k string, ts long, v double, rows double")
    q = spark.createDataFrame(asked, "i long, k string, at long")
    windows = {"1d": day, "14d": 14 * day}
    got = temporal.lookback_sums(
        q, m, key="k", at="at", ts="ts", values={"v": ["1d", "14d"], "rows": ["14d"]}, windows=windows, group_by=["i"], step=step_days * day
    ).collect()
    for r in got:
        _, key, at = asked[r.i]
        for label, length in windows.items():
            assert r[f"v_{label}"] == sum(v for (k, t), v in merged.items() if k == key and at - length <= t < at)
        assert r.rows_14d == sum(1 for (k, t) in merged if k == key and at - 14 * day <= t < at)
    assert len(got) == len(asked)
    ages = temporal.latest_before(q, m, key="k", at="at", ts="ts", step=3 * day).collect()
    for r in ages:
        past = [t for (k, t) in merged if k == r.k and t < r.at]
        assert r.latest == (max(past) if past else None)


def test_lookback_of_one_busy_key_and_missing_values(spark):
    """Every place asks for one key at one instant; a missing key, instant or measure gives zeros, not lost rows."""
    day = 24 * temporal.HOUR
    m = spark.createDataFrame([("A", i * temporal.HOUR, 1.0 if i % 2 else None) for i in range(48)], "k string, ts long, v double")
    busy = spark.range(40_000).selectExpr("id AS i", "'A' AS k", f"{2 * day} AS at")
    odd = spark.createDataFrame([(-1, None, 2 * day), (-2, "A", None), (-3, "B", 2 * day)], "i long, k string, at long")
    blocks = temporal.in_blocks(busy.unionByName(odd))
    assert blocks.groupBy("_block").count().agg(F.max("count")).first()[0] <= temporal.BLOCK
    got = temporal.lookback_sums(blocks, m, key="k", at="at", ts="ts", values={"v": ["1d"]}, windows={"1d": day}, group_by=["i"])
    found = got.groupBy((F.col("i") >= 0).alias("busy"), "v_1d").agg(F.count_distinct("i").alias("n")).collect()
    assert {(r.busy, r.v_1d): r.n for r in found} == {(True, 12.0): 40_000, (False, 0.0): 3}
    none = temporal.lookback_sums(busy.limit(2), m.where("false"), key="k", at="at", ts="ts", values={"v": ["1d"]}, windows={"1d": day}, group_by=["i"])
    assert [r.v_1d for r in none.collect()] == [0.0, 0.0]


def _weather(spark, observations, at, **kw):
    q = spark.createDataFrame([(1, -100.0, 40.0, at)], "qid long, longitude double, latitude double, query_timestamp_utc timestamp")
    w = spark.createDataFrame(observations, "station_id string, longitude double, latitude double, timestamp_utc timestamp, temperature_c double")
    return weather.asof_weather(q, w, id_col="qid", measures=["temperature_c"], **kw).first()


def test_asof_weather(spark):
    at = datetime(2024, 6, 1, 10)
    near = [("W1", -100.01, 40.01, at + timedelta(hours=h), float(h)) for h in (-4, 1)]
    assert _weather(spark, near, at, max_age_hours=5.0).temperature_c == -4.0
    assert not _weather(spark, near, at).weather_available
    assert _weather(spark, near, at, allow_future=True).temperature_c == 1.0
    assert not _weather(spark, [("FAR", -90.0, 45.0, at, 1.0)], at).weather_available
    row = _weather(spark, [("STALE", -100.0, 40.0, at - timedelta(hours=9), 1.0), ("FRESH", -100.3, 40.0, at, 2.0)], at)
    assert row.station_id == "FRESH" and row.weather_observation_age_minutes == 0.0


def test_incident_join_and_quality(spark):
    long = spark.createDataFrame(
        [("Northern Cardinal", "mar", 0.05, 1), ("Northern Cardinal", "apr", 0.10, 2), ("Song Sparrow", "mar", None, 3)],
        "species string, month string, count_per_hour double, n int",
    )
    incidents = spark.createDataFrame([
        ("1", 39.2, -76.0, 2025, 3, "NORTHERN CARDINAL"), ("2", 39.2, -76.0, 2015, 3, "Song Sparrow"),
        ("3", None, -76.0, 2025, 3, "Northern cardinal"), ("4", 45.0, -76.0, None, None, None),
    ], "INDEX_NR string, LATITUDE double, LONGITUDE double, INCIDENT_YEAR int, INCIDENT_MONTH int, SPECIES string")
    joined = species.incidents_with_activity(
        incidents, species.activity_lookup(long, "n"), station_lon=-76.0, station_lat=39.2, season_year=2025, source_dataset="s"
    )
    got = {r.record_id: r for r in joined.collect()}
    assert set(got) == {"1", "2", "4"} and got["1"].value_type == "observed" and got["1"].distance_km == 0.0
    assert got["2"].species_matched and not got["2"].month_monitored and got["2"].value_type == "unavailable"
    assert got["4"].time_diff_years == 0 and not got["4"].species_matched
    report = {r.key: (r.n, r.pct_of_all_incidents) for r in species.join_quality(joined, incidents).collect()}
    assert report["n_incidents_total"][0] == 4 and report["n_dropped_missing_coordinates"][0] == 1
    assert report["within_50km"] == (1, 25.0) and report["within_0yr"] == (1, 25.0)


def test_edge_distance_any_range(spark):
    points = spark.createDataFrame([(1, -100.0, 40.0), (2, 120.0, -30.0)], "airport_id long, longitude double, latitude double")
    edges = spark.createDataFrame([(-101.0, 40.5, -99.0, 40.5), (-90.0, 30.0, -89.0, 30.0)], "lon1 double, lat1 double, lon2 double, lat2 double")
    got = {r[0]: r[1] for r in habitat.nearest_edge_distance(points, edges, "airport_id").collect()}
    assert 50 < got[1] < 60 and got[2] > 10_000


def test_edges_across_a_continent(spark):
    """Cut edges give the distance of whole ones in the plane, few candidate pairs, and pieces of bounded length anywhere."""
    rng = random.Random(8)
    long_edges = [(-124.0, 48.9, -67.0, 45.0), (-120.0, 25.0, -70.0, 49.0), (-10.0, 36.0, 40.0, 70.0), (-60.0, -40.0, 150.0, 60.0)]
    short = [(x, y, x + 0.01, y + 0.02) for x, y in ((rng.uniform(-124, -67), rng.uniform(25, 49)) for _ in range(400))]
    odd = [(None, 1.0, 2.0, 3.0), (-100.0, 40.0, -100.0, 40.0), (-100.0, 40.0, -100.0, 40.0)]
    edges = spark.createDataFrame(long_edges + short + odd, "lon1 double, lat1 double, lon2 double, lat2 double")
    places = [(i, rng.uniform(-124, -67), rng.uniform(25, 49)) for i in range(30)] + [(100 + i, rng.uniform(-180, 180), rng.uniform(-80, 80)) for i in range(10)]
    points = spark.createDataFrame(places + [(900, None, 40.0), (901, 10.0, 95.0)], "airport_id long, longitude double, latitude double")
    got = {r[0]: r[1] for r in habitat.nearest_edge_distance(points, edges, "airport_id").collect()}
    pieces = habitat.edge_pieces(edges).cache()
    assert pieces.where("_half > IF(flat, 5, 100) * 1.05 + 1e-6").count() == 0
    every = spark.createDataFrame(places, "airport_id long, lon double, lat double").crossJoin(pieces)
    every = every.where(habitat._sees(geo.region("lon", "lat"), F.col("_kind")))
    for r in habitat.with_edge_distance_km(every).groupBy("airport_id").agg(F.min("_d").alias("d")).collect():
        assert abs(got[r.airport_id] - r.d) < 1e-9
    assert got[900] is None and got[901] is None
    # whole edges of the region in its plane
    plane = edges.where("lon1 BETWEEN -125 AND -66 AND lat1 > 24").dropna()
    sides = plane.select(geo.placed("lon1", "lat1").alias("a"), geo.placed("lon2", "lat2").alias("b")).where("a.region = 'conus' AND b.region = 'conus'").collect()
    for r in points.where("airport_id < 100").select("airport_id", geo.placed("longitude", "latitude").alias("p")).collect():
        def whole(a, b):
            dx, dy = b.x - a.x, b.y - a.y
            t = max(0.0, min(1.0, ((r.p.x - a.x) * dx + (r.p.y - a.y) * dy) / max(dx * dx + dy * dy, 1e-12)))
            return math.hypot(r.p.x - a.x - dx * t, r.p.y - a.y - dy * t) / 1000
        assert abs(got[r.airport_id] - min(whole(s.a, s.b) for s in sides)) < 1e-6
    met = []
    def counted(pairs):
        met.append(pairs.count())
        return habitat.with_edge_distance_km(pairs)
    spatial.branch_and_bound(points.selectExpr("longitude AS lon", "latitude AS lat"), habitat.edge_pieces(edges), counted, sees=habitat._sees).collect()
    assert met[0] < every.count() / 20
    empty = habitat.nearest_edge_distance(points, edges.where("false"), "airport_id").collect()
    assert len(empty) == 42 and all(r.distance_km is None for r in empty)


def _disc_area(spark, polygon, radius=1.0):
    sides = spark.createDataFrame([(*a, *b) for a, b in zip(polygon, polygon[1:] + polygon[:1])], "ax double, ay double, bx double, by double")
    return habitat.with_disc_part(sides, radius).agg(F.sum("part")).first()[0]


def test_disc_part_against_closed_forms(spark):
    box = lambda w, s, e, n: [(w, s), (e, s), (e, n), (w, n)]
    assert _disc_area(spark, box(-3.0, -2.0, 5.0, 9.0)) == pytest.approx(math.pi, rel=1e-9)  # the disc lies inside
    assert _disc_area(spark, box(-0.2, -0.1, 0.3, 0.4)) == pytest.approx(0.25, rel=1e-9)  # the polygon lies inside
    assert _disc_area(spark, box(0.0, -5.0, 5.0, 5.0)) == pytest.approx(math.pi / 2, rel=1e-9)  # an edge through the centre
    assert _disc_area(spark, box(0.0, 0.0, 5.0, 5.0)) == pytest.approx(math.pi / 4, rel=1e-9)  # a corner at the centre
    for h in (0.1, 0.5, 0.99):
        assert _disc_area(spark, box(h, -5.0, 5.0, 5.0)) == pytest.approx(math.acos(h) - h * math.sqrt(1 - h * h), rel=1e-9)
    assert _disc_area(spark, box(1.0, -5.0, 5.0, 5.0)) == pytest.approx(0.0, abs=1e-12)  # touches
    assert _disc_area(spark, box(2.0, 2.0, 5.0, 5.0)) == pytest.approx(0.0, abs=1e-12)
    assert _disc_area(spark, box(-3.0, -2.0, 5.0, 9.0)[::-1]) == pytest.approx(-math.pi, rel=1e-9)


def test_clipped_area_of_layers(spark):
    points = spark.createDataFrame(
        [(1, -100.0, 40.0), (2, -100.0, 40.0), (3, -80.0, 30.0), (4, 120.0, -30.0), (5, 10.0, 50.0), (6, None, 40.0)],
        "airport_id long, longitude double, latitude double")

    def box(polygon, lon, lat, half, hole=False, back=False):
        ring = [(lon - half, lat - half), (lon + half, lat - half), (lon + half, lat + half), (lon - half, lat + half)]
        return polygon, ring[::-1] if back else ring, hole

    rows = [
        box(1, -100.0, 40.0, 8.0), box(1, -100.0, 40.0, 0.02, hole=True),  # encloses the disc, whose middle is cut out
        box(2, -100.3, 40.0, 0.001, back=True), box(3, -80.0, 30.0, 0.01), box(3, 10.0, 50.0, 0.01, back=True), (4, [(0.0, 0.0), (1.0, 1.0)], False),
        (5, [(-100.1, 40.0), (None, 40.0), (-100.1, 40.1)], False),
    ]
    rings = spark.createDataFrame(rows, "polygon_id long, ring array<struct<lon: double, lat: double>>, hole boolean")
    edges = habitat.polygon_edges(rings)
    got = {r[0]: r[1] for r in habitat.clipped_area(points, edges, "airport_id", 10.0).collect()}
    km2 = lambda lat, half: (2 * half) ** 2 * 111.03 * 111.32 * math.cos(math.radians(lat))
    assert got[1] == got[2] == pytest.approx(math.pi * 100 - km2(40, 0.02), rel=1e-3)
    assert got[3] == pytest.approx(km2(30, 0.01), rel=1e-2) and got[5] == pytest.approx(km2(50, 0.01), rel=1e-2)
    assert got[4] is None and got[6] is None and len(got) == 6
    assert {r[1] for r in habitat.clipped_area(points, edges.limit(0), "airport_id", 10.0).collect()} == {0.0, None}
    assert habitat.environment(points, wetland=edges).where("habitat_data_available AND wetland_area_within_10km > 0").count() == 4


def test_exploded_sides_are_never_broadcast(spark, tmp_path):
    """A side that unpacks or explodes far beyond its files is shuffled, whatever Spark estimates for it."""
    spark.createDataFrame(_points(50, 3), "site_id long, longitude double, latitude double").write.parquet(str(tmp_path / "s"))
    sites = spark.read.parquet(str(tmp_path / "s"))
    pairs = spatial.within_radius(sites.selectExpr("longitude AS lon", "latitude AS lat"), sites, 100.0)
    ring = F.array(*[F.struct((F.col("longitude") + x).alias("lon"), (F.col("latitude") + y).alias("lat")) for x, y in ((0, 0), (1, 0), (0, 1))])
    edges = habitat.polygon_edges(sites.select(F.col("site_id").alias("polygon_id"), F.lit(False).alias("hole"), ring.alias("ring")))
    areas = habitat.clipped_area(sites, edges, "site_id", 100.0)
    near = habitat.nearest_edge_distance(sites, edges, "site_id")
    for made, least in ((pairs, 1), (areas, 2), (near, 1)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("rightHint=(strategy=merge)") >= least


def test_distance_join_stays_compiled_and_spread(spark):
    """The join tests plain expressions, the exact distance is worked out once behind it, and few bytes are not merged into few tasks."""
    places = spark.createDataFrame(_points(50, 3), "site_id long, longitude double, latitude double")
    pairs = spatial.within_radius(places.selectExpr("longitude AS lon", "latitude AS lat"), places, 300.0)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.split("Initial Plan")[0].splitlines() if "SortMergeJoin" in line)
    assert "lambda" not in join and join.lstrip(" :+-").startswith("*(")
    assert plan.count("REPARTITION_BY_NUM") >= 3 and pairs.rdd.getNumPartitions() >= spatial.spread_parts(spark)


@pytest.mark.parametrize("limit", [1 << 19, 5])
def test_walks_equal_brute_force(spark, monkeypatch, limit):
    """Sums, distinct values and freshest events around places, in whole groups and in parts and blocks of a few rows."""
    monkeypatch.setattr(around, "EVENTS", limit)
    monkeypatch.setattr(around, "INSTANTS", limit)
    rng, hour = random.Random(11), temporal.HOUR
    asked = [(float(i % 3), 0.0, rng.randrange(0, 90) * hour) for i in range(60)]
    asked = sorted(set(asked)) + [(99.0, 0.0, 5 * hour)]
    near = {0.0: ["A", "B", "C"], 1.0: ["C", "D"], 2.0: ["Z"]}
    pairs = [(lon, 0.0, k, float(i // 2)) for lon, ks in near.items() for i, k in enumerate(ks)]
    events = sorted({(rng.choice("ABCDE"), rng.randrange(0, 90) * hour): (float(rng.randrange(9)), rng.choice("xyz")) for _ in range(80)}.items())
    q = spark.createDataFrame(asked, "lon double, lat double, at long")
    p = spark.createDataFrame(pairs, "lon double, lat double, k string, distance_km double")
    e = spark.createDataFrame([(k, t, v, s) for (k, t), (v, s) in events], "k string, ts long, v double, s string")
    common = {"key": "k", "ts": "ts", "radius_km": 50.0}
    met = lambda lon: {(k, t): x for (k, t), x in events if k in near.get(lon, [])}

    sums = around.around(q, p, e, around.window_sums({"v": ["day"]}, {"day": 24 * hour}), back=24 * hour, step=24 * hour, **common)
    found = {tuple(r)[:3]: r.n for r in sums.groupBy("lon", "lat", "at").agg(F.sum("v_day").alias("n")).collect()}
    kinds = around.around(q, p, e, around.window_distinct("s", 24 * hour, "n"), back=24 * hour, step=48 * hour, deal="s", **common)
    distinct = {tuple(r)[:3]: r.n for r in kinds.groupBy("lon", "lat", "at").agg(F.sum("n").alias("n")).collect()}
    for one in asked:
        window = [x for (k, t), x in met(one[0]).items() if one[2] - 24 * hour <= t < one[2]]
        assert found.get(one, 0.0) == sum(v for v, _ in window)
        assert distinct.get(one, 0) == len({s for _, s in window})

    for either in (False, True):
        walk = around.nearest_fresh("k", "string", "v", "double", 6 * hour, either)
        hits = around.around(q, p, e.select("k", "ts", "v"), walk, back=6 * hour, ahead=6 * hour * either, step=24 * hour, **common)
        best = {}
        for r in hits.collect():
            best[r.lon, r.lat, r.at] = min(best.get((r.lon, r.lat, r.at), (9.0,)), (r.distance_km, r.k, r.age, r.hit))
        for one in asked:
            far = {k: d for lon, _, k, d in pairs if lon == one[0]}
            fits = [(far[k], k, abs(one[2] - t), t, v) for (k, t), (v, _) in met(one[0]).items()
                    if abs(one[2] - t) <= 6 * hour and (either or t <= one[2])]
            want = min(fits, default=None)
            assert best.get(one) == (want and (*want[:3], want[4]))
