"""Column functions: coercion, names, times, distances, cells."""

import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strikehaz.functions import coerce, geo, names, times
from strikehaz.schemas import COUNTS
from strikehaz.sources import monitoring


def values(df):
    return [tuple(r) for r in df.collect()]


def test_numbers_and_dates_never_throw(spark):
    df = spark.createDataFrame([("5",), (" 5 ",), ("1d",), ("NaN",), ("x",), (None,), ("1e3",)], "s string")
    by_column = [r[0] for r in df.select(coerce.number(F.col("s"))).collect()]
    assert by_column == [5.0, 5.0, None, None, None, None, 1000.0]
    assert [r[0] for r in df.select(coerce.number("s")).collect()] == by_column
    dates = spark.createDataFrame([("2021-06-01",), ("soon",), (None,)], "s string").select(coerce.moment(F.col("s")))
    assert [r[0] is not None for r in dates.collect()] == [True, False, False]
    exported = [("06/01/2021",), ("6/1/2021 0:00",), ("6/1/2021 14:05:09",), ("13/01/2021",), ("6/31/2021",)]
    got = [r[0] for r in spark.createDataFrame(exported, "s string").select(coerce.moment(F.col("s"))).collect()]
    assert got == [datetime(2021, 6, 1), datetime(2021, 6, 1), datetime(2021, 6, 1, 14, 5, 9), None, None]


def test_values_that_overflow_become_null(spark):
    df = spark.createDataFrame([("99999999:00", "3000000000"), ("000012:30", "7")], "clock string, n string")
    assert [r[0] for r in df.select(coerce.clock_minutes(F.col("clock"))).collect()] == [None, 750]
    counts = monitoring.padded(df.withColumnRenamed("n", "count"), COUNTS)
    assert [r[0] for r in counts.select("count").collect()] == [None, 7]


def test_tidy_upper_strips_all_white_space(spark):
    df = spark.createDataFrame([("\t a b\n",), (None,)], "s string")
    assert values(df.select(coerce.tidy_upper("s"), coerce.tidy_upper(F.col("s")))) == [("A B", "A B"), (None, None)]


def test_coordinates_and_time_ranges(spark):
    df = spark.createDataFrame([("90", "-180"), ("90.1", "0"), (None, "0"), ("a", "0")], "lat string, lon string")
    assert [r[0] for r in df.select(coerce.valid_coordinates(F.col("lat"), F.col("lon"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([("08:00", "08:00"), ("10:00", "09:00"), (None, "09:00"), ("25:99", "26:00"), ("22:00", "01:00")], "a string, b string")
    assert [r[0] for r in df.select(coerce.end_not_before_start(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("label, expected", [
    ("Mourning Dove", ["Mourning Dove"]),
    ("Northern Flicker (Yellow-shafted)", ["Northern Flicker"]),
    ("Alder/Willow Flycatcher", ["Alder Flycatcher", "Willow Flycatcher"]),
    ("Gray-cheeked/Bicknell's Thrush", ["Gray-cheeked Thrush", "Bicknell's Thrush"]),
    ("Common Grackle / Boat-tailed Grackle", ["Common Grackle", "Boat-tailed Grackle"]),
    ("  Song Sparrow  ", ["Song Sparrow"]),
])
def test_plain_names(spark, label, expected):
    df = spark.createDataFrame([(label,)], "s string")
    assert df.select(names.plain_names(F.col("s"))).first()[0] == expected


def test_groups_are_never_guessed(spark):
    df = spark.createDataFrame([(" Larus marinus ",), ("Larus",), (None,), ("Buteo buteo",)], "s string")
    got = values(df.select(names.species_group(F.col("s")), names.is_large_bird(F.col("s"))))
    assert got == [("gull", False), ("unknown", False), ("unknown", False), ("raptor", True)]


def test_local_to_utc(spark):
    df = spark.createDataFrame([
        ("2024-07-01", "08:00", "America/New_York"), ("2024-01-01", "08:00", "America/New_York"), ("2024-07-01", None, None),
        ("2024-07-01", "08:00", "Not/AZone"), ("soon", "08:00", "UTC"), ("2024-07-01", "25:00", "UTC"),
    ], "d string, t string, z string")
    got = [r[0] for r in df.select(times.local_to_utc(F.col("d"), F.col("t"), F.col("z"))).collect()]
    assert got[:3] == [datetime(2024, 7, 1, 12), datetime(2024, 1, 1, 13), datetime(2024, 7, 1)]
    assert got[3:] == [None, None, None]


def test_hours_from_clock(spark):
    df = spark.createDataFrame([("55:30",), ("1,018:12",), ("0:00",), ("x",)], "s string")
    assert [r[0] for r in df.select(times.hours_from_clock(F.col("s"))).collect()] == [55.5, 1018.2, 0.0, None]


def test_sun_phase(spark):
    df = spark.createDataFrame([
        ("2024-06-21 17:00:00", 40.0, -75.0), ("2024-06-21 05:00:00", 40.0, -75.0), ("2024-06-22 00:45:00", 40.0, -75.0),
        ("2024-06-21 12:00:00", 80.0, 0.0), ("2024-06-21 12:00:00", None, 0.0),
    ], "t string, lat double, lon double").withColumn("t", F.col("t").cast("timestamp"))
    got = values(df.select(*times.sun_phase(F.col("t"), F.col("lat"), F.col("lon")).values()))
    assert got[0] == (False, False, False) and got[1] == (False, False, True)
    assert got[2] == (False, True, False)  # evening after 00:00 UTC in the Americas
    assert got[3] == (None, None, None) and got[4] == (None, None, None)


def _vincenty(lon1, lat1, lon2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    big_l = lam = math.radians(lon2 - lon1)
    for _ in range(40):
        ss = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        cs = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(ss, cs)
        sa = math.cos(u1) * math.cos(u2) * math.sin(lam) / ss
        c2 = 1 - sa * sa
        cm = cs - 2 * math.sin(u1) * math.sin(u2) / c2
        c = f / 16 * c2 * (4 + f * (4 - 3 * c2))
        lam = big_l + (1 - c) * f * sa * (s + c * ss * (cm + c * cs * (2 * cm * cm - 1)))
    us = c2 * (a * a - b * b) / (b * b)
    big_a = 1 + us / 16384 * (4096 + us * (-768 + us * (320 - 175 * us)))
    big_b = us / 1024 * (256 + us * (-128 + us * (74 - 47 * us)))
    ds = big_b * ss * (cm + big_b / 4 * (cs * (2 * cm * cm - 1) - big_b / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
    return b * big_a * (s - ds) / 1000


def test_geodesic_agrees_with_vincenty(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(-180, 180), rng.uniform(-80, 80), rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(200)]
    rows = [(a, b, a + c, b + d) for a, b, c, d in rows] + [(-74.0, 40.7, -0.1, 51.5), (-73.7781, 40.6413, -118.4085, 33.9416)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    for r in df.select("*", geo.geodesic_km("a", "b", "c", "d").alias("km")).collect():
        assert r["km"] == pytest.approx(_vincenty(*r[:4]), abs=1e-4)
    same = spark.createDataFrame([(1.0, 2.0)], "a double, b double").select(geo.geodesic_km("a", "b", "a", "b")).first()[0]
    assert same == 0.0


def test_regions_and_mixed_distances(spark):
    df = spark.createDataFrame([(-100.0, 40.0, -100.2, 40.1), (-74.0, 40.7, -0.1, 51.5), (10.0, 50.0, 12.0, 51.0), (None, 1.0, 2.0, 3.0)],
                               "a double, b double, c double, d double")
    got = df.select(geo.placed("a", "b").alias("p"), geo.placed("c", "d").alias("q")).select(
        geo.distance_km("p", "q"), geo.distance_method("p", "q"), geo.distance_crs("p", "q")
    ).collect()
    assert got[0][1:] == ("projected", "EPSG:5070") and 15 < got[0][0] < 25
    assert got[1][1:] == ("geodesic", None) and 5400 < got[1][0] < 5750
    assert got[2][1:] == ("projected", "EPSG:3035")
    assert got[3][0] is None


def test_cells(spark):
    df = spark.createDataFrame([(40.6413, -73.7781, 3), (40.6414, -73.7781, 4), (33.9416, -118.4085, 10), (None, -73.0, 99), (95.0, 0.0, 1)],
                               "lat double, lon double, n int")
    cells = df.withColumn("c", geo.cell("lat", "lon", 5)).withColumn("f", geo.cell("lat", "lon", 7))
    got = cells.collect()
    assert got[0]["c"] == got[1]["c"] != got[2]["c"] and got[3]["c"] is None and got[4]["c"] is None
    lat, lon = geo.cell_center("c")
    centre = cells.select(lat, lon).first()
    assert abs(centre[0] - 40.6413) < 0.3 and abs(centre[1] + 73.7781) < 0.3
    apart = spark.createDataFrame([(got[0]["c"], got[2]["c"])], "a string, b string").select(geo.cell_distance_km("a", "b")).first()[0]
    assert 3800 < apart < 4200


def test_buffer_area(spark):
    df = spark.createDataFrame([(-98.0, 39.0)], "lon double, lat double").select(geo.placed("lon", "lat").alias("p"))
    ring = df.select(geo.buffer_ring(F.col("p"), 50.0, 64).alias("r"))
    xy = ring.select(F.explode("r").alias("c")).select(geo.placed("c.lon", "c.lat").alias("q")).select("q.x", "q.y").collect()
    area = abs(sum(a.x * b.y - b.x * a.y for a, b in zip(xy, xy[1:]))) / 2 / 1e6
    assert area == pytest.approx(math.pi * 2500, rel=0.01)
