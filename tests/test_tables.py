"""Targets, guards, reshaping, validation, sources and sinks."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from strikehaz import fixed_values as fv
from strikehaz.operators import features, layers, policy, quality, reshape, scoring, species, targets
from strikehaz.schemas import AIRPORT_DAY, AIRPORT_DAY_COMPANIONS, AIRPORT_DAY_REQUIRED
from strikehaz.sources import monitoring, places, reports, strikes


def _write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("flag, label, status", [
    ("Y", 1, "explicit_positive"), (" yes ", 1, "explicit_positive"), ("true", 1, "explicit_positive"), ("1", 1, "explicit_positive"),
    ("N", 0, "explicit_negative"), ("None", 0, "explicit_negative"), ("0", 0, "explicit_negative"),
    ("", None, "missing_or_ambiguous"), ("UNK", None, "missing_or_ambiguous"), (None, None, "missing_or_ambiguous"),
])
def test_damage_target(spark, flag, label, status):
    row = targets.damage_target(spark.createDataFrame([(flag,)], "damage_flag string")).first()
    assert (row.damage, row.damage_target_status) == (label, status)


@pytest.mark.parametrize("indicated, level, inconsistent, severity", [
    ("1", "M", False, 1.0), ("1", "M?", False, 1.0), ("Y", "S", False, 2.0), ("1", "D", False, 3.0), ("0", "N", False, 0.0), ("0", None, False, 0.0),
    ("1", None, True, None), ("0", "S", True, None), (None, "S", False, None),
])
def test_severity_target(spark, indicated, level, inconsistent, severity):
    df = spark.createDataFrame([(indicated, level)], "INDICATED_DAMAGE string, DAMAGE_LEVEL string")
    row = targets.severity_target(targets.damage_binary_target(df)).first()
    assert (row.damage_level_inconsistent, row.damage_severity_score) == (inconsistent, severity)


def test_every_outcome_field_is_barred():
    for column in fv.OUTCOME_FIELDS:
        with pytest.raises(policy.LeakageError, match=column):
            policy.assert_no_leakage(["state", column])
    for column in fv.RAW_FORBIDDEN:
        with pytest.raises(policy.LeakageError):
            policy.assert_mode_inputs([column], "operational_core")
    for column in fv.RAW_ENCOUNTER:
        policy.assert_mode_inputs([column], "operational_core")
        with pytest.raises(policy.LeakageError):
            policy.assert_mode_inputs([column], "reduced_preflight")
    with pytest.raises(ValueError):
        policy.assert_mode_inputs([], "everything")
    assert len(fv.RAW_FORBIDDEN) == len(set(fv.RAW_FORBIDDEN)) == 75


def test_aliases_resolve_or_refuse():
    got = strikes.resolve_columns(["INDEX NR", "incident_date", "LONG", "Something else"])
    assert got == {"record_id": "INDEX NR", "incident_date": "incident_date", "longitude": "LONG"}
    with pytest.raises(ValueError):
        strikes.resolve_columns(["AIRPORT_ID", "AIRPORT CODE"])
    with pytest.raises(ValueError):
        strikes.resolve_columns(["X"], {"a": ["X"], "b": ["X"]})


def test_strike_scan(spark, tmp_path):
    path = _write(tmp_path / "strikes.csv", (
        "INDEX NR,INCIDENT DATE,TIME,AIRPORT CODE,LAT,LONG,HEIGHT (FT),DAMAGE_FLAG,DAM_LEVEL,EXTRA\n"
        "A-1,2021-06-01,09:15,S01,42.0,-100.0,300,Y,M,kept\nA-2,bad,11:45,S02,x,-100.1,50,N,,\n"
    ))
    scan = strikes.scan_strikes(spark, path)
    rows = scan.data.orderBy("record_id").collect()
    assert rows[0].height_agl_ft == 300.0 and rows[1].latitude is None and rows[1].incident_date is None
    assert "engine_type" in scan.missing and scan.audit.columns[-1] == "EXTRA" and scan.data.count() == 2
    with pytest.raises(ValueError):
        strikes.scan_strikes(spark, str(tmp_path / "strikes.ods"))
    staged = strikes.stage_raw(spark, path, str(tmp_path / "staged"))
    assert staged.count() == 2 and strikes.stage_raw(spark, "/nowhere.csv", str(tmp_path / "staged")).count() == 2


def test_season_files(spark, tmp_path):
    path = _write(tmp_path / "season.csv", (
        "﻿row_type,rank,species,mar,apr,total,presence_percent,presence_days,first_date,last_date,maximum_date\n"
        "species,1,Mourning Dove,4,10,14,50,2,4 Mar,10 Apr,10 Apr\n"
        "species,2,Alder/Willow Flycatcher,0,159,159,10,5,23 Apr,23 Apr,23 Apr\n"
        "totals,,Totals,4,169,173,,7,,,\nobservation_hours,,Observation hours,10:30,0:00,10:30,,,,,\n"
    ))
    table = strikes.read_text_csv(spark, path)
    long = monitoring.season_long(table)
    got = {(r.species, r.month): r.count_per_hour for r in long.collect()}
    assert got["Mourning Dove", "mar"] == pytest.approx(4 / 10.5) and got["Mourning Dove", "apr"] is None and len(got) == 4
    names = {r.species for r in species.expand_species(long).collect()}
    assert names == {"Mourning Dove", "Alder Flycatcher", "Willow Flycatcher"}
    assert {r.species: r.total_count for r in species.pooled_activity(long).collect()}["Mourning Dove"] == 4.0


def _annual(dove):
    years = "  ".join(["1"] * 9 + [str(dove)])
    return (
        f"  1  Mourning Dove   {years}   {9 + dove}  1.0  5  4  {max(dove, 1)} (2025)\nnot a row\n"
        f"Totals  {years}  {9 + dove}  1.0  5  4\nObservation hours   532:59  1,018:12  937:56  899:25  3,388:32  847:08\n"
    )


def test_annual_text_versions(spark, tmp_path):
    import os
    import time

    for i, (name, dove) in enumerate([("x_annual_old.txt", 7), ("x_annual_new.txt", 9)]):
        _write(tmp_path / name, _annual(dove))
        os.utime(tmp_path / name, (time.time() + i * 100 - 1000,) * 2)
    lines = monitoring.read_annual_text(spark, str(tmp_path))
    long = monitoring.annual_long(lines)
    rows = {(r.year, r.source_file): r for r in long.collect()}
    assert rows[2021, "x_annual_old.txt"].monitored is False and rows[2021, "x_annual_old.txt"].count_per_hour is None
    assert rows[2023, "x_annual_new.txt"].observation_hours == 1018.2
    merged = {r.year: r["count"] for r in monitoring.merge_annual(long).collect()}
    assert merged[2025] == 9 and len(merged) == 10
    assert [(r.species, r.year) for r in reshape.version_conflicts(long, ["species", "year"], "count").collect()] == [("Mourning Dove", 2025)]
    assert monitoring.annual_totals(lines).count() == 2 and monitoring.career_summary(lines).count() == 2


def test_crosstab_sheets(spark, tmp_path):
    sheets = tmp_path / "sheets"
    sheets.mkdir()
    body = (
        "Year totals,,,,\n,,,,\nMetric,Species,2017,2018,Total\nCombined (newly ringed + retraps),Mourning Dove,2,3,5\n"
        "TOTAL — Combined,,,,5\nNewly ringed,Mourning Dove,1,2,3\nRetraps,Mourning Dove,1,,1\n"
    )
    _write(sheets / "All months.csv", body)
    _write(sheets / "Unlisted.csv", body)
    index = monitoring.read_crosstab_index(spark, _write(
        tmp_path / "index.csv", "Title,,,,,,\nPeriod code,Period label,Months included,Species recorded,Total,New,Retraps\n0,All months,all,1,5,3,2\n"
    ))
    columns = ["Metric", "Species", "2017", "2018", "Total"]
    long = reshape.crosstab_to_long(monitoring.read_crosstab_sheets(spark, str(sheets), columns), ["2017", "2018"], index)
    assert long.count() == 5 and {r.period_label for r in long.collect()} == {"All months"}
    got = {r.metric: (r.counted, r.matches) for r in reshape.crosstab_mismatches(long, index).collect()}
    assert got == {"combined": (5.0, True), "newly_ringed": (3.0, True), "retraps": (1.0, False)}


def test_counts_long_and_wide(spark, tmp_path):
    wide = monitoring.scan_counts(spark, _write(tmp_path / "wide.csv", "site_id,count_date,Mallard,Herring Gull\nS1,2024-01-01,3,0\nS1,2024-01-02,0,5\n"))
    got = [(r.count_id, r.species_common_name, r["count"], r.species_scientific_name) for r in wide.orderBy("count_id").collect()]
    assert got == [("WIDE000000", "Mallard", 3, None), ("WIDE000001", "Herring Gull", 5, None)]
    long = monitoring.scan_counts(spark, _write(tmp_path / "long.csv", (
        "count_id,site_id,count_date,start_time_local,end_time_local,observation_hours,species_common_name,count,count_type\n"
        "1,S1,2024-01-01,09:00,08:00,0,Mallard,-1,capture\n2,X,2024-01-01,10:00,11:00,1,Mallard,4,made_up\n3,X,2024-01-01,10:00,11:00,1,Mallard,4,\n"
    )))
    sites = monitoring.scan_sites(spark, _write(tmp_path / "sites.csv", "site_id,latitude,longitude,timezone\nS1,40,-100,UTC\n"))
    report = {r.metric: r.n for r in quality.counts_report(long, sites).collect()}
    assert report == {
        "n_rows": 3, "n_invalid_coordinates": 2, "n_negative_counts": 1, "n_invalid_time_ranges": 1, "n_nonpositive_effort": 1,
        "n_unresolved_site_ids": 1, "duplicate_sessions": 2,
    }
    assert {r.count_type: r.recognised for r in quality.count_type_report(long).collect()} == {"capture": True, "made_up": False, None: False}


def test_provenance_gate(spark, tmp_path):
    record = {f: "x" for f in fv.PROVENANCE_FIELDS}
    assert monitoring.scan_provenance(spark, _write(tmp_path / "p.json", json.dumps(record, indent=1))).count() == 1
    del record["notes"]
    with pytest.raises(ValueError, match="notes"):
        monitoring.scan_provenance(spark, _write(tmp_path / "q.json", json.dumps(record)))


def test_airports_and_weather(spark, tmp_path):
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-100.5, 40.25]}, "properties": {"airport_id": "A1", "runway_count": 2}}
    ]}
    row = places.scan_airports(spark, _write(tmp_path / "a.geojson", json.dumps(collection))).first()
    assert (row.airport_id, row.longitude, row.latitude, row.runway_count, row.icao) == ("A1", -100.5, 40.25, 2.0, None)
    raw = spark.createDataFrame([("KX", "KX", None, "X", "Field", "40.5", "-99.5", "12", "small_airport", "US-PA", "US")],
                                "ident string, icao_code string, iata_code string, local_code string, name string, latitude_deg string, longitude_deg string, "
                                "elevation_ft string, type string, iso_region string, iso_country string")
    got = places.world_airports(raw).first()
    assert (got.state, got.latitude, got.runway_count) == ("PA", 40.5, None)
    assert places.unknown_airports(raw.select(F.col("ident").alias("airport_id")), places.world_airports(raw)).count() == 0
    w = places.scan_weather(spark, _write(tmp_path / "w.csv", "station_id,timestamp_utc,latitude,longitude,temperature_c\nW1,2024-01-01 10:00:00,40,-100,3.5\nW1,bad,40,-100,x\n"))
    assert [r.temperature_c for r in w.orderBy(F.desc("timestamp_utc")).collect()] == [3.5, None]


def test_schema_validation(spark):
    rows = [("A", date(2024, 1, 1), "A_1", 40.0, -100.0, 1.0, None), ("A", date(2024, 1, 1), "A_1", 200.0, -100.0, None, None)]
    df = spark.createDataFrame(rows, "airport_id string, date date, observation_id string, latitude double, longitude double, estimated_abundance double, bird_data_resolution string")

    def report(frame):
        out = quality.validate(frame, AIRPORT_DAY, required=AIRPORT_DAY_REQUIRED, lat="latitude", lon="longitude", timestamps=["date"],
                               keys=["airport_id", "date"], companions=AIRPORT_DAY_COMPANIONS)
        return {(r.check, r.subject): r.value for r in out.collect()}

    got = report(df)
    assert got["invalid_coordinates", "rows"] == 1 and got["duplicate_keys", "rows"] == 2 and got["companion_violation", "estimated_abundance"] == 1
    assert got["missing_fraction", "estimated_abundance"] == 0.5 and got["is_clean", "all"] == 0.0
    clean = report(df.where("latitude < 90").withColumn("bird_data_resolution", F.lit("monthly")))
    assert clean["is_clean", "all"] == 1.0
    assert report(df.drop("latitude"))["missing_column", "latitude"] == 1.0
    text = df.where("latitude < 90").withColumns({"date": F.lit("not a date"), "bird_data_resolution": F.lit("m")})
    assert report(text)["invalid_timestamp", "date"] == 1


def test_local_risk_joins_across_case(spark):
    strikes_ = spark.createDataFrame([("Mourning dove", 1.0), ("Mourning dove", 3.0), ("Canada goose", 2.0), (None, 2.0)], "species string, predicted_severity double")
    local = spark.createDataFrame([("Mourning Dove", 0.5), ("Blue Jay", 0.1)], "species string, local_activity double")
    got = {r.species: r for r in species.local_risk(local, species.species_risk(strikes_)).collect()}
    assert got["Mourning Dove"].n_strikes == 2 and got["Mourning Dove"].risk_score == pytest.approx(2 * 1.0986122886681098)
    assert got["Blue Jay"].matched_species is False and got["Blue Jay"].local_risk_contribution is None


def test_scenarios(spark):
    presets = scoring.preset_scenarios(spark)
    seen = spark.createDataFrame([("aircraft_type", "C-172"), ("state", "TX")], "column string, value string")
    ranges = spark.createDataFrame([("height_agl_ft", 0.0, 100.0)], "column string, low double, high double")
    got = {r.scenario_id: r for r in scoring.scenario_violations(presets, seen, ranges, checked=["aircraft_type", "state"]).collect()}
    assert got["c172_day_clear_takeoff"].is_valid and len(got) == 6
    assert got["c172_night_clear_approach"].violations == "height_agl_ft: outside training range"
    assert got["king_air_day_clear_approach"].n_violations == 3
    with pytest.raises(ValueError):
        scoring.check_fields(["scenario_id", "aircraft_type"])
    raw = scoring.scenario_to_raw(presets)
    assert raw.where("ENG_2_POS IS NULL").count() == 4
    assert features.operational_core(raw).frame.count() == 6


def test_layers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", -100.0, 40.0), ("B", None, 40.0)], "airport_id string, longitude double, latitude double")
    made = [json.loads(r.geometry) if r.geometry else None for r in layers.esri_features(df).collect()]
    assert made[0] == {"x": -100.0, "y": 40.0, "spatialReference": {"wkid": 4326}} and made[1] is None
    assert layers.layer_check(df).first().passed is False
    assert layers.layer_check(df.where("longitude IS NOT NULL").withColumn("x" * 32, F.lit(1))).first().field_names_valid_length is False
    rings = layers.buffer_layer(df.where("longitude IS NOT NULL"), 50.0, 16)
    polygon = json.loads(layers.esri_features(rings.select("airport_id", "ring"), "polygon").first().geometry)
    assert len(polygon["rings"][0]) == 17 and polygon["rings"][0][0] == polygon["rings"][0][-1]
    written = reports.write_layer(df, str(tmp_path / "layer"), layers.LayerStamp("test", True))
    assert spark.read.csv(written["csv"], header=True).where("source = 'test'").count() == 2
    assert json.loads(spark.read.text(written["geojson"]).first()[0])["type"] == "Feature"
    parts = df.withColumn("split", F.lit("train"))
    reports.write_splits(parts, str(tmp_path / "splits"))
    assert reports.read_split(spark, str(tmp_path / "splits"), "train").count() == 2
    assert reports.fingerprints(spark, str(tmp_path / "splits"), "*.parquet").where(F.length("sha256") == 64).count() >= 0


def test_catalog(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    meta = reports.build_catalog({"facts": (df, "here", "one row"), "absent": (None, "", "")}, "strikehaz_test")
    assert [(r.table_name, r.row_count, r.column_count) for r in meta.collect()] == [("facts", 1, 2)]
    assert spark.sql("SELECT count(*) FROM strikehaz_test.facts").first()[0] == 1


def test_report_scans(spark, tmp_path):
    path = _write(tmp_path / "r.json", json.dumps({"hash": "x", "populations": {"a": {"n": 1}, "b": {"n": 2}}, "target": {"pos": 3}}))
    assert {r.name: r.n for r in reports.flat_report(spark, path, "populations").collect()} == {"a": 1, "b": 2}
    assert reports.report_summary(spark, path, ["populations", "target"]).first().target_pos == 3


def test_buffers_of_one_file_are_worked_out_on_all_cores(spark):
    """One small file makes one task; the corners are spread before they are worked out."""
    df = spark.range(40, numPartitions=1).selectExpr("id AS airport_id", "-100.0D + id / 10 AS longitude", "40.0D AS latitude")
    rings = layers.buffer_layer(df, 50.0)
    assert rings.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1
    assert rings.where(F.size("ring") == 65).count() == 40
