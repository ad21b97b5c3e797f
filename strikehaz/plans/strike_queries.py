"""Strike-side queries: species risk, targets, populations, validation, roll-ups, exploratory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.functions import coerce
from strikehaz.functions.names import is_large_bird, species_common_name, species_group
from strikehaz.operators import eda, quality, species, targets
from strikehaz.plans.registry import query
from strikehaz.plans.views import SCIENTIFIC, column_names, sql, table, view, with_views
from strikehaz.schemas import AIRPORT_DAY
from strikehaz.sources.strikes import canonical_strikes

# the population-normalised raw table with both targets, as SQL
NORMALISED = """
n AS (SELECT *, upper(trim(INDICATED_DAMAGE)) AS ind, coalesce(upper(trim(DAMAGE_LEVEL)), '') AS lev, upper(trim(DAMAGE_LEVEL)) AS lev0 FROM v_raw),
t AS (SELECT *, CASE WHEN ind IN ('1','Y') THEN 1 WHEN ind IN ('0','N') THEN 0 END AS damage_binary,
  CASE WHEN ind IN ('1','Y') THEN 'explicit_positive' WHEN ind IN ('0','N') THEN 'explicit_negative' ELSE 'missing_or_ambiguous' END AS status,
  coalesce((ind IN ('1','Y') AND lev IN ('N','')) OR (ind IN ('0','N') AND lev IN ('M','M?','S','D')), false) AS bad FROM n),
s AS (SELECT *, CASE WHEN NOT bad AND status = 'explicit_negative' THEN 0e0
  WHEN NOT bad AND status = 'explicit_positive' THEN CASE lev0 WHEN 'M' THEN 1e0 WHEN 'M?' THEN 1e0 WHEN 'S' THEN 2e0 WHEN 'D' THEN 3e0 END END AS severity FROM t)
"""


def labelled_raw(spark, sf_dir) -> DataFrame:
    """Normalised raw strikes with the binary and severity targets."""
    return targets.severity_target(targets.damage_binary_target(targets.normalise_raw(view(spark, sf_dir, "raw"))))


@query("species_local_risk", with_views("counts", "raw") + "," + NORMALISED + """,
local AS (SELECT species_common_name AS species, sum("count") AS total_count, sum(observation_hours) AS total_hours FROM v_counts
  WHERE observation_hours > 0 AND species_common_name IS NOT NULL GROUP BY 1),
risk AS (SELECT upper(SPECIES) AS k, count(severity) AS n_strikes, avg(severity) AS m FROM s WHERE SPECIES IS NOT NULL GROUP BY 1)
SELECT l.species, round(total_count / total_hours, 6) AS local_activity, n_strikes, round(m * ln(1 + n_strikes), 6) AS risk_score,
  m * ln(1 + n_strikes) IS NOT NULL AS matched_species, round(m * ln(1 + n_strikes) * total_count / total_hours, 6) AS local_risk_contribution
FROM local l LEFT JOIN risk r ON upper(l.species) = r.k
ORDER BY m * ln(1 + n_strikes) * total_count / total_hours DESC NULLS LAST, l.species LIMIT 15""")
def species_local_risk(spark, sf_dir):
    """Local activity weighted by national severity, top 15."""
    counts = view(spark, sf_dir, "counts").where(F.col("species_common_name").isNotNull())
    local = species.pooled_activity(counts.select(F.col("species_common_name").alias("species"), "count", "observation_hours"))
    strikes = labelled_raw(spark, sf_dir).withColumn("predicted_severity", F.col("damage_severity_score"))
    risk = species.species_risk(strikes, "SPECIES", fold_case=True)
    best = species.top(species.local_risk(local, risk), "local_risk_contribution", 15, ["species"])
    return best.select(
        "species", F.round("local_activity", 6).alias("local_activity"), "n_strikes", F.round("risk_score", 6).alias("risk_score"),
        "matched_species", F.round("local_risk_contribution", 6).alias("local_risk_contribution"),
    )


@query("species_risk", with_views("raw") + "," + NORMALISED + """
SELECT SPECIES AS species, count(severity) AS n_strikes, round(avg(severity), 6) AS mean_predicted_severity,
  round(avg(severity) * ln(1 + count(severity)), 6) AS risk_score FROM s GROUP BY 1""")
def species_risk(spark, sf_dir):
    """Risk per exact species spelling."""
    strikes = labelled_raw(spark, sf_dir).withColumn("predicted_severity", F.col("damage_severity_score"))
    return species.species_risk(strikes, "SPECIES").select(
        "species", "n_strikes", F.round("mean_predicted_severity", 6).alias("mean_predicted_severity"),
        F.round("risk_score", 6).alias("risk_score"),
    )


@query("alias_projected_strikes", with_views("export") + """
SELECT "INDEX NR" AS record_id, CAST(TRY_CAST("incident date" AS DATE) AS VARCHAR) AS incident_day, "TIME" AS incident_time_local, "AIRPORT CODE" AS airport_id,
  TRY_CAST(LAT AS DOUBLE) AS latitude, TRY_CAST("LONG" AS DOUBLE) AS longitude, TRY_CAST("HEIGHT (FT)" AS DOUBLE) AS height_agl_ft,
  DAMAGE_FLAG AS damage_flag, SPECIES_NAME AS species_common_name, CAST(NULL AS VARCHAR) AS engine_type, 9 AS n_resolved, 25 AS n_missing FROM v_export""")
def alias_projected_strikes(spark, sf_dir):
    """Header aliases resolved, everything coerced safely, absent fields null."""
    scan = canonical_strikes(view(spark, sf_dir, "export"))
    return scan.data.select(
        "record_id", F.to_date("incident_date").cast("string").alias("incident_day"), "incident_time_local", "airport_id", "latitude",
        "longitude", "height_agl_ft", "damage_flag", "species_common_name", "engine_type",
        F.lit(len(scan.resolved)).alias("n_resolved"), F.lit(len(scan.missing)).alias("n_missing"),
    )


@query("safe_coercion", with_views("export", "raw", "counts") + """
SELECT 'strikes' AS part, count(*) AS n, count(TRY_CAST("HEIGHT (FT)" AS DOUBLE)) AS numbers, count(TRY_CAST("incident date" AS DATE)) AS dates,
  count(*) FILTER (WHERE coalesce(TRY_CAST(LAT AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST("LONG" AS DOUBLE) BETWEEN -180 AND 180, false)) AS located,
  CAST(NULL AS BIGINT) AS positive_effort, CAST(NULL AS BIGINT) AS ordered_ranges FROM v_export
UNION ALL SELECT 'raw', count(*), count(TRY_CAST(HEIGHT AS DOUBLE)), count(TRY_CAST(INCIDENT_DATE AS DATE)),
  count(*) FILTER (WHERE coalesce(TRY_CAST(LATITUDE AS DOUBLE) BETWEEN -90 AND 90 AND TRY_CAST(LONGITUDE AS DOUBLE) BETWEEN -180 AND 180, false)), NULL, NULL FROM v_raw
UNION ALL SELECT 'counts', count(*), count(*) FILTER (WHERE "count" >= 0), count(count_date), NULL, count(*) FILTER (WHERE observation_hours > 0),
  count(*) FILTER (WHERE start_time_local <= end_time_local) FROM v_counts""")
def safe_coercion(spark, sf_dir):
    """Planted bad numbers, dates, coordinates and time ranges counted, none fatal."""
    none = F.lit(None).cast("bigint")

    def strikes(name, part, height, date, lat, lon):
        return view(spark, sf_dir, name).agg(
            F.count("*").alias("n"), F.count(coerce.number(F.col(height))).alias("numbers"),
            F.count_if(coerce.valid_timestamp(F.col(date))).alias("dates"),
            F.count_if(coerce.valid_coordinates(F.col(lat), F.col(lon))).alias("located"),
        ).select(F.lit(part).alias("part"), "*", none.alias("positive_effort"), none.alias("ordered_ranges"))

    counts = view(spark, sf_dir, "counts").agg(
        F.count("*").alias("n"), F.count_if(coerce.nonnegative(F.col("count"))).alias("numbers"),
        F.count_if(coerce.valid_timestamp(F.col("count_date"))).alias("dates"), none.alias("located"),
        F.count_if(coerce.positive(F.col("observation_hours"))).alias("positive_effort"),
        F.count_if(coerce.end_not_before_start(F.col("start_time_local"), F.col("end_time_local"))).alias("ordered_ranges"),
    ).select(F.lit("counts").alias("part"), "*")
    return strikes("export", "strikes", "HEIGHT (FT)", "incident date", "LAT", "LONG").unionByName(
        strikes("raw", "raw", "HEIGHT", "INCIDENT_DATE", "LATITUDE", "LONGITUDE")
    ).unionByName(counts)


@query("damage_target", with_views("strikes") + """,
f AS (SELECT upper(trim(damage_flag)) AS f FROM v_strikes),
g AS (SELECT CASE WHEN f IN ('Y','YES','TRUE','1','DAMAGE') THEN 1 WHEN f IN ('N','NO','FALSE','0','NONE','N/A - NO DAMAGE') THEN 0 END AS damage FROM f)
SELECT damage, CASE damage WHEN 1 THEN 'explicit_positive' WHEN 0 THEN 'explicit_negative' ELSE 'missing_or_ambiguous' END AS damage_target_status, count(*) AS n FROM g GROUP BY 1, 2""")
def damage_target(spark, sf_dir):
    """Three-valued target of the canonical flag."""
    return targets.damage_target(view(spark, sf_dir, "strikes")).groupBy("damage", "damage_target_status").agg(F.count("*").alias("n"))


@query("ga_damage_target", with_views("raw") + "," + NORMALISED + """
SELECT INDEX_NR AS record_id, damage_binary, status AS damage_target_status, bad AS damage_level_inconsistent FROM t""")
def ga_damage_target(spark, sf_dir):
    """Indicated damage cross-checked against the level, never changed by it."""
    return labelled_raw(spark, sf_dir).select(
        F.col("INDEX_NR").alias("record_id"), "damage_binary", "damage_target_status", "damage_level_inconsistent"
    )


@query("severity_target", with_views("raw") + "," + NORMALISED + "SELECT INDEX_NR AS record_id, severity AS damage_severity_score FROM s")
def severity_target(spark, sf_dir):
    """Ordinal severity, null unless flag and level agree (P10)."""
    return labelled_raw(spark, sf_dir).select(F.col("INDEX_NR").alias("record_id"), "damage_severity_score")


@query("target_summary", with_views("raw") + "," + NORMALISED + """
SELECT count(*) FILTER (WHERE damage_binary = 1) AS n_positive, count(*) FILTER (WHERE damage_binary = 0) AS n_negative,
  count(*) FILTER (WHERE damage_binary IS NULL) AS n_excluded_unknown, count(*) FILTER (WHERE bad) AS n_inconsistent, round(avg(damage_binary), 6) AS positive_rate FROM t""")
def target_summary(spark, sf_dir):
    """Class balance and conflicts."""
    return targets.target_summary(labelled_raw(spark, sf_dir)).withColumn("positive_rate", F.round("positive_rate", 6))


@query("eligible_rows", with_views("raw") + "," + NORMALISED + """
SELECT CASE WHEN damage_binary IS NULL THEN 'excluded' ELSE 'eligible' END AS part, count(*) AS n, round(sum(TRY_CAST(HEIGHT AS DOUBLE)), 3) AS height_sum FROM t GROUP BY 1""")
def eligible_rows(spark, sf_dir):
    """Rows with a label and without one, both kept."""
    kept, left_out = targets.eligible_and_excluded(labelled_raw(spark, sf_dir), "damage_binary")
    parts = kept.withColumn("part", F.lit("eligible")).unionByName(left_out.withColumn("part", F.lit("excluded")))
    return parts.groupBy("part").agg(F.count("*").alias("n"), F.round(F.sum("HEIGHT"), 3).alias("height_sum"))


@query("population_counts", with_views("raw") + """,
p AS (SELECT upper(trim(OPERATOR)) IN ('BUSINESS','PRIVATELY OWNED') AS a, upper(trim(AC_CLASS)) = 'A' AS b, trim(AC_MASS) IN ('1','2') AS c, upper(trim(TYPE_ENG)) = 'A' AS d FROM v_raw)
SELECT 'confirmed_business_or_private' AS population, count(*) FILTER (WHERE a) AS n FROM p
UNION ALL SELECT 'confirmed_business_or_private_fixed_wing', count(*) FILTER (WHERE a AND b) FROM p
UNION ALL SELECT 'light_fixed_wing_ga', count(*) FILTER (WHERE a AND b AND c) FROM p
UNION ALL SELECT 'light_piston_ga', count(*) FILTER (WHERE a AND b AND c AND d) FROM p""")
def population_counts(spark, sf_dir):
    """Four nested populations from one pass."""
    return targets.population_counts(targets.normalise_raw(view(spark, sf_dir, "raw")))


@query("principal_population", with_views("raw") + """
SELECT INDEX_NR AS record_id, upper(trim(AIRCRAFT)) AS aircraft, TRY_CAST(HEIGHT AS DOUBLE) AS height, TRY_CAST(INCIDENT_YEAR AS DOUBLE) AS incident_year
FROM v_raw WHERE upper(trim(OPERATOR)) IN ('BUSINESS','PRIVATELY OWNED') AND upper(trim(AC_CLASS)) = 'A'""")
def principal_population(spark, sf_dir):
    """The training population with normalised columns."""
    rows = targets.principal_population(targets.normalise_raw(view(spark, sf_dir, "raw")))
    return rows.select(
        F.col("INDEX_NR").alias("record_id"), F.col("AIRCRAFT").alias("aircraft"), F.col("HEIGHT").alias("height"),
        F.col("INCIDENT_YEAR").alias("incident_year"),
    )


@query("counts_validation_report", with_views("counts", "sites") + """,
j AS (SELECT c.*, s.site_id AS known, s.latitude, s.longitude FROM v_counts c LEFT JOIN v_sites s USING (site_id)),
d AS (SELECT count(*) AS n FROM v_counts GROUP BY site_id, count_date, start_time_local, species_scientific_name HAVING count(*) > 1)
SELECT 'n_rows' AS metric, count(*) AS n FROM j
UNION ALL SELECT 'n_invalid_coordinates', count(*) FILTER (WHERE known IS NULL) FROM j
UNION ALL SELECT 'n_negative_counts', count(*) FILTER (WHERE "count" < 0) FROM j
UNION ALL SELECT 'n_invalid_time_ranges', count(*) FILTER (WHERE end_time_local < start_time_local) FROM j
UNION ALL SELECT 'n_nonpositive_effort', count(*) FILTER (WHERE observation_hours <= 0) FROM j
UNION ALL SELECT 'n_unresolved_site_ids', count(DISTINCT CASE WHEN known IS NULL THEN site_id END) FROM j
UNION ALL SELECT 'duplicate_sessions', CAST(coalesce(sum(n), 0) AS BIGINT) FROM d""")
def counts_validation_report(spark, sf_dir):
    """Eight checks of a count table, nothing dropped."""
    return quality.counts_report(view(spark, sf_dir, "counts"), view(spark, sf_dir, "sites"))


@query("count_types", with_views("counts") + """
SELECT count_type, count(*) AS n, count_type IN ('visible_migration','capture','nocturnal_flight_call','other') AS recognised FROM v_counts GROUP BY 1""")
def count_types(spark, sf_dir):
    """Rows per count type, unknown types kept and flagged."""
    return quality.count_type_report(view(spark, sf_dir, "counts"))


@query("unresolved_sites", with_views("counts", "sites") + """
SELECT DISTINCT CAST(site_id AS VARCHAR) AS site_id FROM v_counts WHERE site_id NOT IN (SELECT site_id FROM v_sites)""")
def unresolved_sites(spark, sf_dir):
    """Site ids counted at but unknown."""
    return quality.unresolved_ids(view(spark, sf_dir, "counts"), view(spark, sf_dir, "sites"), "site_id")


@query("schema_validation", with_views("strikes", "airports") + """,
d AS (SELECT airport_id, CAST(incident_date AS DATE) AS date, count(*) AS n FROM v_strikes GROUP BY 1, 2),
r AS (SELECT d.*, a.latitude, a.longitude FROM d LEFT JOIN v_airports a USING (airport_id))
SELECT 'n_rows' AS "check", 'rows' AS subject, CAST(count(*) AS DOUBLE) AS value FROM r
UNION ALL SELECT 'duplicate_keys', 'rows', 0
UNION ALL SELECT 'unexpected_dtype', 'airport_id:bigint', 1
UNION ALL SELECT 'invalid_coordinates', 'rows', count(*) FILTER (WHERE latitude IS NULL) FROM r
UNION ALL SELECT 'invalid_timestamp', 'date', 0
UNION ALL SELECT 'companion_violation', 'estimated_abundance', count(*) FILTER (WHERE n > 1) FROM r
UNION ALL SELECT 'missing_fraction', c, 0 FROM (SELECT unnest(['airport_id','date','observation_id','strike_count','strike_count_basis','injury_flag','species_involved']) AS c)
UNION ALL SELECT 'missing_fraction', c, 0 FROM (SELECT unnest(['latitude','longitude']) AS c)
UNION ALL SELECT 'missing_fraction', 'bird_data_resolution', 1
UNION ALL SELECT 'missing_fraction', 'estimated_abundance', round(count(*) FILTER (WHERE n <= 1) / count(*), 4) FROM r
UNION ALL SELECT 'missing_fraction', 'damage_rate_given_strike', (SELECT round(count(*) FILTER (WHERE k = 0) / count(*), 4) FROM (SELECT count(CASE WHEN f IS NOT NULL THEN 1 END) AS k
  FROM (SELECT airport_id, CAST(incident_date AS DATE) AS date, CASE WHEN upper(trim(damage_flag)) IN ('Y','YES','TRUE','1','N','NO','FALSE','NONE') THEN 1 END AS f FROM v_strikes) GROUP BY airport_id, date))
UNION ALL SELECT 'is_clean', 'all', CASE WHEN count(*) FILTER (WHERE n > 1 OR latitude IS NULL) = 0 THEN 1 ELSE 0 END FROM r""")
def schema_validation(spark, sf_dir):
    """Airport-day rows against their declared schema, with planted companion violations."""
    days = quality.airport_days(targets.damage_target(view(spark, sf_dir, "strikes")), view(spark, sf_dir, "airports"))
    planted = days.withColumns({
        "estimated_abundance": F.when(F.col("strike_count") > 1, F.col("strike_count")),
        "bird_data_resolution": F.lit(None).cast("string"),
    })
    return quality.validate(
        planted, AIRPORT_DAY, required=["airport_id", "date", "observation_id", "latitude", "longitude"], lat="latitude", lon="longitude",
        timestamps=["date"], keys=["airport_id", "date"], companions=[("estimated_abundance", "bird_data_resolution")],
    )


@query("duplicate_keys", """
SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    """Keys with more than one row and all their copies."""
    return quality.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("missingness", with_views("raw") + "SELECT c AS \"column\", n AS n_missing, round(n * 100e0 / t, 2) AS pct_missing FROM ("
       + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER (WHERE {c} IS NULL) AS n, count(*) AS t FROM v_raw" for c in column_names("raw")) + ")")
def missingness(spark, sf_dir):
    """Null counts and shares of every column in one pass."""
    return quality.missingness(view(spark, sf_dir, "raw"))


@query("value_counts", with_views("raw") + """
SELECT SPECIES AS value, count(*) AS n FROM v_raw GROUP BY 1 ORDER BY n DESC, value ASC NULLS LAST LIMIT 20""")
def value_counts(spark, sf_dir):
    """Most frequent values including null."""
    return quality.value_counts(view(spark, sf_dir, "raw"), "SPECIES")


@query("airport_day_rollup", with_views("strikes", "airports") + """,
f AS (SELECT *, CASE WHEN upper(trim(damage_flag)) IN ('Y','YES','TRUE','1') THEN 1 WHEN upper(trim(damage_flag)) IN ('N','NO','FALSE','NONE') THEN 0 END AS d FROM v_strikes)
SELECT f.airport_id, strftime(incident_date, '%Y-%m-%d') AS day, concat(CAST(f.airport_id AS VARCHAR), '_', strftime(incident_date, '%Y-%m-%d')) AS observation_id, CAST(count(*) AS DOUBLE) AS strike_count,
  round(avg(d), 6) AS damage_rate_given_strike, bool_or(injuries > 0) AS injury_flag, string_agg(DISTINCT species, ',' ORDER BY species) AS species_involved
FROM f GROUP BY f.airport_id, strftime(incident_date, '%Y-%m-%d')""")
def airport_day_rollup(spark, sf_dir):
    """Strike facts per airport and day."""
    days = quality.airport_days(targets.damage_target(view(spark, sf_dir, "strikes")))
    return days.select(
        "airport_id", F.date_format("date", "yyyy-MM-dd").alias("day"), "observation_id", "strike_count",
        F.round("damage_rate_given_strike", 6).alias("damage_rate_given_strike"), "injury_flag", "species_involved",
    )


@query("seasonal_rollup", with_views("raw") + "," + NORMALISED + """
SELECT TRY_CAST(INCIDENT_MONTH AS DOUBLE) AS month, count(damage_binary) AS n_strikes, round(avg(damage_binary), 6) AS damage_rate FROM t WHERE INCIDENT_MONTH IS NOT NULL GROUP BY 1""")
def seasonal_rollup(spark, sf_dir):
    """Strikes and damage rate per month."""
    return eda.seasonal_rollup(labelled_raw(spark, sf_dir), "INCIDENT_MONTH", "damage_binary").withColumn("damage_rate", F.round("damage_rate", 6))


@query("confounding", with_views("raw") + "," + NORMALISED + """,
g AS (SELECT SPECIES AS g, count(damage_binary) AS n, avg(damage_binary) AS r FROM t WHERE SPECIES IS NOT NULL GROUP BY 1 HAVING count(damage_binary) >= 30)
(SELECT 'highest' AS "end", g AS "group", n, round(r, 6) AS rate FROM g ORDER BY r DESC, g LIMIT 5)
UNION ALL (SELECT 'lowest', g, n, round(r, 6) FROM g ORDER BY r, g DESC LIMIT 5)""")
def confounding(spark, sf_dir):
    """Highest and lowest damage rates by species with enough rows."""
    return eda.extremes(labelled_raw(spark, sf_dir), "SPECIES", "damage_binary").withColumn("rate", F.round("rate", 6))


@query("rate_ranges", with_views("raw") + "," + NORMALISED + """,
y AS (SELECT TRY_CAST(INCIDENT_YEAR AS DOUBLE) AS g, avg(damage_binary) AS r FROM t WHERE INCIDENT_YEAR IS NOT NULL GROUP BY 1),
a AS (SELECT STATE AS g, avg(damage_binary) AS r FROM t GROUP BY 1 HAVING count(damage_binary) >= 30)
SELECT 'INCIDENT_YEAR' AS "key", count(*) AS n_groups, round(min(r), 6) AS low, round(max(r), 6) AS high FROM y
UNION ALL SELECT 'STATE', count(*), round(min(r), 6), round(max(r), 6) FROM a""")
def rate_ranges(spark, sf_dir):
    """Range of damage rates over years and states."""
    rows = labelled_raw(spark, sf_dir)
    both = eda.rate_range(rows, "INCIDENT_YEAR", "damage_binary").unionByName(eda.rate_range(rows, "STATE", "damage_binary", 30))
    return both.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


_RANKS = "".join(
    f"p{i} AS (SELECT '{a}' AS a, '{b}' AS b, rx, ry FROM (SELECT {x} AS x, {y} AS y, "
    f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2e0 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2e0 AS ry "
    f"FROM q WHERE {x} IS NOT NULL AND {y} IS NOT NULL)), "
    for i, (a, b, x, y) in enumerate([
        ("HEIGHT", "SPEED", "h", "s"), ("HEIGHT", "NUM_ENGS", "h", "e"), ("HEIGHT", "damage_binary", "h", "d"),
        ("SPEED", "NUM_ENGS", "s", "e"), ("SPEED", "damage_binary", "s", "d"), ("NUM_ENGS", "damage_binary", "e", "d"),
    ])
)


@query("spearman", with_views("raw") + "," + NORMALISED + """,
q AS (SELECT TRY_CAST(HEIGHT AS DOUBLE) AS h, TRY_CAST(SPEED AS DOUBLE) AS s, TRY_CAST(NUM_ENGS AS DOUBLE) AS e, damage_binary AS d FROM t), """ + _RANKS + """
u AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4 UNION ALL SELECT * FROM p5)
SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM u GROUP BY 1, 2""")
def spearman(spark, sf_dir):
    """Pairwise-complete rank correlations."""
    return eda.spearman(labelled_raw(spark, sf_dir), ["HEIGHT", "SPEED", "NUM_ENGS", "damage_binary"]).withColumn("rho", F.round("rho", 6))


@query("leakage_smoke", with_views("raw") + "," + NORMALISED + """
SELECT 'DAMAGE_LEVEL' AS "column", 'categorical' AS kind, round(avg(CASE WHEN DAMAGE_LEVEL IS NOT NULL THEN damage_binary END), 6) AS present_rate,
  round(avg(CASE WHEN DAMAGE_LEVEL IS NULL THEN damage_binary END), 6) AS absent_rate, CAST(NULL AS DOUBLE) AS correlation FROM t
UNION ALL SELECT 'NR_INJURIES', 'categorical', round(avg(CASE WHEN NR_INJURIES IS NOT NULL THEN damage_binary END), 6), round(avg(CASE WHEN NR_INJURIES IS NULL THEN damage_binary END), 6), NULL FROM t
UNION ALL SELECT 'damage_severity_score', 'numeric', NULL, NULL, round(corr(severity, damage_binary), 3) FROM s""")
def leakage_smoke(spark, sf_dir):
    """How predictive barred columns are of the target, one pass."""
    out = eda.leakage_smoke(labelled_raw(spark, sf_dir), ["DAMAGE_LEVEL", "NR_INJURIES", "damage_severity_score"], "damage_binary")
    return out.withColumns({"present_rate": F.round("present_rate", 6), "absent_rate": F.round("absent_rate", 6)})


@query("class_histogram", with_views("raw") + "," + NORMALISED + """,
q AS (SELECT TRY_CAST(HEIGHT AS DOUBLE) AS v, damage_binary AS c FROM t WHERE TRY_CAST(HEIGHT AS DOUBLE) IS NOT NULL AND damage_binary IS NOT NULL),
l AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM q)
SELECT c AS class, CAST(least(floor((v - lo) / w), 29) + 1 AS INT) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY c) * max(w)), 9) AS density FROM q, l GROUP BY 1, 2""")
def class_histogram(spark, sf_dir):
    """Height distribution by damage class."""
    return eda.class_histogram(labelled_raw(spark, sf_dir), "HEIGHT", "damage_binary").withColumn("density", F.round("density", 9))


_GROUP = "CASE trim(species_scientific_name) " + " ".join(
    f"WHEN '{s}' THEN '{g}'" for s, g in zip(SCIENTIFIC, ["waterfowl"] * 4 + ["gull"] * 3 + ["raptor"] * 4 + ["large_bird"] * 3 + ["songbird"] * 5 + ["other"] * 2)
) + " ELSE 'unknown' END"


@query("taxonomy_groups", with_views("counts") + f"""
SELECT {_GROUP} AS species_group, {_GROUP} IN ('large_bird','waterfowl','raptor') AS is_large, count(*) AS n, CAST(sum("count") AS BIGINT) AS birds,
  count(CASE WHEN species_common_name <> 'Hoopoe' THEN 1 END) AS n_named FROM v_counts GROUP BY 1, 2""")
def taxonomy_groups(spark, sf_dir):
    """Documented species groups, everything else unknown."""
    name = F.col("species_scientific_name")
    return view(spark, sf_dir, "counts").groupBy(species_group(name).alias("species_group"), is_large_bird(name).alias("is_large")).agg(
        F.count("*").alias("n"), F.sum("count").alias("birds"), F.count(species_common_name(name)).alias("n_named")
    )
