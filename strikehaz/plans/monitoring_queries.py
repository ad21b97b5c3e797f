"""Monitoring-side queries: reshaping, effort rates, annual text, crosstabs, versions, provenance join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.fixed_values import CROSSTAB_METRICS, MONTHS
from strikehaz.operators import reshape, species, targets
from strikehaz.plans import geosql
from strikehaz.plans.registry import query
from strikehaz.plans.views import COMMON, table, view, with_views
from strikehaz.sources import monitoring

YEARS = monitoring.YEARS
STATION = (-76.0, 39.2)
WIDE_SPECIES = [*COMMON, "Hoopoe"]


def moves_by(spark, sf_dir, *keys: str, value=None) -> DataFrame:
    """Birds per species label and the given keys; line items are summed per part before they meet the part table."""
    value = value if value is not None else F.col("birds")
    per_part = view(spark, sf_dir, "moves").groupBy("part_id", *keys).agg(F.sum(value).alias("birds"))
    return per_part.join(view(spark, sf_dir, "species_of_part"), "part_id").groupBy("species", *keys).agg(F.sum("birds").alias("birds"))


def season_table(spark, sf_dir) -> DataFrame:
    """Season totals in the discriminated wide layout: species rows, a totals row and an effort row."""
    months = list(range(1, 13))
    wide = moves_by(spark, sf_dir, "month").groupBy("species").pivot("month", months).agg(F.sum("birds"))
    named = wide.select(F.lit("species").alias("row_type"), "species", *[F.coalesce(F.col(str(m)), F.lit(0)).cast("string").alias(MONTHS[m - 1]) for m in months])
    orders = table(spark, sf_dir, "orders")
    minutes = orders.groupBy().agg(*[
        F.count_if((F.month("o_orderdate") == m) & ~F.lit(m in (6, 7))).alias(str(m)) for m in months
    ])
    effort = minutes.select(
        F.lit("observation_hours").alias("row_type"), F.lit("Observation hours").alias("species"),
        *[F.format_string("%d:%02d", F.floor(F.col(str(m)) / 60), F.col(str(m)) % 60).alias(MONTHS[m - 1]) for m in months],
    )
    totals = named.groupBy().agg(*[F.sum(F.col(m).try_cast("bigint")).cast("string").alias(m) for m in MONTHS]).select(
        F.lit("totals").alias("row_type"), F.lit("Totals").alias("species"), *MONTHS
    )
    return named.unionByName(totals).unionByName(effort)


_SEASON = with_views("moves", "species_of_part") + """,
b AS (SELECT species, month, sum(birds) AS birds FROM v_moves JOIN v_species_of_part USING (part_id) GROUP BY 1, 2),
m AS (SELECT unnest(range(1, 13)) AS month),
e AS (SELECT m.month, count(*) FILTER (WHERE month(o_orderdate) = m.month AND m.month NOT IN (6, 7)) / 60e0 AS hours FROM m CROSS JOIN orders GROUP BY 1),
n AS (SELECT unnest(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec']) AS name, unnest(range(1, 13)) AS month),
x AS (SELECT DISTINCT species FROM b),
l AS (SELECT x.species, n.name AS month, CAST(coalesce(b.birds, 0) AS DOUBLE) AS c, e.hours FROM x CROSS JOIN n JOIN e USING (month) LEFT JOIN b ON b.species = x.species AND b.month = n.month)
"""


@query("season_rates", _SEASON + """SELECT species, month, c AS "count", round(hours, 6) AS observation_hours, hours > 0 AS monitored,
  CASE WHEN hours > 0 THEN round(c / hours, 6) END AS count_per_hour FROM l""")
def season_rates(spark, sf_dir):
    """Wide season to long with effort; unmonitored months have no rate."""
    return monitoring.season_long(season_table(spark, sf_dir)).withColumns({
        "observation_hours": F.round("observation_hours", 6), "count_per_hour": F.round("count_per_hour", 6)
    })


@query("season_pooled", _SEASON + """SELECT species, sum(c) AS total_count, round(sum(hours), 6) AS total_hours, count(*) AS n_source_rows, round(sum(c) / sum(hours), 6) AS local_activity
  FROM l WHERE hours > 0 GROUP BY 1""")
def season_pooled(spark, sf_dir):
    """One pooled rate per species over monitored months."""
    return species.pooled_activity(monitoring.season_long(season_table(spark, sf_dir))).withColumns({
        "total_hours": F.round("total_hours", 6), "local_activity": F.round("local_activity", 6)
    })


def wide_sessions(spark, sf_dir) -> DataFrame:
    """Counts as a wide export: one row per session, one column per species."""
    counts = view(spark, sf_dir, "counts").where(F.col("species_common_name").isNotNull())
    keys = ["site_id", "count_date", "start_time_local", "count_type"]
    return counts.groupBy(*keys).pivot("species_common_name", WIDE_SPECIES).agg(F.sum("count"))


@query("wide_to_long_counts", with_views("counts") + """,
s AS (SELECT site_id, count_date, start_time_local, count_type, species_common_name, sum("count") AS c FROM v_counts
  WHERE species_common_name IS NOT NULL GROUP BY ALL),
k AS (SELECT *, list_position([""" + ", ".join(f"'{n}'" for n in WIDE_SPECIES) + """], species_common_name) AS pos FROM s WHERE c > 0)
SELECT site_id, strftime(count_date, '%Y-%m-%d') AS day, start_time_local, count_type, species_common_name, CAST(c AS DOUBLE) AS "count",
  'WIDE' || lpad(CAST(row_number() OVER (ORDER BY pos, site_id NULLS FIRST, count_date NULLS FIRST, start_time_local NULLS FIRST, count_type NULLS FIRST) - 1 AS VARCHAR), 6, '0') AS count_id FROM k""")
def wide_to_long_counts(spark, sf_dir):
    """Wide export to long: zeros go, ids are made up in column and session order."""
    long = reshape.wide_counts_to_long(wide_sessions(spark, sf_dir), ["site_id", "count_date", "start_time_local", "count_type"])
    return long.select(
        "site_id", F.date_format("count_date", "yyyy-MM-dd").alias("day"), "start_time_local", "count_type", "species_common_name", "count", "count_id"
    )


@query("composite_species", """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat(split_part(p_name, ' ', 1), '/', p_brand, ' ', p_type) WHEN 1 THEN concat(p_name, ' (', p_type, ')')
  WHEN 2 THEN concat(p_name, ' / ', p_type, ' ', p_brand) ELSE p_name END AS label FROM part),
c AS (SELECT p_partkey, trim(regexp_replace(label, '\\s*\\([^)]*\\)\\s*$', '')) AS label FROM p),
h AS (SELECT p_partkey, label, trim(split_part(label, '/', 1)) AS a, trim(substr(label, strpos(label, '/') + 1)) AS b, strpos(label, '/') > 0 AS pair FROM c)
SELECT p_partkey AS part_id, unnest(CASE WHEN NOT pair THEN [label] WHEN strpos(a, ' ') = 0 AND strpos(b, ' ') > 0 THEN [concat(a, ' ', substr(b, strpos(b, ' ') + 1)), b] ELSE [a, b] END) AS species FROM h""")
def composite_species(spark, sf_dir):
    """Tagged and paired labels to plain names."""
    part = table(spark, sf_dir, "part")
    label = F.expr(
        "CASE p_partkey % 4 WHEN 0 THEN concat(split_part(p_name, ' ', 1), '/', p_brand, ' ', p_type) WHEN 1 THEN concat(p_name, ' (', p_type, ')') "
        "WHEN 2 THEN concat(p_name, ' / ', p_type, ' ', p_brand) ELSE p_name END"
    )
    return species.expand_species(part.select(label.alias("species"), F.col("p_partkey").alias("part_id"))).select("part_id", "species")


# --- annual text: lines rendered from the tables, then parsed -------------------

def annual_lines(spark, sf_dir, files: dict[str, str] | None = None) -> DataFrame:
    """Fixed-layout text lines, one per species and file; `files` maps a line status to a file name."""
    files = files or {"F": "annual_1.txt", "O": "annual_2.txt"}
    by_year = moves_by(spark, sf_dir, "year", "linestatus")
    wide = by_year.groupBy("species", "linestatus").pivot("year", YEARS).agg(F.sum("birds"))
    c = [F.coalesce(F.col(str(y)), F.lit(0)) for y in YEARS]
    total = c[0]
    for x in c[1:]:
        total = total + x
    top = F.greatest(*c)
    best = F.coalesce(*[F.when(x == top, y) for x, y in zip(c, YEARS)])
    file = F.when(F.col("linestatus") == "F", files["F"]).otherwise(files["O"])
    line = F.concat(
        F.lit("   7  "), F.col("species"), F.lit("   "), F.concat_ws("  ", *[x.cast("string") for x in c]), F.lit("   "), total.cast("string"),
        F.lit("  "), F.format_string("%.1f", total / 10.0), F.lit("  "), F.floor(total / 3).cast("string"), F.lit("  "),
        (total - F.floor(total / 3)).cast("string"), F.lit("  "), top.cast("string"), F.lit(" ("), best.cast("string"), F.lit(") "),
    )
    species_lines = wide.select(line.alias("line"), file.alias("source_file"))
    sums = wide.groupBy("linestatus").agg(*[F.coalesce(F.sum(str(y)), F.lit(0)).alias(f"y{y}") for y in YEARS])
    s = [F.col(f"y{y}") for y in YEARS]
    all_years = s[0]
    for x in s[1:]:
        all_years = all_years + x
    totals = sums.select(F.concat(
        F.lit("Totals  "), F.concat_ws("  ", *[x.cast("string") for x in s]), F.lit("  "), all_years.cast("string"), F.lit("  "),
        F.format_string("%.1f", all_years / 10.0), F.lit("  1  2"),
    ).alias("line"), file.alias("source_file"))
    # the last four years are monitored; hours follow the yearly totals
    hhmm = [F.concat(F.format_number(F.floor(x / 60), 0), F.lit(":"), F.format_string("%02d", x % 60)) for x in [*s[-4:], all_years, F.floor(all_years / 4)]]
    effort = sums.select(F.concat(F.lit("Observation hours   "), F.concat_ws("   ", *hhmm)).alias("line"), file.alias("source_file"))
    noise = sums.select(F.lit("Species  2016 2017 (years as reported)").alias("line"), file.alias("source_file"))
    lines = species_lines.unionByName(totals).unionByName(effort).unionByName(noise)
    return lines.withColumn("modified", F.when(F.col("source_file") == files["F"], 1).otherwise(2))


_ANNUAL = with_views("moves", "species_of_part") + """,
b AS (SELECT species, linestatus, year, sum(birds) AS birds FROM v_moves JOIN v_species_of_part USING (part_id) GROUP BY ALL),
y AS (SELECT CAST(unnest(range(2016, 2026)) AS INT) AS year),
k AS (SELECT DISTINCT species, linestatus FROM b),
w AS (SELECT k.species, k.linestatus, y.year, CAST(coalesce(b.birds, 0) AS BIGINT) AS c FROM k CROSS JOIN y LEFT JOIN b ON b.species = k.species AND b.linestatus = k.linestatus AND b.year = y.year),
t AS (SELECT linestatus, year, sum(c) AS c FROM w GROUP BY 1, 2),
l AS (SELECT w.*, CASE WHEN linestatus = 'F' THEN 'annual_1.txt' ELSE 'annual_2.txt' END AS source_file, CASE WHEN w.year >= 2022 THEN t.c / 60e0 END AS hours FROM w JOIN t USING (linestatus, year))
"""


@query("annual_text_parse", _ANNUAL + """SELECT species, source_file, CAST(sum(c) AS BIGINT) AS total, round(floor(sum(c) + 5e-1) / 10, 1) AS average, CAST(floor(sum(c) / 3) AS BIGINT) AS newly_ringed,
  CAST(max(c) AS BIGINT) AS year_max_count, min_by(year, (-c, year)) AS year_max_year FROM l GROUP BY 1, 2""")
def annual_text_parse(spark, sf_dir):
    """Species rows read back from fixed-layout lines."""
    return monitoring.career_summary(annual_lines(spark, sf_dir)).select(
        "species", "source_file", "total", "average", "newly_ringed", "year_max_count", "year_max_year"
    )


@query("annual_totals", _ANNUAL + """SELECT source_file, CAST(sum(c) FILTER (WHERE year = 2016) AS BIGINT) AS year_2016, CAST(sum(c) FILTER (WHERE year = 2022) AS BIGINT) AS year_2022, CAST(sum(c) AS BIGINT) AS total
  FROM l GROUP BY 1""")
def annual_totals(spark, sf_dir):
    """Totals rows of the annual text."""
    return monitoring.annual_totals(annual_lines(spark, sf_dir)).select("source_file", "year_2016", "year_2022", "total")


@query("annual_rates", _ANNUAL + """SELECT species, year, source_file, c AS "count", round(hours, 6) AS observation_hours, coalesce(hours > 0, false) AS monitored,
  CASE WHEN hours > 0 THEN round(c / hours, 6) END AS count_per_hour FROM l""")
def annual_rates(spark, sf_dir):
    """Annual lines to long with right-aligned effort; years without effort are unmonitored."""
    long = monitoring.annual_long(annual_lines(spark, sf_dir))
    return long.select(
        "species", "year", "source_file", "count", F.round("observation_hours", 6).alias("observation_hours"), "monitored",
        F.round("count_per_hour", 6).alias("count_per_hour"),
    )


_NEWEST = """, v AS (SELECT *, row_number() OVER (PARTITION BY species, year ORDER BY source_file DESC) AS rn FROM l)"""


@query("version_merge", _ANNUAL + _NEWEST + " SELECT species, year, c AS \"count\", source_file FROM v WHERE rn = 1")
def version_merge(spark, sf_dir):
    """Newest file wins per species and year."""
    return monitoring.merge_annual(monitoring.annual_long(annual_lines(spark, sf_dir))).select("species", "year", "count", "source_file")


@query("version_conflicts", _ANNUAL + " SELECT species, year, count(DISTINCT c) AS n_distinct_values FROM l GROUP BY 1, 2 HAVING count(DISTINCT c) > 1")
def version_conflicts(spark, sf_dir):
    """Species and years two files disagree on."""
    return reshape.version_conflicts(monitoring.annual_long(annual_lines(spark, sf_dir)), ["species", "year"], "count")


@query("annual_pooled", _ANNUAL + _NEWEST + """ SELECT species, CAST(sum(c) AS DOUBLE) AS total_count, round(sum(hours), 6) AS total_hours, count(*) AS n_source_rows,
  round(sum(c) / sum(hours), 6) AS local_activity FROM v WHERE rn = 1 AND hours > 0 GROUP BY 1""")
def annual_pooled(spark, sf_dir):
    """Pooled multi-year rate per species from the merged files."""
    merged = monitoring.merge_annual(monitoring.annual_long(annual_lines(spark, sf_dir)))
    return species.pooled_activity(merged).select(
        "species", F.col("total_count").cast("double").alias("total_count"), F.round("total_hours", 6).alias("total_hours"), "n_source_rows",
        F.round("local_activity", 6).alias("local_activity"),
    )


@query("pooled_hours", _ANNUAL + " SELECT round(sum(h), 6) AS pooled_hours, count(DISTINCT y) AS monitored_periods FROM (SELECT DISTINCT year AS y, hours AS h FROM l WHERE hours > 0)")
def pooled_hours(spark, sf_dir):
    """Effort with each (year, hours) once."""
    return reshape.distinct_hours(monitoring.annual_long(annual_lines(spark, sf_dir))).withColumn("pooled_hours", F.round("pooled_hours", 6))


# --- crosstab ------------------------------------------------------------------

def crosstab_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(sheet rows, index) as the workbook export has them: 12 months and 'All months', three stacked blocks."""
    label = {v: k for k, v in CROSSTAB_METRICS.items()}
    ringed = F.col("returnflag") == "N"
    by_month = moves_by(spark, sf_dir, "year", "month", "returnflag")
    blocks = F.array(F.lit(label["combined"]), F.when(ringed, label["newly_ringed"]).otherwise(label["retraps"]))
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(i + 1), F.lit(m))])
    presets = F.array(F.lit("All months"), months[F.col("month")])
    cells = by_month.withColumn("Metric", F.explode(blocks)).withColumn("period_label", F.explode(presets))
    sheet = cells.groupBy("Metric", F.col("species").alias("Species"), "period_label").pivot("year", YEARS).agg(F.sum("birds"))
    subtotal = cells.groupBy("Metric", "period_label").agg(F.sum("birds").alias("n")).select(
        F.concat(F.lit("TOTAL — "), "Metric").alias("Metric"), F.lit(None).cast("string").alias("Species"), "period_label",
        *[F.col("n").alias(str(y)) if y == YEARS[-1] else F.lit(None).cast("bigint").alias(str(y)) for y in YEARS],
    )
    rows = sheet.unionByName(subtotal).withColumn("source_file", F.concat("period_label", F.lit(".csv")))
    code = F.when(F.col("period_label") == "All months", 0).otherwise(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.col("period_label")))
    index = cells.groupBy("period_label").agg(*[
        F.sum(F.when(F.col("Metric") == label[m], F.col("birds")).otherwise(0)).alias(f"total_{m}") for m in ("combined", "newly_ringed", "retraps")
    ]).where(F.col("period_label") != "dec").withColumn("period_code", code.cast("int"))
    return rows, index


_CROSSTAB = with_views("moves", "species_of_part") + """,
b AS (SELECT species, year, month, returnflag, sum(birds) AS birds FROM v_moves JOIN v_species_of_part USING (part_id) GROUP BY ALL),
a AS (SELECT species, year, birds, unnest(['combined', CASE WHEN returnflag = 'N' THEN 'newly_ringed' ELSE 'retraps' END]) AS metric, returnflag, month FROM b),
c AS (SELECT species, year, birds, metric, unnest([0, month]) AS period_code FROM a)
"""


@query("crosstab_facts", _CROSSTAB + "SELECT species, year, CAST(period_code AS INT) AS period_code, metric, CAST(sum(birds) AS DOUBLE) AS \"count\" FROM c WHERE period_code <> 12 GROUP BY ALL")
def crosstab_facts(spark, sf_dir):
    """Preset sheets to facts; unlisted sheets and total rows are skipped."""
    rows, index = crosstab_tables(spark, sf_dir)
    long = reshape.crosstab_to_long(rows, [str(y) for y in YEARS], index)
    return long.select("species", "year", "period_code", "metric", "count")


@query("crosstab_reconcile", _CROSSTAB + """SELECT CAST(period_code AS INT) AS period_code, metric, CAST(sum(birds) AS BIGINT) AS listed, CAST(sum(birds) AS DOUBLE) AS counted, true AS matches
  FROM c WHERE period_code <> 12 GROUP BY 1, 2""")
def crosstab_reconcile(spark, sf_dir):
    """Facts summed per preset and metric against the index totals."""
    rows, index = crosstab_tables(spark, sf_dir)
    return reshape.crosstab_mismatches(reshape.crosstab_to_long(rows, [str(y) for y in YEARS], index), index)


# --- provenance join -------------------------------------------------------------

def season_activity(spark, sf_dir) -> DataFrame:
    """Long species x month activity from the counts, with one month unmonitored per species group."""
    counts = view(spark, sf_dir, "counts").where(F.col("species_common_name").isNotNull())
    month = F.try_element_at(F.array(*[F.lit(m) for m in MONTHS]), (F.dayofmonth("count_date") % 12 + 1).cast("int"))
    sums = counts.groupBy(F.col("species_common_name").alias("species"), month.alias("month")).agg(
        F.sum("count").alias("count"), F.sum("observation_hours").alias("h")
    )
    hours = F.when(F.col("month") == "jun", 0.0).otherwise(F.col("h"))
    return sums.withColumn("count_per_hour", F.when(hours > 0, F.col("count") / hours))


_JOINED = with_views("raw", "counts") + """,
c AS (SELECT upper(trim(species_common_name)) AS sp, day(count_date) % 12 + 1 AS mo, sum("count") / CASE WHEN day(count_date) % 12 + 1 <> 6 AND sum(observation_hours) > 0 THEN sum(observation_hours) END AS rate
  FROM v_counts WHERE species_common_name IS NOT NULL GROUP BY 1, 2),
i AS (SELECT INDEX_NR AS record_id, TRY_CAST(LATITUDE AS DOUBLE) AS lat1, TRY_CAST(LONGITUDE AS DOUBLE) AS lon1, TRY_CAST(INCIDENT_YEAR AS INT) AS yr, TRY_CAST(INCIDENT_MONTH AS INT) AS mo, upper(trim(SPECIES)) AS sp,
  -76e0 AS lon2, 392e-1 AS lat2 FROM v_raw WHERE LATITUDE IS NOT NULL AND LONGITUDE <> '999'),
""" + geosql.geodesic_ctes("i", "g") + """,
j AS (SELECT g.record_id, round(geodesic_km, 1) AS distance_km, abs(coalesce(yr, 2020) - 2020) AS time_diff_years, c.sp IS NOT NULL AS species_matched, rate IS NOT NULL AS month_monitored, rate
  FROM g LEFT JOIN c ON c.sp = g.sp AND c.mo = g.mo)
"""


def provenance_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    raw = targets.normalise_raw(view(spark, sf_dir, "raw"))
    incidents = raw.withColumn("LONGITUDE", F.when(F.col("LONGITUDE") <= 180, F.col("LONGITUDE")))
    lookup = species.activity_lookup(season_activity(spark, sf_dir), "count")
    joined = species.incidents_with_activity(
        incidents, lookup, station_lon=STATION[0], station_lat=STATION[1], season_year=2020, source_dataset="single_station_season"
    )
    return joined, incidents


@query("provenance_join", _JOINED + """SELECT record_id, 'single_station_season' AS source_dataset, distance_km, time_diff_years, species_matched, month_monitored,
  CASE WHEN species_matched AND month_monitored THEN 'observed' ELSE 'unavailable' END AS value_type, round(rate, 6) AS local_activity_count_per_hour FROM j""")
def provenance_join(spark, sf_dir):
    """Incidents with station activity of their species and month, provenance on every row."""
    return provenance_rows(spark, sf_dir)[0].select(
        "record_id", "source_dataset", "distance_km", "time_diff_years", "species_matched", "month_monitored", "value_type",
        F.round("local_activity_count_per_hour", 6).alias("local_activity_count_per_hour"),
    )


_LADDER = " UNION ALL ".join(
    ["SELECT 'overall' AS section, 'n_incidents_total' AS k, t AS n, t FROM o", "SELECT 'overall', 'n_dropped_missing_coordinates', t - n, t FROM o",
     "SELECT 'overall', 'n_species_matched_any_month', m, t FROM o", "SELECT 'overall', 'n_fully_observed_species_and_month', f, t FROM o"]
    + [f"SELECT 'spatial', 'within_{d}km', (SELECT count(*) FROM j WHERE species_matched AND month_monitored AND distance_km <= {d}), t FROM o" for d in (50, 100, 250, 500, 1000, 2500)]
    + [f"SELECT 'temporal', 'within_{y}yr', (SELECT count(*) FROM j WHERE species_matched AND month_monitored AND time_diff_years <= {y}), t FROM o" for y in (0, 1, 5, 10, 20)]
)


@query("join_quality", _JOINED + """, o AS (SELECT count(*) AS n, count(*) FILTER (WHERE species_matched) AS m, count(*) FILTER (WHERE species_matched AND month_monitored) AS f, (SELECT count(*) FROM v_raw) AS t FROM j)
SELECT section, k AS "key", n, round(n * 100e0 / t, 2) AS pct_of_all_incidents FROM (""" + _LADDER + ")")
def join_quality(spark, sf_dir):
    """Match rates over the distance and year ladders, drops in the denominator."""
    return species.join_quality(*provenance_rows(spark, sf_dir))


@query("local_risk_merge", _ANNUAL + _NEWEST + """,
a AS (SELECT species, sum(c) / sum(hours) AS act FROM v WHERE rn = 1 AND hours > 0 GROUP BY 1),
r AS (SELECT upper(concat(p_type, ' ', replace(p_brand, '#1', '#9'))) AS k, count(*) AS n, avg(p_size) AS m FROM part GROUP BY 1)
SELECT a.species, round(act, 6) AS local_activity, n AS n_strikes, round(m * ln(1 + n), 6) AS risk_score, n IS NOT NULL AS matched_species, round(m * ln(1 + n) * act, 6) AS local_risk_contribution
FROM a LEFT JOIN r ON r.k = upper(a.species)""")
def local_risk_merge(spark, sf_dir):
    """Every local species with its risk where one exists, matched across spellings."""
    merged = monitoring.merge_annual(monitoring.annual_long(annual_lines(spark, sf_dir)))
    # brands starting #1 are spelled differently on the national side and stay unmatched
    label = F.lower(F.concat_ws(" ", "p_type", F.replace("p_brand", F.lit("#1"), F.lit("#9"))))
    part = table(spark, sf_dir, "part").select(label.alias("species"), F.col("p_size").alias("predicted_severity"))
    risk = species.species_risk(part, fold_case=True)
    out = species.local_risk(species.pooled_activity(merged), risk)
    return out.select(
        "species", F.round("local_activity", 6).alias("local_activity"), "n_strikes", F.round("risk_score", 6).alias("risk_score"),
        "matched_species", F.round("local_risk_contribution", 6).alias("local_risk_contribution"),
    )
