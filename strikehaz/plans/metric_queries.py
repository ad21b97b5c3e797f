"""Splits, encoders and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strikehaz.functions.coerce import number
from strikehaz.operators import bootstrap, features, metrics, scoring, splits
from strikehaz.plans.registry import query
from strikehaz.plans.strike_queries import NORMALISED, labelled_raw
from strikehaz.plans.views import table, view, with_views
from strikehaz.sources.strikes import canonical_strikes


@query("chronological_split", with_views("strikes") + """,
r AS (SELECT record_id, incident_date, row_number() OVER (ORDER BY incident_date, record_id % 4096, record_id) - 1 AS rk, count(*) OVER () AS n FROM v_strikes)
SELECT record_id, CASE WHEN rk < floor(n * 7e-1) THEN 'train' WHEN rk < floor(n * (7e-1 + 15e-2)) THEN 'validation' ELSE 'test' END AS split FROM r""")
def chronological_split(spark, sf_dir):
    """70/15/15 by row count in date order, without a global sort."""
    return splits.chronological_split(view(spark, sf_dir, "strikes"), "incident_date", "record_id").select("record_id", "split")


@query("split_boundaries", with_views("strikes") + """,
r AS (SELECT incident_date, row_number() OVER (ORDER BY incident_date, record_id % 4096, record_id) - 1 AS rk, count(*) OVER () AS n FROM v_strikes)
SELECT CASE WHEN rk < floor(n * 7e-1) THEN 'train' WHEN rk < floor(n * (7e-1 + 15e-2)) THEN 'validation' ELSE 'test' END AS split, count(*) AS n,
  strftime(min(incident_date), '%Y-%m-%d') AS first_day, strftime(max(incident_date), '%Y-%m-%d') AS last_day FROM r GROUP BY 1""")
def split_boundaries(spark, sf_dir):
    """Sizes and boundary dates of the chronological split."""
    parts = splits.chronological_split(view(spark, sf_dir, "strikes"), "incident_date", "record_id")
    return splits.split_boundaries(parts, "incident_date").select(
        "split", "n", F.date_format("first_date", "yyyy-MM-dd").alias("first_day"), F.date_format("last_date", "yyyy-MM-dd").alias("last_day")
    )


@query("year_split", with_views("raw") + """
SELECT INDEX_NR AS record_id, CASE WHEN TRY_CAST(INCIDENT_YEAR AS INT) <= 2019 THEN 'train' WHEN TRY_CAST(INCIDENT_YEAR AS INT) <= 2022 THEN 'validation' ELSE 'test' END AS split
FROM v_raw WHERE TRY_CAST(INCIDENT_YEAR AS INT) IS NOT NULL""")
def year_split(spark, sf_dir):
    """Split on calendar-year bounds."""
    return splits.year_split(view(spark, sf_dir, "raw"), "INCIDENT_YEAR").select(F.col("INDEX_NR").alias("record_id"), "split")


@query("holdouts", with_views("raw", "strikes") + """
SELECT 'region' AS kind, FAAREGION IN ('AAL','FGN') AS held_out, count(*) AS n FROM v_raw GROUP BY 2
UNION ALL SELECT 'airport', airport_id IN (1, 7, 99), count(*) FROM v_strikes GROUP BY 2
UNION ALL SELECT 'latest_year', year(incident_date) = (SELECT max(year(incident_date)) FROM v_strikes), count(*) FROM v_strikes GROUP BY 2
UNION ALL SELECT 'coverage', NOT (injuries > 0), count(*) FROM v_strikes GROUP BY 2""")
def holdouts(spark, sf_dir):
    """Hold-outs by region, airport, latest year and coverage."""
    strikes = view(spark, sf_dir, "strikes")
    parts = {
        "region": splits.holdout_by_values(view(spark, sf_dir, "raw"), "FAAREGION", ["AAL", "FGN"]),
        "airport": splits.holdout_by_values(strikes, "airport_id", [1, 7, 99]),
        "latest_year": splits.holdout_latest_year(strikes, "incident_date"),
        "coverage": splits.holdout_by_coverage(strikes.withColumn("monitoring_available", F.col("injuries") > 0)),
    }
    out = None
    for kind, df in parts.items():
        sizes = df.groupBy(F.lit(kind).alias("kind"), "held_out").agg(F.count("*").alias("n"))
        out = sizes if out is None else out.unionByName(sizes)
    return out


@query("stratified_split", with_views("scores") + """, n AS (SELECT y, count(*) AS n, CAST(floor(count(*) * 8e-1) AS BIGINT) AS cut FROM v_scores WHERE y IS NOT NULL GROUP BY 1)
SELECT y, 'train' AS split, cut AS n FROM n UNION ALL SELECT y, 'test', n - cut FROM n""")
def stratified_split(spark, sf_dir):
    """80/20 within each label, fixed by a seeded hash (U8)."""
    rows = view(spark, sf_dir, "scores").where(F.col("y").isNotNull())
    return splits.stratified_split(rows, "y", "id", 0.8).groupBy("y", "split").agg(F.count("*").alias("n"))


@query("rare_categories", with_views("raw") + """,
f AS (SELECT AIRCRAFT AS v FROM v_raw WHERE TRY_CAST(INCIDENT_YEAR AS INT) <= 2019 GROUP BY 1 HAVING count(*) >= 20),
g AS (SELECT PRECIPITATION AS v FROM v_raw WHERE TRY_CAST(INCIDENT_YEAR AS INT) <= 2019 AND PRECIPITATION IS NOT NULL GROUP BY 1 HAVING count(*) >= 20)
SELECT INDEX_NR AS record_id, CASE WHEN AIRCRAFT IS NULL OR AIRCRAFT IN (SELECT v FROM f) THEN AIRCRAFT ELSE 'rare_other' END AS aircraft,
  CASE WHEN PRECIPITATION IS NULL OR PRECIPITATION IN (SELECT v FROM g) THEN PRECIPITATION ELSE 'rare_other' END AS precipitation FROM v_raw""")
def rare_categories(spark, sf_dir):
    """Categories rare in training become one token everywhere, null stays null."""
    raw = view(spark, sf_dir, "raw")
    train = splits.year_split(raw, "INCIDENT_YEAR").where("split = 'train'")
    columns = ["AIRCRAFT", "PRECIPITATION"]
    frequent = splits.frequent_categories(train, columns)
    return splits.bucket_rare(raw, frequent, columns).select(
        F.col("INDEX_NR").alias("record_id"), F.col("AIRCRAFT").alias("aircraft"), F.col("PRECIPITATION").alias("precipitation")
    )


_RAW_TEXT = [raw for field, raw in scoring.fv.SCENARIO_RAW.items() if field not in scoring.fv.SCENARIO_NUMERIC]
_RAW_NUMBERS = [scoring.fv.SCENARIO_RAW[field] for field in scoring.fv.SCENARIO_NUMERIC]


@query("seen_and_ranges", with_views("raw") + """,
t AS (SELECT * FROM v_raw WHERE TRY_CAST(INCIDENT_YEAR AS INT) <= 2022), r AS (SELECT * FROM t WHERE TRY_CAST(INCIDENT_YEAR AS INT) <= 2019)
""" + " UNION ALL ".join(f"""SELECT DISTINCT '{c}' AS "column", upper({c}) AS value, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high FROM t WHERE {c} IS NOT NULL""" for c in _RAW_TEXT)
       + "".join(f" UNION ALL SELECT '{c}', NULL, min(TRY_CAST({c} AS DOUBLE)), max(TRY_CAST({c} AS DOUBLE)) FROM r" for c in _RAW_NUMBERS))
def seen_and_ranges(spark, sf_dir):
    """Categories seen in training or validation and numeric training ranges, every field of each kind."""
    rows = splits.year_split(labelled_raw(spark, sf_dir), "INCIDENT_YEAR")
    seen = splits.seen_categories(rows.where("split <> 'test'"), _RAW_TEXT)
    numbers = rows.where("split = 'train'").withColumns({c: number(c) for c in _RAW_NUMBERS})
    ranges = splits.numeric_ranges(numbers, _RAW_NUMBERS)
    none = F.lit(None)
    return seen.select("column", "value", none.cast("double").alias("low"), none.cast("double").alias("high")).unionByName(
        ranges.select("column", none.cast("string").alias("value"), "low", "high")
    )


@query("standardised", with_views("raw") + """,
v AS (SELECT INDEX_NR AS record_id, TRY_CAST(HEIGHT AS DOUBLE) AS h, TRY_CAST(SPEED AS DOUBLE) AS s, TRY_CAST(INCIDENT_YEAR AS INT) AS y FROM v_raw WHERE TRY_CAST(INCIDENT_YEAR AS INT) IS NOT NULL),
m AS (SELECT avg(h) AS mh, stddev_pop(h) AS sh, avg(s) AS ms, stddev_pop(s) AS ss FROM v WHERE y <= 2019)
SELECT record_id, round((h - mh) / sh, 6) AS height, round((s - ms) / ss, 6) AS speed, 0e0 AS constant FROM v, m""")
def standardised(spark, sf_dir):
    """Train mean and spread applied to every split; zero spread divides by one."""
    rows = splits.year_split(labelled_raw(spark, sf_dir), "INCIDENT_YEAR").select(
        F.col("INDEX_NR").alias("record_id"), F.col("HEIGHT").alias("height"), F.col("SPEED").alias("speed"), F.lit(3.0).alias("constant"), "split"
    )
    out = splits.standardised(rows, rows.where("split = 'train'"), ["height", "speed", "constant"])
    return out.select("record_id", F.round("height", 6).alias("height"), F.round("speed", 6).alias("speed"), "constant")


_PREFLIGHT = """INDEX_NR AS record_id, upper(trim(AIRCRAFT)) AS aircraft_type, upper(trim(AC_MASS)) AS aircraft_mass_class, TRY_CAST(NUM_ENGS AS DOUBLE) AS engine_count,
  coalesce(ENG_2_POS, 'NONE') AS engine_position_secondary, upper(SKY) AS sky_condition, TRY_CAST(INCIDENT_MONTH AS DOUBLE) AS month,
  round(sin(2 * pi() * coalesce(TRY_CAST(INCIDENT_MONTH AS DOUBLE), 6) / 12), 9) AS month_sin, CASE WHEN TRY_CAST(INCIDENT_MONTH AS INT) IN (12, 1, 2) THEN 'WINTER' WHEN TRY_CAST(INCIDENT_MONTH AS INT) <= 5 THEN 'SPRING'
  WHEN TRY_CAST(INCIDENT_MONTH AS INT) <= 8 THEN 'SUMMER' WHEN TRY_CAST(INCIDENT_MONTH AS INT) IS NOT NULL THEN 'FALL' END AS season"""


@query("operational_features", with_views("raw") + "SELECT " + _PREFLIGHT + """, PHASE_OF_FLIGHT AS phase_of_flight, TRY_CAST(HEIGHT AS DOUBLE) AS height_agl_ft, upper(TIME_OF_DAY) AS light_condition, upper(WARNED) AS bird_warned, 6 AS n_numeric, 13 AS n_categorical FROM v_raw""")
def operational_features(spark, sf_dir):
    """Guarded encounter features."""
    out = features.operational_core(labelled_raw(spark, sf_dir), ["INDEX_NR"])
    return out.frame.select(
        F.col("INDEX_NR").alias("record_id"), "aircraft_type", "aircraft_mass_class", "engine_count", "engine_position_secondary", "sky_condition",
        "month", F.round("month_sin", 9).alias("month_sin"), "season", "phase_of_flight", "height_agl_ft", "light_condition", "bird_warned",
        F.lit(len(out.numeric)).alias("n_numeric"), F.lit(len(out.categorical)).alias("n_categorical"),
    )


@query("preflight_features", with_views("raw") + "SELECT " + _PREFLIGHT + ", 14 AS n_features FROM v_raw")
def preflight_features(spark, sf_dir):
    """Guarded preflight features (M2, F2)."""
    out = features.BUILDERS["reduced_preflight"](labelled_raw(spark, sf_dir), ["INDEX_NR"])
    return out.frame.select(
        F.col("INDEX_NR").alias("record_id"), "aircraft_type", "aircraft_mass_class", "engine_count", "engine_position_secondary", "sky_condition",
        "month", F.round("month_sin", 9).alias("month_sin"), "season", F.lit(len(out.numeric) + len(out.categorical)).alias("n_features"),
    )


@query("severity_features", with_views("raw") + "SELECT INDEX_NR AS record_id, upper(trim(SPECIES)) AS species, TRY_CAST(SPEED AS DOUBLE) AS speed_ias_knots, 20 AS n_columns FROM v_raw".replace("upper(trim(SPECIES))", "SPECIES"))
def severity_features(spark, sf_dir):
    """Encounter features plus species for the retrospective model (M3)."""
    out = features.severity_with_species(labelled_raw(spark, sf_dir), ["INDEX_NR"])
    return out.frame.select(F.col("INDEX_NR").alias("record_id"), "species", "speed_ias_knots", F.lit(len(out.numeric) + len(out.categorical)).alias("n_columns"))


@query("canonical_features", with_views("export") + """,
e AS (SELECT "INDEX NR" AS record_id, TRY_CAST("incident date" AS TIMESTAMP) AS d, TRY_CAST("HEIGHT (FT)" AS DOUBLE) AS h, CASE WHEN "TIME" = '08:15' THEN 8 ELSE 0 END AS hr FROM v_export)
SELECT record_id, h AS height_agl_ft, year(d) AS year, month(d) AS month, CASE WHEN d IS NOT NULL THEN hr END AS hour_local, coalesce(month(d) IN (3,4,5,8,9,10), false) AS is_migration_season, CAST(NULL AS BOOLEAN) AS is_night FROM e""")
def canonical_features(spark, sf_dir):
    """Allowed canonical columns with time features; no sun phase without a zone."""
    data = canonical_strikes(view(spark, sf_dir, "export")).data
    return features.canonical_features(data, ["record_id"]).select(
        "record_id", "height_agl_ft", "year", "month", "hour_local", "is_migration_season", "is_night"
    )


# --- metrics ---------------------------------------------------------------------

SCORES = with_views("scores") + ", s AS (SELECT * FROM v_scores WHERE y IS NOT NULL)"
RANKED = SCORES + """,
k AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2e0 AS r FROM s),
u AS (SELECT sum(CASE WHEN y = 1 THEN r END) AS rs, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn FROM k),
a AS (SELECT (rs - np * (np + 1) / 2e0) / (np * nn) AS auc FROM u),
h AS (SELECT p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS cn, sum(pos) OVER () AS allp, sum(n) OVER () AS alln FROM h),
b AS (SELECT sum(pos / allp * tp / cn) AS ap FROM c)
"""
CONFUSION = """count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn"""


def scored(spark, sf_dir):
    return view(spark, sf_dir, "scores").where(F.col("y").isNotNull())


@query("roc_auc", RANKED + "SELECT round(auc, 9) AS roc_auc FROM a")
def roc_auc(spark, sf_dir):
    """Exact ROC-AUC with tied scores."""
    return metrics.roc_auc(scored(spark, sf_dir)).withColumn("roc_auc", F.round("roc_auc", 9))


@query("average_precision", RANKED + "SELECT round(ap, 9) AS average_precision FROM b")
def average_precision(spark, sf_dir):
    """Average precision over distinct scores."""
    return metrics.average_precision(scored(spark, sf_dir)).withColumn("average_precision", F.round("average_precision", 9))


@query("roc_points", RANKED + """SELECT round(p, 9) AS threshold, round((cn - tp) / (alln - allp), 9) AS fpr, round(tp / allp, 9) AS tpr, round(tp / cn, 9) AS precision, round(tp / allp, 9) AS recall FROM c""")
def roc_points(spark, sf_dir):
    """ROC and precision-recall points, one per distinct score."""
    points = metrics.curve_points(scored(spark, sf_dir))
    return points.withColumns({c: F.round(c, 9) for c in points.columns})


@query("classifier_metrics", RANKED + ", m AS (SELECT count(*) AS sample_count, avg(y) AS prev, avg(pow(y - p, 2)) AS brier, " + CONFUSION.format(t="5e-1") + """ FROM s)
SELECT sample_count, round(prev, 6) AS positive_class_prevalence, tp, fp, fn, tn, round(brier, 6) AS brier_score, round((tp + tn) / sample_count, 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(auc, 6) AS roc_auc, round(ap, 6) AS average_precision FROM m, a, b""")
def classifier_metrics(spark, sf_dir):
    """Confusion matrix and every derived metric at one threshold."""
    out = metrics.classifier_metrics(scored(spark, sf_dir), 0.5).drop("warning")
    return out.withColumns({c: F.round(c, 6) for c, t in out.dtypes if t == "double"})


@query("log_loss", SCORES + "SELECT round(avg(-CASE WHEN y = 1 THEN ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) ELSE ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) END), 9) AS log_loss FROM s")
def log_loss(spark, sf_dir):
    """Clipped log loss."""
    return metrics.log_loss(scored(spark, sf_dir)).withColumn("log_loss", F.round("log_loss", 9))


@query("efron_r2", SCORES + ", m AS (SELECT avg(y) AS m FROM s WHERE split_no < 7) SELECT round(1 - sum(pow(y - p, 2)) / sum(pow(y - m, 2)), 9) AS efron_pseudo_r2 FROM s, m")
def efron_r2(spark, sf_dir):
    """Efron's pseudo R2 against the training mean."""
    rows = scored(spark, sf_dir)
    mean = rows.where("split_no < 7").agg(F.avg("y")).scalar()
    return metrics.efron_r2(rows.withColumn("m", mean), F.col("m")).withColumn("efron_pseudo_r2", F.round("efron_pseudo_r2", 9))


@query("regression_metrics", """SELECT count(*) AS n, round(sqrt(avg(pow(o_totalprice - 1000 - 200 * (o_orderkey % 7), 2))), 4) AS rmse,
  round(1 - sum(pow(o_totalprice - 1000 - 200 * (o_orderkey % 7), 2)) / (var_pop(o_totalprice) * count(*)), 6) AS r2 FROM orders""")
def regression_metrics(spark, sf_dir):
    """RMSE and R2 of a prediction column."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("y"), (1000 + 200.0 * (F.col("o_orderkey") % 7)).alias("p"))
    return metrics.regression_metrics(rows).select("n", F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query("calibration_curve", SCORES + """, e AS (SELECT CAST(len(list_filter([i / 10e0 FOR i IN range(1, 10)], lambda x: x < p)) AS INT) AS bin, p, y FROM s)
SELECT bin, count(*) AS n, round(avg(p), 9) AS mean_predicted, round(avg(y), 9) AS observed_rate FROM e GROUP BY 1""")
def calibration_curve(spark, sf_dir):
    """Uniform-bin calibration, edges to the lower bin."""
    out = metrics.calibration_curve(scored(spark, sf_dir))
    return out.withColumns({"mean_predicted": F.round("mean_predicted", 9), "observed_rate": F.round("observed_rate", 9)})


@query("risk_deciles", SCORES + """, r AS (SELECT y, p, row_number() OVER (ORDER BY p, id % 4096, id) - 1 AS rk, count(*) OVER () AS n FROM s)
SELECT CAST(floor((10 * (rk + 1) - 1) / n) + 1 AS INT) AS risk_decile, count(*) AS n, round(avg(p), 9) AS predicted_mean_probability, round(avg(y), 9) AS observed_damage_rate FROM r GROUP BY 1""")
def risk_deciles(spark, sf_dir):
    """Equal-count deciles with floor edges."""
    out = metrics.risk_deciles(scored(spark, sf_dir), "id")
    return out.withColumns({c: F.round(c, 9) for c in ("predicted_mean_probability", "observed_damage_rate")})


_SCAN = SCORES + """, g AS (SELECT CASE WHEN i = 198 THEN 99e-2 ELSE 1e-2 + i * (98e-2 / 198) END AS t FROM range(199) x(i)),
l AS (SELECT t, count(*) FILTER (WHERE p >= t AND y = 1) AS tp, count(*) FILTER (WHERE p >= t AND y = 0) AS fp, count(*) FILTER (WHERE p < t AND y = 1) AS fn, count(*) FILTER (WHERE p < t AND y = 0) AS tn FROM g CROSS JOIN s GROUP BY 1),
z AS (SELECT t, 2 * tp / (2 * tp + fp + fn) AS f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS ba FROM l)
"""


@query("threshold_tuning", _SCAN + """SELECT 'f1' AS objective, round(min(t) FILTER (WHERE f1 = (SELECT max(f1) FROM z)), 9) AS threshold, round(max(f1), 9) AS score_at_threshold FROM z
UNION ALL SELECT 'balanced_accuracy', round(min(t) FILTER (WHERE ba = (SELECT max(ba) FROM z)), 9), round(max(ba), 9) FROM z""")
def threshold_tuning(spark, sf_dir):
    """Best of 199 thresholds, the lowest on ties."""
    rows = scored(spark, sf_dir)
    both = metrics.tune_threshold(rows, "f1").unionByName(metrics.tune_threshold(rows, "balanced_accuracy"))
    return both.select("objective", F.round("threshold", 9).alias("threshold"), F.round("score_at_threshold", 9).alias("score_at_threshold"))


def _stack(spark, sf_dir):
    rows = view(spark, sf_dir, "stacked")
    return rows.unpivot(["id", "y"], ["p_a", "p_b", "p_c"], "model", "p")


_STACK = with_views("stacked") + """, s AS (UNPIVOT v_stacked ON p_a, p_b, p_c INTO NAME model VALUE p),
k AS (SELECT model, y, p, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS r FROM s),
a AS (SELECT model, (sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2e0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM k GROUP BY 1),
h AS (SELECT model, p, sum(y) AS pos, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT model, pos, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY model) AS allp FROM h),
b AS (SELECT model, sum(pos / allp * tp / cn) AS ap FROM c GROUP BY 1),
m AS (SELECT model, count(*) AS sample_count, avg(y) AS prev, avg(pow(y - p, 2)) AS brier, """ + CONFUSION.format(t="5e-1") + " FROM s GROUP BY 1)"


@query("model_comparison", _STACK + """SELECT model, sample_count, round(prev, 4) AS prevalence, round((tp + tn) / sample_count, 4) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 4) AS balanced_accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision,
  round(tp / (tp + fn), 4) AS recall, round(2 * tp / (2 * tp + fp + fn), 4) AS f1, round(auc, 4) AS roc_auc, round(ap, 4) AS average_precision, round(brier, 4) AS brier_score FROM m JOIN a USING (model) JOIN b USING (model)""")
def model_comparison(spark, sf_dir):
    """One rounded row per stacked model."""
    return metrics.model_comparison(_stack(spark, sf_dir), 0.5)


def _lcg():
    """Arithmetic draws that SQL can repeat: (id * 1103515245 + resample * 12345) mod 2^31, sent by value."""
    return bootstrap.Uniform(lambda i: i, lambda rows, resamples: ((rows * 1103515245 + resamples * 12345) & 2147483647) / 2147483648.0)


_STEPS = bootstrap._poisson_bounds()
_BOOT = SCORES + f""", d AS (SELECT b, y, p, CAST(len(list_filter([{', '.join(repr(x) for x in _STEPS)}], lambda q: q <= ((id * 1103515245 + b * 12345) % 2147483648) / 2147483648e0)) AS BIGINT) AS w FROM s CROSS JOIN range(1, 501) t(b)),
h AS (SELECT b, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM d WHERE w > 0 GROUP BY 1, 2),
c AS (SELECT b, pos, neg, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn, sum(pos) OVER (PARTITION BY b) AS ap, sum(neg) OVER (PARTITION BY b) AS an FROM h),
v AS (SELECT b, sum(pos * (bn + neg / 2) / (ap * an)) AS value FROM c GROUP BY 1),
"""


@query("bootstrap_ci", _BOOT + RANKED.split("AS (SELECT * FROM v_scores WHERE y IS NOT NULL),")[1].replace("h AS", "h2 AS").replace("FROM h)", "FROM h2)").replace("c AS (SELECT p, pos", "c2 AS (SELECT p, pos").replace("FROM c)", "FROM c2)") + """
SELECT 'roc_auc' AS metric, true AS available, round(max(auc), 9) AS point_estimate, round(quantile_cont(value, 25e-3), 9) AS ci_low, round(quantile_cont(value, 975e-3), 9) AS ci_high, 95e-2 AS confidence_level, count(value) AS n_resamples_used FROM v, a""")
def bootstrap_ci(spark, sf_dir):
    """Percentile interval of the AUC over 500 Poisson resamples with arithmetic draws."""
    out = bootstrap.bootstrap_ci(scored(spark, sf_dir), "id", "roc_auc", n_resamples=500, uniform=_lcg())
    return out.withColumns({c: F.round(c, 9) for c in ("point_estimate", "ci_low", "ci_high")})


_MEANS = _BOOT.split("h AS (SELECT b, p")[0].rstrip().rstrip(",")
_REFUSED = """, k AS (SELECT count(*) >= 30 AND sum(y) >= 10 AS enough FROM s), u AS (SELECT enough AND count(value) >= 250 AS available, avg(value) AS mean, quantile_cont(value, 25e-3) AS low, quantile_cont(value, 975e-3) AS high,
  count(value) AS used FROM v, k GROUP BY enough)
SELECT '{name}' AS metric, available, CASE WHEN available THEN round(mean, 9) END AS point_estimate, CASE WHEN available THEN round(low, 9) END AS ci_low, CASE WHEN available THEN round(high, 9) END AS ci_high,
  95e-2 AS confidence_level, used AS n_resamples_used FROM u"""


def _resample_mean(spark, sf_dir, metric):
    out = bootstrap.bootstrap_ci(scored(spark, sf_dir), "id", metric, n_resamples=500, variant="resample_mean", uniform=_lcg())
    return out.withColumns({c: F.round(c, 9) for c in ("point_estimate", "ci_low", "ci_high")})


@query("bootstrap_brier", _MEANS + ", v AS (SELECT b, sum(w * pow(y - p, 2)) / sum(w) AS value FROM d GROUP BY b HAVING sum(w * y) > 0 AND sum(w * (1 - y)) > 0)" + _REFUSED.format(name="brier"))
def bootstrap_brier(spark, sf_dir):
    """Resample-mean variant with its refusal rules, arithmetic draws."""
    return _resample_mean(spark, sf_dir, "brier")


@query("bootstrap_pr_auc", _MEANS + """, h AS (SELECT b, p, sum(w * y) AS pos, sum(w) AS n FROM d GROUP BY 1, 2),
c AS (SELECT b, pos, sum(pos) OVER (PARTITION BY b ORDER BY p DESC) AS tp, sum(n) OVER (PARTITION BY b ORDER BY p DESC) AS cn, sum(pos) OVER (PARTITION BY b) AS allp, sum(n) OVER (PARTITION BY b) AS alln FROM h),
v AS (SELECT b, sum(CASE WHEN pos > 0 THEN pos / allp * tp / cn ELSE 0 END) AS value FROM c WHERE allp > 0 AND alln > allp GROUP BY b)""" + _REFUSED.format(name="pr_auc"))
def bootstrap_pr_auc(spark, sf_dir):
    """Average precision over the resamples."""
    return _resample_mean(spark, sf_dir, "pr_auc")


@query("bootstrap_own_metric", _MEANS + ", v AS (SELECT b, sum(w * y * p) / sum(w * y) - sum(w * (1 - y) * p) / sum(w * (1 - y)) AS value FROM d GROUP BY b HAVING sum(w * y) > 0 AND sum(w * (1 - y)) > 0)" + _REFUSED.format(name="score_gap"))
def bootstrap_own_metric(spark, sf_dir):
    """A caller's own metric: how much higher the mean score of damaged rows is (F1)."""

    def score_gap(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        return (p[:, None] * (pos / all_pos - neg / all_neg)).sum(axis=0)

    return _resample_mean(spark, sf_dir, score_gap)


@query("risk_bands", SCORES.replace(", s AS (SELECT * FROM v_scores WHERE y IS NOT NULL)", "") + """
SELECT id, CASE WHEN p < 1e-1 THEN 'Low relative conditional severity' WHEN p < 25e-2 THEN 'Moderate relative conditional severity' WHEN p < 5e-1 THEN 'Elevated relative conditional severity'
  ELSE 'High relative conditional severity' END AS risk_band, CASE WHEN p >= 213e-3 THEN 'ELEVATED' ELSE 'LOWER' END AS classification FROM v_scores""")
def risk_bands(spark, sf_dir):
    """Band and class of every score."""
    return view(spark, sf_dir, "scores").select("id", scoring.risk_band(F.col("p")).alias("risk_band"), scoring.score_class(F.col("p"), 0.213).alias("classification"))


def scenario_rows(spark, sf_dir):
    """Every strike as a scenario table row."""
    core = features.operational_core(labelled_raw(spark, sf_dir), ["INDEX_NR"]).frame
    fields = list(scoring.fv.SCENARIO_RAW)
    return core.select(F.col("INDEX_NR").alias("scenario_id"), *fields)


def _scenario_sql() -> str:
    """One line per field: numbers missing or out of the training range, categories no training row has."""
    raw = dict(scoring.fv.SCENARIO_RAW)
    number_of = {f: f"TRY_CAST({raw[f]} AS DOUBLE)" for f in scoring.fv.SCENARIO_NUMERIC}
    text_of = {f: f"coalesce({raw[f]}, 'NONE')" if f == "engine_position_secondary" else raw[f] for f in scoring.TEXT_FIELDS}
    limits = ", ".join(f"min({x}) AS {f}_0, max({x}) AS {f}_1" for f, x in number_of.items())
    lines = [f"SELECT INDEX_NR AS id, '{f}: missing' AS v FROM v_raw WHERE {x} IS NULL" for f, x in number_of.items()]
    lines += [f"SELECT INDEX_NR, '{f}: outside training range' FROM v_raw, l WHERE {x} < {f}_0 OR {x} > {f}_1" for f, x in number_of.items()]
    lines += [f"SELECT INDEX_NR, '{f}: never seen in training' FROM v_raw WHERE {x} IS NOT NULL AND {x} NOT IN (SELECT {x} FROM r WHERE {x} IS NOT NULL)" for f, x in text_of.items()]
    return with_views("raw") + f""",
t AS (SELECT *, TRY_CAST(INCIDENT_YEAR AS INT) AS yr FROM v_raw), r AS (SELECT * FROM t WHERE yr <= 2019),
l AS (SELECT {limits} FROM r), p AS ({" UNION ALL ".join(lines)}),
g AS (SELECT id, count(*) AS n, string_agg(v, '; ' ORDER BY v) AS vs FROM p GROUP BY 1)
SELECT INDEX_NR AS scenario_id, n IS NULL AS is_valid, coalesce(n, 0) AS n_violations, coalesce(vs, '') AS violations FROM v_raw LEFT JOIN g ON id = INDEX_NR"""


@query("scenario_validity", _scenario_sql())
def scenario_validity(spark, sf_dir):
    """Whole scenario table against categories and ranges of the training rows, every field."""
    rows = splits.year_split(labelled_raw(spark, sf_dir), "INCIDENT_YEAR").where("split = 'train'")
    train = features.operational_core(rows).frame
    seen = splits.seen_categories(train, scoring.TEXT_FIELDS)
    ranges = splits.numeric_ranges(train, scoring.fv.SCENARIO_NUMERIC)
    return scoring.scenario_violations(scenario_rows(spark, sf_dir), seen, ranges)


@query("scenario_raw_rows", with_views("raw") + "SELECT INDEX_NR AS scenario_id, AIRCRAFT, ENG_2_POS, TRY_CAST(HEIGHT AS DOUBLE) AS HEIGHT FROM v_raw")
def scenario_raw_rows(spark, sf_dir):
    """Scenario fields renamed to raw columns, 'NONE' engine to null."""
    return scoring.scenario_to_raw(scenario_rows(spark, sf_dir)).select("scenario_id", "AIRCRAFT", "ENG_2_POS", "HEIGHT")
