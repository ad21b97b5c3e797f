"""Model queries: trained on the year split of the strike table, scored on all of it.

Scores depend on MLlib's own numerics, so all but `additive_importance` have no SQL twin; the tables
around them (splits, features, metrics) do.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strikehaz.operators import explain, features, metrics, models, scoring, splits, targets
from strikehaz.operators.species import species_risk
from strikehaz.plans.registry import query
from strikehaz.plans.strike_queries import labelled_raw
from strikehaz.plans.views import table
from strikehaz.session import durable


def framed(spark, sf_dir, builder=features.operational_core, target="damage_binary"):
    """(feature set, train, validation, test) of the principal population's labelled strikes with `y`, `id` and `region`.

    The raw text is read and parsed once: encoders, fits and scores each read the splits several times.
    """
    rows = splits.year_split(targets.principal_population(labelled_raw(spark, sf_dir)).where(F.col(target).isNotNull()), "INCIDENT_YEAR")
    keyed = rows.withColumns({"y": F.col(target).cast("double"), "id": F.col("INDEX_NR").cast("bigint"), "region": F.col("FAAREGION")})
    built = builder(keyed, ["id", "y", "region", "split"])
    frame = durable(built.frame)
    parts = [frame.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return built, *parts


def _gbt(spark, sf_dir):
    built, train, validation, test = framed(spark, sf_dir)
    encoder = models.fit_tree(train, built.numeric, built.categorical)
    return models.fit_gbt(train, validation, encoder, depth=4), encoder, train, validation, test


def _logistic(spark, sf_dir, builder=features.operational_core):
    built, train, validation, test = framed(spark, sf_dir, builder)
    encoder = models.fit_dense(train, built.numeric, built.categorical)
    return models.fit_logistic(encoder.transform(train)), encoder, train, validation, test


@query("logistic_scores")
def logistic_scores(spark, sf_dir):
    """Balanced logistic baseline on every test row."""
    model, encoder, _, _, test = _logistic(spark, sf_dir)
    return model.transform(encoder.transform(test)).select("id", "y", models.probability().alias("p"))


@query("preflight_scores")
def preflight_scores(spark, sf_dir):
    """The same baseline on preflight features only (M2, M7)."""
    model, encoder, _, _, test = _logistic(spark, sf_dir, features.reduced_preflight)
    return model.transform(encoder.transform(test)).select("id", "y", models.probability().alias("p"))


@query("dummy_scores")
def dummy_scores(spark, sf_dir):
    """Stratified dummy: hard scores drawn with the training prior (M7)."""
    _, train, _, test = framed(spark, sf_dir)
    return models.stratified_dummy(test, train, "id").select("id", "y", "p")


@query("gbt_scores")
def gbt_scores(spark, sf_dir):
    """Boosted trees with native categories and early stopping (M6, M8)."""
    model, encoder, _, _, test = _gbt(spark, sf_dir)
    return model.transform(encoder.transform(test)).select("id", "y", models.probability().alias("p"))


@query("gbt_search")
def gbt_search(spark, sf_dir):
    """Validation log loss and ROC-AUC of every point of the grid (M8)."""
    built, train, validation, _ = framed(spark, sf_dir)
    encoder = models.fit_tree(train, built.numeric, built.categorical)
    _, rows = models.search_gbt(train, validation, encoder)
    return spark.createDataFrame(rows)


@query("calibrated_scores")
def calibrated_scores(spark, sf_dir):
    """Batch scoring: calibrated on validation, class, band and note per test row."""
    model, encoder, _, validation, test = _logistic(spark, sf_dir)
    scored = model.transform(encoder.transform(validation)).select("y", models.probability().alias("p"))
    calibration = models.select_calibration(scored)
    return models.score_batch(model, encoder, test, calibration, 0.5, ["id", "y"])


@query("calibration_choice")
def calibration_choice(spark, sf_dir):
    """Validation Brier score of each calibration method."""
    model, encoder, _, validation, _ = _logistic(spark, sf_dir)
    scored = model.transform(encoder.transform(validation)).select("y", models.probability().alias("p"))
    chosen = models.select_calibration(scored)
    return spark.createDataFrame([(m, b, m == chosen.method) for m, b in chosen.brier.items()], "method string, brier double, selected boolean")


@query("severity_scores")
def severity_scores(spark, sf_dir):
    """Severity regressor and the species ranking over all splits it gives, in-sample as stated."""
    built, train, validation, test = framed(spark, sf_dir, features.severity_with_species, "damage_severity_score")
    encoder = models.fit_tree(train, built.numeric, built.categorical)
    model = models.fit_severity(train, validation, encoder, depth=4)
    everything = train.unionByName(validation).unionByName(test)
    scored = model.transform(encoder.transform(everything.withColumn("SPECIES_NAME", F.col("species"))))
    return species_risk(scored.withColumnRenamed("prediction", "predicted_severity"), "SPECIES_NAME")


@query("severity_metrics")
def severity_metrics(spark, sf_dir):
    """RMSE and R2 of the severity regressor on validation and test."""
    built, train, validation, test = framed(spark, sf_dir, features.severity_with_species, "damage_severity_score")
    encoder = models.fit_tree(train, built.numeric, built.categorical)
    model = models.fit_severity(train, validation, encoder, depth=4)
    scored = model.transform(encoder.transform(validation.unionByName(test))).select("split", "y", F.col("prediction").alias("p"))
    return metrics.regression_metrics(scored, by=["split"])


@query("global_importance")
def global_importance(spark, sf_dir):
    """Tree importances."""
    model, encoder, *_ = _gbt(spark, sf_dir)
    return models.global_importance(spark, model, encoder)


@query("coefficient_ranking")
def coefficient_ranking(spark, sf_dir):
    """Logistic coefficients summed per original column."""
    model, encoder, *_ = _logistic(spark, sf_dir)
    ranking = models.coefficient_ranking(spark, model, encoder)
    return metrics.grouped_importance(ranking, [*encoder.numeric, *encoder.categorical], "coefficient")


@query("local_contributions")
def local_contributions(spark, sf_dir):
    """Three largest contributions of every test row."""
    model, encoder, train, _, test = _logistic(spark, sf_dir)
    return models.local_contributions(model, encoder, test, train, "id")


@query("tree_contributions")
def tree_contributions(spark, sf_dir):
    """Three largest Shapley contributions of the boosted trees for every test row."""
    model, encoder, _, _, test = _gbt(spark, sf_dir)
    return explain.tree_contributions(model, encoder, test, "id")


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    """AUC lost on validation when a column is shuffled, for every feature column."""
    model, encoder, _, validation, _ = _logistic(spark, sf_dir)
    columns = [*encoder.numeric, *encoder.categorical]

    def score(df):
        return model.transform(encoder.transform(df)).select("*", models.probability().alias("p"))

    def parts(df):
        return models.column_parts(model, encoder, df, ["id", "y"])

    return models.permutation_importance(score, validation, "id", columns, parts=parts)


@query("additive_importance", """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, [(1995 - year(o_orderdate)) / 2e0, floor(o_totalprice / 1000) / 64e0, CAST(substr(o_orderpriority, 1, 1) AS INT) / 4e0] AS parts FROM orders),
m AS (SELECT *, 25e-2 + parts[1] + parts[2] + parts[3] AS p FROM s),
z AS (SELECT r, id, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':' || (42 + 2 * r))) AS here, row_number() OVER (PARTITION BY r ORDER BY md5(id || ':' || (43 + 2 * r))) AS there FROM s CROSS JOIN range(5) t(r)),
w AS (SELECT a.r, a.id, b.id AS other FROM z a JOIN z b ON a.r = b.r AND a.here = b.there),
x AS (SELECT w.r, k, i.y, CASE WHEN k = 0 THEN i.p ELSE i.p - i.parts[k] + o.parts[k] END AS p FROM w JOIN m i ON i.id = w.id JOIN m o ON o.id = w.other CROSS JOIN range(4) t(k) WHERE k > 0 OR w.r = 0),
h AS (SELECT k, r, p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY 1, 2, 3),
c AS (SELECT *, sum(neg) OVER (PARTITION BY k, r ORDER BY p) - neg AS below FROM h),
u AS (SELECT k, r, sum(pos * (below + neg / 2e0)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY 1, 2)
SELECT ['order_year', 'total_price', 'priority'][k] AS feature, round(avg(b.auc - u.auc), 9) AS mean_roc_auc_drop, round(stddev_pop(b.auc - u.auc), 9) AS std_roc_auc_drop
FROM u, (SELECT auc FROM u WHERE k = 0) b WHERE k > 0 GROUP BY 1""")
def additive_importance(spark, sf_dir):
    """AUC lost by each column of a stated additive scorer over all orders, with shuffles that SQL can repeat."""
    parts = F.array(
        (1995 - F.year("o_orderdate")) / 2.0, F.floor(F.col("o_totalprice") / 1000) / 64.0, F.substring("o_orderpriority", 1, 1).cast("int") / 4.0)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), parts.alias("parts"))
    rows = rows.withColumn("margin", F.aggregate("parts", F.lit(0.25), lambda s, v: s + v))
    out = models.additive_importance(
        rows, "id", ["order_year", "total_price", "priority"], order=lambda i, salt: F.unhex(F.md5(F.concat_ws(":", i.cast("string"), salt.cast("string")))))
    return out.withColumns({c: F.round(c, 9) for c in ("mean_roc_auc_drop", "std_roc_auc_drop")})


@query("region_slice")
def region_slice(spark, sf_dir):
    """The model on held-out regions beside the rest."""
    model, encoder, _, _, test = _logistic(spark, sf_dir)
    marked = splits.holdout_by_values(test, "region", ["AAL", "FGN"])
    scored = model.transform(encoder.transform(marked)).select("held_out", "y", models.probability().alias("p"))
    return metrics.classifier_metrics(scored, 0.5, by=["held_out"])


@query("strike_scenario_scores")
def strike_scenario_scores(spark, sf_dir):
    """Every strike of the test years scored next to the six named scenarios."""
    model, encoder, _, validation, test = _logistic(spark, sf_dir)
    scored = model.transform(encoder.transform(validation)).select("y", models.probability().alias("p"))
    calibration = models.select_calibration(scored)
    presets = features.operational_core(scoring.scenario_to_raw(scoring.preset_scenarios(spark)), ["scenario_id"]).frame
    rows = test.select(F.col("id").cast("string").alias("scenario_id"), *encoder.numeric, *encoder.categorical).unionByName(
        presets.select("scenario_id", *encoder.numeric, *encoder.categorical)
    )
    return models.score_batch(model, encoder, rows, calibration, 0.5, ["scenario_id"])
