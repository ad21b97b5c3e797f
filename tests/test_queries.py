"""Registered queries against their SQL on the small tables, and the model bundle round trip."""

import inspect

import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import compare
from strikehaz.operators import metrics, models, splits
from strikehaz.plans import registry
from strikehaz.plans.model_queries import framed

SF = "/root/testdata/sf0.001"
FAST = [
    "species_local_risk", "ga_damage_target", "counts_validation_report", "airport_day_rollup", "season_rates", "annual_pooled", "crosstab_reconcile",
    "airport_site_links", "nearest_site", "lookback_totals", "asof_weather", "join_quality", "chronological_split", "classifier_metrics", "esri_features",
]


def test_registry_is_consistent():
    plans, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert len(plans) > 90 and set(oracles) <= set(plans)
    assert all(p.__doc__ for p in registry.QUERIES.values())


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    plan, sql = entry_points.queries()[name], entry_points.oracle_sql()[name]
    assert compare.difference(plan(spark, SF), compare.connect(SF), sql) is None


def test_bundle_round_trip_scores_the_same(spark, tmp_path):
    built, train, validation, test = framed(spark, SF)
    encoder = models.fit_dense(train, built.numeric, built.categorical, threshold=5)
    model = models.fit_logistic(encoder.transform(train), max_iter=5)
    scored = model.transform(encoder.transform(validation)).select("y", models.probability().alias("p"))
    calibration = models.select_calibration(scored, min_isotonic=10)
    assert calibration.brier[calibration.method] == min(calibration.brier.values()) and "isotonic" in calibration.brier
    before = models.score_batch(model, encoder, test, calibration, 0.5, ["id"])
    seen, ranges = splits.seen_categories(train, built.categorical), splits.numeric_ranges(train, built.numeric)
    models.save_bundle(str(tmp_path / "b"), model, encoder, calibration, 0.5, seen, ranges, "v1")
    again, encoder2, calibration2, threshold, seen2, _, version = models.load_bundle(spark, str(tmp_path / "b"), LogisticRegressionModel)
    after = models.score_batch(again, encoder2, test, calibration2, threshold, ["id"])
    gap = before.join(after.select("id", F.col("probability").alias("q")), "id").agg(F.max(F.abs(F.col("probability") - F.col("q"))), F.count("*")).first()
    assert gap[0] < 1e-12 and gap[1] == test.count() and version == "v1" and seen2.count() == seen.count()


def test_contributions_add_up_and_planted_signal_is_found(spark):
    df = spark.range(600).select("id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("x"), (F.pmod(F.col("id"), F.lit(7)) * 1.0).alias("noise"), F.lit("a").alias("c"))
    df = df.withColumn("y", F.when(F.col("x") > 5, 1.0).otherwise(0.0))
    encoder = models.fit_dense(df, ["x", "noise"], ["c"], threshold=1)
    model = models.fit_logistic(encoder.transform(df))

    def score(frame):
        return model.transform(encoder.transform(frame)).select("*", models.probability().alias("p"))

    assert metrics.rank_metrics(score(df)).first().roc_auc > 0.99
    drops = {r.feature: r.mean_roc_auc_drop for r in models.permutation_importance(score, df, "id", ["x", "noise"], repeats=2).collect()}
    assert drops["x"] > 0.3 and abs(drops["noise"]) < 0.05
    parts = models.local_contributions(model, encoder, df, df, "id", top_n=3)
    total = parts.groupBy("id").agg((F.first("base_value") + F.sum("contribution")).alias("z"))
    logit = score(df).select("id", F.log(F.col("p") / (F.lit(1.0) - F.col("p"))).alias("l"))
    assert total.join(logit, "id").agg(F.max(F.abs(F.col("z") - F.col("l")))).first()[0] < 1e-6


def test_importance_from_parts_equals_scoring_every_shuffle(spark):
    df = spark.range(500).select(
        "id", (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("x"), F.when(F.col("id") % 9 > 0, F.pmod(F.col("id"), F.lit(7)) * 1.0).alias("gaps"),
        F.concat(F.lit("k"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(4)).cast("string")).alias("c"), F.lit("a").alias("same"))
    df = df.withColumn("y", F.when(F.col("x") + F.when(F.col("c") == "k1", 4.0).otherwise(0.0) > 6, 1.0).otherwise(0.0))
    encoder = models.fit_dense(df, ["x", "gaps"], ["c", "same"], threshold=1)
    model = models.fit_logistic(encoder.transform(df))
    columns = ["x", "gaps", "c", "same"]
    unseen = df.withColumn("c", F.when(F.col("id") % 50 == 0, "new").otherwise(F.col("c")))

    def score(frame):
        return model.transform(encoder.transform(frame)).select("*", vector_to_array("rawPrediction")[1].alias("p"))

    def parts(frame):
        return models.column_parts(model, encoder, frame, ["id", "y"])

    margins = parts(unseen).join(score(unseen).select("id", "p"), "id")
    assert margins.agg(F.max(F.abs(F.col("margin") - F.col("p")))).first()[0] < 1e-9
    plain = {r.feature: (r[1], r[2]) for r in models.permutation_importance(score, unseen, "id", columns, repeats=2).collect()}
    fast = {r.feature: (r[1], r[2]) for r in models.permutation_importance(None, unseen, "id", columns, repeats=2, parts=parts).collect()}
    assert plain.keys() == fast.keys() == set(columns) and fast["same"] == (0.0, 0.0) and fast["x"][0] > 0.2
    assert all(abs(plain[c][0] - fast[c][0]) < 1e-3 and abs(plain[c][1] - fast[c][1]) < 1e-3 for c in columns)
    assert models.permutation_importance(None, unseen.where("false"), "id", columns, repeats=2, parts=parts).count() == 0


def test_shuffles_are_numbered_in_slices(spark, monkeypatch):
    """Seeded orders over many slices give the permutations of a plain sort."""
    monkeypatch.setattr(models, "SLICE_ROWS", 7)
    ids = spark.createDataFrame([(i * i - 50,) for i in range(60)], "id long")
    for order in (F.xxhash64, lambda i, salt: F.unhex(F.md5(F.concat_ws(":", i.cast("string"), salt.cast("string"))))):
        made = models._shuffled(ids, "id", 3, 42, order)
        got = {(r.repeat, r._id): r._other for r in made.collect()}
        want = {}
        for repeat in range(3):
            here, there = ([r.id for r in ids.orderBy(order(F.col("id"), F.lit(repeat * 2 + 42 + k))).collect()] for k in (0, 1))
            want |= {(repeat, a): b for a, b in zip(here, there)}
        assert got == want
    with pytest.raises(ValueError):
        models._shuffled(ids, "id", 1, 42, lambda i, salt: F.md5(i.cast("string")))


def test_splits_of_a_model_parse_the_raw_text_once(spark):
    """Train, validation and test read one checkpoint, not the source again."""
    for part in framed(spark, SF)[1:]:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "LogicalRDD" in plan and "parquet" not in plan
    assert sum(part.count() for part in framed(spark, SF)[1:]) == framed(spark, SF)[0].frame.count()


def test_model_queries_run_the_whole_job(spark, monkeypatch):
    """All columns, all grid points and the operators' own numbers of trees and repeats reach the operators."""
    from strikehaz import fixed_values as fv
    from strikehaz.plans import model_queries

    calls = {}

    def noted(name, out):
        plain = getattr(models, name)

        def run(*args, **kwargs):
            bound = inspect.signature(plain).bind(*args, **kwargs)
            bound.apply_defaults()
            calls[name] = bound.arguments
            return out

        monkeypatch.setattr(models, name, run)

    noted("permutation_importance", None)
    noted("search_gbt", (None, [{"depth": 4}]))
    noted("fit_gbt", None)
    model_queries.permutation_importance(spark, SF)
    model_queries.gbt_search(spark, SF)
    encoder = model_queries._gbt(spark, SF)[1]
    assert len(encoder.numeric) + len(encoder.categorical) == 19
    assert sorted(calls["permutation_importance"]["columns"]) == sorted([*encoder.numeric, *encoder.categorical])
    assert calls["permutation_importance"]["repeats"] == 5
    assert calls["search_gbt"]["grid"] == fv.GBT_GRID and calls["search_gbt"]["iterations"] == calls["fit_gbt"]["iterations"] == 100
