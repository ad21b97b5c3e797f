"""Rank metrics, deciles, thresholds, bootstrap, splits and encoders."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikehaz.operators import bootstrap, eda, metrics, ordered, splits


def _frame(spark, rows):
    return spark.createDataFrame([(i, int(y), float(p)) for i, (y, p) in enumerate(rows)], "id long, y int, p double")


def _rows(n, seed, ties=20):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = rng.random() < 0.3
        out.append((y, min(1.0, rng.randrange(ties) / ties + 0.2 * y)))
    return out


@pytest.fixture(params=[200_000, 3], ids=["one-slice", "many-slices"])
def sliced(request, monkeypatch):
    """Run with one slice and with many."""
    monkeypatch.setattr(ordered, "SLICE_ROWS", request.param)
    return request.param


def test_null_groups_scores_ids_and_labels_are_kept(spark, sliced):
    hist = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 1.0, 5), ("a", None, 7)], "g string, k double, n long")
    got = {(r.g, r.k): (r.below_n, r.all_n) for r in ordered.running_totals(hist, ["k"], ["n"], ["g"]).collect()}
    assert got == {(None, 1.0): (0, 5), (None, 2.0): (2, 5), ("a", None): (0, 12), ("a", 1.0): (7, 12)}
    pred = spark.createDataFrame([(None if i % 5 == 0 else i, i % 2, None if i % 2 else i / 100) for i in range(100)], "id long, y int, p double")
    deciles = {r.risk_decile: r.n for r in metrics.risk_deciles(pred, "id").collect()}
    assert deciles == {d: 5 for d in range(1, 11)}
    days = spark.createDataFrame([(None if i % 3 == 0 else i, "6/1/2021" if i < 50 else "2021-06-02", None if i % 4 == 0 else "x") for i in range(60)], "id long, d string, label string")
    parts = splits.chronological_split(days, "d", "id", 0.5, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 30, "validation": 15, "test": 15}
    strata = splits.stratified_split(days, "label", "id", 0.8).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in strata} == {(None, "train"): 12, (None, "test"): 3, ("x", "train"): 36, ("x", "test"): 9}


def test_auc_and_average_precision_equal_definitions(spark, sliced):
    rows = _rows(400, 1)
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({p for _, p in rows}, reverse=True):
        hits = sum(1 for y, p in rows if y and p == s)
        seen += sum(1 for _, p in rows if p == s)
        tp += hits
        ap += hits / len(pos) * tp / seen
    got = metrics.rank_metrics(_frame(spark, rows)).first()
    assert got.roc_auc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)


def test_one_class_is_undefined(spark):
    got = metrics.classifier_metrics(_frame(spark, [(1, 0.2), (1, 0.9)]), 0.5).first()
    assert got.roc_auc is None and got.warning and got.recall == 0.5 and got.specificity is None and got.balanced_accuracy == 0.5


def test_zero_division_gives_zero(spark):
    got = metrics.threshold_metrics(_frame(spark, [(0, 0.1), (1, 0.2)]), 0.9).first()
    assert (got.precision, got.recall, got.f1) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("n", [7, 10, 53, 204])
def test_deciles_have_floor_edges(spark, n, sliced):
    got = {r.risk_decile: r.n for r in metrics.risk_deciles(_frame(spark, _rows(n, n, 5)), "id").collect()}
    edges = [i * n // 10 for i in range(11)]
    assert got == {i + 1: edges[i + 1] - edges[i] for i in range(10) if edges[i + 1] > edges[i]}


def test_log_loss_of_hard_scores(spark):
    rows = [(1, 0.0), (0, 0.0), (1, 1.0), (0, 0.0)]
    got = metrics.log_loss(_frame(spark, rows)).first()[0]
    assert got == pytest.approx(-math.log(2.220446049250313e-16) / 4, rel=1e-6)


def test_threshold_takes_the_lowest_on_ties(spark):
    got = metrics.tune_threshold(_frame(spark, [(0, 0.1), (1, 0.9)]), "youden_j").first()
    assert got.score_at_threshold == 1.0 and 0.1 < got.threshold < 0.11
    with pytest.raises(ValueError):
        metrics.tune_threshold(_frame(spark, [(0, 0.1)]), "accuracy")


def test_calibration_edge_goes_down(spark):
    got = [r.bin for r in metrics.calibration_curve(_frame(spark, [(1, 0.1), (0, 0.1000001), (1, 1.0), (0, 0.0)])).orderBy("bin").collect()]
    assert got == [0, 1, 9]


def test_bootstrap(spark):
    df = _frame(spark, _rows(300, 9))
    got = bootstrap.bootstrap_ci(df, "id", "roc_auc", n_resamples=80).first()
    assert got.ci_low < got.point_estimate < got.ci_high and got.n_resamples_used == 80
    assert bootstrap.bootstrap_ci(df, "id", "roc_auc", n_resamples=80).first() == got  # fixed by row and resample
    few = bootstrap.bootstrap_ci(_frame(spark, _rows(20, 3)), "id", "brier", 20, variant="resample_mean").first()
    assert few.available is False and few.point_estimate is None


def _plain_resamples(df, name, n):
    """The metric of all rows and of every resample, row by row."""
    draws = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda b: bootstrap.poisson_weight(bootstrap.hashed_uniform(F.col("id"), b)))
    out = []
    rows = df.select("y", "p", F.concat(F.array(F.lit(1)), draws).alias("w")).collect()
    for b in range(n + 1):
        held = [(r.p, 1 if r.y == 1 else 0, r.w[b]) for r in rows]
        pos, neg = sum(w for _, y, w in held if y), sum(w for _, y, w in held if not y)
        if not pos or not neg:
            out.append(None)
        elif name == "roc_auc":
            out.append(sum(w * v * ((p > q) + (p == q) / 2) for p, y, w in held if y for q, z, v in held if not z) / (pos * neg))
        elif name == "pr_auc":
            total = 0.0
            for p, y, w in held:
                if y and w:
                    above = [(z, v) for q, z, v in held if q >= p]
                    total += w / pos * sum(v for z, v in above if z) / sum(v for _, v in above)
            out.append(total)
        else:
            out.append(sum(w * (p - y) ** 2 for p, y, w in held) / (pos + neg))
    return out


@pytest.mark.parametrize("name", ["roc_auc", "pr_auc", "brier"])
@pytest.mark.parametrize("slice_rows", [7, 10_000])
def test_bootstrap_equals_row_by_row(spark, name, slice_rows):
    tied = [(y, 0.5) for y in (0, 1, 1, 0, 0) * 9]  # one score held by a third of the rows, over many slices
    df = _frame(spark, _rows(90, 4) + tied)
    values, rows, positives = bootstrap.resampled(df, "id", name, 12, slice_rows=slice_rows)
    want = _plain_resamples(df, name, 12)
    assert (rows, positives) == (135, df.where("y = 1").count())
    assert all((w is None and math.isnan(v)) or abs(v - w) < 1e-12 for v, w in zip(values, want))


def test_numpy_draws_equal_the_column_draws(spark):
    """Draws are worked out by numpy, bit for bit those of the columns, for ids of any type and absent ones."""
    ids = spark.sql("SELECT * FROM VALUES (CAST(7 AS BIGINT), 'a'), (-1, NULL), (NULL, 'bc'), (9000000000000000000, '') t(i, s)")
    for col in ("i", "s"):
        made = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda b: bootstrap.hashed_uniform(F.col(col), b))
        for r in ids.select(bootstrap.HASHED.row(F.col(col)).alias("row"), made.alias("u")).collect():
            got = bootstrap.HASHED.numbers(np.array([[r.row]]), np.arange(1, 41)[None, :])
            assert got.tolist() == [r.u]
    steps = bootstrap._poisson_bounds()
    odd = bootstrap.Uniform(lambda i: i, lambda rows, resamples: np.array([steps + [0.0, 0.999]])[:, : resamples.shape[1]] + rows * 0.0)
    n = len(steps) + 2
    frame = spark.sql("SELECT * FROM VALUES (1, 1, 0.5D), (2, 0, 0.5D), (NULL, 0, 0.25D) t(id, y, p)")

    def zeros(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        return neg.sum(axis=0)

    values, _, _ = bootstrap.resampled(frame, "id", zeros, n, uniform=odd)
    want = [k + 1 for k in range(len(steps))] + [0, next(k for k, b in enumerate(steps) if 0.999 < b)]
    assert [v for v in values[1:] if v == v] == [w + len(steps) for w in want if w]  # no id: beyond all bounds, as `poisson_weight` has it


def test_bootstrap_of_a_callers_metric_and_edge_tables(spark):
    def positives_share(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        return pos.sum(axis=0) / (all_pos + all_neg)

    df = _frame(spark, _rows(200, 5))
    got = bootstrap.bootstrap_ci(df, "id", positives_share, 50, slice_rows=30).first()
    assert got.metric == "positives_share" and got.ci_low < got.point_estimate < got.ci_high
    assert abs(got.point_estimate - df.where("y = 1").count() / df.count()) < 1e-12
    for odd in (df.where("false"), df.where("y = 1"), df.limit(1)):
        row = bootstrap.bootstrap_ci(odd, "id", "roc_auc", 10).first()
        assert row.available is False and row.point_estimate is None and row.n_resamples_used == 0
    holes = spark.createDataFrame([(None, 1, None), (2, None, 0.5), (3, 0, float("nan")), (3, 1, 0.2)] * 20, "id int, y int, p double")
    for name in bootstrap.METRICS:
        assert bootstrap.bootstrap_ci(holes, "id", name, 20, slice_rows=9).first().available
    with pytest.raises(ValueError):
        bootstrap.bootstrap_ci(df, "id", "kappa", 10)


def test_chronological_split(spark, sliced):
    rows = [(i, f"2020-{1 + i % 3:02d}-01") for i in range(100)] + [(1000, None)]
    df = spark.createDataFrame(rows, "id long, d string")
    parts = splits.chronological_split(df, "d", "id")
    sizes = {r.split: r.n for r in parts.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 70, "validation": 15, "test": 15}
    last = {r.split: (r.first_date, r.last_date) for r in splits.split_boundaries(parts, "d").collect()}
    assert last["train"][1] <= last["validation"][0] <= last["validation"][1] <= last["test"][0]
    again = splits.chronological_split(df.orderBy(F.desc("id")), "d", "id")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in parts.collect()}
    with pytest.raises(ValueError):
        splits.chronological_split(df, "d", "id", 0.9, 0.1)


def test_holdouts_and_year_split(spark):
    df = spark.createDataFrame([("A", "2019", "2019-05-01"), ("B", "2021", "2021-01-01"), ("B", None, None), ("C", "2024", "2024-02-02")], "a string, y string, d string")
    assert [r.split for r in splits.year_split(df, "y").orderBy("y").collect()] == ["train", "validation", "test"]
    assert splits.holdout_by_values(df, "a", ["B"]).where("held_out").count() == 2
    assert [r.a for r in splits.holdout_latest_year(df, "d").where("held_out").collect()] == ["C"]


def test_rare_categories_fit_on_train_only(spark):
    train = spark.createDataFrame([("A",)] * 10 + [("B",)] * 3 + [("C",)], "c string")
    other = spark.createDataFrame([("A",), ("B",), ("Z",), (None,)], "c string")
    frequent = splits.frequent_categories(train, ["c"], 5)
    expected = ["A", "rare_other", "rare_other", None]
    joined = [r.c for r in splits.bucket_rare(other, frequent, ["c"]).collect()]
    assert sorted(joined, key=str) == sorted(expected, key=str)


def test_stratified_split_and_standardise(spark):
    df = spark.createDataFrame([(i, i % 4 == 0, float(i)) for i in range(200)], "id long, y boolean, x double")
    parts = splits.stratified_split(df, "y", "id", 0.8)
    got = {(r.y, r.split): r.n for r in parts.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    assert got == {(True, "train"): 40, (True, "test"): 10, (False, "train"): 120, (False, "test"): 30}
    flat = splits.standardised(df.withColumn("k", F.lit(5.0)), df.withColumn("k", F.lit(5.0)), ["x", "k"])
    mean = flat.agg(F.avg("x"), F.stddev_pop("x"), F.max("k")).first()
    assert mean[0] == pytest.approx(0, abs=1e-9) and mean[1] == pytest.approx(1) and mean[2] == 0.0


def test_spearman_perfect_and_missing(spark):
    df = spark.createDataFrame([(float(i), float(i) ** 3, None if i % 2 else float(-i)) for i in range(20)], "a double, b double, c double")
    got = {(r.a, r.b): (r.n, r.rho) for r in eda.spearman(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (20, pytest.approx(1.0)) and got["a", "c"] == (10, pytest.approx(-1.0))
