"""Exact binary-classifier metrics from score histograms.

Every rank-based number is computed from one row per distinct score (and
model), so ties are exact and nothing is sorted globally.  Predictions are
rows (model, y, p); `by` names the model column or columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz import fixed_values as fv
from strikehaz.operators.ordered import ranked, running_totals

LOG_CLIP = 2.220446049250313e-16


def score_histogram(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, p, pos, neg): labels per distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return pred.groupBy(*(by or []), F.col(p).cast("double").alias("p")).agg(
        F.sum(F.when(F.col(y) == 1, w).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(F.col(y) == 1, 0).otherwise(w)).cast("bigint").alias("neg"),
    )


def cumulative(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Histogram with counts strictly below each score and totals; base of AUC, AP and the curves."""
    return running_totals(score_histogram(pred, y, p, by), ["p"], ["pos", "neg"], by)


def _area_terms() -> tuple[Column, Column]:
    """Per histogram row: its share of ROC-AUC and of average precision."""
    auc = F.col("pos") * (F.col("below_neg") + F.col("neg") / 2) / (F.col("all_pos") * F.col("all_neg"))
    tp = F.col("all_pos") - F.col("below_pos")  # scores at or above this one
    fp = F.col("all_neg") - F.col("below_neg")
    ap = F.col("pos") / F.col("all_pos") * tp / (tp + fp)
    return auc, ap


def rank_metrics(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """roc_auc and average_precision; null when only one class is present."""
    table = cumulative(pred, y, p, by)
    auc, ap = _area_terms()
    both = (F.col("all_pos") > 0) & (F.col("all_neg") > 0)
    return table.groupBy(*(by or [])).agg(
        F.sum(F.when(both, auc)).alias("roc_auc"), F.sum(F.when(both, ap)).alias("average_precision")
    )


def roc_auc(pred: DataFrame, **kw) -> DataFrame:
    return rank_metrics(pred, **kw).drop("average_precision")


def average_precision(pred: DataFrame, **kw) -> DataFrame:
    return rank_metrics(pred, **kw).drop("roc_auc")


def curve_points(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """One row per distinct score: threshold, fpr, tpr, precision, recall."""
    table = cumulative(pred, y, p, by)
    tp, fp = F.col("all_pos") - F.col("below_pos"), F.col("all_neg") - F.col("below_neg")
    return table.select(
        *(by or []), F.col("p").alias("threshold"),
        F.when(F.col("all_neg") > 0, fp / F.col("all_neg")).alias("fpr"),
        F.when(F.col("all_pos") > 0, tp / F.col("all_pos")).alias("tpr"),
        (tp / (tp + fp)).alias("precision"),
        F.when(F.col("all_pos") > 0, tp / F.col("all_pos")).alias("recall"),
    )


def _safe(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(0.0)


def confusion_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Threshold metrics from the four counts; precision, recall and F1 are 0 on an empty denominator."""
    recall, specificity = _safe(tp, tp + fn), F.when(tn + fp > 0, tn / (tn + fp))
    present = [F.when(tp + fn > 0, recall), F.when(tn + fp > 0, tn / (tn + fp))]
    balanced = (F.coalesce(present[0], F.lit(0.0)) + F.coalesce(present[1], F.lit(0.0))) / (
        present[0].isNotNull().cast("int") + present[1].isNotNull().cast("int")
    )
    return {
        "accuracy": (tp + tn) / (tp + fp + fn + tn), "balanced_accuracy": balanced, "precision": _safe(tp, tp + fp),
        "recall": recall, "specificity": specificity, "f1": _safe(tp * 2, tp * 2 + fp + fn),
    }


def threshold_metrics(pred: DataFrame, threshold: float | Column, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Confusion matrix, derived metrics, Brier score and prevalence in one aggregate."""
    hit = F.col(p) >= threshold
    pos = F.col(y) == 1
    counted = pred.groupBy(*(by or [])).agg(
        F.count("*").alias("sample_count"), F.avg(F.when(pos, 1.0).otherwise(0.0)).alias("positive_class_prevalence"),
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
        F.avg(F.pow(F.when(pos, 1.0).otherwise(0.0) - F.col(p), 2)).alias("brier_score"),
    )
    return counted.withColumns(confusion_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def classifier_metrics(pred: DataFrame, threshold: float | Column, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """threshold_metrics with roc_auc, average_precision and a one-class `warning`."""
    base = threshold_metrics(pred, threshold, y, p, by)
    ranks = rank_metrics(pred, y, p, by)
    if by:
        out = base.join(ranks, by, "left")
    else:
        both = ranks.select(F.struct("roc_auc", "average_precision").alias("r")).scalar()
        out = base.withColumn("_r", both).select("*", "_r.*").drop("_r")
    return out.withColumn("warning", F.when(F.col("roc_auc").isNull(), "only one class present; rank metrics undefined"))


def model_comparison(pred: DataFrame, threshold: float | Column, model: str = "model", y: str = "y", p: str = "p") -> DataFrame:
    """One row per model, rounded to four places."""
    names = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier_score"]
    table = classifier_metrics(pred, threshold, y, p, [model])
    return table.select(
        model, "sample_count", F.round("positive_class_prevalence", 4).alias("prevalence"), *[F.round(n, 4).alias(n) for n in names]
    )


def log_loss(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Mean negative log likelihood with probabilities clipped away from 0 and 1."""
    clipped = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - LOG_CLIP)), F.lit(LOG_CLIP))
    return pred.groupBy(*(by or [])).agg(
        F.avg(-F.when(F.col(y) == 1, F.log(clipped)).otherwise(F.log(F.lit(1.0) - clipped))).alias("log_loss")
    )


def efron_r2(pred: DataFrame, train_mean: float | Column, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """1 - sum (y-p)^2 / sum (y - train mean)^2, null when the denominator is 0."""
    sums = pred.groupBy(*(by or [])).agg(
        F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("_res"), F.sum(F.pow(F.col(y) - train_mean, 2)).alias("_tot")
    )
    return sums.select(*(by or []), F.when(F.col("_tot") > 0, F.lit(1.0) - F.col("_res") / F.col("_tot")).alias("efron_pseudo_r2"))


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """RMSE and R2."""
    sums = pred.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.sum(F.pow(F.col(y) - F.col(p), 2)).alias("_res"), F.var_pop(y).alias("_var")
    )
    total = F.col("_var") * F.col("n")
    return sums.select(
        *(by or []), "n", F.sqrt(F.col("_res") / F.col("n")).alias("rmse"),
        F.when(total > 0, F.lit(1.0) - F.col("_res") / total).alias("r2"),
    )


def calibration_curve(pred: DataFrame, n_bins: int = 10, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Uniform bins: mean score and observed rate; an edge value belongs to the lower bin, empty bins vanish."""
    bin_of = F.expr(f"size(filter({_doubles([i / n_bins for i in range(1, n_bins)])}, e -> e < `{p}`))")
    return pred.groupBy(*(by or []), bin_of.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed_rate")
    )


def risk_deciles(pred: DataFrame, id_col: str, n_bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Equal-count bins in score order with edges floor(i * N / n).

    Ties at an edge are settled by id, neutrally with respect to the label.
    Rows without a score have no decile and do not count towards N.
    """
    scored = ranked(pred.where(F.col(p).isNotNull()).select(id_col, y, p), p, id_col)
    decile = F.floor((F.lit(n_bins) * (F.col("rank") + 1) - 1) / F.col("n_total")) + 1
    return scored.groupBy(decile.cast("int").alias("risk_decile")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted_mean_probability"), F.avg(F.col(y).cast("double")).alias("observed_damage_rate")
    )


def _doubles(values: list[float]) -> str:
    """SQL array literal of exact doubles."""
    return "array(" + ", ".join(f"{v!r}D" for v in values) + ")"


def threshold_scan(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The 199 candidate thresholds with their confusion counts.

    Scores are first reduced to 'how many candidates lie at or below', at most
    200 rows; only these are accumulated.
    """
    lo, hi, k = fv.THRESHOLD_LOW, fv.THRESHOLD_HIGH, fv.THRESHOLD_COUNT
    step = (hi - lo) / (k - 1)
    grid = [lo + i * step for i in range(k - 1)] + [hi]
    # candidates at or below the score: the even spacing gives the position, its neighbours settle rounding
    guess = f"CAST(least(greatest(floor((`{p}` - {lo!r}D) / {step!r}D) + 1, 0), {k}) AS INT)"
    table = _doubles(grid)
    passed = F.expr(
        f"{guess} + CASE WHEN get({table}, {guess}) <= `{p}` THEN 1 WHEN get({table}, {guess} - 1) > `{p}` THEN -1 ELSE 0 END"
    )
    pos = F.col(y) == 1
    levels = pred.groupBy(passed.alias("level")).agg(F.count_if(pos).alias("pos"), F.count_if(~pos).alias("neg"))
    spark = pred.sparkSession
    ladder = spark.createDataFrame([(0, None), *[(i + 1, t) for i, t in enumerate(grid)]], "level int, threshold double")
    down = Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # over 200 rows
    everyone = Window.partitionBy()
    counts = ladder.join(levels, "level", "left").select(
        "threshold",
        F.sum(F.coalesce("pos", F.lit(0))).over(down).alias("tp"), F.sum(F.coalesce("neg", F.lit(0))).over(down).alias("fp"),
        F.sum(F.coalesce("pos", F.lit(0))).over(everyone).alias("all_pos"),
        F.sum(F.coalesce("neg", F.lit(0))).over(everyone).alias("all_neg"),
    ).where(F.col("threshold").isNotNull())
    return counts.select(
        "threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn")
    )


def tune_threshold(pred: DataFrame, objective: str = "f1", y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, objective, score_at_threshold): best candidate, the lowest on ties."""
    m = confusion_columns(*[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    scores = {
        "f1": m["f1"], "balanced_accuracy": m["balanced_accuracy"],
        "youden_j": m["recall"] + F.coalesce(m["specificity"], F.lit(0.0)) - 1,
    }
    if objective not in scores:
        raise ValueError(f"Unknown threshold objective '{objective}'; expected one of {sorted(scores)}")
    return threshold_scan(pred, y, p).agg(
        F.max_by("threshold", F.struct(scores[objective], -F.col("threshold"))).alias("threshold"),
        F.max(scores[objective]).alias("score_at_threshold"),
    ).select("threshold", F.lit(objective).alias("objective"), "score_at_threshold")


# --- importances -----------------------------------------------------------------

def grouped_importance(per_column: DataFrame, conceptual: list[str], value_col: str, feature_col: str = "feature") -> DataFrame:
    """Dummy-column importances summed (absolute) per original column, longest prefix first."""
    parent = F.lit("_unmatched")
    for name in sorted(conceptual, key=len):
        parent = F.when(F.col(feature_col).startswith(name), name).otherwise(parent)
    return per_column.groupBy(parent.alias("feature")).agg(F.sum(F.abs(value_col)).alias(value_col))
