"""Models on Spark MLlib with train-only encoders, calibration, scoring and explanations."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikehaz import fixed_values as fv
from strikehaz.operators.metrics import log_loss, rank_metrics
from strikehaz.operators.ordered import SLICE_ROWS
from strikehaz.operators.scoring import risk_band, score_class
from strikehaz.operators.spatial import exchanged
from strikehaz.operators.splits import bucket_rare, frequent_categories
from strikehaz.session import durable


def _filled(df: DataFrame, categorical: list[str], token: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(token)) for c in categorical})


@dataclass
class Encoder:
    """Rare-category table and fitted stages; applies to any later frame unchanged."""

    numeric: list[str]
    categorical: list[str]
    frequent: DataFrame
    stages: PipelineModel
    names: list[str] = field(default_factory=list)

    def transform(self, df: DataFrame) -> DataFrame:
        bucketed = _filled(bucket_rare(df, self.frequent, self.categorical), self.categorical, fv.MISSING_TOKEN)
        return self.stages.transform(_marked(bucketed, self.numeric))


def _marked(df: DataFrame, numeric: list[str]) -> DataFrame:
    """`df` with a 0/1 column <name>__m for each numeric one: whether it is missing."""
    return df.withColumns({f"{c}__m": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double") for c in numeric})


def fit_dense(train: DataFrame, numeric: list[str], categorical: list[str], threshold: int = fv.RARE_THRESHOLD) -> Encoder:
    """Median impute and standardise; bucket rare, one-hot, unseen categories all zero (M5)."""
    frequent = durable(frequent_categories(train, categorical, threshold))
    ready = durable(_filled(bucket_rare(train, frequent, categorical), categorical, fv.MISSING_TOKEN))
    imputed = [f"{c}__n" for c in numeric]
    stages = Pipeline(stages=[
        Imputer(strategy="median", inputCols=numeric, outputCols=imputed),
        VectorAssembler(inputCols=imputed, outputCol="_numeric"),
        StandardScaler(withMean=True, withStd=True, inputCol="_numeric", outputCol="_scaled"),
        # 'keep' puts unseen values in one last slot, which the encoder drops
        StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical], dropLast=True),
        VectorAssembler(inputCols=["_scaled", *[f"{c}__v" for c in categorical]], outputCol="features"),
    ]).fit(ready)
    labels = stages.stages[3].labelsArray
    names = [*numeric, *[f"{c}_{v}" for c, values in zip(categorical, labels) for v in values]]
    return Encoder(numeric, categorical, frequent, stages, names)


def fit_tree(train: DataFrame, numeric: list[str], categorical: list[str], threshold: int = fv.RARE_THRESHOLD) -> Encoder:
    """Indexed categories with a missing token; numerics at their median where missing, beside an indicator of that (M6)."""
    frequent = durable(frequent_categories(train, categorical, threshold))
    ready = durable(_marked(_filled(bucket_rare(train, frequent, categorical), categorical, fv.MISSING_TOKEN), numeric))
    imputed, missing = [f"{c}__n" for c in numeric], [f"{c}__m" for c in numeric]
    indexer = StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep")
    imputer = Imputer(strategy="median", inputCols=numeric, outputCols=imputed)
    assembler = VectorAssembler(inputCols=[*[f"{c}__i" for c in categorical], *imputed, *missing], outputCol="features")
    stages = Pipeline(stages=[imputer, indexer, assembler]).fit(ready)
    return Encoder(numeric, categorical, frequent, stages, [*categorical, *numeric, *[f"{c}_missing" for c in numeric]])


def balanced_weights(train: DataFrame, label: str = "y") -> DataFrame:
    """`train` with `weight` so both classes weigh the same, from training rows only."""
    totals = train.agg(F.struct(F.count("*").alias("n"), F.sum(label).alias("pos")).alias("s")).scalar()
    rows = train.withColumn("_s", totals)
    share = F.when(F.col(label) == 1, F.col("_s.pos")).otherwise(F.col("_s.n") - F.col("_s.pos"))
    return rows.withColumn("weight", F.col("_s.n") / (share * 2)).drop("_s")


def stratified_dummy(df: DataFrame, train: DataFrame, id_col: str, label: str = "y", seed: int = 42) -> DataFrame:
    """`df` with a 0/1 score drawn with the training prior, fixed by the row id (M7)."""
    prior = train.agg(F.avg(label).alias("m")).scalar()
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return df.withColumn("p", F.when(draw < prior, 1.0).otherwise(0.0))


def probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def fit_logistic(encoded: DataFrame, label: str = "y", max_iter: int = 100):
    """Balanced logistic regression with unit ridge penalty (M7)."""
    rows = durable(balanced_weights(encoded, label).select("features", label, "weight"))
    return LogisticRegression(
        featuresCol="features", labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / max(rows.count(), 1), standardization=False
    ).fit(rows)


def _bins(encoder: Encoder) -> int:
    indexer = next(s for s in encoder.stages.stages if hasattr(s, "labelsArray"))
    return max(32, *[len(v) + 2 for v in indexer.labelsArray])


def _gbt_rows(train: DataFrame, validation: DataFrame, encoder: Encoder, label: str) -> DataFrame:
    """Encoded, weighted rows of both splits, materialised once."""
    rows = balanced_weights(encoder.transform(train), label).withColumn("_v", F.lit(False)).unionByName(
        encoder.transform(validation).withColumns({"weight": F.lit(1.0), "_v": F.lit(True)}), allowMissingColumns=True)
    return durable(rows.select("features", label, "weight", "_v"))


def _boosted(rows: DataFrame, encoder: Encoder, label: str, depth: int, step: float, min_rows: int, iterations: int, seed: int):
    return GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", validationIndicatorCol="_v", maxDepth=depth, stepSize=step,
        minInstancesPerNode=min_rows, maxIter=iterations, maxBins=_bins(encoder), seed=seed,
    ).fit(rows)


def fit_gbt(
    train: DataFrame, validation: DataFrame, encoder: Encoder, label: str = "y", depth: int = 5, step: float = 0.1,
    min_rows: int = 1, iterations: int = 100, seed: int = 42,
):
    """Balanced boosted trees stopping early on the validation rows (M7, M8)."""
    return _boosted(_gbt_rows(train, validation, encoder, label), encoder, label, depth, step, min_rows, iterations, seed)


def search_gbt(
    train: DataFrame, validation: DataFrame, encoder: Encoder, grid: dict[str, list] = fv.GBT_GRID, label: str = "y",
    iterations: int = 100, seed: int = 42,
):
    """(best model, search rows): every grid point with its validation log loss, ROC-AUC and trees kept; least log loss wins (M8).

    MLlib has no leaf penalty; the grid's `l2` is used as the minimum rows per
    leaf, the regulariser it does have.  Rows are encoded once for the whole grid.
    """
    data = _gbt_rows(train, validation, encoder, label)
    held = data.where("_v").select("features", label)
    best, rows = None, []
    for depth, step, l2 in product(grid["depth"], grid["learning_rate"], grid["l2"]):
        model = _boosted(data, encoder, label, depth, step, int(l2), iterations, seed)
        scored = durable(model.transform(held).select(F.col(label).alias("y"), probability().alias("p")))
        loss, auc = log_loss(scored).first()[0], rank_metrics(scored).first()["roc_auc"]
        rows.append({"depth": depth, "learning_rate": step, "min_rows": int(l2), "trees": model.getNumTrees, "val_logloss": loss, "val_roc_auc": auc})
        if best is None or loss < best[0]:
            best = (loss, model)
    return best[1], rows


def fit_severity(train: DataFrame, validation: DataFrame, encoder: Encoder, label: str = "y", depth: int = 5, iterations: int = 100, seed: int = 42):
    """Boosted regressor on the 0-3 severity score (M9)."""
    rows = encoder.transform(train).withColumn("_v", F.lit(False)).unionByName(encoder.transform(validation).withColumn("_v", F.lit(True)))
    rows = durable(rows.select("features", label, "_v"))
    return GBTRegressor(
        featuresCol="features", labelCol=label, validationIndicatorCol="_v", maxDepth=depth, maxIter=iterations,
        maxBins=_bins(encoder), seed=seed,
    ).fit(rows)


# --- calibration -----------------------------------------------------------------

@dataclass
class Calibration:
    """Chosen method with its parameters and the validation Brier scores compared."""

    method: str
    brier: dict[str, float]
    slope: float = 1.0
    intercept: float = 0.0
    isotonic: IsotonicRegressionModel | None = None

    def apply(self, df: DataFrame, p: str = "p", out: str = "p_calibrated") -> DataFrame:
        return _calibrated(df, p, out, self.method, self.slope, self.intercept, self.isotonic)


def _calibrated(df, p, out, method, slope, intercept, isotonic) -> DataFrame:
    if method == "raw":
        return df.withColumn(out, F.col(p))
    if method == "platt":
        return df.withColumn(out, F.lit(1.0) / (F.exp(-(F.col(p) * slope + intercept)) + 1))
    if method == "isotonic":
        scored = isotonic.copy({isotonic.featuresCol: "_feature", isotonic.predictionCol: out})
        return scored.transform(df.withColumn("_feature", F.col(p).cast("double"))).drop("_feature")
    raise ValueError(f"Unknown calibration method '{method}'")


def select_calibration(validation: DataFrame, y: str = "y", p: str = "p", min_isotonic: int = fv.ISOTONIC_MIN_ROWS) -> Calibration:
    """Raw, Platt or isotonic, whichever has the least validation Brier score.

    Fits read the scores as they are, one row per distinct score and label with its count as weight;
    isotonic pools violators inside score ranges before the blocks meet.
    """
    hist = validation.groupBy(F.col(p).cast("double").alias("s"), F.col(y).cast("double").alias("label")).agg(F.count("*").cast("double").alias("w"))
    hist = durable(hist.withColumn("features", array_to_vector(F.array("s"))))
    n = int(hist.agg(F.sum("w")).first()[0])
    platt = LogisticRegression(labelCol="label", weightCol="w", regParam=1.0 / n, standardization=False).fit(hist)
    slope, intercept = float(platt.coefficients[0]), float(platt.intercept)
    isotonic = None
    if n >= min_isotonic:
        isotonic = IsotonicRegression(featuresCol="s", labelCol="label", weightCol="w").fit(hist.select("s", "label", "w"))
    methods = ["raw", "platt"] + (["isotonic"] if isotonic is not None else [])
    scored = validation.select(F.col(y).alias("_y"), F.col(p).cast("double").alias("_p"))
    for m in methods:
        scored = _calibrated(scored, "_p", f"_{m}_p", m, slope, intercept, isotonic)
    brier = scored.agg(*[F.avg(F.pow(F.col(f"_{m}_p") - F.col("_y"), 2)).alias(m) for m in methods]).first().asDict()
    return Calibration(min(methods, key=brier.get), brier, slope, intercept, isotonic)


def score_batch(model, encoder: Encoder, df: DataFrame, calibration: Calibration, threshold: float, keep: list[str]) -> DataFrame:
    """Raw and calibrated probability, class, band and the reading note per row."""
    raw = model.transform(encoder.transform(df)).select(*keep, probability().alias("p"))
    return calibration.apply(raw).select(
        *keep, F.col("p").alias("probability_raw"), F.col("p_calibrated").alias("probability"),
        score_class(F.col("p_calibrated"), threshold).alias("classification"),
        risk_band(F.col("p_calibrated")).alias("risk_band"), F.lit(fv.PREDICTION_NOTE).alias("note"),
    )


# --- explanations ------------------------------------------------------------------

def _table(spark: SparkSession, names: list[str], values, column: str) -> DataFrame:
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], f"feature string, {column} double")


def global_importance(spark: SparkSession, model, encoder: Encoder) -> DataFrame:
    """Tree importances by feature, largest first."""
    return _table(spark, encoder.names, model.featureImportances.toArray(), "importance").orderBy(F.desc("importance"), "feature")


def coefficient_ranking(spark: SparkSession, model, encoder: Encoder) -> DataFrame:
    """Logistic coefficients by absolute size."""
    return _table(spark, encoder.names, model.coefficients.toArray(), "coefficient").orderBy(F.desc(F.abs("coefficient")), "feature")


def local_contributions(model, encoder: Encoder, df: DataFrame, background: DataFrame, id_col: str, top_n: int = 3) -> DataFrame:
    """Per row the largest additive contributions coef * (x - mean) of the linear model.

    Exact on the log-odds scale; base value is the log-odds of the mean row.
    """
    from pyspark.ml.stat import Summarizer

    mean = encoder.transform(background).select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    coef = model.coefficients.toArray()
    known = F.array(*[
        F.struct(F.lit(n).alias("feature"), F.lit(float(c)).alias("c"), F.lit(float(m)).alias("m"))
        for n, c, m in zip(encoder.names, coef, mean)
    ])
    base = float(model.intercept + (coef * mean).sum())
    rows = encoder.transform(df).select(id_col, vector_to_array("features").alias("x"))
    parts = F.zip_with(known, F.col("x"), lambda k, x: F.struct(
        F.abs(k["c"] * (x - k["m"])).alias("size"), k["feature"].alias("feature"), (k["c"] * (x - k["m"])).alias("contribution")
    ))
    ordered = F.slice(F.sort_array(parts, asc=False), 1, top_n)
    return rows.select(id_col, F.lit(base).alias("base_value"), F.posexplode(ordered).alias("rank", "_c")).select(
        id_col, "base_value", (F.col("rank") + 1).alias("rank"), "_c.feature", "_c.contribution"
    )


def column_parts(model, encoder: Encoder, df: DataFrame, keep: list[str]) -> DataFrame:
    """`keep`, `margin` and `parts`: what each numeric, then each categorical column of the encoder adds to the margin of a linear model.

    Reads the scaled numerics and the category numbers, so no one-hot vector is unpacked; unseen categories add 0.
    """
    coef = [float(c) for c in model.coefficients.toArray()]
    labels = next(s for s in encoder.stages.stages if hasattr(s, "labelsArray")).labelsArray
    rows = encoder.transform(df).withColumn("_x", vector_to_array("_scaled"))
    parts, first = [F.lit(c) * F.col("_x")[i] for i, c in enumerate(coef[: len(encoder.numeric)])], len(encoder.numeric)
    for name, values in zip(encoder.categorical, labels):
        weights = F.lit(coef[first: first + len(values)]) if len(values) else F.array().cast("array<double>")
        parts.append(F.coalesce(F.get(weights, F.col(f"{name}__i").cast("int")), F.lit(0.0)))
        first += len(values)
    summed = rows.select(*keep, F.array(*parts).alias("parts"))
    return summed.withColumn("margin", F.aggregate("parts", F.lit(float(model.intercept)), lambda s, v: s + v))


def _leading(key: Column, kind: str) -> Column:
    """The leading 16 bits of a hash as a number from 0, in the order of the hash: an integer of eight bytes, or binary."""
    if kind == "bigint":
        return F.shiftright(key, 48) + 32768
    if kind == "binary":
        return F.conv(F.hex(F.substring(key, 1, 2)), 16, 10).cast("bigint")
    raise ValueError(f"An order must be bigint or binary, not {kind}")


def _shuffled(ids: DataFrame, id_col: str, repeats: int, seed: int, order) -> DataFrame:
    """(repeat, id, _other): every row with another one, a true permutation for each repeat.

    Two seeded orders are numbered side by side for all repeats, in slices by the leading bits of the hashes: no global sort, no task beyond
    a slice.  Only ids travel, hashes are worked out again where they are sorted.  `ids` is read several times; callers cut its lineage.
    """
    known = ids.select(F.col(id_col).alias("_id"))
    each = min(1 << 16, max(1, -(-known.count() // SLICE_ROWS)))

    def numbered(second: int, name: str) -> DataFrame:
        drawn = known.select(F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"), F.col("_id").alias(name))
        key = order(F.col(name), F.col("repeat") * 2 + (seed + second))
        kind = drawn.select(key.alias("h")).dtypes[0][1]
        dealt = drawn.withColumn("_slice", F.shiftright(_leading(key, kind) * each, 16).cast("int"))
        before = Window.partitionBy("repeat").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        sizes = dealt.groupBy("repeat", "_slice").agg(F.count("*").alias("n"))
        sizes = sizes.select("repeat", "_slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_below"))
        row = F.row_number().over(Window.partitionBy("repeat", "_slice").orderBy(key, name)) - 1
        rows = dealt.repartition(each * repeats, "repeat", "_slice").withColumn("_row", row)
        return rows.join(sizes, ["repeat", "_slice"]).select("repeat", name, (F.col("_row") + F.col("_below")).alias("_rank"))

    return numbered(0, "_id").join(exchanged(numbered(1, "_other")), ["repeat", "_rank"]).select("repeat", "_id", "_other")


def _drops(aucs: DataFrame, base: float | None) -> DataFrame:
    drop = F.lit(base).cast("double") - F.col("roc_auc")
    return aucs.groupBy("feature").agg(F.avg(drop).alias("mean_roc_auc_drop"), F.stddev_pop(drop).alias("std_roc_auc_drop"))


def additive_importance(
    scored: DataFrame, id_col: str, columns: list[str], label: str = "y", repeats: int = 5, seed: int = 42, order=F.xxhash64,
) -> DataFrame:
    """Permutation importance of a scorer that adds up its columns, from one encoding pass.

    `scored`: id, label, `margin` and `parts`, one number for each of `columns` (see `column_parts`); ids are unique.  A shuffle swaps one
    part, so no row is encoded or scored again: all (column, repeat) curves come from one histogram of swapped margins.
    `order(id, salt)` gives the seeded orders, a hash as bigint or binary.  Same permutations and result as `permutation_importance`; an empty
    frame gives no rows, one class alone null.
    """
    rows = durable(scored.select(F.col(id_col).alias("_id"), F.col(label).alias("y"), F.col("margin").cast("double").alias("p"), "parts"))
    base = rank_metrics(rows).first()
    theirs = rows.select(F.col("_id").alias("_other"), F.col("parts").alias("_theirs"))
    paired = _shuffled(rows, "_id", repeats, seed, order).join(exchanged(theirs), "_other").drop("_other").join(exchanged(rows), "_id")
    # an unchanged part leaves the margin as it was, to the last bit
    swapped = F.zip_with("parts", "_theirs", lambda mine, other: F.when(mine == other, F.col("p")).otherwise(F.col("p") - mine + other))
    curves = paired.select("repeat", "y", F.posexplode(swapped).alias("_column", "p"))
    aucs = rank_metrics(curves, by=["_column", "repeat"])
    return _drops(aucs.withColumn("feature", F.get(F.lit(columns), F.col("_column"))), base["roc_auc"] if base else None)


def permutation_importance(
    score, df: DataFrame, id_col: str, columns: list[str], label: str = "y", repeats: int = 5, seed: int = 42, parts=None,
) -> DataFrame:
    """(feature, mean_roc_auc_drop, std_roc_auc_drop): AUC lost when one column is shuffled.

    `score(df)` returns the frame with `p`; every column and repeat is scored.  For a linear model give `parts(df)` (see
    `column_parts`) instead, which swaps parts of margins and scores nothing twice.
    """
    if parts is not None:
        return additive_importance(parts(df), id_col, columns, label, repeats, seed)
    base = rank_metrics(score(df).select(F.col(label).alias("y"), "p")).first()["roc_auc"]
    others = df.select(F.col(id_col).alias("_other"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    here = _shuffled(durable(df.select(id_col)), id_col, repeats, seed, F.xxhash64).join(df, F.col("_id") == df[id_col]).drop("_id")
    paired = durable(here.join(others, "_other"))
    scored = None
    for c in columns:
        one = score(paired.withColumn(c, F.col(f"_o_{c}"))).select(F.lit(c).alias("feature"), "repeat", F.col(label).alias("y"), "p")
        scored = one if scored is None else scored.unionByName(one)
    return _drops(rank_metrics(scored, by=["feature", "repeat"]), base)


# --- saved models ------------------------------------------------------------------

def save_bundle(path: str, model, encoder: Encoder, calibration: Calibration, threshold: float, seen: DataFrame, ranges: DataFrame, version: str) -> None:
    """Model, encoder, calibrator and everything scoring needs, as Spark-readable files."""
    spark = seen.sparkSession
    model.write().overwrite().save(f"{path}/model")
    encoder.stages.write().overwrite().save(f"{path}/encoder")
    encoder.frequent.write.mode("overwrite").parquet(f"{path}/frequent")
    seen.write.mode("overwrite").parquet(f"{path}/seen")
    ranges.write.mode("overwrite").parquet(f"{path}/ranges")
    if calibration.isotonic is not None:
        calibration.isotonic.write().overwrite().save(f"{path}/isotonic")
    meta = {
        "numeric": encoder.numeric, "categorical": encoder.categorical, "names": encoder.names, "threshold": threshold,
        "method": calibration.method, "brier": calibration.brier, "slope": calibration.slope, "intercept": calibration.intercept,
        "has_isotonic": calibration.isotonic is not None, "version": version,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_bundle(spark: SparkSession, path: str, model_class):
    """(model, encoder, calibration, threshold, seen, ranges, version) of a saved bundle."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    encoder = Encoder(meta["numeric"], meta["categorical"], spark.read.parquet(f"{path}/frequent"), PipelineModel.load(f"{path}/encoder"), meta["names"])
    isotonic = IsotonicRegressionModel.load(f"{path}/isotonic") if meta["has_isotonic"] else None
    calibration = Calibration(meta["method"], meta["brier"], meta["slope"], meta["intercept"], isotonic)
    return (
        model_class.load(f"{path}/model"), encoder, calibration, meta["threshold"],
        spark.read.parquet(f"{path}/seen"), spark.read.parquet(f"{path}/ranges"), meta["version"],
    )
