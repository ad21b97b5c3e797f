"""Shapley values of boosted trees against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from strikehaz.operators import explain, models


@pytest.fixture(scope="module")
def encoded(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    df = spark.range(800).select(
        "id", F.when(h % 11 != 0, h / 100.0).alias("x"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50)).cast("double").alias("z"),
        F.element_at(F.array(*map(F.lit, "abcd")), (h % 4 + 1).cast("int")).alias("c"))
    df = df.withColumn("y", ((F.coalesce("x", F.lit(2.0)) > 4) != (F.col("c") == "b")).cast("double")).withColumn("y", F.when(F.col("id") % 9 == 0, 1.0 - F.col("y")).otherwise(F.col("y")))
    df = df.withColumn("weight", 1.0 + F.col("id") % 3)
    encoder = models.fit_tree(df, ["x", "z"], ["c"], threshold=1)
    return df, encoder, encoder.transform(df).cache()


def expected(nodes, x, known, at=0):
    """The tree's value if only the features in `known` are seen."""
    n = nodes[at]
    if n["left"] < 0:
        return n["prediction"]
    left = int(x[n["feature"]]) in [int(c) for c in n["split"]] if n["categories"] >= 0 else x[n["feature"]] <= n["split"][0]
    if n["feature"] in known:
        return expected(nodes, x, known, n["left"] if left else n["right"])
    return sum(nodes[c]["cover"] / n["cover"] * expected(nodes, x, known, c) for c in (n["left"], n["right"]))


def by_subsets(trees, weights, factor, x):
    every = range(len(x))
    game = {s: factor * sum(w * expected(t, x, s) for t, w in zip(trees, weights)) for k in range(len(x) + 1) for s in itertools.combinations(every, k)}
    out = []
    for i in every:
        phi = 0.0
        for s in game:
            if i not in s:
                share = math.factorial(len(s)) * math.factorial(len(x) - len(s) - 1) / math.factorial(len(x))
                phi += share * (game[tuple(sorted((*s, i)))] - game[s])
        out.append(phi)
    return game[()], out


@pytest.mark.parametrize("classify", [True, False])
@pytest.mark.parametrize("depth", [1, 4])
def test_equal_to_all_subsets(spark, encoded, classify, depth):
    _, encoder, rows = encoded
    kind, extra = (GBTClassifier, {"weightCol": "weight"}) if classify else (GBTRegressor, {})
    model = kind(labelCol="y", maxIter=4, maxDepth=depth, seed=1, **extra).fit(rows)
    leaves = explain.leaf_table(spark, model)
    trees = {}
    for r in explain.tree_nodes(spark, model).collect():
        trees.setdefault(r.tree, {})[r.id] = r.asDict()
    trees, factor = [trees[k] for k in sorted(trees)], 2.0 if classify else 1.0
    x = np.array([r.features.toArray() for r in rows.select("features").limit(40).collect()])
    got = explain.shapley_values(x, leaves)
    for row, phi in zip(x, got):
        base, want = by_subsets(trees, model.treeWeights, factor, row)
        assert abs(base - leaves.base) < 1e-9 and np.allclose(phi, want, atol=1e-9)


def test_contributions_add_up_to_the_margin_of_each_row(spark, encoded):
    df, encoder, rows = encoded
    model = GBTClassifier(labelCol="y", weightCol="weight", maxIter=15, maxDepth=5, seed=1).fit(rows)
    parts = explain.tree_contributions(model, encoder, df, "id", top_n=None)
    added = parts.groupBy("id").agg((F.first("base_value") + F.sum("contribution")).alias("total"), F.first("margin").alias("margin"), F.count("*").alias("n"))
    p = models.probability()
    both = added.join(model.transform(rows).select("id", F.log(p / (F.lit(1.0) - p)).alias("logit")), "id")
    worst = both.agg(F.max(F.abs(F.col("total") - F.col("logit"))), F.max(F.abs(F.col("margin") - F.col("logit"))), F.count("*"), F.min("n"), F.max("n")).first()
    assert worst[0] < 1e-9 and worst[1] < 1e-9 and worst[2:] == (800, 3, 3)
    top = explain.tree_contributions(model, encoder, df, "id", top_n=1).collect()
    assert len(top) == 800 and {r.feature for r in top} <= {"x", "c", "z"} and sum(r.feature == "z" for r in top) < 80
    shown = {r.id: (r.feature, r.value) for r in top}
    own = {r.id: r.asDict() for r in df.collect()}
    assert all(v == (None if own[i][f] is None else str(own[i][f])) for i, (f, v) in shown.items())


def test_edge_frames(spark, encoded):
    df, encoder, rows = encoded
    stump = GBTRegressor(labelCol="y", maxIter=1, maxDepth=2, minInstancesPerNode=790).fit(rows)  # a lone root
    assert all(r.contribution == 0 and abs(r.margin - r.base_value) < 1e-12 for r in explain.tree_contributions(stump, encoder, df.limit(5), "id").collect())
    model = GBTClassifier(labelCol="y", maxIter=3, maxDepth=3).fit(rows)
    odd = spark.createDataFrame([(None, None, None, "new", "q"), (1, 1e9, -5.0, None, "r"), (1, 1e9, -5.0, None, "r")], "id bigint, x double, z double, c string, rank string")
    got = explain.tree_contributions(model, encoder, odd, "id").collect()
    assert len(got) == 9 and all(math.isfinite(r.contribution) for r in got)
    assert explain.tree_contributions(model, encoder, odd.where("false"), "id").count() == 0
