"""Exact Shapley values of boosted trees, row by row.

The value of a set of known features is the path-dependent expectation: where a split's feature is
unknown, both branches count by their share of the training weight.  A tree is a sum over its
leaves, and a leaf is a game of the few distinct features on its path: each is met or not by the row
(o = 1 or 0), and counts z, the product of its shares, where unknown.  The Shapley
value of feature i in that game is

    leaf * (o_i - z_i) * integral over t in [0, 1] of the product over j != i of (z_j + t (o_j - z_j)),

a polynomial in t whose degree is below the number of features on the path, so a Gauss rule of half as
many nodes gives it exactly.  Rows are independent: no shuffle, and the leaf table's size is that of the model.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.operators.models import Encoder
from strikehaz.session import checkpoint_dir

CELLS = 1 << 21  # of the row x leaf x feature arrays held at once


@dataclass(frozen=True)
class Leaves:
    """One row per leaf of all trees, features of its path side by side (-1: none).

    A row of data meets feature k if low < x <= high, or for a category (group >= 0) if `groups[group][x]`.
    `value` has the tree's weight and the link's factor in it, `base` is the expectation over all leaves.
    """

    value: np.ndarray
    feature: np.ndarray
    share: np.ndarray
    low: np.ndarray
    high: np.ndarray
    group: np.ndarray
    groups: np.ndarray
    base: float
    width: int


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """(tree, id, prediction, cover, left, right, feature, split, categories): the nodes of a fitted ensemble, as Spark saves them."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats")[0].alias("cover"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("split"),
        F.col("nodeData.split.numCategories").alias("categories"),
    )


def _paths(nodes: dict[int, dict], at: int, met: dict[int, tuple]) -> Iterator[tuple[float, dict[int, tuple]]]:
    """(prediction, {feature: (share, low, high, categories)}) of every leaf below a node."""
    node = nodes[at]
    if node["left"] < 0:
        yield node["prediction"], met
        return
    f = node["feature"]
    share, low, high, kept = met.get(f, (1.0, -np.inf, np.inf, None))
    for side, child in (("left", node["left"]), ("right", node["right"])):
        part = share * (nodes[child]["cover"] / node["cover"] if node["cover"] else 0.5)
        if node["categories"] < 0:
            cut = node["split"][0]
            now = (part, low, min(high, cut), None) if side == "left" else (part, max(low, cut), high, None)
        else:
            every = frozenset(range(node["categories"]))
            lefts = frozenset(int(c) for c in node["split"])
            now = (part, low, high, (every if kept is None else kept) & (lefts if side == "left" else every - lefts))
        yield from _paths(nodes, child, met | {f: now})


def leaf_table(spark: SparkSession, model) -> Leaves:
    """The leaf table of a fitted boosted classifier (on its log odds) or regressor."""
    factor = 2.0 if isinstance(model, GBTClassificationModel) else 1.0  # probability is 1 / (1 + exp(-2 margin))
    trees: dict[int, dict[int, dict]] = {}
    for r in tree_nodes(spark, model).collect():  # at most trees x 2^(depth + 1) nodes
        trees.setdefault(r.tree, {})[r.id] = r.asDict()
    found = [(factor * weight * p, met) for tree, weight in zip(sorted(trees), model.treeWeights) for p, met in _paths(trees[tree], 0, {})]
    deep = max((len(met) for _, met in found), default=0)
    shape = (len(found), max(deep, 1))
    out = {"feature": np.full(shape, -1), "share": np.ones(shape), "low": np.full(shape, -np.inf), "high": np.full(shape, np.inf), "group": np.full(shape, -1)}
    kinds: dict[frozenset, int] = {}
    for row, (_, met) in enumerate(found):
        for k, (f, (share, low, high, kept)) in enumerate(met.items()):
            out["feature"][row, k], out["share"][row, k], out["low"][row, k], out["high"][row, k] = f, share, low, high
            if kept is not None:
                out["group"][row, k] = kinds.setdefault(kept, len(kinds))
    widest = max((max(k, default=0) for k in kinds), default=0) + 1
    groups = np.zeros((max(len(kinds), 1), widest + 1), bool)  # the last column stands for anything else
    for kept, k in kinds.items():
        groups[k, sorted(kept)] = True
    value = np.array([v for v, _ in found])
    base = float((value * out["share"].prod(axis=1)).sum()) if len(found) else 0.0
    return Leaves(value, **out, groups=groups, base=base, width=int(model.numFeatures))


def _by_value():
    """The function as a local one: Spark sends its code along, so executors need no copy of this package."""

    def values(rows: np.ndarray, leaves) -> np.ndarray:
        """(rows, features): contributions of encoded rows; with `leaves.base` they add up to the margin."""
        size, deep = leaves.feature.shape
        used, known = np.maximum(leaves.feature, 0), leaves.feature >= 0
        at, weight = np.polynomial.legendre.leggauss(deep // 2 + 1)
        at, weight = (at + 1) / 2, weight / 2
        place = np.zeros((size * deep, leaves.width))
        place[np.arange(size * deep)[known.ravel()], leaves.feature.ravel()[known.ravel()]] = 1.0
        out = np.zeros((len(rows), leaves.width))
        step = max(1, CELLS // max(size * deep, 1))
        for start in range(0, len(rows), step):
            x = rows[start : start + step][:, used]
            code = np.clip(np.nan_to_num(x, nan=-1.0), -1, leaves.groups.shape[1] - 1).astype(np.int64)  # -1 and too large ones: the last column
            met = np.where(leaves.group >= 0, leaves.groups[np.maximum(leaves.group, 0), code], (x > leaves.low) & (x <= leaves.high)) | ~known
            gap = met - leaves.share
            total = np.zeros_like(gap)
            for t, w in zip(at, weight):
                factors = leaves.share + t * gap
                before, after = np.ones_like(gap), np.ones_like(gap)
                for k in range(1, deep):
                    before[..., k] = before[..., k - 1] * factors[..., k - 1]
                    after[..., deep - 1 - k] = after[..., deep - k] * factors[..., deep - k]
                total += w * before * after
            out[start : start + step] = (total * gap * leaves.value[:, None]).reshape(len(x), -1) @ place
        return out

    return values


shapley_values = _by_value()


def tree_contributions(model, encoder: Encoder, df: DataFrame, id_col: str, top_n: int | None = 3) -> DataFrame:
    """(id, base_value, margin, rank, feature, value, contribution): what moved each row's score away from the average.

    Contributions are Shapley values on the scale of the margin (log odds of a classifier); base_value and all of them
    add up to `margin`.  Those of a column and of its missing indicator are one.  Largest size first, ties by name;
    `top_n` None returns all.  value is the row's own, as text.  Rows of any number stay in their tasks.
    """
    columns = [*encoder.categorical, *encoder.numeric]
    leaves = leaf_table(df.sparkSession, model)
    places = {c: [k for k, n in enumerate(encoder.names) if n in (c, f"{c}_missing")] for c in columns}
    shared = df.sparkSession.sparkContext.broadcast(SimpleNamespace(**vars(leaves)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                got = shapley_values(x, table)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1]), pa.array(got.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), lists], [*kept, "_phi"])

    kept = ["_id", *(f"_value_{k}" for k in range(len(columns)))]
    own = df.select("*", F.col(id_col).alias("_id"), *(F.col(c).cast("string").alias(f"_value_{k}") for k, c in enumerate(columns)))
    rows = encoder.transform(own).select(*kept, vector_to_array("features").alias("_x"))
    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"_id {kind}, " + ", ".join(f"{c} string" for c in kept[1:]) + ", _phi array<double>")
    base = leaves.base
    parts = []
    for k, c in enumerate(columns):
        phi = sum((F.col("_phi")[p] for p in places[c][1:]), F.col("_phi")[places[c][0]])
        parts.append(F.struct((-F.abs(phi)).alias("size"), F.lit(c).alias("feature"), F.col(f"_value_{k}").alias("value"), phi.alias("contribution")))
    ordered = F.sort_array(F.array(*parts))
    margin = F.aggregate("_phi", F.lit(base), lambda a, x: a + x)
    shown = found.select(F.col("_id").alias(id_col), F.lit(base).alias("base_value"), margin.alias("margin"),
                         F.posexplode(ordered if top_n is None else F.slice(ordered, 1, top_n)).alias("_rank", "_c"))
    return shown.select(id_col, "base_value", "margin", (F.col("_rank") + 1).alias("rank"), "_c.feature", "_c.value", "_c.contribution")
