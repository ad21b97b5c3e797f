"""Bootstrap intervals from score slices that meet arrays of resample weights.

Rows are dealt out once by ranges of the score.  A task walks through its slice in order and keeps one running total per
resample, so no (row, resample) pair is ever a row of its own; numpy draws the weights of some rows at a time.  Slices meet only through their totals:
a first walk gives each slice's totals, a second one starts from what lies below.  A score held by very many rows is
spread over slices, and counted whole by the first slice that has it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.session import durable

#: Rows of a slice, and the most slices; a slice is walked through in pieces, so a long one needs no more memory.
SLICE_ROWS, MOST_SLICES = 20_000, 512


def _by_value() -> dict[str, Callable]:
    """Metrics as local functions: Spark sends their code along, so executors need no copy of this package."""

    def roc_auc(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        return (pos * (below_neg + neg / 2)).sum(axis=0) / (all_pos * all_neg)

    def pr_auc(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        reached = (all_pos - below_pos) + (all_neg - below_neg)
        return (pos / all_pos * np.divide(all_pos - below_pos, reached, out=np.zeros_like(reached), where=reached > 0)).sum(axis=0)

    def brier(p, pos, neg, below_pos, below_neg, all_pos, all_neg):
        known = np.isfinite(p)
        q = np.where(known, p, 0.0)
        return (((1 - q) ** 2 * known) @ pos + (q**2) @ neg) / (all_pos + all_neg)

    return {"roc_auc": roc_auc, "pr_auc": pr_auc, "brier": brier}


#: A metric is a sum over distinct scores, highest last: f(p, pos, neg, below_pos, below_neg, all_pos, all_neg) gives each
#: resample's part of some scores, from (scores x resamples) weights of both labels, the weights strictly below, and all.
METRICS = _by_value()


def _poisson_bounds() -> list[float]:
    """Upper bounds of the Poisson(1) inverse distribution, as far as doubles tell them apart."""
    term, total, out = math.exp(-1), 0.0, []
    while total + term > total:
        total += term
        out.append(total)
        term /= len(out)
    return out


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw of a uniform number in [0, 1)."""
    bounds = _poisson_bounds()
    out = F.when(u < bounds[0], 0)
    for k, b in enumerate(bounds[1:], 1):
        out = out.when(u < b, k)
    return out.otherwise(len(bounds))


def hashed_uniform(row_id: Column, resample: Column, seed: int = 42) -> Column:
    """Uniform number fixed by (row, resample, seed): the same on every executor and retry."""
    return F.pmod(F.xxhash64(row_id, resample, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


@dataclass(frozen=True)
class Uniform:
    """Uniform numbers in [0, 1) of (row, resample): `row(id)` is one integer column that Spark works out, `numbers` maps
    (rows x 1) of those and (1 x resamples) to (rows x resamples) doubles, in numpy: an expression over the resamples of a row would be
    interpreted number by number."""

    row: Callable[[Column], Column]
    numbers: Callable[[np.ndarray, np.ndarray], np.ndarray]


def hashed_numbers(seed: int = 42) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """`hashed_uniform` from xxhash64 of the id: the hash goes on over the resample and the seed, both integers of four bytes."""

    def numbers(rows: np.ndarray, resamples: np.ndarray) -> np.ndarray:
        p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
        h = rows.astype(np.uint64)
        with np.errstate(over="ignore"):
            for value in (resamples, np.array([[seed]])):
                h = (h + (p5 + np.uint64(4))) ^ ((value.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * p1)
                h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
                h ^= h >> np.uint64(33)
                h *= p2
                h ^= h >> np.uint64(29)
                h *= p3
                h ^= h >> np.uint64(32)
        return (h & np.uint64((1 << 52) - 1)) / float(1 << 52)

    return numbers


#: Fixed by (row, resample, seed 42) like `hashed_uniform`, and equal to it.
HASHED = Uniform(F.xxhash64, hashed_numbers())


def _walks():
    """The two walks over a slice, by value like the metrics."""

    def drawn_rows(batches: Iterator[pa.RecordBatch], n: int, uniform: Callable, bounds: np.ndarray, cells: int = 1 << 16):
        """(p, hit, weights) of some rows at a time: the row itself, then its Poisson(1) weight in each of `n` resamples."""
        piece, resamples = max(1, cells // (n + 1)), np.arange(1, n + 1)[None, :]
        for batch in batches:
            p, hit = batch.column("p").to_numpy(), batch.column("hit").to_numpy(zero_copy_only=False)
            numbers, missing = batch.column("row").fill_null(0).to_numpy()[:, None], batch.column("row").is_null().to_numpy(zero_copy_only=False)
            for start in range(0, len(p), piece):
                some = uniform(numbers[start: start + piece], resamples)
                counts = np.zeros(some.shape, np.uint8)
                for b in bounds[:6]:
                    counts += some >= b
                most = counts == 6
                if most.any():
                    counts[most] = np.searchsorted(bounds, some[most], side="right")
                counts[missing[start: start + piece]] = len(bounds)  # no number is below no bound, as in `poisson_weight`
                weights = np.ones((len(some), n + 1))
                weights[:, 1:] = counts
                yield p[start: start + piece], hit[start: start + piece], weights

    def distinct_scores(drawn):
        """(p, pos, neg) of the distinct scores of a sorted slice, some at a time, none split."""
        held = None
        for p, hit, weights in drawn:
            edges = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            pos = weights * hit[:, None]
            neg = weights - pos
            if len(edges) < len(p):
                pos, neg = np.add.reduceat(pos, edges), np.add.reduceat(neg, edges)
                p = p[edges]
            if held is not None and held[0][0] == p[0]:
                pos[0] += held[1][0]
                neg[0] += held[2][0]
            elif held is not None:
                yield held
            if len(p) > 1:
                yield p[:-1], pos[:-1], neg[:-1]
            held = p[-1:], pos[-1:], neg[-1:]
        if held is not None:
            yield held

    def totals(batches: Iterator[pa.RecordBatch], slices, draw: tuple) -> Iterator[pa.RecordBatch]:
        """One row: first and last score, and both labels' weights of all scores, the first and the last."""
        number, rest = slices(batches)
        first = last = whole = None
        for p, hit, weights in drawn_rows(rest, *draw):
            labels = np.stack([hit, ~hit]).astype(np.float64)
            ends, both = np.searchsorted(p, p[0], side="right"), labels @ weights
            head = labels[:, :ends] @ weights[:ends]
            begin = np.searchsorted(p, p[-1])
            tail = labels[:, begin:] @ weights[begin:]
            if whole is None:
                first, whole = (p[0], head), both
            else:
                whole = whole + both
                if p[0] == first[0]:
                    first = (p[0], first[1] + head)
            last = (p[-1], tail + last[1] if last is not None and last[0] == p[-1] else tail)
        if whole is not None:
            sums = np.concatenate([whole, first[1], last[1]])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([float(first[0])]), pa.array([float(last[0])]), pa.array([sums.tobytes()], pa.binary())], ["slice", "first", "last", "sums"])

    def parts(batches: Iterator[pa.RecordBatch], slices, draw: tuple, metric: Callable, starts: dict, merged: dict, all_pos: np.ndarray, all_neg: np.ndarray) -> Iterator[pa.RecordBatch]:
        """One row: the slice's part of the metric of every resample."""
        number, rest = slices(batches)
        below = [s.copy() for s in starts[number]] if number in starts else None
        out = np.zeros(len(all_pos))
        for p, pos, neg in distinct_scores(drawn_rows(rest, *draw)):
            mine = np.ones(len(p), bool)
            for k in {0, len(p) - 1}:
                if float(p[k]) in merged:
                    owner, some, others = merged[float(p[k])]
                    mine[k] = owner == number
                    pos[k], neg[k] = some, others
            p, pos, neg = p[mine], pos[mine], neg[mine]
            if len(p):
                up_pos, up_neg = np.cumsum(pos, axis=0), np.cumsum(neg, axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out += metric(p, pos, neg, below[0] + up_pos - pos, below[1] + up_neg - neg, all_pos, all_neg)
                below = [below[0] + up_pos[-1], below[1] + up_neg[-1]]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["part"])

    def numbered(batches: Iterator[pa.RecordBatch]):
        """The slice's number and its batches."""
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return -1, iter(())
        return first.column("slice")[0].as_py(), (b for group in ([first], batches) for b in group)

    return totals, parts, numbered


def resampled(
    pred: DataFrame, id_col: str, metric: str | Callable = "roc_auc", n_resamples: int = 500, y: str = "y", p: str = "p",
    uniform: Uniform = HASHED, slice_rows: int = SLICE_ROWS,
) -> tuple[np.ndarray, float, float]:
    """(values, rows, positives): the metric of all rows, then of each Poisson resample; not a number where a label is missing.

    `metric` is a name of METRICS or a function like those.  A null label counts as 0; null scores come first in order.
    What reaches the driver is a few numbers for each slice and resample, whatever the number of rows.
    """
    if isinstance(metric, str) and metric not in METRICS:
        raise ValueError(f"Unknown bootstrap metric '{metric}'")
    call = METRICS[metric] if isinstance(metric, str) else metric
    score = F.col(p).cast("double")
    narrow = pred.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(y) == 1, F.lit(False)).alias("hit"),
        F.when(score.isNull(), float("-inf")).when(F.isnan(score), float("inf")).otherwise(score + 0.0).alias("p"),
        uniform.row(F.col(id_col)).cast("bigint").alias("row"))
    narrow = durable(narrow)
    slices = int(min(MOST_SLICES, max(1, -(-narrow.count() // slice_rows))))
    dealt = narrow.repartitionByRange(slices, "p", F.pmod(F.xxhash64("id"), F.lit(4096))).withColumn("slice", F.spark_partition_id())
    sliced = durable(dealt.sortWithinPartitions("p"))
    drawn, draw = sliced, (n_resamples, uniform.numbers, np.array(_poisson_bounds()))
    totals, parts, numbered = _walks()
    size = n_resamples + 1
    found = {}
    for r in drawn.mapInArrow(lambda b: totals(b, numbered, draw), "slice bigint, first double, last double, sums binary").collect():  # one row for each slice
        found[r.slice] = (r.first, r.last, np.frombuffer(bytes(r.sums)).reshape(6, size))
    if not found:
        return np.full(size, np.nan), 0.0, 0.0
    ends: dict[float, list] = {}
    for k in sorted(found):
        first, last, sums = found[k]
        for value, mine in {first: sums[2:4], last: sums[4:6]}.items():
            ends.setdefault(value, []).append((k, mine))
    merged = {v: (held[0][0], *sum(m for _, m in held)) for v, held in ends.items() if len(held) > 1}
    starts, below = {}, np.zeros((2, size))
    for k in sorted(found):
        first, last, sums = found[k]
        starts[k] = (below[0].copy(), below[1].copy())
        own = sums[:2].copy()
        for value, mine in {first: sums[2:4], last: sums[4:6]}.items():
            if value in merged:
                own += (np.stack(merged[value][1:]) if merged[value][0] == k else 0.0) - mine
        below = below + own
    shared = pred.sparkSession.sparkContext.broadcast((starts, merged, below[0], below[1]))
    summed = np.zeros(size)
    for r in drawn.mapInArrow(lambda b: parts(b, numbered, draw, call, *shared.value), "part binary").collect():
        summed += np.frombuffer(bytes(r.part))
    return np.where((below[0] > 0) & (below[1] > 0), summed, np.nan), float(below[:, 0].sum()), float(below[0, 0])


def bootstrap_ci(
    pred: DataFrame, id_col: str, metric: str | Callable = "roc_auc", n_resamples: int = 500, confidence: float = 0.95,
    variant: str = "full_sample", y: str = "y", p: str = "p", uniform: Uniform = HASHED,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Percentile interval of a metric over Poisson resamples.

    A row enters each resample with a Poisson(1) weight, the distributed form of
    drawing with replacement.  One-class resamples are skipped.  `full_sample` reports
    the metric of all rows; `resample_mean` reports the mean over resamples and
    refuses (available = false) below 30 rows, 10 positives or half usable
    resamples.  `metric` may be a caller's own function, see METRICS.
    """
    if variant not in ("full_sample", "resample_mean"):
        raise ValueError(f"Unknown bootstrap variant '{variant}'")
    values, rows, positives = resampled(pred, id_col, metric, n_resamples, y, p, uniform, slice_rows)
    used = values[1:][~np.isnan(values[1:])]
    if variant == "full_sample":
        available, point = len(used) > 0, values[0]
    else:
        available = bool(rows >= 30 and positives >= 10 and len(used) >= 0.5 * n_resamples and len(used))
        point = used.mean() if len(used) else None
    low, high = np.quantile(used, [(1 - confidence) / 2, (1 + confidence) / 2]) if len(used) else (None, None)
    shown = [float(x) if available and x is not None and not np.isnan(x) else None for x in (point, low, high)]
    name = metric if isinstance(metric, str) else metric.__name__
    return pred.sparkSession.createDataFrame(
        [(name, bool(available), *shown, float(confidence), len(used))],
        "metric string, available boolean, point_estimate double, ci_low double, ci_high double, confidence_level double, n_resamples_used bigint")
