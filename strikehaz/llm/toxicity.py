"""Toxicity by maximum-scoring segments.

A token's score is its log odds between toxic and clean texts under a hierarchical Dirichlet prior: what is
known of a word is drawn towards its prefix, that towards the next shorter one, and the shortest towards
even odds, so rare and inflected words score like their stem and frequent ones by themselves.  Every token pays `drift`, so the
expected score of clean text is below zero.  One scan finds all maximal segments of a text.  Their scores are calibrated
by the extreme-value law of clean texts: of n tokens, the number of segments with a score of s or more is about Poisson with mean
K n exp(-lambda s).  The evidence of a text is the rarest of its events "r segments of at least s_r".
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, remainder, rows_of, stored, whole_text

WORD = re.compile("[a-z\u0080-\U0010ffff]+")
END = ">"  # marks a whole word, which no token holds
WORDS_KEPT = 300_000  # scored words a worker remembers before it starts anew; no effect on results
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """`toxic` and `clean` bound the labelled rows of each kind that are learnt from; with them the size of the model."""

    toxic: int = 2000
    clean: int = 4000
    prefixes: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)
    strength: float = 10.0  # of the prior, in documents
    drift: float = 2.0
    least: int = 2  # documents that hold a prefix or word


@dataclass(frozen=True)
class Model:
    """Scores of prefixes and words; lambda and K of clean segments; intercept and slope over the log of evidence."""

    scores: dict[str, float]
    rate: float
    scale: float
    intercept: float
    slope: float


def tokens(text: bytes) -> list[str]:
    """Runs of letters (A-Z lower-cased) of a whole text; every code point from U+0080 on counts as a letter."""
    return WORD.findall(text.lower().decode("utf-8", "replace"))


def chain(word: str, settings: Settings) -> list[str]:
    """A word's prefixes, short ones first, and the word itself."""
    return [word[:n] for n in settings.prefixes if n <= len(word)] + [word + END]


def token_scores(toxic: dict[str, int], clean: dict[str, int], sizes: tuple[int, int], settings: Settings, left_out: int | None = None) -> dict[str, float]:
    """Log odds less the drift of every prefix and word, from documents that hold it.

    Clean counts are scaled to as many documents as there are toxic ones.  With `left_out` (a label) the scores are
    those without one document of that label, for words which that document holds.
    """
    ratio = sizes[1] / max(sizes[0], 1)
    out, odds = {}, {}
    names = sorted(toxic.keys() | clean.keys(), key=lambda f: (len(f.removesuffix(END)), f.endswith(END), f))
    for f in names:
        a, b = toxic.get(f, 0), clean.get(f, 0)
        if a + b < settings.least:
            continue
        a, b = max(a - (left_out == 1), 0), max(b - (left_out == 0), 0) * ratio
        stem = f.removesuffix(END)
        above = [n for n in settings.prefixes if n <= len(stem) and (n < len(stem) or f != stem)]
        base = odds[stem[: above[-1]]] if above else 0.5
        odds[f] = (a + settings.strength * base) / (a + b + settings.strength)
        out[f] = float(np.log(odds[f] / (1 - odds[f])) - settings.drift)
    return out


class Scorer:
    """Token scores of texts; remembers words within a task."""

    def __init__(self, scores: dict[str, float], settings: Settings):
        self.scores, self.settings, self.known = scores, settings, {}

    def word(self, word: str) -> float:
        """Score of the word if it is known, else of its longest known prefix."""
        for f in reversed(chain(word, self.settings)):
            if f in self.scores:
                return self.scores[f]
        return -self.settings.drift

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.word(w)
        return np.array([known[w] for w in words])


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(start, stop, score) of all maximal scoring segments in one scan.

    Each is a run whose score no part of it reaches and no longer run around it exceeds; they do not overlap.  A candidate is joined with those back to
    the last one that began lower, if that one ended lower too; links to it keep the search linear.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, stop, total before, total after, last candidate that began lower
    totals = np.concatenate([[0.0], np.cumsum(scores)])
    for k in np.flatnonzero(scores > 0).tolist():
        start, before, after = k, totals[k], totals[k + 1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                found.append((start, k + 1, before, after, j))
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def evidence(segments: np.ndarray, size: int, model: tuple[float, float]) -> float:
    """The largest -log probability (by its exponential bound) that r or more clean segments reach the r-th best score; 0 without segments."""
    if not len(segments):
        return 0.0
    rate, scale = model
    best = np.sort(segments)[::-1]
    r = np.arange(1, len(best) + 1)
    mean = np.log(scale * max(size, 1)) - rate * best  # its logarithm
    deep = np.exp(np.minimum(mean, 700.0)) - r + r * (np.log(r) - mean)
    return float(np.where(np.log(r) > mean, deep, 0.0).max())


def fitted_line(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 at least) of the log odds of label 1 over log(1 + x), by Newton's method with a small ridge."""
    rows = np.stack([np.ones(len(x)), np.log1p(x)], 1)
    line, ridge = np.zeros(2), np.array([1e-3, 1e-1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(rows @ line, -30, 30)))
        slope = rows.T @ (weights * (labels - p)) - ridge * line
        curve = (rows * (weights * p * (1 - p))[:, None]).T @ rows + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        line = line + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(line[0]), max(float(line[1]), 0.0)


def trained(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Model of the labelled rows whose crc32(doc_id) modulo 4 is not 2.

    Of each label at most `settings.toxic` or `settings.clean` ids are taken, those with the smallest hashes; labels that are null
    or not 0 or 1 and ids without a document are left out, of an id with several labels the larger counts, and equal texts of a
    label count once.  Documents are scored without their own share of the counts when segments and evidence are
    calibrated.  Without both labels, the model gives every text the share of toxic labels.
    """
    usable = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(remainder("doc_id", 4) != 2)
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    )
    sizes = {r.label: r.n for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = usable.where("label = 1").orderBy(*order).limit(settings.toxic).union(usable.where("label = 0").orderBy(*order).limit(settings.clean))
    chosen = stored(chosen)  # bounded by the two parameters, so it may be broadcast
    texts = docs.select("doc_id", whole_text().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = for_python(stored(texts.groupBy("label", F.md5("text").alias("digest")).agg(F.first("text").alias("text")).select("label", "text")), 64)
    held = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = held.get(1, 0), held.get(0, 0)
    if not n1 or not n0:
        share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
        return Model({}, 1.0, 1.0, float(np.log(share / (1 - share))), 0.0)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, ts in rows_of(batches, "label", "text"):
            for y, t in zip(ys, ts):
                names = {f for w in set(tokens(t)) for f in chain(w, settings)}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(names), pa.string()), pa.array([y] * len(names), pa.int32())], ["name", "label"])

    counted = rows.mapInArrow(parts, "name string, label int").groupBy("name").agg(F.sum("label").alias("toxic"), F.count("*").alias("n"))
    counts = counted.where(F.col("n") >= settings.least).collect()  # prefixes and words of the bounded sample
    toxic = {r.name: r.toxic for r in counts}
    clean = {r.name: r.n - r.toxic for r in counts}
    without = {y: token_scores(toxic, clean, (n0, n1), settings, left_out=y) for y in (0, 1)}
    shared = docs.sparkSession.sparkContext.broadcast(without)

    def spans(batches: Iterator[pa.RecordBatch], law: tuple[float, float] | None) -> Iterator[pa.RecordBatch]:
        scorers = {y: Scorer(shared.value[y], settings) for y in (0, 1)}
        for ys, ts in rows_of(batches, "label", "text"):
            out = []
            for y, t in zip(ys, ts):
                scores = scorers[y](tokens(t))
                found = np.array([s for _, _, s in maximal_segments(scores)])
                out.append((y, len(scores), len(found), float(found.sum())) if law is None else (y, 0, 0, evidence(found, len(scores), law)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["label", "size", "n", "value"])

    schema = "label int, size bigint, n bigint, value double"
    law = rows.where("label = 0").mapInArrow(lambda b: spans(b, None), schema).agg(F.sum("size"), F.sum("n"), F.sum("value")).first()
    rate, scale = (law[1] + 1) / (law[2] + 1), (law[1] + 1) / (law[0] + 1)
    seen = rows.mapInArrow(lambda b: spans(b, (rate, scale)), schema).select("label", "value").collect()  # one row for each document of the sample
    seen = sorted((r.label, r.value) for r in seen)
    y, x = np.array([v[0] for v in seen]), np.array([v[1] for v in seen])
    weights = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    intercept, slope = fitted_line(x, y, weights / weights.mean())
    return Model(token_scores(toxic, clean, (n0, n1), settings), rate, scale, intercept, slope)


def scored(docs: DataFrame, model: Model, settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages): one row for each input row.

    score is the probability of label 1 from the whole text alone; null and empty texts have no segment and get that of no
    evidence.  predicted is 1 from `threshold` on, n_passages the number of maximal segments.  held_out says that crc32 of the
    id modulo 4 is 2 (null ids count as the empty text).  Repeated rows get a row each, other columns are not read, an empty table
    gives an empty result.  The model's size depends on the bounded sample, not on the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.scores, settings)
        for ids, held, texts in rows_of(batches, "doc_id", "held_out", "text"):
            scores, sizes = [], []
            for t in texts:
                values = scorer(tokens(t))
                found = np.array([s for _, _, s in maximal_segments(values)])
                x = evidence(found, len(values), (m.rate, m.scale))
                scores.append(float(1 / (1 + np.exp(-np.clip(m.intercept + m.slope * np.log1p(x), -700, 700)))))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(sizes, pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_passages"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 4) == 2).alias("held_out"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int, n_passages bigint")


def passages(docs: DataFrame, model: Model, settings: Settings = Settings(), expected: float = 0.05) -> DataFrame:
    """(doc_id, start, n_tokens, score, expected, words): every significant toxic passage.

    A passage is a maximal segment of which a clean text of the same length would hold `expected` at most; start counts
    tokens from 0, words are its tokens joined by spaces.  Texts without such a segment have no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scorer = Scorer(m.scores, settings)
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out = []
            for i, t in zip(ids, texts):
                words = tokens(t)
                for a, b, s in maximal_segments(scorer(words)):
                    mean = float(m.scale * len(words) * np.exp(-m.rate * s))
                    if mean <= expected:
                        out.append((i, a, b - a, s, mean, " ".join(words[a:b])))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "start", "n_tokens", "score", "expected", "words"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, score double, expected double, words string")
