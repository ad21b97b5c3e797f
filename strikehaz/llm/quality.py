"""Quality classifier: supervised subword embeddings, averaged per document, softmax output.

Words, word pairs and character n-grams are hashed to buckets with learned vectors; a document
is the mean of the vectors of its features, and a softmax over two labels follows.  Training is
numpy stochastic gradient descent over a bounded sample of the labelled rows.  Since the mean and the output
are linear, each bucket's share of the score is one number once training is over, and
scoring is a mean of these numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import remainder, rows_of, for_python, stored, whole_text

WORDS_KEPT = 300_000  # scored words a worker remembers before it starts anew; no effect on results
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """`sample` bounds the labelled rows that are learnt from, and with it the size of training."""

    sample: int = 4000
    buckets: int = 1 << 16
    width: int = 12
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 6
    rate: float = 1.0
    seed: int = 7


def word_features(word: bytes, settings: Settings) -> np.ndarray:
    """Buckets of a word and of its character n-grams (bytes, with edge marks)."""
    marked = b"<" + word + b">"
    found = [zlib.crc32(marked)]
    found += [zlib.crc32(marked[k : k + n], n) for n in settings.grams for k in range(len(marked) - n + 1)]
    return np.array(found, np.int64) % settings.buckets


def pair_features(codes: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets of neighbouring words; all pairs of a word with itself share the first."""
    pairs = codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(codes[:-1] == codes[1:], 0, (pairs >> np.uint64(40)) % np.uint64(settings.buckets)).astype(np.int64)


def _counted(text: bytes, settings: Settings, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their shares."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    for w in words:
        if w not in known:
            known[w] = word_features(w, settings)
    codes = np.fromiter((zlib.crc32(w) for w in words), np.uint64, len(words))
    every = np.concatenate([*(known[w] for w in words), pair_features(codes, settings)])
    buckets, counts = np.unique(every, return_counts=True)
    return buckets, counts / len(every)


def fit(texts: list[bytes], labels: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Shares of the log odds of label 1 by bucket, and the bias; the same input gives the same result."""
    rng = np.random.default_rng(settings.seed)
    known: dict[bytes, np.ndarray] = {}
    rows = [_counted(t, settings, known) for t in texts]
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.width)) / settings.width
    output, bias = np.zeros((settings.width, 2)), np.zeros(2)
    steps, total = 0, settings.epochs * max(len(rows), 1)
    for _ in range(settings.epochs):
        for k in rng.permutation(len(rows)):
            rate = settings.rate * (1 - steps / total)
            steps += 1
            buckets, shares = rows[k]
            hidden = shares @ vectors[buckets]
            logits = hidden @ output + bias
            p = np.exp(logits - logits.max())
            error = p / p.sum()
            error[int(labels[k])] -= 1.0
            back = output @ error
            output -= rate * np.outer(hidden, error)
            bias -= rate * error
            vectors[buckets] -= rate * len(buckets) ** 0.5 * shares[:, None] * back[None, :]
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def trained(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on labelled rows that are not held out, in one task over a bounded sample.

    At most `settings.sample` labelled ids are taken, those with the smallest hashes; labels
    that are null or not 0 or 1 and ids without a document are left out, of an id with several
    labels the larger counts.  With no labelled row every score is one half.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(remainder("doc_id", 5) != 0)
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    )
    chosen = stored(chosen)  # bounded by the parameter, so it may be broadcast
    rows = docs.select("doc_id", whole_text().cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted({(i, t, y) for ids, texts, ys in rows_of(batches, "doc_id", "text", "label") for i, t, y in zip(ids, texts, ys)})
        if found:
            weights, bias = fit([t for _, t, _ in found], np.array([y for _, _, y in found]), settings)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    model = for_python(rows.repartition(1)).mapInArrow(run, "weights binary, bias double").first()
    if model is None:
        return np.zeros(settings.buckets), 0.0
    return np.frombuffer(bytes(model.weights)), float(model.bias)


class Scorer:
    """Scores whole texts with a fitted model; remembers words within a task."""

    def __init__(self, model: tuple[np.ndarray, float], settings: Settings):
        self.weights, self.bias = model
        self.settings = settings
        self.known: dict[bytes, tuple[float, int, int]] = {}

    def __call__(self, text: bytes) -> float:
        words, known = text.split(), self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in words:
            if w not in known:
                buckets = word_features(w, self.settings)
                known[w] = (float(self.weights[buckets].sum()), len(buckets), zlib.crc32(w))
        got = [known[w] for w in words]
        total, size = sum(g[0] for g in got), sum(g[1] for g in got)
        if len(got) > 1:
            pairs = pair_features(np.array([g[2] for g in got], np.uint64), self.settings)
            total, size = total + float(self.weights[pairs].sum()), size + len(pairs)
        return float(1 / (1 + np.exp(-np.clip(self.bias + total / max(size, 1), -700, 700))))


def scored(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each input row.

    score is the probability of label 1 from the whole text alone; null and empty texts get
    that of the bias.  predicted is 1 from `threshold` on.  held_out says that crc32 of the id
    modulo 5 is 0 (null ids count as the empty text).  Repeated rows get a row each, other
    columns are not read.  The model is `buckets` numbers, whatever the size of the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for ids, held, texts in rows_of(batches, "doc_id", "held_out", "text"):
            scores = [scorer(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder("doc_id", 5) == 0).alias("held_out"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: tuple[np.ndarray, float], settings: Settings = Settings(), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that score `threshold` or more; judged like `scored`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, settings)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([scorer(t or b"") >= threshold for t in texts], pa.bool_()))

    return for_python(docs).mapInArrow(run, docs.schema)
