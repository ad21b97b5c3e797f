"""Segments, scores and calibration against their definitions, and held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from strikehaz.llm import toxicity as tx

S = tx.Settings()


def by_definition(scores):
    """Maximal scoring segments: take the best segment (the shortest, then the first), then the same on either side."""

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] or (total == best[0] and j + 1 - i < best[2] - best[1])):
                    best = (total, i, j + 1)
        if best is None:
            return []
        total, i, j = best
        return split(a, i) + [(i, j, total)] + split(j, b)

    return split(0, len(scores))


def test_segments_equal_their_definition():
    rng = random.Random(1)
    for _ in range(400):
        scores = [rng.choice([-3, -2, -1, -1, 1, 2, 4]) + rng.random() / 64 for _ in range(rng.randint(0, 40))]
        found = tx.maximal_segments(np.array(scores))
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in by_definition(scores)]
        assert all(math.isclose(s, sum(scores[a:b])) for a, b, s in found)
    assert tx.maximal_segments(np.array([])) == [] and tx.maximal_segments(np.array([-1.0, 0.0])) == []


def test_segments_take_linear_time():
    rng = np.random.default_rng(2)
    assert len(tx.maximal_segments(np.where(rng.random(300_000) < 0.5, 1.0, -1.0))) > 10
    assert len(tx.maximal_segments(np.tile([2.0, -1.0], 100_000))) == 1
    assert len(tx.maximal_segments(np.tile([1.0, -2.0], 100_000))) == 100_000


def plain_score(word, toxic, clean, ratio, out=None):
    q = 0.5
    for f in tx.chain(word, S):
        a, b = toxic.get(f, 0), clean.get(f, 0)
        if a + b < S.least:
            break
        a, b = max(a - (out == 1), 0), max(b - (out == 0), 0) * ratio
        q = (a + S.strength * q) / (a + b + S.strength)
    return math.log(q / (1 - q)) - S.drift


def test_token_scores_are_the_posterior_along_the_prefixes():
    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randint(1, 12))) for _ in range(300)]
    toxic, clean = {}, {}
    for w in words:
        for f in tx.chain(w, S):
            counts = toxic if rng.random() < 0.4 else clean
            counts[f] = counts.get(f, 0) + 1
    for f in [*toxic, *clean]:  # counts fall along a chain, as in documents
        stem = f.removesuffix(tx.END)
        for n in S.prefixes:
            if n <= len(stem):
                for counts in (toxic, clean):
                    counts[stem[:n]] = max(counts.get(stem[:n], 0), counts.get(f, 0))
    for out in (None, 0, 1):
        scorer = tx.Scorer(tx.token_scores(toxic, clean, (30, 20), S, out), S)
        got = scorer(words + ["zzz", "a"])
        assert np.allclose(got, [plain_score(w, toxic, clean, 20 / 30, out) for w in words + ["zzz", "a"]])


def test_evidence_is_the_rarest_event():
    rng = np.random.default_rng(4)
    for _ in range(50):
        segments, size, law = rng.exponential(2, rng.integers(1, 9)), int(rng.integers(1, 500)), (float(rng.uniform(0.5, 2)), 0.01)
        best = 0.0
        for s in segments:
            r, mean = sum(t >= s for t in segments), law[1] * size * math.exp(-law[0] * s)
            if r > mean:
                best = max(best, mean - r + r * math.log(r / mean))
                exact = 1 - sum(math.exp(-mean) * mean**k / math.factorial(k) for k in range(r))
                assert exact <= math.exp(-(mean - r + r * math.log(r / mean))) + 1e-12  # it bounds the Poisson tail
        assert math.isclose(tx.evidence(segments, size, law), best, abs_tol=1e-9)
    assert tx.evidence(np.array([]), 10, (1.0, 0.1)) == 0 and math.isfinite(tx.evidence(np.array([1e6]), 10, (1.0, 1e-9)))


@pytest.fixture(scope="module")
def learnt(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, tx.trained(docs, labels)


def test_held_out_accuracy(learnt):
    docs, labels, model = learnt
    rows = tx.scored(docs, model).join(labels.where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if r.toxic == 1]
    wrong = [r.predicted for r in held if r.toxic == 0]
    assert len(caught) > 50 and sum(caught) / len(caught) > 0.9 and sum(wrong) / len(wrong) < 0.01
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_passages_hold_the_insults(learnt):
    docs, _, model = learnt
    rows = tx.passages(docs, model).collect()
    assert len(rows) > 500 and all(r.expected <= 0.05 and r.score > 0 for r in rows)
    words = {w for r in rows for w in r.words.split()}
    assert {"idiot", "worthless", "pathetic"} <= words


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(learnt):
    docs, labels, model = learnt
    held = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2"
    changed = labels.selectExpr("doc_id", "quality", f"IF({held}, 1 - toxic, toxic) AS toxic")
    again = tx.trained(docs.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "0 AS label"), changed)
    assert again == model


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 0, 0), (4, None, None), (6, 1, 0), (8, 1, 0), (None, 1, 1), (10, 1, 7), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    for docs in (edge_docs, no_docs):
        for known in (labels, labels.where("toxic = 0"), labels.where("false")):
            model = tx.trained(docs, known)
            rows = tx.scored(docs, model).collect()
            assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
            tx.passages(docs, model).collect()
    blank = {r.score for r in tx.scored(edge_docs, model).collect()}
    assert len(blank) == 1
