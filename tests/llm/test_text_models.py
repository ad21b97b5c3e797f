"""Tokens, scores, quality and benchmark passages against brute force and libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from strikehaz.llm import decontaminate, lm_score, piece_codec, quality
from strikehaz.llm.ngram_trie import BigramTrie, EliasFano
from strikehaz.llm.queries import piece_model


def test_codec_equals_the_library(edge_docs, real_docs, no_docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for docs in (edge_docs, real_docs):
        want = []
        for r in docs.collect():
            ids = lib.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
        got = piece_codec.encoded(docs, piece_model()).collect()
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got)
        assert all(lib.encode(r.decoded) == r.ids for r in got)
    assert piece_codec.encoded(no_docs, piece_model()).count() == 0


def test_codec_on_random_texts():
    import sentencepiece

    lib, model = sentencepiece.SentencePieceProcessor(model_file=piece_model()), piece_codec.PieceModel(piece_model())
    rng = random.Random(2)
    letters = [" "] * 6 + list("abcdehinorst") + ["é", "日", "\n", "\U0001f600", "\U0001d518", "\t", "▁", "\x00", "<", "s", ">"]
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(3000)] + [" " * n for n in range(50)] + ["a" * 500, "<s></s><0x41>", "x" + " " * 33 + "日"]
    for text in texts:
        ids = lib.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == lib.decode(ids)


def _base(rows):
    tokens = [(i, zlib.crc32(str("" if i is None else i).encode()) % 10 == 0, (t or "").encode().lower().split() + [None]) for i, t in rows]
    counts = Counter(w for _, held, ws in tokens if not held for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    lower = lambda w: (counts[w] + 0.1) / (total + 0.1 * (distinct + 1))
    pairs = Counter(p for _, held, ws in tokens if not held for p in zip([b""] + ws, ws))
    return tokens, counts, total, lower, pairs


def test_scores_equal_the_formula(edge_docs, real_docs, no_docs):
    for docs in (edge_docs, real_docs):
        tokens, counts, total, lower, pairs = _base([(r.doc_id, r.text) for r in docs.collect()])
        seen, after = Counter(), Counter()
        for (a, _), n in pairs.items():
            seen[a] += n
            after[a] += 1
        usual = lm_score._discount(sum(n == 1 for n in pairs.values()), sum(n == 2 for n in pairs.values()))
        once, twice = (Counter(a for (a, _), n in pairs.items() if n == k) for k in (1, 2))
        frequent = max(1, total // lm_score.OFTEN)

        def probability(a, b):
            if not seen[a]:
                return lower(b)
            discount = lm_score._discount(once[a], twice[a]) if seen[a] >= frequent else usual
            return max(pairs[a, b] - discount, 0) / seen[a] + discount * after[a] / seen[a] * lower(b)

        want = sorted(((i is None, i or 0, held, len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10(lower(w)) for w in ws),
                        sum(math.log10(probability(a, b)) for a, b in zip([b""] + ws, ws))) for i, held, ws in tokens))
        got = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.lm_scores(docs).collect())
        assert [w[:6] for w in want] == [g[:6] for g in got]
        for w, g in zip(want, got):
            assert g[6] == pytest.approx(w[6], abs=1e-6) and w[7] - 0.001 * w[3] <= g[7] <= w[7] + 1e-6 * w[3]
    assert lm_score.lm_scores(no_docs).count() == 0


def test_scores_hold_for_small_shards_and_frequent_contexts(real_docs):
    """Discounts are estimated by shard, so scores may move a little, base and counts not."""
    one = {r.doc_id: r for r in lm_score.lm_scores(real_docs).collect()}
    many = {r.doc_id: r for r in lm_score.lm_scores(real_docs, shard_tokens=8000).collect()}
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (many[k].n_tokens, many[k].n_known, many[k].train_tokens)
        assert many[k].base_score == pytest.approx(r.base_score, abs=1e-6) and many[k].score == pytest.approx(r.score, rel=0.03)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_shards_only_place_work(real_docs, monkeypatch):
    """Discounts are those of all pairs: scores are the same however the contexts are dealt out."""
    one = {r.doc_id: r.score for r in lm_score.lm_scores(real_docs).collect()}
    monkeypatch.setattr(lm_score, "PART", 3000)
    for tokens in (8000, 400):
        many = {r.doc_id: r.score for r in lm_score.lm_scores(real_docs, shard_tokens=tokens).collect()}
        assert one.keys() == many.keys() and all(many[k] == pytest.approx(s, rel=1e-9) for k, s in one.items())


def test_frequent_contexts_keep_their_probabilities_normal():
    contexts = np.array([5, 5, 5, 9], np.uint64)
    words, counts, lower = np.array([1, 2, 3, 1], np.uint64), np.array([3, 1, 1, 2]), np.array([0.5, 0.2, 0.2, 0.5])
    trie = BigramTrie(contexts, words, counts, lower, 0.6, {})
    own = np.array([1, 2, 3, 4], np.uint64)
    logs = trie.logs(np.array([5], np.uint64), np.zeros(4, np.int64), own, np.arange(4), np.log10([0.5, 0.2, 0.2, 0.1]))
    assert 0.995 <= (10**logs).sum() <= 1 + 1e-9
    unseen = trie.logs(np.array([7], np.uint64), np.zeros(1, np.int64), own[:1], np.zeros(1, np.int64), np.log10([0.5]))
    assert unseen[0] == pytest.approx(math.log10(0.5))


def test_elias_fano_levels():
    rng = np.random.default_rng(0)
    for universe in (1 << 64, 10**6, 40):
        values = np.sort(rng.integers(0, universe, 700, dtype=np.uint64))
        level = EliasFano(values, universe)
        assert (level.get(np.arange(700)) == values).all()
        wanted = np.concatenate([values[::3], rng.integers(0, universe, 300, dtype=np.uint64)])
        assert (level.successor(wanted) == np.searchsorted(values, wanted)).all()
        assert ((level.find(wanted) >= 0) == np.isin(wanted, values)).all()
    assert (EliasFano(np.empty(0, np.uint64), 10).find(np.array([3], np.uint64)) == -1).all()


def test_quality_is_learnt_and_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.trained(docs, labels, quality.Settings(sample=1500))
    got = quality.scored(docs, model).join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", "quality").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.95 and (held[held.quality == 1].predicted == 1).mean() > 0.98
    again = quality.trained(docs.repartition(7), labels, quality.Settings(sample=1500))
    assert np.array_equal(model[0], again[0])


def test_quality_with_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (None, 1, 0), (10, None, 0), (11, 7, 0), (999, 0, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.trained(edge_docs, labels)
    got = quality.scored(edge_docs, model)
    assert got.count() == edge_docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = quality.accepted(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == got.where("predicted = 1").count()
    assert quality.scored(no_docs, model).count() == 0 and quality.accepted(no_docs, model).count() == 0
    empty = quality.trained(edge_docs, labels.where("false"))
    assert {r.score for r in quality.scored(edge_docs, empty).select("score").distinct().collect()} == {0.5}


def test_planted_passages_are_found(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.leaks(docs, items).collect()}
    texts, wanted = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    assert {(d, i) for d, t in texts.items() for i, w in wanted.items() if w in t} <= set(got)
    for (doc_id, item), value in got.items():
        assert value == pytest.approx(_best(texts[doc_id], wanted[item])) and value >= 0.8


def _best(text, item, least=0.0):
    words, own = text.encode().lower().split(), item.encode().lower().split()
    mine = decontaminate._shingles(own)
    return max((decontaminate.weighted_similarity(decontaminate._shingles(words[k : k + len(own)]), mine) for k in range(len(words) - len(own) + 1)), default=0)


def test_edited_passages_and_edge_rows(spark, edge_docs, no_docs):
    rng = random.Random(4)
    items = [(k, " ".join(f"q{rng.randint(0, 9999)}" for _ in range(n))) for k, n in enumerate((3, 14, 30, 40, 59))]
    items += [(90, None), (91, ""), (92, items[1][1])]
    docs = []
    for k, text in items[1:5]:
        words = text.split()
        for n in range(30):
            edited = words.copy()
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = "edited"
            docs.append((k * 100 + n, "some words before " + " ".join(edited) + " and after"))
    docs += [(1, f"x {items[0][1].upper()} y"), (2, None), (3, ""), (None, f"a {items[2][1]} b"), (4, items[3][1]), (4, items[3][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'x' AS item_id", "1 AS size", "'p' AS print")
    want = {(d, i) for d, t in docs for i, w in items if t and w and _best(t, w) >= 0.8}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, table).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and {(1, 0), (None, 2), (4, 3), (114, 1)} & want <= got
    flagged = decontaminate.flagged(frame, table).collect()
    assert len(flagged) == len(docs) and all(r.leaked == (r.doc_id in {d for d, _ in got}) for r in flagged)
    clean = decontaminate.clean(frame, table)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate.flagged(no_docs, table).count() == 0 and decontaminate.clean(edge_docs, table.where("false")).count() == edge_docs.count()
