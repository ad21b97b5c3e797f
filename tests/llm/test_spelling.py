"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from strikehaz.llm import spelling


def plain(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def got(df):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()), key=str)


def corpus(seed, letters, size, least=4, most=8):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(size)]
    return [(d, " ".join(rng.choices(pool, weights=[1 / (k + 1) for k in range(size)], k=400))) for d in range(60)]


def test_equal_to_all_pairs(spark):
    for rows in (corpus(1, "ab", 300), corpus(2, "abcé", 500), corpus(3, "abÀÿ÷-", 300, 5, 20)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert got(spelling.spelling_variants(df)) == plain(rows)


def test_full_groups_are_dealt_out_without_losing_a_pair(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    rows = corpus(4, "ab", 400)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert got(spelling.spelling_variants(df)) == plain(rows)


def test_each_pair_is_found_once_in_large_and_small_groups():
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("ab", k=rng.randint(6, 7))) for _ in range(150)})
    found = Counter()
    for longer in (7,):
        for piece in range(spelling.PIECES):
            keys = {}
            for row, size, p, key in zip(*spelling.group_keys(words)):
                if size == longer and p == piece:
                    keys.setdefault(key, []).append(row)
            for small in (1, 48):
                for rows in keys.values():
                    held = [words[r].encode("latin-1") for r in rows]
                    old, spelling.SMALL = spelling.SMALL, small
                    try:
                        u, v = spelling.near_in_run(np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), held, longer, piece)
                    finally:
                        spelling.SMALL = old
                    found.update((small, *sorted((held[a], held[b]))) for a, b in zip(u.tolist(), v.tolist()))
    want = {(s, *sorted((a.encode(), b.encode()))) for s in (1, 48) for a in words for b in words if a < b and max(len(a), len(b)) == 7 and one_edit(a, b)}
    assert set(found) == want and set(found.values()) == {1}


def test_chains_of_forms_reach_the_last(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbbc"]
    rows = [(None, " ".join(w for k, w in enumerate(words) for _ in range(3 * 2**k)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(spelling.spelling_variants(df)) == plain(rows)
    assert {r.root for r in spelling.spelling_variants(df).collect()} == {"bbbbbc"}


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    long = "é" * 3000
    assert got(spelling.spelling_variants(edge_docs)) == plain(rows)
    rows = [(1, f"{long} {long} {long} {long}x {long}x {long}x tail"), (2, None), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, 1, "w", 5) for i, t in rows], "doc_id bigint, text string, n int, word string, form int")
    assert got(spelling.spelling_variants(df)) == plain(rows)
    assert spelling.spelling_variants(no_docs).count() == 0
