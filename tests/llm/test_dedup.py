"""Exact, near and substring duplicates against brute force."""

import hashlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from strikehaz.llm import exact_dedup, simhash, substring_dedup, word_places
from strikehaz.llm.components import components
from strikehaz.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def test_exact_groups_with_edge_rows(edge_docs):
    got = {}
    for r in exact_dedup.exact_groups(edge_docs, "max").collect():
        got.setdefault((r.doc_id, r.text_sha256), []).append((r.keep_id, r.group_size, r.kept))
    rows = [(r.doc_id, r.text or "") for r in edge_docs.collect()]
    sizes = Counter(t for _, t in rows)
    for doc_id, text in rows:
        ids = [i for i, t in rows if t == text and i is not None]
        keep = max(ids) if ids else None
        assert (keep, sizes[text], doc_id == keep) in got[doc_id, hashlib.sha256(text.encode()).hexdigest()]
    assert sum(map(len, got.values())) == len(rows)


def test_exact_collisions_are_told_apart_by_their_bytes(edge_docs):
    weak = exact_dedup.exact_groups(edge_docs, "min", digest=lambda t: F.unhex(F.lpad(F.hex(F.length(t) % 2), 2, "0"))).drop("digest")
    true = exact_dedup.exact_groups(edge_docs, "min").drop("digest")
    assert sorted(map(str, weak.collect())) == sorted(map(str, true.collect()))


def test_exact_kept_returns_one_row_per_text_with_all_columns(edge_docs, no_docs):
    kept = exact_dedup.exact_kept(edge_docs)
    assert kept.columns == edge_docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r.text or "" for r in edge_docs.collect()}
    assert exact_dedup.exact_kept(no_docs).count() == 0 and exact_dedup.exact_groups(no_docs).count() == 0


def _prints(rows, size=3):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        out.append((doc_id, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0))
    return out


def _classes(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, f"{p:016x}", least.get(find(i))) for i, (doc_id, p) in enumerate(prints)]


def test_simhash_equals_brute_force(edge_docs, real_docs, no_docs):
    for docs in (edge_docs, real_docs):
        want = _classes(_prints([(r.doc_id, r.text) for r in docs.collect()]))
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(no_docs).count() == 0


def test_golay_keys_meet_up_to_five_errors():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    row, key = simhash.fuzzy_keys(prints)
    keys = {}
    for r, k in zip(row.tolist(), key.tolist()):
        keys.setdefault(r, set()).add(k)
    for errors in range(1, simhash.CERTAIN + 1):
        other = prints.copy()
        for k in range(len(other)):
            for bit in rng.choice(64, errors, replace=False):
                other[k] ^= np.uint64(1) << np.uint64(bit)
        row, key = simhash.fuzzy_keys(other)
        met = {r for r, k in zip(row.tolist(), key.tolist()) if k in keys[r]}
        assert met == set(range(len(prints)))


def test_links_of_crowded_keys_join_the_same_components(spark):
    rng = np.random.default_rng(5)
    center = 0x0123456789ABCDEF
    crowd = sorted({center ^ int(sum(1 << int(b) for b in rng.choice(64, 2, replace=False))) for _ in range(150)})
    prints = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in crowd], "print bigint").selectExpr("print AS node", "print")
    simhash.for_python(prints, 1000)
    for bucket in (20_000, 40):
        found = components(simhash.links(prints, ("print",), 3, bucket)).collect()
        assert len({r.label for r in found}) == len({c for _, _, c in _classes([(k, p) for k, p in enumerate(crowd)])})


def test_near_kept_drops_similar_documents_and_no_others(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["text"])
    sets = {}
    for r in docs.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = set(zip(*[words[k:] for k in range(5)])) or {tuple(words)}
    ids = sorted(sets)
    similar = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
               and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    kept = {r.doc_id for r in simhash.near_kept(docs).collect()}
    assert set(ids) - kept <= {b for _, b in similar}
    assert not any(a in kept and b in kept for a, b in similar)
    left = simhash.near_kept(edge_docs)
    assert left.columns == edge_docs.columns and {r.doc_id for r in left.collect()} == {None, 1, 3, 6, 8, 10, 11}
    assert simhash.near_kept(no_docs).count() == 0


def test_verified_blocks_cover_a_large_cluster(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(n, " ".join(base[:k] + [f"x{n}"] + base[k + 1 :])) for n, k in enumerate(range(20, 90, 2))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.doc_id for r in simhash.near_kept(docs, radius=60, block=8).collect()] == [0]


def _recall(spark, pairs):
    """Share of copies (odd ids) that near_kept drops; no two pairs share a word."""
    rows = [(2 * n + k, " ".join(w)) for n, pair in enumerate(pairs) for k, w in enumerate(pair)]
    kept = {r.doc_id for r in simhash.near_kept(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(2 * n in kept for n in range(len(pairs)))
    return 1 - sum(2 * n + 1 in kept for n in range(len(pairs))) / len(pairs)


def test_recall_of_near_copies(spark):
    """Copies with a repeated line, and copies with a paragraph appended at similarity 0.80 to 0.87."""
    repeated, appended = [], []
    for size, number in ((60, 300), (300, 300), (1500, 100)):
        for n in range(number):
            words = [f"d{size}n{n}w{k}" for k in range(size)]
            repeated.append((words, words + words[-10:] * (size // 10)))
            more = int((size - 4) / (0.8 + 0.07 * n / number)) - (size - 4)
            appended.append((words, words + [f"a{size}n{n}w{k}" for k in range(more)]))
    found = _recall(spark, repeated), _recall(spark, appended)
    print("recall of repeated lines and appended paragraphs", found)
    assert min(found) >= 0.995


def test_hooked_links_have_the_same_components(spark):
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2)) if a < b} | {(int(a), int(b)) for a in range(500, 505) for b in range(505, 900, 3)}
    links = spark.createDataFrame(sorted(pairs), "u bigint, v bigint").repartition(5)
    fewer = simhash.hooked(links)
    assert sorted(components(fewer).collect()) == sorted(components(links).collect())
    assert fewer.count() < len(pairs) / 2 and fewer.where("u >= v").count() == 0
    assert simhash.hooked(links.where("false")).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (7, 7)], "u bigint, v bigint")
    assert {(r.node, r.label) for r in components(path).collect()} == {(k, 1) for k in range(1, 61)} | {(100, 100), (101, 100)}


def _without_repeats(rows, window):
    first, words = {}, [(i, (t or "").encode().split()) for i, t in rows]
    for doc_id, w in words:
        for k in range(len(w) - window + 1):
            if doc_id is not None:
                piece = tuple(w[k : k + window])
                first[piece] = min(first.get(piece, doc_id), doc_id)
    out = []
    for doc_id, w in words:
        going = [False] * len(w)
        for k in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[k : k + window])] < doc_id:
                going[k : k + window] = [True] * window
        out.append((doc_id, len(w), sum(going), hashlib.sha256(b" ".join(x for x, g in zip(w, going) if not g)).hexdigest()))
    return out


def test_substring_dedup_equals_brute_force(edge_docs, real_docs, no_docs, monkeypatch):
    for docs, hot, shard, window in ((edge_docs, 10_000, 10**6, 13), (real_docs, 10_000, 10**6, 13), (real_docs, 2, 20_000, 13), (edge_docs, 2, 1000, 3)):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
        want = _without_repeats([(r.doc_id, r.text) for r in docs.collect()], window)
        got = substring_dedup.without_repeats(docs, window, keep=False).collect()
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert substring_dedup.without_repeats(no_docs).count() == 0


def test_anchor_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 30)
    rng = np.random.default_rng(3)
    lines = [f"the same {k} words" for k in range(20_000)]
    line = min(lines, key=lambda t: int(substring_dedup.anchors(t.encode().split(), 4)[0]))  # least hash: the anchor of all windows around it
    rows = []
    for doc_id in range(12):
        parts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 12)) for _ in range(5)]
        rows.append((doc_id, f" {line} ".join(parts)))
    rows.append((12, "other start " + rows[4][1] + " other end"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    shared = substring_dedup._shared_anchors(docs, 13)
    top = shared.groupBy("anchor").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).orderBy(F.desc("n")).first()
    assert top.docs <= 13 < 30 < top.n
    for hot in (30, 10**6):
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = substring_dedup.without_repeats(docs, keep=False).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, _without_repeats(rows, 13)))


def test_substring_dedup_returns_texts_and_spans(spark):
    shared = " ".join(f"s{k}" for k in range(15))
    docs = spark.createDataFrame([(1, f"a b {shared} c"), (2, f"x {shared} y z"), (3, "short")], "doc_id bigint, text string")
    got = {r.doc_id: (r.kept_text, r.removed) for r in substring_dedup.without_repeats(docs).collect()}
    assert got == {1: (f"a b {shared} c", []), 2: ("x y z", [[1, 16]]), 3: ("short", [])}


def test_index_parts():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 9, 300)
    wavelet = WaveletMatrix(text, 9)
    for symbol in range(9):
        ends = np.arange(301)
        assert (wavelet.rank(np.full(301, symbol), ends) == [int((text[:e] == symbol).sum()) for e in ends]).all()
    sequences = [rng.integers(1, 4, n) for n in (20, 5, 40, 13, 1)]
    index = FMIndex(sequences, 3)
    assert sorted(suffix_array(index.text).tolist()) == list(range(len(index.text)))
    low, high = index.matching(5)
    windows = Counter(tuple(s[k : k + 5]) for s in sequences for k in range(len(s) - 4))
    starts = index.ends - index.lengths
    for start, s in zip(starts, sequences):
        for k in range(len(s) - 4):
            assert high[start + k] - low[start + k] == windows[tuple(s[k : k + 5])]


def test_bounded_context_gives_the_same_intervals():
    rng = np.random.default_rng(5)
    sequences = [rng.integers(1, 4, n) for n in rng.integers(3, 60, 40)]
    whole, bounded = FMIndex(sequences, 3), FMIndex(sequences, 3, context=5)
    assert not np.array_equal(whole.order, bounded.order)
    for size in (3, 5):
        for a, b in zip(whole.matching(size), bounded.matching(size)):
            assert np.array_equal(a, b)


def test_anchors_need_no_call_for_each_word(monkeypatch):
    calls = []
    true = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or true(*a))
    words = [b"w%d" % (k % 700) for k in range(5000)] + [b"x" * 200]
    found = substring_dedup.anchors(words, 13)
    assert len(found) == len(words) - 12 and len(calls) <= 1  # the long word
    assert np.array_equal(found[700:1400], found[1400:2100])


def test_intervals_of_one_place_are_counted_once(monkeypatch):
    counted = []
    true = WaveletMatrix.rank
    monkeypatch.setattr(WaveletMatrix, "rank", lambda self, wanted, ends: counted.append(len(ends)) or true(self, wanted, ends))
    rng = np.random.default_rng(4)
    sequences = [rng.integers(1, 5000, 40) for _ in range(100)]
    low, high = FMIndex(sequences, 5000).matching(13)
    assert (high - low)[low >= 0].tolist() == [1] * 2800
    assert sum(counted) < 1.2 * 4000


def test_index_finds_no_pattern_that_is_missing():
    index = FMIndex([np.array([1, 2, 3]), np.array([2, 2])], 4)
    low, high = np.array([0]), np.array([len(index.text)])
    for symbol, places in ((3, 1), (1, 0), (4, 0), (2, 0)):  # 3 once, then 1 3 and so on never
        low, high = index.step(np.array([symbol]), low, high)
        assert (high - low).tolist() == [places]


def test_words_by_places(monkeypatch):
    texts = [b"", b" ", b"a", b" a\tb\x0b\x0cc\r\nd  ", b"a\0 a a\0\0", "\u00a0x \u2003 y\x85z \x1c \x1f".encode(), b"q" * 64 + b" " + b"q" * 65 + b" " + b"q" * 65 + b"\n" + b"q" * 63]
    texts += [b" ".join(texts * 3), bytes(np.random.default_rng(2).choice(np.frombuffer(b"ab \t\0\xff", np.uint8), 5000))]
    for weak in (False, True):
        if weak:
            monkeypatch.setattr(word_places, "place_hashes", lambda text, starts, ends: (ends - starts).astype(np.uint64))
        for text in texts:
            words = text.split()
            starts, ends = word_places.word_places(text)
            assert [text[a:b] for a, b in zip(starts, ends)] == words
            numbers, size = word_places.numbered(text)
            assert len(numbers) == len(words) and len(set(zip(words, numbers.tolist()))) == len(set(words)) == len(set(numbers.tolist())) == size
            if not weak:
                hashes = word_places.place_hashes(text, starts, ends)
                assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert list(word_places.by_size([])) == [] and [t for g in word_places.by_size(iter(texts)) for t in g] == texts


def test_kept_texts_of_long_passages(spark, edge_docs):
    long = " ".join(f"p{k}" for k in range(300))
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    rows += [(1000, f"{long} a"), (1001, f"b c {long[5:]}"), (1002, long), (1003, " ".join([long] * 2)), (1004, f"{long[:400]} between  {long[400:]}\tend"), (1005, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substring_dedup.without_repeats(docs).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == sorted(map(str, _without_repeats(rows, 13)))
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(b - a for a, b in r.removed) == r.n_removed
