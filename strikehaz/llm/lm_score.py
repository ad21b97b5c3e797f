"""LM scoring: a smoothed bigram model in Elias-Fano tries, sharded by context.

Words are known by 64-bit hashes.  A first pass counts words.  A second deals out all pairs of
successive words by the first one; each shard gets the counts of the words it needs, builds
the trie of its training pairs and scores all its pairs, training and held out, against it.
What a shard has found for the texts of one batch goes back as one row, and the rows of a batch are
added up together.  Between the two, the shards count how many of all training pairs occur once and twice:
discounts are those of the whole table, whatever shard or part a pair is scored in.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, mixed, released, remainder, rows_of, stored_table, whole_text, word_hashes
from strikehaz.llm.ngram_trie import BigramTrie

BEGIN = xxhash.xxh64_intdigest(b" begin")  # a blank keeps both apart from words
END = xxhash.xxh64_intdigest(b" end")
HELD = 3_000_000  # tokens a task gathers before it sends them
SHARD = 8_000_000  # tokens of a shard
PART = 700_000  # tokens of a shard that are scored at once
OFTEN = 200  # a context with at least this fraction of all training tokens has a discount of its own, at any size
ADDED = 0.1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(rows, ids, null ids, held out, words, document of each word) of some batches; every text ends with END."""
    held: list[tuple] = []
    size = 0
    for columns in rows_of(batches, "row", "doc_id", "held_out", "text"):
        for row, doc_id, out, text in zip(*columns):
            words = text.lower().split()
            held.append((row, doc_id, out, np.append(word_hashes(words), np.uint64(END))))
            size += len(words) + 1
            if size >= HELD:
                joined, held, size = _joined(held), [], 0
                yield joined
    if held:
        yield _joined(held)


def _joined(held: list[tuple]) -> tuple[np.ndarray, ...]:
    rows, ids, out, words = zip(*held)
    return (
        np.array(rows, np.int64), np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids]), np.array(out),
        np.concatenate(words), np.repeat(np.arange(len(held), dtype=np.int32), [len(w) for w in words]))


def _pairs(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each one, BEGIN at the start of a document."""
    before = np.concatenate([[np.uint64(BEGIN)], words[:-1]])
    before[np.concatenate([[True], doc[1:] != doc[:-1]])] = np.uint64(BEGIN)
    return before


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n): counts of the training words and of END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for *_, words, _ in _gathered(batches):
            word, n = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(word), pa.array(n)], ["word", "n"])

    partial = docs.where("NOT held_out").mapInArrow(run, "word bigint, n bigint")
    return stored_table(partial.groupBy("word").agg(F.sum("n").alias("n")))


def _frequent(counts: DataFrame, least: int, texts: int) -> dict[int, int]:
    """Counts of the contexts that occur `least` times or more; at most N / least of them."""
    often = {r.word & (1 << 64) - 1: r.n for r in counts.where(F.col("n") >= least).collect()}
    often.pop(END, None)
    if texts >= least:
        often[BEGIN] = texts
    return often


def _pair_kinds(dealt: DataFrame, often: np.ndarray) -> dict[int | None, tuple[int, int, int]]:
    """(distinct training pairs, those seen once, those seen twice) of each context of `often`, and of all contexts for None.

    Every pair is in one shard only; a shard sends one row for each of these contexts.
    """
    shared = dealt.sparkSession.sparkContext.broadcast(often)

    def count(part: pa.Table) -> pa.Table:
        often, pairs, marks = shared.value, [], []
        for shard, packed in zip(part.column("shard").to_pylist(), part.column("content").to_pylist()):
            if shard < 0:
                continue
            context, n, word, index, _, held_out, place = _content(packed)
            before = np.repeat(_codes(context), _wide(n))
            trained = ~held_out[_wide(place)]
            before, words = before[trained], _codes(word)[_wide(index)[trained]]
            mine = np.searchsorted(often, before)
            mine[~np.isin(before, often)] = len(often)
            pairs.append(mixed(mixed(before) * np.uint64(0x9E3779B97F4A7C15) + words))
            marks.append(mine.astype(np.int32))
        found = np.zeros((3, len(often) + 1), np.int64)
        if pairs:
            _, first, seen = np.unique(np.concatenate(pairs), return_index=True, return_counts=True)
            mark = np.concatenate(marks)[first]
            for k, chosen in enumerate((seen > 0, seen == 1, seen == 2)):
                found[k] = np.bincount(mark[chosen], minlength=len(often) + 1)
        some = np.flatnonzero(found[0])
        names = np.append(often, np.uint64(0)).view(np.int64)[some]
        return pa.table({"before": pa.array(names, mask=some == len(often)), **{c: found[k, some] for k, c in enumerate(("t", "n1", "n2"))}})

    kinds = dealt.groupBy("shard").applyInArrow(count, "before bigint, t bigint, n1 bigint, n2 bigint")
    rows = kinds.groupBy("before").agg(*(F.sum(c).alias(c) for c in ("t", "n1", "n2"))).collect()
    out = {None if r.before is None else r.before & (1 << 64) - 1: (r.t, r.n1, r.n2) for r in rows}
    out[None] = tuple(sum(v[k] for v in out.values()) for k in range(3))
    return out


def _discount(n1: int, n2: int) -> float:
    return max(0.1, n1 / (n1 + 2 * n2)) if n1 else 0.5


def _place(before: np.ndarray, words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Where a pair belongs: by its first word, for frequent first words by both."""
    place = mixed(before)
    often = np.isin(before, frequent)
    place[often] = mixed(place[often] ^ mixed(words[often]))
    return place


def _dealt(docs: DataFrame, shards: int, frequent: np.ndarray) -> DataFrame:
    """(shard, source, content): pairs of words by shard; `source` is the batch of texts they come from.

    Ids and held-out marks of a batch's texts come as a row of their own with a negative shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for rows, ids, nulls, out, words, doc in _gathered(batches):
            source = int(rows[0])
            before = _pairs(words, doc)
            shard = ((_place(before, words, frequent) >> np.uint64(20)) % np.uint64(shards)).astype(np.int32)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            names, packed = [-1 - (source >> 8) % shards], [packer.compress(pickle.dumps((ids, nulls, out), protocol=5))]
            for k in np.flatnonzero(np.diff(edges)):
                part = order[edges[k] : edges[k + 1]]
                part = part[np.argsort(before[part], kind="stable")]
                context, n = np.unique(before[part], return_counts=True)
                word, number = np.unique(words[part], return_inverse=True)
                own, place = np.unique(doc[part], return_inverse=True)
                content = (_steps(context), _narrow(n), _steps(word), _narrow(number), own, out[own], _narrow(place))
                names.append(int(k))
                packed.append(packer.compress(pickle.dumps(content, protocol=5)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int32()), pa.array([source] * len(names), pa.int64()), pa.array(packed, pa.binary())], ["shard", "source", "content"])

    return docs.mapInArrow(run, "shard int, source bigint, content binary")


def _content(packed: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Small numbers byte by byte, which compresses well."""
    kind = np.uint16 if not len(x) or x.max() < 1 << 16 else np.uint32
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T)


def _wide(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.T).view({2: np.uint16, 4: np.uint32}[x.shape[0]]).ravel().astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted codes byte by byte."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(len(x), 8).T)


def _codes(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.T).view(np.uint64).ravel(), dtype=np.uint64)


class Shard:
    """The pairs of a shard, scored part by part so that only one part is unpacked at a time."""

    def __init__(self, packed: list[bytes], spread: np.ndarray, frequent: dict[int, tuple[int, int, float]], discount: float):
        self.packed = packed
        self.frequent = frequent
        self.spread = spread
        self.often = np.array(sorted(frequent), np.uint64)
        self.discount = discount
        heads = [_content(p) for p in packed]
        self.own = [h[4] for h in heads]
        self.held_out = np.concatenate([h[5] for h in heads])
        self.size = sum(h[6].shape[1] for h in heads)
        self.shift = np.concatenate([[0], np.cumsum([len(o) for o in self.own])])

    def part(self, number: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word, text) of the pairs of one part."""
        found = []
        for packed, shift in zip(self.packed, self.shift):
            context, n, word, index, _, _, place = _content(packed)
            before, words = np.repeat(_codes(context), _wide(n)), _codes(word)[_wide(index)]
            mine = (_place(before, words, self.spread) >> np.uint64(44)) % np.uint64(parts) == number
            found.append((before[mine], words[mine], shift + _wide(place)[mine]))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def scores(self, known: np.ndarray, counts: np.ndarray, tokens: int, distinct: int) -> list[bytes]:
        """For each batch the shares of its texts: (texts, tokens, known tokens, base, score); `known` are the training words, sorted."""
        size = len(self.held_out)
        sums = [np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)]
        parts = max(1, -(-self.size // PART))
        for number in range(parts):
            before, words, text = self.part(number, parts)
            if not len(text):
                continue
            contexts, context = np.unique(before, return_inverse=True)
            vocabulary, word = np.unique(words, return_inverse=True)
            count = _looked_up(vocabulary, known, counts)
            lower = (count + ADDED) / (tokens + ADDED * (distinct + 1))
            both, which = np.unique(context * len(vocabulary) + word, return_inverse=True)
            trained = np.bincount(which[~self.held_out[text]], minlength=len(both))
            kept = trained > 0
            c, w = both // len(vocabulary), both % len(vocabulary)
            totals = {k: self.frequent[k] for k in contexts[np.isin(contexts, self.often)].tolist()}
            trie = BigramTrie(contexts[c[kept]], vocabulary[w[kept]], trained[kept], lower[w[kept]], self.discount, totals)
            logs = trie.logs(contexts, c, vocabulary, w, np.log10(lower)[w])
            sums[0] += np.bincount(text, minlength=size)
            sums[1] += np.bincount(text[(count > 0)[word]], minlength=size)
            sums[2] += np.bincount(text, weights=np.log10(lower)[word], minlength=size)
            sums[3] += np.bincount(text, weights=logs[which], minlength=size)
        packer = zstandard.ZstdCompressor(level=1)
        return [
            packer.compress(pickle.dumps((own, *(x[a:b] for x in sums)), protocol=5))
            for own, a, b in zip(self.own, self.shift[:-1], self.shift[1:])]


def _added_up(part: pa.Table) -> pa.Table:
    """One row for each text of a batch: ids and marks from the row about it, the sums of all others."""
    rows = list(zip(part.column("about").to_pylist(), part.column("content").to_pylist()))
    ids, nulls, out = next(_content(c) for about, c in rows if about)
    sums = [np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))]
    for about, content in rows:
        if not about:
            own, *shares = _content(content)
            for total, share in zip(sums, shares):
                total[own] += share
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=nulls), "held_out": out, "n_tokens": sums[0], "n_known": sums[1], "base_score": sums[2], "score": sums[3]})


def _looked_up(wanted: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Counts of the wanted words, 0 for unknown ones."""
    if not len(known):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, counts[at], 0)


def lm_scores(docs: DataFrame, modulus: int = 10, shard_tokens: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row for each input row.

    A-Z are lower-cased; tokens are the runs of non-blank characters and one end.  Rows whose
    crc32(doc_id as text) modulo `modulus` is 0 are held out, all others are learnt from (null ids
    count as the empty text).  base_score is the add-0.1 unigram log10 probability, score that of an interpolated
    absolute-discount bigram model over the same unigrams, its probabilities rounded down to
    16-bit steps.  Null and empty texts have the end alone; without training rows both scores
    use counts of zero.  Repeated rows get a row each; other columns are not read.

    The discount is that of all training pairs; a context with a 200th or more of all training tokens has its own.
    Shards are as many as the tokens need and are scored in parts.  A context with half a part of training tokens
    or more is dealt out by both its words, which only places the work: no score depends on it.
    """
    spark = docs.sparkSession
    text = whole_text(text_col).cast("binary")
    read = for_python(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        (remainder(id_col, modulus) == 0).alias("held_out"), text.alias("text")))
    counts = _counted(read)
    released(spark)
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.col("word") == _as_long(END), F.col("n"))).alias("texts")).first()
    tokens, distinct, texts = total.n or 0, total.v, total.texts or 0
    spread, own = min(shard_tokens // 2, PART // 2), max(1, tokens // OFTEN)
    often = _frequent(counts, min(spread, own), texts)
    split = np.array(sorted(c for c, n in often.items() if n >= spread), np.uint64)
    shards = max(1, -(-tokens * modulus // ((modulus - 1) * shard_tokens)))
    dealt = _dealt(read, shards, split).repartition(4 * shards, "shard")
    kinds = _pair_kinds(dealt, np.array(sorted(often), np.uint64))
    released(spark)
    usual = _discount(*kinds[None][1:])
    frequent = {c: (n, kinds[c][0], _discount(*kinds[c][1:]) if n >= own else usual) for c, n in often.items() if c in kinds}
    shared = spark.sparkContext.broadcast(frequent)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[np.ndarray]] = {}
        for names, packed in rows_of(batches, "shard", "content"):
            for name, p in zip(names, packed):
                if name >= 0:
                    own.setdefault(name, []).append(_codes(_content(p)[2]))
        for name, parts in own.items():
            word = np.unique(np.concatenate(parts))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), name, np.int32)), _signed(word)], ["shard", "word"])

    asked = dealt.mapInArrow(words, "shard int, word bigint")
    answered = asked.join(counts, "word").select("shard", "word", "n")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        about = not left.num_rows or left.column("shard")[0].as_py() < 0
        content = left.column("content").to_pylist()
        if not about:
            known = right.column("word").to_numpy().view(np.uint64)
            order = np.argsort(known)
            content = Shard(content, split, shared.value, usual).scores(known[order], right.column("n").to_numpy()[order], tokens, distinct)
        return pa.table({"source": left.column("source"), "about": pa.array([about] * len(content), pa.bool_()), "content": pa.array(content, pa.binary())})

    parts = dealt.groupBy("shard").cogroup(answered.groupBy("shard")).applyInArrow(score, "source bigint, about boolean, content binary")
    summed = parts.groupBy("source").applyInArrow(_added_up, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _as_long(code: int) -> int:
    return code - (1 << 64) if code >> 63 else code
