"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Every window of a document that is as long as a benchmark item gets a 64-bit SimHash of its
word shingles.  Items and windows of one length are joined on four 16-bit blocks: of two
fingerprints within 15 bits one block differs in at most three, so each item is entered under
all block values within three bits and each window asks with its own four.  What is met
is compared by the weighted (multiset) Jaccard similarity of its shingles.

A window can only be similar enough if most of its shingles occur in items of its length, so
windows are first thinned by a bit table of the items' shingles, once for any length and then
for the own one.  This loses nothing: the table has no false negatives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, gram_hashes, mixed, rows_of, stored, whole_text, word_hashes

SHINGLE = 5
TABLE_BITS = 20  # the bit table has 2^20 slots whatever the benchmark's size
RADIUS = 15  # four blocks: one of them has at most three errors
NEAR_BLOCKS = np.array(sorted(sum(1 << b for b in bits) for n in range(RADIUS // 4 + 1) for bits in combinations(range(16), n)), np.int64)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.lower().split()


def prints_at(grams: np.ndarray, count: int, starts: np.ndarray) -> np.ndarray:
    """SimHash of `count` successive shingles from each start: bits set in more than half of them."""
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.concatenate([[0], np.cumsum((grams >> np.uint64(bit)) & np.uint64(1))]).astype(np.int64)
        out |= ((ones[starts + count] - ones[starts]) * 2 > count).astype(np.uint64) << np.uint64(bit)
    return out


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller over the sum of the larger counts of each shingle."""
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def _kinds(size: int) -> tuple[int, int]:
    """Shingle length of items with `size` words and how many shingles they have; short ones are one shingle."""
    gram = min(size, SHINGLE)
    return gram, size - gram + 1


def _slots_of(hashes: np.ndarray, size: int = 0) -> np.ndarray:
    """Slots of shingles of items with `size` words; 0: of any."""
    return (mixed(hashes + np.uint64(size)) & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)


def candidate_windows(words: list[bytes], sizes: np.ndarray, table: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, fingerprints) of the windows that can be similar enough to an item of that size."""
    own = word_hashes(words)
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in sizes[sizes <= len(words)].tolist():
        gram, count = _kinds(size)
        if gram not in grams:
            hashes = gram_hashes(own, gram)
            grams[gram] = hashes, np.concatenate([[0], np.cumsum(table[_slots_of(hashes)])])
        hashes, seen = grams[gram]
        needed = least * count - 1e-9
        if seen[-1] < needed:
            continue
        starts = np.flatnonzero(seen[count:] - seen[:-count] >= needed)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > count) + 1) if len(starts) else ():
            low = int(part[0])
            span = hashes[low : int(part[-1]) + count]
            seen_here = np.concatenate([[0], np.cumsum(table[_slots_of(span, size)])])
            kept = part[seen_here[part - low + count] - seen_here[part - low] >= needed]
            if len(kept):
                yield size, kept, prints_at(span, count, kept - low)


def _item_rows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, print, text) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "item_id", "text"):
            found = []
            for item, text in zip(ids, texts):
                words = words_of(text)
                if words:
                    gram, count = _kinds(len(words))
                    own = prints_at(gram_hashes(word_hashes(words), gram), count, np.zeros(1, np.int64))
                    found.append((item, len(words), int(own.view(np.int64)[0]), b" ".join(words)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "size", "print", "item"])

    read = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, "item_id bigint, size int, print bigint, item binary")


def _slots(items: DataFrame) -> np.ndarray:
    """Bit table of the shingles of all items; at most 2^20 slot numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in rows_of(batches, "item"):
            slots = [np.empty(0, np.int64)]
            for text in texts:
                words = text.split()
                hashes = gram_hashes(word_hashes(words), _kinds(len(words))[0])
                slots += [_slots_of(hashes), _slots_of(hashes, len(words))]
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(slots)).astype(np.int32))], ["slot"])

    table = np.zeros(1 << TABLE_BITS, np.int32)
    found = for_python(items.select("item")).mapInArrow(run, "slot int").distinct().toPandas()
    table[found["slot"].to_numpy()] = 1
    return table


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity): the documents that hold a passage similar to a benchmark item, and the best similarity.

    Words are runs of non-blank characters, A-Z lower-cased.  A passage is any window with as
    many words as the item; the similarity is the weighted Jaccard similarity of five-word
    shingles (items of fewer words are one shingle), `least` or more.  Pairs whose fingerprints
    differ in more than 15 bits are not seen; copies differ in none.  Items without words fit
    nothing, null and empty texts hold nothing.  Repeated documents and items give one row for each
    (doc_id, item_id); rows with null ids stand for themselves as one document.

    Windows are reduced to distinct (size, fingerprint) before they are joined with the items,
    so copies of a passage are looked up once.  The benchmark is joined by shuffle; what is
    broadcast is a bit table of fixed size and the list of item lengths.
    """
    spark = docs.sparkSession
    items = stored(_item_rows(benchmark))
    lengths = [r.size for r in items.select("size").distinct().collect()]  # no more than the longest item has words
    shared = spark.sparkContext.broadcast((np.array(sorted(lengths), np.int64), _slots(items)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, table = shared.value
        for ids, texts in rows_of(batches, "doc_id", "text"):
            out: list[tuple] = []
            for doc_id, text in zip(ids, texts):
                words = words_of(text)
                for size, starts, prints in candidate_windows(words, sizes, table, least):
                    out.extend((doc_id, size, own, b" ".join(words[s : s + size])) for s, own in zip(starts.tolist(), prints.view(np.int64).tolist()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "size", "print", "passage"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    held = for_python(read).mapInArrow(windows, "doc_id bigint, size int, print bigint, passage binary").distinct()
    held = stored(held.withColumn("passage_key", F.md5("passage")))
    passages = held.groupBy("size", "print", "passage_key").agg(F.first("passage").alias("passage"))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("print").to_numpy()
            for k in range(batch.num_rows):
                keys = [((own[k] >> (16 * b)) & 0xFFFF ^ NEAR_BLOCKS) | (b << 16) for b in range(4)]
                keys = np.concatenate(keys).astype(np.int32)
                row = batch.slice(k, 1).take(pa.array(np.zeros(len(keys), np.int32)))
                yield pa.RecordBatch.from_arrays([row.column("size"), pa.array(keys), row.column("print")], ["size", "block", "item_print"])

    index = items.select("size", "print").distinct().mapInArrow(entered, "size int, block int, item_print bigint")
    asked = passages.select("size", "print").distinct().select(
        "size", "print",
        F.explode(F.array(*[F.shiftrightunsigned("print", 16 * b).bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(b << 16)).cast("int") for b in range(4)])).alias("block"))
    met = (
        asked.join(index, ["size", "block"]).where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
        .select("size", "print", "item_print").distinct()
    )
    named = items.select(F.col("size"), F.col("print").alias("item_print"), "item_id", "item")
    pairs = met.join(named, ["size", "item_print"]).join(passages, ["size", "print"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for prints, keys, texts, ids, items_ in rows_of(batches, "print", "passage_key", "passage", "item_id", "item"):
            found = []
            for own, key, text, item, body in zip(prints, keys, texts, ids, items_):
                value = 1.0 if text == body else weighted_similarity(_shingles(text.split()), _shingles(body.split()))
                if value >= least:
                    found.append((own, key, item, value))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64()]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["print", "passage_key", "item_id", "similarity"])

    alike = for_python(pairs.select("print", "passage_key", "passage", "item_id", "item")).mapInArrow(
        verify, "print bigint, passage_key string, item_id bigint, similarity double")
    return held.join(alike, ["print", "passage_key"]).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _shingles(words: list[bytes]) -> Counter:
    gram, count = _kinds(len(words))
    return Counter(b" ".join(words[k : k + gram]) for k in range(count))


def flagged(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, leaked, n_items, item_ids, similarity): one row for each input row.

    item_ids are the benchmark items the document holds (see `leaks`), ascending, empty if
    none; similarity is the best one, null if none.
    """
    found = leaks(docs, benchmark, least).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    return ids.join(found, ids["id"].eqNullSafe(found["doc_id"]), "left").select(
        F.col("id").alias("doc_id"), F.col("item_ids").isNotNull().alias("leaked"), F.coalesce(F.size("item_ids"), F.lit(0)).alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of `docs`, all columns, that hold no benchmark passage."""
    gone = leaks(docs, benchmark, least).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
