"""Substring dedup: FM-index shards give matching statistics of documents, repeated windows go.

Windows of the same words must meet in the same shard.  Each window has an anchor, the smallest
hash among its runs of ANCHOR words; neighbouring windows mostly share it and form a stretch.
Only anchors that several documents have can hold repeated windows.  Their stretches are reduced to
distinct ones with the smallest document id, dealt out by anchor, indexed in shards of bounded size
and streamed through backward search, which gives for each window the interval of its
occurrences and with it the smallest document id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, gram_hashes, released, rows_of, stored_table, whole_text
from strikehaz.llm.fm_index import FMIndex
from strikehaz.llm.word_places import by_size, numbered, place_hashes, word_places

ANCHOR = 4
PIECE = 64  # windows of a stretch; longer ones are cut, which loses no window
SHARD_WORDS = 1_000_000
HOT = 10_000  # stretches of an anchor; beyond, they are dealt out window by window


class Stretches(NamedTuple):
    """The stretches of some texts, and where the words of the joined texts are."""

    joined: bytes
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray
    first: np.ndarray  # number of the first word of each text, and of all words
    text: np.ndarray  # of each stretch from here on: number of its text
    anchor: np.ndarray
    start: np.ndarray  # its first window in the text
    windows: np.ndarray


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """The smallest hash among the runs of ANCHOR words in each window."""
    grams = gram_hashes(hashes, min(ANCHOR, window))
    spread = window - min(ANCHOR, window) + 1
    if len(grams) < spread:
        return np.empty(0, np.uint64)
    taken = 1
    while taken < spread:
        more = min(taken, spread - taken)
        grams = np.minimum(grams[:-more], grams[more:])
        taken += more
    return grams


def anchors(words: list[bytes], window: int) -> np.ndarray:
    """The anchor of every window of the words."""
    joined = b" ".join(words)
    return _least(place_hashes(joined, *word_places(joined)), window)


def stretches(texts: list[bytes], window: int) -> Stretches:
    """The stretches of each text, in order."""
    joined = b" ".join(texts)
    starts, ends = word_places(joined)
    behind = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(starts, behind)])
    least = _least(place_hashes(joined, starts, ends), window).view(np.int64)
    sizes = np.maximum(np.diff(first) - window + 1, 0)  # windows of each text
    found = np.concatenate([least[a : a + n] for a, n in zip(first.tolist(), sizes.tolist())])
    before = np.cumsum(sizes) - sizes
    fresh = np.concatenate([[True], found[1:] != found[:-1]])[: len(found)]
    fresh[before[sizes > 0]] = True
    at = np.flatnonzero(fresh)
    text = np.repeat(np.arange(len(texts)), sizes)[at]
    return Stretches(joined, starts, ends, first, text, found[at], at - before[text], np.diff(at, append=len(found)))


def _columns(kinds: list[tuple[str, pa.DataType]], size: int, **columns) -> pa.RecordBatch:
    """Columns as a batch of `size` rows; those not given are null."""
    made = [pa.array(columns[n], k) if n in columns else pa.nulls(size, k) for n, k in kinds]
    return pa.RecordBatch.from_arrays(made, [n for n, _ in kinds])


def _table(kinds: list[tuple[str, pa.DataType]], rows: list[tuple], names: list[str] | None = None) -> pa.RecordBatch:
    """Rows as a batch; `names` are the columns they have, all others are null."""
    names = names or [n for n, _ in kinds]
    return _columns(kinds, len(rows), **dict(zip(names, list(zip(*rows)) or [()] * len(names))))


def _shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, doc_id, n) of the anchors that at least two documents have, once for each document, with its number of stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            done = 0
            for some in by_size(texts):
                found = stretches(some, window)
                order = np.lexsort((found.anchor, found.text))
                text, anchor = found.text[order], found.anchor[order]
                fresh = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[: len(text)])
                doc_ids = np.array(ids[done : done + len(some)], np.int64)[text[fresh]]
                counts = np.diff(fresh, append=len(text)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[fresh]), pa.array(doc_ids), pa.array(counts)], ["anchor", "doc_id", "n"])
                done += len(some)

    read = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    pairs = stored_table(for_python(read).mapInArrow(run, "anchor bigint, doc_id bigint, n int"))
    several = pairs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = stored_table(pairs.join(several, "anchor"))
    released(docs.sparkSession, pairs)
    return shared


CUT = [
    ("doc_id", pa.int64()), ("version", pa.int64()), ("n_words", pa.int64()), ("kept", pa.string()), ("text", pa.binary()),
    ("anchor", pa.int64()), ("code", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("hot", pa.bool_()), ("words", pa.binary()),
]
CUT_SCHEMA = (
    "doc_id bigint, version bigint, n_words bigint, kept string, text binary, "
    "anchor bigint, code bigint, start int, windows int, hot boolean, words binary")
COMBINED = 200_000  # distinct stretches a task holds before it sends them


def _cut(docs: DataFrame, shared: DataFrame, window: int, keep: bool) -> DataFrame:
    """Three kinds of rows in one table.

    n_words set: a document, with its text if that is needed and else with its digest.  start set: a
    stretch of a document, by anchor and hash code.  words set: the words of a stretch, once
    for each task that met it, doc_id being the smallest one there.
    """
    hot = shared.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > HOT).select("anchor", F.lit(True).alias("hot"))
    wanted = (
        shared.join(hot, "anchor", "left").groupBy(F.col("doc_id").alias("id"))
        .agg(F.collect_list("anchor").alias("wanted"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        met: dict[bytes, list] = {}

        def combined() -> pa.RecordBatch:
            rows = [(*known, words) for words, known in met.items()]
            return _table(CUT, rows, ["doc_id", "anchor", "code", "windows", "hot", "words"])

        for batch in batches:
            ids, versions, packed = (batch.column(n).to_pylist() for n in ("doc_id", "version", "text"))
            asked = batch.column("wanted").is_valid().to_pylist()
            wanted = np.unique(batch.column("wanted").flatten().to_numpy())
            hot = np.isin(wanted, batch.column("hot").flatten().to_numpy())
            texts: list[tuple] = []

            def opened() -> Iterator[bytes]:
                for doc_id, version, small, is_asked in zip(ids, versions, packed, asked):
                    text = unpacker.decompress(small)
                    n_words = text.count(b" ") + 1 if text else 0
                    if is_asked or keep:
                        texts.append((doc_id, version, n_words, None, small))
                    else:
                        texts.append((doc_id, version, n_words, hashlib.sha256(text).hexdigest(), None))
                    if is_asked:
                        yield text

            rows = np.flatnonzero(asked)
            done = 0
            for some in by_size(opened()):
                found = stretches(some, window)
                own = rows[done : done + len(some)]
                done += len(some)
                text, start, windows, at = _pieces(found, wanted, hot)
                anchor, is_hot = wanted[at], hot[at]
                word = found.first[text] + start
                doc_ids = np.array([ids[k] for k in own], np.int64)[text]
                codes = []
                places = found.starts[word].tolist(), found.ends[word + windows + window - 2].tolist()
                for doc_id, a, count, h, begin, end in zip(doc_ids.tolist(), anchor.tolist(), windows.tolist(), is_hot.tolist(), *places):
                    part = found.joined[begin:end]
                    known = met.get(part)
                    if known is None:
                        known = met[part] = [doc_id, a, _signed_hash(part), count, h]
                    elif doc_id < known[0]:
                        known[0] = doc_id
                    codes.append(known[2])
                version = np.array([versions[k] for k in own], np.int64)[text]
                yield _columns(CUT, len(codes), doc_id=doc_ids, version=version, anchor=anchor, code=codes, start=start.astype(np.int32), windows=windows.astype(np.int32))
                if len(met) >= COMBINED:
                    yield combined()
                    met.clear()
            yield _table(CUT, texts, ["doc_id", "version", "n_words", "kept", "text"])
        yield combined()

    light = for_python(docs).mapInArrow(_packed, "doc_id bigint, version bigint, text binary")
    joined = light.join(wanted, light["doc_id"] == wanted["id"], "left").select("doc_id", "version", "text", "wanted", "hot")
    return stored_table(joined.mapInArrow(run, CUT_SCHEMA))


def _pieces(found: Stretches, wanted: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, number of windows and place in `wanted`, which is sorted, of the stretches with a wanted anchor, cut to length."""
    if not len(wanted):
        return (np.empty(0, np.int64),) * 4
    at = np.minimum(np.searchsorted(wanted, found.anchor), len(wanted) - 1)
    kept = np.flatnonzero(wanted[at] == found.anchor)
    at = at[kept]
    size = np.where(hot[at], 1, PIECE)
    pieces = -(-found.windows[kept] // size)
    of = np.repeat(np.arange(len(kept)), pieces)
    skipped = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * size[of]
    kept = kept[of]
    return found.text[kept], found.start[kept] + skipped, np.minimum(size[of], found.windows[kept] - skipped), at[of]


def _signed_hash(words: bytes) -> int:
    code = xxhash.xxh64_intdigest(words)
    return code - (1 << 64) if code >> 63 else code


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed runs of words with one space between."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [packer.compress(b" ".join(t.split())) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(texts, pa.binary())], ["doc_id", "version", "text"])


def first_owners(texts: list[bytes], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of any text that holds a window, for all windows of all texts in order, and how many each text has."""
    numbers, symbols = numbered(b" ".join(texts))
    lengths = np.fromiter((t.count(b" ") + 1 for t in texts), np.int64, len(texts))
    index = FMIndex.joined(numbers, lengths, symbols, context=window)
    low, high = index.matching(window)
    owner_at = np.repeat(owners, index.lengths + 1)[index.order]
    found = np.flatnonzero(low >= 0)
    low, high = low[found], high[found]
    highs = np.zeros(len(index.text) + 1, np.int64)
    highs[low] = high
    lows = np.flatnonzero(highs)
    bounds = np.stack([lows, highs[lows]], 1).ravel()  # intervals of different windows never overlap
    by_low = np.empty(len(index.text) + 1, np.int64)
    by_low[lows] = np.minimum.reduceat(np.concatenate([owner_at, owner_at[:1]]), bounds)[::2]
    return by_low[low], index.lengths - window + 1


def _repeated(cut: DataFrame, window: int) -> DataFrame:
    """(anchor, code, first, seen): distinct stretches, their first document and its windows that an earlier one has."""
    rows = cut.where("words IS NOT NULL").select(F.col("doc_id").alias("first"), "anchor", "code", "windows", "hot", "words")
    size = rows.agg(F.sum(F.col("windows") + window - 1)).first()[0] or 0
    shards = max(1, -(-int(size) // SHARD_WORDS))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        shard = None

        def found() -> pa.RecordBatch:
            anchor, code, first = zip(*held.values())
            owners = np.array(first, np.int64)
            mins, counts = first_owners(list(held), owners, window)
            of = np.repeat(np.arange(len(held)), counts)
            earlier = np.flatnonzero(mins < owners[of])
            bits = np.zeros((len(held), -(-int(counts.max()) // 8) * 8), bool)
            bits[of[earlier], earlier - (np.cumsum(counts) - counts)[of[earlier]]] = True
            seen = [row.tobytes() if some else None for row, some in zip(np.packbits(bits, axis=1, bitorder="little"), bits.any(axis=1).tolist())]
            return _columns(
                [("anchor", pa.int64()), ("code", pa.int64()), ("first", pa.int64()), ("seen", pa.binary())],
                len(held), anchor=anchor, code=code, first=owners, seen=seen)

        for columns in rows_of(batches, "shard", "anchor", "code", "words", "first"):
            for name, anchor, code, words, first in zip(*columns):
                if held and name != shard:
                    yield found()
                    held = {}
                shard = name
                known = held.get(words)
                if known is None:
                    held[words] = [anchor, code, first]
                elif first < known[2]:
                    known[2] = first
        if held:
            yield found()

    place = F.when(F.col("hot"), F.xxhash64("words")).otherwise(F.xxhash64("anchor"))
    dealt = rows.withColumn("shard", F.pmod(place, F.lit(shards)).cast("int")).select("shard", "anchor", "code", "words", "first")
    dealt = for_python(dealt, 20_000).repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(search, "anchor bigint, code bigint, first bigint, seen binary")


def without_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text, removed]): one row for each input row.

    Words are runs of non-blank characters, unchanged.  A word goes if it is covered by a window of
    `window` words whose words in this order also start in a document with a smaller id; windows
    are judged on the input.  kept_text is what is left, joined by one space (null texts count as empty), and
    `removed` has the (start, end) word intervals that went.  Rows with a null id neither go nor make others go; rows
    that share an id are one document in what they make others lose, and are cut alike if equal.
    Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = whole_text(text_col)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), text.cast("binary").alias("text"))
    shared = _shared_anchors(read, window)
    released(spark)
    cut = _cut(read, shared, window, keep)
    released(spark, shared)
    gone = _removed(cut, window)
    released(spark)
    texts = cut.where("n_words IS NOT NULL").select("doc_id", "version", "n_words", "kept", "text")
    same = texts["doc_id"].eqNullSafe(gone["id"]) & (texts["version"] == gone["of"])
    joined = texts.join(gone, same, "left").select("doc_id", "n_words", "kept", "text", "parts")
    kinds = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    if keep:
        kinds += [("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))]
        schema += ", kept_text string, removed array<array<bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            ids, sizes, kept, packed = (batch.column(n).to_pylist() for n in ("doc_id", "n_words", "kept", "text"))
            rows = [(doc_id, size, 0, digest, *([""] * keep), *([[]] * keep)) for doc_id, size, digest in zip(ids, sizes, kept)]
            cutting = [k for k, digest in enumerate(kept) if digest is None]
            done = 0
            for texts in by_size(unpacker.decompress(packed[k]) for k in cutting):
                own = cutting[done : done + len(texts)]
                done += len(texts)
                first = np.concatenate([[0], np.cumsum([sizes[k] for k in own])])
                going = covered(batch.column("parts").slice(own[0], own[-1] + 1 - own[0]), np.array(own) - own[0], first, window)
                for k, words, left in zip(own, np.split(going, first[1:-1]), _left(texts, first, going)):
                    rows[k] = (ids[k], sizes[k], int(np.count_nonzero(words)), hashlib.sha256(left).hexdigest())
                    if keep:
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], words, [False]]).astype(np.int8)))
                        rows[k] += (left.decode("utf-8", "replace"), edges.reshape(-1, 2).tolist())
            yield _table(kinds, rows)

    return for_python(joined).mapInArrow(run, schema)


def covered(parts: pa.ListArray, rows: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Which words a removed window covers, for the texts of these rows; `first` has the number of the first word of each, and of all.

    `seen` has a bit for each window of a part, null means all.  Other rows than `rows` have no parts.
    """
    counts = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)[rows]
    start, windows, seen = parts.flatten().flatten()
    start = start.to_numpy() + np.repeat(first[:-1], counts)
    all_gone = seen.is_null().to_numpy(zero_copy_only=False)
    begins, ends = [start[all_gone]], [(start + windows.to_numpy() + window - 1)[all_gone]]
    if not all_gone.all():
        bits = seen.drop_null().to_pylist()
        width = max(map(len, bits))
        packed = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in bits), np.uint8).reshape(-1, width)
        part, nth = np.nonzero(np.unpackbits(packed, axis=1, bitorder="little"))
        begins.append(start[~all_gone][part] + nth)
        ends.append(begins[1] + window)
    change = np.bincount(np.concatenate(begins), minlength=first[-1] + 1) - np.bincount(np.concatenate(ends), minlength=first[-1] + 1)
    return np.cumsum(change[:-1]) > 0


def _left(texts: list[bytes], first: np.ndarray, going: np.ndarray) -> Iterable[bytes]:
    """The words of each text that do not go, with one space between, as they have in the texts."""
    joined = b" ".join(texts)
    starts, ends = word_places(joined)
    edge = np.zeros(len(going) + 1, bool)  # before this word a text begins
    edge[first] = True
    gone = np.concatenate([[True], going, [True]])
    begin = np.flatnonzero(~going & (gone[:-2] | edge[:-1]))
    end = np.flatnonzero(~going & (gone[2:] | edge[1:]))
    runs = [joined[a:b] for a, b in zip(starts[begin].tolist(), ends[end].tolist())]
    upto = np.searchsorted(begin, first).tolist()
    return (b" ".join(runs[a:b]) for a, b in zip(upto, upto[1:]))


def _removed(cut: DataFrame, window: int) -> DataFrame:
    """(id, of, parts): the parts of each document whose windows go."""
    places = cut.where("start IS NOT NULL").select("doc_id", "version", "anchor", "code", "start", "windows")
    later = F.col("doc_id") > F.col("first")
    gone = (
        places.join(_repeated(cut, window), ["anchor", "code"]).where(later | F.col("seen").isNotNull())
        .select(F.col("doc_id").alias("id"), F.col("version").alias("of"), F.struct("start", "windows", F.when(~later, F.col("seen")).alias("seen")).alias("part"))
        .groupBy("id", "of").agg(F.collect_list("part").alias("parts"))
    )
    return stored_table(gone)
