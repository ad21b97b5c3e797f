"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments, each padded with zeros to the 23 bits of the
perfect Golay code.  Every 23-bit word lies within three bits of one codeword; decoding a
segment and all its one-bit neighbours gives one to six codeword indices, and two segments
that differ in at most two bits share one of them.  Fingerprints that differ in at most five bits
have two segments with at most two errors each, so they share a pair of indices: the keys are
the index pairs of each two segments.  Fingerprints with a common key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, mixed, released, rows_of, stored, whole_text
from strikehaz.llm.components import components

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, fixed value of the binary Golay code
WIDTHS = (22, 21, 21)
RADIUS = 3
BUCKET = 20_000  # fingerprints compared at once; fuller keys are dealt out in blocks
SMALL = 24
SHORT = 50_000  # rows of two numbers that may be broadcast
CERTAIN = 5  # two of three segments have at most two errors each; farther ones share a key by chance
BANDS, ROWS = 24, 5  # of least hashes: sets of Jaccard similarity J agree in no band with probability (1 - J^ROWS)^BANDS
PRINTS = ("print", "other", "third")
LEAST = np.random.default_rng(11).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


def _error_table() -> np.ndarray:
    """The error of at most three bits for each of the 2,048 syndromes."""
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(23), n)], np.int64)
    table = np.zeros(2048, np.int64)
    table[_syndrome(errors)] = errors
    return table


ERRORS = _error_table()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[_syndrome(words)]) >> 11


def segment_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word and its one-bit neighbours: distinct ones first, then -1."""
    flips = np.array([0, *(1 << b for b in range(width))], np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return found[:, : max(1, int((found >= 0).sum(1).max(initial=1)))]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of all keys of the fingerprints."""
    segments, shift = [], 0
    for width in WIDTHS:
        segments.append(segment_keys(((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64), width))
        shift += width
    rows, keys = [], []
    for number, (i, j) in enumerate(combinations(range(len(WIDTHS)), 2)):
        a, b = segments[i][:, :, None], segments[j][:, None, :]
        row, *_ = held = np.nonzero((a >= 0) & (b >= 0))
        joint = (number << 24) | (a << 12) | b
        rows.append(row)
        keys.append(joint[held])
    return np.concatenate(rows), np.concatenate(keys)


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined runs of `size` words, repeats included; fewer words: of all."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist())), np.uint64, len(words) - size + 1)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256)[None, :]


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes; 0 for none."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _BYTE
    ones = (np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return sum(1 << int(b) for b in np.nonzero(2 * ones > len(hashes))[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, print, other): two fingerprints of every row's whole text as signed 64-bit numbers, the second from mixed hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            hashes = [shingle_hashes(t.lower().split(), size) for t in texts]
            prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            others = np.array([majority(mixed(h)) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints), pa.array(others)], ["doc_id", "print", "other"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, "doc_id bigint, print bigint, other bigint")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key of each band from the least hashes of a set under ROWS orders; zeros for the empty set."""
    if not len(hashes):
        return np.zeros(BANDS, np.int32)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for start in range(0, len(hashes), 4096):
        np.minimum(least, np.multiply.outer(LEAST, hashes[start : start + 4096]).min(axis=1), out=least)
    joint = mixed(least).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return -1 - (mixed(joint) >> np.uint64(33)).astype(np.int32)  # below zero: apart from Golay keys


def set_prints(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, whole, print, other, third, bands): of the distinct shingles of every row's whole text a hash, three fingerprints and the band keys."""
    names = ["doc_id", "whole", *PRINTS, "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows_of(batches, "doc_id", "text"):
            sets = [np.unique(shingle_hashes(t.lower().split(), size)) for t in texts]
            whole = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            prints, hashes = [], sets
            for _ in PRINTS:
                prints.append(np.array([majority(h) for h in hashes], np.uint64).view(np.int64))
                hashes = [mixed(h) for h in hashes]
            bands = pa.array([band_keys(s) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(whole), *map(pa.array, prints), bands], names)

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().cast("binary").alias("text"))
    return for_python(read).mapInArrow(run, f"doc_id bigint, whole bigint, {', '.join(f'{c} bigint' for c in PRINTS)}, bands array<int>")


def distance(some: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits of each row of fingerprints."""
    return np.bitwise_count(some ^ one).sum(axis=1, dtype=np.int64)


def near(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all rows of fingerprints of a bucket within the radius, directly or in a chain.

    Breadth-first: each reached one is compared with those not reached yet, so a bucket of
    close copies gives as many links as it has members, not all pairs.
    """
    left = np.arange(len(prints))
    froms, tos = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = distance(prints[left], prints[x]) <= radius
            if close.any():
                met = left[close]
                left = left[~close]
                froms.append(np.full(len(met), x))
                tos.append(met)
                queue.extend(met)
    none = [np.empty(0, np.int64)]
    return np.concatenate(froms or none), np.concatenate(tos or none)


def links_in_buckets(marks: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row numbers) inside each run of equal marks."""
    edges = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1], [True]]))
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    us, vs = [], []
    at = np.flatnonzero(small & (end - np.arange(len(marks)) > 1))
    for step in range(1, SMALL):
        at = at[at + step < end[at]]
        if not len(at):
            break
        hit = at[distance(prints[at], prints[at + step]) <= radius]
        us.append(hit)
        vs.append(hit + step)
    for k in np.flatnonzero(sizes > SMALL):
        a, b = near(prints[edges[k] : edges[k + 1]], radius)
        us.append(a + edges[k])
        vs.append(b + edges[k])
    none = [np.empty(0, np.int64)]
    return np.concatenate(us or none), np.concatenate(vs or none)


def links(nodes: DataFrame, columns: tuple[str, ...] = ("print",), radius: int = RADIUS, bucket: int = BUCKET, bands: str | None = None) -> DataFrame:
    """(u, v): links of nodes whose fingerprints differ in at most `radius` bits, all `columns` together.

    Their components are those of all nodes that share a key of the first column and lie within the
    radius.  With one column that is every pair up to CERTAIN bits; of those farther apart,
    only the ones that do share a key are linked.  Keys in the array column `bands`, all below zero, count as well.

    Rows are dealt out by key and sorted, so a task holds one bucket at a time and searches from its
    smallest node: a group of copies that shares many keys gives much the same links in each.  A key with more than
    `bucket` nodes is dealt out as pairs of blocks: every two of its nodes still
    meet, in tasks of at most two blocks.
    """
    schema = "node bigint, " + ", ".join(f"{c} bigint" for c in columns)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                row, key = fuzzy_keys(part.column(columns[0]).to_numpy().view(np.uint64))
                given = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(given.column(c) for c in ("node", *columns))], ["key", "node", *columns])
                if bands:
                    lists = part.column(bands)
                    given = part.take(pc.list_parent_indices(lists))
                    yield pa.RecordBatch.from_arrays([lists.flatten(), *(given.column(c) for c in ("node", *columns))], ["key", "node", *columns])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, rows = np.empty(0, np.int64), np.empty((0, 1 + len(columns)), np.int64)

        def found(marks: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            u, v = links_in_buckets(marks, rows[:, 1:].view(np.uint64), radius)
            u, v = rows[u, 0], rows[v, 0]
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.concatenate([marks, batch.column("mark").to_numpy()])
            rows = np.concatenate([rows, np.stack([batch.column(c).to_numpy() for c in ("node", *columns)], 1)])
            cut = int(np.searchsorted(marks, marks[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield found(marks[:cut], np.ascontiguousarray(rows[:cut]))
                marks, rows = marks[cut:], rows[cut:]
        if len(marks):
            yield found(marks, np.ascontiguousarray(rows))

    keyed = nodes.select("node", *columns, *([bands] if bands else [])).mapInArrow(spread, f"key int, {schema}")
    marked = in_blocks(keyed, "key", "node", bucket).select("mark", "node", *columns)
    return marked.repartition("mark").sortWithinPartitions("mark", "node").mapInArrow(compare, "u bigint, v bigint")


def hooked(found: DataFrame) -> DataFrame:
    """Distinct links (u < v) with the components of those found: every node hangs on its smallest neighbour, whose other neighbours hang on that one.

    Copies meet under many keys, each time below another small node; those few small nodes are then
    linked to each other instead of to all copies.  A node has at most some links for each of its keys, so no task gathers a hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, top = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
            first = np.concatenate([[v[0] != node], v[1:] != v[:-1]])
            tops = u[np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))]
            if not first[0]:  # the node goes on from the batch before
                tops[: int(first.argmax()) if first.any() else len(u)] = top
            pairs = np.stack([tops, np.where(first, v, u)], 1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            node, top = v[-1], tops[-1]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    return found.repartition("v").sortWithinPartitions("v", "u").mapInArrow(run, "u bigint, v bigint").distinct()


def in_blocks(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Rows with the column `mark`; any two members of a group share a mark.

    Groups of up to `most` rows have one mark.  Larger ones are cut into blocks by the hash of
    the member, and every row goes to all pairs of blocks with its own: tasks stay small, and a
    group's rows multiply by its size over `most`.  The table of larger groups is broadcast if it
    was counted to be short; its length changes the plan only.
    """
    full = stored(rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most))
    released(rows.sparkSession)
    if full.count() <= SHORT:
        full = F.broadcast(full)
    blocks = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(own, b).alias("a"), F.greatest(own, b).alias("b")))
    alone = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    dealt = rows.join(full, group, "left").withColumn("pair", F.explode(F.when(F.col("n").isNull(), alone).otherwise(pairs)))
    return dealt.withColumn("mark", F.xxhash64(group, "pair.a", "pair.b")).drop("n", "pair")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each input row.

    Texts are lower-cased (A-Z); a bit of the fingerprint is 1 if it is set in more than half of the XXH64
    values of the `size`-word shingles, repeats included.  Fewer words are one shingle; null,
    empty and blank texts have fingerprint zero, which links like any other.  Fingerprints
    within `radius` bits are linked; component_id is the smallest id reachable (null if all
    ids of the component are null).  Repeated rows get a row each; other columns are not read.

    Keys, links and components are those of distinct fingerprints, so copies of one text are
    one node however many there are.
    """
    prints = stored(fingerprints(docs, size).drop("other"))
    firsts = prints.groupBy("print").agg(F.min("doc_id").alias("first"))
    for_python(docs, 100_000)
    nodes = prints.select(F.col("print").alias("node"), "print").distinct()
    found = components(stored(links(nodes, ("print",), radius, bucket)))
    labelled = firsts.join(found, firsts["print"] == found["node"], "left").select("print", "first", F.coalesce("label", "print").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = labelled.join(smallest, "label").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct shingle hashes; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common) if len(a) + len(b) else 1.0


def verified_links(ids: list[int], prints: np.ndarray, texts: list[bytes], radius: int, least: float, size: int = 5) -> list[tuple[int, int]]:
    """Links between texts of one block that are similar enough, joined in chains like `near`; `prints` has the fingerprints of each."""
    sets = [np.unique(shingle_hashes(t.lower().split(), size)) for t in texts]
    left, found = list(range(len(ids))), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and left:
            x = queue.pop()
            close = distance(prints[left], prints[x]) <= radius
            met = {y for y, c in zip(left, close.tolist()) if c and similarity(sets[x], sets[y]) >= least}
            if met:
                found += [(ids[x], ids[y]) for y in met]
                left = [y for y in left if y not in met]
                queue += met
    return found


def near_kept(docs: DataFrame, least: float = 0.8, radius: int = 54, block: int = 2000) -> DataFrame:
    """The rows of `docs`, all columns, but those similar to one with a smaller id.

    Two documents are linked if their distinct five-word shingles (A-Z lower-cased) have a
    Jaccard similarity of `least` or more; of each component the smallest id stays.
    Candidates share a key and differ in at most `radius` of the 192 bits of three fingerprints, in a chain; the
    similarity of candidates is computed exactly.  Fingerprints and keys come from the same distinct shingles as the
    similarity, so a line repeated more often changes none of them.  Keys are the Golay keys of the first fingerprint,
    which close pairs share for certain and far ones by chance, and BANDS keys of ROWS least hashes each, all of which a pair of
    similarity 0.8 misses once in 10,000.  Such a pair differs in 29 bits, give or take 5, unrelated ones in
    96, give or take 7, so chains of unrelated texts do not form however many there are.
    Texts without words are equal to each other.  Rows with a null id are never dropped; rows
    that share an id stay or go together.  Tests state the recall.
    """
    spark = docs.sparkSession
    released(spark)
    prints = stored(set_prints(docs.where("doc_id IS NOT NULL")))
    for_python(docs, 100_000)
    nodes = stored(prints.groupBy("whole").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in (*PRINTS, "bands"))))
    prints = prints.drop("bands")
    found = stored(hooked(links(nodes, PRINTS, radius, bands="bands")))
    released(spark)
    same = prints.join(nodes.select("whole", "node"), "whole").select("doc_id", "node")
    clusters = components(same.union(found)).toDF("doc_id", "label")
    members = stored(prints.join(clusters, "doc_id"))
    released(spark)
    for_python(docs, 500)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, held = None, []

        def found() -> pa.RecordBatch:
            ids, *prints, texts = zip(*held)
            pairs = verified_links(list(ids), np.ascontiguousarray(np.array(prints, np.int64).T).view(np.uint64), list(texts), radius, least)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for columns in rows_of(batches, "mark", "doc_id", *PRINTS, "text"):
            for m, *row in zip(*columns):
                if held and m != mark:
                    yield found()
                    held = []
                mark = m
                held.append(row)
        if held:
            yield found()

    texts = docs.select("doc_id", whole_text().cast("binary").alias("text"))
    dealt = in_blocks(members, "label", "doc_id", block).select("mark", "doc_id", *PRINTS)
    rows = dealt.join(texts, "doc_id").repartition("mark").sortWithinPartitions("mark", "doc_id")
    classes = components(rows.mapInArrow(verify, "u bigint, v bigint"))
    gone = classes.where("node <> label").select(F.col("node").alias("__gone"))
    released(spark)
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
