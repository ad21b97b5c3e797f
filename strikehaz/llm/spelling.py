"""Spelling variant grouping by dense prefix-suffix tiling.

Words one edit apart share all but one place: their common prefix and common suffix
together reach the longer word's length less one.  Places are cut into PIECES windows; a pair whose edit
lies in a window agrees before and behind it, so words meet by what is outside of one window.  Within
such a group padded code-point matrices of block pairs are compared, and each pair is taken once, in the
window of its first difference.  Links are added up per word where they are found, not sent as pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, rows_of, stored, whole_text

RUN = re.compile("[A-Za-zÀ-ÿ]+")
CUT = 97  # a run whose checksum this divides loses a code point
LEAST_LENGTH, LEAST_COUNT = 5, 3
HELD = 300_000  # words a task counts before it sends them on; no effect on results
PIECES = 3
BLOCK = 2_000  # words of a group compared at once; fuller groups are dealt out as pairs of blocks
CELLS = 1 << 22  # of the matrices of one comparison
SMALL = 48  # groups up to this size are compared side by side


def document_words(doc_id: str, text: bytes) -> Counter:
    """Counted words of a whole text: lower-cased (A-Z) runs of letters, some of which lose a code point."""
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % CUT == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
        if len(run) >= LEAST_LENGTH:
            out[run] += n
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of all texts with at least LEAST_COUNT occurrences, counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for ids, texts in rows_of(batches, "id", "text"):
            for i, t in zip(ids, texts):
                held.update(document_words(i, t))
            if len(held) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    read = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), whole_text().cast("binary").alias("text"))
    counted = for_python(read).mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def window(length: int, piece: int) -> tuple[int, int]:
    """First place of a window of a word of `length` code points, and the one behind it."""
    return piece * length // PIECES, (piece + 1) * length // PIECES


def group_keys(words: list[str]) -> tuple[list[int], list[int], list[int], list[int]]:
    """(row, longer, piece, key): what each word shares with its near words whose longer length and window these are."""
    rows, longers, pieces, keys = [], [], [], []
    for row, word in enumerate(words):
        size = len(word)
        for longer in (size, size + 1):
            for piece in range(PIECES):
                a, b = window(longer, piece)
                rows.append(row)
                longers.append(longer)
                pieces.append(piece)
                keys.append(xxhash.xxh64_intdigest(f"{longer} {piece} {word[:a]} {word[size - (longer - b):] if longer > b else ''}"))
    return rows, longers, pieces, keys


def padded(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points from the left and from the right, filled up with zeros, and lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    left = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    right = np.frombuffer(b"".join(w[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
    return left, right, lengths


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal leading places of rows of two matrices."""
    same = a == b
    first = same.argmin(axis=1)
    return np.where(same[np.arange(len(same)), first], a.shape[1], first)


def single_edits(left: np.ndarray, right: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray, longer: int, places: tuple[int, int]) -> np.ndarray:
    """Which of the pairs (i, j) differ by one edit whose first place lies in the window, and have this longer length.

    Only the longest prefix and suffix count, and the prefix comes first, so equal letters around
    the edit do not let a pair be found twice.
    """
    size, other = lengths[i], lengths[j]
    fit = np.flatnonzero((np.maximum(size, other) == longer) & (np.abs(size - other) <= 1))
    prefix = np.minimum(common(left[i[fit]], left[j[fit]]), np.minimum(size, other)[fit])
    hold = (prefix >= places[0]) & (prefix < places[1])
    fit, prefix = fit[hold], prefix[hold]
    suffix = np.minimum(common(right[i[fit]], right[j[fit]]), longer - 1 - prefix)
    return fit[prefix + suffix >= longer - 1]


def near_in_run(groups: np.ndarray, sides: np.ndarray, crossing: np.ndarray, words: list[bytes], longer: int, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (row numbers) within each run of equal groups.

    In a crossing group, made of two blocks, only rows of different sides meet.
    """
    width, places = longer, window(longer, piece)
    left, right, lengths = padded(words, width)
    edges = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1], [True]]))
    sizes = np.diff(edges)
    end = np.repeat(edges[1:], sizes)
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, CELLS // width)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = ~crossing[i] | (sides[i] != sides[j])
        i, j = i[ok], j[ok]
        for start in range(0, len(i), step):
            a, b = i[start : start + step], j[start : start + step]
            hit = single_edits(left, right, lengths, a, b, longer, places)
            us.append(a[hit])
            vs.append(b[hit])

    at = np.flatnonzero(np.repeat(sizes <= SMALL, sizes) & (end - np.arange(len(groups)) > 1))
    for shift in range(1, SMALL):
        at = at[at + shift < end[at]]
        if not len(at):
            break
        take(at, at + shift)
    for k in np.flatnonzero(sizes > SMALL):
        start, stop = int(edges[k]), int(edges[k + 1])
        for a in range(start, stop, 256):
            rows = np.arange(a, min(a + 256, stop))
            for b in range(a, stop, 256):
                i, j = np.meshgrid(rows, np.arange(b, min(b + 256, stop)), indexing="ij")
                ahead = i < j
                take(i[ahead], j[ahead])
    return np.concatenate(us), np.concatenate(vs)


def best_near(words: list[bytes], counts: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, number of near words, the near word of largest count, the smallest of equal ones) of each row with pairs."""
    froms, tos = np.concatenate([u, v]), np.concatenate([v, u])
    names = np.array([words[k] for k in tos.tolist()]) if len(tos) else np.empty(0, "S1")
    order = np.lexsort((names, -counts[tos], froms))
    froms, tos = froms[order], tos[order]
    first = np.flatnonzero(np.concatenate([[True], froms[1:] != froms[:-1]])) if len(froms) else np.empty(0, np.int64)
    return froms[first], np.diff(np.append(first, len(froms))), tos[first]


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): for words that have near words, their number and the one of largest n.

    Groups above BLOCK words are dealt out as pairs of blocks by the word's hash, so that a task holds
    two blocks of one group at most.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, longers, pieces, keys = group_keys(batch.column("word").to_pylist())
            given = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(longers, pa.int32()), pa.array(pieces, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)), given.column("word"), given.column("n")],
                ["longer", "piece", "key", "word", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["longer", "piece", "mark", "side", "crossing", "word", "n"]
        held: list[pa.RecordBatch] = []

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            longer, piece, mark, side, crossing, n = (table.column(c).to_numpy() for c in ("longer", "piece", "mark", "side", "crossing", "n"))
            texts = table.column("word").to_pylist()
            kinds = longer.astype(np.int64) * PIECES + piece
            edges = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1], [True]])) if len(kinds) else []
            for a, b in zip(edges[:-1], edges[1:]):
                words = [w.encode("latin-1") for w in texts[a:b]]
                u, v = near_in_run(mark[a:b], side[a:b], crossing[a:b], words, int(longer[a]), int(piece[a]))
                if len(u):
                    row, number, best = best_near(words, n[a:b], u, v)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([texts[a + k] for k in row.tolist()], pa.string()), pa.array(number.astype(np.int64)),
                         pa.array([texts[a + k] for k in best.tolist()], pa.string()), pa.array(n[a:b][best])], ["word", "n_near", "form", "form_n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.select(names))
            last = [batch.column(c)[-1].as_py() for c in ("longer", "piece", "mark")]
            table = pa.Table.from_batches(held)
            if table.num_rows < 4 * BLOCK:
                continue
            ends = np.flatnonzero((table.column("mark").to_numpy() != last[2]) | (table.column("piece").to_numpy() != last[1]) | (table.column("longer").to_numpy() != last[0]))
            cut = int(ends[-1]) + 1 if len(ends) else 0  # the last group may go on in the next batch
            yield from found(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from found(pa.Table.from_batches(held))

    keyed = for_python(vocab, 10_000).mapInArrow(spread, "longer int, piece int, key bigint, word string, n bigint")
    full = stored(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK))
    dealt = _in_block_pairs(keyed, full)
    sorted_rows = dealt.repartition("mark").sortWithinPartitions("longer", "piece", "mark")
    partial = sorted_rows.mapInArrow(compare, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("order"), F.col("form").alias("form"))).alias("best")
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.order")).alias("form_n"))


def _in_block_pairs(keyed: DataFrame, full: DataFrame) -> DataFrame:
    """Rows with `mark` of what is compared together, the own block `side`, and whether only different sides meet."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    alone = F.array(pair(F.lit(0), F.lit(0)))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: pair(F.least(own, b), F.greatest(own, b)))
    dealt = keyed.join(full, "key", "left").withColumn("pair", F.explode(F.when(F.col("size").isNull(), alone).otherwise(pairs)))
    return dealt.select(
        "longer", "piece", F.xxhash64("key", "pair.a", "pair.b").alias("mark"), F.coalesce(own, F.lit(0)).alias("side"),
        (F.col("pair.a") != F.col("pair.b")).alias("crossing"), "word", "n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following (word, form); a form has at least twice the occurrences, so there is no cycle.

    Steps double each round, so a chain of length d takes about log2(d) rounds.
    """
    steps = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        joined = stored(steps.join(ahead, steps["root"] == ahead["via"], "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("via").isNotNull().alias("went")))
        if joined.where("went").isEmpty():
            return joined.select("word", "root")
        steps = joined.select("word", "root")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row for each word of at least five code points and three occurrences.

    Words come from every whole text (null: none), see `document_words`; a null doc_id counts as the empty text.
    Near words differ by one inserted, deleted or replaced code point; form is the near word of largest n (ties: the
    smallest in code-point order) if its n is at least twice the word's, else null; root follows forms to the last.
    n_near is 0 without near words.  Repeated rows count each; other columns are not read; an empty table gives an
    empty result.
    """
    vocab = stored(vocabulary(docs))
    found = vocab.join(near_words(vocab), "word", "left")
    enough = F.col("form_n") >= 2 * F.col("n")
    words = stored(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n")))
    followed = roots(words.where("form IS NOT NULL"))
    return words.join(followed, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
