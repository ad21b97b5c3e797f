"""Vector code compression: product codes whose codebooks are fitted by active-entry Lloyd.

Vectors become integers and are cut into equal parts; each part position has a codebook.  A round
assigns every part to its nearest entry and moves each entry to the floor of its parts' mean.  The
assigned entry and its exact distance are stored with the row: a part whose entry stayed where it was
is compared with the moved entries only, every other part is scanned anew.  A part's
distances to entries that did not move cannot have changed, so both ways give the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import for_python, released, stored, stored_table

REACH = 1 << 27  # integers are kept within this, so that distances and sums of any number of rows are exact
SLICE = 4096  # rows whose distances to all entries are held at once


@dataclass(frozen=True)
class Settings:
    """Sizes of the codes; at most 256 entries, so that an index is a byte."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(REACH)), F.lit(-REACH)).cast("int"))


def kept(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector): integer vectors of the rows without null or non-finite components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), integers(F.col("embedding"), scale).alias("vector"))


def squared(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers to entries."""
    width = parts.shape[1]
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * reach * reach * max(width, 1) < 1 << 52:  # sums stay exact as doubles
        p, b = parts.astype(np.float64), book.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(parts), len(book)), np.int64)
    for d in range(width):
        out += (parts[:, d, None] - book[None, :, d]) ** 2
    return out


def nearest(parts: np.ndarray, book: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of `among` (ascending) nearest to each row, the lowest index of equal ones, and its distance."""
    codes, dists = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    for start in range(0, len(parts), SLICE):
        d = squared(parts[start : start + SLICE], book[among])
        best = d.argmin(1)
        codes[start : start + SLICE] = among[best]
        dists[start : start + SLICE] = d[np.arange(len(d)), best]
    return codes, dists


def reassigned(parts: np.ndarray, codes: np.ndarray, dists: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes and distances after the entries `moved` (flags) changed, and how many distances that took."""
    codes, dists = codes.copy(), dists.copy()
    lost = moved[codes]
    active, stay, again = np.flatnonzero(moved), np.flatnonzero(~lost), np.flatnonzero(lost)
    if len(active) and len(stay):
        rival, far = nearest(parts[stay], book, active)
        better = (far < dists[stay]) | ((far == dists[stay]) & (rival < codes[stay]))
        codes[stay[better]], dists[stay[better]] = rival[better], far[better]
    if len(again):
        codes[again], dists[again] = nearest(parts[again], book, np.arange(len(book)))
    return codes, dists, len(stay) * len(active) + len(again) * len(book)


def _cut(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    """(rows, parts, width) integers of the column `vector`."""
    flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, width)


STATE = ["vec_id", "label", "vector", "codes", "dists", "scanned"]


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, parts: int) -> DataFrame:
    """Rows with the codes (a byte each), distances and the distances computed under the codebooks.

    `moved` is None for the first assignment; afterwards rows have codes and distances of the codebooks before.
    """
    shared = rows.sparkSession.sparkContext.broadcast((books, moved))  # parts x entries vectors, whatever the table holds
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, moved = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _cut(batch, parts, width)
            codes, dists = np.zeros((batch.num_rows, parts), np.int64), np.zeros((batch.num_rows, parts), np.int64)
            scanned = 0
            if moved is not None:
                codes[:] = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                dists[:] = batch.column("dists").flatten().to_numpy().reshape(-1, parts)
            for p in range(parts):
                if moved is None:
                    codes[:, p], dists[:, p] = nearest(cut[:, p], books[p], np.arange(books.shape[1]))
                    scanned += len(cut) * books.shape[1]
                else:
                    codes[:, p], dists[:, p], n = reassigned(cut[:, p], codes[:, p], dists[:, p], books[p], moved[p])
                    scanned += n
            raw = codes.astype(np.uint8).tobytes()
            offsets = np.arange(batch.num_rows + 1, dtype=np.int32) * parts
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), batch.column("vector"), pa.array([raw[k : k + parts] for k in range(0, len(raw), parts)], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(dists.ravel())), pa.array([scanned] + [0] * (batch.num_rows - 1), pa.int64())], STATE)

    kind = rows.schema["label"].dataType.simpleString()
    return for_python(rows, 20_000).mapInArrow(run, f"vec_id bigint, label {kind}, vector array<int>, codes binary, dists array<bigint>, scanned bigint")


def _moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry at the floor of the mean of its parts; unused entries stay.

    Each task adds up its own rows, so it sends one number for each entry and component; the sums of all tasks reach the driver.
    """
    parts, entries, width = books.shape
    step = width + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, step), np.int64)
        for batch in batches:
            if batch.num_rows:
                cut = _cut(batch, parts, width)
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    np.add.at(sums[p, :, :width], codes[:, p], cut[:, p])
                    sums[p, :, width] += np.bincount(codes[:, p], minlength=entries)
        used = np.flatnonzero(np.repeat(sums[:, :, width] > 0, step))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums.ravel()[used])], ["place", "total"])

    gathered = for_python(state.select("vector", "codes"), 20_000).mapInArrow(run, "place bigint, total bigint")
    sums = np.zeros(parts * entries * step, np.int64)
    for place, total in gathered.groupBy("place").agg(F.sum("total").alias("total")).collect():  # at most one row for each entry and component
        sums[place] = total
    sums = sums.reshape(parts, entries, step)
    counts = sums[:, :, width]
    means = sums[:, :, :width] // np.maximum(counts, 1)[:, :, None]
    return np.where(counts[:, :, None] > 0, means, books)


def books_digest(books: np.ndarray) -> str:
    """Lowercase SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _with_label_sums(rows: DataFrame) -> DataFrame:
    """`rows` with label_error, the sum of `error` over equal labels; nulls are one label.

    Labels with a thousandth of the rows or more are at most 1,000 and are broadcast; the others have
    too few rows each to fill a task, and meet their sums in a shuffle.
    """
    key = F.struct(F.col("label").isNull().alias("none"), F.col("label").alias("label"))
    sums = stored(rows.groupBy(key.alias("key")).agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    often = sums.where(F.col("n") * 1000 >= total).select(F.col("key").alias("often"), F.col("label_error").alias("often_error"))
    marked = rows.withColumn("key", key).join(F.broadcast(often), F.expr("key <=> often"), "left")
    hot = marked.where("often IS NOT NULL").withColumn("label_error", F.col("often_error"))
    rest = marked.where("often IS NULL").join(sums.select(F.col("key").alias("seldom"), "label_error"), F.expr("key <=> seldom")).drop("seldom")
    return hot.unionByName(rest).drop("key", "often", "often_error")


def compressed(vectors: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, vector, codes, dists, scanned), codebooks): the final assignment of every kept row.

    See `vector_codes` for what is kept; `codes` has one byte for each part, `dists` its exact squared distances,
    the sum of `scanned` is the number of distances that the last assignment computed.
    """
    spark = vectors.sparkSession
    read = kept(vectors, settings.scale)
    firsts = sorted(read.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(settings.entries).collect(), key=lambda r: (r.vec_id, r.vector))
    size = len(firsts[0].vector) if firsts else 0
    read = read.where(F.size("vector") == size)
    firsts = [r.vector for r in firsts if len(r.vector) == size]
    width = -(-size // settings.parts)
    if firsts:
        padded = np.zeros((len(firsts), width * settings.parts), np.int64)
        padded[:, :size] = firsts
        books = np.ascontiguousarray(padded.reshape(len(firsts), settings.parts, width).transpose(1, 0, 2))
    else:
        books = np.zeros((settings.parts, 1, width), np.int64)
    if width * settings.parts > size:
        read = read.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0), width * settings.parts - size)))
    state, moved = read, None
    for _ in range(settings.rounds):
        following = stored_table(_assigned(state, books, moved, settings.parts))
        if moved is not None:
            released(spark, state)
        state = following
        after = _moved_books(state, books)
        books, moved = after, (after != books).any(axis=2)
    following = stored_table(_assigned(state, books, moved, settings.parts))
    if moved is not None:
        released(spark, state)
    return following, books


def vector_codes(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row for each kept row of (vec_id, embedding, label).

    Rows whose vector is null or has null or non-finite components are dropped.  Components become floor(scale * x),
    kept within +-2^27.  Codebooks start at the rows with the smallest ids (equal ids: the smaller vector first; null ids
    never), fewer if there are fewer rows.  The vector of the smallest id gives the length; rows of another length
    are dropped, a length that does not divide is filled up with zeros, empty vectors have zero distances.
    Repeated rows count and are returned each; other columns are not read; an empty table gives an empty result.

    code has two hex digits for each part, error is the sum of the parts' exact squared distances, label_error the sum of
    errors over equal labels (nulls together).  Codebooks are settings.parts x settings.entries vectors at any size;
    rows never leave their task but to be written with their state in the shared folder.
    """
    state, books = compressed(vectors, settings)
    rows = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), F.aggregate("dists", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    return _with_label_sums(rows).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
