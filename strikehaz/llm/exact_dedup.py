"""Exact duplicates: group by a 128-bit content hash, then compare bytes inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikehaz.llm.common import stored, whole_text


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", digest=_digest) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, digest): one row for each input row.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.  `keep` says
    whether the smallest ("min") or the largest ("max") id of a group stays; null ids stay
    only where the whole group has none.  Repeated rows (same id, same text) all count in
    group_size and are all marked `kept` if their id stays; `exact_kept` returns one of them.
    Other columns are not read.  An empty table gives an empty result.

    Only hashes are grouped (counts are combined before the shuffle, so a group of any size
    sends one row for each task).  Texts move once, to be compared with the text of the row
    that stays; a hash whose texts differ is grouped again by the texts themselves.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep is 'min' or 'max', not {keep!r}")
    pick = F.min if keep == "min" else F.max
    text = whole_text(text_col)
    hashed = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"))
    groups = hashed.groupBy("digest").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    decided = hashed.join(groups, "digest")

    texts = docs.select(F.col(id_col).alias("doc_id"), digest(text).alias("digest"), text.alias("text"))
    repeated = texts.join(groups.where("group_size > 1"), "digest")
    staying = repeated.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("staying"))
    odd = stored(repeated.join(staying, "digest").where(F.col("text") != F.col("staying")).groupBy("digest").agg(F.count("*").alias("n_odd")))
    if not odd.isEmpty():
        clash = texts.join(odd, "digest", "left_semi")
        apart = clash.groupBy("digest", "text").agg(pick("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        resolved = clash.join(apart, ["digest", "text"]).withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        decided = decided.join(odd, "digest", "left_anti").unionByName(resolved.select("digest", "doc_id", "sha", "keep_id", "group_size"))
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "digest",
    )


def exact_kept(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of `docs`, all columns, that stay: one for each distinct text.

    Rows are dropped by (id, SHA-256), so an id that also has another text keeps it.
    Of repeated rows with the id that stays, one is returned.
    """
    found = exact_groups(docs, keep)
    in_groups = stored(found.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.first("kept").alias("kept"), F.count("*").alias("copies")))
    key = F.sha2(whole_text().cast("binary"), 256)

    def matches(others: DataFrame) -> Column:
        return F.col("doc_id").eqNullSafe(others["__id"]) & (key == others["__sha"])

    named = in_groups.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), "kept", "copies")
    gone = named.where("NOT kept OR copies > 1").select("__id", "__sha")
    staying = docs.join(gone, matches(gone), "left_anti")
    again = named.where("kept AND copies > 1").select("__id", "__sha")
    one_each = docs.join(again, matches(again), "left_semi").withColumn("__sha", key).dropDuplicates(["doc_id", "__sha"]).drop("__sha")
    return staying.unionByName(one_each)
