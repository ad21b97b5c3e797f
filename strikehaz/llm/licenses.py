"""License scans: TF-IDF cosine of license lines and files to templates, inherited along paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.llm.common import LOWER, UPPER, stored, whole_text

#: Lines and files without such a word are no license statements and are not compared.
KEYWORDS = "(?i)licen[cs]e|copyright|spdx|released under|all rights reserved"
TERM = "[a-z0-9]+(?:\\.[0-9]+)*"
LICENSE_FILE = "(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause license"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution license CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0"),
]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, text string")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def cosines(units: DataFrame, templates: DataFrame) -> DataFrame:
    """(unit_key, license, score): best template of each distinct text (unit_key, unit) that shares a term with any.

    Weights are counts times idf = ln((1 + T) / (1 + df)) + 1 over the T templates; terms of no
    template have df 0 and only lengthen a unit's vector.  Of equal scores the smallest name counts.
    """
    kinds = templates.select("license", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "term").agg(F.count("*").alias("n"))
    size = F.lit(templates.select("license").distinct().count())
    idf = kinds.groupBy("term").agg(F.count("*").alias("df")).select("term", (F.log((size + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighted = kinds.join(idf, "term").withColumn("weight", F.col("n") * F.col("idf"))
    norms = weighted.groupBy("license").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    sides = weighted.join(norms, "license").select("license", "term", (F.col("weight") / F.col("norm")).alias("share"))
    texts = units.select("unit_key", "unit").dropDuplicates(["unit_key"])
    found = texts.select("unit_key", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("unit_key", "term").agg(F.count("*").alias("n"))
    own = stored(found.join(idf, "term", "left").withColumn("weight", F.col("n") * F.coalesce("idf", F.log(size + 1) + 1)))
    length = own.groupBy("unit_key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = own.join(sides, "term").groupBy("unit_key", "license").agg(F.sum(F.col("weight") * F.col("share")).alias("dot"))
    scored = dots.join(length, "unit_key").select("unit_key", "license", F.round(F.col("dot") / F.col("length"), 6).alias("score"))
    best = scored.groupBy("unit_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("unit_key", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def licenses(files: DataFrame, templates: DataFrame, least: float = 0.6, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, path, own_license, own_score, license, inherited_from): one row for each distinct (id, path, text hash).

    A file's own license is the best match, `least` or more, of its lines with a license word,
    and of its whole text if its name marks it as a license file.  A license file that has one
    sets it for its directory (the best score, then the smallest name and path counts).  A file without its own takes
    that of the nearest directory upwards, its own directory first; `inherited_from` names
    it ("" is the root).  Null texts are empty, null paths are files in the root; nothing
    found gives nulls.  Repeated rows give one row.  Other columns are not read.

    Lines are compared once however many files have them; inheritance is settled for distinct directories.
    """
    read = files.select(
        F.col(id_col).alias("doc_id"), F.coalesce("path", F.lit("")).alias("path"), whole_text().alias("text")
    ).withColumn("version", F.xxhash64("text"))
    key = ["doc_id", "path", "version"]
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(KEYWORDS))
    whole = F.when(F.col("path").rlike(LICENSE_FILE), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = read.where(F.col("text").rlike(KEYWORDS)).select(*key, F.explode(F.array_union(lines, whole)).alias("unit"))
    units = stored(units.withColumn("unit_key", F.unhex(F.md5(F.col("unit").cast("binary")))))
    matched = cosines(units, templates).where(F.col("score") >= least)
    own = (
        units.drop("unit").join(matched, "unit_key").groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("own"))
        .select(F.col("doc_id").alias("id"), F.col("path").alias("at"), F.col("version").alias("of"), F.col("own.license").alias("own_license"), (-F.col("own.s")).alias("own_score"))
    )
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("path") == F.col("at")) & (F.col("version") == F.col("of"))
    marked = stored(read.select(*key, directory.alias("directory")).distinct().join(own, same, "left").drop("id", "at", "of"))
    declared = (
        marked.where(F.col("path").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
        .groupBy("directory").agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_license", "path")).alias("d"))
        .select(F.col("directory").alias("ancestor"), F.col("d.own_license").alias("declared"))
    )
    parts = F.split("directory", "/")
    depths = F.when(F.col("directory") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    upwards = marked.select("directory").distinct().select("directory", F.explode(depths).alias("depth")).withColumn("ancestor", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    nearest = (
        upwards.join(declared, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "ancestor", "declared")).alias("n"))
        .select("directory", F.col("n.ancestor").alias("ancestor"), F.col("n.declared").alias("declared"))
    )
    inherits = F.col("own_license").isNull()
    return marked.join(nearest, "directory", "left").select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "declared").alias("license"),
        F.when(inherits, F.col("ancestor")).alias("inherited_from"))
