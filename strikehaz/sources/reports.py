"""Report scans, file fingerprints, and the sinks: partitioned facts, layers, catalog, quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.operators.layers import LayerStamp, geo_table, geojson_features, stamped


def fingerprints(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file_name, n_bytes, sha256) per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256")
    )


def flat_report(spark: SparkSession, path: str, nested: str) -> DataFrame:
    """One row per entry of a nested report section: name plus its fields."""
    report = spark.read.json(path, multiLine=True)
    fields = report.schema[nested].dataType
    entries = [
        F.struct(F.lit(f.name).alias("name"), *[F.col(f"{nested}.`{f.name}`.`{g.name}`").alias(g.name) for g in f.dataType.fields])
        for f in fields.fields
    ]
    return report.select(F.inline(F.array(*entries)))


def report_summary(spark: SparkSession, path: str, nested: list[str]) -> DataFrame:
    """Top-level fields of a report with the named sections flattened as <section>_<field>."""
    report = spark.read.json(path, multiLine=True)
    plain = [c for c in report.columns if c not in nested]
    flat = [
        F.col(f"{n}.{f.name}").alias(f"{n}_{f.name}") for n in nested for f in report.schema[n].dataType.fields
    ]
    return report.select(*plain, *flat)


def write_splits(split_df: DataFrame, path: str) -> None:
    """Splits as one partitioned table (K1)."""
    split_df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split back; only its partition is read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def write_facts(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Parquet fact table (K2)."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_layer(df: DataFrame, path: str, stamp: LayerStamp, formats=("geojson", "parquet", "csv")) -> dict[str, str]:
    """Stamped layer as newline-delimited GeoJSON, geo Parquet and flat CSV (K3-K6)."""
    out = stamped(df, stamp)
    written = {}
    if "geojson" in formats:
        written["geojson"] = f"{path}/geojson"
        geojson_features(out).write.mode("overwrite").text(written["geojson"])
    if "parquet" in formats:
        written["parquet"] = f"{path}/parquet"
        geo_table(out).write.mode("overwrite").parquet(written["parquet"])
    if "csv" in formats:
        written["csv"] = f"{path}/csv"
        out.write.mode("overwrite").csv(written["csv"], header=True)
    return written


def write_features(features: DataFrame, path: str) -> None:
    """Prepared feature records as JSON lines, for publishing by hand (K9)."""
    features.write.mode("overwrite").json(path)


def quality_rows(section: str, df: DataFrame, key: str, value: str) -> DataFrame:
    """A small report table as (section, key, value) text rows (K8)."""
    return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"))


def write_quality_report(rows: list[DataFrame], path: str, title: str, sample_data_flag: bool) -> None:
    """Sections stacked and written as JSON lines (K8)."""
    table = rows[0]
    for more in rows[1:]:
        table = table.unionByName(more)
    table.withColumns({"title": F.lit(title), "sample_data_flag": F.lit(sample_data_flag)}).coalesce(1).write.mode("overwrite").json(path)


def table_entry(df: DataFrame, name: str, source: str, description: str) -> DataFrame:
    """Catalog row of one table (K7)."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.lit(", ".join(df.columns)).alias("columns"), F.lit(source).alias("source"), F.lit(description).alias("description"),
    )


def build_catalog(tables: dict[str, tuple[DataFrame | None, str, str]], database: str) -> DataFrame:
    """Full rebuild of the catalog tables and their metadata table (K7).

    `tables` maps a name to (frame, source, description); an absent source
    (None) is skipped, never faked.
    """
    present = {name: entry for name, entry in tables.items() if entry[0] is not None}
    if not present:
        raise ValueError("No source is present; there is nothing to build")
    spark = next(iter(present.values()))[0].sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    metadata = None
    for name, (df, source, description) in present.items():
        df.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.{name}")
        row = table_entry(spark.table(f"{database}.{name}"), name, source, description)
        metadata = row if metadata is None else metadata.unionByName(row)
    metadata = metadata.withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    metadata.write.mode("overwrite").format("parquet").saveAsTable(f"{database}.table_metadata")
    return spark.table(f"{database}.table_metadata")
