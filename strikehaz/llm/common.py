"""Helpers the operators of this folder share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strikehaz.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder of spark.checkpoint.dir; the copy outlives any executor."""
    if checkpoint_dir(df.sparkSession) is None:
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    return df.checkpoint(eager=True)


def stored_table(df: DataFrame) -> DataFrame:
    """Like `stored`, as a compressed Parquet table: for wide rows that are read several times by column.

    The table stays in the checkpoint folder, which its owner clears.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if folder is None:
        raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of `stored_table` that are used up, and let Spark delete shuffle files of frames no longer referred to."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        folder = jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
        if folder is not None and folder.getName().startswith("table-"):
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()
    jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def _ship(spark: SparkSession) -> None:
    """Hand this package to Spark once for each application; executors need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[2]
    folder = _shipped[sc.applicationId] = tempfile.TemporaryDirectory()  # the driver's own, which Spark's file server reads; gone at exit
    archive = f"{folder.name}/strikehaz_llm.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in [top / "strikehaz/__init__.py", top / "strikehaz/session.py", *sorted((top / "strikehaz/llm").glob("*.py"))]:
            z.write(path, path.relative_to(top))
    sc.addPyFile(archive)


def for_python(df: DataFrame, rows: int = 256) -> DataFrame:
    """Ready for mapInArrow: the package is on the executors, and batches have few rows since texts can be very long."""
    _ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of n words; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    out = hashes[:size] + np.uint64(n)
    for k in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : k + size]
    return mixed(out)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of each batch as Python lists."""
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(n).to_pylist() for n in names)
