"""Session settings the operators rely on, and lineage cutting that survives lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Read by every plan here: instants are UTC, bad casts are handled with try_*,
#: and AQE sizes partitions, picks broadcasts from measured sizes and splits
#: skewed shuffle partitions.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller owns."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


_scratch: list[tempfile.TemporaryDirectory] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder, from the context or `spark.checkpoint.dir`.

    A cluster must have one: without it this fails at once.  A local master, where the driver is
    the only machine, gets a folder that goes with the process.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        _scratch.append(tempfile.TemporaryDirectory(prefix="strikehaz-checkpoint-", ignore_cleanup_errors=True))
        configured = _scratch[-1].name
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that is read more than once: a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
