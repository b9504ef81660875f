"""Spark session and checkpoint-directory handling.

Library code never builds its own session: every job takes the caller's
``SparkSession``.  This module is for tests, the bench and command-line use.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tillroll.storage import shared_dir

# Settings every job relies on: zone-less time handling, adaptive execution
# (runtime coalescing of small shuffles, skew-join splitting) and no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # Checkpointed intermediates (ranges, invoice grains) are deleted once
    # the DataFrames that own them are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app: str = "tillroll",
    driver_memory: str = "16g",
    extra: dict | None = None,
) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark
