"""Shared storage for intermediates: where it is, and how a relation is written once.

Intermediates go to the folder the cluster names in ``spark.checkpoint.dir``,
which every executor and the driver can reach.  Only a local master, whose
single machine is the whole cluster, gets a scratch folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of this session.

    Raises ``RuntimeError`` on a cluster that names none: a machine-local
    folder there would lose intermediates together with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to storage that all executors share")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write a relation once (compressed Parquet, shared folder) and read it back.

    Later branches and retried tasks all read the same rows, column by column,
    and the lineage ends here.
    """
    path = fresh_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
