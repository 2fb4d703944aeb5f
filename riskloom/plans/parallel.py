"""Parallelism of row-wise plans over small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out when the scan has fewer partitions than the cluster has cores.

    For plans that spend much CPU on each row.  A large table has more partitions
    than there are cores and is left as it is: no shuffle is added at scale.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
