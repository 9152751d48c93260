"""Reading plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, spread over all of them by ``keys``.

    For small inputs of CPU-heavy steps. A table with enough splits is left as it is stored: no
    shuffle. ``scan`` must not contain shuffles itself; only its planned splits are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, *keys)
