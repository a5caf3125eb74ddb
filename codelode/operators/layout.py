"""Partition layout of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Inputs above this size come in enough row groups to keep all cores busy.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is small and comes from fewer files than there are cores, else as it is.

    A file of one row group is read by one task, however many cores there are; for work that takes more time than dealing the
    rows out does, that leaves the others idle. Large inputs are never shuffled by this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 1 << 20 < size <= SMALL_BYTES and 0 < len(df.inputFiles()) < cores else df
