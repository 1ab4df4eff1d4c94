"""Layout of partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input below which a scan may give fewer tasks than there are cores.
SPLIT = 4 << 20
#: From here on a plan's size isn't one of files but a stand-in for not known.
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Size of what the frame reads, from the file sizes its plan knows; no job runs."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only where a scan is too small to give every core a task, before costly work on texts.

    Large inputs have more splits than cores, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if input_bytes(df) < cores * SPLIT else df
