"""Helpers shared by the text operators: parallel spread, Arrow row mapping, checkpoints."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


#: Bytes of input below which a scan may give fewer tasks than there are cores.
SPLIT = 4 << 20


def input_bytes(df: DataFrame) -> int:
    """Size of what the frame reads, from the file sizes its plan knows; no job runs."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """Repartition only where a scan is too small to give every core a task.

    Large inputs have more splits than cores, so at scale this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if input_bytes(df) < cores * SPLIT else df


def map_batches(df: DataFrame, fn: Callable[[Iterator[list[list]]], Iterator[list[list]]], schema: T.StructType) -> DataFrame:
    """Run ``fn`` over each partition as an iterator of column lists; it yields column lists of ``schema``.

    Columns are addressed by position, so clashing or extra names of the caller's frame don't matter.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ([c.to_pylist() for c in b.columns] for b in batches)
        for out in fn(columns):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a session on one machine (tests, the bench) gets a folder of its own; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or os.path.join(tempfile.gettempdir(), "foliant-checkpoints"))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
