"""Prefix sums over ordered rows of a key, in two levels.

A window over a key puts all rows of that key into one task. Here the rows of a key are cut into buckets that follow the
order; buckets are summed first, their sums are turned into offsets, and only inside a bucket does a window run. So a
key that holds a third of all rows is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column, name: str, inclusive: bool = True) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the key up to (and with) each row.

    ``bucket`` must not decrease along ``order``. Null values count as 0. Without keys all rows are one sequence.
    """
    b, v = f"_{name}_bucket", f"_{name}_value"
    df = df.withColumn(b, bucket).withColumn(v, F.coalesce(value, F.lit(0)).cast("long"))
    before = Window.partitionBy(*keys).orderBy(F.col(b).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, b).agg(F.sum(v).alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = df.withColumn("_local", F.coalesce(F.sum(v).over(inside), F.lit(0)))
    joined = local.alias("l").join(sums.drop("_sum").alias("s"), [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*keys, b]])
    return joined.select("l.*", (F.col("_local") + F.col("_before")).alias(name)).drop(b, v, "_local")


def numbered(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str = "pos") -> DataFrame:
    """``df`` with ``name``: the rank of each row in its key, from 1."""
    return running_sum(df, keys, bucket, order, F.lit(1), name)
