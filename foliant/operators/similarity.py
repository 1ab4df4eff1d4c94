"""Cosine search of a stated query set against all vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from foliant.operators.layout import UNKNOWN, input_bytes

#: Ids that one block of queries, and one pack of vectors, spans.
BLOCK, PACK = 40_960, 4096
#: Bytes of vectors that meet one copy of the queries.
SHARE = 128 << 20
SCHEMA = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])


def top_similar(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """(query_id, vec_id, score): the ``k`` nearest other vectors of each query by cosine; ties go to the lower id.

    Null and zero vectors take no part. Each batch of vectors keeps the best ``k`` of every query before anything is
    shuffled.
    """
    usable = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL AND aggregate(v, 0D, (s, x) -> s + x * x) > 0")
    q = usable(queries)
    blocks = q.groupBy(F.floor(F.col("id") / BLOCK).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("queries"))
    packs = usable(vectors).groupBy(F.floor(F.col("id") / PACK).alias("pack")).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
    # every pack meets every block: each share of the packs gets a copy of the blocks, and there are as many shares as tasks
    size, cores = input_bytes(vectors), vectors.sparkSession.sparkContext.defaultParallelism
    shares = max(cores, size // SHARE) if size < UNKNOWN else 8 * cores
    sent = packs.withColumn("share", F.pmod(F.xxhash64("pack"), F.lit(shares)).cast("int"))
    met = sent.join(blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))), "share")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def unit(items) -> tuple[np.ndarray, np.ndarray]:
            m = np.array([r["v"] for r in items], np.float64)
            return np.array([r["id"] for r in items]), m / np.linalg.norm(m, axis=1, keepdims=True)

        for pdf in batches:
            out = []
            for rows, queries in zip(pdf["rows"], pdf["queries"]):
                ids, m = unit(rows)
                qids, q = unit(queries)
                scores = q @ m.T
                for i, own in enumerate(qids):
                    order = np.lexsort((ids, -scores[i]))
                    out += [(own, ids[j], scores[i, j]) for j in order[: k + 1] if ids[j] != own][:k]
            yield pd.DataFrame(out, columns=SCHEMA.names)

    found = met.mapInPandas(run, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("r", rank).where(F.col("r") <= k).drop("r")
