"""The register of named queries, and pieces of SQL that several of them share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.functions import text as X

QUERIES: dict = {}
ORACLE: dict = {}
WS, BLANK = X.WS, X.BLANK


def segments_sql(x: str) -> str:
    """Segments in SQL: marks are replaced by a sentinel, since RE2 has no lookbehind."""
    return rf"string_split(regexp_replace(regexp_replace({x}, '([.!?]){BLANK}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '{BLANK}+'), lambda w: w <> ''))"


def slug_sql(x: str) -> str:
    s = f"trim(regexp_replace(coalesce({x}, ''), '[^A-Za-z0-9]+', '_', 'g'), '_')"
    return f"CASE WHEN {s} = '' THEN 'chapter' ELSE {s} END"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def c(name: str):
    return F.col(name)
