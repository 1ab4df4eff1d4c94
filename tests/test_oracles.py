"""Every query with SQL gives the same rows in DuckDB, on the smallest tables."""

import datetime
import html as html_lib
import math
import os
import re
from collections import Counter

import duckdb
import pytest

from foliant.functions import markup as M
from foliant.plans.catalogue import ORACLE, QUERIES, _html


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    rel = duck.sql(ORACLE[name])
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


# Queries that SQL can't express, each with the plain function of a row that gives its result.
PLAIN = {
    "chunk_text": lambda html, text: [] if text is None else M.chunk(text, 500),
    "page_text": lambda html, text: M.strip_html_text(html),
    "page_text_without_ads": lambda html, text: M.strip_html_text(html.replace('<div class="ad">Buy (now)</div>', "<div></div>").replace("p { margin: 0 }", "")),
    "page_text_feed": lambda html, text: " ".join(re.sub(r"&[A-Za-z0-9#]+;", "", re.sub(r"<[^>]+>", "", html_lib.unescape(html).replace("\xa0", " "))).split()),
    "roman_numerals": lambda html, text: M.roman_text(text),
}


def test_every_query_has_sql_or_a_model():
    assert set(QUERIES) - set(ORACLE) == set(PLAIN)


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_same_as_model(name, spark, sf):
    rows = {r.chapter_id: r for r in _html(spark, sf).join(spark.read.parquet(f"{sf}/chapters.parquet").select("chapter_id", "content_text"), "chapter_id").collect()}
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if "pos" in df.columns:
        chunks = {i: [] for i in rows}
        for r in sorted(got, key=lambda r: (r.chapter_id, r.pos)):
            chunks[r.chapter_id].append(r.chunk)
        got = list(chunks.items())
    assert len(got) == len(rows)
    for i, value in got:
        assert value == PLAIN[name](rows[i].html, rows[i].content_text), i
