import os
import re

import duckdb
from hypothesis import given, settings, strategies as st

from foliant.llm import pieces as P
from foliant.llm.common import table


def test_same_as_sql(spark, sf):
    con = duckdb.connect()
    for t in ("chapters", "tts_limits"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(con.sql(P.ORACLE["p3_found"]).fetchall())
    assert want and sorted(map(tuple, P.p3_found(spark, sf).collect())) == want


def test_pieces_cover_and_overlap(spark, sf):
    text = {r.chapter_id: r.content_text for r in table(spark, sf, "chapters").collect()}
    limit = {r.model_name: r for r in table(spark, sf, "tts_limits").collect()}
    for r in P.split_oversized(table(spark, sf, "chapters"), table(spark, sf, "tts_limits"), "chapter_id", "content_text").collect():
        own, t = limit[r.model_name], text[r.id]
        assert r.starts[0] == 0 and r.ends[-1] == len(t)
        assert all(0 < b - a <= own.max_chars for a, b in zip(r.starts, r.ends))
        assert all(a < s <= e and e - s <= own.overlap_chars for a, s, e in zip(r.starts, r.starts[1:], r.ends))


def test_ranges_give_what_the_whole_gives(spark, sf):
    args = (table(spark, sf, "chapters"), table(spark, sf, "tts_limits"), "chapter_id", "content_text")
    whole = sorted(map(str, P.split_oversized(*args).collect()))
    assert sorted(map(str, P.split_oversized(*args, size=700, halo=4).collect())) == whole


def test_defined_cases(spark):
    limits = spark.createDataFrame([("a", 10, 3), ("b", 10, 3), ("none", None, None), ("zero", 0, 1), ("wide", 5, 9)], "model_name string, max_chars int, overlap_chars int")
    rows = [(1, None), (2, ""), (3, "short"), (4, "x" * 40), (5, "one. two. three. four.")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id, r.model_name): r for r in P.split_oversized(df, limits, "id", "text").collect()}
    assert set(got) == {(i, m) for i in (4, 5) for m in ("a", "b", "wide")}
    assert got[4, "a"].cut == "forced" and got[5, "a"].cut == "natural"
    assert got[4, "a"].ends == [10, 17, 24, 31, 38, 40] and got[5, "a"].ends[0] == 10
    wide = df.selectExpr("id", "text", "id AS part", "'x' AS model_name", "1 AS n", "text AS begin", "array(1) AS starts")
    same = {(r.id, r.model_name): r for r in P.split_oversized(wide.union(wide), limits, "id", "text").collect()}
    assert same == got and P.split_oversized(wide.union(wide), limits, "id", "text").count() == 2 * len(got)
    assert P.split_oversized(df, limits.limit(0), "id", "text").count() == 0
    assert P.split_oversized(df.limit(0), limits, "id", "text").count() == 0


def whole(text, most, overlap):
    """The pieces by one pass over the whole text: strong boundaries, white space only where they are far apart."""
    strong = [(m.end(), k) for m in P.BOUNDARY.finditer(text) if (k := P._strength(m.group())) is not None]
    edges = [0, *(e for e, _ in strong), len(text) + 1]
    table = dict(strong)
    for a, b in zip(edges, edges[1:]):
        if b - a > P.FINE:
            table |= {m.end(): P.SPACE for m in P.WHITE.finditer(text, a, b) if m.end() < min(b, len(text))}
    at = sorted(table)
    return P.cut_offsets(len(text), P.array("i", at), P.array("b", [table[e] for e in at]), most, overlap)


def scanned(raw, size, halo):
    read = lambda a, b: raw[a:b]
    return [P.scan_range(read, len(raw), k, size, 1, halo)[1:] for k in range(-(-len(raw) // size))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab1", min_size=1, max_size=200), st.sampled_from([" " * 90, "\n" * 70, ". ", "。", "?! ", ", ", "3.5", "”", " \xa0", "é", "語", "😀", "\t" * 300])), max_size=40).map("".join), st.integers(8, 200), st.integers(1, 8))
def test_ranges_with_long_runs(text, size, halo):
    ranges = scanned(text.encode(), size, halo)
    n, at, kind, widest = P.stitched(ranges)
    assert n == len(text) and widest == max(map(len, re.split(rf"[\s{re.escape(P.BREAKS)}]", text)))
    for most, overlap in ((20, 5), (60, 0), (150, 40)):
        if n > most:
            assert P.cut_offsets(n, at, kind, most, overlap) == whole(text, most, overlap)


def test_files(spark, tmp_path):
    text = "One day. Then, " + "word " * 300 + " " * 500 + "\n\n語" * 200 + "x" * 700 + ". End"
    (tmp_path / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("")
    files = spark.createDataFrame([(f"file://{tmp_path}/a.txt", len(text.encode())), (f"file://{tmp_path}/b.txt", 0)], "path string, length long")
    limits = spark.createDataFrame([("m", 120, 30)], "model_name string, max_chars int, overlap_chars int")
    rows = P.read_pieces(P.split_files(files, limits, size=100, halo=8)).orderBy("piece_no").collect()
    starts, ends = whole(text, 120, 30)
    assert [(r.start_pos, r.end_pos) for r in rows] == list(zip(starts, ends))
    assert [r.text for r in rows] == [text[a:b] for a, b in zip(starts, ends)] and {r.cut for r in rows} == {"forced"}


def test_widest_stretch():
    for text in ("", "abc", "a b", "aaaa.bbbbbb", ".....", "aaaaaa bb cccccccc"):
        want = max(map(len, re.split(rf"[\s{re.escape(P.BREAKS)}]", text)))
        first, last, inner = P.widest_stretch(text, 1)
        got = max(inner, first, len(text) - 1 - last) if text else 0
        assert got == want, text
