"""Folds and cleaners against plain Python models."""

import random
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from foliant.functions import markup as M, text as X
from foliant.operators import chapters as C, prefix, queues as Q, sequences as S, timeline as L
from foliant.operators.similarity import top_similar

TEXTS = [None, "", "   ", "One. Two! Three? Four", "A " * 400, "x" * 2500, "Dr. Who left. He (or she (maybe)) ran, and ran; and ran. . . . Then J. R. came.", "Wait... now.  Next\nline. 一。二"]


def packed(text, most):
    parts = [s for s in (p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip())) if s]
    out, cur, n = [], [], 0
    for s in parts:
        if cur and n + len(s) + 1 > most:
            out.append(" ".join(cur))
            cur, n = [s], len(s)
        else:
            cur.append(s)
            n += len(s) + 1
    if cur:
        out.append(" ".join(cur))
    return [c[i : i + most] for c in out for i in range(0, len(c), most)] if out else []


def test_pack_sentences(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS) if t is not None], "i int, t string").select("t", X.pack_sentences(F.col("t"), 30).alias("p")).collect()
    for r in rows:
        assert r.p == packed(r.t, 30), r.t


def test_pack_lines(spark):
    words = "the quick brown fox jumps over the lazy dog incomprehensibilities of it all".split()
    got = spark.createDataFrame([(words,), ([],)], "w array<string>").select(X.pack_lines(F.col("w"), 20).alias("l")).collect()
    assert [w for line in got[0].l for w in line] == words
    assert all(sum(len(w) + 1 for w in line) <= 20 or len(line) == 1 for line in got[0].l)
    assert got[1].l == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc ,;.!?()A\n", max_size=200), st.integers(1, 40))
def test_chunks_hold_all_words(text, size):
    flat = text
    while (x := re.sub(r"\([^()]*\)", "", flat)) != flat:
        flat = x
    flat = re.sub(r"\.\s*(?:\.\s*)+", ".", flat).strip()
    got = M.chunk(text, size)
    if M.split_rule_sentences(text):
        assert "".join("".join(got).split()) == "".join(flat.split())
    else:
        assert "".join(got) == text


def test_chunk_bounds():
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    assert all(len(c) <= 200 for c in M.chunk(text, 100))
    assert M.chunk(None, 10) == [] and M.chunk("", 10) == []
    assert M.chunk("(all in brackets here)", 5) == ["(all ", "in br", "acket", "s her", "e)"]


def test_split_at_delimiter(spark):
    rows = [("aaaa, bbbb, cc",), ("no marks at all",), ("a;b",), (",,",), ("",), (None,)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").select(X.split_at_delimiter(F.col("t"), 4).alias("p")).collect()]
    assert got == [["aaaa,", "bbbb, cc"], ["no marks at all"], ["a;b"], [",,"], [], None]


def test_strip_html():
    assert M.strip_html_text("<h1>Title</h1><p>One <b>two</b> (gone)</p><p>Three!</p>") == "Title. One two . Three!"
    assert M.strip_html_text('<div class="ad x"><p>no</p></div><p>yes', frozenset({"ad"})) == "yes"
    assert M.strip_html_text("<style>a{}</style>x") == "a{}x" and M.strip_html_text("<style>a{}</style>x", drop_script=True) == "x"
    assert M.strip_html_text(None) is None and M.strip_html_text("") == ""


def test_slice_by_anchor():
    doc = '<p id="a">one</p><p id="b">two</p><p id="c">three</p>'
    assert M.slice_by_anchor_text(doc, "b", "c") == '<p id="b">two</p>'
    assert M.slice_by_anchor_text(doc, "b", "zz") == '<p id="b">two</p>'
    assert M.slice_by_anchor_text(doc, "zz", "c") == doc and M.slice_by_anchor_text(doc, None, None) == doc
    assert M.slice_by_anchor_text(doc, "c", None) == '<p id="c">three</p>'


def test_roman():
    assert M.roman_sentence("Louis XIV. and I saw IIX but IX.") == "Louis 14. and I saw IIX but 9."
    assert M.VALUES["XXXIX"] == 39 and len(M.VALUES) == 39


def test_running_sum_over_buckets(spark):
    rows = [(i % 3, i // 7, i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, b int, i int, v int")
    got = {(r.k, r.i): r.s for r in prefix.running_sum(df, ["k"], F.col("b"), ["i"], F.col("v"), "s").collect()}
    total = {}
    for k, _, i, v in rows:
        total[k] = total.get(k, 0) + v
        assert got[k, i] == total[k]


def test_queue_edits(spark):
    q = spark.createDataFrame([("u", i, f"p{i}", i) for i in range(1, 5)], "user_id string, idx long, pod_id string, episode_idx int")
    twice = Q.swap_at(Q.swap_at(q, 2), 2)
    assert sorted(twice.collect()) == sorted(q.collect())
    assert sorted(r.idx for r in Q.delete_at(q, F.lit(2)).collect()) == [1, 2, 3]
    assert Q.swap_at(q, 4).orderBy("idx").first().pod_id == "p1"


def test_segment_groups(spark):
    rows = [(1, i, f"w{i}", float(a), float(b)) for i, (a, b) in enumerate([(0, 4), (4, 8), (8, 12), (12, 40), (40, 40.2), (41, 50)])]
    df = spark.createDataFrame(rows, "id long, pos int, word string, start double, end double")
    got = [(r.start, r.end, r.text) for r in L.segment_groups(df).orderBy("utterance").collect()]
    assert got == [(0.0, 8.0, "w0 w1"), (8.0, 12.0, "w2"), (40.0, 50.0, "w4 w5")]


def test_best_candidates(spark):
    rows = [(1, 1, 0, 0.5), (1, 2, 0, 0.09), (1, 2, 1, 0.01), (2, 1, 0, 0.9), (2, 3, 0, 0.4), (3, 6, 0, 0.0)]
    got = {r.chunk_idx: (r.attempt, r.copy, r.accepted) for r in L.best_candidates(spark.createDataFrame(rows, "chunk_idx int, attempt int, copy int, silence double")).collect()}
    assert got == {1: (2, 0, True), 2: (3, 0, False)}


def test_similarity_is_exact(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 4)).astype("float32")
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None), (98, [0.0] * 4)], "vec_id long, embedding array<float>")
    got = top_similar(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", 3).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 60, 10):
        s = unit @ unit[q]
        want = [int(i) for i in np.argsort(-s, kind="stable") if i != q][:3]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: -r.score)] == want


def test_parens_of_any_depth(spark):
    texts = ["a" + "(b" * n + ")" * n + "c" for n in (1, 8, 9, 40)] + ["((((((((((x)))))))))) (y", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in df.select(X.strip_parens_deep(F.col("t")).alias("x")).collect()] == ["ac"] * 4 + [" (y", "", None]


def test_ignored_blocks_part_words_and_void_tags_close_nothing():
    ads = frozenset(["Ad"])
    assert M.strip_html_text('One<div class="ad">x</div>Two', ads) == "One. Two"
    assert M.strip_html_text('One<div class="x AD">x<br>y<p>z</div> Two <b>three</b>', ads) == "One. Two three"
    assert M.strip_html_text("<style>a</style>One", drop_script=True) == "One"


def test_anchors_in_any_case():
    doc = '<p ID="a">one</p><p Id="b">two</p>'
    assert M.slice_by_anchor_text(doc, "A", "B") == '<p ID="a">one</p>' and M.slice_by_anchor_text(doc, "c", None) == doc


def test_roman_numerals_keep_brackets():
    assert M.roman_text("Louis XIV (king) rules. And I am X.") == "Louis 14 (king) rules. And I am 10. "
    assert M.roman_text("   ") == "   " and M.roman_text(None) is None
    assert len(M.VALUES) == 39 and M.VALUES["XXXIX"] == 39 and M.VALUES["XIV"] == 14


def test_rule_checks_and_removed_texts(spark):
    df = spark.createDataFrame([("a (b) c9 d10",), ("",), (None,)], "x string")
    rows = C.with_rules(df, "x", [r"\(b\)", "(unclosed", r"([a-z])\d+", r"(x)(y)"]).collect()
    assert [(r.x, r.removed) for r in rows] == [("a   ", ["(b)", "c", "d"]), ("", []), (None, None)]
    got = C.checked_rules(spark.createDataFrame([(1, "(a"), (2, "a")], "rule_no int, rule string")).collect()
    assert [r.valid for r in got] == [False, True] and "(a" in got[0].error and got[1].error is None


def test_segments_group_by_the_sum_of_their_lengths(spark):
    rows = [(1, 0, 0.0, 4.0, "a"), (1, 1, 10.0, 14.0, " b "), (1, 2, 20.0, 21.0, "c"), (2, 0, None, 2.0, "x"), (2, 1, 5.0, 5.0, "no"), (2, 2, 6.0, 30.0, "long"), (2, 3, 31.0, 31.5, "short")]
    df = spark.createDataFrame(rows, "id long, pos int, start double, end double, word string")
    got = sorted((r.id, r.utterance, r.start, r.end, r.text) for r in L.segment_groups(df).collect())
    assert got == [(1, 0, 0.0, 21.0, "a b c"), (2, 0, 0.0, 2.0, "x")]


def test_gaps_from_the_beginning_to_the_end(spark):
    words = spark.createDataFrame([(1, 0, 1.0, 2.0), (1, 1, 2.0005, 3.0), (1, 2, 4.0, 3.5)], "id long, pos int, start double, end double")
    totals = spark.createDataFrame([(1, 6.0), (2, 2.0), (3, 0.0)], "id long, total double")
    assert sorted(map(tuple, L.speech_gaps(words, totals).collect())) == [(1, 0.0, 1.0), (1, 3.0, 4.0), (1, 3.5, 6.0), (2, 0.0, 2.0)]


def test_first_in_first_out(spark):
    jobs = [(i, (i * 37) % 50, i % 4) for i in range(40)]
    df = spark.createDataFrame(jobs, "id int, a int, n int").withColumn("k", F.lit("x"))
    got = {r.id: (r.begins, r.ends) for r in S.fifo_service(df, ["k"], F.floor(F.col("id") / 7), ["id"], F.col("a"), F.col("n")).collect()}
    free = None
    for i, a, n in jobs:
        begins = a if free is None else max(a, free)
        free = begins + n
        assert got[i] == (begins, free)


def test_early_stopping(spark):
    for losses, want in (([3, 2, 2, 2, 1], (1, 2.0, 3)), ([3, 2, 2, 1, 1], (3, 1.0, None)), ([5], (0, 5.0, None))):
        df = spark.createDataFrame([("r", k, float(x)) for k, x in enumerate(losses)], "run string, epoch int, loss double")
        r = S.early_stopping(df, "run", "epoch", "loss", 2).first()
        assert (r.best_epoch, r.best_loss, r.stopped_at) == want


def test_split_is_whole_and_repeatable(spark):
    df = spark.range(50).withColumnRenamed("id", "i")
    a, b = (sorted(map(tuple, S.train_val_split(df.repartition(k), "i", 0.1).collect())) for k in (1, 5))
    assert a == b and sum(p == "val" for _, p in a) == 5 and len(a) == 50
    assert S.train_val_split(df.limit(0), "i", 0.1).count() == 0


def test_cache(spark):
    cache = spark.createDataFrame([("a", "old"), ("b", None)], "key string, response string")
    new = S.stored(cache, spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("c", "3", 1)], "key string, response string, seq long"))
    assert {r.key: r.response for r in new.collect()} == {"a": "2", "b": None, "c": "3"}
    got = S.cached(spark.createDataFrame([("a",), ("b",), ("z",)], "key string"), new)
    assert {r.key: r.response for r in got.collect()} == {"a": "2", "b": None, "z": None}


def test_insertions_and_flags(spark):
    log = spark.createDataFrame([(1, "u", "p", 1, 10), (1, "u", "p", 1, 10), (2, "u", "p", 1, 20), (3, "u", "q", 1, 5), (4, None, "q", 1, 5)], "log_id long, user_id string, pod_id string, episode_idx int, logged_time int")
    assert {r.log_id: r.inserted for r in Q.insertions(log).collect()} == {1: True, 2: False, 3: True}
    queue = spark.createDataFrame([("a", 1, "p", 1, True), ("a", 2, "p", 2, False), ("b", 1, "p", 1, False)], "user_id string, idx int, pod_id string, episode_idx int, is_current boolean")
    assert {(r.user_id, r.idx): r.is_current for r in Q.set_current(queue, F.lit(2)).collect()} == {("a", 1): False, ("a", 2): True, ("b", 1): True}
    before = spark.createDataFrame([("b", "p", 1), ("a", "p", 2)], "user_id string, pod_id string, episode_idx int")
    assert {r.user_id: r.idx for r in Q.current_item(queue, before).collect()} == {"a": 1, "b": 1}


def test_state_folds_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(S, "FOLDED", 3)
    rng = random.Random(2)
    rows = [(k, i, rng.choice(["go", "stop", "reset", None])) for k in "ab" for i in range(50)]
    moves = {("idle", "go"): "on", ("on", "stop"): "off", ("off", "go"): "on", ("on", "reset"): "idle", ("off", "reset"): "idle"}
    df = spark.createDataFrame(rows, "k string, i int, e string")
    got = {r.k: (r.state, r.n) for r in S.fold_states(df, "k", F.floor(F.col("i") / 7), ["i"], "e", moves, "idle").collect()}
    for k in "ab":
        state = "idle"
        for kk, _, e in rows:
            if kk == k:
                state = moves.get((state, e), state)
        assert got[k] == (state, 50)
