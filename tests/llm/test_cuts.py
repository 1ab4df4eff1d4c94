import random

import pytest
from pyspark.sql import Row

from foliant.llm import cuts as C

WORDS = "the keeper of a small lamp walked slowly along an old stone wall while rain fell over every quiet harbour town".split()


def sentence(rng):
    return rng.choice(["Mr. Hill", "The keeper", "No one", "Dr. Moss"]) + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 12))) + "."


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for i in range(900):
        text = "\n\n".join(" ".join(sentence(rng) for _ in range(rng.randint(2, 5))) for _ in range(3))
        cut = i % 6 == 0
        if cut:
            at = rng.randint(len(text) // 2, len(text) - 3)
            while not text[at - 1].isalpha():
                at -= 1
            text = text[:at] + rng.choice(["", "…", " …", " [...]"])
        rows.append(Row(doc_id=i, text=text, lang=rng.choice(["en", "EN", None]), source=f"s{i % 3}", doc_kind="chapter"))
        truth[i] = cut
    more = ["- One\n- The keeper\n- The harbour", "Some words here.\n\n— Moss", "Some words here.\n\nThe End", "Here it ends. 🎧", None, "", " \n", "Then Mr.", "word " * 60_000 + "end.", "a walk,"]
    for k, text in enumerate(more, 10_000):
        rows.append(Row(doc_id=k, text=text, lang="en", source="x", doc_kind="letter" if text and "\n\n" in text else "chapter"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc_kind string")
    return {r.id: r.cut for r in C.cut_texts(df).collect()}, truth


def test_held_out_accuracy(judged):
    got, truth = judged
    assert sum(got[i] == c for i, c in truth.items()) >= 0.98 * len(truth)


def test_endings_on_purpose(judged):
    got, _ = judged
    assert [got.get(10_000 + k) for k in range(7)] == [False, False, False, False, None, None, None]
    assert got[10_007] and not got[10_008] and got[10_009]


def test_empty_table(spark):
    assert C.cut_texts(spark.createDataFrame([], "doc_id long, text string, lang string, source string, doc_kind string")).count() == 0


def test_lists_without_case(spark):
    rng = random.Random(3)
    schema = "doc_id long, text string, lang string, source string, doc_kind string"
    item = {"zh": lambda: f"第{rng.randint(1, 9)}章　灯塔", "en": lambda: f"Chapter {rng.randint(10, 60)} of 60"}
    cut = {"zh": lambda: f"第{rng.randint(1, 9)}章　灯", "en": lambda: f"Chapter {rng.randint(10, 60)} of 6"}
    rows = [Row(doc_id=i, text="\n".join(f"- {item[lang]()}" for _ in range(6)) + "\n- " + (cut if i % 10 == 0 else item)[lang](), lang=lang, source="s", doc_kind="show_notes") for i in range(600) for lang in [["zh", "en"][i % 4 // 2]]]
    got = {r.id: r.cut for r in C.cut_texts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: i % 10 == 0 for i in range(600)}


def test_odds_are_those_of_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(C, "BITS", (3, 3))  # a bitmap too small to keep much back changes nothing
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(["So it was said (", "So it is said ("]) + rng.choice(["a", "b"]) + rng.choice([") there.", ") here.\n\n", ")"]) for _ in range(90)) for _ in range(12)]
    df = spark.createDataFrame([(i, t, "en", "s", "verse") for i, t in enumerate(texts)], "id long, text string, lang string, source string, kind string")
    got = {(r.id, r.inner): r for r in C.with_odds(C.ends_of(df), df, "text").collect()}
    places = [(t, k) for t in texts for k in range(len(t) - 1)]
    behind = lambda c: c in C.TERMINATORS + C.CLOSERS + ";"
    for i, text in enumerate(texts):
        body = C.ending(text, "verse")[1]
        own = [(t, k) for t, k in places if behind(t[k]) == behind(body[-1])]
        rate = sum(t[k + 1] == "\n" for t, k in own) / len(own)
        orders = C.ORDERS[behind(body[-1])]
        seen = [[(t, k) for t, k in own if t[max(0, k - n + 1) : k + 1] == body[-n:]] for n in orders]
        best = next((x for x in reversed(seen) if len(x) >= C.SEEN), None)
        p = (sum(t[k + 1] == "\n" for t, k in best) + C.WEIGHT * rate) / (len(best) + C.WEIGHT) if best else rate
        p = min(max(p, 1e-7), 1 - 1e-7)
        assert abs(got[i, False].line - C.math.log(p / (1 - p))) < 1e-4
    assert C.ORDERS[1][-1] == 10


def test_open_paragraph_that_ends_on_purpose(spark):
    rng = random.Random(4)
    schema, rows = "doc_id long, text string, lang string, source string, doc_kind string", []
    for i in range(400):
        end = "He kept a careful note of all of it and it is filed under Lamp"
        text = "\n".join(sentence(rng) for _ in range(5)) + "\n\nfiled under Lamp\n" + (end[:-7] if i % 10 == 0 else end)
        rows.append(Row(doc_id=i, text=text, lang="en", source="s", doc_kind="chapter"))
    got = {r.id: r.cut for r in C.cut_texts(spark.createDataFrame(rows, schema)).collect()}
    assert C.ending(rows[1].text, "chapter")[0] == "open" and got == {i: i % 10 == 0 for i in range(400)}


def test_a_comma_is_judged_by_its_odds(spark):
    rng = random.Random(9)
    schema, rows = "doc_id long, text string, lang string, source string, doc_kind string", []
    for i in range(300):  # address lines end with a comma as a rule, sentences don't
        text = "\n".join(sentence(rng) for _ in range(6)) + "\n\n" + "\n".join(["Dear Sir or Madam,", sentence(rng), "Yours most sincerely,"])
        rows.append(Row(doc_id=i, text=text if i % 10 else text.replace("Yours most sincerely,", sentence(rng)[:12] + " and then,"), lang="en", source="s", doc_kind="letter"))
    got = {r.id: r.cut for r in C.cut_texts(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[i] for i in got if i % 10 == 0)
