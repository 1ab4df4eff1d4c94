import random
from collections import Counter

import pytest

from foliant.llm.encodings import Repair, repaired_fields, search

TEXTS = ["Le phare de la forêt était fermé, déjà.", "„Niemals!“, rief der Müller über die Brücke.", "El corazón de la estación, mañana.", "Усталый архивариус перевёл стёртую надпись очень медленно.", "没有人知道图书管理员打开了窄窗。", "灯台守は壊れたランプを直した。", "“Where is the key?” asked the keeper’s boy."]
PATHS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp866", "cp1251"), ("gbk", "latin-1"), ("euc_jp", "latin-1")]


@pytest.mark.parametrize("text", TEXTS)
def test_plain_text_stays(text):
    assert Repair().field(text) == (text, False)


def test_dirt_is_no_damage():
    for text in ("Thе mаstеr оf the hоuѕe", "Ｃａｆé on the ｒｏａｄ", "a b​c à la fin", "SÃO JOÃO, dizia a placa, E NÃO", "the low¬\ner road, übersetz†e", "Why?Because he knew", None, ""):
        assert not Repair().field(text)[1], text


def garbled():
    for text in TEXTS:
        for w, r in PATHS:
            if w in ("gbk", "euc_jp") and text[0] < "一":
                continue  # charsets of the East Asian texts
            try:
                yield pytest.param(text, text.encode(w).decode(r), id=f"{text[:8]}-{w}-{r}")
            except UnicodeError:
                continue


@pytest.mark.parametrize(("text", "bad"), list(garbled()))
def test_found(text, bad):
    if bad != text:
        assert Repair().field(bad)[1]


@pytest.mark.parametrize("text", TEXTS)
def test_restored(text):
    for r in ("latin-1", "mac_roman"):
        assert Repair().field(text.encode().decode(r))[0] == text
    twice = text.encode().decode("latin-1").encode().decode("latin-1")
    assert Repair().field(twice)[0] == text


def test_lost_characters():
    for bad in ("Der Schl?ssel f?r Rom", "La for�t", "?pilogue", "N?chte in Rom"):
        assert Repair().field(bad)[1], bad


def test_part_of_a_text():
    text = "Все спали. Младший брат шёл домой. Было тихо."
    bad = text.replace("Младший брат шёл домой.", "Младший брат шёл домой.".encode("koi8_r").decode("cp1251"))
    fixed, damaged = Repair().field(bad)
    assert damaged and fixed == text


def test_operator(spark):
    df = spark.createDataFrame([(1, "dÃ©jÃ\xa0 vu", None), (2, None, "Caf� noir"), (3, "plain", ""), (3, "plain", "")], "chapter_id long, content_text string, chapter_title string")
    got = sorted((r.chapter_id, r.field, r.restored) for r in repaired_fields(df, "chapter_id", ["content_text", "chapter_title"]).collect())
    assert [g[:2] for g in got] == [(1, "content_text"), (2, "chapter_title")] and got[0][2] == "déjà vu"
    assert repaired_fields(df.limit(0), "chapter_id", ["content_text", "chapter_title"]).count() == 0


def test_the_same_text_gets_the_same_answer_again():
    text = "没有人知道他在桥下。一句话也没说，他数着木箱；钟表匠烧掉了文件".replace("一句话也没说，他数着木箱；钟表匠", "一句话也没说，他数着木箱；钟表匠".encode().decode("latin-1"))
    repair = Repair()
    first = repair.field(text)
    assert first[1] and all(repair.field(text) == first for _ in range(3))


def test_ends_are_carried_back():
    text = "„Niemals!“, rief der Müller. Dann ging er über die Brücke."
    bad = text.encode().decode("latin-1")
    restored, ends = Repair().aligned(bad)
    assert restored == text and len(ends) == len(text) and ends[-1] == len(bad)
    assert [bad[:e].encode("latin-1").decode() for e in ends] == [text[: i + 1] for i in range(len(text))]


@pytest.mark.parametrize("text", ["Zażółć gęślą jaźń", "Český král", "Příliš žluťoučký kůň", "Ağır yük", "Γιατί έφυγε ο φύλακας;", "Почему он уехал?"])
def test_other_languages_come_out_right(text):
    assert Repair().field(text.encode().decode("latin-1")) == (text, True)


def test_undamaged_stretches_stay_as_stored():
    bad = "Thе old mаn left.\nLe phare Ã©tait fermÃ©."
    assert Repair().field(bad) == ("Thе old mаn left.\nLe phare était fermé.", True)


def test_a_damaged_part_of_a_long_text_is_seen():
    clean = "没有人知道图书管理员为什么打开了窄窗。" * 200
    part = "他照例听着远处的钟声".encode().decode("gbk", "ignore") + "。"
    assert Repair().field(clean + part + clean)[1] and not Repair().field(clean)[1]


def test_bounds_of_the_search():
    x = search("Ã©tÃ©", budget=0)
    assert x.text == "Ã©tÃ©" and x.bounded
    assert search("Ã©tÃ©", depth=None, budget=None).text == "été"
    repair = Repair(budget=0)
    assert repair.field("Ã©tÃ©") == ("Ã©tÃ©", False) and repair.bounded


def test_held_out_restoring(spark, sf):
    """Clean fields of the smallest tables, wrongly decoded in several ways: how many come back exactly, by way."""
    rng = random.Random(6)
    rows = spark.read.parquet(f"{sf}/chapters.parquet").select("chapter_id", "content_text").collect()
    texts = [r.content_text for r in sorted(rows) if r.content_text and not r.content_text.isascii() and not Repair().field(r.content_text)[1]]
    ways = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("cp1251", "latin-1"), ("koi8_r", "cp1251"), ("cp1253", "latin-1"), ("gbk", "latin-1")]
    hit, tried = Counter(), Counter()
    for w, r in ways:
        for text in rng.sample(texts, min(60, len(texts))):
            line = max(text.split("\n"), key=len)
            try:
                bad = line.encode(w).decode(r)
            except UnicodeError:
                continue
            if bad != line and (w == "utf-8" or sum(ord(c) > 0x2AF for c in line) * 3 > len(line)):
                tried[w, r] += 1
                hit[w, r] += Repair().field(bad)[0] == line
    assert sum(tried.values()) > 100 and sum(hit.values()) / sum(tried.values()) > 0.95, (hit, tried)
