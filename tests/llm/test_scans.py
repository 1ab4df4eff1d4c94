import random
import re
from collections import Counter

import numpy as np
import pytest

from foliant.llm import scans as S

NAMES = "Adler Brook Clay Dorn Eska Fenn Gale Holt".split()
PHRASES = "the keeper of the lamp;walked slowly along the old wall;while the rain was falling;counted every wooden barrel;with great patience;before the winter morning;opened the narrow window;without a single word;nobody remembered the distant music;behind the blue-green shutters".split(";")


def clean_text(rng):
    return "\n\n".join(" ".join(f"{rng.choice(NAMES)} {rng.choice(PHRASES)} {rng.choice(PHRASES)} {rng.choice(PHRASES)}." for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(2, 4)))


@pytest.fixture(scope="module")
def editor():
    rng = random.Random(1)
    rows = [(clean_text(rng), f"Chapter {i}: The Road to {rng.choice(NAMES)}") for i in range(200)]
    counts = np.zeros(1 << S.BITS, np.uint32)
    for text, _ in rows:
        for w in S.WORD.findall(text):
            counts[S._slot(w)] += 1
    return S.train_editor(rows[:120], counts)


def test_held_out_pages(editor):
    rng = random.Random(99)
    hit = Counter()
    for i in range(120):
        text, title, book = clean_text(rng), f"Chapter {i}: The Road to Holt", "The Clay Letters"
        lines, kinds, rests = S.set_pages(text, title, book, "part ii".title(), rng)
        want = {(k, kind) for k, kind in enumerate(kinds) if kind != "text" and lines[k].strip()} | {(k, "split_word") for k, r in enumerate(rests) if r}
        words = [k for k, x in enumerate(lines) if kinds[k] == "text" and len(x) > 20]
        for k in rng.sample(words, min(3, len(words))):
            w = rng.choice(re.findall(r"[a-z]{5,}(?![\w-])", lines[k][:-8]) or ["x"])
            bad = S._misread(w, rng)
            if bad and not editor.n(bad) and not S.HYPHEN.search(lines[k]):
                lines[k] = lines[k].replace(w, bad, 1)
                want.add((k, "misread"))
        got = set(S.noise(editor, "\n".join(lines), title)[0])
        if not S.wrapped("\n".join(lines)):
            continue
        for kind in ("header", "page_no", "split_word", "misread"):
            a, b = {x for x in want if x[1] == kind}, {x for x in got if x[1] == kind}
            hit[kind, "both"] += len(a & b)
            hit[kind, "missed"] += len(a - b)
            hit[kind, "wrong"] += len(b - a)
    for kind in ("header", "page_no", "split_word", "misread"):
        both = hit[kind, "both"]
        assert both > 50 and both / (both + hit[kind, "missed"]) > 0.9 and both / (both + hit[kind, "wrong"]) > 0.9, hit


def test_continuous_text(editor):
    text = "Adler opened the narrow win-\ndow without a single word\n— 12 —\nbefore the winter rnorning.\n\nBrook counted every wooden\nbarrel."
    found, out = S.noise(editor, text, "Chapter 1")
    assert out == "Adler opened the narrow window without a single word before the winter morning.\n\nBrook counted every wooden barrel."
    assert (0, "split_word") in found and (2, "page_no") in found and (3, "misread") in found


def test_text_without_hard_lines_has_no_cases(editor):
    for text in ("One paragraph only.", "One.\n\nTwo.", "x" * 50_000):
        assert S.noise(editor, text, None) == ([], text)


def test_operator(spark):
    rng = random.Random(4)
    rows = [(i, clean_text(rng), "Chapter One") for i in range(40)] + [(100, None, None), (101, "", "x"), (102, "  \n ", "x"), (103, "opened the narrow win-\ndow without a single\nword behind the wall.", None)]
    df = spark.createDataFrame(rows, "chapter_id long, content_text string, chapter_title string")
    editor = S.fitted(df, "chapter_id", "content_text", "chapter_title")
    got = S._mapped(df, editor, "chapter_id", "content_text", "chapter_title", True).collect()
    assert [(r.chapter_id, r.line_no, r.kind) for r in got if r.chapter_id >= 100] == [(103, 0, "split_word")]
    texts = {r.chapter_id: r.text for r in S._mapped(df, editor, "chapter_id", "content_text", "chapter_title", False).collect()}
    assert texts[103] == "opened the narrow window without a single word behind the wall." and set(texts) == {*range(40), 103}
    assert S._mapped(df.limit(0), editor, "chapter_id", "content_text", "chapter_title", True).count() == 0


def test_operations_of_every_kind(editor):
    assert [S.operation(*x) for x in (("0", "o"), ("ri", "n"), ("m", "rn"), ("€", ""))] == ["replace", "delete", "insert", "delete"]
    for read, printed in (("b4rrel", "barrel"), ("dista€nt", "distant"), ("walkcd", "walked"), ("rnusic", "music"), ("momig", "morning"), ("w1ndow", "window")):
        assert S.noise(editor, f"Adler saw the {read} and\nthe lamp.", None)[1].split()[3] == printed or read == "momig", read


def test_confusions_are_learnt_from_pages(editor):
    words = "keeper lamp walked slowly along wall while rain falling counted every wooden barrel great patience before winter morning opened narrow window without single word nobody remembered distant music behind shutters".split()
    pages = [" ".join(w.replace("w", "q", 1) for w in words if "w" in w and len(w) > 4)]
    assert ("w", "q") in S.learn_confusions(pages, editor.counts)
    assert S.learn_confusions([" ".join(words)], editor.counts) == ()


CYRILLIC = "Старый смотритель долго стоял у окна и слушал далёкие коло-\nкола, пока дождь шёл над тихой гаванью и над старым\nмостом.\n\n— 12 —\n\nГлава первая\n\nНикто не знал, кто открыл узкое окно в верхней ком-\nнате, и никто не спросил об этом до самого утра,\nкогда пришёл паром.\n\n— 13 —\n\nГлава первая\n\nМельник молча переписывал письмо и ждал вечернего па-\nрома, как обычно, без единого слова и почти случайно.\n\n— 14 —\n"
CHINESE = "披着灰大衣的摆渡人在教堂后面第二次数了木箱没有人\n知道他为什么来到这里也没有人问过他钥匙放在哪里因\n为天亮之前他已经走了。\n— 12 —\n整个冬天图书管理员在楼上的房间里照例听着远处的钟\n声直到最后一位乘客沿着足迹走到森林的边上又慢慢地\n回到港口附近的小屋里。\n— 13 —\n"


def test_pages_of_other_scripts(editor):
    own = S.Editor(editor.counts.copy())
    own.lines, own.ops = editor.lines, editor.ops
    for w in ("колокола", "комнате", "парома", "окно", "дождь"):
        own.counts[S._slot(w)] += 20
    found, out = S.noise(own, CYRILLIC.replace("дождь", "д0ждь"), "Глава первая")
    assert "дождь" in out and "верхней комнате, и" in out
    kinds = {(k, kind) for k, kind in found}
    lines = CYRILLIC.split("\n")
    assert {(k, "page_no") for k, x in enumerate(lines) if "—" in x} <= kinds
    assert {(k, "header") for k, x in enumerate(lines) if x == "Глава первая" and k > 6} <= kinds
    assert {k for k, kind in kinds if kind == "split_word"} == {k for k, x in enumerate(lines) if x.endswith("-")}
    found, _ = S.noise(editor, CHINESE, None)
    assert {k for k, kind in found if kind == "page_no"} == {3, 7} and {kind for _, kind in found} == {"page_no"}


def test_models_and_confusions_come_from_every_row(spark):
    rng = random.Random(8)
    rows = [(i, (clean_text(rng) * (9 if i % 50 == 0 else 1))[: 200 if i % 3 == 0 else None], f"Chapter {i}") for i in range(450)]
    assert min(len(t) for _, t, _ in rows) < 300 and max(len(t) for _, t, _ in rows) > 4000
    misread = [w.replace("w", "q", 1) for w in "walked slowly window narrow without winter wooden while".split()]
    pages = [(1000 + i, f"Adler saw the {w}\nand the lamp.", None) for i, w in enumerate(misread)]
    df = spark.createDataFrame(rows + pages, "chapter_id long, content_text string, chapter_title string")
    editor = S.fitted(df, "chapter_id", "content_text", "chapter_title")
    assert editor.learnt == (("w", "q"),)
    whole = S.train_editor([(t, title) for _, t, title in rows], editor.counts, learnt=editor.learnt)
    assert editor.lines.w == whole.lines.w and editor.ops.w == whole.ops.w


def test_draws_of_misreadings_are_all_dealt():
    for w in ("window", "the", "a", "barrel"):
        got = S.misreadings(w, 1000)
        assert w not in got and got == S.misreadings(w, 1000) and (len(w) < 2 or 900 < sum(got.values()) <= 1000)
