"""Sentence units on hand-marked texts (| ends a unit) and the operator's defined cases."""

import pytest
from hypothesis import given, settings, strategies as st

from foliant.llm import dictionary as D
from foliant.llm.sentences import Gaps, sentence_units, unit_ends

GAPS = Gaps()

MARKED = [
    "Mr. Smith paid 3.50 crowns to Mrs. Jones at 7.30 p.m. and left.| Nobody knew.|",
    "“Where is the key?” asked Tom.| “No. No. No,” whispered the man.| “Dr. Lee is late.”| The tide rose.|",
    "J. Smith and R. T. Brown came.| He signed with the letters A. B.| The office of C.B.R. opened.|",
    "She paused... then left.| Really?!| See fig. 3 on p. 34, cf. vol. 5, no. 19 of the ledger.|",
    "The boxes held rope, ink, etc.| The lamp went out.| The file a_01.mp3 was louder than version 1.2.3 ... or so it seemed.|",
    "The weekly ‘Why Not?’ sold 9 copies.| He came (or did she?) at noon.| (The lamp was still warm.)| They left.|",
    "Am 24. Mai kam Dr. Roth.| Der 11. Wagen blieb stehen.| „Niemals!“, rief er.| Es fehlten z. B. Seil, Tinte usw.| Wer kam?|",
    "El Sr. Paz vivía en la c. Mayor, núm. 3.| —¿Quién llama? —preguntó Luz.| ¿Quién?, pensó ella.| «¡Nunca!», gritó.|",
    "Il mesurait 7,5 m, p. ex., soit env. 15 pieds.| « Où est la clé ? » demanda Luc.| S. A. R. Luc logea bd. du Port, chap. 47.|",
    "В 1923 г. он купил 2 кг муки, т. е. 21 мешок и т. д.| А. С. Попов и др. жили на ул. Садовой, д. 27, кв. 2.| — Кто там? — крикнул он.| «Хорошо. Очень хорошо», — ответил он.|",
    "Γιατί έφυγε ο φύλακας;| Ο κ. Παύλος έγραψε π.χ. 25 σελίδες.| «Ποιος είναι;» ρώτησε ο ξένος.|",
    "دفع د. سامر 3.5 كرونة ثم خرج.| «من هناك؟» سأل صانع الساعات.| أين المفتاح؟|",
    "पं. राम 3.5 बजे आए।| “कौन है?” नाविक ने पूछा।| क्या वह आया?|",
    "没有人知道。|“走吧！”船夫喊道。|船夫问：“钥匙在哪里？”|他沉默了……然后走了。|第3页写着“为什么？”三个字。|《为什么？》卖了3本。|（灯还热。）|A. 王先生来了。|",
    "王先生说得对……|老人点了点头。|他走了…|小船漂远了。|他走了…|他没回来。|我……我不知道。|这是他的……书。|",
    "彼は……何も言わなかった。|雨が降った…|船は出た。|「行こう！」とても寒かった。|",
    "誰が直した？|「行こう！」船頭は叫んだ。|「鍵はどこですか。」と彼は言った。|劇団「夜。」の公演は3回続いた。|『手紙』を読んだ。|",
    "คนแจวเรือนับลังไม้|  ดร.สมิทธ์เดินไป3.26กิโลเมตร|",
    "„Dr. Roth ist da.“| „Wo ist der Schlüssel?“, fragte er.| „Die Flut kommt.“| Das Blatt „Warum nicht?“ erschien.|",
    "« La marée est en retard. »| Pourquoi vint-il ?| (Or did he?)| «La Dra. Luz ha llegado.»| ¿Por qué?|",
    "Heading|\n\nFirst line.| Second|\nThird.|",
    "Fim.|O dia veio.|",
]


def split(marked):
    text, ends = "", []
    for c in marked:
        if c == "|":
            ends.append(len(text))
        else:
            text += c
    return text, ends


@pytest.mark.parametrize("marked", MARKED)
def test_marked(marked):
    text, ends = split(marked)
    got = unit_ends(text, GAPS)
    assert got == ends, [text[a:b] for a, b in zip([0, *got], got)]


def test_invisible_and_wide_characters_count_as_stored():
    text = "Ｏｎｅ​ tw­o. Ｔhree."
    assert unit_ends(text, GAPS) == [text.index(".") + 1, len(text)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aA .!?\n“”‘’«»()—1。！」「者とx", max_size=80))
def test_units_cover_all_text(text):
    ends = unit_ends(text, GAPS)
    assert ends == sorted(set(ends))
    assert "".join(text[a:b] for a, b in zip([0, *ends], ends)).strip() == text.strip() or not text.strip()
    assert all(not text[e - 1].isspace() for e in ends)


def test_operator_cases(spark):
    rows = [(1, None, 7), (2, "", 7), (3, " \n ", 7), (4, "One. Two.", 7), (4, "One. Two.", 7), (5, "word " * 50_000 + "end.", 7)]
    df = spark.createDataFrame(rows, "chapter_id long, content_text string, end_pos int")
    got = sorted((r.id, r.end_pos) for r in sentence_units(df, "chapter_id", "content_text").collect())
    assert got == [(4, 4), (4, 4), (4, 9), (4, 9), (5, 250_004)]
    assert sentence_units(df.limit(0), "chapter_id", "content_text").count() == 0


def test_dictionary_against_brute_force(spark):
    texts = ["我知道路。他知道！", "天知道吗", None, "", "latin only", "路很长，道路通天", "知道了"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    runs = [r for t in texts if t for r in D.RUN.findall(t)]
    want = {}
    for r in runs:
        for size in range(1, D.LONGEST + 2):
            for i in range(len(r) - size + 1):
                want[r[i : i + size]] = want.get(r[i : i + size], 0) + 1
    got = {r.gram: r.n for r in D.count_grams(df.repartition(3), "text").collect()}
    assert got.pop("") == sum(map(len, runs)) and got == want
    words = D.count_words(df, "text")
    assert "知道" in words and "知" in words and "道路" not in words and "我知" not in words
    assert D.Lattice(words).words("我知道路") == ("我", "知道", "路")
    assert D.count_words(df.limit(0), "text") == {"": 2.0} and D.Lattice({}).words("一二") == ("一", "二")


def test_a_verb_inside_a_word_reports_nothing():
    gaps = Gaps({"知道": 6.0, "道": 7.0, "知": 7.0, "": 12.0})
    assert unit_ends("“走吧！”没人知道。“走吧！”老人说道。", gaps) == [5, 10, 20]


def test_names_with_a_mark_are_learnt(spark):
    rows = [("She sang on Hallo! Radio and in Paris.",)] * 4 + [("He came to Paris! Then he left Paris and went home.",)] * 4
    df = spark.createDataFrame(rows, "text string").selectExpr("monotonically_increasing_id() AS id", "text")
    ends = {r.end_pos for r in sentence_units(df, "id", "text").collect()}
    assert 16 not in ends and 18 not in ends and {17, 38} <= ends
