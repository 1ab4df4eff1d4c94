"""Sentence boundaries across languages and scripts.

Every line is cut into candidate gaps: a run of terminal marks with the closers behind it. Spaced scripts decide each
gap on a terminator lattice (mark, token before, token after). Scripts without spaces are segmented into words beside
the gap, by the cheapest path through the lattice of a dictionary counted over the corpus; final particles, linking
words and reporting verbs that end the path before the gap, and opening words behind it, decide. Marks in a matched
quotation or bracket are never gaps; the gap behind its closer decides. In Thai a space ends a unit. Stretches that were
decoded wrongly are restored first, and the ends found are carried back to the text as stored.

Null, empty and blank texts have no units. A text of any length is read whole, line by line. Repeated rows give
repeated units; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import checkpointed, map_batches, spread, table
from foliant.llm.dictionary import RUN, Lattice, count_words
from foliant.llm.encodings import TO_LATIN, Repair, plain_letters

# Abbreviations that never close a sentence, a name or number follows.
TITLES = set(
    "mr mrs ms messrs dr drs prof sgt cpl capt cmdr lt col gen maj adm rev fr hon gov pres sen rep st ste mt ft no nos vol vols fig figs p pp ch chap sec art para dept approx max min cf vs v ca viz eg ie ed eds trans al b d "
    "m mm mme mlle mgr me av bd boul t env hab "
    "cia sra srta sres dra d dña da c núm pág págs cap art exma exmo ilmo av avda aprox máx mín n.º ud "
    "fa hr fr nr str bd jg vgl s bzw ca z.b d.h u.a gest geb verh abs ziff kap "
    "см с т ул д кв стр рис гл г-н г-жа проф акад им пер пл обл р тыс т.е т.н напр "
    "κ κα δρ βλ σ σελ τ τόμ π.χ αρ κεφ "
    "पं डॉ श्री सु कु प्रो "
    "د ص ج أ م ".split()
)
# Abbreviations that may close a sentence; an opener behind them decides.
MAYBE = set(
    "etc inc ltd co corp bros jr sr esq ave blvd rd sq a.m p.m am pm ph.d u.s in lb lbs oz ft yd kg cm km hr hrs dept jan feb mar apr jun jul aug sept sep oct nov dec "
    "usw u.a o.ä ff f jh jhd mio mrd chr c.a a.c d.c cía ex p.ex tel "
    "др т.д т.п г гг в вв руб коп экз нояб дек янв февр апр авг сент окт "
    "κ.λπ κλπ κ.ά μ.χ π.μ μ.μ".split()
)
MONTHS = set("jan feb mar apr jun jul aug sept sep oct nov dec янв февр апр авг сент окт нояб дек".split())
# Nouns that a single letter or number designates, so that the letter can close the sentence.
DESIGNATORS = set("letter letters initial initials plan type section class group point grade vitamin option figure part".split())
# German words before an ordinal number.
ORDINAL_LEAD = set("der die das dem den des am im vom zum beim ins ihr ihre sein seine jeder jede jedes".split())
CHAPTER_WORDS = set("chapter kapitel chapitre capítulo capitulo глава teil partie parte part book band tome тома volume κεφάλαιο".split())

# Closing marks, opening marks, terminators.
CLOSERS = "\"'”’»)]}›」』）］】〉》〕｣"
OPENERS = "\"'“‘„«([{‹「『（［【〈《〔¿¡—–―-｢"
PAIRS = {"“": "”", "„": "“”", "«": "»", "‘": "’", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "《": "》", "〈": "〉", "【": "】", "‹": "›", "｢": "｣", '"': '"'}
# Verbs and verb forms that report speech.
ZH_REPORT = frozenset("说 道 问 喊 答 叫 嚷 讲 说道 问道 喊道 答道 叫道 嚷道 讲道 笑道 回答 回答说 回答道 喊叫 大喊 大叫 低声说 轻声说".split())
JA_REPORT = frozenset("言った 叫んだ 答えた 尋ねた 聞いた つぶやいた 呟いた ささやいた 囁いた 言う 言います 言いました 述べた 語った 話した 怒鳴った 訊いた 笑った".split())
HI_REPORT = ("कहा", "पूछा", "बोला", "बोली", "बोले", "चिल्लाया", "चिल्लाई", "जवाब दिया", "उत्तर दिया", "फुसफुसाया", "सोचा")
AR_REPORT = ("سأل", "قال", "صاح", "أجاب", "رد", "همس", "صرخ", "هتف", "سألت", "قالت", "أجابت", "صاحت", "همست", "أضاف", "تساءل", "نادى")
# Fixed values, closed classes of Chinese and Japanese: particles that tie a quotation to its clause; final particles and
# endings; words that a clause can't end with; words that carry a broken-off sentence on; pronouns, question words and
# conjunctions that open one.
JA_AFTER = frozenset("と って の を は が に も で や へ から など という とは".split())
FINAL = frozenset("了 吗 吧 呢 啊 呀 么 嘛 啦 哦 か よ ね な ぞ わ さ だ た です ます でした ました".split())
LINKING = frozenset("的 地 得 把 被 在 和 与 跟 向 从 给 是 很 不 没 也 都 这 那 は が を に へ と の で も や から まで て".split())
CONNECTIVES = frozenset("然后 于是 但是 可是 然而 不过 因为 所以 而且 并且 只是 就 才 也 还 又 再 却 而 便 接着 しかし そして だが また それから けれど けれども でも".split())
OPENING = frozenset(
    "我 你 他 她 它 我们 你们 他们 她们 谁 为什么 怎么 哪里 什么 如果 虽然 难道 多么 没有人 第 彼 彼女 私 僕 あなた 誰 なぜ どこ もし なんと 何 それ これ この その あの".split()
)
CLOSED = frozenset().union(ZH_REPORT, JA_REPORT, JA_AFTER, FINAL, LINKING, CONNECTIVES, OPENING)

BREAKS = re.compile(r"[\n\r\x0b\x0c\x1c-\x1e\x85  ]+")
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
ODD = re.compile("[­͏؜᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿！-－／-～⼀-⿟̀-ͯﬀ-ﬆ]")
GAP = re.compile(r"(?:[.!?…؟।॥。！？｡]|;(?=\s|$|[»”\"]))+[\"'”’»)\]}›」』）］】〉》〕｣]*")
# What may close a quotation, and what may stand before that at the end of a sentence.
CLOSING, TERMINAL = CLOSERS + "“", ".!?…؟।॥;。！？｡"
CJK = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿]")
THAI = re.compile("[฀-๿]")
GREEK = re.compile("[Ͱ-Ͽἀ-῿]")
EDGES = frozenset("“”„«»‘([{\"—–")
TOKEN_AFTER = re.compile(r"[\s]*([^\s]+)")
DASH_SPEECH = re.compile(r"(?:^|(?<=[.!?…]))\s*[—–]\s?[^—–\n]+?[.!?…,]?\s?[—–]\s?(?=[a-zà-öø-ÿа-яё])")
QUOTE_MARKS = re.compile("[“”„«»‘’(\\[)\\]「」『』（）《》〈〉【】‹›｢｣\"]")
BORROWED = frozenset(map(chr, TO_LATIN))
WIDE = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
for _c in "！？（），：；［］":  # of their own meaning in text without spaces
    WIDE.pop(ord(_c), None)


def _view(line: str) -> tuple[str, list[int] | None]:
    """The line without invisible characters and in plain width, and where each of its characters stands in the line."""
    if not ODD.search(line):
        return line, None
    at: list[int] = []
    out: list[str] = []
    for i, c in enumerate(line):
        if unicodedata.combining(c) and ord(c) < 0x370 or INVISIBLE.match(c):
            if at:
                at[-1] = i
            continue
        o = ord(c)
        if 0xFB00 <= o <= 0xFB06:
            for x in unicodedata.normalize("NFKC", c):
                out.append(x)
                at.append(i)
            continue
        out.append(chr(WIDE[o]) if o in WIDE else unicodedata.normalize("NFKC", c)[0] if 0x2F00 <= o <= 0x2FDF else c)
        at.append(i)
    return "".join(out), at


def _protected(line: str) -> list[tuple[int, int]]:
    """Spans of matched quotations, brackets and dash-led speech, outermost ones only."""
    spans: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in QUOTE_MARKS.finditer(line):
        c, i = m.group(), m.start()
        if stack and c in PAIRS[stack[-1][0]]:
            if c == "’" and i + 1 < len(line) and line[i + 1].isalnum() and line[i - 1].isalpha():
                continue  # an apostrophe
            _, at = stack.pop()
            if not stack:
                spans.append((at, i + 1))
            continue
        if c == "’" or (c == "‘" and i and line[i - 1].isalpha()):
            continue
        if c in PAIRS:
            stack.append((c, i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in PAIRS[stack[k][0]]:  # an inner mark was never closed
                    at = stack[k][1]
                    del stack[k:]
                    if not stack:
                        spans.append((at, i + 1))
                    break
    if stack:  # an unmatched opener hides nothing: read what stands behind it on its own
        at = stack[0][1] + 1
        spans += [(a + at, b + at) for a, b in _protected(line[at:])]
    if "—" in line or "–" in line:
        for m in DASH_SPEECH.finditer(line):
            spans.append((m.start(), m.end()))
    return sorted(spans)


STOPS = re.compile("[。！？｡“「『《（\n]")
LAST_RUN = re.compile(f"(?:{RUN.pattern})$")


class Gaps:
    """Decides gaps in scripts without spaces from the words beside them on the cheapest path of the lattice."""

    def __init__(self, cost: dict[str, float] | None = None, names: Iterable[str] = ()):
        """``cost``: the dictionary; ``names``: words of spaced scripts that hold a terminal mark."""
        apart = tuple(w for w in CONNECTIVES | OPENING | ZH_REPORT | JA_REPORT if len(w) > 1)  # no part of a longer word
        kept = {w: c for w, c in (cost or {}).items() if w in CLOSED or not (w.startswith(apart) or w.endswith(apart))}
        self.lattice = Lattice(kept, CLOSED)
        self.names = frozenset(names)

    def after(self, text: str) -> str:
        """The first word of ``text``, '' where it begins with something else."""
        m = RUN.match(text)
        return self.lattice.words(m.group())[0] if m else ""

    def before(self, text: str) -> tuple[str, ...]:
        """The words at the end of ``text``."""
        m = LAST_RUN.search(text)
        return self.lattice.words(m.group()) if m else ()

    def reports(self, clause: str, verbs: frozenset[str]) -> bool:
        """Whether the clause ends with a verb that reports speech, of one word or several."""
        words = self.before(clause.rstrip())
        return any("".join(words[k:]) in verbs for k in range(max(-4, -len(words)), 0))

    def broken_off(self, before: str, rest: str) -> bool:
        """Whether an ellipsis between the two ends a unit: not before a word that goes on, not behind one that must,
        and not in a stammer."""
        first, words = self.after(rest), self.before(before)
        last = words[-1] if words else ""
        if first in CONNECTIVES or not last and not first:
            return False
        if last in FINAL:
            return True
        if last in LINKING or first in JA_AFTER:
            return False
        return not (first and first == last) and not (len(words) == 1 and len(last) <= 2 and len(before.strip()) == len(last))

    def closes(self, line: str, start: int, mark: str, end: int, opener: int | None) -> bool:
        """Whether the gap at ``end`` closes a unit."""
        rest = line[end:]
        if not rest.strip():
            return True
        if opener is None:  # plain marks; only an ellipsis leaves it open
            return bool(mark.strip("….")) or self.broken_off(line[start : end - len(mark)], rest)
        closer = line[end - 1]
        before = line[start:opener].strip()
        if closer in "》〉】":
            return False
        if closer in "）)":
            return not before
        inside = line[:end].rstrip(CLOSING)[-1:]
        if inside == "" or inside not in "。！？｡!?….،" or rest[0] in "，,、；":
            return False
        if before.endswith(("：", ":", "，")):
            return True
        first, follow = self.after(rest), STOPS.split(rest, maxsplit=1)[0]
        if closer in "」』":
            if first in JA_AFTER:
                return False
            return first in OPENING if before else not self.reports(follow, JA_REPORT)
        if before:
            return first not in CONNECTIVES and self.reports(before, ZH_REPORT) or first in OPENING
        return not self.reports(follow, ZH_REPORT)


def _token_before(line: str, start: int, end: int) -> str:
    at = end
    while at > start and not line[at - 1].isspace() and line[at - 1] not in EDGES:
        at -= 1
    return line[at:end]


def _opens(after: str) -> bool:
    c = after[0]
    return c.isupper() or c.istitle() or c in OPENERS or c.isdigit()


def _spaced(line: str, start: int, mark: str, m_start: int, end: int, opener: int | None, greek: bool, names: frozenset[str]) -> bool:
    """Whether the gap at ``end`` closes a unit in a spaced script."""
    nxt = TOKEN_AFTER.match(line, end)
    if not nxt:
        return True
    after = nxt.group(1)
    glued = nxt.start(1) == end
    a0 = after[0]
    if opener is not None:  # behind a quotation or bracket
        inside = line[:end].rstrip(CLOSING + " \xa0\u202f")[-1:]
        if a0 in ",;:—–-.…!?" and not (a0 in "—–" and not line[nxt.start(1) + 1 :].lstrip()[:1].islower()):
            return False
        if line[end - 1] in ")]}" and line[start:opener].strip():
            return False
        if not inside or inside not in TERMINAL:
            return False
        if a0.islower() or a0.isdigit() and line[start:opener].strip():
            return False
        if glued and a0.isalnum():
            return False
        if "؀" <= a0 <= "ۿ":
            return after.rstrip(".,،") not in AR_REPORT
        if "ऀ" <= a0 <= "ॿ":
            clause = re.split("[।॥?!“\"]", line[end:], maxsplit=1)[0].rstrip()
            return bool(line[start:opener].strip()) or not clause.endswith(HI_REPORT)
        return True
    if ";" in mark and not greek:
        return False
    if glued:
        if a0 in CLOSERS or a0 in ",;:-—":
            return False
        w = _token_before(line, start, m_start)
        if CJK.match(a0) or "ऀ" <= a0 <= "ॿ" and mark[0] in "।॥?!":
            return mark[0] != "."
        if not (a0.isupper() or a0 in "¿¡«“„") or not w:
            return False
        return (len(w) >= 2 or mark[0] in "!?") and (w[-1].islower() or mark[0] in "!?؟।") and "." not in w and not w.isupper() and w.lower() not in TITLES and "/" not in w and "@" not in w
    if a0.islower():
        return False
    if a0 in ",;:%" or a0 in CLOSERS and a0 not in "\"'":
        return False
    if a0 in "—–―-" and (x := line[nxt.start(1) + 1 :].lstrip()[:1]) and x.islower():
        return False
    if mark[0] in "!?؟":
        word = _token_before(line, start, m_start)
        return not (word + mark[0] in names and line[start : m_start - len(word)].strip())
    if mark[0] in "।॥;。｡" or len(mark) > 1 or mark[0] == "…":
        return _opens(after) or not a0.isascii()
    # a single full stop
    w = _token_before(line, start, m_start)
    low = w.lower()
    head = line[start : m_start - len(w)]
    if not w:
        return _opens(after)
    prev = head.rsplit(None, 1)[-1] if head.strip() else ""
    if w.isdigit():
        if not head.strip():
            return False  # a list number
        if len(w) <= 2 and (prev.lower() in ORDINAL_LEAD):
            return False
        return True
    short = low.rstrip(".")
    compound = f"{prev.lower().rstrip('.')}.{short}" if prev.endswith(".") and len(prev) <= 3 else ""
    if not head.strip() and re.fullmatch("[IVXLC]+", w) or prev.lower() in CHAPTER_WORDS and re.fullmatch("[IVXLC]+", w):
        return False
    if compound in MAYBE and len(w) == 1 and a0.isupper():
        return True
    if compound in TITLES or len(w) == 1 and len(after) == 2 and after[1] == "." and after[0].isalpha():
        return False
    if short == "sr":  # a title before a name, or "senior" behind one
        return bool(prev[:1].isupper()) and len(prev) > 3 and prev.isalpha() and _opens(after)
    if compound in MAYBE or short in MAYBE and short not in TITLES or low in MAYBE:
        return not (a0.isdigit() and (short in MONTHS or short in ("dept", "ex", "sq"))) and _opens(after)
    if len(w) == 1 and w.isalpha() and w.isupper():  # initials
        first = re.search(r"((?:\S\.[  ])*)$", head)
        lead = head[: first.start()].rstrip()
        word0 = lead.rsplit(None, 1)[-1].lower() if lead else ""
        return word0 in DESIGNATORS
    if "." in w and all(len(x) <= 1 for x in w.split(".")):  # C.B.R
        return _opens(after) and w.lower() in MAYBE
    if short in TITLES:
        if w[0].isupper() or len(short) <= 2 or short not in ("no", "min", "max", "art", "sec", "fig", "al", "me", "da", "hr", "cap", "gen", "sen"):
            return False
        return short in ("no", "me", "art", "cap") and a0.isupper()
    if len(w) == 1 and not w.isascii() and w.isalpha() and not CJK.match(w):
        return False
    return True


def _thai(line: str, base: int, ends: list[int], at: list[int] | None) -> None:
    for m in re.finditer(r"\S+", line):
        e = m.end()
        ends.append(base + (at[e - 1] if at else e - 1) + 1)


def _line(raw: str, base: int, ends: list[int], lattice: Gaps) -> None:
    line, at = _view(raw)
    body = line.rstrip()
    if not body.strip():
        return
    n_thai = len(THAI.findall(body))
    if n_thai and n_thai * 2 > sum(c.isalpha() for c in body):
        _thai(body, base, ends, at)
        return
    spans = _protected(body) if QUOTE_MARKS.search(body) or "—" in body or "–" in body else []
    n_cjk = len(CJK.findall(body))
    spaceless = n_cjk * 4 > len(body)
    greek = ";" in body and len(GREEK.findall(body)) * 3 > len(body)
    put = lambda e: ends.append(base + (at[e - 1] if at else e - 1) + 1)
    gaps: list[tuple[int, int, str, int | None]] = []  # end, beginning of the mark, mark, opener of the closer before the gap
    k = 0
    for m in GAP.finditer(body):
        i, e = m.span()
        while k < len(spans) and spans[k][1] <= i:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] <= i and spans[j][1] <= i:
            j += 1
        if j < len(spans) and spans[j][0] <= i:
            continue  # a mark inside a quotation or bracket
        gaps.append((e, i, m.group().rstrip(CLOSERS), None))
    for x, y in spans:
        inner = body[x + 1 : y - 1].rstrip()[-1:]
        if body[y - 1] in CLOSING and inner and inner in TERMINAL and not any(x2 < x and y < y2 for x2, y2 in spans):
            gaps.append((y, y, "", x))
    gaps.sort(key=lambda g: g[0])
    start = last = 0
    for e, i, mark, opener in gaps:
        if e <= last:
            continue
        if mark and e > i + len(mark):
            opener = start  # closers without a known opener
        cjk_side = spaceless and (CJK.match(body, e) is not None or CJK.match(body[i - 1 : i]) is not None or (opener is not None and body[e - 1] in "”」』》）"))
        if mark and mark[0] == "." and spaceless and opener is None and len(mark) == 1:
            continue  # a decimal or an initial
        if lattice.closes(body, start, mark, e, opener) if cjk_side else _spaced(body, start, mark, i, e, opener, greek, lattice.names):
            put(e)
            start = last = e
    tail = body[start:].rstrip()
    if tail.strip():
        put(start + len(tail))


def unit_ends(text: str | None, gaps: Gaps) -> list[int]:
    """Ends of the sentence units of ``text``: code points up to and including each unit's last character."""
    ends: list[int] = []
    if not text or not text.strip():
        return ends
    at = 0
    for m in BREAKS.finditer(text):
        _line(text[at : m.start()], at, ends, gaps)
        at = m.end()
    _line(text[at:], at, ends, gaps)
    return ends


def stored_unit_ends(text: str | None, repair: Repair, gaps: Gaps) -> list[int]:
    """Unit ends of a text as stored; stretches with a wrong encoding are read as what they were."""
    if not text or text.isascii():
        return unit_ends(text, gaps)
    got = repair.aligned(text)
    restored, ends = got or (text, None)
    chars = set(restored)
    if not chars.isdisjoint(BORROWED) and not chars.isdisjoint("aeiouAEIOU"):
        restored = plain_letters(restored)  # letters of another script, one for one
    found = unit_ends(restored, gaps)
    return [ends[e - 1] for e in found] if ends else found


def marked_names(df: DataFrame, text_col: str) -> list[str]:
    """Capitalised words with a mark, such as a paper's name, that inside sentences stand with it rather than without.

    At most a millionth part of the capitalised words inside sentences each, so at most a million.
    """
    text = F.col(text_col)
    inside = F.regexp_extract_all(text, F.lit(r"[\p{Ll},] (\p{Lu}\p{L}+[!?]?)(?=[ ,.;:])"), F.lit(1))
    words = df.where(text.isNotNull()).select(F.explode(inside).alias("w"))
    marked = F.col("w").rlike("[!?]$")
    counts = words.groupBy(F.regexp_replace("w", "[!?]$", "").alias("bare")).agg(F.count("*").alias("n"), F.count_if(marked).alias("n_marked"), F.mode(F.when(marked, F.col("w")), True).alias("w"))
    counts = checkpointed(counts)  # as long as the vocabulary; the texts are read once
    total = counts.agg(F.sum("n").alias("total"))
    kept = counts.where((F.col("n_marked") * 2 > F.col("n")) & (F.col("n_marked") >= 3)).join(F.broadcast(total), F.col("n_marked") >= F.col("total") / 1e6)
    return [r.w for r in kept.select("w").collect()]


ENDS = T.StructType([T.StructField("id", T.LongType()), T.StructField("end_pos", T.LongType())])


def learn(df: DataFrame, text_col: str) -> tuple[dict[str, float], list[str]]:
    """The dictionary and the names with a mark of a corpus."""
    texts = spread(df.select(text_col))
    return count_words(texts, text_col), marked_names(texts, text_col)


def sentence_units(df: DataFrame, id_col: str, text_col: str, learnt: tuple[dict[str, float], list[str]] | None = None) -> DataFrame:
    """(id, end_pos) of every sentence unit of every row. Null, empty and blank texts give no row.

    ``learnt``: what ``learn`` counted over the corpus the rows belong to, by default over the rows themselves.
    """
    shared = df.sparkSession.sparkContext.broadcast(learn(df, text_col) if learnt is None else learnt)  # both of bounded size

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        repair, gaps = Repair(), Gaps(*shared.value)
        for ids, texts in columns:
            out_id: list[int] = []
            out_end: list[int] = []
            for i, t in zip(ids, texts):
                ends = stored_unit_ends(t, repair, gaps)
                out_id += [i] * len(ends)
                out_end += ends
            yield [out_id, out_end]

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return map_batches(spread(slim), run, ENDS)


def p1_found(spark, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters")
    learnt = learn(chapters, "content_text")
    return sentence_units(chapters.where("src_format = 'epub'"), "chapter_id", "content_text", learnt).withColumnRenamed("id", "chapter_id")


QUERIES = {"p1_found": p1_found}
