"""Garbled text from wrong character encoding.

A text is cut into segments at line ends and sentence gaps. A segment that looks implausible is the start of a
best-first search: each step encodes the segment by a charset it may have been read as and decodes it by one it may
have been written in, or unescapes character references; visited texts are kept by hash; the queue is ordered by a
character-plausibility cost, and the cheapest reachable text wins if it is clearly cheaper than the start. Characters
lost for good (U+FFFD, or a question mark inside a word) mark a field as damaged although they can't be had back.

Null and empty fields are never damaged. Texts of any length are read whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import map_batches, spread, table
from foliant.llm.lookalikes import ALIKE

# Charsets a text may have been read as, and charsets it may have been written in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1253", "iso8859_7", "gbk", "shift_jis", "euc_jp", "cp1250")
WRITTEN_IN = ("utf_8", "cp1251", "koi8_r", "cp866", "gbk", "euc_jp", "shift_jis", "cp1253", "iso8859_7", "cp1252", "mac_roman", "cp850", "cp437", "cp1256", "cp874", "iso8859_6")
MULTI = ("gbk", "shift_jis", "euc_jp")

# Russian letters by how often they are used.
CYR_COMMON, CYR_MID, CYR_RARE = "оеаинтсрвлкмдпу", "яыьгзбчй", "хжшюц"
# Greek letters by how often they are used.
GREEK_COMMON, GREEK_MID, GREEK_RARE = "αοιετσνηυρπκμλς", "ωάίόέήύδγθ", "χφβξζψώ"
# Accented Latin letters of the Western languages here, and others of Latin-1.
LATIN_COMMON, LATIN_RARE = "éáóíúñäöüßçãõêàèâîôùûëïœÉÁÓÍÚÑÄÖÜÇÃÕÊÀÈÂÎÔ", "åæøìòðþýÿÅÆØÌÒÐÞÝÙÛËÏ"
# Letters of Central and Eastern European languages and of Turkish that Latin-1 lacks.
LATIN_EASTERN = "ąćęłńśźżčďěňřšťůžľĺŕőűășțşţđğıİĄĆĘŁŃŚŹŻČĎĚŇŘŠŤŮŽĽĹŔŐŰĂȘȚŞŢĐĞāēīūģķļņĀĒĪŪĢĶĻŅėįųĖĮŲ"
# The accents that letters of these languages are written with.
ACCENTS = "\u0300\u0301\u0302\u0303\u0306\u0308\u030a\u030c\u0327\u0345"
PUNCTUATION = "“”‘’«»„—–…¿¡°¬"
SIGNS = "·•§€£©®™№†‡‚"


@functools.cache
def _kind(c: str) -> tuple[str, float]:
    """A character's class (script and case) and its own cost."""
    o = ord(c)
    if o < 0x80:
        if c.islower():
            return "al", 0.0
        if c.isupper():
            return "aU", 0.05
        if c.isdigit():
            return "0", 0.0
        return (" ", 0.0) if c.isspace() else ("p", 0.3 if c in "`^~|{}\\$@<>" else 0.0) if o >= 32 else ("x", 4.0)
    if o < 0xA0 or c == "�" or 0xE000 <= o < 0xF900 or unicodedata.category(c) in ("Co", "Cn"):
        return "x", 5.0
    if c in PUNCTUATION:
        return "<" if c in "¡¿‘„«" else ">" if c == "»" else "q", {"“": 0.0, "”": 0.0, "’": 0.0, "‘": 0.0, "—": 0.0, "–": 0.0, "«": 0.1, "»": 0.1, "„": 0.1, "…": 0.1, "¿": 0.1, "¡": 0.1, "°": 0.2}.get(c, 0.3)
    if c in SIGNS:
        return "y", 0.9
    if o == 0xA0 or unicodedata.category(c) in ("Zs", "Cf"):
        return " ", 0.05
    if c in LATIN_COMMON:
        return ("aU", 0.6) if c.isupper() else ("al", 0.35)
    if c in LATIN_RARE:
        return ("aU", 1.6) if c.isupper() else ("al", 1.2)
    low = c.lower()
    if 0x400 <= o < 0x530:
        own = 0.0 if low in CYR_COMMON else 0.15 if low in CYR_MID else 0.6 if low in CYR_RARE else 0.9 if low in "щэфъё" else 2.2
        return ("cU" if c.isupper() else "cl"), own + (0.1 if c.isupper() else 0.0)
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        own = 0.0 if low in GREEK_COMMON else 0.2 if low in GREEK_MID else 0.5 if low in GREEK_RARE else 1.0
        return ("gU" if c.isupper() else "gl"), own + (0.1 if c.isupper() else 0.0)
    if 0x4E00 <= o < 0xA000 or 0x3400 <= o < 0x4DC0 or 0xF900 <= o < 0xFB00:
        return "h", 0.25 if _common_han(c) else 1.6
    if 0x3041 <= o < 0x3100:
        return "h", 0.1
    if 0xFF61 <= o < 0xFFA0:
        return "w", 1.5
    if 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFF61:
        if c.isalnum():
            return "aU" if c.isupper() else "al" if c.isalpha() else "0", 0.15
        return ("Q", 0.1) if c in "、。「」『』《》〈〉（），！？：；　．" else ("s", 1.5)
    if 0x900 <= o < 0x980:
        return "d", 0.05
    if 0xE00 <= o < 0xE80:
        kind = "v" if unicodedata.category(c) == "Mn" else "V" if c in "ะาำ" else "T" if c in "เแโใไ" else "t"
        return kind, 1.5 if c in "ฃฅฆฌฎฏฐฑฒฮฤฦฯฺ๎๏๚๛ฬฺํฝฟ฿ๆๅ" else 0.1
    if 0x600 <= o < 0x700:
        return "r", 0.1 if c in "ابتثجحخدذرزسشصضطظعغفقكلمنهويةىءأإآؤئ،؟؛" or 0x64B <= o < 0x653 else 1.5
    if unicodedata.category(c) in ("Mn", "Mc"):
        return "m", 0.2 if not 0x300 <= o < 0x370 else 0.4 if c in ACCENTS else 2.0
    if 0x1F000 <= o or 0x2600 <= o < 0x27C0 or 0x2F00 <= o < 0x2FE0 or 0x1D100 <= o < 0x1D200 or 0xFB00 <= o < 0xFB07 or 0x2010 <= o < 0x2013 or 0x2070 <= o < 0x2090 or 0x2460 <= o < 0x2500:
        return "e", 0.2
    if 0x100 <= o < 0x250:
        return ("aU" if c.isupper() else "al"), 0.6 if c in LATIN_EASTERN else 1.8
    if c.isalpha():
        return "o", 2.0
    return "s", 2.0


def _common_han(c: str) -> bool:
    try:
        if 0xB0 <= c.encode("gb2312")[0] <= 0xD7:
            return True
    except UnicodeEncodeError:
        pass
    try:
        return 0x88 <= c.encode("shift_jis")[0] <= 0x97
    except UnicodeEncodeError:
        return False


@functools.cache
def _step(a: str, b: str) -> float:
    """Cost of two classes side by side."""
    if a == b:
        return 0.25 if a in ("aU", "cU", "gU") else 0.8 if a == "s" else 0.0
    if a[0] == b[0] and len(a) == len(b) == 2:  # case inside a word
        return 2.2 if b[1] == "U" else 0.0
    if b == "v" and a not in "tv":
        return 3.0
    if b == "V" and a not in "tv" or a == "T" and b != "t":
        return 2.0
    if a in "TVv" and b in "TVvt":
        return 0.0
    if "Q" in (a, b):
        return 1.5 if a[0] in "acgdtr" or b[0] in "acgdtr" and b != "aU" else 0.0
    letters = "acghdtrow"
    if a[0] in letters and b[0] in letters and len(a + b) > 1:
        return 1.0 if "h" in (a, b) or "t" in (a, b) or "d" in (a, b) else 2.0
    if b == "<" and a[0] in letters or a == ">" and b[0] in letters:  # an opening or closing mark inside a word
        return 1.5
    if (a in "sy" or b in "sy") and (a[0] in letters or b[0] in letters):
        return 1.0
    return 0.0


def judged(text: str) -> tuple[float, int]:
    """How implausible the characters of ``text`` are beside each other, and how many of them are plainly wrong."""
    total, bad, last, before = 0.0, 0, " ", " "
    for c in text:
        kind, own = _kind(c)
        step = _step(last, kind)
        if kind == "m" and c in ACCENTS and len(unicodedata.normalize("NFC", before + c)) > 1:
            own = 2.0  # an accent that its letter never has
        total += own + step
        bad += own >= 1.0 or step >= 1.0
        last, before = kind, c
    return total, bad


def cost(text: str) -> float:
    return judged(text)[0]


@functools.cache
def _bytes_of(charset: str) -> dict[str, int]:
    table = {chr(b): b for b in range(256) if b < 0x80 or b < 0xA0}
    if charset == "cp1252":  # also what was read as Latin-1
        table |= {chr(b): b for b in range(0xA0, 256)}
    for b in range(0x80, 256):
        try:
            table[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    return table


def _encode(text: str, charset: str) -> bytes | None:
    if charset in MULTI:
        try:
            return text.encode(charset)
        except UnicodeEncodeError:
            if "�" in text and charset == "gbk" and RARE_HAN.search(text):
                try:
                    return text.replace("�", "").encode(charset)
                except UnicodeEncodeError:
                    return None
            return None
    try:
        return bytes(map(_bytes_of(charset).__getitem__, text))
    except KeyError:
        return None


MULTI_BYTE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


def _decode(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset)
    except UnicodeDecodeError:
        if charset != "utf_8":
            return None
        if not MULTI_BYTE.search(raw):
            return None
        text = raw.decode(charset, "replace")  # a few characters may be lost
        return text if text.count("�") * 6 <= len(text) + 6 else None


@functools.cache
def _chars_of(charset: str) -> frozenset[str]:
    return frozenset(_bytes_of(charset))


UTF8 = tuple((r, "utf_8") for r in READ_AS)
OTHER = tuple((r, w) for r in READ_AS for w in WRITTEN_IN if w != "utf_8" and r != w)
#: Texts looked at for one segment, and steps behind one another, at most; None for no bound.
BUDGET, DEPTH = 400, 3
#: Charsets whose every byte is a letter of a script without case: any bytes look well in them, so each character costs more.
EACH = {"cp874": 0.1, "cp1256": 0.1, "iso8859_6": 0.1}
#: A text is read on while its cost is no more than this above the best one: so much, and so much a character.
MARGIN, MARGIN_EACH = 3.0, 0.05


@dataclass
class Found:
    """The cheapest text reached: itself, its cost, the cost of the start, whether well-formed UTF-8 gave it, the steps to
    it, and whether the search ended before all was looked at."""

    text: str
    cost: float
    start_cost: float
    proof: bool
    steps: list[tuple[str, str]]
    bounded: bool


def search(start: str, depth: int | None = DEPTH, budget: int | None = BUDGET) -> Found:
    """The cheapest text reachable from ``start`` by encode-decode and unescape steps, the cheapest first.

    A text with no implausible character has nothing left to explain and isn't read on. Where well-formed UTF-8 explains a
    text, only UTF-8 readings of it are tried, and behind one only a reading that leaves nothing implausible.
    """
    base, base_bad = judged(start)
    best, best_cost, proof = start, base, False
    margin = MARGIN + MARGIN_EACH * len(start)
    seen = {hash(start)}
    came: dict[str, tuple[str, tuple[str, str]]] = {}
    queue: list[tuple[float, int, int, str, int, bool]] = [(base, 0, 0, start, base_bad, False)]
    n, bounded = 0, False
    while queue:
        at, level, _, text, bad, sure_here = heapq.heappop(queue)
        if level and at > best_cost + margin:
            break  # the queue is in order of cost
        if level and not bad:
            continue
        if depth is not None and level >= depth or budget is not None and n >= budget:
            bounded = True
            continue

        def put(out: str, step: tuple[str, str], price: float, sure: bool) -> bool:
            """Whether ``out`` is new and cheaper than the text it was read from."""
            nonlocal best, best_cost, proof, n
            if hash(out) in seen:
                return False
            seen.add(hash(out))
            c, wrong = judged(out)  # noqa: B023
            if sure_here and not sure and wrong:  # noqa: B023
                return False
            came[out] = (text, step)  # noqa: B023
            n += 1
            c += price
            if c < best_cost:
                best, best_cost, proof = out, c, sure
            heapq.heappush(queue, (c, level + 1, n, out, wrong, sure))  # noqa: B023
            return c < at  # noqa: B023

        if "&" in text and (plain := html.unescape(text)) != text:
            put(plain, ("", "unescape"), 0.4 * (level + 1), False)
        chars = set(text)
        raws: dict[str, bytes | None] = {}
        for steps in (UTF8, OTHER):
            proven = False
            for r, w in steps:
                if r not in raws:
                    raws[r] = _encode(text, r) if r in MULTI or chars <= _chars_of(r) else None
                out = _decode(raws[r], w) if raws[r] is not None else None
                if out is not None:
                    sure = w == "utf_8" and "\ufffd" not in out
                    proven |= put(out, (r, w), 0.4 * level + (0.0 if sure else 0.4 + EACH.get(w, 0.0) * len(out)), sure) and sure
            if proven:
                break
    path: list[tuple[str, str]] = []
    at_text = best
    while at_text in came:
        at_text, step = came[at_text]
        path.append(step)
    return Found(best, best_cost, base, proof, path[::-1], bounded)


# Characters that plain text of these languages holds none of, or only in other surroundings.
SUSPECT = re.compile(
    "[\x80-\x9f�]"
    "|[¡-ÿŒœŠšŸŽžƒˆ˜€‚-„†-•‰‹›™]{3,}"
    "|[\xc2-\xf4][\xa0-\xbf]|[ÃÂâÐÑÎÏà-ïØÙ][€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]"
    "|[a-zß-ÿ][A-ZÀ-ÞŠŒŽŸ]|[а-яё][А-ЯЁ]|[Ђ-ЄЇЉ-Џђ-єїљ-џҐґ]"
    "|[√∂∑∏∫Ω≈∆◊ıˆ˜¯˘˙˚¸˝˛ˇ⁄‰]|‚Ä|[a-zA-Z][‚„]|[─-▟⌐¬½¼αßΓπΣσµτΦΘΩδ∞φε∩≡±≥≤⌠⌡÷≈∙√ⁿ²][─-▟⌐¬½¼ΓΣΦΘ∞∩≡±≥≤⌠⌡÷≈∙√ⁿ²ÇüéâäàåçêëèïîìÄÅÉæÆôöòûùÿÖÜ¢£¥₧ƒáíóúñÑªº¿¡]"
    "|(?<![A-Za-zÀ-ÿ])[ìîÒÓÔÕ](?=[A-Z][a-z ])|[?!.,][ìîÓÔ]|[a-z][ΘΓΣΦΩδεφστπ±≥≤÷≡∩⌠⌡²¢£¥§¶ªº®©½¼¾¨¸´Øøþðý‡ŽŠˆŸš]|[ΘΓΣΦΩδ∞φε±≥≤÷≡∩⌠⌡²¢£¥§¶®©½¼¾¨¸´Øøþð‡ŽŠˆŸš][a-z]"
    "|[a-zß-ÿ][Ђ-ЄЇЉ-ЏБГДЖЗИЙЛПФЦ-Ябвгджзийклмнптфцчшщъыьэюяё-єїљ-џ]|[Ђ-ЄЇЉ-ЏБГДЖЗИЙЛПФЦ-Ябвгджзийклмнптфцчшщъыьэюяё-єїљ-џ][a-zß-ÿ]"
    "|&#?\\w{2,8};"
)
RARE_HAN = re.compile("[㐀-䶿一-鿿]{2,}")
LOST = re.compile(r"�|\A…[a-zà-öø-ÿ]{4,}\Z|[a-zà-öø-ÿ]\?[a-zà-öø-ÿ]|(?:^|[\s“«(])\?[a-zà-öø-ÿ]{2}|[A-ZÀ-Þ]\?[A-ZÀ-Þ](?![a-zà-ÿ])|\b[A-ZÀ-Þ]\?[a-zà-ÿ]{2}|[А-Яа-яΑ-ω]\?[а-яα-ω]|\?{3,}[ ?]|\?\?\s\?\?|\b[A-Z]{3,}\?\s[A-Z]{2,}\b")
PART = re.compile(r"[^.!?。！？।\n]+[.!?。！？।\"”»’]*[ \t]*|[.!?。！？।]+[ \t]*|\n+")


BY_SCRIPT = re.compile("[Ͱ-῿　-鿿豈-﫿＀-｠]+|[^Ͱ-῿　-鿿豈-﫿＀-｠]+")
SAFE = frozenset(
    "".join(map(chr, range(128))) + "“”‘’«»„—–…¿¡°¬•·†©€ªº\xa0\xad" + "éáóíúñäöüßçãõêàèâîôùûëïœ" + "".join(map(chr, (*range(0x2000, 0x2012), *range(0x202A, 0x2030), *range(0x2060, 0x2070), 0xFEFF)))
    + "".join(map(chr, (*range(0x300, 0x3FF), *range(0x600, 0x700), *range(0x900, 0x980), *range(0xE00, 0xE80), *range(0x1F00, 0x2000), *range(0x2F00, 0x2FE0), *range(0x3000, 0x3100), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF61), *range(0x1F000, 0x1FAFF), 0x1D11E)))
)


def _dense(at: list[int], length: int) -> bool:
    """Whether rare signs make up a quarter of a run, or three of them stand within six."""
    return len(at) * 4 > length or any(b - a <= 5 for a, b in zip(at, at[2:]))


def suspicious(text: str) -> bool:
    """Whether the text holds characters or sequences that plain text of these scripts doesn't."""
    odd = set(text) - SAFE
    if not odd:
        return GREEK_IN_LATIN.search(text) is not None
    han = [c for c in odd if "㐀" <= c <= "鿿"]
    rare = {c for c in han if not _kind_common(c)}
    if rare and any(_dense([i for i, c in enumerate(run) if c in rare], len(run)) for run in RARE_HAN.findall(text)):
        return True
    return (len(han) < len(odd) or not odd) and SUSPECT.search(text) is not None


GREEK_IN_LATIN = re.compile("[a-z][ΘΓΣΦΩδεφστπ]|[ΘΓΣΦΩδφ][a-z]|[a-zA-Z][‚„]|ΓÇ|[?!.,]î|[a-z][A-Z]|&#?\\w{2,8};|[àâ]\xa0|[âàãïä][€“”–„†°\xa0]")
_kind_common = functools.cache(_common_han)


MIXED_WORD = re.compile(r"\w*(?:[A-Za-zÀ-ÿ][Ѐ-ӿͰ-Ͽ]|[Ѐ-ӿͰ-Ͽ][A-Za-zÀ-ÿ])\w*")
TO_LATIN = {ord(a): b for k in ("Cyrillic", "Greek") for a, b in zip(ALIKE[k][::2], ALIKE[k][1::2])}
TO_CYRILLIC = {ord(b): a for a, b in zip(ALIKE["Cyrillic"][::2], ALIKE["Cyrillic"][1::2]) if "а" <= a <= "я" or "А" <= a <= "Я"}


def plain_letters(text: str) -> str:
    """The text with letters borrowed from another script put back, one for one, so that they don't look damaged."""

    def put(m: re.Match) -> str:
        w = m.group()
        latin = w.translate(TO_LATIN)
        if not re.search("[Ѐ-ӿͰ-Ͽ]", latin):
            return latin
        cyrillic = w.translate(TO_CYRILLIC)
        return w if re.search("[A-Za-z]", cyrillic) else cyrillic

    return MIXED_WORD.sub(put, text)


class Repair:
    """Repairs fields one after the other.

    A text's answer depends on nothing but the text. Answers for short texts are kept. ``bounded`` counts the segments
    whose search ended at ``budget`` or ``depth``.
    """

    def __init__(self, keep: int = 50_000, short: int = 256, depth: int | None = DEPTH, budget: int | None = BUDGET):
        self.keep, self.short, self.depth, self.budget = keep, short, depth, budget
        self.kept: dict[str, tuple[str, bool]] = {}
        self.bounded = 0
        self._fresh()

    def _fresh(self) -> None:
        self.memo: dict[str, tuple[str, bool]] = {}
        self.steps: dict[str, list[tuple[str, str]]] = {}

    def segment(self, part: str) -> tuple[str, bool]:
        got = self.memo.get(part)
        if got is None:
            x = search(part, self.depth, self.budget)
            self.bounded += x.bounded
            gain = x.start_cost - x.cost
            ok = x.text != part and (x.proof and gain >= 0.2 or gain >= 1.5 and x.cost <= 0.6 * x.start_cost)
            got = (x.text, True) if ok else (part, False)
            self.memo[part] = got
            if ok:
                self.steps[part] = x.steps
        return got

    def parts(self, text: str) -> list[tuple[str, str, bool]]:
        """(read, restored, damaged) for consecutive stretches of ``text``, read with borrowed letters put back."""
        self._fresh()
        out: list[tuple[str, str, bool]] = []
        for line in re.split(r"(\n+)", plain_letters(text)):
            if not line or not suspicious(line):
                out.append((line, line, False))
                continue
            whole, damaged = self.segment(line)
            if damaged and judged(whole)[1] * 40 <= len(whole):
                out.append((line, whole, True))
                continue
            pieces, any_part = [], False
            for part in PART.findall(line):
                fixed, hit = self.segment(part) if suspicious(part) else (part, False)
                core = part.rstrip("。！？ \t”」』")
                if not hit and core != part and RARE_HAN.search(core) and suspicious(core):  # its mark may be sound
                    fixed, hit = self.segment(core)
                    if hit:
                        pieces += [(core, fixed, True), (part[len(core) :], part[len(core) :], False)]
                        any_part = True
                        continue
                if not hit and len(runs := BY_SCRIPT.findall(part)) > 1 and suspicious(part):
                    for run in runs:
                        fixed, hit = self.segment(run) if suspicious(run) else (run, False)
                        pieces.append((run, fixed, hit))
                        any_part |= hit
                    continue
                pieces.append((part, fixed, hit))
                any_part |= hit
            if damaged and (not any_part or cost("".join(f for _, f, _ in pieces)) > cost(whole)):
                out.append((line, whole, True))
            else:
                out += pieces
        return out

    def field(self, text: str | None) -> tuple[str | None, bool]:
        """The restored text and whether any stretch of it was decoded wrongly; other stretches stay as stored."""
        if not text:
            return text, False
        if text.isascii():
            return text, "?" in text and LOST.search(text) is not None
        damaged = LOST.search(text) is not None
        if not suspicious(text) or not suspicious(plain_letters(text)):
            return text, damaged
        if text in self.kept:
            return self.kept[text]
        out, at = [], 0
        for read, fixed, hit in self.parts(text):
            out.append(fixed if hit else text[at : at + len(read)])
            at += len(read)
            damaged |= hit
        got = "".join(out), damaged
        if len(text) <= self.short:
            if len(self.kept) >= self.keep:
                self.kept.clear()
            self.kept[text] = got
        return got

    def aligned(self, text: str) -> tuple[str, list[int]] | None:
        """The restored text and, for each of its characters, where it ends in the stored one; None if nothing changes."""
        if text.isascii() or not suspicious(text) or not suspicious(plain_letters(text)):
            return None
        out: list[str] = []
        ends: list[int] = []
        at, changed = 0, False
        for stored, _, damaged in self.parts(text):
            got = _ends(stored, self.steps.get(stored, [])) if damaged else None
            if got is None:
                out.append(text[at : at + len(stored)])
                ends += range(at + 1, at + len(stored) + 1)
            else:
                out.append(got[0])
                ends += (at + e for e in got[1])
                changed = True
            at += len(stored)
        return ("".join(out), ends) if changed else None


def _ends(stored: str, steps: list[tuple[str, str]]) -> tuple[str, list[int]] | None:
    """The text after the steps, and the end in ``stored`` of each of its characters; None where characters were lost."""
    text, ends = stored, list(range(1, len(stored) + 1))
    for r, w in steps:
        raw = _encode(text, r) if w != "unescape" else None
        out = _decode(raw, w) if raw is not None else None
        if out is None or "\ufffd" in out:
            return None
        owner: list[int] = []  # of each byte the end of its character
        for c, e in zip(text, ends):
            owner += [e] * (len(c.encode(r)) if r in MULTI else 1)
        at, new = 0, []
        for c in out:
            at += len(c.encode(w))
            if at > len(owner):
                return None
            new.append(owner[at - 1])
        if at != len(raw):
            return None
        text, ends = out, new
    return text, ends


FIXED = T.StructType([T.StructField("chapter_id", T.LongType()), T.StructField("field", T.StringType()), T.StructField("restored", T.StringType())])


def repaired_fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, restored): one row per damaged field, with what could be had back."""

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        repair = Repair()
        for cols in columns:
            ids, out = cols[0], ([], [], [])
            for name, texts in zip(fields, cols[1:]):
                for i, t in zip(ids, texts):
                    fixed, damaged = repair.field(t)
                    if damaged:
                        out[0].append(i)
                        out[1].append(name)
                        out[2].append(fixed)
            yield list(out)

    return map_batches(spread(df.select(F.col(id_col).cast("long"), *fields)), run, FIXED)


def p4_restored(spark, sf_dir: str) -> DataFrame:
    return repaired_fields(table(spark, sf_dir, "chapters"), "chapter_id", ["content_text", "chapter_title"])


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_restored(spark, sf_dir).select("chapter_id", "field")


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
