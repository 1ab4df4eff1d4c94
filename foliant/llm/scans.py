"""Noise in text from scanned pages: page furniture, words split over lines, misread letters.

Two averaged perceptrons share one hashed word count of the whole corpus. The line model tells running text from running
heads and page numbers by features of the line's place on the page. The editor predicts operations: at a letter keep,
replace, delete or insert, at a line's end keep or join. What an operation may put is proposed by a table of confusions
(fixed ones and those learnt from pages of the corpus), and for a sign or digit inside a word by the whole alphabet of its
script; a proposal must give a word that the corpus has. Both models are trained here, on pages that are set from every
clean row: wrapped, hyphenated, furnished and misread by known rules, so that pages and rows are aligned letter by letter
and every label is known. Examples are counted where the rows are; the driver trains on the different ones with their counts.

Pages of any script are read; texts without hard line ends have no cases. Null and blank texts give no row. Lines are
split at ``\\n`` only. Texts of any length are read whole. Repeated rows give repeated results; extra columns don't matter.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import groupby, repeat
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import map_batches, spread, table

#: log2 of the entries of the word count, 16 MB for any corpus.
BITS = 22
SLOTS = (1 << BITS) - 1
#: Turns of training whose scores are taken at once, at most, and parts of a round at least.
BLOCK, BLOCKS = 500, 500
#: A confusion is learnt if so many different words show it, and so many times as many as another one shows on average.
VOTES, ABOVE = 6, 4.0

# Letter groups as printed, and what a scan makes of them.
MISREAD = (
    ("t", "†"), ("o", "0"), ("b", "6"), ("é", "6"), ("h", "b"), ("n", "ri"), ("e", "c"), ("l", "1"), ("i", "1"), ("s", "5"), ("u", "ii"), ("tt", "ll"), ("d", "cl"), ("m", "rn"), ("ü", "ii"),
    ("rn", "m"), ("E", "F"), ("O", "0"), ("I", "l"), ("l", "I"), ("S", "5"), ("B", "8"), ("g", "9"), ("a", "o"), ("cl", "d"), ("li", "h"), ("vv", "w"), ("w", "vv"), ("f", "t"), ("h", "li"), ("c", "e"), ("b", "h"), ("ll", "tt"), ("ri", "n"), ("ii", "u"), ("i", "l"), ("y", "v"), ("B", "R"), ("G", "C"), ("G", "6"), ("Q", "O"), ("T", "†"), ("i", "!"), ("l", "|"), ("z", "2"), ("in", "m"), ("n", "u"), ("u", "n"),
)
# Part labels that stand in running heads, by language; page words.
PARTS = ("part ii", "part i", "part iii", "part one", "part two", "première partie", "deuxième partie", "primera parte", "segunda parte", "erster teil", "zweiter teil")
PARTS_OF = {n: [p for p in PARTS if len(p) == n] for n in set(map(len, PARTS))}
NUMBER = r"(?:\d|[lIOoSB](?=[\dlIOoSB]*\d)|(?<=\d)[lIOoSB])[\dlIOoSB]{0,3}|l[lO]{1,2}"
ROMAN = r"(?=[ivxlc])(?:x{0,4}l?x{0,3})(?:ix|iv|v?i{0,3})"
PAGE_LINE = re.compile(rf"^[\s\f]*(?:[-–—·•\[(|*]\s*)?(?:(?i:page|seite|pág(?:ina)?\.?|p\.)\s*)?(?:{NUMBER}|{ROMAN})(?:\s*(?:of|von|de|sur|/)\s*(?:{NUMBER}))?(?:\s*[-–—·•\])|*])?[\s\f]*$")
NUMBERED_HEAD = re.compile(rf"^[\s\f]*(?:(?P<a>{NUMBER}|{ROMAN})\s{{2,}}(?P<t>\S.*?)|(?P<u>\S.*?)(?:\s+\|\s+|\s{{3,}})(?P<b>{NUMBER}|{ROMAN}))\s*$")
# Marks that end a sentence or clause, and closers behind them.
ENDERS, CLOSERS = frozenset(".!?…:。！？｡।॥؟"), "\"”’»)]」』"
WORDLIKE = re.compile(r"\w")
HYPHENS = "-‐\xad¬"
HYPHEN = re.compile(r"([^\W\d_]+(?:[’'][^\W\d_]+)*)([-‐­¬])[ ]?$")
WORD = re.compile(r"[^\W_]+(?:[’'†|!€£$¢§@~^-]+[^\W_]+)*[†|]?|†[^\W_]+(?:-[^\W_]+)*")
#: Scripts that are written without spaces have no words to count.
SPACELESS = re.compile("[฀-๿぀-ヿ㐀-鿿]")
NAME = re.compile(r"\b[A-Z][a-z]{3,}\b")
#: What every NUMBERED_HEAD has.
GAP_OR_BAR = re.compile(r"\s\s|\|")
YEAR, YEAR_END = re.compile(r"1[5-9]\d\d|20\d\d"), re.compile(r", 1[0-9]{3}$")
# Digits and signs read for letters, letters read for digits.
LIKE_LETTERS, LIKE_DIGITS = tuple(zip("01†589", "oltsbg")), str.maketrans("lIOoSB", "110058")
ASCII_LETTERS, ASCII_OTHER = bytes.maketrans(b"01589", b"olsbg"), bytes(k for k in range(128) if not chr(k).isalnum())
SIGNS = "0123456789€£$§@|!"
DIGITS = "0123456789lIOo|[]—–-·"
DIRT = re.compile("[​‌⁠﻿]")
BROKEN = re.compile(r"[-‐­¬] ?\n\s*")


def ended(line: str) -> bool:
    """Whether a line stops at a mark, or has nothing but signs."""
    body = line.rstrip().rstrip(CLOSERS)
    return body[-1:] in ENDERS or not WORDLIKE.search(line)


def _slot(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass")) & SLOTS


# --- the word count ------------------------------------------------------------------------------------------------

COUNTS = T.StructType([T.StructField("slot", T.LongType()), T.StructField("n", T.LongType())])


def count_words(df: DataFrame, text_col: str) -> DataFrame:
    """How often each word (by hash) stands in all texts, words broken at line ends left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter[str] = Counter()
        slots: Counter[int] = Counter()

        def fold() -> None:
            for token, n in tokens.items():
                if "\0" not in token and not SPACELESS.search(token):
                    for w in WORD.findall(token):
                        slots[_slot(w)] += n
            tokens.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    tokens.update((BROKEN.sub("\0", t) if "\n" in t else t).split())
                    if len(tokens) > 500_000:
                        fold()
        fold()
        items = list(slots.items())
        for a in range(0, len(items), 100_000):
            part = items[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int64()), pa.array([n for _, n in part], pa.int64())], names=["slot", "n"])

    texts = df.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, COUNTS).groupBy("slot").agg(F.sum("n").alias("n"))


def word_counts(df: DataFrame, text_col: str) -> np.ndarray:
    """The counts as one array; the driver gets at most 2**BITS rows."""
    out = np.zeros(1 << BITS, np.uint32)
    for batch in count_words(df, text_col).toArrow().to_batches():
        out[batch["slot"].to_numpy()] = np.minimum(batch["n"].to_numpy(), 2**32 - 1)
    return out


# --- averaged perceptron -------------------------------------------------------------------------------------------


class Perceptron:
    """Averaged perceptron over sparse named features. ``w``: of each label the weights by feature."""

    def __init__(self, labels: tuple[str, ...]):
        self.labels = labels
        self.w: dict[str, dict[str, float]] = {k: {} for k in labels}

    def score(self, label: str, features: list[str]) -> float:
        return sum(map(self.w[label].get, features, repeat(0.0)))

    def best(self, features: list[str]) -> str:
        return max(self.labels, key=lambda k: self.score(k, features))

    def train(self, data: Counter[tuple[str, str, tuple[str, ...]]], rounds: int = 5, seed: int = 7) -> None:
        """``data``: how many examples have this key (see ``key_of``), this label, and these labels that come into question.

        Equal examples of different labels offset one another, and those left over have the commonest label. A round takes
        ``n`` equal ones in about log2(n) turns; a turn moves the weights as often as that many copies in a row would. Turns
        that are right when their block begins are passed.
        """
        names: dict[str, int] = {}
        ids, labels, allowed, parts, copies = [], [], [], [], []
        for (key, choices), same in groupby(sorted(data.items(), key=lambda x: (x[0][0], x[0][2], x[0][1])), key=lambda x: (x[0][0], x[0][2])):
            (n, label), (less, _) = [*sorted(((n, label) for (_, label, _), n in same), reverse=True)[:2], (0, "")][:2]
            if n > less:
                ids.append(np.array([names.setdefault(f, len(names)) for f in features_of(key)], np.int32))
                labels.append(self.labels.index(label))
                allowed.append([k in choices for k in self.labels])
                parts.append((n - less).bit_length())
                copies.append(-(-(n - less) // parts[-1]))
        if not ids:
            return
        padded = np.full((len(ids), max(map(len, ids))), len(names), np.int32)
        for row, own in zip(padded, ids):
            row[: len(own)] = own
        right, barred, turns = np.array(labels), np.where(allowed, 0.0, -np.inf), np.repeat(np.arange(len(ids)), parts)
        weight, moved = np.zeros((2, len(self.labels), len(names) + 1))
        pairs, size = [sum(x) == 2 for x in allowed], min(BLOCK, -(-len(turns) // BLOCKS))
        now, rng = 0, np.random.default_rng(seed)
        for _ in range(rounds):
            order = rng.permutation(turns)
            for block in np.split(order, range(size, len(order), size)):
                sums = weight[:, padded[block]].sum(-1).T + barred[block]
                for j in np.flatnonzero(sums.argmax(1) != right[block]).tolist():
                    g = block[j]
                    own, label, left = ids[g], labels[g], copies[g]
                    while left:
                        score = weight[:, own].sum(1) + barred[g]
                        guess = int(score.argmax())
                        if guess == label:
                            break
                        step = min(left, int((score[guess] - score[label]) // (2 * len(own))) + 1)
                        left -= step
                        for k, d in ((label, step), (guess, -step)):
                            weight[k, own] += d
                            moved[k, own] += d * (now + j)
                        if pairs[g]:  # right now, or out of copies
                            break
                now += len(block)
        mean = weight - moved / now
        self.w = {k: {f: x for f, x in zip(names, own) if x} for k, own in zip(self.labels, mean.tolist())}


def _band(n: float) -> str:
    return str(min(14, int(math.log2(n + 1))))


OPERATIONS = ("keep", "replace", "delete", "insert", "join")


def operation(read: str, printed: str) -> str:
    """What turns a read group into the printed one."""
    return "replace" if len(read) == len(printed) else "delete" if len(read) > len(printed) else "insert"


@functools.cache
def alphabet(c: str) -> tuple[str, ...]:
    """The small letters of the script that ``c`` belongs to."""
    script = unicodedata.name(c, "?").partition(" ")[0]
    blocks = {"LATIN": (0x61, 0x100), "GREEK": (0x370, 0x400), "CYRILLIC": (0x430, 0x460)}
    low, high = blocks.get(script, (ord(c) & ~0x7F, (ord(c) & ~0x7F) + 0x80))
    return tuple(x for x in map(chr, range(low, high)) if x.isalpha() and not x.isupper() and unicodedata.name(x, "").startswith(script))


class Editor:
    """The two models, the confusions and the word count."""

    def __init__(self, counts: np.ndarray, learnt: tuple[tuple[str, str], ...] = ()):
        self.counts, self.learnt, self.view = counts, tuple(learnt), memoryview(np.ascontiguousarray(counts))
        self.lines = Perceptron(("text", "header", "page_no"))
        self.ops = Perceptron(OPERATIONS)
        self.memo: dict[str, list[tuple[int, str, str]]] = {}
        self.looked: dict[str, int] = {}
        self.filled: dict[tuple[str, str], list[tuple[str, str]]] = {}
        self.kind_of: dict[tuple, str] = {}
        self.printed = defaultdict(list)
        for printed, read in (*MISREAD, *self.learnt):
            self.printed[read].append(printed)
        self.unread = re.compile("|".join(sorted(map(re.escape, filter(None, self.printed)), key=len, reverse=True)))

    def n(self, word: str) -> int:
        got = self.looked.get(word)
        if got is None:
            if len(self.looked) > 200_000:
                self.looked.clear()
            got = self.looked[word] = self.view[_slot(word)]
        return got

    # characters

    def options(self, word: str) -> list[tuple[int, str, str, str]]:
        """(position, read group, printed group, word with it) of every operation that gives a word of the corpus."""
        out: list[tuple[int, str, str, str]] = []
        seen: set[tuple[int, str]] = set()

        def propose(i: int, read: str, printed: str) -> None:
            fixed = word[:i] + printed + word[i + len(read) :]
            if (i, fixed) not in seen and fixed != word and self.view[_slot(fixed)]:
                seen.add((i, fixed))
                out.append((i, read, printed, fixed))

        def fills(head: str, tail: str, letter: str) -> list[tuple[str, str]]:
            """What may stand between, and the words that it gives."""
            got = self.filled.get((head, tail))
            if got is None:
                if len(self.filled) > 20_000:
                    self.filled.clear()
                got = self.filled[head, tail] = [(x, head + x + tail) for x in ("", *alphabet(letter)) if self.view[_slot(head + x + tail)]]
            return got

        sizes = (0, 1, 2) if "" in self.printed else (1, 2)
        for i in range(len(word) + ("" in self.printed)):
            for size in sizes:
                read = word[i : i + size]
                if read in self.printed and len(read) == size:
                    for printed in self.printed[read]:
                        propose(i, read, printed)
        if not word.isalpha():
            letter = next((c for c in word if c.isalpha()), None)
            if letter and sum(map(str.isalpha, word)) * 2 > len(word):
                for i, c in enumerate(word):
                    if not c.isalpha() and c not in "’'-":
                        for x, fixed in fills(word[:i], word[i + 1 :], letter):
                            if (i, fixed) not in seen:
                                seen.add((i, fixed))
                                out.append((i, c, x, fixed))
        return out

    def char_values(self, word: str, option: tuple[int, str, str, str], own: int | None = None) -> tuple:
        """What ``char_features`` names."""
        i, read, printed, fixed = option
        a, b = self.n(word) if own is None else own, self.n(fixed)
        ratio = int(2 * (math.log2(b + 1) - math.log2(a + 1)))
        where = "start" if i == 0 else "end" if i + len(read) == len(word) else "in"
        mixed = not word.isalpha() and any(map(str.isdigit, word)) and any(map(str.isalpha, word))
        return read, printed, max(-6, min(24, ratio)), _band(a), _band(b), min(8, len(word)), where, len(word) < 3, mixed, printed in self.printed.get(read, ())

    def char_features(self, word: str, option: tuple[int, str, str, str], own: int | None = None) -> list[str]:
        return char_names(self.char_values(word, option, own))

    def gain(self, word: str, option: tuple[int, str, str, str], own: int | None = None) -> float:
        """How much the option's operation is preferred to keeping."""
        features = self.char_features(word, option, own)
        return self.ops.score(operation(option[1], option[2]), features) - self.ops.score("keep", features)

    def edits(self, word: str) -> list[tuple[int, str, str]]:
        """Operations (position, read, printed) that restore ``word``, best first."""
        got = self.memo.get(word)
        if got is not None:
            return got
        now, done = word, []
        if len(word) > 1 and not word.isdigit():
            for _ in range(len(word)):
                gains = [(self.gain(now, option), -k, option) for k, option in enumerate(self.options(now))]
                top, _, best = max(gains, default=(0.0, 0, None), key=lambda g: g[:2])
                if top <= 0.0:
                    two = self._second_chance(now)
                    if not two:
                        break
                    done += [x[:3] for x in two]
                    now = two[-1][3]
                    continue
                done.append(best[:3])
                now = best[3]
        if len(self.memo) > 300_000:
            self.memo.clear()
        self.memo[word] = done
        return done

    def _second_chance(self, word: str) -> list[tuple[int, str, str, str]]:
        """Two misread groups in a word that the corpus hardly knows."""
        if self.n(word) > 2 or len(word) < 4 or word.isalpha() and len(word) < 6:
            return []
        best, top = [], 0.0
        for m in self.unread.finditer(word):
            for printed in self.printed[m.group()]:
                half = word[: m.start()] + printed + word[m.end() :]
                for option in self.options(half):
                    if option[0] >= m.start() and self.n(option[3]) > 8:
                        gain = self.gain(half, option, self.n(word))
                        if gain > top:
                            best, top = [(m.start(), m.group(), printed, half), option], gain
        return best

    # joins

    def join_features(self, left: str, mark: str, right: str) -> list[str]:
        joined, whole = self.n(left + right), self.n(f"{left}-{right}")
        a, b = self.n(left), self.n(right)
        return [
            "join", f"mark={mark}", f"joined={_band(joined)}", f"whole={_band(whole)}", f"more={joined > whole}", f"diff={max(-8, min(8, int(math.log2(joined + 1) - math.log2(whole + 1))))}",
            f"parts={min(4, int(_band(a)))},{min(4, int(_band(b)))}", f"lower={right[:1].islower()}", f"none={not joined and not whole}", f"mark={mark},whole={whole > 0}", f"both={a > 20 and b > 20},{joined > 0},{whole > 0}",
        ]

    def joins(self, left: str, mark: str, right: str) -> bool:
        features = self.join_features(left, mark, right)
        return self.ops.score("join", features) > self.ops.score("keep", features)

    # lines

    def line_values(self, page: "Page", k: int) -> tuple:
        """What ``line_features`` names."""
        x = page.lines[k]
        s = x.strip(" \f\t")
        number = k in page.number_set and not (s[:1] in "-" and not s.endswith("-") and not s[1:].strip().isdigit())
        before, after = page.before(k), page.after(k)
        cut = before is not None and not page.ends[before]
        low = after is not None and (c := page.lines[after].lstrip()[:1]).isalpha() and not c.isupper()
        title = page.is_title(k)
        upper = s.isupper()
        value = (page._value(s) or 0) if number else 0
        return (
            len(s) < 0.75 * page.width, page.ends[k] and not title, "none" if not number else "year" if YEAR.fullmatch(s) else "small" if value <= 12 and s.isalnum() else "page",
            (k == 0 or not page.lines[k - 1].strip()) and (k + 1 >= len(page.lines) or not page.lines[k + 1].strip()), page.in_sequence(k), "cut" if cut else "ended", low, page.place.get(k, -1) >= len(page.filled) - 1,
            "upper" if upper else "title" if s[:1].isupper() or s[:1] in "“\"0123456789" else "lower", page.head(k) is not None, len(s) <= page.width, number, title, page.close(s.lower(), PARTS_OF[len(s)]) if len(s) in PARTS_OF else False, page.near_number(k),
            before is None, "\f" in x, x.startswith("      "), page.is_twin(k), page.blanks(k), min(4, len(s.split(None, 4))), page.unnumbered, "," in s[-6:] and YEAR_END.search(s) is not None, not any(map(str.isalnum, s)), s[:1] == "[" and not number,
        )

    def line_features(self, page: "Page", k: int) -> list[str]:
        return line_names(self.line_values(page, k))

    def kinds(self, page: "Page") -> list[str]:
        """The kind of every line; blank lines are text."""
        out = ["text"] * len(page.lines)
        for k in page.filled:
            values = self.line_values(page, k)
            kind = self.kind_of.get(values)
            if kind is None:
                if len(self.kind_of) > 100_000:
                    self.kind_of.clear()
                kind = self.kind_of[values] = self.lines.best(line_names(values))
            out[k] = kind
        return out


def char_names(values: tuple) -> list[str]:
    read, printed, ratio, own, other, size, where, short, mixed, listed = values
    odd = not read.isalpha()
    return [
        "bias", f"op={read}>{printed}", f"ratio={ratio}", f"ratio={ratio},odd={odd}", f"own={own}", f"other={other}", f"len={size}",
        f"odd={odd},{where}", f"own={own},other={other}", f"ops={read}>{printed},ratio={ratio // 4}", f"op={read}>{printed},own={min(3, int(own))}",
        *(f"ratio>={k}" for k in range(2, ratio + 1, 2)), f"short={short},odd={odd}", f"mixed={mixed}", f"listed={listed},odd={odd}",
    ]


def line_names(values: tuple) -> list[str]:
    short, stops, band, alone, seq, gap, low, last, case, numbered, fits, number, title, part, near, first, feed, indented, twin, blanks, words, style, year, stars, bracket = values
    plain = short and not stops and case != "lower"
    base = f"short={short},ended={stops}"
    return [
        "bias", base, f"num={band},alone={alone},seq={seq}", f"num={band},gap={gap},low={low}", f"num={band},last={last}", f"case={case},{base}", f"numbered={numbered},fits={fits}", f"numbered={numbered},gap={gap},low={low}", f"number={number}", f"number={number},seq={seq}", f"title={title},{base}", f"part={part},{base}", f"near={near},plain={plain}",
        f"gap={gap},low={low},plain={plain}", f"first={first},plain={plain}", f"feed={feed},plain={plain}", f"indented={indented},plain={plain}", f"twin={twin},plain={plain}", f"alone={alone},gap={gap},plain={plain},near={near}",
        f"blank2={blanks},plain={plain},low={low}", f"title={title},near={near},first={first}", f"part={part},near={near},gap={gap},alone={alone},first={first}", f"upper={case == 'upper'},words={words},plain={plain}",
        f"style={style},title={title},plain={plain},alone={alone},gap={gap}", f"year={year}", f"stars={stars}", f"bracket={bracket}",
    ]


class Page:
    """The lines of one text with what their place tells."""

    def __init__(self, text: str, title: str | None):
        self.lines = text.split("\n")
        sizes = sorted(len(x) for x in self.lines if x.strip())
        self.width = sizes[int(len(sizes) * 0.85)] if sizes else 1
        self.title = self.key(title or "")
        self.filled = [k for k, x in enumerate(self.lines) if x.strip(" \f\t\r")]
        self.place = {k: i for i, k in enumerate(self.filled)}
        self.numbers = [k for k in self.filled if PAGE_LINE.match(self.lines[k])]
        self.number_set = set(self.numbers)
        values = [(k, self._value(self.lines[k])) for k in self.numbers]
        self.sequence = {k for (k, a), (j, b) in zip(values, values[1:]) if a and b == a + 1} | {j for (k, a), (j, b) in zip(values, values[1:]) if a and b == a + 1}
        self.matched = {k: NUMBERED_HEAD.match(x) if "  " in (x := self.lines[k]) or "|" in x or not x.isprintable() and GAP_OR_BAR.search(x) else None for k in self.filled}
        self.heads = {k: m for k, m in self.matched.items() if m and len(self.lines[k].strip()) <= self.width}
        self.keys: dict[int, str] = {}
        self.ends = {k: ended(self.lines[k]) for k in self.filled}
        self.twins: Counter[str] = Counter(self.key_at(k) for k in self.filled if not self.ends[k] and len(self.lines[k].strip()) < 0.75 * self.width)
        self.twice = {key for key, n in self.twins.items() if n > 1}
        self.unnumbered = not self.numbers and not self.heads

    def key_at(self, k: int) -> str:
        got = self.keys.get(k)
        if got is None:
            m = self.matched[k]
            got = self.keys[k] = self._letters((m.group("t") or m.group("u")) if m else self.lines[k])
        return got

    def is_twin(self, k: int) -> bool:
        return bool(self.twice) and self.key_at(k) in self.twice

    def head(self, k: int):
        return self.matched[k]

    @staticmethod
    def _value(line: str) -> int | None:
        s = re.sub(r"(?i)page|seite|página|pág\.|p\.", "", line)
        m = re.search(r"[\dlIOoSB]+", s)
        if m and any(map(str.isdigit, m.group())) or m and m.group()[0] == "l" and set(m.group()) <= {"l", "O"}:
            return int(m.group().translate(LIKE_DIGITS))
        m = re.search(r"[ivxlc]+", s.lower())
        if not m:
            return None
        v = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in m.group()]
        return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))

    @staticmethod
    def _letters(s: str) -> str:
        if s.isascii():
            return s.lower().encode().translate(ASCII_LETTERS, ASCII_OTHER).decode()
        s = s.lower()
        for a, b in LIKE_LETTERS:
            s = s.replace(a, b)
        return "".join(filter(str.isalnum, s))

    @classmethod
    def key(cls, s: str) -> str:
        m = NUMBERED_HEAD.match(s)
        return cls._letters((m.group("t") or m.group("u")) if m else s)

    @staticmethod
    def close(s: str, others) -> bool:
        return any(sum(map(ne, s, o)) <= max(1, len(s) // 8) for o in others)

    def is_title(self, k: int) -> bool:
        title = self.title
        if not title or not self.matched[k] and len(self.lines[k].encode("ascii", "ignore").translate(None, ASCII_OTHER)) > len(title) + 2:
            return False
        key = self.key_at(k)
        if not key or abs(len(key) - len(title)) > 2:
            return False
        if key == title:
            return True
        return sum(map(ne, key, title)) + abs(len(key) - len(title)) <= max(1, len(key) // 6) or len(key) > 6 and key[: len(key) // 2] == title[: len(key) // 2]

    def in_sequence(self, k: int) -> bool:
        return k in self.sequence

    def before(self, k: int) -> int | None:
        """The nearest line above that isn't blank and not only a page number."""
        i = self.place.get(k, 0) - 1
        while i >= 0 and (self.filled[i] in self.number_set or self.filled[i] in self.heads):
            i -= 1
        return self.filled[i] if i >= 0 else None

    def after(self, k: int) -> int | None:
        i = self.place.get(k, -1) + 1
        while 0 < i < len(self.filled) and (self.filled[i] in self.number_set or self.filled[i] in self.heads):
            i += 1
        return self.filled[i] if 0 < i < len(self.filled) else None

    def near_number(self, k: int) -> bool:
        return k - 1 in self.number_set or k + 1 in self.number_set and k + 1 < len(self.lines) - 1 or k - 2 in self.number_set and not self.lines[k - 1].strip()

    def blanks(self, k: int) -> int:
        n = 0
        while k - n - 1 >= 0 and not self.lines[k - n - 1].strip() and n < 2:
            n += 1
        return n


# --- training pages ------------------------------------------------------------------------------------------------


def _misread(word: str, rng: random.Random, learnt: tuple[tuple[str, str], ...] = (), common: int = 15) -> str | None:
    """``word`` with one group misread: by a listed confusion, now and then by a digit or sign that is none of them."""
    if rng.random() < 0.08 and len(word) > 3:
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + rng.choice(SIGNS) + word[at + rng.choice((1, 1, 1, 0)) :]
    pairs = [(a, b) for a, b in (*MISREAD[: common if rng.random() < 0.9 else len(MISREAD)], *learnt) if a in word and a]
    if not pairs or len(word) < 2:
        return None
    a, b = rng.choice(pairs)
    at = rng.choice([i for i in range(len(word)) if word.startswith(a, i)])
    out = word[:at] + b + word[at + len(a) :]
    return out if out != word else None


def misreadings(word: str, n: int, learnt: tuple[tuple[str, str], ...] = (), common: int = 15) -> Counter[str]:
    """What ``n`` draws of ``_misread`` make of ``word``, with how often; drawn at once, the same for a word each time."""
    out: Counter[str] = Counter()
    rng = np.random.default_rng(xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))
    sign = 0.08 * (len(word) > 3)

    def deal(k: int, made: list[tuple[str, float]]) -> None:
        if k and made:
            p = np.array([x for _, x in made])
            for (w, _), m in zip(made, rng.multinomial(k, p / p.sum())):
                if m and w != word:
                    out[w] += int(m)

    signs, few, many = rng.multinomial(n, (sign, 0.9 * (1 - sign), 0.1 * (1 - sign))).tolist()
    if signs:
        deal(signs, [(word[:at] + c + word[at + gone :], 3.0 if gone else 1.0) for at in range(1, len(word) - 1) for c in SIGNS for gone in (1, 0)])
    for k, table in ((few, (*MISREAD[:common], *learnt)), (many, (*MISREAD, *learnt))):
        if k and len(word) > 1:
            places = [(a, b, [i for i in range(len(word)) if word.startswith(a, i)]) for a, b in table if a and a in word]
            deal(k, [(word[:i] + b + word[i + len(a) :], 1 / len(at)) for a, b, at in places for i in at])
    return out


def _number(n: int, rng: random.Random, style: str) -> str:
    s = str(n)
    if rng.random() < 0.15:
        s = s.replace("1", "l").replace("0", "O")
    roman = "".join(("x" * (n % 40 // 10), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10])) or "x"
    return {"bare": s, "dash": f"— {s} —", "hyphen": f"- {s} -", "dot": f"· {s} ·", "bracket": f"[{s}]", "of": f"Page {s} of {n + 80}", "roman": roman, "right": " " * 30 + s}[style]


def set_pages(text: str, title: str, book: str, part: str, rng: random.Random) -> tuple[list[str], list[str], list[str | None]]:
    """(lines, kinds, rest of the word split at each line's end) of ``text`` as scanned pages of one layout."""
    width, height = rng.randint(48, 76), rng.randint(7, 30)
    mark = rng.choice(["-", "-", "‐", "­", "¬", "- "])
    body: list[tuple[str, str | None]] = []
    for paragraph in text.split("\n"):
        line = ""
        words = paragraph.split()
        for w in words:
            if not line:
                line = w
                continue
            if len(line) + 1 + len(w) <= width:
                line += " " + w
                continue
            room = width - len(line) - 2
            if "-" in w[1:-1] and w.index("-") < room:
                at = w.index("-") + 1
                body.append((line + " " + w[:at], None))
                line = w[at:]
            elif room >= 2 and len(w) >= 5 and w.isalpha() and rng.random() < 0.6:
                at = min(room, len(w) - 2)
                body.append((line + " " + w[:at] + mark, w[at:]))
                line = w[at:]
            else:
                body.append((line, None))
                line = w
        body.append((line, None))
    layout = rng.choice(["foot", "foot", "foot+head", "foot+head", "bar", "left", "head", "none"])
    style = rng.choice(["bare", "dash", "hyphen", "dot", "bracket", "of", "roman", "right"])
    case = rng.choice([str, str, str.upper])
    pad, feed, gap = rng.choice(["", "", " " * 8]), rng.random() < 0.2, rng.random() < 0.5
    names = [rng.choice([book, book, part]), title]
    n = rng.randint(2, 380)
    lines: list[str] = []
    kinds: list[str] = []
    rests: list[str | None] = []

    def put(x: str, kind: str, rest: str | None = None) -> None:
        lines.append(x)
        kinds.append(kind)
        rests.append(rest)

    def space() -> None:
        for _ in range(rng.choice([1, 1, 2]) if gap else 0):
            put("", "text")

    for p, a in enumerate(range(0, len(body), height)):
        head = case(names[p % 2])
        if rng.random() < 0.15:
            head = head.replace("E", "F", 1).replace("o", "0", 1)
        if layout in ("foot+head", "head"):
            put(("\f" if feed else "") + pad + head, "header")
            space()
        elif layout == "bar":
            put(("\f" if feed else "") + f"{head} | {n}", "header")
            space()
        elif layout == "left":
            put(("\f" if feed else "") + (f"{n}    {head}" if p % 2 else f"{head}    {n}"), "header")
            space()
        for x, rest in body[a : a + height]:
            put(x, "text", rest)
        if layout in ("foot", "foot+head"):
            space()
            put(_number(n, rng, style), "page_no")
        elif layout != "none":
            space()
        n += 1
    return lines, kinds, rests


def rare_words(tokens: set[str], editor: Editor) -> set[str]:
    """Words of pages that the corpus hardly has."""
    return {w for token in tokens for w in WORD.findall(token) if len(w) > 4 and w.isalpha() and w.islower() and editor.n(w) <= 2}


def vote(w: str, editor: Editor) -> tuple[str, str] | None:
    """(read, printed) of the only operation that turns ``w`` into a common word."""
    counts, least, found = editor.view, 30 * max(1, editor.n(w)), None
    for i in range(len(w) + 1):
        for size in (0, 1, 2):
            read = w[i : i + size]
            if len(read) == size:
                head, tail = w[:i], w[i + size :]
                for x in (*alphabet(w[0]), *([""] if size == 1 else [])):
                    if x != read and counts[_slot(head + x + tail)] >= least:
                        if found not in (None, (read, x)):
                            return None
                        found = read, x
    return found


def elected(votes: dict[tuple[str, str], int]) -> tuple[tuple[str, str], ...]:
    """(printed, read) of confusions that the table lacks and enough words voted for."""
    known = {(read, printed) for printed, read in MISREAD}
    new = {k: n for k, n in votes.items() if k not in known}
    total, others = sum(new.values()), max(1, len(new) - 1)
    return tuple(sorted((printed, read) for (read, printed), n in new.items() if n >= max(VOTES, ABOVE * (total - n) / others)))


def learn_confusions(pages: list[str], counts: np.ndarray) -> tuple[tuple[str, str], ...]:
    """(printed, read) of confusions that the table lacks but pages show: rare words that one operation alone turns into a
    common word vote for it."""
    editor = Editor(counts)
    rare = rare_words({token for text in pages for token in BROKEN.sub("", text).split()}, editor)
    return elected(Counter(v for w in rare if (v := vote(w, editor))))


def page_examples(editor: Editor, text: str, own: str | None, out: Counter) -> None:
    """Count the examples of (values or features, label) that ``text`` gives as pages of one layout, the same each time."""
    rng = random.Random(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")))
    found = NAME.search(text, rng.randrange(len(text))) or NAME.search(text)
    name = found.group() if found else "Town"
    words = text.split()
    at = rng.randrange(len(words))
    phrase = " ".join(words[at : at + rng.randint(2, 5)]).strip(".,;:!?…\"”“«»").title() or "Chapter 1"
    title = own if own and own.isprintable() else phrase
    book = phrase if rng.random() < 0.3 else rng.choice(["The {} Letters", "Letters from {}", "A Summer in {}", "The Clock of {}", "Les portes de {}", "El jardín de {}", "Der Garten von {}"]).format(name)
    extra = text
    if rng.random() < 0.4 and "\n\n" in text:  # headings of the text itself
        own_heading = rng.choice(["* * *", f"{name}, {rng.randint(1800, 1950)}", f"The {name} Papers", "Interlude", f"Part {rng.choice(['IV', 'V', 'IX', 'XI', 'II'])}", f"Les papiers de {name}", "[sic]", "- iv", f"What {name} saw", str(rng.randint(1700, 1990)), str(rng.randint(1, 12))])
        extra = text.replace("\n\n", f"\n\n{own_heading}\n\n", 1)
    lines, kinds, rests = set_pages(extra, title, book, rng.choice(PARTS), rng)
    page = Page("\n".join(lines), title if rng.random() < 0.9 else None)
    for k in page.filled:
        out["line", editor.line_values(page, k), kinds[k]] += 1
    flow = [k for k in page.filled if kinds[k] == "text"]
    for k, j in zip(flow, flow[1:]):
        if lines[k].rstrip(" ")[-1:] in HYPHENS and (m := HYPHEN.search(lines[k])) and (r := re.match(r"\s*([^\W\d_]+)", lines[j])):
            out["join", tuple(editor.join_features(m.group(1), m.group(2), r.group(1))), "join" if rests[k] else "keep"] += 1


def word_examples(editor: Editor, word: str, n: int, out: Counter) -> None:
    """Count the examples of (values, label, operation) that ``n`` times ``word`` give, as printed and each misread once."""
    if not editor.n(word):
        return
    for noisy, times in ((word, n), *misreadings(word, n, editor.learnt).items()):
        for option in editor.options(noisy):
            kind = operation(option[1], option[2])
            out[editor.char_values(noisy, option), kind if noisy != word and option[3] == word else "keep", kind] += times


def words_of(tokens: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for token, n in tokens.items():
        for w in WORD.findall(token):
            out[w] += n
    return out


def trained(counts: np.ndarray, learnt: tuple[tuple[str, str], ...], lines: Counter, ops: Counter) -> Editor:
    """The models from examples (features, label, labels that come into question) with their counts."""
    editor = Editor(counts, learnt)
    editor.lines.train(lines, rounds=6)
    editor.ops.train(ops, rounds=8)
    return editor


def key_of(kind: str, values: tuple) -> str:
    """An example as a short string."""
    return json.dumps((kind, *values))


def features_of(key: str) -> list[str]:
    kind, *values = json.loads(key)
    return {"line": line_names, "join": list, "char": char_names}[kind](values)


def train_editor(rows: list[tuple[str, str | None]], counts: np.ndarray, learnt: tuple[tuple[str, str], ...] = ()) -> Editor:
    """The models from clean rows (text, title) and confusions beside those of the table."""
    editor = Editor(counts, learnt)
    pages, chars, lines, ops = Counter(), Counter(), Counter(), Counter()
    for text, title in rows:
        page_examples(editor, text, title, pages)
    for w, n in words_of(Counter(w for text, _ in rows for w in text.split())).items():
        word_examples(editor, w, n, chars)
    for (kind, values, label), n in pages.items():
        (lines if kind == "line" else ops)[key_of(kind, values), label, editor.lines.labels if kind == "line" else ("keep", "join")] += n
    for (values, label, kind), n in chars.items():
        ops[key_of("char", values), label, ("keep", kind)] += n
    return trained(counts, learnt, lines, ops)


# --- use -----------------------------------------------------------------------------------------------------------


def wrapped(text: str) -> bool:
    """Whether lines end inside sentences: a small letter goes on behind a line end, or a hyphen stands at one; in scripts
    without case, most lines are full and go on."""
    caseless, i, n = 0, text.find("\n"), len(text)
    while 0 <= i < n - 1:
        at = i - 2 if text[i - 1 : i] == " " else i - 1
        before, after = text[at] if at >= 0 else "\n", text[i + 1]
        if before in HYPHENS and at > 0 and text[at - 1].isalpha():
            return True
        if after.isalpha() and (before.isalpha() or before == ","):
            if after.islower() and (before == "," or before.islower()):
                return True
            caseless += after.lower() == after.upper()
        i = text.find("\n", i + 1)
    if caseless < 3:
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    width = sorted(map(len, lines))[int(len(lines) * 0.85)]
    return caseless * 3 > len(lines) and sum(len(x) > 0.8 * width for x in lines) * 5 >= 2 * len(lines)


def noise(editor: Editor, text: str, title: str | None) -> tuple[list[tuple[int, str]], str]:
    """((line, kind) of every case, the text as continuous paragraphs)."""
    if "\n" not in text or not wrapped(text):
        return [], text
    text = DIRT.sub("", text)
    page = Page(text, title)
    kinds = editor.kinds(page)
    found = [(k, kind) for k, kind in enumerate(kinds) if kind != "text"]
    flow = [k for k, kind in enumerate(kinds) if kind == "text" and page.lines[k].strip()]
    bad: set[int] = set()
    out: list[str] = []
    carry, carry_line = "", -1

    def repaired(words_of: str, at: int, start: int = 0, joined: tuple[int, int] | None = None) -> str:
        pieces, last = [], 0
        for m in WORD.finditer(words_of):
            w = m.group()
            todo = editor.edits(w)
            if todo:
                fixed = w
                for i, read, printed in todo:
                    fixed = fixed[:i] + printed + fixed[i + len(read) :]
                    where = at if joined is None or m.start() or i >= joined[0] else joined[1]
                    bad.add(where)
                pieces.append(words_of[last : m.start()] + fixed)
                last = m.end()
        return "".join(pieces) + words_of[last:]

    for pos, k in enumerate(flow):
        line = page.lines[k].strip(" \f\t\r")
        joined = (len(carry), carry_line) if carry else None
        line, carry = carry + line, ""
        m = HYPHEN.search(page.lines[k]) if page.lines[k].rstrip(" ")[-1:] in HYPHENS else None
        if m and pos + 1 < len(flow) and (r := re.match(r"[\s\f]*([^\W\d_]+(?:[†0-9][^\W_]*)?)", page.lines[flow[pos + 1]])):
            if editor.joins(m.group(1), m.group(2), r.group(1)):
                found.append((k, "split_word"))
                carry, carry_line = m.group(1), k
                line = line[: len(line.rstrip(" ")) - len(m.group(1)) - 1]
            else:
                carry, carry_line = m.group(1) + "-", k
                line = line[: len(line.rstrip(" ")) - len(m.group(1)) - 1]
        fixed = repaired(line, k, joined=joined)
        new = pos > 0 and not page.lines[k - 1].strip() and kinds[k - 1] == "text" and ended(page.lines[flow[pos - 1]]) and not joined
        out.append(("\n\n" if new else " " if out and not joined else "") + fixed.rstrip())
        if carry and out[-1].strip():
            out[-1] += " "
    found += [(k, "misread") for k in bad]
    return sorted(set(found)), "".join(out).strip()


FOUND = T.StructType([T.StructField("chapter_id", T.LongType()), T.StructField("line_no", T.LongType()), T.StructField("kind", T.StringType())])
TEXT = T.StructType([T.StructField("chapter_id", T.LongType()), T.StructField("text", T.StringType())])


CLEAN = re.compile("[a-z]{3}")
LOW_WRAP = re.compile("\n(?=[a-z])(?:(?<=[a-z,]\n)|(?<=[a-z,] \n))")
DIRTY = re.compile("[\u0300-\u200f\u2041-\uffff\u0080-\u009f]")


def is_clean(text: str) -> bool:
    """Whether a text can be set as pages: Latin small letters, no hard line ends, nothing that wrong decoding leaves."""
    if "\n" in text and LOW_WRAP.search(text) or not CLEAN.search(text):
        return False
    return text.isascii() or not ("Ã" in text or "â€" in text or DIRTY.search(text))


KEYS = T.StructType([T.StructField("kind", T.StringType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType()), T.StructField("n", T.LongType())])
#: Different examples and words that a task holds before it hands them on.
HELD = 50_000


def _batch(rows: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    columns = [list(c) for c in zip(*rows)] or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["kind", "key", "label", "n"])


def _summed(df: DataFrame, run) -> DataFrame:
    return df.mapInArrow(run, KEYS).groupBy("kind", "key", "label").agg(F.sum("n").alias("n"))


def gathered(df: DataFrame, kept, text_col: str, title_col: str) -> DataFrame:
    """(kind, key, label, n) of all rows: ``line`` and ``join`` examples and the words of clean ones, rare words of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(kept.value)
        found: Counter[tuple] = Counter()
        tokens: Counter[str] = Counter()
        pages: set[str] = set()

        def fold() -> Iterator[pa.RecordBatch]:
            rows = [(kind, key_of(kind, values), label, n) for (kind, values, label), n in found.items()]
            rows += [("word", w, "", n) for w, n in words_of(tokens).items() if not SPACELESS.search(w)]
            rows += [("rare", w, "", 1) for w in rare_words(pages, editor)]
            for x in (found, tokens, pages):
                x.clear()
            for a in range(0, len(rows), 10_000):
                yield _batch(rows[a : a + 10_000])

        for batch in batches:
            for text, title in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or text.isspace():
                    continue
                if is_clean(text):
                    page_examples(editor, text, title, found)
                    tokens.update(text.split())
                if "\n" in text and wrapped(text):
                    pages.update(BROKEN.sub("", text).split())
                if len(found) + len(tokens) + len(pages) > HELD:
                    yield from fold()
        yield from fold()

    return _summed(df.select(F.col(text_col).alias("text"), F.col(title_col).alias("title")).where("text IS NOT NULL"), run)


def fitted(df: DataFrame, id_col: str, text_col: str, title_col: str) -> Editor:
    """Word counts, confusions and both models, each from all rows of ``df``; two readings.

    The driver gets the counts, confusions with their votes and the different examples, which have a limited number of
    features. Fit once and hand the editor to ``scan_noise`` and ``repaired_pages`` for any number of tables.
    """
    source = spread(df)
    sc = df.sparkSession.sparkContext
    counts = word_counts(source, text_col)
    kept = sc.broadcast(counts)
    rows = gathered(source, kept, text_col, title_col).persist()
    part = lambda kind: rows.where(F.col("kind") == kind).repartition(2 * sc.defaultParallelism, "key")

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(kept.value)
        for batch in batches:
            yield _batch([("vote", *v, 1) for w in batch["key"].to_pylist() if (v := vote(w, editor))])

    lines, ops = Counter(), Counter()
    for r in rows.where("kind IN ('line', 'join')").collect():
        if r.kind == "line":
            lines[r.key, r.label, ("text", "header", "page_no")] = r.n
        else:
            ops[r.key, r.label, ("keep", "join")] = r.n
    learnt = elected({(r.key, r.label): r.n for r in _summed(part("rare"), votes).collect()})

    def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor = Editor(kept.value, learnt)
        found: Counter[tuple] = Counter()

        def fold() -> pa.RecordBatch:
            out = _batch([(kind, key_of("char", values), label, n) for (values, label, kind), n in found.items()])
            found.clear()
            return out

        for batch in batches:
            for w, n in zip(batch["key"].to_pylist(), batch["n"].to_pylist()):
                word_examples(editor, w, n, found)
                if len(found) > HELD:
                    yield fold()
        yield fold()

    for r in _summed(part("word"), chars).collect():
        ops[r.key, r.label, ("keep", r.kind)] = r.n
    rows.unpersist()
    kept.unpersist()
    return trained(counts, learnt, lines, ops)


def _mapped(df: DataFrame, editor: Editor, id_col: str, text_col: str, title_col: str, cases: bool) -> DataFrame:
    kept = df.sparkSession.sparkContext.broadcast((editor.counts, editor.learnt, editor.lines.w, editor.ops.w))  # of fixed size, see BITS

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        own = Editor(*kept.value[:2])
        own.lines.w, own.ops.w = kept.value[2:]
        for ids, texts, titles in columns:
            out: list[list] = [[], [], []] if cases else [[], []]
            for i, text, title in zip(ids, texts, titles):
                if not text or text.isspace():
                    continue
                found, clean = noise(own, text, title)
                if cases:
                    out[0] += [i] * len(found)
                    out[1] += [k for k, _ in found]
                    out[2] += [kind for _, kind in found]
                else:
                    out[0].append(i)
                    out[1].append(clean)
            yield out

    slim = df.select(F.col(id_col).cast("long"), F.col(text_col), F.col(title_col)).where(F.col(text_col).isNotNull())
    return map_batches(spread(slim), run, FOUND if cases else TEXT)


def scan_noise(df: DataFrame, editor: Editor, id_col: str, text_col: str, title_col: str) -> DataFrame:
    """(id, line_no, kind) of every case in pages of ``df``, read once."""
    return _mapped(df, editor, id_col, text_col, title_col, True)


def repaired_pages(df: DataFrame, editor: Editor, id_col: str, text_col: str, title_col: str) -> DataFrame:
    """Every non-blank text as continuous paragraphs: (id, text)."""
    return _mapped(df, editor, id_col, text_col, title_col, False)


COLUMNS = ("chapter_id", "content_text", "chapter_title")


def p5_found(spark, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters")
    return scan_noise(chapters, fitted(chapters, *COLUMNS), *COLUMNS)


def p5_repaired(spark, sf_dir: str) -> DataFrame:
    chapters = table(spark, sf_dir, "chapters")
    return repaired_pages(chapters, fitted(chapters, *COLUMNS), *COLUMNS)


QUERIES = {"p5_found": p5_found, "p5_repaired": p5_repaired}
