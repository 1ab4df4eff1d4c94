"""Visually identical text with different characters.

A text's skeleton: canonical decomposition, every character replaced by its prototype, decomposition again. Prototypes
come from the public look-alike table of Unicode, as the ICU library that Spark ships holds it (read once on the driver;
its size is that of Unicode), as far as it joins letters of different scripts, and from a rule over the Unicode character data: width, font, ligature and presentation
forms decompose, invisible characters vanish, every space is a space. The public table takes 1, l and I, or 0 and O, for
one; here case, digits and letters count, so a letter's prototype is the member of its look-alike class of its own
case, and ASCII characters and digits are their own. Raised and circled forms keep their own look. Two texts look the same exactly
when their skeletons are equal.

Null and blank texts are left out of pairs. Texts of any length are read whole. Identically stored texts form one class
and are no pair. Extra columns don't matter.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from foliant.llm.common import checkpointed, map_batches, spread, table

# Letters of Cyrillic and Greek (and hyphens) drawn like a Latin letter, beside that letter.
ALIKE = {
    "Cyrillic": "аaеeоoрpсcуyхxіiјjѕsԁdһhԛqԝwѵvӏl" "АAВBЕEЅSІIЈJКKМMНHОOРPСCТTХXУYԌGԚQԜWҮYӀI",
    "Greek": "οoνvρpαaιiγy" "ΑAΒBΕEΖZΗHΙIΚKΜMΝNΟOΡPΤTΥYΧX",
    "other": "‐-‑-⁃-−-ⅼlօoսuոnɡgıiᴏoᴠvᴄcᴢzՏSꓳOꓴUꓲI",
}
# Compatibility forms whose look differs from what they decompose to.
KEPT_TAGS = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>")
KEPT = "ſªº№℀℁℅℆"


# The letters of the two scripts that share most letters with Latin.
BASIC = {"CYRILLIC": range(0x400, 0x460), "GREEK": range(0x391, 0x3CA)}
LISTED = frozenset(c for row in ALIKE.values() for c in row[::2])


def script(c: str) -> str:
    """The script of a letter: the first word of its name."""
    return unicodedata.name(c, "").partition(" ")[0]


def public_classes(spark: SparkSession) -> dict[str, str]:
    """Of each letter its class in the public look-alike table: the skeleton that ICU gives it alone."""
    letters = [c for c in map(chr, range(0x21, 0x1FFFF)) if unicodedata.category(c) in ("Lu", "Ll", "Lt", "Lo")]
    checker = getattr(spark._jvm, "com.ibm.icu.text.SpoofChecker$Builder")().build()
    return dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))


def public_prototypes(classes: dict[str, str]) -> dict[int, str]:
    """Prototypes by the public classes: for a cased letter the member of its class of its own case, for one without
    case the class's own sign; ASCII first, then Latin, Cyrillic and Greek.

    The table is wider than equal looks: within one script two letters are two letters; letters that join change their
    shape; and Greek and Cyrillic letters that only slant like a Latin one (such as the fourth of the Cyrillic alphabet
    and r) keep their look, since between these scripts and ASCII the short list holds.
    """

    def rank(c: str) -> tuple[bool, bool, bool, int]:
        o = ord(c)
        return not c.isascii(), o >= 0x250, not any(o in letters for letters in BASIC.values()), o

    def slanted(c: str) -> bool:
        return 0x370 <= ord(c) < 0x460 and c not in LISTED

    plain = {c: look for c, look in classes.items() if unicodedata.bidirectional(c) == "L" and not unicodedata.decomposition(c) and c not in KEPT}
    least: dict[tuple[str, str, bool], str] = {}
    for c, look in plain.items():
        own = (look, unicodedata.category(c), slanted(c))
        least[own] = min(least.get(own, c), c, key=rank)
    table = {}
    for c, look in plain.items():
        kind = unicodedata.category(c)
        to = look if kind == "Lo" else min((least[k] for k in ((look, kind, False), (look, kind, True)) if k in least and not (slanted(c) and least[k].isascii())), key=rank)
        if not c.isascii() and to != c and len(to) == 1 and to in classes and unicodedata.bidirectional(to) == "L" and script(c) != script(to):
            table[ord(c)] = to
    return table


def _prototypes(classes: dict[str, str]) -> dict[int, str]:
    table: dict[int, str] = {}
    for o in range(0xA0, min(sys.maxunicode, 0x2FFFF)):
        c = chr(o)
        kind = unicodedata.category(c)
        if kind in ("Cf",) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180F or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            table[o] = ""
        elif kind == "Zs":
            table[o] = " "
        else:
            d = unicodedata.decomposition(c)
            if d.startswith("<") and not d.startswith(KEPT_TAGS) and c not in KEPT:
                full = unicodedata.normalize("NFKD", c)
                if not full.startswith(" "):
                    table[o] = full
    alike = public_prototypes(classes) | {ord(a): b for row in ALIKE.values() for a, b in zip(row[::2], row[1::2])}
    for o, full in table.items():
        table[o] = full.translate(alike)
    table = alike | table
    for o in (*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F):
        table[o] = ""
    return table


_built: dict[str, str] = {}


def prototypes(spark: SparkSession | None = None) -> dict[str, str]:
    """Every character that isn't its own prototype, with its prototype, decomposed."""
    if not _built:
        classes = public_classes(spark or SparkSession.active())
        _built.update((chr(o), unicodedata.normalize("NFD", full)) for o, full in _prototypes(classes).items())
    return _built


def skeleton(text: str, protos: dict[str, str] | None = None) -> str:
    """The form shared by all texts that look like ``text``."""
    protos = prototypes() if protos is None else protos
    text = unicodedata.normalize("NFD", text)
    for c in protos.keys() & set(text):
        text = text.replace(c, protos[c])
    return unicodedata.normalize("NFD", text)


class Forms:
    """What puts a skeleton back into the letters of its own scripts."""

    def __init__(self, protos: dict[str, str]):
        self.protos = protos
        self.back: dict[str, dict[int, str]] = {}
        for c, to in sorted(protos.items(), reverse=True):
            if len(to) == 1 and to.isalpha() and not unicodedata.decomposition(c) and script(c) != script(to):
                self.back.setdefault(script(c), {})[ord(to)] = c
        for k, letters in BASIC.items():
            self.back[k] = {ord(protos.get(c, c)): c for c in map(chr, reversed(letters)) if len(protos.get(c, c)) == 1}
        kana = {x: c for k in ("KATAKANA",) for x, c in self.back.pop(k, {}).items()}
        for k in ("HIRAGANA", "CJK", "BOPOMOFO", "HANGUL", "LATIN"):
            self.back.pop(k, None)
        shared = {x for i, a in self.back.items() if i in BASIC for j, b in self.back.items() if j in BASIC and i != j for x in a if x in b}
        #: Letters that only one of these scripts has, with it.
        self.owner = {c: k for c in map(chr, range(0x370, 0x1FFFF)) if c not in protos and c.isalpha() and ord(c) not in shared and (k := script(c)) in self.back}
        self.owner |= {chr(x): k for k in BASIC for x in self.back[k] if x not in shared and script(chr(x)) != "LATIN"}
        images = {chr(x) for k in BASIC for x in self.back[k]}
        self.latin = re.compile("[" + "".join(c for c in map(chr, range(0x41, 0x7B)) if c.isalpha() and c not in images) + "]")
        self.word = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*")
        signs = "".join(map(chr, kana))
        self.kana, self.of_kana = kana, re.compile(rf"(?<=[ァ-ヺー])[{signs}]+|[{signs}]+(?=[ァ-ヺー])") if signs else None

    def one_form(self, text: str) -> str:
        s = skeleton(text, self.protos)
        if s.isascii():
            return s
        if self.of_kana:
            s = self.of_kana.sub(lambda m: m.group().translate(self.kana), s)
        if self.owner.keys().isdisjoint(s):
            return unicodedata.normalize("NFC", s)
        counts = Counter(map(self.owner.get, s))
        counts.pop(None, None)
        main, n = min(counts.items(), key=lambda x: (-x[1], x[0]))
        home = main if n > len(self.latin.findall(s)) else None

        def put(m: re.Match) -> str:
            w = m.group()
            k = next((k for c in w if (k := self.owner.get(c))), None if self.latin.search(w) else home)
            return w.translate(self.back[k]) if k else w

        return unicodedata.normalize("NFC", self.word.sub(put, s))


_forms: list[Forms] = []


def one_form(text: str, protos: dict[str, str] | None = None) -> str:
    """A readable form, a function of the skeleton alone: words take the script of their unmistakable letters."""
    protos = prototypes() if protos is None else protos
    if not _forms or _forms[0].protos is not protos:
        _forms[:] = [Forms(protos)]
    return _forms[0].one_form(text)


KEYS = T.StructType([T.StructField("id", T.LongType()), T.StructField("skeleton_key", T.BinaryType()), T.StructField("stored_key", T.BinaryType())])


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, 128-bit key of the skeleton, 128-bit key of the text as stored) of every non-blank text."""
    shared = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))  # as large as Unicode makes it, not the data

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        digest, protos = xxhash.xxh3_128_digest, shared.value
        for ids, texts in columns:
            keep = [(i, t) for i, t in zip(ids, texts) if t and not t.isspace()]
            yield [
                [i for i, _ in keep],
                [digest(skeleton(t, protos).encode("utf-8", "surrogatepass")) for _, t in keep],
                [digest(t.encode("utf-8", "surrogatepass")) for _, t in keep],
            ]

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return map_batches(spread(slim), run, KEYS)


def look_classes(keys: DataFrame, group_cols: list[str]) -> DataFrame:
    """One row per look: (group columns, skeleton_key, class_id = its lowest id, n texts, whether stored in several ways)."""
    return keys.groupBy(*group_cols, "skeleton_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), (F.min("stored_key") != F.max("stored_key")).alias("several"))


def members(keys: DataFrame, group_cols: list[str]) -> DataFrame:
    """One row per text: (group columns, id, class_id, n texts of its look, whether the look is stored in several ways)."""
    on = [*group_cols, "skeleton_key"]
    return keys.join(look_classes(keys, group_cols), on).select(*group_cols, "id", "class_id", "n", "several")


def same_look_pairs(keys: DataFrame, group_cols: list[str], block: int = 50_000) -> DataFrame:
    """Pairs id_a < id_b of one skeleton whose stored forms differ.

    Only members of skeletons with several stored forms are joined, and one of the two sides of a large group is cut
    into blocks of about ``block`` rows, so no task gets a whole group however large it is.
    """
    keys = keys.select(*group_cols, "id", "skeleton_key", "stored_key")
    on = [*group_cols, "skeleton_key"]
    multi = look_classes(keys, group_cols).where("several").select(*on, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    found = keys.join(multi, on)
    left = found.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).select(*on, "part", F.col("id").alias("id_a"), F.col("stored_key").alias("stored_a"))
    right = found.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*on, "part", F.col("id").alias("id_b"), F.col("stored_key").alias("stored_b"))
    return left.join(right, [*on, "part"]).where("id_a < id_b AND stored_a <> stored_b").select(*group_cols, "id_a", "id_b")


def _keys(spark, sf_dir: str) -> DataFrame:
    """Keys of both fields, 48 bytes a text, kept so that the texts are read and reduced once."""
    books = keyed(table(spark, sf_dir, "books"), "id", "book_title").withColumn("field", F.lit("book_title"))
    chapters = keyed(table(spark, sf_dir, "chapters"), "chapter_id", "content_text").withColumn("field", F.lit("content_text"))
    return checkpointed(books.unionByName(chapters))


def p2_found(spark, sf_dir: str) -> DataFrame:
    return same_look_pairs(_keys(spark, sf_dir), ["field"])


def p2_classes(spark, sf_dir: str) -> DataFrame:
    """Every non-blank text with the class of its look: (field, id, class_id, n, several)."""
    return members(_keys(spark, sf_dir), ["field"])


FORMS = T.StructType([T.StructField("id", T.LongType()), T.StructField("form", T.StringType())])


def same_form(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form): every text in one consistent form; null and empty texts keep their value."""

    shared = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, texts in columns:
            yield [ids, [one_form(t, shared.value) if t else t for t in texts]]

    return map_batches(spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))), run, FORMS)


def p2_forms(spark, sf_dir: str) -> DataFrame:
    books = same_form(table(spark, sf_dir, "books"), "id", "book_title").withColumn("field", F.lit("book_title"))
    chapters = same_form(table(spark, sf_dir, "chapters"), "chapter_id", "content_text").withColumn("field", F.lit("content_text"))
    return books.unionByName(chapters).select("field", "id", "form")


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_forms": p2_forms}
