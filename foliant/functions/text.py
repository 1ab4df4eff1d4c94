"""Column functions over text: white space, sentences, slugs, file names, hrefs, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as a character class that Java, RE2 and Python read alike.
WS = r"\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = rf"[{WS}]"
BLANKS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Splits behind a terminal mark with white space after it, and at line breaks.
SEGMENT = rf"(?<=[.!?]){BLANK}+|\n+"


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(x, F.lit(BLANKS))


def normalize_ws(x: Column) -> Column:
    return strip(F.regexp_replace(x, rf"{BLANK}+", " "))


def word_count(x: Column) -> Column:
    """Number of tokens between white space; 0 for null."""
    return F.coalesce(F.regexp_count(x, F.lit(rf"[^{WS}]+")), F.lit(0)).cast("long")


def segments(x: Column) -> Column:
    return F.split(x, SEGMENT)


def filled_segments(x: Column) -> Column:
    return F.filter(F.transform(segments(x), strip), lambda s: s != "")


def first_sentence(x: Column, least: int = 50) -> Column:
    """struct(text, used): the segments that reach ``least`` characters together, and how many raw segments they took.

    Blank text gives ('', 0).
    """
    start = F.struct(F.lit(0).alias("chars"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("taken"))

    def step(a: Column, s: Column) -> Column:
        done = a["chars"] >= least
        s = strip(s)
        add = (~done) & (s != "")
        return F.struct(
            F.when(add, a["chars"] + F.length(s)).otherwise(a["chars"]).alias("chars"),
            F.when(done, a["used"]).otherwise(a["used"] + 1).alias("used"),
            F.when(add, F.concat(a["taken"], F.array(s))).otherwise(a["taken"]).alias("taken"),
        )

    def finish(a: Column) -> Column:
        return F.struct(normalize_ws(F.concat_ws(" ", a["taken"])).alias("text"), a["used"].alias("used"))

    empty = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))
    return F.when(x.isNull(), None).when(strip(x) == "", empty).otherwise(F.aggregate(segments(x), start, step, finish))


def replace_first_sentence(x: Column, used: Column, new: Column) -> Column:
    rest = F.filter(F.transform(F.slice(segments(x), used + 1, F.greatest(F.size(segments(x)) - used, F.lit(0))), strip), lambda s: s != "")
    return F.when(F.size(rest) == 0, new).otherwise(F.concat_ws(" ", new, F.concat_ws(" ", rest)))


def prepend_title(title: Column, body: Column) -> Column:
    return F.when(strip(F.coalesce(title, F.lit(""))) == "", body).otherwise(F.concat(strip(title), F.lit(". "), body))


def apply_edits(x: Column, edits: Column) -> Column:
    """Sentence k (from 1) becomes edits[k]; blank, equal and unknown ones change nothing, and no change keeps the text."""
    parts = filled_segments(x)
    changed = F.transform(parts, lambda s, i: F.when(strip(F.coalesce(F.try_element_at(edits, i + 1), F.lit(""))) != "", F.try_element_at(edits, i + 1)).otherwise(s))
    return F.when(changed == parts, x).otherwise(F.array_join(changed, " "))


def strip_parens_flat(x: Column) -> Column:
    return F.regexp_replace(x, r"\([^)]*\)", "")


def strip_parens_deep(x: Column, depth: int = 8) -> Column:
    """Innermost brackets go first, until none are left; after ``depth`` times it is looked whether any are."""
    pattern = r"\([^()]*\)"
    for _ in range(depth):
        x = F.regexp_replace(x, pattern, "")
    again = F.aggregate(F.sequence(F.lit(1), F.regexp_count(x, F.lit(r"\("))), x, lambda a, _: F.when(F.regexp_like(a, F.lit(pattern)), F.regexp_replace(a, pattern, "")).otherwise(a))
    return F.when(F.regexp_like(x, F.lit(pattern)), again).otherwise(x)


def collapse_dots(x: Column) -> Column:
    return F.regexp_replace(x, rf"\.{BLANK}*(?:\.{BLANK}*)+", ".")


def slugify(x: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("chapter")).otherwise(s)


def chapter_filename(number: Column, title: Column) -> Column:
    return F.format_string("%03d_%s.mp3", F.coalesce(number.cast("int"), F.lit(0)), slugify(title))


def episode_title(filename: Column) -> Column:
    """struct(index, title) of a file name like ``007_The_Road.mp3``; null for others."""
    pattern = r"(?i)^(\d+)_(.+)\.mp3$"
    parsed = F.struct(F.regexp_extract(filename, pattern, 1).cast("long").alias("index"), strip(F.translate(F.regexp_extract(filename, pattern, 2), "_", " ")).alias("title"))
    return F.when(filename.rlike(pattern), parsed)


def split_href(x: Column) -> Column:
    """struct(path, anchor): cut at the first ``#``; an empty anchor is null."""
    at = F.instr(x, "#")
    return F.struct(F.substring_index(x, "#", 1).alias("path"), F.when(at > 0, F.nullif(x.substr(at + 1, F.length(x)), F.lit(""))).alias("anchor"))


def sanitize_title(x: Column) -> Column:
    """Base name without blanks and slashes."""
    base = F.regexp_extract(F.regexp_replace(x, r"/+$", ""), r"([^/]*)$", 1)
    return F.regexp_replace(strip(base), r"[ /\\]", "")


def sanitize_name(x: Column) -> Column:
    """Base name without its last extension and without white space."""
    base = F.regexp_extract(x, r"([^/\\]*)$", 1)
    return F.regexp_replace(F.regexp_replace(base, r"\.[^.]+$", ""), BLANK, "")


def fixed_slices(x: Column, size: int) -> Column:
    """Slices of ``size`` code points; an empty text has none."""
    n = F.length(x)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), ((n - 1) / size).cast("int")), lambda i: x.substr(i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def split_at_delimiter(x: Column, upper: int) -> Column:
    """One cut behind the comma or semicolon nearest the middle (the left one of two) if longer than ``upper``."""
    s = strip(x)
    half = F.floor(F.length(s) / 2).cast("int")
    left = F.length(F.regexp_extract(F.left(s, half + 1), "(?s)^(.*[,;])", 1)) - 1  # at or before the middle, -1 for none
    right = half + F.length(F.regexp_extract(s.substr(half + 1, F.length(s)), "(?s)^([^,;]*[,;])", 1)) - 1
    best = F.when((left >= 0) & ((right < half) | (half - left <= right - half)), left).when(right >= half, right)
    two = F.filter(F.array(strip(s.substr(F.lit(1), best + 1)), strip(s.substr(best + 2, F.length(s)))), lambda p: p != "")
    return F.when(x.isNull(), None).when((F.length(s) <= upper) | best.isNull(), F.filter(F.array(s), lambda p: p != "")).otherwise(two)


def strip_code_fence(x: Column) -> Column:
    return strip(F.regexp_replace(strip(x), r"^```[A-Za-z0-9_-]*\s*|\s*```$", ""))


def split_comma_list(x: Column) -> Column:
    parts = F.filter(F.transform(F.split(x, ","), strip), lambda s: s != "")
    return F.when(F.size(parts) > 0, parts)


def syllables(word: Column) -> Column:
    return F.greatest(F.regexp_count(F.lower(word), F.lit("[aeiouy]+")), F.lit(1))


def quote_path(x: Column) -> Column:
    """Percent-encoding that keeps letters, digits, ``_.-~`` and slashes."""
    x = F.url_encode(x)
    for written, wanted in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        x = F.replace(x, F.lit(written), F.lit(wanted))
    return x


def numeric_key(x: Column) -> Column:
    """What a list is sorted by: the number, 0 for an empty sign, the largest exact integer for any other sign."""
    return F.when(F.trim(x) == "", 0).otherwise(F.coalesce(x.try_cast("long"), F.lit(9007199254740991))).cast("long")


def host_port(x: Column) -> Column:
    """struct(host, port): exactly one colon with a numeric port, else port 22."""
    one = (F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit("")))) == 1
    port = F.substring_index(x, ":", -1).try_cast("int")
    ok = one & port.isNotNull()
    return F.struct(F.when(ok, F.substring_index(x, ":", 1)).otherwise(x).alias("host"), F.when(ok, port).otherwise(22).alias("port"))


def is_true(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin("1", "true", "yes", "y", "on"), F.lit(False))


def strip_suffix(x: Column, suffix: str = "-tts") -> Column:
    return F.regexp_replace(F.lower(strip(x)), f"{suffix}$", "")


def pack_sentences(x: Column, most: int) -> Column:
    """Sentences packed up to ``most`` code points, oversize chunks cut at fixed width.

    A chunk begun by appending counts one code point more than one begun by an overflow.
    """
    parts = F.filter(F.transform(F.split(strip(x), rf"(?<=[.!?]){BLANK}+"), strip), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        over = (a["n"] + F.length(s) + 1 > most) & (F.size(a["cur"]) > 0)
        return F.struct(
            F.when(over, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]).alias("done"),
            F.when(over, F.array(s)).otherwise(F.concat(a["cur"], F.array(s))).alias("cur"),
            F.when(over, F.length(s)).otherwise(a["n"] + F.length(s) + 1).alias("n"),
        )

    packed = F.aggregate(parts, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]))
    return F.flatten(F.transform(packed, lambda c: F.when(F.length(c) > most, fixed_slices(c, most)).otherwise(F.array(c))))


def pack_lines(words: Column, most: int = 30) -> Column:
    """Words packed into lines; each costs its length + 1, and a line breaks before it would pass ``most``."""
    start = F.struct(F.array().cast("array<array<string>>").alias("done"), F.array().cast("array<string>").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, w: Column) -> Column:
        over = (a["n"] + F.length(w) + 1 > most) & (F.size(a["cur"]) > 0)
        return F.struct(
            F.when(over, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]).alias("done"),
            F.when(over, F.array(w)).otherwise(F.concat(a["cur"], F.array(w))).alias("cur"),
            F.when(over, F.length(w) + 1).otherwise(a["n"] + F.length(w) + 1).alias("n"),
        )

    return F.aggregate(words, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(a["cur"]))).otherwise(a["done"]))
