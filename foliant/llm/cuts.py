"""Text cut off by field limits or mid-transfer.

A backward character n-gram model is counted over all texts: for the last 8, 4 and 2 characters before a position (10,
8, 6 and 4 behind a mark), how often a line ends there, a sentence mark or line end follows, or a word ends. Only
contexts that occur at an end to judge are counted, and those exactly, by a hash of 61 bits: a bitmap of them, of at most
32 MB, keeps most others back, and a join drops the rest. Each text's final context is then read from its
end, the longest well-seen order counts, and the log-odds that a text stops there are held against a threshold per
language and column
that comes from the texts which end with a mark. Layout (verse, lists, signatures, headings) decides which of the
events counts, and lengths that pile up in a source tell a limit from chance.

Null, empty and blank texts are never cut. Copies of a cut text are cut too. Texts are read whole, of any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import checkpointed, spread, table

#: Bits of the bitmap a context to count, and log2 of the least and most bits. Its size decides how many rows are
#: shuffled, not what is counted.
ROOM, BITS = 16, (16, 28)
#: log2 of the bits that one task sets.
CHUNK = 20
#: Characters counted at a time.
BLOCK = 1_500_000
#: The longest order whose context was seen so often is the one that counts; the weight of the overall rate in it.
SEEN, WEIGHT = 60, 5.0
#: A text stops implausibly if its odds are so many nats below what is usual in its language and column.
NATS_LINE, NATS_TERM, NATS_WORD = 4.0, 4.2, 4.5
#: So many ends inside texts a language needs for a threshold of its own.
LEAST = 20
#: Thresholds by language: the rules whose ends inside texts give them, the odds, the share of those ends that lies lower,
#: and how many nats below it the threshold is. Headings and open text go on as a rule, so they must end as plausibly as
#: the upper tenth of the ends without a mark, and text that stops at a comma, dash or opener like the upper tenth of the lines
#: that do. Signatures stand at texts' ends only, so these give their threshold. Without the model only U+FFFD at the end, a
#: visible mark of a cut, and trailing dots at a source's length limit decide.
PLAIN = ["list", "list_end", "heading", "verse", "open"]
LEAST_OF = {
    "list_end": (["list_end"], "line", 0.05, 1.0),
    "list": (["list"], "word", 0.01, 3.0),
    "signature": (["signature"], "word", 0.05, 3.0),
    "verse": (["verse"], "term", 0.01, 2.0),
    "dots": (PLAIN, "term", 0.05, 0.7),
    "open": (PLAIN, "line", 0.9, 0.0),
    "pause": (["pause"], "line", 0.9, 0.0),
}
#: A length of a source is a limit if it holds at least so many of its texts and this share of them.
PILE, PILE_SHARE = 4, 0.006

# Marks that end a sentence; closers; marks that show a cut.
TERMINATORS = ".!?。！？｡؟।॥…"
CLOSERS = "\"'”’»)]}›」』）］】》“"
BRACKET_MARK = re.compile(r"\s*(?:\[(?:\.{2,}|…)\]|\((?:\.{2,}|…|more)\)|\[(?:truncated|cut|more)\]|\.{2,}\s*\(?more\)?|…\s*\(?more\)?)$", re.I)
DOTS = re.compile(r"(\s*)(\.{2,}|…+)$")
LIST_LINE = re.compile(r"^\s*(?:[-*•–·▪‣]|\d{1,3}[.)])\s+\S")
SIGNATURE = re.compile(r"^(?:[—–-]\s*\w[\w .'-]*|(?:Yours|Love|Best|Sincerely|Regards)\b.*|\w[\w '-]*,\s*\d{1,4}|The End|Fin|Ende|Fine)$")
OPENERS = "“‘„«([{‹「『（［【《¿¡"

MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Orders of the contexts that don't end with a mark or closer, and of those that do.
ORDERS = ((2, 4, 8), (4, 6, 8, 10))


def _hashes(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each order the hash, its low three bits clear, of the context that ends at each position."""
    m = [np.uint64(x) for x in MULT]
    with np.errstate(over="ignore"):
        h1 = (codes.astype(np.uint64) + np.uint64(7)) * m[0]
        h1 ^= h1 >> np.uint64(29)

        def joined(a: np.ndarray, b: np.ndarray, gap: int, k: int) -> np.ndarray:
            out = a * m[k]
            out[..., gap:] += b[..., : b.shape[-1] - gap]
            out ^= out >> np.uint64(31)
            return out

        h2 = joined(h1, h1, 1, 1)
        h4 = joined(h2, h2, 2, 2)
        h8 = joined(h4, h4, 4, 3)
        of = {2: h2, 4: h4, 6: joined(h4, h2, 4, 4), 8: h8, 10: joined(h8, h2, 8, 4)}
        return {order: (h * m[1]) & ~np.uint64(7) for order, h in of.items()}


def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below 0x10000: whether it is a sentence mark, belongs to a word, is Thai, ends like a mark."""
    term = np.zeros(0x10001, bool)
    term[[0, 10, *map(ord, TERMINATORS), ord(";")]] = True
    word = np.array([chr(i).isalnum() or chr(i) in "’'-\xad\u200b\u200c\u2060\ufeff" for i in range(0x10001)], bool)
    thai = np.zeros(0x10001, bool)
    thai[0xE00:0xE80] = True
    marked = np.zeros(0x10001, bool)
    marked[[*map(ord, TERMINATORS + CLOSERS), ord(";")]] = True
    return term, word, thai, marked


COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "line", "term", "word")])


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap, by the high bits of ``key``, of the distinct keys; each task sets 2**CHUNK bits of it."""
    bits = min(max(BITS[0], math.ceil(math.log2(ROOM * max(1, keys.count())))), BITS[1])
    slots = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("slot")).distinct()

    def packed(part: pa.Table) -> pa.Table:
        own = np.zeros(1 << min(bits, CHUNK), bool)
        own[part["slot"].to_numpy() & (len(own) - 1)] = True
        return pa.table({"chunk": part["chunk"][:1], "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    out = np.zeros(1 << bits >> 3, np.uint8)
    step = 1 << min(bits, CHUNK) >> 3
    for row in slots.withColumn("chunk", F.shiftright("slot", CHUNK)).groupBy("chunk").applyInArrow(packed, "chunk long, bits binary").toLocalIterator():
        out[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(row.bits, np.uint8)
    return out


def count_contexts(df: DataFrame, text_col: str, bitmap: np.ndarray) -> DataFrame:
    """Summed counts by key: seen, line end next, sentence mark or line end next, word end next. Keys 0 and 1 hold the
    sums over all contexts without and with a mark; keys that the bitmap doesn't have are left out."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, word, thai, marked = _kinds()
        spaced_mark = np.zeros(0x10001, bool)
        spaced_mark[[*map(ord, "?!»")]] = True
        wanted = np.unpackbits(shared.value).view(bool)
        high = np.uint64(64 - (len(wanted).bit_length() - 1))
        events_of = np.array([[1, e & 1, e >> 1 & 1, e >> 2] for e in range(8)], np.int64)

        def rows(coded: np.ndarray) -> pa.RecordBatch:
            """``coded``: keys with their events in the low three bits."""
            each, n = np.unique(coded, return_counts=True)
            key = each & ~np.uint64(7)
            first = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            sums = np.add.reduceat(n[:, None] * events_of[(each & np.uint64(7)).astype(np.int64)], first, axis=0)
            return batch(key[first].view(np.int64), sums)

        def batch(key: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(sums[:, j].copy()) for j in range(4))], names=COUNTS.names)

        def counted(texts: list[str]) -> Iterator[pa.RecordBatch]:
            joined = "\0" * 12 + ("\0" * 12).join(texts) + "\0"
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = np.minimum(codes, 0x10000)
            here, then = codes[:-1], codes[1:]
            beyond = np.append(then[1:], np.uint32(0))
            spaced = ((then == 32) | (then == 0xA0) | (then == 0x202F)) & spaced_mark[beyond]  # French marks stand off
            keep = (here != 0) & (then != 0)  # a text's own end is no evidence
            hashes = _hashes(codes)
            for with_mark, orders in enumerate(ORDERS):
                at = np.nonzero(keep & (marked[here] == bool(with_mark)))[0]
                if not len(at):
                    continue
                after, cur = then[at], here[at]
                event = ((after == 10) + 2 * (term[after] | spaced[at] | thai[cur] & (after == 32)) + 4 * (word[cur] & ~word[after])).astype(np.uint64)
                yield batch(np.array([with_mark]), (np.bincount(event.astype(np.int64), minlength=8) @ events_of)[None, :])
                for order in orders:
                    h = hashes[order][at]
                    hit = wanted[h >> high]
                    if hit.any():
                        yield rows(h[hit] | event[hit])

        held, chars = [], 0
        for part in batches:
            for t in part.column(0).to_pylist():
                if t:
                    held.append(t)
                    chars += len(t)
                    if chars >= BLOCK:
                        yield from counted(held)
                        held, chars = [], 0
        if held:
            yield from counted(held)

    found = df.select(F.col(text_col).alias("text")).where("text IS NOT NULL").mapInArrow(run, COUNTS)
    return found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "line", "term", "word")))


EVENTS = ("line", "term", "word")


def with_odds(ends: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """``ends`` (with ``marked`` and ``keys``, shortest order first) with the log-odds of the three events at each: of
    the longest order seen SEEN times, else over all contexts."""
    tails = ends.select(F.element_at("keys", -1).alias("longest"), F.posexplode("keys").alias("pos", "key")).distinct()
    counts = checkpointed(count_contexts(df, text_col, bitmap_of(tails.select("key").distinct())))
    overall = {r.key: r for r in counts.where("key IN (0, 1)").collect()}
    rate = [{c: min(max((overall[k][c] if k in overall else 0) / (overall[k].n if k in overall else 1), 1e-6), 1 - 1e-6) for c in EVENTS} for k in (0, 1)]

    def of(c: str):
        return F.when(F.col("marked"), rate[1][c]).otherwise(rate[0][c])

    best = tails.join(counts.where(F.col("n") >= SEEN), "key").groupBy("longest").agg(F.max(F.struct("pos", "n", *EVENTS)).alias("best"))
    x = ends.withColumn("longest", F.element_at("keys", -1)).join(best, "longest", "left")
    p = {c: F.least(F.greatest(F.coalesce((F.col(f"best.{c}") + WEIGHT * of(c)) / (F.col("best.n") + WEIGHT), of(c)), F.lit(1e-7)), F.lit(1 - 1e-7)) for c in EVENTS}
    return x.select(*(c for c in ends.columns if c not in ("keys", "marked")), *(F.log(p[c] / (1 - p[c])).cast("float").alias(c) for c in EVENTS))


def _ornament(c: str) -> bool:
    return ord(c) >= 0x1F000 or 0x2600 <= ord(c) < 0x27C0 or c in "️‍"


def ending(text: str, kind: str | None) -> tuple[str, str] | None:
    """How the text ends (a rule's name) and the text up to the point whose context is judged."""
    body = text.rstrip()
    while body and (_ornament(body[-1]) or body[-1].isspace() or body[-1] in "​‌⁠﻿­"):
        body = body[:-1]
    if not body:
        return None
    if body[-1] == "�":
        return "cut", body
    if m := BRACKET_MARK.search(body):
        return "cut", body[: m.start()]
    last = body[body.rfind("\n") + 1 :].strip()
    paragraph = body[body.rfind("\n\n") + 2 :].strip() if "\n\n" in body else body
    if m := DOTS.search(body):
        before = body[: m.start()]
        if m.group(1) and m.group(2) != "...":
            return "cut", before
        return ("dots", before) if before else None
    if LIST_LINE.match(last):
        return ("list" if body[-1].isalpha() and body[-1].lower() != body[-1].upper() else "list_end"), body
    c = body[-1]
    if c in TERMINATORS:
        return "mark", body
    if c == ";" and re.search("[Ͱ-Ͽ]", body[-12:]):
        return "mark", body
    if c in CLOSERS and not (c == "“" and "„" not in body[-200:]) and not (c in "’'" and body[-2:-1].isalnum() and kind != "verse"):
        inner = body[:-1].rstrip()[-1:]
        return "closer" if inner and inner in TERMINATORS + CLOSERS else "bare_closer", body
    if kind == "letter" and last == paragraph and SIGNATURE.match(last) or SIGNATURE.match(last) and last == paragraph and last in ("The End", "Fin", "Ende"):
        return "signature", body
    if c in ",،、，:：—–-(" or c in OPENERS:
        return "pause", body
    lines = [x for x in body.split("\n") if x.strip()]
    if kind == "verse" or len(lines) > 3 and sum(x.rstrip()[-1] not in TERMINATORS + CLOSERS for x in lines[:-1]) * 3 > 2 * (len(lines) - 1):
        return "verse", body
    if 0xE00 <= ord(c) < 0xE80:
        return "verse", body
    if last == paragraph and len(last) <= 40:
        return "heading", body
    return "open", body


ENDS = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("inner", T.BooleanType()), T.StructField("source", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("n_chars", T.IntegerType()), T.StructField("n_bytes", T.IntegerType()), T.StructField("marked", T.BooleanType()), T.StructField("keys", T.ArrayType(T.LongType()))]
)


KINDS = (pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())


def endings(text: str, kind: str | None) -> Iterator[tuple[bool, str, str]]:
    """(inner, rule, text before) of the text's end and of the end of the line before its last, where a line did end.

    Lines that end with a mark are left out inside, lists aside.
    """
    if got := ending(text, kind):
        yield False, *got
        at = text.rfind("\n", 0, len(text.rstrip()))
        while at > 0 and text[at - 1].isspace():
            at -= 1
        if at > 0 and (text[at - 1] not in TERMINATORS + CLOSERS or LIST_LINE.match(text[text.rfind("\n", 0, at) + 1 : at])) and (got := ending(text[:at], kind)):
            yield True, *got


def ends_of(df: DataFrame) -> DataFrame:
    """Rule, lengths and keys of every text's ends, see ``endings``. ``df``: id, text, lang, source, kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked_of = _kinds()[3]
        for batch in batches:
            rows, tails = [], []
            for i, text, lang, source, kind in zip(*(c.to_pylist() for c in batch.columns)):
                for inner, rule, body in endings(text or "", kind):
                    tail = [min(ord(c), 0x10000) for c in body[-12:]]
                    tails.append([0] * (12 - len(tail)) + tail)
                    rows.append((i, inner, source, (lang or "").strip().lower()[:2], rule, len(text), len(text.encode("utf-8", "surrogatepass"))))
            if not rows:
                continue
            codes = np.array(tails, np.uint32)
            marked, hashes = marked_of[codes[:, -1]], {k: h[:, -1].view(np.int64).tolist() for k, h in _hashes(codes).items()}
            keys = [[hashes[k][j] for k in ORDERS[x]] for j, x in enumerate(marked.tolist())]
            yield pa.RecordBatch.from_arrays([*(pa.array(list(c), f) for c, f in zip(zip(*rows), KINDS)), pa.array(marked), pa.array(keys, pa.list_(pa.int64()))], names=ENDS.names)

    return df.mapInArrow(run, ENDS)


def limits_of(scored: DataFrame) -> DataFrame:
    """(source, unit, length): lengths that pile up in a source, in characters or bytes."""
    sizes = scored.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x")).select("source", "x.unit", "x.length")
    counted = sizes.groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    totals = scored.groupBy("source").agg(F.count("*").alias("total"))
    return counted.where(F.col("n") >= PILE).join(totals, "source").where(F.col("n") >= PILE_SHARE * F.col("total")).select("source", "unit", "length")


def least_odds(both: DataFrame) -> DataFrame:
    """By language the thresholds of LEAST_OF, from the odds where lines inside texts (signatures: texts) end like its rules.

    Languages with fewer than LEAST such lines take it from all languages, no language with any from nowhere: null.
    """
    inner, out = both.where("inner OR rule = 'signature'"), both.select("lang").distinct()
    own, overall = [], []
    for name, (rules, column, share, below) in LEAST_OF.items():
        of = F.when(F.col("rule").isin(rules), F.col(column))
        own.append(F.when(F.count(of) >= LEAST, F.percentile_approx(of, share) - below).alias(f"own_{name}"))
        overall.append((F.percentile_approx(of, share) - below).alias(f"all_{name}"))
    found = out.join(inner.groupBy("lang").agg(*own), "lang", "left").crossJoin(inner.agg(*overall))
    return found.select("lang", *(F.coalesce(f"own_{n}", f"all_{n}").alias(f"least_{n}") for n in LEAST_OF))


def cut_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", kind_col: str = "doc_kind") -> DataFrame:
    """(id, source, cut) of every text with an end to judge."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(kind_col).alias("kind")).where("text IS NOT NULL")
    slim = spread(slim)
    both = checkpointed(with_odds(checkpointed(ends_of(slim)), slim, "text"))
    scored = both.where("NOT inner")
    usual = scored.where("rule = 'mark'").groupBy("lang").agg(F.percentile_approx("line", 0.5).alias("usual_line"))
    piles = limits_of(scored)
    chars = piles.where("unit = 'chars'").select(F.col("source").alias("s1"), F.col("length").alias("n_chars"), F.lit(True).alias("at_chars"))
    nbytes = piles.where("unit = 'bytes'").select(F.col("source").alias("s2"), F.col("length").alias("n_bytes"), F.lit(True).alias("at_bytes"))
    x = scored.join(usual, "lang", "left").join(least_odds(both), "lang", "left")
    x = x.join(chars, (x["source"] == chars["s1"]) & (x["n_chars"] == chars["n_chars"]), "left").drop(chars["n_chars"])
    x = x.join(nbytes, (x["source"] == nbytes["s2"]) & (x["n_bytes"] == nbytes["n_bytes"]), "left").drop(nbytes["n_bytes"])
    usual_line = F.coalesce(F.col("usual_line"), F.lit(math.log(0.15)))
    odd_line = F.col("line") < usual_line - NATS_LINE
    at_limit = F.coalesce(F.col("at_chars") | F.col("at_bytes"), F.col("at_chars"), F.col("at_bytes"), F.lit(False))

    def below(name: str, column: str, otherwise):
        """Below the language's threshold, or below a constant where no line of any text ended like that."""
        return F.col(column) < F.coalesce(F.col(f"least_{name}"), F.lit(otherwise) if isinstance(otherwise, float) else otherwise)

    cut = (
        F.when(F.col("rule") == "cut", True)
        .when(F.col("rule") == "dots", at_limit | below("dots", "term", -NATS_TERM))
        .when(F.col("rule").isin("mark", "closer"), odd_line)
        .when(F.col("rule") == "verse", below("verse", "term", -NATS_TERM - 1.0))
        .when(F.col("rule") == "list", below("list", "word", -NATS_WORD))
        .when(F.col("rule") == "list_end", below("list_end", "line", usual_line - NATS_LINE))
        .when(F.col("rule") == "signature", below("signature", "word", -NATS_WORD))
        .when(F.col("rule") == "pause", below("pause", "line", 0.0))
        .otherwise(below("open", "line", 0.0))
    )
    return x.select("id", "source", cut.alias("cut"))


def _documents(spark, sf_dir: str) -> DataFrame:
    return cut_texts(table(spark, sf_dir, "documents"))


def p8_found(spark, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("cut").select(F.col("id").alias("doc_id"))


def p8_sources(spark, sf_dir: str) -> DataFrame:
    """How often each source cuts: (source, n_texts, n_cut, share_cut), over texts that aren't null or blank."""
    judged = _documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"))
    return judged.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6))


QUERIES = {"p8_found": p8_found, "p8_sources": p8_sources}
