"""Operators over timed words, segments and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foliant.functions import text as X
from foliant.operators.prefix import running_sum

WORDS = "array<struct<word:string,start:double,end:double>>"


def timed_words(clips: DataFrame) -> DataFrame:
    """(id, user_id, pos, word, start, end): the words of every clip; broken transcripts have none."""
    rows = clips.select("id", "user_id", F.posexplode(F.from_json("transcript", WORDS)).alias("pos", "w"))
    return rows.select("id", "user_id", "pos", F.col("w.word").alias("word"), F.col("w.start").alias("start"), F.col("w.end").alias("end"))


def speech_gaps(words: DataFrame, totals: DataFrame, least: float = 0.001) -> DataFrame:
    """(id, start, end): stretches without speech, from 0 to each recording's total, longer than ``least`` seconds.

    ``totals``: (id, total). A stretch begins at the end of the word before, be it the latest end so far or not.
    """
    order = Window.partitionBy("id").orderBy("pos")
    spoken = words.where("start IS NOT NULL AND `end` IS NOT NULL")
    inner = spoken.select("id", F.lag("end", 1, 0.0).over(order).alias("start"), F.col("start").alias("end")).where(F.col("end") > F.col("start") + least)
    last = spoken.groupBy("id").agg(F.max(F.struct("pos", "end"))["end"].alias("last"))
    tail = totals.join(last, "id", "left").select("id", F.coalesce("last", F.lit(0.0)).alias("start"), F.col("total").alias("end")).where(F.col("start") < F.col("end") - least)
    return inner.unionByName(tail)


def speech_totals(words: DataFrame, totals: DataFrame) -> DataFrame:
    """Seconds of speech and silence of each recording, their percentages, and the part that isn't speech (0 without length)."""
    speech = words.where("start IS NOT NULL AND `end` IS NOT NULL").groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("p"))
    silence = speech_gaps(words, totals).groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("q"))
    x = totals.join(speech, "id", "left").join(silence, "id", "left").select("id", "total", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    part = F.when(F.col("total") > 0, 1 - F.col("p") / F.col("total")).otherwise(0.0)
    share = lambda c: F.round(100 * F.try_divide(F.col(c), F.col("total")), 1)
    return x.select("id", F.round("p", 3).alias("speech"), F.round("q", 3).alias("silence"), share("p").alias("speech_pct"), share("q").alias("silence_pct"), F.round(part, 3).alias("silent_part"))


def sentence_clips(words: DataFrame, pad: float = 0.02, shortest: float = 6.0, longest: float = 15.0) -> DataFrame:
    """(id, sentence, text, start, end): sentences of timed words, cut just before the next word, of a fitting length."""
    w = Window.partitionBy("id").orderBy("pos")
    ends = F.col("word").rlike(r"[.?!;]+$").cast("int")
    rows = words.where("word IS NOT NULL").withColumn("sentence", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("next_start", F.lead("start").over(w)).withColumn("is_end", ends)
    out = rows.groupBy("id", "sentence").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("text"),
        F.min(F.struct("pos", F.col("start").alias("t")))["t"].alias("start"),
        F.max(F.struct("pos", F.coalesce(F.col("next_start") - pad, F.col("end")).alias("t"), "is_end")).alias("last"),
    )
    out = out.where("last.is_end = 1").select("id", "sentence", "text", "start", F.col("last.t").alias("end"))
    return out.where((F.col("end") - F.col("start")).between(shortest, longest))


def within_budget(clips: DataFrame, key: str, bucket: Column, order: list[str], pad: float, budget: float) -> DataFrame:
    """Clips of each key until their lengths and pads before them, in whole milliseconds, reach the budget."""
    length = F.round((F.col("end") - F.col("start") + pad) * 1000)
    return running_sum(clips, [key], bucket, order, length, "_before", inclusive=False).where(F.col("_before") < budget * 1000).drop("_before")


def _greedy(rows: list[tuple[float, float, str]], low: float, high: float, longest: float, least: float) -> list[tuple[float, float, str]]:
    """Groups by the sum of their segments' lengths; segments of no length are skipped, one above ``longest`` parts groups."""
    groups: list[tuple[float, list[tuple[float, float, str]]]] = [(0.0, [])]
    for row in rows:
        n = row[1] - row[0]
        total, held = groups[-1]
        if n <= 0:
            continue
        if n > longest:
            groups.append((0.0, []))
        elif total + n > high and total >= low:
            groups.append((n, [row]))
        else:
            groups[-1] = (total + n, [*held, row])
    return [(g[0][0], g[-1][1], " ".join(t.strip() for _, _, t in g)) for total, g in groups if g and least <= total <= longest]


GROUPED = T.StructType([T.StructField("id", T.LongType()), T.StructField("utterance", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType())])


def segment_groups(segments: DataFrame, low: float = 8.0, high: float = 10.0, longest: float = 15.0, least: float = 1.0) -> DataFrame:
    """Greedy groups of timed segments of a file: cut when the sum of lengths would pass ``high`` and has reached ``low``.

    Times that are null count as 0. A group holds segments of one recording only.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    part = F.struct("pos", zero("start").alias("a"), zero("end").alias("b"), F.col("word").alias("t"))
    files = segments.groupBy("id").agg(F.array_sort(F.collect_list(part)).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, a, b, t) for i, rows in zip(pdf["id"], pdf["rows"]) for k, (a, b, t) in enumerate(_greedy([(r["a"], r["b"], r["t"] or "") for r in rows], low, high, longest, least))]
            yield pd.DataFrame(out, columns=GROUPED.names)

    return files.mapInPandas(run, GROUPED)


def frames(clips: DataFrame, fps: int) -> DataFrame:
    """(id, frame, at): every frame of (id, start, length) and its time."""
    n = F.floor(F.col("length") * fps).cast("int")
    return clips.where(n >= 1).select("id", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"), "start").select("id", "frame", (F.col("start") + F.col("frame") / fps).alias("at"))


def word_states(frames: DataFrame, words: DataFrame) -> DataFrame:
    """(id, frame, pos, state): spoken, current or pending, for each word of a clip at each of its frames."""
    met = frames.join(words, "id")
    state = F.when(F.col("at") >= F.col("end"), "spoken").when(F.col("at") >= F.col("start"), "current").otherwise("pending")
    return met.select("id", "frame", "pos", state.alias("state"))


def scroll_offsets(clips: DataFrame, fps: int = 4, visible: int = 16, line_px: int = 36, width: int = 30) -> DataFrame:
    """(id, frame, offset_px): 0 until the first word of the middle visible line is due, then evenly to the last line.

    ``clips``: id, start, length (seconds), words (array of word, start, end), packed into lines of ``width``.
    """
    lines = X.pack_lines(F.transform("words", lambda w: F.coalesce(w["word"], F.lit(""))), width)
    sizes = F.transform(lines, lambda x: F.size(x))
    before = F.aggregate(F.slice(sizes, 1, visible // 2), F.lit(0), lambda a, n: a + n)
    rows = clips.select("id", "start", "length", F.size(lines).alias("n_lines"), F.try_element_at(F.col("words"), before + 1)["start"].alias("due"))
    trigger = F.when(F.col("n_lines") > visible, F.coalesce("due", "start") - F.col("start")).otherwise(0.0)
    rows = rows.select("id", "start", "length", "n_lines", trigger.alias("trigger"))
    most = F.greatest(F.lit(0), F.col("n_lines") - visible) * line_px
    span = F.when(F.col("trigger") < F.col("length"), F.col("length") - F.col("trigger")).otherwise(1.0)
    n = F.floor(F.col("length") * fps).cast("int")
    each = rows.where(n >= 1).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame"))
    t = F.col("frame") / fps
    moved = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - F.col("trigger")) / span))
    return each.select("id", "frame", F.when((F.col("n_lines") > visible) & (t > F.col("trigger")), F.floor(moved * most)).otherwise(0).cast("long").alias("offset_px"))


def best_candidates(candidates: DataFrame, limit: float = 0.10, attempts: int = 5) -> DataFrame:
    """Per chunk the first candidate within the limit in order of attempt and copy, else the one with the least silence."""
    rows = candidates.where(F.col("attempt") <= attempts)
    ok = F.min(F.when(F.col("silence") <= limit, F.struct("attempt", "copy", "silence")))
    least = F.min(F.struct("silence", "attempt", "copy"))
    got = rows.groupBy("chunk_idx").agg(ok.alias("ok"), least.alias("least"))
    pick = lambda c: F.when(F.col("ok").isNotNull(), F.col(f"ok.{c}")).otherwise(F.col(f"least.{c}")).alias(c)
    return got.select("chunk_idx", pick("attempt"), pick("copy"), pick("silence"), F.col("ok").isNotNull().alias("accepted"))


def attempt_log(candidates: DataFrame, limit: float = 0.10) -> DataFrame:
    """(chunk_idx, attempt, n_candidates, least_silence, accepted): a line for each attempt at a chunk."""
    return candidates.groupBy("chunk_idx", "attempt").agg(F.count("*").alias("n_candidates"), F.min("silence").alias("least_silence"), F.max(F.col("silence") <= limit).alias("accepted"))
