"""Column functions over seconds, timestamps, progress and sample arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def duration_feed(seconds: Column) -> Column:
    """``H:MM:SS`` or ``MM:SS`` of the seconds rounded half to even."""
    s = F.bround(seconds).cast("long")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s % 60))).otherwise(F.concat_ws(":", _two(m), _two(s % 60)))


def duration_list(seconds: Column) -> Column:
    """``H:MM:SS`` or ``M:SS`` of the whole seconds."""
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), _two(m), _two(s % 60))).otherwise(F.concat_ws(":", m.cast("string"), _two(s % 60)))


def clock(seconds: Column) -> Column:
    """``M:SS`` with unbounded minutes; ``0:00`` for null, NaN and negative."""
    s = F.floor(seconds)
    ok = seconds.isNotNull() & ~F.isnan(seconds) & (seconds >= 0)
    return F.when(ok, F.concat_ws(":", F.floor(s / 60).cast("string"), _two(s % 60))).otherwise("0:00")


def parse_duration(x: Column) -> Column:
    """Seconds of ``H:M:S`` or ``M:S``; null for anything else."""
    p = F.transform(F.split(x, ":"), lambda v: v.try_cast("double"))
    get = lambda i: F.try_element_at(p, F.lit(i))
    return F.when(F.size(p) == 3, get(1) * 3600 + get(2) * 60 + get(3)).when(F.size(p) == 2, get(1) * 60 + get(2))


def eta(seconds: Column) -> Column:
    s = F.floor(seconds)
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    text = F.when(h > 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).when(m > 0, F.concat(F.lit("~"), m.cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
    return F.when(seconds < 0, "—").otherwise(F.coalesce(text, F.concat(F.lit("~"), s.cast("string"), F.lit("s"))))


def iso_timestamp(x: Column) -> Column:
    """An ISO date or date-time, ``Z`` and offsets read as UTC; null for other text."""
    s = F.regexp_replace(F.trim(x), "[Zz]$", "+00:00")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?([+-]\d{2}:\d{2})?)?$"), s.try_cast("timestamp"))


def rfc822(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))


def clamp_progress(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), x.cast("int")))


def stage_percent(done: Column, total: Column) -> Column:
    return F.bround(done / total * 100).cast("int")


def word_offset(t: Column, offset: Column) -> Column:
    return F.bround(F.coalesce(t, F.lit(0.0)) + offset, 3)


def trim_silence(samples: Column, threshold_db: float = -40.0) -> Column:
    """From the first to the last sample above the threshold; all quiet samples stay as they are."""
    level = 10 ** (threshold_db / 20)
    loud = F.filter(F.sequence(F.lit(1), F.greatest(F.size(samples), F.lit(1))), lambda i: F.abs(F.try_element_at(samples, i)) > level)
    first, last = F.try_element_at(loud, F.lit(1)), F.try_element_at(loud, F.lit(-1))
    return F.when(first.isNull(), samples).otherwise(F.slice(samples, F.coalesce(first, F.lit(1)), F.coalesce(last - first + 1, F.lit(0))))


def silence(milliseconds: int, rate: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), rate * milliseconds // 1000)


def clip_samples(samples: Column) -> Column:
    return F.transform(samples, lambda v: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), v)))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def fill_frame(width: Column, height: Column, frame_width: int, frame_height: int) -> Column:
    """struct(new_width, new_height, left_px, top_px): an image scaled to cover a frame, and where its centre crop begins."""
    ratio = width / height
    wider = ratio > frame_width / frame_height
    w = F.when(wider, F.floor(frame_height * ratio)).otherwise(frame_width).cast("long")
    h = F.when(wider, frame_height).otherwise(F.floor(frame_width / ratio)).cast("long")
    return F.struct(w.alias("new_width"), h.alias("new_height"), F.floor((w - frame_width) / 2).cast("long").alias("left_px"), F.floor((h - frame_height) / 2).cast("long").alias("top_px"))


def overall_percent(chapter: Column, chapters: Column, done: Column, total: Column) -> Column:
    """Whole percent done at chunk ``done`` of ``total`` in the ``chapter``-th (from 1) of ``chapters``."""
    base = (chapter - 1) / chapters
    return F.floor((base + done / F.greatest(F.lit(1), total) / chapters) * 100).cast("int")
