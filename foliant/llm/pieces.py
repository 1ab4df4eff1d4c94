"""Splitting oversized items at natural boundaries.

An item is processed in byte ranges. A worker reads a range with a halo on both sides: one character to the left, which
tells whether a run of marks and blanks began before the range, and to the right as many as the last run of the range
needs, doubled until the run has ended. A run belongs to the range it begins in, so each is found once however long it
is. The range's boundary table and its summary (code points, first and last break, widest stretch without one) are all
that is kept; the tables are stitched in range order, prefix sums of the lengths turn them into offsets of the item, and
pieces are emitted as offsets. Items of a column are read in place, range after range; items in files are read by
offset, each range by any worker, and only tables are shuffled. Every item of any size takes this way.

Pieces cover the text: each begins ``overlap`` code points before the end of the one before, or later where a natural
boundary stands there. Texts that are null or within the limit give no row. Limits of equal numbers under different
names give rows of their own; an overlap of at least the limit counts as limit - 1; a limit below 1 gives no row.
Extra columns don't matter. Bytes that aren't UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import functools
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from foliant.llm.common import map_batches, spread, table

#: Bytes of one range, and of the first halo to its right.
RANGE, HALO = 1 << 16, 256
#: A limits table of more rows is refused, since it is shipped with every task.
MOST_LIMITS = 1_000
# Strength of a boundary, the lower the stronger.
PARAGRAPH, SENTENCE, CLAUSE, SPACE = 0, 1, 2, 3

# Marks that make a boundary, and closers behind them.
MARKS, CLOSERS = ".!?…؟।॥。！？｡,;:،؛，、；：", "\"'”’»)\\]』」》）"
BOUNDARY = re.compile(rf"[\n{MARKS}][.!?…؟।॥。！？｡{CLOSERS}]*\s*")
#: A maximal run of characters that boundaries are made of.
RUN = re.compile(rf"[\s{MARKS}{CLOSERS}]+")
WHITE = re.compile(r"\s+")
# The marks that, beside white space, break a stretch.
BREAKS = ".!?。！？｡…؟।"
BREAK = re.compile(rf"[\s{re.escape(BREAKS)}]")
#: White space counts as a boundary only where stronger ones are further apart than this.
FINE = 160


def _strength(g: str) -> int | None:
    """The kind of a mark with what stands behind it; None if it is inside a number, name or the like."""
    lines = g.count("\n")
    if lines:
        return PARAGRAPH if lines > 1 else SENTENCE
    c = g[0]
    if c in "。！？｡":
        return SENTENCE
    if c in "，、；：":
        return CLAUSE
    if not g[-1].isspace():
        return None
    return CLAUSE if c in ",;:،؛" else SENTENCE


@functools.cache
def _stretch(least: int) -> re.Pattern:
    marks = re.escape(BREAKS)
    return re.compile(rf"[\s{marks}][^\s{marks}]{{{max(1, least)},}}")


def widest_stretch(text: str, least: int) -> tuple[int, int, int]:
    """(first break, last break, widest stretch between two breaks if above ``least``); -1 and -1 without breaks."""
    first = BREAK.search(text)
    if first is None:
        return -1, -1, 0
    last = len(text) - 1
    while not (text[last] in BREAKS or text[last].isspace()):
        last -= 1
    widest = 0
    for m in _stretch(least).finditer(text, first.start(), last + 1):
        widest = max(widest, m.end() - m.start() - 1)
    return first.start(), last, widest


def _aligned(read: Callable[[int, int], bytes], at: int, size: int) -> int:
    """The first byte at or behind ``at`` that begins a character."""
    if 0 < at < size:
        for i, b in enumerate(read(at, min(at + 4, size))):
            if b & 0xC0 != 0x80:
                return at + i
        return min(at + 4, size)
    return min(at, size)


def scan_range(read: Callable[[int, int], bytes], size: int, part: int, step: int, least: int, halo: int = HALO) -> tuple[int, int, bytes, bytes, int, int, int]:
    """(byte it begins at, code points, boundary offsets, their kinds, first break, last break, widest stretch) of a range.

    ``read(a, b)`` gives the bytes a..b of an item of ``size`` bytes. Boundaries are the ends of the marks that begin in
    the range, as code points from its beginning.
    """
    start, stop = _aligned(read, part * step, size), _aligned(read, min((part + 1) * step, size), size)
    own = read(start, stop).decode("utf-8", "replace")
    n = len(own)
    left = read(max(0, start - 4), start).decode("utf-8", "ignore")[-1:] if start else ""
    begin = 0
    if left and RUN.match(left) and (m := RUN.match(own)):  # a run of an earlier range
        begin = m.end()
    text, reach = own, halo
    if begin < n and RUN.match(own[-1]):  # the last run may go on
        while True:
            more = _aligned(read, min(stop + reach, size), size)
            tail = read(stop, more).decode("utf-8", "replace")
            m = RUN.match(tail)
            if more >= size or m is None or m.end() < len(tail):
                text = own + (tail[: m.end()] if m else "")
                break
            reach *= 2
    at, kind = array("i"), array("b")
    last = begin

    def fine(to: int) -> None:
        for m in WHITE.finditer(text, last, to):
            if m.end() < to:
                at.append(m.end())
                kind.append(SPACE)

    for m in BOUNDARY.finditer(text, begin):
        strength = _strength(m.group())
        if strength is None:
            continue
        e = m.end()
        if e - last > FINE or last == begin:  # what stands before the range isn't known
            fine(e)
        at.append(e)
        kind.append(strength)
        last = e
    fine(len(text) + 1)
    first, latest, widest = widest_stretch(own, least)
    return start, n, at.tobytes(), kind.tobytes(), first, latest, widest


def stitched(ranges: list[tuple[int, bytes, bytes, int, int, int]]) -> tuple[int, np.ndarray | array, np.ndarray | array, int]:
    """(code points, boundaries, kinds, widest stretch) of an item from its ranges in order: (n, at, kind, first, last, widest).

    White space between stronger boundaries that are near each other is left out, whichever ranges they stand in.
    """
    bases = [0, *accumulate(r[0] for r in ranges)]
    widest = since = 0
    for base, (_, _, _, first, last, inner) in zip(bases, ranges):
        if first >= 0:
            widest = max(widest, base + first - since, inner)
            since = base + last + 1
    total = bases[-1]
    at = np.concatenate([np.frombuffer(r[1], np.int32) + np.int64(base) if base >> 31 else np.frombuffer(r[1], np.int32) + np.int32(base) for base, r in zip(bases, ranges)] or [np.zeros(0, np.int32)])
    kind = np.frombuffer(b"".join(r[2] for r in ranges), np.int8)
    fine = np.flatnonzero(kind == SPACE)
    if len(fine):
        strong = at[kind < SPACE]
        behind = fine - np.arange(len(fine))  # strong boundaries before each
        low = np.where(behind > 0, strong[behind - 1], 0) if len(strong) else np.zeros(len(fine), np.int64)
        high = np.where(behind < len(strong), strong[np.minimum(behind, len(strong) - 1)], total + 1) if len(strong) else np.full(len(fine), total + 1)
        drop = fine[(high - low <= FINE) | (at[fine] == total)]
        at, kind = np.delete(at, drop), np.delete(kind, drop)
    if len(at) < 100_000:  # small tables are quicker to search as plain arrays
        return total, array("q", at.tolist()), array("b", kind.tolist()), max(widest, total - since)
    return total, at, kind, max(widest, total - since)


def cut_offsets(n: int, at: array, kind: array, most: int, overlap: int) -> tuple[list[int], list[int]]:
    """Starts and ends of the pieces of a text of ``n`` code points."""
    overlap = min(overlap, most - 1)
    starts, ends, start = [0], [], 0
    while n - start > most:
        low, high = bisect_right(at, start + most // 2), bisect_right(at, start + most)
        end = None
        if high > low:  # in the second half the strongest boundary, the last of its kind
            best = min(kind[low:high])
            if best < SPACE:
                end = int(at[next(i for i in range(high - 1, low - 1, -1) if kind[i] == best)])
        if end is None:
            floor = bisect_right(at, start + overlap)
            end = int(at[high - 1]) if high > floor else start + most
        ends.append(end)
        back = bisect_left(at, end - overlap)
        begin = end - overlap
        if overlap and back < len(at) and at[back] < end:  # the strongest boundary inside the overlap
            inside = range(back, bisect_left(at, end))
            begin = int(at[min(inside, key=lambda i: (kind[i], i))])
        start = max(begin, start + 1)
        starts.append(start)
    ends.append(n)
    return starts, ends


Limit = tuple[str | None, int, int]
RESULT = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("model_name", T.StringType()), T.StructField("cut", T.StringType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
    ]
)


def limits_of(limits: DataFrame) -> list[Limit]:
    rows = limits.select("model_name", "max_chars", "overlap_chars").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    return [(r.model_name, r.max_chars, max(0, r.overlap_chars or 0)) for r in rows if r.max_chars is not None and r.max_chars > 0]


def cut_item(ranges: list[tuple], caps: list[Limit]) -> Iterator[tuple[str | None, str, list[int], list[int]]]:
    """(limit, natural or forced, starts, ends) for every limit that the item exceeds."""
    n, at, kind, widest = stitched(ranges)
    for name, most, overlap in caps:
        if n > most:
            yield name, "forced" if widest > most else "natural", *cut_offsets(n, at, kind, most, overlap)


def split_oversized(df: DataFrame, limits: DataFrame, id_col: str, text_col: str, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """(id, model_name, cut, starts, ends) of every text and limit it exceeds.

    ``cut`` is ``forced`` if some stretch without white space and without a terminal mark is longer than the limit. The
    bytes of a text are read where they are in the Arrow column, a range at a time; they are never decoded as a whole.
    """
    caps = limits_of(limits)
    if not caps:
        return df.sparkSession.createDataFrame([], RESULT)
    least = min(m for _, m, _ in caps)
    longer = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where(F.length(F.col(text_col).cast("string")) > least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in RESULT.names]
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = memoryview(value.as_buffer())
                read = lambda a, b: bytes(data[a:b])  # noqa: B023, E731
                parts = range(-(-len(data) // size))
                ranges = [scan_range(read, len(data), part, size, least, halo)[1:] for part in parts]
                for row in cut_item(ranges, caps):
                    for column, x in zip(out, (i, *row)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(out, ARROW)], names=RESULT.names)

    return spread(longer).mapInArrow(run, RESULT)


ARROW = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))

# --- items in files ------------------------------------------------------------------------------------------------

TABLES = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("begin", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("at", T.BinaryType()),
        T.StructField("kind", T.BinaryType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()), T.StructField("widest", T.IntegerType()),
    ]
)
PLACED = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("model_name", T.StringType()), T.StructField("cut", T.StringType()), T.StructField("piece_no", T.IntegerType()),
        T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType()), T.StructField("from_byte", T.LongType()), T.StructField("skip", T.LongType()),
    ]
)


def _reader(path: str) -> Callable[[int, int], bytes]:
    """Reads bytes a..b of a file by offset; nothing else of it is loaded."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path)
    f = where.open_input_file(name)

    def read(a: int, b: int) -> bytes:
        f.seek(a)
        return f.read(b - a)

    return read


def file_ranges(files: DataFrame, least: int, size: int = 1 << 24, halo: int = HALO) -> DataFrame:
    """The boundary table and summary of every byte range of ``files`` (path, length); ranges are dealt out one by one."""
    parts = files.where("length > 0").select("path", F.col("length").cast("long").alias("length"), F.explode(F.sequence(F.lit(0), ((F.col("length") - 1) / size).cast("int"))).alias("part"))

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        for paths, lengths, nums in columns:
            for path, length, part in zip(paths, lengths, nums):
                yield [[x] for x in (path, part, *scan_range(_reader(path), length, part, size, least, halo))]

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return map_batches(parts.repartition(tasks, "path", "part"), run, TABLES)


def split_files(files: DataFrame, limits: DataFrame, size: int = 1 << 24, halo: int = HALO) -> DataFrame:
    """Pieces of giant text files (path, length): their places, and at which byte and how many code points behind it each begins.

    A file's tables meet in one task (about a twelfth of its bytes); its text never does.
    """
    caps = limits_of(limits)
    if not caps:
        return files.sparkSession.createDataFrame([], PLACED)
    tables = file_ranges(files, min(m for _, m, _ in caps), size, halo)
    fields = ("part", "begin", "n", "at", "kind", "first", "last", "widest")
    whole = tables.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ranges"))

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        for paths, tables in columns:
            for path, ranges in zip(paths, tables):
                bases = [0, *accumulate(r["n"] for r in ranges)]
                for name, cut, starts, ends in cut_item([tuple(r[f] for f in fields[2:]) for r in ranges], caps):
                    own = [bisect_right(bases, s) - 1 for s in starts]
                    yield [
                        [path] * len(starts), [name] * len(starts), [cut] * len(starts), list(range(len(starts))), starts, ends,
                        [ranges[k]["begin"] for k in own], [s - bases[k] for s, k in zip(starts, own)],
                    ]

    return map_batches(whole, run, PLACED)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """The pieces of ``split_files`` with their ``text``, each read from its file by offset."""
    schema = T.StructType([*PLACED.fields, T.StructField("text", T.StringType())])

    def run(columns: Iterator[list[list]]) -> Iterator[list[list]]:
        for cols in columns:
            texts, of = [], {}
            for path, start, end, begin, skip in zip(cols[0], cols[4], cols[5], cols[6], cols[7]):
                read = of.get(path) or of.setdefault(path, _reader(path))
                raw = read(begin, begin + 4 * (skip + end - start))
                texts.append(raw.decode("utf-8", "replace")[skip : skip + end - start])
            yield [*cols, texts]

    return map_batches(pieces.select(*PLACED.names).repartition(4 * pieces.sparkSession.sparkContext.defaultParallelism, "path", "piece_no"), run, schema)


# --- queries -------------------------------------------------------------------------------------------------------


def _split(spark, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chapters"), table(spark, sf_dir, "tts_limits"), "chapter_id", "content_text")


def p3_found(spark, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select(F.col("id").alias("chapter_id"), "model_name", "cut")


def p3_pieces(spark, sf_dir: str) -> DataFrame:
    """The pieces as offsets: (chapter_id, model_name, piece_no, start_pos, end_pos)."""
    pieces = _split(spark, sf_dir).select(F.col("id").alias("chapter_id"), "model_name", F.posexplode(F.arrays_zip("starts", "ends")).alias("piece_no", "span"))
    return pieces.select("chapter_id", "model_name", "piece_no", F.col("span.starts").alias("start_pos"), F.col("span.ends").alias("end_pos"))


# The stretches of the SQL: text between breaks, by the list of TESTDATA.
ORACLE = {
    "p3_found": r"""
        SELECT c.chapter_id, l.model_name,
               CASE WHEN list_max(list_transform(string_split_regex(c.content_text,
                    '[\t\n\x0B\x0C\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}.!?。！？｡…؟।]'), lambda x: length(x))) > l.max_chars
                    THEN 'forced' ELSE 'natural' END AS cut
        FROM chapters c JOIN tts_limits l ON length(c.content_text) > l.max_chars"""
}
QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
