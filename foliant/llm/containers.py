"""Filling fixed-capacity containers with items.

The items' sizes form a histogram of at most ``capacity`` rows, and the whole plan is made on it: first Martello-Toth
reduction, which fixes sets of items that dominate every other set their largest item could be in, as many copies at a
time as there are; then best fit, in decreasing size, of the remainder, whole groups of equal containers at a time.
The plan is a list of patterns with their copies. Each item then finds its container from its rank among the items of
its size, a prefix sum over hash buckets, so that a size held by a third of all rows is spread over many tasks.

Items without size (null, zero, negative) take no container. An item larger than the capacity is split into full
pieces and a rest. Ties are settled by id; repeated rows are separate items. Containers are numbered from 0.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window, functions as F

from foliant.llm.common import checkpointed, table
from foliant.llm.tokens import VOCABULARY, token_counts

#: Rows of one rank bucket, about.
BUCKET_ROWS = 200_000
#: Up to this many plan rows are broadcast (24 bytes each); larger plans are joined by shuffle.
BROADCAST_ROWS = 200_000


def _two_sums(counts: dict[int, int], most: int) -> int:
    """Bit set of the sums up to ``most`` that two or more items make."""
    mask = (1 << (most + 1)) - 1
    one, many = 1, 0  # sums of any number of items; of two or more
    single = 0
    for s, n in counts.items():
        if s > most:
            continue
        left, step = n, 1
        while left > 0 and s * step <= most:  # copies by doubling
            take = min(step, left)
            if take > 1:
                many |= (one << (s * take)) & mask
            else:
                many |= ((many | single) << s) & mask
            one |= (one << (s * take)) & mask
            left -= take
            step *= 2
        single |= 1 << s
        many &= mask
    return many


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets and take their items out of ``counts``; returns (sizes of one container, copies)."""
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(sizes: tuple[int, ...], copies: int) -> None:
        for s in sizes:
            counts[s] -= copies
            if not counts[s]:
                del counts[s]
        fixed.append((sizes, copies))

    changed = True
    while changed and counts:
        changed = False
        for j in sorted(counts, reverse=True):
            while counts.get(j, 0):
                n, rest = counts[j], capacity - j
                others = dict(counts)
                others[j] -= 1
                if not others[j]:
                    del others[j]
                fitting = sorted(s for s in others if s <= rest)
                if not fitting:
                    take((j,), n if 2 * j > capacity else 1)
                    changed = True
                    continue
                k = fitting[-1]
                copies = min(n, counts[k]) if k != j else n // 2
                if k == rest:
                    take((j, k), copies)
                    changed = True
                    continue
                low = fitting[0]
                pair_low = low + (low if others[low] > 1 else fitting[1] if len(fitting) > 1 else capacity)
                if pair_low > rest:  # one partner at most
                    take((j, k), copies)
                    changed = True
                    continue
                if pair_low > k:
                    break  # two items together exceed the best partner
                many = _two_sums(others, rest)
                if many.bit_length() - 1 <= k:
                    take((j, k), 1)
                    changed = True
                    continue
                break
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing size of all items of ``counts``, over groups of equal containers."""
    spaces: list[int] = []  # the different free spaces, ascending
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

    def put(space: int, content: tuple[tuple[int, int], ...], copies: int) -> None:
        if space not in groups:
            bisect.insort(spaces, space)
            groups[space] = []
        groups[space].append((content, copies))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect.bisect_left(spaces, s)
            if at < len(spaces):
                space = spaces[at]
                content, copies = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                    spaces.pop(at)
            else:
                space, content, copies = capacity, (), n
            each = space // s
            full = min(copies, n // each)
            if full:
                put(space - each * s, (*content, (s, each)), full)
                n -= full * each
            rest = copies - full
            if n and rest and n < each:
                put(space - n * s, (*content, (s, n)), 1)
                n, rest = 0, rest - 1
            if rest and content:
                put(space, content, rest)
    return [(tuple(s for s, m in content for _ in range(m)), copies) for own in groups.values() for content, copies in own]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(size, first rank, first container, items of that size in each container) of every pattern."""
    left = dict(counts)
    patterns = reduce_by_dominance(left, capacity) + best_fit(left, capacity)
    rows: list[tuple[int, int, int, int]] = []
    used: dict[int, int] = {}
    base = 0
    for sizes, copies in patterns:
        for s in dict.fromkeys(sizes):
            m = sizes.count(s)
            rows.append((s, used.get(s, 0), base, m))
            used[s] = used.get(s, 0) + m * copies
        base += copies
    return rows


def pieces_of(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, size): the items, those larger than the capacity in pieces."""
    size = F.col(size_col).cast("long")
    last = F.floor((size - 1) / capacity).cast("int")
    pieces = df.where(size > 0).select(F.col(id_col).alias("id"), size.alias("total"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    return pieces.select("id", "piece_no", start.alias("start"), F.least(F.lit(capacity).cast("long"), F.col("total") - start).alias("size"))


def fill_containers(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, piece_no, start, size, container_id) of every item with a size. ``df`` is read three times: give it kept."""
    spark = df.sparkSession
    items = pieces_of(df, id_col, size_col, capacity)
    histogram = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    rows = plan(histogram, capacity)
    buckets = max(1, -(-max(histogram.values(), default=1) // BUCKET_ROWS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("id", "piece_no"), F.lit(buckets)).cast("int"))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("id", "piece_no")).cast("long")
    ranked = items.withColumn("rank", inside - 1)
    if buckets > 1:
        before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = items.groupBy("size", "bucket").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        ranked = ranked.join(offsets.drop("n"), ["size", "bucket"]).withColumn("rank", F.col("rank") + F.col("offset"))
    by_size: dict[int, list[tuple[int, int, int]]] = {}
    for s, first, base, m in rows:
        by_size.setdefault(s, []).append((first, base, m))
    spans = spark.createDataFrame([(s, sorted(v)) for s, v in by_size.items()] or [(0, [])], "size long, spans array<struct<first:long,base:long,each:long>>")
    spans = F.broadcast(spans) if len(rows) <= BROADCAST_ROWS else spans
    placed = ranked.join(spans, "size").withColumn("span", F.element_at(F.filter("spans", lambda x: x["first"] <= F.col("rank")), -1))
    container = F.col("span.base") + F.floor((F.col("rank") - F.col("span.first")) / F.col("span.each"))
    return placed.select("id", "piece_no", "start", "size", container.cast("long").alias("container_id"))


def p7_containers(spark, sf_dir: str, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    sizes = checkpointed(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary))
    out = fill_containers(sizes, "id", "n_tokens", capacity)
    return out.select(F.col("id").alias("doc_id"), "piece_no", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"), "container_id")


QUERIES = {"p7_containers": p7_containers}
