"""A dictionary of scripts without spaces, counted over a corpus, and the word lattice over it.

Words are the strings of up to four characters with free neighbours: the entropy of what stands before and behind a
string, over all its occurrences, is high at the edges of words and low inside them. Strings that make up less than
FREQUENCY of all characters are left out, so that whatever the corpus a dictionary has at most 1 / FREQUENCY words of
each length. A text's segmentation is the cheapest path through the lattice of all dictionary words in it.

Null and empty texts count for nothing; a corpus without such scripts has an empty dictionary, and every character is
then a word of its own.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Characters of the longest word.
LONGEST = 4
#: Least share of all characters that a word makes up, and least number of times it stands in the corpus.
FREQUENCY, LEAST = 1e-5, 3
#: Least entropy, in nats, on either side of a word.
FREE = 1.0
#: What a task may keep of rare strings: those below this part of FREQUENCY in its own characters are not sent.
SLACK = 0.1
#: A run of characters that are written without spaces.
RUN = re.compile("[぀-ゟ゠-ヿ々㐀-䶿一-鿿豈-﫿]+")

GRAMS = T.StructType([T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])


def count_grams(df: DataFrame, text_col: str) -> DataFrame:
    """(gram, n): how often each string of up to LONGEST + 1 characters stands in runs; '' has the number of characters.

    Counted exactly in each task; a string that is rarer than SLACK * FREQUENCY in all tasks may be counted too low.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: Counter[str] = Counter()
        grams: Counter[str] = Counter()
        total = 0

        def fold() -> None:
            nonlocal total
            for r, k in runs.items():
                total += k * len(r)
                for size in range(1, LONGEST + 2):
                    for i in range(len(r) - size + 1):
                        grams[r[i : i + size]] += k
            runs.clear()
            if len(grams) > 4_000_000:
                prune()

        def prune() -> None:
            floor = SLACK * FREQUENCY * total
            for g in [g for g, n in grams.items() if n < floor and len(g) > 1]:
                del grams[g]

        for batch in batches:
            for text in batch.column(0).to_pylist():
                runs.update(RUN.findall(text))
            if len(runs) > 300_000:
                fold()
        fold()
        prune()
        items = [("", total), *grams.items()]
        for a in range(0, len(items), 50_000):
            part = items[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=GRAMS.names)

    texts = df.select(F.col(text_col).alias("text")).where("text RLIKE '[\\\\x{3040}-\\\\x{30ff}\\\\x{3400}-\\\\x{9fff}]'")
    return texts.mapInArrow(run, GRAMS).groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(df: DataFrame, text_col: str) -> dict[str, float]:
    """Each word with its cost, the negative logarithm of its share; under '' the cost of a character never seen."""
    grams = count_grams(df, text_col)
    long, weight = F.length("gram") > 1, F.col("n") * F.log(F.col("n"))
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("gram").alias("w"), F.col("n").alias("n"), F.lit(0.0).alias("after"), F.lit(0.0).alias("before")),
        F.when(long, F.struct(F.expr("left(gram, length(gram) - 1)").alias("w"), none.alias("n"), weight.alias("after"), F.lit(0.0).alias("before"))),
        F.when(long, F.struct(F.expr("right(gram, length(gram) - 1)").alias("w"), none.alias("n"), F.lit(0.0).alias("after"), weight.alias("before"))),
    )
    sums = grams.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("x")).groupBy("x.w").agg(F.sum("x.n").alias("n"), F.sum("x.after").alias("after"), F.sum("x.before").alias("before"))
    total = grams.where("gram = ''").select(F.col("n").alias("total"))
    free = (F.log("n") - F.col("after") / F.col("n") >= FREE) & (F.log("n") - F.col("before") / F.col("n") >= FREE)
    often = F.col("n") >= F.greatest(F.lit(LEAST), FREQUENCY * F.col("total"))
    kept = sums.join(F.broadcast(total)).where((F.length("w") > 0) & (F.length("w") <= LONGEST) & often & ((F.length("w") == 1) | free))
    table = kept.select("w", "n", "total").toArrow()
    cost = {w: math.log(t / n) for w, n, t in zip(*(table[c].to_pylist() for c in ("w", "n", "total")))}
    return {"": max(cost.values(), default=0.0) + 2.0, **cost}


class Lattice:
    """Cheapest paths over a dictionary. ``known`` words are in it whatever the corpus, and are preferred by ``bonus``."""

    def __init__(self, cost: dict[str, float], known: frozenset[str] = frozenset(), bonus: float = 2.0):
        unseen = cost.get("", 12.0)
        self.cost = {w: c for w, c in cost.items() if w}
        for w in known:
            own = self.cost.get(w, 1.5 * unseen if len(w) > 1 else unseen)
            self.cost[w] = max(0.5, own - bonus)
        self.unseen = unseen
        self.longest = max(map(len, self.cost), default=1)
        self.words = functools.lru_cache(100_000)(self._words)

    def _words(self, run: str) -> tuple[str, ...]:
        """The words of ``run`` on the cheapest path; of equal paths the one whose last words are longest."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        get = self.cost.get
        for e in range(1, n + 1):
            for b in range(max(0, e - self.longest), e):
                c = get(run[b:e])
                if c is None:
                    if b != e - 1:
                        continue
                    c = self.unseen
                if best[b] + c < best[e]:
                    best[e], back[e] = best[b] + c, b
        out, e = [], n
        while e:
            out.append(run[back[e] : e])
            e = back[e]
        return tuple(reversed(out))
