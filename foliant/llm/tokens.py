"""Encoding of a corpus with a public byte-level BPE vocabulary.

The distinct pieces of a batch of texts (an Arrow batch, part of a partition; pieces seen before in the partition are
kept) are laid out in one symbol sequence. An index maps each adjacent pair that
has a rank to all its positions; the lowest active rank is applied at all positions of its pair, from left to right,
and the lists of the neighbouring pairs are updated. Ranks are applied in ascending order, so every piece gets exactly
the merges that encoding it alone would give.

Null and empty texts give an empty list; strings of special tokens are ordinary text. Texts of any length are encoded
whole. The vocabulary file is a parameter; it is read once on the driver and broadcast (its size is checked).
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import accumulate, chain

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from foliant.llm.common import spread, table

VOCABULARY = os.environ.get("FOLIANT_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Largest vocabulary file that is broadcast.
MOST_VOCABULARY_MB = 64
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class PairIndex:
    """Encodes pieces with one vocabulary; keeps the ids of pieces seen, and the ranks of pairs met."""

    def __init__(self, ranks: dict[bytes, int], keep: int = 400_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.ids: dict[str, bytes] = {}  # of each piece its ids, four bytes each
        self.keep = keep

    def _rank(self, pair: tuple[int, int]) -> int:
        got = self.ranks.get(self.tokens[pair[0]] + self.tokens[pair[1]], -1)
        self.pairs[pair] = got
        return got

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces that aren't known yet, all of them together."""
        if len(self.ids) > self.keep:
            self.ids.clear()
        fresh = [p for p in pieces if p not in self.ids]
        sym: list[int] = []
        starts: list[int] = []
        todo: list[str] = []
        as_id, ranks = self.bytes, self.ranks
        for p in fresh:
            raw = p.encode("utf-8", "surrogatepass")
            if raw in ranks:
                self.ids[p] = array("i", (ranks[raw],)).tobytes()
                continue
            starts.append(len(sym))
            todo.append(p)
            sym += [as_id[b] for b in raw]
            sym.append(-1)  # a wall between pieces
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        where: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(sym, sym[1:])):
            if pair in where:
                where[pair].append(i)
            else:
                where[pair] = [i]
        known, rank_of = self.pairs, self._rank
        active: dict[int, list[tuple[int, int]]] = {}
        for pair in [p for p in where if p[0] >= 0 and p[1] >= 0]:
            r = known[pair] if pair in known else rank_of(pair)
            if r >= 0:
                active.setdefault(r, []).append(pair)
        heap = list(active)
        heapify(heap)
        while heap:
            r = heappop(heap)
            # pairs of one rank spell the same token; a position belongs to the piece, so they go from left to right
            spots = [(i, pair) for pair in active.pop(r, ()) for i in where.pop(pair, ())]
            spots.sort()
            for i, (a, b) in spots:
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue  # an earlier merge took one of the two
                sym[i], sym[j] = r, -2
                k = after[j]
                after[i] = k
                if k < n:
                    before[k] = i
                    if sym[k] >= 0:
                        pair = (r, sym[k])
                        q = known[pair] if pair in known else rank_of(pair)
                        if q >= 0:
                            if pair in where:
                                where[pair].append(i)
                            else:
                                where[pair] = [i]
                                if q in active:
                                    active[q].append(pair)
                                else:
                                    active[q] = [pair]
                                    heappush(heap, q)
                h = before[i]
                if h >= 0 and sym[h] >= 0:
                    pair = (sym[h], r)
                    q = known[pair] if pair in known else rank_of(pair)
                    if q >= 0:
                        if pair in where:
                            where[pair].append(h)
                        else:
                            where[pair] = [h]
                            if q in active:
                                active[q].append(pair)
                            else:
                                active[q] = [pair]
                                heappush(heap, q)
        for p, at in zip(todo, starts):
            out = array("i")
            while sym[at] >= 0:
                out.append(sym[at])
                at = after[at]
            self.ids[p] = out.tobytes()

    def _pieces(self, texts: list[str | None]) -> list[list[str]]:
        split = self.split
        pieces = [split(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        return pieces

    def encode(self, texts: list[str | None]) -> tuple[bytes, list[int]]:
        """All ids of the texts one after the other, and where each text's ids begin (one more than texts)."""
        pieces, get = self._pieces(texts), self.ids.__getitem__
        own = [b"".join(map(get, p)) for p in pieces]
        return b"".join(own), [0, *accumulate(len(x) >> 2 for x in own)]

    def count(self, texts: list[str | None]) -> list[int]:
        pieces, get = self._pieces(texts), self.ids.__getitem__
        return [sum(map(len, map(get, p))) >> 2 for p in pieces]


def _index(raw: bytes) -> PairIndex:
    """The worker's index of one vocabulary, kept between tasks."""
    key = hash(raw)
    if _KEPT.get("key") != key:
        _KEPT.update(key=key, index=PairIndex(load_ranks(raw)))
    return _KEPT["index"]


_KEPT: dict = {}


def _chunks(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most about ``most`` bytes of text, one row at least."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def _vocabulary(spark, path: str):
    size = os.path.getsize(path)
    if size > MOST_VOCABULARY_MB << 20:
        raise ValueError(f"vocabulary of {size} bytes; at most {MOST_VOCABULARY_MB} MB are broadcast")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ids(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids) of every row: the token ids of its text, an empty list for null and empty texts."""
    raw = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(raw.value)
        for batch in batches:
            for b in _chunks(batch):
                flat, ends = index.encode(b.column(1).to_pylist())
                flat_ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat_ids)
                yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(slim).mapInArrow(run, "id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every row, without moving the ids."""
    raw = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(raw.value)
        for batch in batches:
            for b in _chunks(batch):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(index.count(b.column(1).to_pylist()), pa.int64())], names=["id", "n_tokens"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return spread(slim).mapInArrow(run, "id long, n_tokens long")


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES = {"p6_ids": p6_ids}
