import os

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from foliant.llm import tokens as K

pytestmark = pytest.mark.skipif(not os.path.exists(K.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    with open(K.VOCABULARY, "rb") as f:
        ranks = K.load_ranks(f.read())
    return K.PairIndex(ranks), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(index, texts):
    import array

    flat, ends = index.encode(texts)
    all_ids = array.array("i", flat)
    return [list(all_ids[a:b]) for a, b in zip(ends, ends[1:])]


def test_same_ids_on_all_documents(both, spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert ids(both[0], texts) == [both[1].encode_ordinary(t) if t else [] for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_same_ids_on_any_text(both, texts):
    assert ids(both[0], texts) == [both[1].encode_ordinary(t) for t in texts]
    assert both[0].count(texts) == [len(both[1].encode_ordinary(t)) for t in texts]


def test_repeats_and_special_strings(both):
    texts = ["aaaaaaaaaaaaaaaa", "ababababab", "<|endoftext|>", "   \n\n  x", "la " * 3000, "", None]
    assert ids(both[0], texts) == [both[1].encode_ordinary(t) if t else [] for t in texts]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Hello world", [1]), (2, "", None), (3, None, None), (1, "Hello world", [1])], "doc_id long, text string, ids array<int>")
    got = sorted((r.id, r.ids) for r in K.token_ids(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert sorted((r.id, r.n_tokens) for r in K.token_counts(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert K.token_ids(df.limit(0), "doc_id", "text").count() == 0
