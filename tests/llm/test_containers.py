import random
from collections import Counter
from itertools import combinations

from hypothesis import given, settings, strategies as st

from foliant.llm import containers as B


def least_containers(items, capacity):
    """Exact number of containers of a small instance."""
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(k, spaces):
        if len(spaces) >= best[0]:
            return
        if k == len(items):
            best[0] = len(spaces)
            return
        for i in sorted({s: i for i, s in enumerate(spaces) if s >= items[k]}.values()):
            spaces[i] -= items[k]
            go(k + 1, spaces)
            spaces[i] += items[k]
        spaces.append(capacity - items[k])
        go(k + 1, spaces)
        spaces.pop()

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_optimum(items):
    left = dict(Counter(items))
    fixed = B.reduce_by_dominance(left, 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    used = Counter(s for sizes, m in fixed for s in sizes for _ in range(m))
    assert used + Counter(rest) == Counter(items) and all(sum(s) <= 20 for s, _ in fixed)
    assert sum(m for _, m in fixed) + (least_containers(rest, 20) if rest else 0) == least_containers(items, 20)


def test_best_fit_places_everything():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 30, 100])
        h = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 80)))
        got = Counter()
        for sizes, m in B.best_fit(dict(h), cap):
            assert sum(sizes) <= cap and m > 0
            for s in sizes:
                got[s] += m
        assert got == h


def test_operator(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 0, -3, 5, 5, 5, 9, 17, 45, 100])) for i in range(400)] + [(1000, 7), (1000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n long").cache()
    for bucket_rows in (200_000, 7):  # one bucket, and many
        monkeypatch.setattr(B, "BUCKET_ROWS", bucket_rows)
        got = B.fill_containers(df, "doc_id", "n", 20).collect()
        load = Counter()
        whole = Counter()
        for r in got:
            load[r.container_id] += r.size
            whole[r.id] += r.size
        assert max(load.values()) <= 20 and sorted(load) == list(range(len(load)))
        want = Counter()
        for i, n in rows:
            want[i] += max(0, n or 0)
        assert whole == +want
        assert all(Counter(r.size for r in got if r.id == i) for i, n in rows if n == 45)
        assert len(load) <= -(-sum(load.values()) // 20) * 1.25 + 1
    assert B.fill_containers(df.limit(0), "doc_id", "n", 20).count() == 0
