import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scholiast.llm.packing import best_fit, p8_packed, pack, pieces, plan


def brute_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b[0] >= s]
        if fits:
            b = min(fits, key=lambda b: b[0])
            b[0] -= s
        else:
            bins.append([capacity - s])
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_one_size(sizes):
    where, caps = best_fit(sizes, [64])
    assert len(caps) == brute_best_fit(sizes, 64)
    loads = [0] * len(caps)
    for s, c in zip(sizes, where):
        loads[c] += s
    assert all(0 < u <= c for u, c in zip(loads, caps))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_several_sizes_cost_no_more(sizes):
    where, caps = plan(sizes, [16, 32, 64])
    loads = [0] * len(caps)
    for s, c in zip(sizes, where):
        loads[c] += s
    assert all(u <= c and not any(u <= k < c for k in (16, 32, 64)) for u, c in zip(loads, caps)), "downsized to the contents"
    assert sum(caps) <= 64 * brute_best_fit(sizes, 64)


def test_pieces_and_edges(spark):
    df = spark.createDataFrame([(1, 0, 9), (2, 10, 9), (3, 25, 9), (4, None, 9)], "doc_id long, n_tokens int, tokens int")
    got = sorted(tuple(r) for r in pieces(df, 10).collect())
    assert got == [(2, 1, 0, 10), (3, 1, 0, 10), (3, 2, 10, 10), (3, 3, 20, 5)]
    assert pack(pieces(df.limit(0), 10), [10]).count() == 0


def test_rounds_keep_everything(spark, monkeypatch):
    import scholiast.llm.packing as P

    monkeypatch.setattr(P, "GROUP", 50)
    r = random.Random(5)
    items = [(k, 1, 0, r.randint(1, 100)) for k in range(1000)]
    rows = P.pack(spark.createDataFrame(items, "doc_id long, piece_no int, token_start int, tokens int"), [100]).collect()
    assert sorted((x.doc_id, x.tokens) for x in rows) == sorted((k, n) for k, _, _, n in items)
    loads = {}
    for x in rows:
        loads[x.container] = loads.get(x.container, 0) + x.tokens
    assert max(loads.values()) <= 100
    # groups of 50 pieces, four hundred times smaller than in production, cost a few percent over one whole packing
    assert len(loads) <= 1.05 * brute_best_fit([n for *_, n in items], 100)


def test_documents(spark, tables):
    rows = p8_packed(spark, "/root/testdata/sf0.01").collect()
    whole, docs = {}, {}
    for r in rows:
        key = (r.window_name, r.container)
        whole.setdefault(key, [r.capacity, 0])[1] += r.tokens
        docs.setdefault((r.window_name, r.doc_id), []).append((r.token_start, r.tokens, r.capacity))
        assert whole[key][0] == r.capacity
    assert all(u <= c for c, u in whole.values())
    largest = {"brief": 512, "page": 2048, "chapter": 8192, "joint": 8192}
    for (w, _), parts in docs.items():
        total = sum(n for _, n, _ in parts)
        assert len(parts) == 1 or total > largest[w], "cut only what alone exceeds the capacity"
        assert [s for s, *_ in sorted(parts)] == list(range(0, total, largest[w]))
    for w in largest:
        used, room = sum(u for (x, _), (_, u) in whole.items() if x == w), sum(c for (x, _), (c, _) in whole.items() if x == w)
        assert used / room > 0.98
    with pytest.raises(Exception):  # noqa: B017,PT011 - no windows, no packing
        p8_packed(spark, tables()).count()
