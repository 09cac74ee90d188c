import random

import numpy as np

from cartomill.llm import length_buckets as lb


def padding(counts, bounds):
    return sum(n * (min(b for b in bounds if b >= i + 1) - i - 1) for i, n in enumerate(counts) if n)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(30):
        counts = np.array([rng.choice([0, 0, 1, 3, 9]) for _ in range(9)])
        if not counts.any():
            continue
        top = int(np.nonzero(counts)[0].max()) + 1
        for k in (1, 2, 3):
            best = min(padding(counts, (*c, top)) for n in range(k) for c in combinations(range(1, top), n))
            assert padding(counts, lb.boundaries(counts, k)) == best
    assert lb.boundaries(np.zeros(5), 3) == []


def test_plan_uses_every_item_once():
    sizes, counts = [2, 3, 5, 8], [7, 5, 3, 2]
    seen = [0] * 4
    for repeats, batch in lb.plan(sizes, counts, 10):
        assert sum(sizes[b] * k for b, k in batch.items()) <= 10 and repeats >= 1
        for b, k in batch.items():
            seen[b] += repeats * k
    assert seen == counts


def check(rows, sizes, capacity):
    by_item = {}
    for r in rows:
        by_item.setdefault(r.doc, []).append(r)
    total = {}
    for k, n in sizes:
        total[k] = total.get(k, 0) + (n or 0)
    assert {k: sum(r.n_tokens for r in v) for k, v in by_item.items()} == total
    spans = {}
    for r in rows:
        assert 0 <= r.n_tokens <= capacity and (r.container_id is None) == (r.n_tokens == 0)
        if r.n_tokens:
            spans.setdefault(r.container_id, []).append((r.start, r.start + r.n_tokens))
    for v in spans.values():
        v.sort()
        assert v[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(v, v[1:]))
    return spans


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(lb, "PART_ROWS", 100)
    rng = random.Random(3)
    sizes = [(i, rng.choice([0, None, 1, 7, 7, 7, 30, 63, 64, 65, 200, rng.randrange(64)])) for i in range(900)]
    sizes += [(i, 40) for i in range(1000, 1600)]  # a length that holds a large share
    df = spark.createDataFrame([(*x, 1, 1) for x in sizes], "doc bigint, n bigint, _bucket int, start int")
    rows = lb.pack(df, "doc", "n", capacity=64, buckets=8).collect()
    spans = check(rows, sizes, 64)
    whole = {k for k, n in sizes if n and n <= 64}
    assert all(r.part_no == 0 for r in rows if r.doc in whole)
    assert sorted(spans) == list(range(len(spans)))
    assert sum(n or 0 for _, n in sizes) / (len(spans) * 64) > 0.7


def test_pack_empty_and_zero(spark):
    df = spark.createDataFrame([], "doc bigint, n bigint")
    assert lb.pack(df, "doc", "n").collect() == []
    df = spark.createDataFrame([(1, 0), (2, None)], "doc bigint, n bigint")
    assert sorted(tuple(r) for r in lb.pack(df, "doc", "n").collect()) == [(1, 0, 0, None, None), (2, 0, 0, None, None)]


def test_batches_form_inside_their_bucket():
    sizes, counts = [2, 3, 5, 8], [7, 5, 3, 2]
    alone = lb.plan(sizes, counts, 10, top_up=False)
    assert all(len(batch) == 1 for _, batch in alone)
    assert [(n, b) for n, b in alone] == [(2, {3: 1}), (1, {2: 2}), (1, {2: 1}), (1, {1: 3}), (1, {1: 2}), (1, {0: 5}), (1, {0: 2})]
    # a topped-up batch still begins with all that fits of its own bucket
    for _, batch in lb.plan(sizes, counts, 10):
        own = next(iter(batch))
        assert own == max(batch, key=lambda b: sizes[b])


def test_fill_is_told_with_and_without_top_up(spark):
    df = spark.createDataFrame([(i, 5 if i % 2 else 60) for i in range(200)], "doc bigint, n bigint")
    rows = {r.top_up: r for r in lb.fill(df, "doc", "n", 64).collect()}
    assert (rows[False].containers, rows[True].containers) == (100 + 9, 100 + 9) and rows[True].tokens == 6500
    df = spark.createDataFrame([(i, 20 if i % 2 else 40) for i in range(200)], "doc bigint, n bigint")
    rows = {r.top_up: r for r in lb.fill(df, "doc", "n", 64).collect()}
    assert (rows[False].containers, rows[True].containers) == (100 + 34, 100)
    assert [r.fill for r in lb.fill(df.limit(0), "doc", "n").collect()] == [None, None]


def test_large_containers_are_planned_in_bounded_steps():
    import time

    counts = np.random.default_rng(1).integers(1, 10_000, 32_768)
    began = time.time()
    bounds = lb.boundaries(counts, 128)
    assert len(bounds) == 128 and bounds[-1] == 32_768 and time.time() - began < 20
