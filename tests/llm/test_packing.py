"""Containers: nothing lost, nothing over the capacity, little unused; the dynamic program against brute force."""

import itertools
import random

import numpy as np

from sheaf.llm import packing, queries


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= v) - v) for v, c in zip(lengths, counts))


def test_bounds_are_optimal():
    random.seed(4)
    for _ in range(40):
        v = sorted(random.sample(range(1, 60), random.randrange(1, 9)))
        c = [random.randrange(1, 9) for _ in v]
        for most in (1, 2, 3, 20):
            got = packing.bucket_bounds(np.array(v), np.array(c), most)
            best = min(padding(v, c, [*s, v[-1]]) for k in range(min(most, len(v))) for s in itertools.combinations(v[:-1], k))
            assert len(got) <= most and got[-1] == v[-1] and padding(v, c, got) == best


def test_bounds_of_long_containers():
    """20,000 lengths: one number a length and one link a length and row, no table of pairs."""
    import tracemalloc

    g = np.random.default_rng(1)
    v, c = np.arange(1, 20_001), g.integers(1, 1000, 20_000)
    tracemalloc.start()
    got = packing.bucket_bounds(v, c, 12)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 12 and got[-1] == 20_000 and peak < 32 << 20


def test_blocks_find_the_segment():
    random.seed(2)
    segments, at = [], {}
    for i in range(200):
        b, ranks = random.randrange(4), random.choice([1, 1, 2, 500])
        segments.append((b, at.get(b, 0), ranks, i, 1, 0, 0))
        at[b] = at.get(b, 0) + ranks
    width, rows = packing.by_blocks(segments)
    assert len(rows) <= 9 * len(segments) + 8
    for b, n in at.items():
        for r in range(n):
            hit = [x for x in rows if x[0] == b and x[1] == r // width[b] and x[2] <= r < x[2] + x[3]]
            assert len(hit) == 1 and [s for s in segments if s[0] == b and s[1] <= r < s[1] + s[2]] == [(hit[0][0], *hit[0][2:])]


def validate(rows, sizes, capacity):
    by, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r.k, []).append((r.piece, r.length))
        if r.container is not None:
            by.setdefault(r.container, []).append((r.place, r.offset, r.length))
    assert {k: sum(n for _, n in v) for k, v in pieces.items()} == {k: n or 0 for k, n in sizes.items()}
    for k, v in pieces.items():
        assert [p for p, _ in sorted(v)] == list(range(len(v))) and (len(v) == 1 or sizes[k] > capacity)
    for slots in by.values():
        slots.sort()
        assert [p for p, _, _ in slots] == list(range(len(slots)))
        assert all(o + n <= o2 for (_, o, n), (_, o2, _) in zip(slots, slots[1:])) and slots[-1][1] + slots[-1][2] <= capacity
    assert sorted(by) == list(range(len(by)))
    return len(by)


def test_pack(spark):
    random.seed(5)
    sizes = {i: random.choice([0, None, 1, 2, 100, 101, random.randrange(1, 300), random.randrange(1, 70)]) for i in range(3000)}
    sizes[77] = 1000
    d = spark.createDataFrame(list(sizes.items()), "k long, n int").withColumn("place", d_clash())
    for buckets in (4, 64):
        got = packing.pack(d, "k", "n", 100, buckets, rows_per_part=500).collect()
        used = validate(got, sizes, 100)
        total = sum(n or 0 for n in sizes.values())
        assert total / (used * 100) > (0.93 if buckets == 64 else 0.75)


def d_clash():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_edges(spark):
    d = spark.createDataFrame([(1, 0), (2, None)], "k long, n int")
    assert [tuple(r)[2:] for r in packing.pack(d, "k", "n", 10).collect()] == [(0, None, None, None)] * 2
    assert packing.pack(d.limit(0), "k", "n", 10).collect() == []
    one = packing.pack(spark.createDataFrame([(1, 25)], "k long, n int"), "k", "n", 10).collect()
    assert sorted((r.piece, r.length) for r in one) == [(0, 10), (1, 10), (2, 5)]


def test_query(spark, data):
    r = queries.p7_fill(spark, data).collect()[0]
    assert r.n_tokens > 0 and r.unused_share < 0.1
