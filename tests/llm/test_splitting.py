"""Pieces: limits, overlap, balance and boundaries."""

import random

import pytest

from sheaf.llm import queries, splitting


def spread(spans):
    return [p for a, z in spans for p in range(a, z + 1)]


@pytest.mark.parametrize("limit, overlap", [(12, 1), (5, 0), (6, 3), (2, 1)])
def test_pieces_keep_every_page(limit, overlap):
    random.seed(limit)
    for _ in range(300):
        spans, at = [], 1
        for _ in range(random.randrange(1, 4)):
            a = at + random.randrange(2, 9)
            z = a + random.randrange(0, 40)
            spans.append((a, z))
            at = z + 1
        pages = spread(spans)
        outline = {random.randrange(1, 120): random.randrange(1, 4) for _ in range(random.randrange(0, 30))}
        got = [(first, spread(part), natural) for first, part, natural in splitting.pieces_of(spans, limit, overlap, outline)]
        assert all(len(p) <= limit for _, p, _ in got) and all(f == p[0] for f, p, _ in got)
        whole = got[0][1][:]
        for (_, before, _), (_, p, natural) in zip(got, got[1:]):
            assert p[:overlap] == before[len(before) - overlap :] and p[0] > before[0]
            whole += p[overlap:]
        assert whole == pages
        assert all(natural == (f in outline) for f, _, natural in got)
        least = 1 if len(pages) <= limit else -(-(len(pages) - overlap) // (limit - overlap))
        assert least <= len(got) <= 2 * least + 1


def test_balance_and_boundaries():
    assert splitting.cut_points(25, 12, 1, {}) == [0, 8, 16]  # equal pieces rather than 12, 12 and a rest
    assert splitting.cut_points(25, 12, 1, {7: 2, 9: 1, 17: 1}) == [0, 9, 17]  # the stronger one
    assert splitting.cut_points(23, 12, 1, {}) == [0, 11]
    assert splitting.cut_points(23, 12, 1, {5: 1, 14: 1}) == [0, 5, 14]  # one more piece, as two can start at no boundary
    assert splitting.cut_points(12, 12, 1, {5: 1}) == [0]
    with pytest.raises(ValueError):
        splitting.cut_points(30, 5, 5, {})


def test_every_start_in_reach_of_a_boundary_stands_on_one():
    """Against all ways to cut: as few pieces as that rule allows, however many."""
    from functools import lru_cache

    random.seed(8)
    for _ in range(300):
        n, overlap = random.randrange(2, 60), random.randrange(0, 3)
        limit = overlap + random.randrange(1, 9)
        strength = {random.randrange(1, n): random.randrange(1, 4) for _ in range(random.randrange(0, 14))}
        places = {p for p in strength if p < n - overlap}

        @lru_cache(None)
        def least(at):
            if n - at <= limit:
                return 1
            reach = range(at + 1, at + limit - overlap + 1)
            on = [p for p in reach if p in places]
            return 1 + min(least(p) for p in on or reach)

        got = splitting.cut_points(n, limit, overlap, strength)
        assert n - got[-1] <= limit or len(got) == 1
        for a, b in zip(got, got[1:]):
            assert 0 < b - a <= limit - overlap and (b in places or not any(p in places for p in range(a + 1, a + limit - overlap + 1)))
        assert len(got) == least(0)


def test_huge_items_are_cut_in_linear_time():
    import time

    t = time.time()
    got = splitting.cut_points(2_000_000, 12, 1, {p: p % 3 + 1 for p in range(5, 2_000_000, 7)})
    assert len(got) > 180_000 and time.time() - t < 30


def test_keys_of_any_type(spark):
    d = spark.createDataFrame([("a-1", [(1, 30)], None), (None, [(1, 3)], None)], "id string, s array<struct<lo:int,hi:int>>, o array<struct<level:int,title:string,page:int>>")
    assert sorted((r.id or "", r.piece) for r in splitting.split_items(d, "id", "s", "o").collect()) == [("", 1), ("a-1", 1), ("a-1", 2), ("a-1", 3)]


def test_frames(spark):
    schema = "id long, s array<struct<lo:int,hi:int>>, o array<struct<level:int,title:string,page:int>>, piece string"
    d = spark.createDataFrame([
        (1, [(1, 30)], [(1, "a", 12), (2, "b", None), (None, "c", 21), (1, "d", 5)], "clash"), (2, [(4, 6)], None, ""), (3, [], [], ""), (4, None, None, ""), (5, [(1, 13)], [], ""), (5, [(1, 13)], [], ""),
    ], schema)
    got = sorted((r.id, r.piece, r.pages) for r in splitting.split_items(d, "id", "s", "o").collect())
    assert got[:3] == [(1, 1, "1-12"), (1, 2, "12-21"), (1, 3, "21-30")] and got[3] == (2, 1, "4-6") and [g[0] for g in got[4:]] == [5, 5, 5, 5]
    assert splitting.split_items(d.limit(0), "id", "s", "o").collect() == []


def test_query(spark, data):
    pieces = queries.p3_pieces(spark, data).collect()
    assert pieces and all(r.n_pages <= 12 for r in pieces)
    assert {r.frag_id for r in pieces} == {r.frag_id for r in queries.p3_found(spark, data).collect()}
    by = {}
    for r in pieces:
        by.setdefault(r.frag_id, []).append(r)
    assert all(sorted(x.piece for x in v) == list(range(1, v[0].n_pieces + 1)) for v in by.values())
