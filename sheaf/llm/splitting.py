"""Splitting oversized items at natural boundaries (problem 3): balanced targets.

The least number of pieces that fits is placed at targets of equal length, each target is snapped to
the strongest boundary near it, and pieces are added where a limit fails: as many as all starts need
to stand on boundaries in their reach, without a cap.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import ship


class _Rest:
    """Least number of pieces from a place to the end, if every start with a boundary in reach stands on one."""

    def __init__(self, n: int, limit: int, overlap: int, places: list[int]):
        self.n, self.limit, self.overlap, self.step, self.places = n, limit, overlap, limit - overlap, places
        self.need = [0] * len(places)
        for i in range(len(places) - 1, -1, -1):
            self.need[i] = self.of(places[i])

    def reach(self, at: int) -> tuple[int, int]:
        """Range of the boundaries at which a piece after the one that starts ``at`` may start."""
        return bisect_right(self.places, at), bisect_right(self.places, at + self.step)

    def of(self, at: int) -> int:
        if self.n - at <= self.limit:
            return 1
        i, j = self.reach(at)
        if i < j:
            return 1 + min(self.need[i:j])
        if i == len(self.places):
            return -(-(self.n - self.overlap - at) // self.step)
        whole = (self.places[i] - at - 1) // self.step  # full pieces until the next boundary is in reach
        return whole + self.of(at + whole * self.step)


def cut_points(n: int, limit: int, overlap: int, strength: dict[int, int]) -> list[int]:
    """Places 0..n-1 at which pieces start; piece i holds starts[i] .. starts[i+1] + overlap - 1.

    ``strength``: place to level of a boundary, 1 the strongest. Every piece holds at most ``limit``
    places. There are as few pieces as let every start with a boundary in reach stand on one: counted
    back from the end over the boundaries, then laid out in one pass at targets of equal length. A
    start takes the strongest boundary within half a piece of its target from which the pieces left
    suffice, else the nearest in reach; with none in reach, the target.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    if n <= limit:
        return [0]
    places = sorted(p for p in strength if 0 < p < n - overlap)
    rest = _Rest(n, limit, overlap, places)
    k = rest.of(0)
    size = (n - overlap) / k
    starts = [0]
    for i in range(1, k):
        at, left = starts[-1], k - i
        target = round(i * size)
        a, b = rest.reach(at)
        good = [places[x] for x in range(a, b) if rest.need[x] <= left]
        near = [p for p in good if abs(p - target) <= size / 2]
        if near:
            starts.append(min(near, key=lambda p: (strength[p], abs(p - target), p)))
        elif good:
            starts.append(min(good, key=lambda p: (abs(p - target), strength[p], p)))
        else:
            far = at + rest.step
            target = min(max(target, at + 1), far)
            starts.append(target if rest.of(target) <= left else far)
    return starts


def pieces_of(spans: list[tuple[int, int]], limit: int, overlap: int, strength: dict[int, int]) -> Iterator[tuple[int, list[tuple[int, int]], bool]]:
    """(first page, spans of the piece, starts at a boundary) of sorted disjoint page spans."""
    base, at = [], 0
    for lo, hi in spans:
        base.append(at)
        at += hi - lo + 1
    n = at

    def place(page: int) -> int | None:
        i = bisect_left(spans, (page + 1, -1)) - 1
        return base[i] + page - spans[i][0] if i >= 0 and page <= spans[i][1] else None

    by_place: dict[int, int] = {}
    for page, level in strength.items():
        p = place(page)
        if p is not None:
            by_place[p] = min(level, by_place.get(p, level))
    starts = cut_points(n, limit, overlap, by_place)
    for i, s in enumerate(starts):
        e = starts[i + 1] + overlap - 1 if i + 1 < len(starts) else n - 1
        part, x = [], bisect_right(base, s) - 1
        while x < len(spans) and base[x] <= e:
            (lo, hi), b = spans[x], base[x]
            part.append((lo + max(s, b) - b, lo + min(e, b + hi - lo) - b))
            x += 1
        yield part[0][0], part, s in by_place


def split_items(df: DataFrame, key: str, spans: str, outline: str, limit: int = 12, overlap: int = 1) -> DataFrame:
    """(key, piece, n_pieces, page_from, page_to, n_pages, pages, at_boundary) of every item.

    ``spans``: array of (lo, hi), sorted and disjoint; ``outline``: array of (level, title, page),
    null, empty, out of order or lacking pages. Keys may be of any type and repeat. Items without a
    page give no row, small items one piece. Only what exceeds the limit needs more, so filter before; each item is worked on alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, sp, ol in zip(b["k"], b["s"], b["o"]):
                ranges = [(x["lo"], x["hi"]) for x in (sp if sp is not None else ())]
                if not ranges:
                    continue
                strength: dict[int, int] = {}
                for e in ol if ol is not None else ():
                    if e is not None and e["page"] is not None and not pd.isna(e["page"]):
                        level = int(e["level"]) if e["level"] is not None else 99
                        strength[int(e["page"])] = min(level, strength.get(int(e["page"]), level))
                got = list(pieces_of(ranges, limit, overlap, strength))
                for i, (first, part, natural) in enumerate(got, 1):
                    text = ", ".join(f"{a}-{z}" if z > a else f"{a}" for a, z in part)
                    out.append((k, i, len(got), first, part[-1][1], sum(z - a + 1 for a, z in part), text, natural))
            yield pd.DataFrame(out, columns=["k", "piece", "n_pieces", "page_from", "page_to", "n_pages", "pages", "at_boundary"])

    ship(df.sparkSession)
    kind = df.select(key).schema[0].dataType.simpleString()
    schema = f"k {kind}, piece int, n_pieces int, page_from int, page_to int, n_pages int, pages string, at_boundary boolean"
    slim = df.select(F.col(key).alias("k"), F.col(spans).alias("s"), F.col(outline).alias("o"))
    return slim.mapInPandas(run, schema).withColumnRenamed("k", key)
