"""Filling fixed-capacity containers (problem 7): optimal length buckets.

Dynamic programming over the global histogram of lengths chooses bucket boundaries that waste the
least padding. Containers are then planned on buckets, not on items: batches up to the token budget
form inside a bucket, and what a batch leaves free is topped up with slots of smaller buckets. The
plan depends on the histogram only (at most ``capacity`` lengths); items find their slot by their
rank in the bucket, counted in two levels so that no bucket is ever ranked by one task.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """At most ``most`` upper bounds, the last the greatest length, with least padding in total.

    One row of the program after another: to end a bucket at the j-th length after the i-th costs a
    line in that length, so each row is read off the lower envelope of lines in one pass. Memory is
    one number a length, and one link a length and row.
    """
    order = np.argsort(lengths)
    v, c = lengths[order].astype(int).tolist(), counts[order].astype(int).tolist()
    m = len(v)
    if m <= most:
        return v
    n, s = [0, *accumulate(c)], [0, *accumulate(x * y for x, y in zip(c, v))]
    best = [0, *(v[j - 1] * n[j] - s[j] for j in range(1, m + 1))]
    back = np.zeros((most - 1, m + 1), np.int32)  # 0: the bucket begins with the shortest length
    for row in range(most - 1):
        hull: list[int] = []
        new, links, at = best[:], [-1] * (m + 1), 0
        for j in range(1, m + 1):
            # Line i has slope -n[i] and starts at best[i] + s[i]; slopes fall, so the envelope is kept on a stack.
            i = j - 1
            y = best[i] + s[i]
            while len(hull) > 1:
                p, q = hull[-2], hull[-1]
                if (y - best[p] - s[p]) * (n[q] - n[p]) <= (best[q] + s[q] - best[p] - s[p]) * (n[i] - n[p]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = v[j - 1]
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and best[hull[at + 1]] + s[hull[at + 1]] - n[hull[at + 1]] * x <= best[hull[at]] + s[hull[at]] - n[hull[at]] * x:
                at += 1
            i = hull[at]
            cost = best[i] + s[i] - n[i] * x + x * n[j] - s[j]
            if cost < new[j]:
                new[j], links[j] = cost, i
        best = new
        back[row] = links
    bounds, j = [], m
    for row in range(most - 2, -1, -1):
        if j > 0 and back[row, j] >= 0:
            bounds.append(v[j - 1])
            j = int(back[row, j])
    if j > 0:
        bounds.append(v[j - 1])
    return sorted(bounds)


def by_blocks(segments: list[tuple[int, int, int, int, int, int, int]]) -> tuple[dict[int, int], list[tuple[int, int, int, int, int, int, int, int]]]:
    """(block width of each bucket, rows of a segment and a block of ranks it covers).

    A rank finds its segment by an equality on (bucket, rank // width) and looks at the few segments
    of that block. There are at most as many rows as segments and blocks, eight blocks a segment.
    """
    ends, many = {}, {}
    for b, start, ranks, *_ in segments:
        ends[b] = max(ends.get(b, 0), start + ranks)
        many[b] = many.get(b, 0) + 1
    width = {b: max(1, -(-ends[b] // (8 * many[b]))) for b in ends}
    return width, [(b, k, start, ranks, *rest) for b, start, ranks, *rest in segments for k in range(start // width[b], (start + ranks - 1) // width[b] + 1)]


def plan(bounds: list[int], counts: list[int], capacity: int, top_up: bool = True) -> list[tuple[int, int, int, int, int, int, int]]:
    """Segments (bucket, rank_from, ranks, container, per_container, place, offset).

    Items of a bucket with ranks from ``rank_from`` fill ``per_container`` slots each of containers
    from ``container`` on, starting at slot ``place`` and token ``offset``. Largest buckets first.
    Each pattern repeats until a bucket runs short, so there are at most a few times as many
    segments as buckets, squared in the worst case - whatever the number of items. Without
    ``top_up`` batches hold items of one bucket only (to measure what topping up saves).
    """
    left, used = list(counts), [0] * len(bounds)
    out, container = [], 0
    for b in reversed(range(len(bounds))):
        while left[b] > 0:
            room, pattern = capacity, []
            for x in range(b, -1 if top_up else b - 1, -1):
                if bounds[x] <= room and left[x] > 0:
                    m = min(room // bounds[x], left[x])
                    pattern.append((x, m))
                    room -= m * bounds[x]
            times = min(left[x] // m for x, m in pattern)
            place = offset = 0
            for x, m in pattern:
                out.append((x, used[x], m * times, container, m, place, offset))
                used[x] += m * times
                left[x] -= m * times
                place += m
                offset += m * bounds[x]
            container += times
    return out


def pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, length): an item over the capacity is cut into full pieces and a rest; others stay whole."""
    parts = F.greatest(F.ceil(F.col(size) / capacity), F.lit(1)).cast("int")
    return sizes.select(key, size, F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece")).select(
        key, "piece", F.least(F.lit(capacity), F.col(size) - F.col("piece") * capacity).cast("int").alias("length")
    )


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, buckets: int = 256, rows_per_part: int = 50_000) -> DataFrame:
    """(key, piece, length, container, place, offset) for every piece of every item.

    ``sizes`` is read three times: write it or checkpoint it before. ``offset`` is where the piece
    starts within its container. Items of size 0 or null take no space: one row of length 0 with a
    null container. Equal keys are different items. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    whole = pieces(sizes.select(key, F.coalesce(F.col(size), F.lit(0)).alias(size)), key, size, capacity)
    some = whole.where(F.col("length") > 0)
    # At most `capacity` rows, whatever the input.
    hist = some.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    if not hist:
        return whole.select(key, "piece", "length", *[F.lit(None).cast(t).alias(n) for n, t in (("container", "long"), ("place", "int"), ("offset", "int"))])
    lengths, counts = np.array([r.length for r in hist]), np.array([r.n for r in hist])
    bounds = bucket_bounds(lengths, counts, buckets)
    of = np.searchsorted(bounds, lengths)
    segments = plan(bounds, [int(counts[of == b].sum()) for b in range(len(bounds))], capacity)
    width, rows = by_blocks(segments)
    # At most `capacity` lengths, and the segments by blocks: both follow the buckets, not the items.
    of_length = spark.createDataFrame([(int(n), int(b), int(bounds[b]), width[int(b)]) for n, b in zip(lengths, of)], "length int, _b int, _bound int, _width long")
    of_rank = spark.createDataFrame(rows, "_b int, _block long, _from long, _ranks long, _container long, _per int, _place int, _offset int")
    parts = max(1, int(counts.sum()) // rows_per_part)
    keyed = some.join(F.broadcast(of_length), "length").withColumn("_part", F.pmod(F.xxhash64(key, "piece"), F.lit(parts)).cast("int"))
    tally = keyed.groupBy("_b", "_part").agg(F.count(F.lit(1)).alias("_n"))
    start = tally.select("_b", "_part", (F.sum("_n").over(Window.partitionBy("_b").orderBy("_part")) - F.col("_n")).alias("_start"))
    ranked = (
        keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_b", "_part").orderBy(key, "piece")) - 1)
        .join(start, ["_b", "_part"])
        .withColumn("_r", F.col("_r") + F.col("_start"))
        .withColumn("_block", F.expr("_r div _width"))
    )
    q = F.col("_r") - F.col("_from")
    slot = (q % F.col("_per")).cast("int")
    placed = ranked.join(F.broadcast(of_rank), ["_b", "_block"]).where((q >= 0) & (q < F.col("_ranks"))).select(
        key,
        "piece",
        "length",
        (F.col("_container") + F.floor(q / F.col("_per"))).cast("long").alias("container"),
        (F.col("_place") + slot).cast("int").alias("place"),
        (F.col("_offset") + slot * F.col("_bound")).cast("int").alias("offset"),
    )
    none = whole.where(F.col("length") <= 0).select(key, "piece", "length", F.lit(None).cast("long").alias("container"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("offset"))
    return placed.unionByName(none)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens and the share of space left unused."""
    return packed.agg(
        F.countDistinct("container").alias("n_containers"), F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces")
    ).withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * capacity), 6))
