"""Operators on small frames: nulls, empty tables, ties, repeated rows, clashing columns, hot keys."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import drift, figures, intervals, lagged, lookups, orphans, packed, pages, planning, policy, reconcile, sampling, state, validate


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_periods_and_gaps(spark):
    random.seed(3)
    spans = [("hot" if random.random() < 0.4 else f"k{random.randrange(5)}", a := random.randrange(900), a + random.randrange(-3, 40)) for _ in range(300)] + [(None, 1, 2), ("n", None, 3), ("n", 3, None)]
    aims = [(None, 0, 5), ("hot", 5, 700), ("hot", 650, 800), ("only", 10, 12), ("n", 9, 8)]
    cover = spark.createDataFrame(spans, "k string, lo int, hi int")
    target = spark.createDataFrame(aims, "k string, lo int, hi int")
    got = rows(intervals.periods_and_gaps(cover, target, ["k"], 16))
    named, aimed = {}, {}
    for into, src in ((named, spans), (aimed, aims)):
        for k, a, b in src:
            if a is not None and b is not None and a <= b:
                into.setdefault(k, set()).update(range(a, b + 1))

    def runs(s):
        s, out = sorted(s), []
        for x in s:
            if out and out[-1][1] == x - 1:
                out[-1][1] = x
            else:
                out.append([x, x])
        return out

    want = []
    for k in set(named) | set(aimed):
        c = named.get(k, set())
        t = aimed.get(k) or set(range(min(c), max(c) + 1))
        want += [(k, "period", *r) for r in runs(c)] + [(k, "gap", *r) for r in runs(t - c)]
    assert got == sorted(want, key=repr)
    assert rows(intervals.periods(cover.limit(0), ["k"])) == []
    assert rows(intervals.periods_and_gaps(cover.limit(0), target.limit(0), ["k"])) == []
    assert rows(intervals.periods(cover, ["k"], 16)) == sorted([w[:1] + w[2:] for w in want if w[1] == "period"], key=repr)
    # A long interval is two rows, whatever it spans.
    long = spark.createDataFrame([("a", 1, 999_999_999), ("a", 5, 6), ("a", -7, -3), ("a", 1_000_000_002, 1_000_000_003)], "k string, lo int, hi int")
    assert intervals.clip(long, None, ["k"], 256).count() == 8
    assert rows(intervals.periods_and_gaps(long, target.limit(0), ["k"])) == [("a", "gap", -2, 0), ("a", "gap", 1000000000, 1000000001), ("a", "period", -7, -3), ("a", "period", 1, 999999999), ("a", "period", 1000000002, 1000000003)]


def test_runs_upwards(spark):
    random.seed(12)
    found = [(random.choice("ab"), random.randrange(400)) for _ in range(160)]
    d = spark.createDataFrame(found, "k string, n int")
    got = intervals.tolerant_runs(d, ["k"], "n", 3, 2)
    want, last = [], {}
    for k in "ab":
        runs = []
        for x in sorted({n for q, n in found if q == k}):
            if runs and x - runs[-1][1] - 1 <= 3:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        runs = [r for r in runs if r[1] - r[0] >= 2]
        want += [(k, *r) for r in runs]
        lo, hi = runs[-1]
        for a, b in reversed(runs[:-1]):
            if lo - b > 6 or b - a >= 25:
                break
            lo = a
        last[k] = (k, lo, hi)
    assert rows(got) == sorted(want, key=repr)
    assert rows(intervals.merge_upwards(got, ["k"], 6, 25, 16)) == [last["a"], last["b"]]


def test_as_of_over_shards(spark):
    random.seed(13)
    left = [(random.choice(["hot", "hot", "b", None]), random.choice([None, *range(-40, 300)]), i) for i in range(300)]
    right = [(random.choice(["hot", "b", "c"]), random.choice([None, *range(-40, 300, 7)])) for _ in range(40)]
    l, r = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, pt int")
    pts = {k: sorted({p for q, p in right if q == k and p is not None}) for k in ("hot", "b", "c")}
    fwd = {x.i: x.found for x in lookups._asof(l, r, ["k"], "at", "pt", True, 16).select("_row.*", "found").collect()}
    back = {x.i: x.found for x in lookups._asof(l, r, ["k"], "at", "pt", False, 16).select("_row.*", "found").collect()}
    for k, at, i in left:
        own = pts.get(k, []) if at is not None else []
        assert fwd[i] == min((p for p in own if p > at), default=None) and back[i] == max((p for p in own if p <= at), default=None), (k, at)


def test_previous_over_shards(spark):
    random.seed(1)
    data = [(random.choice("ab"), i, f"v{i}") for i in random.sample(range(2000), 300)]
    d = spark.createDataFrame(data, "k string, n int, v string")
    got = {(r.k, r.n): r.v_before for r in lagged.previous(d, ["k"], "n", ["v"], F.floor(F.col("n") / 50)).collect()}
    for k in "ab":
        own = sorted(r for r in data if r[0] == k)
        assert [got[k, n] for _, n, _ in own] == [None, *[v for _, _, v in own]][: len(own)]


def test_drift(spark):
    raw = [
        (1, "f", 1, '{"offset": 3, "pages": 9, "x": [1]}'), (2, "f", 1, '{ "x":[1], "offset":3,"pages":9}'), (3, "f", 2, None), (4, "f", 3, "{broken"), (5, "f", 3, "[1]"),
        (6, "f", 5, '{"pdf_offset": "pdf = printed + 4", "pages": null, "y": true, "clean": {"keep": "a", "skip": "b"}}'), (7, "f", 6, '{"pdf_offset": "n/a", "pages": "7", "y": 1} tail'),
        (8, "f", 7, '{"pdf_offset": "n/a", "pages": "7", "y": "s"}'), (9, "g", 1, "{}"),
    ]
    d = spark.createDataFrame(raw, "map_id int, map_file string, rev int, raw string").withColumn("types", F.lit("clash"))
    r = drift.ingest(d, ["map_file", "rev"], "raw", "map_id")
    assert rows(r.select("map_file", "rev")) == [("f", 1), ("f", 5), ("f", 7), ("g", 1)]
    assert rows(drift.changes(r, ["map_file"], "rev")) == sorted([
        ("f", 5, "pdf_offset", "renamed"), ("f", 5, "pdf_offset", "retyped"), ("f", 5, "x", "removed"), ("f", 5, "y", "added"), ("f", 5, "clean", "added"),
        ("f", 7, "clean", "removed"), ("f", 7, "y", "retyped"),
    ], key=repr)
    t = {(x.map_file, x.rev): x for x in drift.rows(r, ["map_file", "rev"]).collect()}
    assert (t["f", 1].page_offset, t["f", 1].page_count, json.loads(t["f", 1].rescued)) == (3, 9, {"x": [1]})
    assert (t["f", 5].page_offset, t["f", 5].page_count, t["f", 5].structure_notes) == (4, None, "a b") and json.loads(t["f", 5].rescued) == {"pages": None, "y": True}
    assert t["f", 7].page_offset is None and json.loads(t["f", 7].rescued) == {"pdf_offset": "n/a", "y": "s"}
    again = {x.rev: x for x in drift.replay(drift.rows(r, ["map_file", "rev"]), drift.Piece("y", ("y",), "text")).where("map_file = 'f'").collect()}
    assert again[7].y == "s" and json.loads(again[7].rescued) == {"pdf_offset": "n/a"} and again[5].y is None
    assert rows(drift.changes(drift.ingest(d.limit(0), ["map_file", "rev"], "raw", "map_id"), ["map_file"], "rev")) == []


def test_drift_loses_nothing(spark):
    """Two fields of one piece, null order of deliveries, null keys, a null name, and approved names as a table."""
    raw = [(None, "f", 1, '{"offset": 3, "pdf_offset": 4, "pages": "x"}'), (2, None, None, '{"offset": 1}'), (3, "g", 1, '{"offset": null}'), (None, "g", 1, None)]
    d = spark.createDataFrame(raw, "map_id int, map_file string, rev int, raw string")
    r = drift.ingest(d, ["map_file", "rev"], "raw", "map_id")
    got = {x.map_file: x for x in r.collect()}
    assert set(got) == {"f", None, "g"} and got["f"].page_offset == 3 and json.loads(got["f"].rescued) == {"pdf_offset": 4, "pages": "x"}
    assert got["g"].page_offset is None and json.loads(got["g"].rescued) == {"offset": None}
    filled = drift.replay(drift.rows(r, ["map_file", "rev"]), drift.Piece("page_offset", ("offset", "pdf_offset"), "int")).where("map_file = 'f'").collect()[0]
    assert filled.page_offset == got["f"].page_offset and json.loads(filled.rescued) == json.loads(got["f"].rescued)
    s = drift.TargetSchema.approved(drift.MAP_SCHEMA.table(spark))
    assert s == drift.MAP_SCHEMA and rows(drift.ingest(d.limit(0), ["map_file", "rev"], "raw", "map_id", s)) == []
    with pytest.raises(ValueError):
        drift.TargetSchema.approved(drift.MAP_SCHEMA.table(spark), most=3)


def _events(spark, seed):
    random.seed(seed)
    ev = []
    for i in range(400):
        k = "hot" if random.random() < 0.35 else f"k{random.randrange(25)}"
        at = f"2024-{random.randrange(1, 13):02d}-{random.randrange(1, 28):02d} 00:00:00"
        ev.append((k, at, 2, "t", i))
    for k in ["hot", *[f"k{i}" for i in range(20)]]:
        day = 1
        for _ in range(random.randrange(1, 4)):
            a, b = sorted(random.sample(range(day, day + 120), 2))
            if b > 360:
                break
            date = lambda n: f"2024-{(n - 1) // 30 + 1:02d}-{(n - 1) % 30 % 28 + 1:02d} 00:00:00"
            if date(a) >= date(b):
                continue
            ev += [(k, date(a), 0, None, None), (k, date(b), 1, None, None)]
            day = b + 40
    return ev, spark.createDataFrame(ev, "key string, at string, kind int, tbl string, row_id long").withColumn("at", F.col("at").cast("timestamp"))


def test_orphans_in_batches_equal_all_at_once(spark):
    ev, d = _events(spark, 5)
    whole = rows(orphans.OrphanState.empty(d).open_orphans().select("tbl", "row_id", "state"))
    want = []
    for k, at, kind, t, i in ev:
        if kind == 2:
            own = [e for e in ev if e[0] == k and e[2] < 2]
            w = sum(e[2] == 0 and e[1] <= at for e in own)
            gone = sum(e[2] == 1 and e[1] <= at for e in own)
            s = "missing" if not any(e[2] == 0 for e in own) else "late" if w == 0 else "deleted" if w <= gone else None
            if s:
                want.append((t, i, s))
    assert whole == sorted(want, key=repr) and {w[2] for w in want} == {"missing", "late", "deleted"}
    n = d.withColumn("b", F.pmod(F.xxhash64("key", "at", "kind", "row_id"), F.lit(3)))
    s = orphans.OrphanState.empty(n.where("b = 0").drop("b"))
    for i in (1, 2, 2):  # the last batch comes twice
        s = s.advance(n.where(f"b = {i}").drop("b"))
    assert rows(s.open_orphans().select("tbl", "row_id", "state")) == whole
    assert sum(r.n_missing + r.n_late + r.n_deleted for r in s.snapshot().collect()) == len(whole)


def test_orphans_of_two_parents_deleted_at_once(spark):
    """Two files of one path, written on different days and deleted on the same: both must count as deleted, in any batches."""
    day = lambda n: F.to_timestamp(F.lit(f"2024-01-{n:02d}"))
    f = spark.range(2).select(F.lit("a").alias("file"), F.when(F.col("id") == 0, day(1)).otherwise(day(2)).alias("w"), day(9).alias("d"))
    r = spark.range(4).select("id", F.lit("a").alias("file"), F.element_at(F.array(day(15), day(5), day(9), F.lit(None).cast("timestamp")), (F.col("id") + 1).cast("int")).alias("at"))
    p, q = orphans.parents(f, F.col("file"), "w", "d"), orphans.references(r, "t", "id", F.col("file"), "at")
    want = [(0, "deleted"), (2, "deleted")]
    assert rows(orphans.OrphanState.empty(p.unionByName(q)).open_orphans().select("row_id", "state")) == want
    for few in (0, 100):
        s = orphans.OrphanState.empty(q)
        assert rows(s.open_orphans().select("row_id", "state")) == [(i, "missing") for i in range(4)]
        s = s.advance(p.where("kind = 0"), few=few)
        assert rows(s.open_orphans()) == []
        s = s.advance(p.where("kind = 1"), few=few).advance(p.unionByName(q), few=few)
        assert rows(s.open_orphans().select("row_id", "state")) == want
    gone = f.limit(1).withColumn("d", day(1) - F.expr("interval 1 day"))
    assert rows(orphans.OrphanState.empty(orphans.parents(gone, F.col("file"), "w", "d").unionByName(q)).open_orphans().select("row_id", "state")) == [(0, "deleted"), (1, "deleted"), (2, "deleted")]


def test_orphans_edges(spark):
    f = spark.createDataFrame([("a", "2024-01-02", None), ("a", "2024-01-02", None), ("b", "2024-01-01", "2024-01-03"), (None, "2024-01-01", None)], "file string, w string, d string")
    f = f.withColumn("w", F.col("w").cast("timestamp")).withColumn("d", F.col("d").cast("timestamp"))
    r = spark.createDataFrame([(1, "a", "2024-01-02"), (2, "b", "2024-01-03"), (3, "c", "2024-01-03"), (4, None, "2024-01-03"), (5, "a", "2024-01-01"), (6, "a", None), (7, "c", None)], "id int, file string, at string").withColumn("at", F.col("at").cast("timestamp"))
    ev = orphans.references(r, "t", "id", F.col("file"), "at").unionByName(orphans.parents(f, F.col("file"), "w", "d"))
    assert rows(orphans.OrphanState.empty(ev).open_orphans().select("row_id", "state")) == [(2, "deleted"), (3, "missing"), (5, "late"), (7, "missing")]
    assert rows(orphans.fold(ev.limit(0))) == []


def test_unpack(spark):
    d = spark.createDataFrame([(1, "a, b", 1), (1, "a, b", 2), (2, "a", 1), (3, None, 1), (None, "a,b", 1), (4, "a,,a", 1)], "id int, tags string, pos int")
    assert rows(packed.unpack_tags(d, "id", "tags", 2)) == [(1, 1, "a"), (1, 2, "b"), (4, 1, "a"), (4, 2, "a")]
    assert rows(packed.unpack_pages(d.limit(0), "id", "tags")) == []


def test_pages(spark):
    d = spark.createDataFrame([("d", i, "licensed to ACME" + ("\nreal text of this very page" if i % 2 else "")) for i in range(4)] + [("e", 1, "licensed to ACME"), ("f", 1, None)], "doc string, page int, text string")
    assert rows(pages.boilerplate(d, "doc", "page", "text")) == [("d", "licensedtoACME")]
    got = {r.doc: r for r in pages.text_layer(d, "doc", "page", "text").collect()}
    assert (got["d"].pages_with_text, got["d"].verdict) == (2, "mixed") and got["e"].verdict == "scanned" and got["f"].chars_total == 0
    n = spark.createDataFrame([("d", i) for i in range(130)], "doc string, page int")
    assert [r.page for r in pages.stride_sample(n, "doc", "page").orderBy("page").collect()] == list(range(0, 130, 2)) == [r.page for r in pages.stride_sample(n, "doc", "page", None).orderBy("page").collect()] == [r.page for r in pages.stride_sample(n, "doc", "page", 16).orderBy("page").collect()]
    u = spark.createDataFrame([("d", "x" * n) for n in (1, 2, 3, 4)], "doc string, text string")
    assert pages.usable_text(u, "doc", "text").collect()[0].median_length == 3  # the upper median


def test_runs_and_regions(spark):
    lang = "aaabaaaaaabbbbaaa"
    d = spark.createDataFrame([("d", i, c, "any") for i, c in enumerate(lang)], "doc string, page int, lang string, version string")
    r = pages.runs(d, "doc", "page", ["lang", "version"])
    assert [(x.start, x.end) for x in r.orderBy("start").collect()] == [(0, 2), (3, 3), (4, 9), (10, 13), (14, 16)]
    assert rows(pages.target_region(r, "doc", "a", "final")) == rows(pages.target_region(r, "doc", "a", "final", width=None)) == [("d", 0, 9)]  # a gap of 1 joins, one of 5 does not
    random.seed(14)
    many = spark.createDataFrame([(random.choice("xy"), i, random.choice("aab"), random.choice(["any", "final", None])) for i in random.sample(range(900), 500)], "doc string, page int, lang string, version string")
    two = pages.runs(many, "doc", "page", ["lang", "version"], 64)
    assert rows(two) == rows(pages.runs(many, "doc", "page", ["lang", "version"], None))
    assert rows(pages.target_region(two, "doc", "a", "final", width=32)) == rows(pages.target_region(two, "doc", "a", "final", width=None))
    ff = spark.createDataFrame([("d", i, v) for i, v in enumerate([None, "x", None, "y"])], "doc string, page int, hit string")
    assert [x.v for x in pages.forward_fill(ff, "doc", "page", "hit", "v").orderBy("page").collect()] == ["any", "x", "x", "y"]
    random.seed(6)
    big = [(random.choice(["a", "b", None]), i, random.choice([None, None, None, str(i)])) for i in range(400)]
    bf = spark.createDataFrame(big, "k string, n int, v string")
    whole = rows(pages.forward_fill(bf, "k", "n", "v", "f"))
    assert rows(pages.forward_fill(bf, "k", "n", "v", "f", shard=F.floor(F.col("n") / 30))) == whole
    p = spark.createDataFrame([("d", 10, [3, 8]), ("d", 11, [9]), ("d", 12, [5, 99])], "doc string, page int, c array<int>")
    reg = spark.createDataFrame([("d", 1, 20)], "doc string, start int, end int")
    assert rows(pages.page_offset(p, "doc", "page", "c", reg)) == [("d", 7, 2, 4)]


@pytest.mark.parametrize("s, e, kids, want", [
    (1, 30, [], [(1, 12), (12, 23), (23, 30)]), (1, 12, [5], [(1, 12)]), (5, 3, [], [(5, 5)]), (1, 20, [8, 15], [(1, 7), (7, 14), (14, 20)]),
    (1, 40, [30], [(1, 12), (12, 23), (23, 29), (29, 40)]), (1, 24, [13], [(1, 12), (12, 23), (23, 24)]),
])
def test_pack(spark, s, e, kids, want):
    d = spark.createDataFrame([(s, e, kids)], "s int, e int, k array<int>")
    assert [(w.lo, w.hi) for w in d.select(planning.pack(F.col("s"), F.col("e"), F.col("k"), 12, 1).alias("w")).collect()[0].w] == want


def test_plan_of_some_chapters(spark):
    o = spark.createDataFrame([("d", [(1, "1 A", 3), (2, "1.1 B", 5), (1, "2 C", 9), (1, "no number", 10), (1, "3 D", None)], 400)], "doc string, outline array<struct<level:int,title:string,page:int>>, pages int")
    p = planning.plan_fragments(o, "doc", "outline", "pages").orderBy("pos", "part").collect()
    assert [(r.clause, r.lo, r.hi) for r in p[:3]] == [("1", 3, 4), ("1.1", 5, 8), ("2", 9, 20)] and len({r.target_file for r in p}) == len(p) == 38 and p[-1].hi == 400
    assert "aa-" in p[28].target_file
    assert {r.clause for r in planning.plan_fragments(o, "doc", "outline", "pages", heads=["1"]).collect()} == {"1", "1.1"}
    assert planning.plan_fragments(o.limit(0), "doc", "outline", "pages").collect() == []


def test_tile_and_coverage(spark):
    d = spark.createDataFrame([(1, 30), (4, 4), (5, 3), (1, 13)], "s int, e int")
    got = [[(w.lo, w.hi) for w in r.w] for r in d.select(planning.tile(F.col("s"), F.col("e"), 12, 1).alias("w")).collect()]
    assert got == [[(1, 12), (12, 23), (23, 30)], [(4, 4)], [(5, 5)], [(1, 12), (12, 13)]]
    with pytest.raises(ValueError):
        planning.tile(F.col("s"), F.col("e"), 3, 3)
    spans = spark.createDataFrame([("d", 1, 5), ("d", 5, 7), ("d", 40, 41)], "doc string, lo int, hi int")
    body = spark.createDataFrame([("d", 1, 10), ("e", 1, 2)], "doc string, body_start int, body_end int")
    assert rows(planning.coverage(spans, body, "doc")) == [("d", 10, 7, 3, 70.0, 1, 1, 41, "8,9,10"), ("e", 2, 0, 2, 0.0, 0, None, None, "1,2")]
    long = spark.createDataFrame([("d", 1, 999_999_999), ("d", 500, 600)], "doc string, lo int, hi int")
    assert rows(planning.coverage(long, spark.createDataFrame([("d", 1, 1_000_000_100)], "doc string, body_start int, body_end int"), "doc"))[0][2:6] == (999_999_999, 101, 100.0, 101)


def test_plan_windows_cover_sections(spark, data):
    from sheaf.plans import records

    o = records.outlines(spark, data)
    p = planning.plan_fragments(o, "doc", "outline", "pages").collect()
    e = planning.numbered_entries(o, "doc", "outline")
    s = {(r.doc, r.pos): (r.page, r.section_end) for r in planning.section_spans(e, planning.body_range(e, o, "doc", "pages"), "doc").collect()}
    got = {}
    for r in p:
        assert r.hi - r.lo + 1 <= 12 and r.est_pages == r.hi - r.lo + 1
        got.setdefault((r.doc, r.pos), set()).update(range(r.lo, r.hi + 1))
    assert {k: (min(v), max(v), len(v)) for k, v in got.items()} == {k: (a, max(a, b), max(a, b) - a + 1) for k, (a, b) in s.items()}


def test_reconcile(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "file string")
    b = spark.createDataFrame([("y",), ("z",)], "file string")
    assert rows(reconcile.reconcile(a, b, "file")) == [("x", "left_only"), ("z", "right_only")]
    assert rows(reconcile.duplicates(a, "file")) == [("x", 2)]
    docs = spark.createDataFrame([("a/b.md", "[1](c.md#x) [2](../d/e.md) [3](http://x/y.md) [4](f.md)")], "file string, raw string")
    known = spark.createDataFrame([("a/c.md",), ("d/e.md",)], "f string")
    assert rows(reconcile.dangling_links(docs, "file", "raw", known, "f")) == [("a/b.md", "f.md", "a/f.md")]
    t = spark.createDataFrame([(1, "# A b\n## A b\n```\n# A b\n```\n[x](#a-b-1) [y](#A-b) [z](#a-b-2)")], "k int, t string")
    assert rows(reconcile.dangling_anchors(t, "k", "t")) == [(1, "A-b")]
    r = spark.createDataFrame([("x", None), ("x", ""), ("y", None), ("y", "z")], "file string, raw string")
    assert rows(reconcile.dead_results(a.union(spark.createDataFrame([("n",)], "file string")), r, "file", "raw")) == [("n", 0), ("x", 2)]
    n = spark.createDataFrame([(1, "a\nb\n"), (2, "a\nb\nc")], "k int, t string")
    assert rows(reconcile.line_counts(n, "k", "t", 2)) == [(2, 3)]


def test_policy(spark):
    d = spark.createDataFrame([("a 'x' 1", "error", "api/x", 1), ("boom", "INFO", "b", 2), ("boom", "error", "b", 3)], "m string, s string, f string, o int")
    default, rules = policy.policy({"default": "ignore", "rules": [{"description": "(", "action": "fix"}, {"paths": ["**/api/**"], "action": "odd"}, {"severity": "info", "action": "suppress"}]})
    r = policy.route(policy.first_match(d, rules, "m", "s", "f"), rules, default, "s", ("ERROR",))
    assert rows(r.select("o", "rule_idx", "bucket", "pinned_action", "policy_reason")) == [(1, 1, "actionable", "auto", ""), (2, 2, "outOfScope", None, None), (3, None, "ignored", None, "default: ignore")]
    assert policy.policy(None, [{"description": "x"}]) == ("auto", [{"description": "x", "action": "ignore"}])
    assert [(x.template, x.n, x.severity) for x in policy.message_types(d, "m", "f", "s", "o").orderBy(F.desc("n"), "first_seen").collect()] == [("boom", 2, "INFO"), ("a '…' #", 1, "error")]


def test_sampling(spark):
    d = spark.createDataFrame([("g", "k" + str(i % 2), i) for i in range(25)], "g string, k string, i int")
    assert [r.i for r in sampling.stratified(d, "g", "k", "i", 1, 10).orderBy("i").collect()] == sorted({0, 1, *range(0, 25, 2)})
    assert [r.rn for r in sampling.numbered(d, [F.desc("i")], rows_per_part=5).orderBy(F.desc("i")).collect()] == list(range(1, 26))
    assert max(r.batch for r in sampling.batches(d, "g", "i", 10).collect()) == 2
    # A payload column beside the order, and the same numbers on every reading.
    big = spark.range(20000).select((F.col("id") * 7919 % 20011).alias("i"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    n = sampling.numbered(big, [F.col("i")], rows_per_part=1500)
    assert [r.rn for r in n.orderBy("i").collect()] == list(range(1, 20001)) and sampling.numbered(big.limit(0), [F.col("i")]).count() == 0


def test_lookups(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y"), ("b", 3, "z"), ("a", 9, "w")], "k string, at int, found0 string")
    right = spark.createDataFrame([("a", 5), ("a", 3), ("a", 5), ("a", None)], "k string, pt int")
    assert {r.found0: r.found for r in lookups.next_after(left, right, ["k"], "at", "pt").collect()} == {"x": None, "y": 3, "z": None, "w": None}
    assert {r.found0: r.found for r in lookups.last_before(left, right, ["k"], "at", "pt").collect()} == {"x": 5, "y": 3, "z": None, "w": 5}
    t = spark.createDataFrame([(1, None), (2, 1), (3, 2), (9, 8)], "n int, p int")
    assert rows(lookups.flatten_tree(t, "n", "p").select("n", "level")) == [(1, 1), (2, 2), (3, 3)]
    long = spark.createDataFrame([(12345, None), (12399, 12345), (7, 12399)], "n int, p int")
    assert rows(lookups.flatten_tree(long, "n", "p")) == [(12345, 1, "12345"), (12399, 2, "12345/12399"), (7, 3, "12345/12399/7")]


def test_state(spark):
    log = spark.createDataFrame([("a", "1", 1), ("a", "2", 3), ("a", "3", 2), (None, "x", 9)], "k string, v string, at int")
    s = state.compact(log, "k", "v", "at", "v")
    assert rows(s) == [("a", "2", 3)]
    w = spark.createDataFrame([("a", "9", 9), ("zz", "x", 9)], "k string, v string, at int")
    assert rows(state.apply_writes(s, w, "k", "v", "at", ["a"])) == [("a", "9", 9)]
    assert rows(state.init_if_absent(s, w, "k", "v", "at")) == [("a", "2", 3), ("zz", "x", 9)]
    touched = state.apply_writes(s, w, "k", "v", "at", ["a"], touch="updated_at")
    assert rows(touched) == [("a", "9", 9), ("updated_at", "9", 9)] and rows(state.apply_writes(s, w, "k", "v", "at", ["none"], touch="updated_at")) == [("a", "2", 3)]
    kept, empty = state.archive(touched, None, "k", "v", "at", F.lit("t1"))
    assert rows(kept) == [("a", "9", 9, "t1"), ("updated_at", "9", 9, "t1")] and rows(empty) == []
    assert rows(state.archive(s, kept, "k", "v", "at", F.lit("t1"))[0]) == rows(kept) and len(rows(state.archive(s, kept, "k", "v", "at", F.lit("t2"))[0])) == 3


GOOD = """---
date: "2024-05-01"
researcher: "x"
topic: "t"
tags: ["research", "a"]
status: "complete"
last_updated: "2024-05-01T10:00:00+02:00"
last_updated_by: "x"
---
# T

Summary. One open question remains.
"""


def test_research_document(spark):
    bad = GOOD.replace('status: "complete"', 'status: "done"\nbranch: "b"').replace('"research", ', "").replace("# T", "```\n# no\n```").replace("last_updated_by", "last_by")
    d = spark.createDataFrame([("good", GOOD), ("bad", bad), ("none", ""), ("null", None)], "k string, raw string")
    got = {}
    for r in validate.research_document(d, "k", "raw").collect():
        got.setdefault(r.k, set()).add((r.check, r.detail))
    assert "good" not in got and "null" not in got
    assert {("unknown status", "done"), ("missing field", "last_updated_by"), ("repository incomplete", "dirty, git_commit, repository"), ("titles", "0"), ("no research tag", "")} <= got["bad"]
    assert ("start", "") in got["none"]
    s = {r.k: r.ok for r in validate.summary(validate.research_document(d, "k", "raw"), d, "k", strict=True).collect()}
    assert s["good"] and not s["bad"]


def test_plan_document(spark):
    plan = "**Status:** Ready\n**Re-ground before:** x\n## Work Package 1: A\n**ID:** WP2\n### 1.1 sub\ntext\n### Tests\n## Open Decisions\n| Decision |\n|---|\n"
    d = spark.createDataFrame([(1, plan)], "k int, t string")
    got = {(r.check, r.detail) for r in validate.plan_document(d, "k", "t").collect()}
    assert {("ready with open decisions", ""), ("wrong package id", "WP2"), ("package without depends on", "WP1"), ("package without verification", "WP1"), ("subtask without declaration", "WP1")} <= got
    assert ("package without tests", "WP1") not in got and ("no packages", "") not in got
    fence = spark.createDataFrame([(1, "# a\n~~~\n```\n# b\n~~~\n# c")], "k int, t string")
    assert [(r.title, r.line) for r in validate.headings(fence, "k", "t").orderBy("line").collect()] == [("a", 1), ("c", 6)]


def test_figures(spark):
    w = [("p", 10, 100, 20, 110, "Figure"), ("p", 21, 100, 25, 110, "3"), ("p", 26, 101, 40, 111, "Frames"), ("p", 60, 100, 70, 110, "Fig."), ("p", 71, 100, 75, 110, "4:"), ("p", 2, 100, 4, 110, "17"), ("p", 10, 5, 20, 9, "Figure"), ("p", 21, 5, 25, 9, "9")]
    d = spark.createDataFrame([(a, float(x0), float(y0), float(x1), float(y1), t) for a, x0, y0, x1, y1, t in w], "page string, x0 double, y0 double, x1 double, y1 double, word string")
    assert sorted((r.num, r.text) for r in figures.captions(d, ["page"], 800.0).collect()) == [(3, "Figure 3 Frames"), (4, "Fig. 4:")]
    f = spark.createDataFrame([("# Figure 03 x\ntext",)], "raw string").withColumn("file", F.lit("a"))
    g = spark.createDataFrame([("a", 3, "c", 1, "i.png"), ("a", 4, "Figure 4: d", 2, "j.png")], "file string, num int, caption string, page int, image string")
    once, h, a, t = figures.inject_figures(f, g).select("raw", "n_heading", "n_appended", "n_there").collect()[0]
    assert (h, a, t) == (1, 1, 0) and "**Figure 4 — d**" in once
    twice = figures.inject_figures(figures.inject_figures(f, g).select("file", "raw"), g).collect()[0]
    assert (twice.raw, twice.n_heading, twice.n_appended, twice.n_there) == (once, 0, 0, 2)
    assert once == "# Figure 03 x\n\n![c (source p.1)](i.png)\n\ntext\n\n## Figures\n\n**Figure 4 — d** (source p.2)\n\n![Figure 4](j.png)\n"
    # Several below one heading, the greatest number first; one image twice, a null page, clashing and null texts.
    f = spark.createDataFrame([("a", "x\n## Fig. 2 and figure 10\r\n# figure 2\nend \n"), ("b", None), ("c", "")], "file string, raw string")
    g = spark.createDataFrame([("a", 2, " p ", None, "p.png"), ("a", 10, "q", 7, "q.png"), ("a", 10, "r", 8, "q.png"), ("a", 1, None, 1, "s.png"), ("b", 1, "c", 1, "i.png"), ("zz", 1, "c", 1, "i.png"), ("a", None, "n", 1, "n.png")], "file string, num int, caption string, page int, image string")
    got = {r.file: r for r in figures.inject_figures(f, g).collect()}
    assert got["a"].raw == "x\n## Fig. 2 and figure 10\r\n\n![q (source p.7)](q.png)\n\n\n![p (source p.?)](p.png)\n\n# figure 2\nend\n\n## Figures\n\n**Figure 1 — ** (source p.1)\n\n![Figure 1](s.png)\n"
    assert tuple(got["a"])[2:] == (2, 1, 1) and tuple(got["b"])[1:] == (None, 0, 0, 0) and got["c"].raw == ""
    files, figs = spark.createDataFrame([("a.md", "# Fig 1"), ("b.md", "x")], "file string, raw string"), spark.createDataFrame([("a.md", 1, "c", 1, "i.png")], "file string, num int, caption string, page int, image string")
    assert {r.file: r.n_heading for r in figures.inject_figures(files, figs).collect()} == {"a.md": 1, "b.md": 0}
    import numpy as np

    img = np.full((100, 50), 255, np.uint8)
    img[60:95, 10:40] = 0
    img[2:30, :] = 0
    r = spark.createDataFrame([(bytearray(img.tobytes()), 50), (None, 50)], "b binary, w int")
    out = r.select(figures.ink_region("b", "w").alias("i"), figures.crop_box("b", "w").alias("c")).collect()
    assert tuple(out[0].i) == (60, 94, 10, 39) and out[1].i.top is None and tuple(out[0].c) == (0, 100, 0, 50)
    # A narrow block close above joins, with vectors only if it has one; then the guards.
    img[2:30, :5] = img[2:30, 30:] = 255
    path = lambda *r: [dict(zip(("x0", "y0", "x1", "y1"), map(float, x))) for x in r]
    boxes = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    r = spark.createDataFrame([(bytearray(img.tobytes()), 50, path((10, 10, 20, 20), (12, 70, 30, 80)), []), (bytearray(img.tobytes()), 50, path((10, 10, 11, 11)), path((0, 0, 90, 90))), (bytearray(img.tobytes()), 50, None, None), (bytearray(b"\xff" * 100), 50, [], [])], f"b binary, w int, v {boxes}, m {boxes}")
    out = r.select(figures.ink_region("b", "w").alias("i"), figures.ink_region("b", "w", vectors="v").alias("g"), "v", "m").select("i", "g", *[figures.is_figure(F.col("g"), F.col("v"), F.col("m"), F.lit(x), F.lit(x + 10), 100).alias(f"f{x}") for x in (20, 80)]).collect()
    assert [tuple(x.i) for x in out[:3]] == [(2, 94, 5, 39)] * 3 and [tuple(x.g) for x in out] == [(2, 94, 5, 39), (60, 94, 10, 39), (60, 94, 10, 39), (None,) * 4]
    assert [(x.f20, x.f80) for x in out] == [(True, False), (True, False), (False, False), (False, False)]
    png = r.limit(1).withColumn("c", F.struct(F.lit(58).alias("top"), F.lit(97).alias("bottom"), F.lit(8).alias("left"), F.lit(42).alias("right"))).select(figures.cropped_png("b", "w", "c").alias("p")).collect()[0].p
    import struct
    import zlib

    wide, high = struct.unpack(">II", png[16:24])
    data = png[png.index(b"IDAT") + 4 : -16]
    assert (wide, high) == (34, 39) and png[:4] == b"\x89PNG" and zlib.decompress(data) == b"".join(b"\0" + img[y, 8:42].tobytes() for y in range(58, 97))
