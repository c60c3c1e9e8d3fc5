"""Page windows planned from an outline, and their coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.bind import let
from sheaf.functions.text import letters, pages_text, section_number, title_slug
from sheaf.operators import intervals
from sheaf.operators.policy import top_k
from sheaf.session import written


def tile(start: Column, end: Column, window: int, overlap: int) -> Column:
    """array<struct(lo, hi)>: windows of at most ``window`` places sharing ``overlap`` with the next.

    ``overlap`` must be less than ``window``. A span without length is one window.
    """
    if not 0 <= overlap < window:
        raise ValueError("overlap must be at least 0 and less than window")
    step = window - overlap
    last = F.when(end - start + 1 <= window, F.lit(0)).otherwise(F.ceil((end - start + 1 - window) / step)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct((start + i * step).alias("lo"), F.greatest(start, F.least(end, start + i * step + window - 1)).alias("hi")),
    )


def pack(start: Column, end: Column, children: Column, window: int, overlap: int) -> Column:
    """array<struct(lo, hi)>: windows of [start, end] that end before a child's first page where they can.

    As many whole children as fit go into a window; inner windows start ``overlap`` pages early;
    what is still longer than ``window`` is tiled. ``children``: sorted array of different pages.
    """
    stops = F.filter(children, lambda c: (c > start) & (c <= end))
    closed = lambda a: F.concat(a["out"], F.array(F.struct(a["lo"].alias("lo"), (a["last"] - 1).alias("hi"))))
    none = F.struct(start.alias("lo"), F.lit(None).cast("int").alias("last"), F.array().cast("array<struct<lo:int,hi:int>>").alias("out"))

    def step(a: Column, stop: Column) -> Column:
        fits = a["last"].isNull() | (stop - a["lo"] <= window)
        return F.when(fits, F.struct(a["lo"].alias("lo"), stop.alias("last"), a["out"].alias("out"))).otherwise(F.struct(a["last"].alias("lo"), stop.alias("last"), closed(a).alias("out")))

    spans = F.aggregate(F.concat(stops, F.array(end + 1)), none, step, closed)
    early = F.transform(spans, lambda p, i: tile(F.when(i == 0, p["lo"]).otherwise(F.greatest(start, p["lo"] - overlap)), p["hi"], window, overlap))
    return F.when((end - start + 1 <= window) | (F.size(stops) == 0), tile(start, F.greatest(start, end), window, overlap)).otherwise(F.flatten(early))


def numbered_entries(outlines: DataFrame, doc: str, outline: str) -> DataFrame:
    """(doc, pos, page, title, sec): outline entries with a page and a readable section number."""
    e = outlines.select(doc, F.posexplode(outline).alias("pos", "_e")).select(doc, "pos", F.col("_e.page").alias("page"), F.coalesce("_e.title", F.lit("")).alias("title"))
    return e.withColumn("sec", section_number(F.col("title"))).where(F.col("page").isNotNull() & (F.col("page") != 0) & F.col("sec").isNotNull())


def body_range(entries: DataFrame, totals: DataFrame, doc: str, total: str) -> DataFrame:
    """(doc, body_start, body_end): from the first chapter (else entry) to the last page (else entry)."""
    top = F.when((F.size("sec") == 1) & F.get("sec", F.lit(0)).rlike(r"^\d"), F.col("page"))
    b = entries.groupBy(doc).agg(F.min(top).alias("_top"), F.min("page").alias("_min"), F.max("page").alias("_max"))
    return b.join(totals.select(doc, total), doc, "left").select(
        doc, F.coalesce("_top", "_min").alias("body_start"), F.coalesce(F.nullif(F.col(total), F.lit(0)), "_max").alias("body_end")
    )


def section_spans(entries: DataFrame, body: DataFrame, doc: str, heads: Sequence[str] | None = None) -> DataFrame:
    """(doc, pos, page, title, sec, section_end, body_end): chapters and their sections, each up to the next start.

    ``heads`` keeps the chapters named there only.

    The end is the last page before the next different start (sections that start on one page span
    the same), found with ``lead`` over distinct starts.
    """
    units = entries.join(body, doc).where((F.size("sec") <= 2) & F.col("page").between(F.col("body_start"), F.col("body_end")))
    if heads is not None:
        units = units.where(F.get("sec", F.lit(0)).isin(*heads))
    starts = units.select(doc, "page").distinct().withColumn("_next", F.lead("page").over(Window.partitionBy(doc).orderBy("page")))
    end = F.least(F.greatest(F.col("page"), F.coalesce(F.col("_next") - 1, F.col("body_end"))), F.col("body_end"))
    return units.join(starts, [doc, "page"]).withColumn("section_end", end).drop("_next")


def children_of(entries: DataFrame, doc: str) -> DataFrame:
    """(doc, parent, children): sorted first pages of the sections below each section number."""
    return (
        entries.where(F.size("sec") >= 2).groupBy(doc, F.array_join(F.slice("sec", F.lit(1), F.size("sec") - 1), ".").alias("parent"))
        .agg(F.sort_array(F.collect_list("page")).alias("children"))
    )


def _units(outlines: DataFrame, doc: str, outline: str, total: str, heads: Sequence[str] | None = None) -> DataFrame:
    """(doc, _e, _from, _to, _u, _starts): entries, body range, units of the body and their different first pages, by document."""
    d = outlines.select(doc, total, F.transform(outline, lambda e, i: F.struct(i.cast("int").alias("pos"), e["page"].alias("page"), F.coalesce(e["title"], F.lit("")).alias("title"), section_number(F.coalesce(e["title"], F.lit(""))).alias("sec"))).alias("_e"))
    d = d.withColumn("_e", F.filter("_e", lambda e: e["page"].isNotNull() & (e["page"] != 0) & e["sec"].isNotNull()))
    pages = lambda es: F.transform(es, lambda e: e["page"])
    chapters = F.filter("_e", lambda e: (F.size(e["sec"]) == 1) & F.get(e["sec"], F.lit(0)).rlike(r"^\d"))
    d = d.select(doc, "_e", F.coalesce(F.array_min(pages(chapters)), F.array_min(pages("_e"))).alias("_from"), F.coalesce(F.nullif(F.col(total), F.lit(0)), F.array_max(pages("_e"))).alias("_to"))
    kept = lambda e: F.lit(True) if heads is None else F.get(e["sec"], F.lit(0)).isin(*heads)
    # Bound once: what a lambda names from outside would be worked out again for every element.
    within = lambda x: F.filter(x["_e"], lambda e: (F.size(e["sec"]) <= 2) & e["page"].between(x["_from"], x["_to"]) & kept(e))
    d = d.withColumn("_u", let(F.struct("_e", "_from", "_to"), within))
    d = d.withColumn("_starts", F.array_sort(F.array_distinct(pages("_u"))))
    return d


def section_starts(outlines: DataFrame, doc: str, outline: str, total: str) -> DataFrame:
    """(doc, page) of the pages at which chapters and sections of the body start, each once."""
    # Outer: a plain explode is guarded by a filter in which all of this would be worked out again.
    return _units(outlines, doc, outline, total).select(doc, F.explode_outer("_starts").alias("page")).where(F.col("page").isNotNull())


def plan_fragments(outlines: DataFrame, doc: str, outline: str, total: str, window: int = 12, overlap: int = 1, heads: Sequence[str] | None = None) -> DataFrame:
    """Planned fragments of every document: clause, title, pages, file, estimated pages, end of the window before.

    ``outlines`` has one row a document, and all of a document is worked out from its own outline: no
    join, no shuffle. ``heads`` keeps the chapters named there only.
    """
    d = _units(outlines, doc, outline, total, heads)
    pages = lambda es: F.transform(es, lambda e: e["page"])
    children = lambda u: F.array_sort(F.array_distinct(pages(F.filter("_e", lambda e: (F.size(e["sec"]) == F.size(u["sec"]) + 1) & (F.slice(e["sec"], F.lit(1), F.size(u["sec"])) == u["sec"])))))
    after = lambda u: F.coalesce(F.get("_starts", F.array_position("_starts", u["page"]).cast("int")) - 1, F.col("_to"))
    unit = lambda u: F.struct(
        u["pos"].alias("pos"), F.array_join(u["sec"], ".").alias("clause"), u["title"].alias("title"), u["page"].alias("lo"), F.least(F.greatest(u["page"], after(u)), F.col("_to")).alias("hi"), children(u).alias("kids")
    )
    d = d.select(doc, F.explode_outer(F.transform("_u", unit)).alias("_s")).where(F.col("_s").isNotNull())  # outer: see section_starts
    d = d.select(doc, "_s.pos", "_s.clause", "_s.title", pack(F.col("_s.lo"), F.col("_s.hi"), F.col("_s.kids"), window, overlap).alias("_all"))
    w = d.select("*", F.size("_all").alias("_n"), F.posexplode_outer("_all").alias("_i", "_w"))
    suffix = F.when(F.col("_n") > 1, letters(F.col("_i") + 1)).otherwise("")
    return w.select(
        doc, "pos", F.col("_i").alias("part"), "clause", F.trim("title").alias("title"), pages_text(F.col("_w.lo"), F.col("_w.hi")).alias("pdf_pages"),
        F.concat(F.col(doc), F.lit("/"), F.col("clause"), suffix, F.lit("-"), title_slug(F.col("title")), F.lit(".md")).alias("target_file"),
        (F.col("_w.hi") - F.col("_w.lo") + 1).alias("est_pages"), F.when(F.col("_i") > 0, F.get("_all", F.col("_i") - 1)["hi"]).alias("prev_end"),
        F.col("_w.lo").alias("lo"), F.col("_w.hi").alias("hi"),
    )


def coverage(spans: DataFrame, body: DataFrame, doc: str, shown: int = 20) -> DataFrame:
    """Per document: pages of the body, covered and uncovered ones, the share covered in percent, repeats,
    first and last named page, and the first ``shown`` uncovered pages as text.

    ``spans``: (doc, lo, hi); ``body``: (doc, body_start, body_end), one row a document. Documents
    without spans are reported with nothing covered, spans of documents without a body are not.
    ``repeats`` counts how often pages are named again. All is added up over spans, never over pages.
    """
    size = F.col("hi").cast("long") - F.col("lo") + 1
    named = spans.where("lo <= hi").groupBy(doc).agg(F.sum(size).alias("_named"), F.min("lo").alias("first_page"), F.max("hi").alias("last_page"))
    aims = body.select(doc, F.col("body_start").alias("lo"), F.col("body_end").alias("hi"))
    runs = written(intervals.periods_and_gaps(spans.select(doc, "lo", "hi"), aims, [doc]))
    is_gap = F.col("span_kind") == "gap"
    g = runs.groupBy(doc).agg(F.sum(F.when(~is_gap, size)).alias("_distinct"), F.sum(F.when(is_gap, size)).alias("uncovered"))
    # Of a gap no more pages than are shown, so of a document at most ``shown`` a gap that comes into question.
    free = top_k(runs.where(is_gap), [doc], [F.col("lo")], shown).select(doc, F.explode(F.sequence("lo", F.least("hi", F.col("lo") + shown - 1))).alias("_p"))
    sample = free.groupBy(doc).agg(F.array_join(F.slice(F.array_sort(F.collect_list("_p")), 1, shown), ",").alias("uncovered_pages"))
    n = F.greatest(F.col("body_end") - F.col("body_start") + 1, F.lit(0)).cast("long")
    d = body.join(named, doc, "left").join(g, doc, "left").join(sample, doc, "left").withColumn("_n", n).withColumn("_u", F.when(F.col("_named").isNull(), F.col("_n")).otherwise(F.least(F.coalesce("uncovered", F.lit(0)), F.col("_n"))))
    return d.select(
        doc, F.col("_n").alias("body_pages"), (F.col("_n") - F.col("_u")).alias("covered"), F.col("_u").alias("uncovered"),
        F.round(100.0 * (F.col("_n") - F.col("_u")) / F.greatest(F.lit(1), F.col("_n")), 2).alias("percent"),
        F.coalesce(F.col("_named") - F.col("_distinct"), F.lit(0)).alias("repeats"), "first_page", "last_page",
        F.when(F.col("_n") > 0, F.coalesce("uncovered_pages", F.lit(""))).otherwise("").alias("uncovered_pages"),
    )
