"""Page and line statistics, page runs and page offsets of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import lines, without_space
from sheaf.operators import intervals
from sheaf.operators.lagged import placed, previous


def stride_sample(pages: DataFrame, doc: str, page: str, width: int | None = 4096) -> DataFrame:
    """All pages of documents of up to 60, else every ``max(1, n div 50)``-th, counted from the first.

    Pages are chosen by their numbers alone; texts are read for the chosen ones only. Documents and
    pages are not null, a page is there once. Pages are counted in shards ``width`` wide, or by the
    document (None) where it is known that none is large.
    """
    stride = F.when(F.col("_n") <= 60, 1).otherwise(F.greatest(F.lit(1), F.expr("_n div 50")))
    places = pages.select(doc, page)
    if width is None:
        w = Window.partitionBy(doc)
        places = places.withColumn("_i", F.row_number().over(w.orderBy(page)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    else:
        places = placed(places, [doc], page, F.floor(F.col(page) / width))
    chosen = places.where(F.col("_i") % stride == 0)
    return pages.join(chosen.select(doc, page), [doc, page], "left_semi")


def _page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    return pages.select(doc, page, F.explode(lines(F.col(text))).alias("_line")).select(doc, page, without_space(F.col("_line")).alias("norm"))


def _marked(df: DataFrame, n: DataFrame, doc: str, page: str, line: list[str], ratio: float, least: int) -> DataFrame:
    """(doc, *line) of lines on at least ``max(least, int(ratio * pages))`` pages of documents of 3 pages or more."""
    df = df.select(doc, page, *line).distinct().groupBy(doc, *line).agg(F.count(F.lit(1)).alias("_df"))
    return df.join(n, doc).where((F.col("_n") >= 3) & (F.col("_df") >= F.greatest(F.lit(least), F.floor(F.col("_n") * ratio)))).select(doc, *line)


def boilerplate(pages: DataFrame, doc: str, page: str, text: str, ratio: float = 0.8, least: int = 3) -> DataFrame:
    """(doc, norm): lines found on at least ``max(least, int(ratio * pages))`` pages of a document.

    Lines are compared without white space; those shorter than 8 are no boilerplate, and documents
    of fewer than 3 pages have none. Each line counts once a page; the distinct combines map-side.
    """
    n = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    return _marked(_page_lines(pages, doc, page, text).where(F.length("norm") >= 8), n, doc, page, ["norm"], ratio, least)


def text_layer(pages: DataFrame, doc: str, page: str, text: str, ratio: float = 0.8, least: int = 3) -> DataFrame:
    """Per document: pages, pages with more than 20 characters of own text, their share, characters and a verdict.

    As ``boilerplate``, but lines travel as a 64-bit hash and their length (two lines of a document
    count as one if they agree in both).
    """
    n = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("_n"))
    ls = _page_lines(pages, doc, page, text).select(doc, page, F.xxhash64("norm").alias("_h"), F.length("norm").alias("_len"))
    marks = _marked(ls.where("_len >= 8"), n, doc, page, ["_h", "_len"], ratio, least)
    kept = ls.where("_len > 0").join(marks, [doc, "_h", "_len"], "left_anti").groupBy(doc, page).agg(F.sum("_len").alias("_chars"))
    got = kept.groupBy(doc).agg(F.sum((F.col("_chars") > 20).cast("long")).alias("_with"), F.sum("_chars").alias("_all"))
    share = F.col("pages_with_text") / F.col("pages_sampled")
    stats = n.join(got, doc, "left").select(doc, F.col("_n").alias("pages_sampled"), F.coalesce("_with", F.lit(0)).alias("pages_with_text"), F.coalesce("_all", F.lit(0)).alias("chars_total"))
    return stats.select("*", F.round(share, 4).alias("fraction"), verdict(share).alias("verdict"))


def verdict(fraction: Column) -> Column:
    """born-digital from 0.85, scanned up to 0.15, else mixed."""
    return F.when(fraction >= 0.85, "born-digital").when(fraction <= 0.15, "scanned").otherwise("mixed")


def usable_text(pages: DataFrame, doc: str, text: str) -> DataFrame:
    """Distinct texts and the upper median length of a document's pages, and whether it can be read.

    Usable: median of at least 200 and, from 5 pages on, more than 2 distinct texts.
    """
    t = pages.select(doc, F.coalesce(F.btrim(text, F.lit(" \t\r\n\f\x0b")), F.lit("")).alias("_t")).select(doc, F.length("_t").alias("_len"), F.sha2("_t", 256).alias("_h"))
    # Texts travel as their digests, lengths as counts: a document's pages are never sorted.
    each = t.groupBy(doc, "_len", "_h").agg(F.count(F.lit(1)).alias("_c"))
    by = each.groupBy(doc, "_len").agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"))
    w = Window.partitionBy(doc)
    upto = F.sum("_c").over(w.orderBy("_len").rowsBetween(Window.unboundedPreceding, 0))
    d = by.withColumn("_upto", upto).withColumn("_n", F.sum("_c").over(w))
    g = d.groupBy(doc).agg(F.max("_n").alias("n_pages"), F.sum("_d").alias("n_distinct"), F.min(F.when(F.col("_upto") >= F.expr("_n div 2") + 1, F.col("_len"))).alias("median_length"))
    return g.withColumn("usable", (F.col("median_length") >= 200) & ((F.col("n_pages") < 5) | (F.col("n_distinct") > 2)))


def forward_fill(df: DataFrame, key: str, order: str, col: str, out: str, before: str = "any", shard: Column | None = None) -> DataFrame:
    """The last value that is not null carried forward; ``before`` ahead of the first.

    For keys of any size give ``shard``, a whole number that never falls as ``order`` rises: rows are
    filled within their (key, shard), and each shard takes over the last value of those before it,
    found among one row a shard.
    """
    if shard is None:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.coalesce(F.last(col, ignorenulls=True).over(w), F.lit(before)))
    d = df.withColumn("_shard", shard.cast("long"))
    w = Window.partitionBy(key, "_shard").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    tails = d.groupBy(key, "_shard").agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.col(order))).alias("_tail"))
    along = Window.partitionBy(key).orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = tails.select(F.col(key).alias("_key"), F.col("_shard").alias("_of"), F.last("_tail", ignorenulls=True).over(along).alias("_carry")).where("_carry is not null")
    local = d.withColumn("_local", F.last(col, ignorenulls=True).over(w))
    out_of = local.join(heads, F.col(key).eqNullSafe(F.col("_key")) & F.col("_shard").eqNullSafe(F.col("_of")), "left")
    return out_of.withColumn(out, F.coalesce("_local", "_carry", F.lit(before))).drop("_shard", "_local", "_key", "_of", "_carry")


def runs(df: DataFrame, key: str, order: str, same: list[str], width: int | None = 4096) -> DataFrame:
    """(key, *same, start, end): longest runs of rows, in order, alike in ``same``.

    A run begins at a row unlike the one before and ends with the row before the next such row; only
    those rows are looked at again. ``order`` is a number, shards of it are ``width`` wide; keys are
    not null and ``order`` does not repeat within them. Without shards (None) a key is one task's
    work: for keys known to be small.
    """
    if width is None:
        w = Window.partitionBy(key).orderBy(order)
        unlike = F.row_number().over(w) == 1
        for c in same:
            unlike = unlike | ~F.col(c).eqNullSafe(F.lag(c).over(w))
        d = df.withColumn("_new", unlike.cast("int"))
        d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(key, "_run", *same).agg(F.min(order).alias("start"), F.max(order).alias("end")).drop("_run")
    d = previous(df.select(key, order, *same), [key], order, [order, *same], F.floor(F.col(order) / width))
    unlike = F.col(f"{order}_before").isNull()
    for c in same:
        unlike = unlike | ~F.col(c).eqNullSafe(F.col(f"{c}_before"))
    begin = d.where(unlike).select(key, *same, order, F.col(f"{order}_before").alias("_ended"), (-F.col(order)).alias("_down"))
    begin = previous(begin, [key], "_down", ["_ended"], F.floor(F.col("_down") / width))
    last = df.groupBy(key).agg(F.max(order).alias("_last"))
    return begin.join(last, key).select(key, *same, F.col(order).alias("start"), F.coalesce("_ended_before", "_last").alias("end"))


def region_matches(lang: Column, version: Column, target_lang: str, target_version: str) -> Column:
    """Language equal, version equal or ``any`` on either side."""
    return (lang == target_lang) & (F.lit(target_version == "any") | version.isin(target_version, "any"))


def target_region(regions: DataFrame, key: str, target_lang: str, target_version: str, gap: int = 3, width: int | None = 256) -> DataFrame:
    """(key, start, end): the longest matching run with all matching runs at most ``gap`` places away, repeatedly.

    The longest run's island among runs joined over gaps; the first of equally long ones. Runs are
    joined in shards ``width`` wide, or by the key (None) where it is known that none is large.
    """
    c = regions.where(region_matches(F.col("lang"), F.col("version"), target_lang, target_version)).select(key, "start", "end")
    if width is None:
        w = Window.partitionBy(key).orderBy("start")
        reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = c.withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0))
        d = d.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        of = d.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max(F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("_best"))
        return of.groupBy(key).agg(F.max_by(F.struct("start", "end"), "_best").alias("_r")).select(key, "_r.*")
    islands = intervals.periods(c.select(key, F.col("start").alias("lo"), (F.col("end") + gap - 1).alias("hi")), [key])
    spine = c.groupBy(key).agg(F.max_by("start", F.struct(F.col("end") - F.col("start"), -F.col("start"))).alias("_at"))
    return islands.join(spine, key).where(F.col("_at").between(F.col("lo"), F.col("hi"))).select(key, F.col("lo").cast("int").alias("start"), (F.col("hi") - (gap - 1)).cast("int").alias("end"))


def page_offset(pages: DataFrame, key: str, page: str, candidates: str, region: DataFrame) -> DataFrame:
    """(key, offset, n_votes, n_anchors): the offset most pages of the region vote for, the larger on a tie.

    Page and region meet by an equality on the key, the range is a filter on top. A printed number
    beyond its page has no vote.
    """
    votes = (
        pages.select(key, page, F.explode(candidates).alias("_printed")).join(region, key)
        .where(F.col(page).between(F.col("start"), F.col("end")) & (F.col(page) >= F.col("_printed")))
        .groupBy(key, (F.col(page) - F.col("_printed")).alias("offset")).agg(F.count(F.lit(1)).alias("_n"))
    )
    return votes.groupBy(key).agg(
        F.max_by("offset", F.struct("_n", "offset")).alias("offset"), F.max("_n").alias("n_votes"), F.sum("_n").alias("n_anchors")
    )
