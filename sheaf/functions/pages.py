"""Hand-written page lists: spans, items and page counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.bind import let
from sheaf.functions.packed import PAGE_DELIMITERS, split_packed

# One page or one span, after an optional word for "page" and before an optional remark.
_ITEM = r"(?i)^(?:pages?|pp?\.?)?\s*(\d{1,9})(?:\s*(?:-|‐|‑|–|—|−|\.\.|to)\s*(\d{1,9}|end))?\s*(?:\?|\(.*\)|\[.*\])?$"


def page_items(col: Column) -> Column:
    """``array<string>`` of ``first-last`` or single numbers, in the order written.

    Unreadable parts name no page and are left out; ``end`` is kept as written in lower case.
    """
    parts = F.filter(split_packed(col, PAGE_DELIMITERS, bullets=False), lambda v: v.rlike(_ITEM))

    def item(v: Column) -> Column:
        first, last = F.regexp_extract(v, _ITEM, 1), F.lower(F.regexp_extract(v, _ITEM, 2))
        return F.when(last == "", first).otherwise(F.concat(first, F.lit("-"), last))

    # Most lists are one page or one span in the plain notation, which is its own item.
    return F.when(col.rlike(r"^\d{1,9}(?:-\d{1,9})?\z"), F.array(col)).otherwise(F.transform(parts, item))


def page_spans(col: Column) -> Column:
    """``array<struct<lo:int,hi:int>>`` with ``lo <= hi``; an open end has a null ``hi``."""

    def span(v: Column) -> Column:
        a = F.split_part(v, F.lit("-"), F.lit(1)).try_cast("int")
        tail = F.split_part(v, F.lit("-"), F.lit(2))
        b = F.when(tail == "", a).when(tail == "end", F.lit(None).cast("int")).otherwise(tail.try_cast("int"))
        return F.struct(F.when(b < a, b).otherwise(a).alias("lo"), F.when(b < a, a).otherwise(b).alias("hi"))

    return F.transform(page_items(col), span)


def close_spans(spans: Column, last_page: Column) -> Column:
    """Open ends reach to ``last_page``; where it is unknown or lower, only the first page is named."""
    return F.transform(
        spans,
        lambda s: F.struct(s["lo"].alias("lo"), F.coalesce(s["hi"], F.greatest(s["lo"], last_page), s["lo"]).alias("hi")),
    )


def target_spans(col: Column) -> Column:
    """As ``page_spans``; a bracketed pair of numbers is one span."""
    return page_spans(F.regexp_replace(col, r"\[\s*(\d+)\s*,\s*(\d+)\s*\]", "$1-$2"))


def merge_spans(spans: Column) -> Column:
    """Sorted, disjoint, non-adjacent spans naming the same pages (one row's list; not for groups)."""

    def step(acc: Column, s: Column) -> Column:
        def grown(last: Column) -> Column:
            joined = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"))
            return F.when(
                s["lo"] <= last["hi"] + 1, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))
            ).otherwise(F.concat(acc, F.array(s)))

        return F.when(F.size(acc) == 0, F.array(s)).otherwise(let(F.get(acc, F.size(acc) - 1), grown))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<lo:int,hi:int>>"), step)


def count_pages(merged: Column) -> Column:
    """How many different pages merged spans name."""
    return F.aggregate(merged, F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"] + 1)
