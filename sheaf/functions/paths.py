"""Path normalisation and path predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.bind import let, strip


def normalize_path(col: Column) -> Column:
    """The location a loosely spelled path leads to; letter case counts.

    Outer white space and an anchor (from ``#``) are cut, backslashes are slashes, empty and ``.``
    segments vanish and ``..`` removes the segment before it. A leading slash stays. Null stays
    null and a path of nothing is the empty string.
    """
    cut = strip(F.translate(F.split_part(col, F.lit("#"), F.lit(1)), "\\", "/"))

    def back(acc: Column, s: Column) -> Column:
        up = (s == "..") & (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))

    def resolved(t: Column) -> Column:
        segments = F.filter(F.split(t, "/"), lambda s: (s != "") & (s != "."))
        none = F.array().cast("array<string>")
        folded = F.when(t.contains(".."), F.aggregate(segments, none, back)).otherwise(segments)
        return F.concat(F.when(t.startswith("/"), F.lit("/")).otherwise(F.lit("")), F.array_join(folded, "/"))

    # Most paths are already in their plain form: a few looks at their bytes tell, and they stay as they are.
    loose = col.contains("#") | col.contains("\\") | col.contains("//") | col.contains("/.") | col.startswith(".") | col.endswith("/")
    return F.when(~loose & (strip(col) == col), col).otherwise(let(cut, resolved))


def join_path(base_dir: Column, link: Column) -> Column:
    """``link`` seen from ``base_dir`` (empty: the root of all paths), normalized."""
    return normalize_path(F.when(base_dir == "", link).otherwise(F.concat(base_dir, F.lit("/"), link)))


def base_name(col: Column) -> Column:
    """The last segment of a path."""
    return F.regexp_extract(F.translate(F.trim(col), "\\", "/"), r"([^/]*)$", 1)


def last_two_segments(col: Column) -> Column:
    """The last two segments, or the whole path where it has fewer."""
    parts = F.split(col, "/")
    return F.when(F.size(parts) <= 2, col).otherwise(F.array_join(F.slice(parts, -2, 2), "/"))
