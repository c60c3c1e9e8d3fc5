"""Frontmatter readers: lenient, checked and strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.bind import let, strip
from sheaf.functions.text import lines, scalar_kind, unquoted


def _block(ls: Column) -> Column:
    """Lines between the first and the next ``---``; to the end where there is none."""
    rest = F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(1)))
    end = F.array_position(F.transform(rest, strip), "---").cast("int")
    return F.when(end > 0, F.slice(rest, F.lit(1), end - 1)).otherwise(rest)


def _fields(block: Column) -> Column:
    """Map of ``key: value`` lines; of a repeated key the last counts."""

    def pair(x: Column) -> Column:
        at = F.instr(x, ":")
        return F.struct(strip(F.substring(x, F.lit(1), at - 1)).alias("key"), unquoted(strip(F.substring(x, at + 1, F.length(x)))).alias("value"))

    pairs = F.transform(F.filter(block, lambda x: x.contains(":")), pair)

    def last_of_key(ps: Column) -> Column:
        return F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"]))

    return F.map_from_entries(let(pairs, last_of_key))


def lenient(raw: Column) -> Column:
    """map<string,string>; the first line must be ``---``, an unclosed block reads to the end, else empty."""
    return let(lines(raw), lambda ls: F.when(F.get(ls, F.lit(0)) == "---", _fields(_block(ls))).otherwise(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))))


def checked(raw: Column) -> Column:
    """struct(fields, err): ``err`` is null, ``no start`` or ``not closed``. Text need only start with ``---``."""

    def read(ls: Column) -> Column:
        closed = F.exists(F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(1))), lambda x: strip(x) == "---")
        return F.struct(_fields(_block(ls)).alias("fields"), F.when(~closed, "not closed").alias("err"))

    none = F.struct(F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")).alias("fields"), F.lit("no start").alias("err"))
    return F.when(raw.startswith("---"), let(lines(raw), read)).otherwise(none)


def strict(df: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, line, name, value, kind, err): every frontmatter line with its number in the file.

    ``err``: ``malformed`` (no ``name: value``), ``duplicate`` (the first of a key counts) or
    ``scalar``; null if the line is sound. Files without a closed block give no row.
    """
    ls = F.col("_ls")
    end = F.array_position(F.slice(ls, F.lit(2), F.greatest(F.size(ls), F.lit(1))), "---").cast("int")
    body = (
        df.where(F.col(raw).startswith("---\n")).select(key, lines(F.col(raw)).alias("_ls")).withColumn("_end", end).where("_end > 0")
        .select(key, F.posexplode(F.slice(ls, F.lit(2), F.col("_end") - 1)).alias("_p", "_line"))
        .where((strip(F.col("_line")) != "") & ~F.ltrim("_line").startswith("#"))
    )
    pattern = r"^([A-Za-z_][A-Za-z0-9_-]*):\s*(.*)\z"
    d = body.select(
        key, (F.col("_p") + 2).alias("line"), F.nullif(F.regexp_extract("_line", pattern, 1), F.lit("")).alias("name"), F.regexp_extract("_line", pattern, 2).alias("value")
    )
    nth = F.row_number().over(Window.partitionBy(key, "name").orderBy("line"))
    kind = scalar_kind(F.col("value"))
    return d.withColumn("_nth", nth).withColumn("kind", F.when(F.col("name").isNotNull(), kind)).select(
        key, "line", "name", "value", "kind",
        F.when(F.col("name").isNull(), "malformed").when(F.col("_nth") > 1, "duplicate").when(F.col("kind") == "error", "scalar").alias("err"),
    )
