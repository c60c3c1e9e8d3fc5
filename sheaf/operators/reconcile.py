"""Two-sided reconciliation, link integrity and duplicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.paths import join_path
from sheaf.functions.text import anchor_links, heading_slug, lines, markdown_links


def reconcile(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left_only", "right_only")) -> DataFrame:
    """(key, side): keys on one side only; repeated keys count once, null keys are ignored."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct()
    b = right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit(names[0])).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit(names[1])))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys found more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def uniqueness(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys and whether they agree."""
    return df.agg(F.count(key).alias("n"), F.countDistinct(key).alias("n_distinct")).withColumn("is_unique", F.col("n") == F.col("n_distinct"))


def dangling_links(docs: DataFrame, file: str, text: str, known: DataFrame, known_file: str, links: Callable[[Column], Column] = markdown_links) -> DataFrame:
    """(file, link, resolved): links to ``.md`` files, seen from their own folder, that name no known file.

    ``links`` finds the links of a text, an array of paths; those of another scheme are no files.
    """
    folder = F.regexp_replace(F.col(file), r"/?[^/]*\z", "")
    found = docs.select(F.col(file).alias("file"), folder.alias("_dir"), F.explode(links(F.col(text))).alias("link")).where(~F.col("link").rlike(r"^[a-z]+://"))
    resolved = found.withColumn("resolved", join_path(F.col("_dir"), F.col("link"))).drop("_dir").distinct()
    return resolved.join(known.select(F.col(known_file).alias("resolved")).distinct(), "resolved", "left_anti").select("file", "link", "resolved")


def heading_anchors(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, anchor): anchors of all headings; repeated ones get ``-1``, ``-2`` in order. Fences are not skipped."""
    h = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "_line")).where(F.col("_line").rlike(r"^#{1,6}\s+.+\z"))
    h = h.withColumn("_base", heading_slug(F.regexp_extract("_line", r"^#{1,6}\s+(.+)\z", 1)))
    nth = F.row_number().over(Window.partitionBy(key, "_base").orderBy("pos")) - 1
    return h.withColumn("_n", nth).select(key, "pos", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat_ws("-", "_base", "_n")).alias("anchor"))


def dangling_anchors(docs: DataFrame, key: str, text: str, links: Callable[[Column], Column] = anchor_links, anchors: DataFrame | None = None) -> DataFrame:
    """(key, anchor): links to anchors that no heading of the same document has; case counts.

    ``links`` finds the anchors a text names, an array; ``anchors`` (key, anchor) are those there
    are, by default of the headings of ``docs``.
    """
    named = docs.select(key, F.explode(links(F.col(text))).alias("anchor")).distinct()
    there = heading_anchors(docs, key, text) if anchors is None else anchors
    return named.join(there.select(key, "anchor"), [key, "anchor"], "left_anti")


def dead_results(inputs: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n_results) of inputs none of whose results holds anything: null and empty ones are dead, and so is an input without any."""
    alive = (F.col(value).isNotNull() & (F.col(value) != "")).cast("long")
    r = results.groupBy(key).agg(F.count(F.lit(1)).alias("n_results"), F.sum(alive).alias("_alive"))
    return inputs.select(key).where(F.col(key).isNotNull()).distinct().join(r, key, "left").where(F.coalesce("_alive", F.lit(0)) == 0).select(key, F.coalesce("n_results", F.lit(0)).alias("n_results"))


def line_counts(docs: DataFrame, key: str, text: str, above: int) -> DataFrame:
    """(key, n_lines) of texts with more than ``above`` lines; a final line end adds none."""
    return docs.select(key, F.size(lines(F.col(text))).alias("n_lines")).where(F.col("n_lines") > above)


def missing_fields(*checks: tuple[str, Column]) -> Column:
    """Comma list of the names whose value is null or empty."""
    return F.array_join(F.array_compact(F.array(*[F.when(c.isNull() | (c == ""), F.lit(n)) for n, c in checks])), ",")


def last_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (an index in which later writes win); a null in the order comes first.

    An aggregation: each task keeps one row a key ahead of the shuffle, so no key is sorted.
    """
    rest = [c for c in df.columns if c not in key]
    place = F.struct(*[x for i, c in enumerate(order) for x in (c.isNotNull().alias(f"_h{i}"), c.alias(f"_o{i}"))])
    last = df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), place).alias("_last"))
    return last.select(*[F.col("_last")[c].alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def lookup(facts: DataFrame, dims: DataFrame, key: list[str], order: list[Column], how: str = "inner") -> DataFrame:
    """Equality lookup in which the last row of a repeated build key wins."""
    return facts.join(last_wins(dims, key, order), key, how)
