"""Several values packed in one field: one row per value with its position (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.packed import split_packed
from sheaf.functions.pages import page_items


def unpack(df: DataFrame, key: str, values: Column, least: int = 1, names: tuple[str, str, str] = ("row_id", "pos", "item")) -> DataFrame:
    """One row per value of the array ``values`` of each different ``key``, positions from 1.

    Keys whose field holds fewer than ``least`` values give no row. Copies of a key count once:
    copies differ in columns other than the field, so equal (key, values) pairs are merged before
    the values are spread. A null key or a null field gives no row; repeated values stay. Columns
    of ``df`` never clash with the result's, which is built from its own three columns only.
    """
    row_id, pos, item = names
    kept = (
        df.select(F.col(key).alias("_k"), values.alias("_v"))
        .where(F.col("_k").isNotNull() & (F.size("_v") >= least))
        .groupBy("_k")
        .agg(F.min("_v").alias("_v"))
    )
    return kept.select(F.col("_k").alias(row_id), F.posexplode("_v").alias("_p", item)).select(
        row_id, (F.col("_p") + 1).cast("int").alias(pos), item
    )


def unpack_pages(df: DataFrame, key: str, col: str, least: int = 1) -> DataFrame:
    """``unpack`` of a hand-written page list."""
    return unpack(df, key, page_items(F.col(col)), least)


def unpack_tags(df: DataFrame, key: str, col: str, least: int = 1) -> DataFrame:
    """``unpack`` of a tag list in any of its notations."""
    return unpack(df, key, split_packed(F.col(col)), least)
