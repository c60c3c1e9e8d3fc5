"""Keyed state with last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compact(log: DataFrame, key: str, value: str, at: str, tie: str) -> DataFrame:
    """(key, value, at): the latest write of each key; ``tie`` decides among equal times.

    ``max_by`` combines on the map side, so a key written very often is reduced before the shuffle.
    """
    last = F.max_by(F.struct(value, at), F.struct(at, tie))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_l")).select(key, f"_l.{value}", f"_l.{at}")


def apply_writes(state: DataFrame, writes: DataFrame, key: str, value: str, at: str, allowed: list[str] | None = None, touch: str | None = None) -> DataFrame:
    """State after more writes; keys outside ``allowed`` are refused (left out).

    With ``touch`` the state's row of that name takes the time of the last write that was let in, as
    its value and its time; no write, no touch.
    """
    w = writes if allowed is None else writes.where(F.col(key).isin(*allowed))
    if touch is not None:
        kind = dict(state.dtypes)[value]
        last = w.where(F.col(key).isNotNull()).agg(F.max(at).alias(at)).where(F.col(at).isNotNull())
        w = w.select(key, value, at).unionByName(last.select(F.lit(touch).alias(key), F.col(at).cast(kind).alias(value), at))
    both = state.select(key, value, at, F.lit(0).alias("_t")).unionByName(w.select(key, value, at, F.lit(1).alias("_t")))
    return compact(both, key, value, at, "_t")


def init_if_absent(state: DataFrame, defaults: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Defaults only for keys that have no value yet."""
    return state.select(key, value, at).unionByName(defaults.select(key, value, at).join(state.select(key), key, "left_anti"))


def archive(state: DataFrame, archived: DataFrame | None, key: str, value: str, at: str, when: Column) -> tuple[DataFrame, DataFrame]:
    """(archived rows, the empty state after it): the state put aside under the time ``when``.

    ``archived`` holds what was put aside before; an archive of the same time is there already and is
    left as it is.
    """
    new = state.select(key, value, at, when.alias("archived_at"))
    if archived is not None:
        new = archived.unionByName(new.join(archived.select("archived_at").distinct(), "archived_at", "left_anti").select(*archived.columns))
    return new, state.limit(0)
