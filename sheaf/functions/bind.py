"""Binding a sub-expression to a name, so that it is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\r\n\f\x0b\u00a0\u2007\u202f\u2003\u2002\u2009\u3000\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without outer white space (linear, unlike an anchored regular expression)."""
    return F.btrim(c, F.lit(BLANK))
