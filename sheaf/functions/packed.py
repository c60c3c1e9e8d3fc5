"""Several values packed in one string field.

The string is cut at its quote characters: pieces at odd places are literals, pieces at even
places are searched for delimiters. Delimiters become one separator character, the pieces are
folded together again and the separator cuts the values, so a delimiter inside a quoted or
escaped value never parts it. Everything is built-in SQL expressions, linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.bind import BLANK, let, strip

# Unicode noncharacters: never valid in interchanged text.
_QUOTE, _SEP = "﷐", "﷑"
_ESCAPED = {"\\": "﷒", '"': "﷓", "'": "﷔", ",": "﷕", ";": "﷖", "|": "﷗", "/": "﷘"}

# Before and after a quoted value only these may stand; an apostrophe within a word is no quote.
_EDGE = r"""\[\](),;|/，、·+&"'“”\s"""
_QUOTED = rf"""(?<![^{_EDGE}])(?:"([^"]*+)"|“([^”]*+)”|'([^']*+)')(?![^{_EDGE}])"""

TAG_DELIMITERS = r"[,;|，、\t\n]|(?<=\s)[/·](?=\s)|(?<!\S)#(?=\S)"
BULLET = r"\n[ \t]*[-*][ \t]+"
FIRST_BULLET = r"^[ \t]*[-*][ \t]+"
PAGE_DELIMITERS = r"(?i)[,;|\n/&+]|(?<!\S)and(?!\S)"


def _unescape(c: Column) -> Column:
    for plain, mark in _ESCAPED.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    return c


def _unicode_escapes(c: Column) -> Column:
    """``\\u00f6`` to its character, where the text has such an escape."""
    decoded = F.from_json(F.concat(F.lit('["'), c, F.lit('"]')), "array<string>")[0]
    return F.when(c.rlike(r"\\u[0-9a-fA-F]{4}"), F.coalesce(decoded, c)).otherwise(c)


def split_packed(col: Column, delimiters: str = TAG_DELIMITERS, bullets: bool = True) -> Column:
    """``array<string>`` of the values packed in ``col``, in order, without empty ones.

    Wrapping brackets, quotes (straight, single, typographic), list bullets and escapes are
    removed; a doubled quote inside a quoted value is one quote. Null gives null; empty and
    blank text give an empty array. Text of any length is handled in linear time.
    """
    clean = strip(F.translate(col, _QUOTE + _SEP + "".join(_ESCAPED.values()), ""))
    clean = F.btrim(clean, F.lit(BLANK + ",;"))

    def marked(t: Column) -> Column:
        wrapped = t.startswith("[") & t.endswith("]") & (F.length(t) >= 2)
        t = F.when(wrapped, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        for plain, mark in _ESCAPED.items():
            t = F.replace(t, F.lit("\\" + plain), F.lit(mark))
        t = F.regexp_replace(t, r"(?<=\w)''(?=\w)", _ESCAPED["'"])
        return F.regexp_replace(t, _QUOTED, f"{_QUOTE}$1$2$3{_QUOTE}")

    def joined(pieces: Column) -> Column:
        def fold(piece: Column, i: Column) -> Column:
            inner = (i > 0) & (i < F.size(pieces) - 1)
            outside = piece
            if bullets:
                outside = F.when(i == 0, F.regexp_replace(outside, FIRST_BULLET, _SEP)).otherwise(outside)
                outside = F.regexp_replace(outside, BULLET, _SEP)
            outside = F.regexp_replace(outside, delimiters, _SEP)
            return (
                F.when(i % 2 == 1, piece)
                .when(inner & (piece == ""), F.lit('"'))
                .when(inner & (strip(piece) == ""), F.lit(_SEP))
                .otherwise(outside)
            )

        return F.array_join(F.transform(pieces, fold), "")

    folded = let(F.split(let(clean, marked), _QUOTE, -1), joined)
    values = F.transform(F.split(folded, _SEP, -1), lambda v: strip(_unescape(_unicode_escapes(v))))
    return F.filter(values, lambda v: v != "")
