"""Text scalars as column expressions; all run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.bind import strip

# The patterns, marks and limits of this module (section numbers, slugs, anchors, printed numbers, templates,
# declarations, scalars) define the results and are the same in every reading of these documents.

#: Unicode white space, written out so that every regex engine agrees on it.
SPACE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The accented letters that lean a page to the second language.
ACCENTS = "éèêàçâîôûïë"
HEADER_SCAN_CHARS = 600
# What an unfinished plan still says in brackets.
HINTS = (
    "feature name", "authoritative source", "feature-slug", "ready | conditional | draft", "path or none", "branch, commit", "wpx", "title", "capability or", "material decision",
    "person, design", "trigger", "purpose", "package-or-module", "optional formatter", "targeted tests", "full required verification", "summary or links", "summary and rationale",
    "commands and results", "configuration or re-grounding", "concise list",
)


def without_space(c: Column) -> Column:
    """Text with all white space deleted (not collapsed)."""
    return F.regexp_replace(c, SPACE + "+", "")


def lines(c: Column) -> Column:
    """Lines of a text; a final line end opens no further line, empty text has no line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def count_literal(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal; an empty one counts nothing."""
    if not literal:
        return F.lit(0)
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def count_markers(c: Column, markers: Sequence[str]) -> Column:
    """Occurrences of all markers together; blank markers are dropped."""
    total = F.lit(0)
    for m in markers:
        if m.strip():
            total = total + count_literal(c, m)
    return total


def classify_page(c: Column, a_markers: Sequence[str], b_markers: Sequence[str], redline: Sequence[str], final: Sequence[str]) -> Column:
    """struct(lang, version_hit, a_markers, b_markers, accents) of one page's text.

    More markers win; on a tie three accents or more lean to ``b``. A final sentinel beats a
    redline one on the same page.
    """
    a, b = count_markers(c, a_markers), count_markers(c, b_markers)
    accents = F.length(c) - F.length(F.translate(c, ACCENTS, ""))
    lang = F.when(a > b, "a").when(b > a, "b").when(accents >= 3, "b").otherwise("a")
    hit = F.when(count_markers(c, final) > 0, "final").when(count_markers(c, redline) > 0, "redline")
    return F.struct(lang.alias("lang"), hit.alias("version_hit"), a.alias("a_markers"), b.alias("b_markers"), accents.alias("accents"))


def printed_candidates(c: Column) -> Column:
    """Numbers of one to three digits between dashes in the head of a page, in order."""
    head = F.substring(c, 1, HEADER_SCAN_CHARS)
    return F.transform(F.regexp_extract_all(head, F.lit(r"[–\-]\s*(\d{1,3})\s*[–\-]"), 1), lambda x: x.cast("int"))


def title_slug(c: Column, most: int = 56) -> Column:
    """Slug of a title without its leading number; after an annex prefix leading capitals go, too."""
    t = F.regexp_replace(c, r"(?i)^\s*Annex\s+[A-Z]+\s*[-–:]?\s*", "")
    t = F.regexp_replace(t, r"^\s*[0-9A-Z]+(?:\.[0-9]+)*\s*[-–:.]?\s*", "")
    t = F.btrim(F.regexp_replace(F.lower(t), r"[^a-z0-9]+", "-"), F.lit("-"))
    t = F.rtrim(F.left(t, F.lit(most)), F.lit("-"))
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("section"))


def section_number(c: Column) -> Column:
    """Leading section number as its components, or null; any leading capital counts as one."""
    t = F.regexp_replace(strip(c), r"(?i)^\s*Annex\s+", "")
    head = F.regexp_extract(t, r"^([0-9]+|[A-Z])((?:\.[0-9]+)*)", 0)
    return F.when(head != "", F.split(head, r"\."))


def heading_slug(c: Column) -> Column:
    """Anchor of a heading, before the suffix of repeated ones."""
    t = F.lower(strip(F.replace(c, F.lit("`"), F.lit(""))))
    t = F.regexp_replace(t, r"<[^>]+>", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{M}\p{N}\p{Pc}\s-]", "")
    return F.btrim(F.regexp_replace(t, r"\s+", "-"), F.lit("-"))


def pages_text(first: Column, last: Column) -> Column:
    """``a-b``, or ``a`` for one page."""
    return F.when(last > first, F.concat_ws("-", first, last)).otherwise(first.cast("string"))


def simple_page_spans(c: Column) -> Column:
    """Spans of the plain notation only: ``a-b`` or ``n``, parted by ``;`` or ``,``; all else ignored."""

    def span(m: Column) -> Column:
        a, b = F.split_part(m, F.lit("-"), F.lit(1)).try_cast("int"), F.split_part(m, F.lit("-"), F.lit(-1)).try_cast("int")
        return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))

    parts = F.transform(F.split(c, "[;,]"), lambda p: F.regexp_replace(strip(p), r"\s*[-–]\s*", "-"))
    return F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{1,9}(?:-\d{1,9})?\z")), span)


def markdown_links(c: Column) -> Column:
    """Targets of Markdown links to ``.md`` files, without their anchors."""
    return F.regexp_extract_all(c, F.lit(r"\]\(([^)\s#]+\.md)(?:#[^)]*)?\)"), 1)


def anchor_links(c: Column) -> Column:
    """Anchors of links within a document."""
    return F.regexp_extract_all(c, F.lit(r"\]\(#([^)]+)\)"), 1)


def message_template(c: Column) -> Column:
    """A message with quoted parts as ``'…'`` and whole numbers as ``#``."""
    return F.regexp_replace(F.regexp_replace(c, r"'[^']*'", "'…'"), r"(?<![A-Za-z0-9_])\d+(?![A-Za-z0-9_])", "#")


def template_regex(c: Column) -> Column:
    """Anchored regular expression of a template; a literal ``#`` stands for digits, too."""
    t = F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    t = F.replace(F.replace(t, F.lit("'…'"), F.lit("'[^']*'")), F.lit("#"), F.lit(r"\d+"))
    return F.concat(F.lit("^"), t, F.lit("$"))


def label_value(c: Column, label: str) -> Column:
    """Value of the first ``**Label:** value`` line without outer space and backticks, or null."""
    v = F.regexp_extract(c, rf"(?m)^\*\*{re.escape(label)}:\*\*\s*(\S.*?)\s*$", 1)
    return F.when(v != "", F.btrim(strip(v), F.lit("`")))


def declarations(c: Column) -> Column:
    """array<struct(kind, path)> of backticked paths on declaration lines."""
    found = F.regexp_extract_all(c, F.lit(r"(?m)^(\*\*(?:File|New file|Destination|Artifact):\*\*\s*.+)$"), 1)

    def paths(d: Column) -> Column:
        kind = F.regexp_extract(d, r"^\*\*([^:]+):", 1)
        return F.transform(F.regexp_extract_all(d, F.lit(r"`([^`]+)`"), 1), lambda p: F.struct(kind.alias("kind"), p.alias("path")))

    return F.flatten(F.transform(found, paths))


def unquoted(c: Column) -> Column:
    """Without one pair of matching outer quotes."""
    q = F.left(c, F.lit(1))
    matching = (F.length(c) >= 2) & q.isin("'", '"') & (q == F.right(c, F.lit(1)))
    return F.when(matching, F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def scalar_kind(c: Column) -> Column:
    """empty, bool, string, array or error of a frontmatter value, by a strict grammar."""
    v = strip(c)
    quoted = v.rlike(r"""^(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')\z""")
    listed = v.rlike(r"""^\[\s*(?:(?:"[^"\\]*"|'[^'\\]*'|-?\d+)\s*(?:,\s*(?:"[^"\\]*"|'[^'\\]*'|-?\d+)\s*)*+,?\s*)?\]\z""")
    return (
        F.when(v == "", "empty").when(v.isin("true", "false"), "bool").when(quoted, "string").when(listed, "array")
        .when(v.rlike(r"""^["'\[]"""), "error").when(v.rlike(r":\s") | v.rlike(r"^[{|>&*!]"), "error").otherwise("string")
    )


def is_iso8601(c: Column) -> Column:
    """Whether text is an ISO date or timestamp of a real day and time."""
    shape = c.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{3,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?\z")
    day = F.try_to_timestamp(F.left(c, F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull()
    hour = F.coalesce(F.substring(c, 12, 2).try_cast("int"), F.lit(0)) < 24
    minute = F.coalesce(F.substring(c, 15, 2).try_cast("int"), F.lit(0)) < 60
    return shape & day & hour & minute


def csv_values(c: Column) -> Column:
    """Comma list trimmed and without blanks."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")


def yaml_quoted(c: Column) -> Column:
    """A double-quoted YAML scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def natural_key(c: Column) -> Column:
    """Sort key: digit runs compare as numbers and before text, a prefix before what it begins."""
    tokens = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)

    def part(t: Column) -> Column:
        digits = t.rlike(r"^\d")
        return F.struct(F.when(digits, 0).otherwise(1).alias("kind"), F.when(digits, t.try_cast("decimal(38,0)")).otherwise(F.lit(0)).alias("num"), F.when(digits, "").otherwise(t).alias("txt"))

    return F.transform(tokens, part)


def glob_regex(glob: str) -> str:
    """Anchored regular expression of a path glob: ``**`` crosses slashes (and takes one after it), ``*`` does not."""
    body = re.sub(r"\*\*/?|\*|[^*]+", lambda m: {"**/": ".*", "**": ".*", "*": "[^/]*"}.get(m[0]) or re.sub(r"[\\^$+?.()|\[\]{}]", r"\\\g<0>", m[0]), glob)
    return f"^{body}$"


def matches_globs(path: Column, globs: Sequence[str]) -> Column:
    """Whether a path matches any glob, bare or below any folder."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_regex(g)) | path.rlike(glob_regex("**/" + g))
    return hit


def letters(n: Column) -> Column:
    """a to z for 1 to 26, then aa, ab and so on; the empty string for 0."""
    # Seven letters count further than rows of one group can.
    step = lambda a, _: F.when(a["n"] > 0, F.struct(F.floor((a["n"] - 1) / 26).alias("n"), F.concat(F.chr(F.lit(97) + (a["n"] - 1) % 26), a["s"]).alias("s"))).otherwise(a)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct(n.cast("long").alias("n"), F.lit("").alias("s")), step, lambda a: a["s"])


def first_non_blank(*cols: Column) -> Column:
    """The first value with anything but white space, as it is; else the empty string."""
    return F.coalesce(*[F.when(strip(c) != "", c) for c in cols], F.lit(""))


def first_integer(*cols: Column) -> Column:
    """The first whole number found anywhere in the values, else 0."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c.cast("string"), r"([+-]?\d{1,9})", 1), F.lit("")).cast("int") for c in cols], F.lit(0))


def placeholders(c: Column, hints: Sequence[str] = HINTS) -> Column:
    """array<string> of what a finished document must not contain any more."""
    hinted = F.filter(
        F.regexp_extract_all(c, F.lit(r"\[([^\]\n]+)\]"), 1), lambda v: F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(F.lower(v), h))
    )
    return F.concat(
        F.when(c.contains("<!--") | c.contains("-->"), F.array(F.lit("comment"))).otherwise(F.array().cast("array<string>")),
        F.when(c.rlike(r"(?i)\b(?:TBD|TODO)\b"), F.array(F.lit("marker"))).otherwise(F.array().cast("array<string>")),
        F.when(c.contains("…"), F.array(F.lit("ellipsis"))).otherwise(F.array().cast("array<string>")),
        F.transform(hinted, lambda v: F.concat(F.lit("["), v, F.lit("]"))),
    )


