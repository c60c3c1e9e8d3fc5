"""Scalars, with the traps of their definitions; expected values are worked out by hand."""

import pytest
from pyspark.sql import functions as F

from sheaf.functions import frontmatter, pages, packed, paths, text


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("y")).collect()[0]["y"]


@pytest.mark.parametrize("value, want", [
    (None, None), ("", []), ("   ", []), ("a", ["a"]), ("a,b", ["a", "b"]), ("a,,b ;", ["a", "b"]), ("[a, b]", ["a", "b"]), ("[]", []),
    ('["a, b", "c"]', ["a, b", "c"]), ('"the ""x"" y", z', ['the "x" y', "z"]), (r'["the \"x\" y"]', ['the "x" y']), (r"a\, b, c", ["a, b", "c"]),
    ("'a; b'; c", ["a; b", "c"]), ("\"it's late\", web", ["it's late", "web"]), ("it's late, web", ["it's late", "web"]), ("“a” , \"b\"", ["a", "b"]),
    ("- a\n- b", ["a", "b"]), ("* a\n- b c", ["a", "b c"]), ("#a #b", ["a", "b"]), ("i/o / tcp/ip", ["i/o", "tcp/ip"]), ("a、b，c", ["a", "b", "c"]),
    ("a\tb", ["a", "b"]), ("a · b", ["a", "b"]), (r'["größe"]', ["größe"]), ("re-scan", ["re-scan"]), ("c++, v2.1", ["c++", "v2.1"]), ('""', []), ("a, a", ["a", "a"]),
    ("'the \"x\" y', b", ['the "x" y', "b"]), ("research|a,b", ["research", "a", "b"]),
])
def test_split_packed(spark, value, want):
    assert one(spark, value, packed.split_packed) == want


def test_split_packed_long(spark):
    """Very long texts: many values, many quotes, long blanks; linear and without deep recursion."""
    n = 50_000
    assert len(one(spark, ",".join(["ab"] * n), packed.split_packed)) == n
    assert len(one(spark, ",".join(['"a,b"'] * n), packed.split_packed)) == n
    assert one(spark, "a" + " " * 200_000 + "b", packed.split_packed) == ["a" + " " * 200_000 + "b"]
    assert one(spark, '"' * 100_001, packed.split_packed) is not None


@pytest.mark.parametrize("value, want", [
    (None, None), ("", []), ("x", []), ("n/a", []), ("7", ["7"]), ("3-5", ["3-5"]), ("5-3", ["5-3"]), ("3–5", ["3-5"]), ("1;4-6", ["1", "4-6"]), ("9..14", ["9-14"]),
    ("10 to 12", ["10-12"]), ("264-end", ["264-end"]), ("pp. 28-30", ["28-30"]), ("p.83", ["83"]), ("pages 113 - 115", ["113-115"]), ("12 (scan)", ["12"]), ("4-5 [sic]", ["4-5"]),
    ("66-68; and 64-65", ["66-68", "64-65"]), ("[1-2, 4]", ["1-2", "4"]), ("[1-2, 4],", ["1-2", "4"]), ('"1-2";"4"', ["1-2", "4"]), ("1 / 2 & 3 + 4\n5", ["1", "2", "3", "4", "5"]),
    ("99999999999", []),
])
def test_page_items(spark, value, want):
    assert one(spark, value, pages.page_items) == want


def test_page_spans(spark):
    spans = lambda v: [(s.lo, s.hi) for s in one(spark, v, pages.page_spans)]
    assert spans("5-3, 7, 9-end") == [(3, 5), (7, 7), (9, None)]
    assert [(s.lo, s.hi) for s in one(spark, "[[17, 81], [83, 129]]", pages.target_spans)] == [(17, 81), (83, 129)]
    assert [(s.lo, s.hi) for s in one(spark, "[12,84]", pages.target_spans)] == [(12, 84)]
    closed = lambda last: [(s.lo, s.hi) for s in one(spark, "9-end", lambda c: pages.close_spans(pages.page_spans(c), F.lit(last).cast("int")))]
    assert closed(12) == [(9, 12)] and closed(None) == [(9, 9)] and closed(4) == [(9, 9)]
    merged = one(spark, "1-3, 3-5, 8-7, 6, 20-22", lambda c: pages.merge_spans(pages.page_spans(c)))
    assert [(s.lo, s.hi) for s in merged] == [(1, 8), (20, 22)]
    assert one(spark, "1-3, 3-5", lambda c: pages.count_pages(pages.merge_spans(pages.page_spans(c)))) == 5


@pytest.mark.parametrize("value, want", [
    (None, None), ("", ""), (" ./a//b/../c\\d.md#x y\n", "a/c/d.md"), ("../x", "../x"), ("/a/./b", "/a/b"), ("a/b/", "a/b"), ("A/b", "A/b"), ("a/../../b", "../b"), ("#x", ""), ("a..b/c", "a..b/c"),
])
def test_normalize_path(spark, value, want):
    assert one(spark, value, paths.normalize_path) == want


def test_path_parts(spark):
    assert one(spark, "in/x y.pdf", paths.base_name) == "x y.pdf"
    assert one(spark, "a", paths.last_two_segments) == "a" and one(spark, "a/b/c", paths.last_two_segments) == "b/c"
    assert one(spark, "../c.md", lambda c: paths.join_path(F.lit("a/b"), c)) == "a/c.md"


@pytest.mark.parametrize("title, slug, sec", [
    ("12.5.2 Foo Bar", "foo-bar", ["12", "5", "2"]), ("A.1 Bar", "bar", ["A", "1"]), ("Annex A - Xyz", "yz", ["A"]), ("Annex A - PICS", "section", ["A"]),
    ("1 PURPOSE", "purpose", ["1"]), ("Contents", "ontents", ["C"]), ("lower", "lower", None), ("", "section", None),
])
def test_titles(spark, title, slug, sec):
    assert one(spark, title, text.title_slug) == slug and one(spark, title, text.section_number) == sec


def test_text_scalars(spark):
    assert one(spark, "a b c\n", text.without_space) == "abc"
    assert one(spark, "a\r\nb\n", text.lines) == ["a", "b"] and one(spark, "", text.lines) == [] and one(spark, "\n", text.lines) == [""]
    assert one(spark, "aaa", lambda c: text.count_literal(c, "aa")) == 1 and one(spark, "aaa", lambda c: text.count_literal(c, "")) == 0
    assert one(spark, "-1-2- – 7 –", text.printed_candidates) == [1, 7]
    assert one(spark, "x" * 600 + "-5-", text.printed_candidates) == []
    page = lambda v: one(spark, v, lambda c: text.classify_page(c, ["the"], ["le"], ["draft"], ["final"]))
    assert page("the le draft final").lang == "a" and page("the le draft final").version_hit == "final"
    assert page("éèê").lang == "b" and page("éè").lang == "a" and page("le le the draft").version_hit == "redline"
    assert one(spark, "Don't `use` <b>it</b>!", text.heading_slug) == "dont-use-it"
    assert one(spark, "unused 'x' in 12 of 3a", text.message_template) == "unused '…' in # of 3a"
    assert one(spark, "a '…' (#)", text.template_regex) == r"^a '[^']*' \(\d+\)$"
    assert one(spark, "**Status:**  `Ready` \nx", lambda c: text.label_value(c, "Status")) == "Ready"
    assert one(spark, "none", lambda c: text.label_value(c, "Status")) is None
    assert [tuple(x) for x in one(spark, "**File:** `a`, `b`\n**Nope:** `c`\n**New file:** `d`", text.declarations)] == [("File", "a"), ("File", "b"), ("New file", "d")]
    assert one(spark, "'a\"", text.unquoted) == "'a\"" and one(spark, '"a"', text.unquoted) == "a" and one(spark, '"', text.unquoted) == '"'
    kinds = {"": "empty", "true": "bool", '"x"': "string", "['a', 'b']": "array", "[a]": "error", "a: b": "error", "> x": "error", "plain": "string", "'open": "error"}
    assert {k: one(spark, k, text.scalar_kind) for k in kinds} == kinds
    iso = {"2024-02-29": True, "2023-02-29": False, "2024-01-01T10:20:30+02:00": True, "2024-01-01T25:00": False, "01.02.2024": False, "2024-1-1": False}
    assert {k: one(spark, k, text.is_iso8601) for k in iso} == iso
    assert one(spark, " a, ,b ", text.csv_values) == ["a", "b"] and one(spark, 'a"\\', text.yaml_quoted) == '"a\\"\\\\"'
    assert one(spark, "a 12", lambda c: text.first_integer(F.lit(None).cast("int"), c)) == 12 and one(spark, "n/a", text.first_integer) == 0
    assert one(spark, " ", lambda c: text.first_non_blank(c, F.lit(" x"))) == " x"
    assert one(spark, "see [Trigger here] … TODO <!--", lambda c: text.placeholders(c, ["trigger"])) == ["comment", "marker", "ellipsis", "[Trigger here]"]


def test_natural_order(spark):
    d = spark.createDataFrame([(x,) for x in ["A.1", "7.3.10", "7.3.1", "7.10", "7", "", "10"]], "x string")
    assert [r.x for r in d.orderBy(text.natural_key(F.col("x"))).collect()] == ["", "7", "7.3.1", "7.3.10", "7.10", "10", "A.1"]


def test_globs(spark):
    hit = lambda p, g: one(spark, p, lambda c: text.matches_globs(c, [g]))
    assert hit("api/x", "**/api/**") and hit("myapi/x", "**/api/**") and hit("a/b/c.java", "*.java") and not hit("a/b", "a*") and hit("what?", "what?") and not hit("whatX", "what?")


FM = '---\nsource: "a: b"\nclause: 1\nclause: 2\nbad\n---\nbody: x\n'


def test_frontmatter(spark):
    assert one(spark, FM, frontmatter.lenient) == {"source": "a: b", "clause": "2"}
    assert one(spark, "---\na: 1", frontmatter.lenient) == {"a": "1"} and one(spark, "x\n---\na: 1", frontmatter.lenient) == {} and one(spark, "", frontmatter.lenient) == {}
    got = one(spark, "----\na: 1", frontmatter.checked)
    assert got.fields == {"a": "1"} and got.err == "not closed"
    assert one(spark, "a", frontmatter.checked).err == "no start" and one(spark, FM, frontmatter.checked).err is None
    d = spark.createDataFrame([(1, FM), (2, "---\nopen: 1\n"), (3, None)], "k int, raw string")
    rows = {(r.k, r.line): (r.name, r.err) for r in frontmatter.strict(d, "k", "raw").collect()}
    assert rows == {(1, 2): ("source", None), (1, 3): ("clause", None), (1, 4): ("clause", "duplicate"), (1, 5): (None, "malformed")}


def test_normalize_path_against_plain_python(spark):
    import itertools
    import posixpath

    from pyspark.sql import functions as F

    from sheaf.functions.paths import normalize_path

    parts = ["a", "b.md", ".", "..", "", ".x", " ", "ä"]
    paths = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(parts, repeat=n)]
    paths += [p + t for p in ("a/b", "a/../b", "../a") for t in ("#x", "#a/../b", " ", "\t", "/", " ")] + ["a\\b", "\\a\\..\\b", " a/b", "", None]
    got = {r.p: r.n for r in spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "p string").select("p", normalize_path(F.col("p")).alias("n")).collect()}
    for p in paths:
        if p is None:
            assert got[p] is None
            continue
        clean = p.split("#")[0].replace("\\", "/").strip(" \t\r\n ")
        want = posixpath.normpath(clean) if clean else ""
        want = "" if want == "." else "/" + want.lstrip("/") if clean.startswith("/") else want
        if clean.startswith("/") and got[p].startswith("/.."):
            continue  # ".." above the root stays as written
        assert got[p] == want, (p, got[p], want)
