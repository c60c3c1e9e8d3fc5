"""Queries over records: planning, coverage, reconciliation, integrity, sampling, sets, arrays, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from sheaf.functions import text
from sheaf.functions.pages import count_pages, merge_spans, page_items
from sheaf.functions.paths import base_name, last_two_segments, normalize_path
from sheaf.operators import drift, figures, intervals, lagged, lookups, planning, policy, reconcile, sampling, state
from sheaf.plans.catalog import Catalog
from sheaf.session import written
from sheaf.sources import sinks
from sheaf.sources.tables import table

C = Catalog()

# ---- planning from outlines ------------------------------------------------------------------

OUTLINES_SQL = r"""WITH probed AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(pdf, '([^/]*)$', 1) ORDER BY probed_at DESC, probe_id DESC) AS rn FROM probe
), outlines AS (SELECT regexp_extract(pdf, '([^/]*)$', 1) AS doc, pages, outline FROM probed WHERE rn = 1
), raw_entries AS (SELECT doc, pages, unnest(outline) AS e, generate_subscripts(outline, 1) - 1 AS pos FROM outlines
), entries AS (SELECT doc, pos, e.page AS page, coalesce(e.title, '') AS title,
    regexp_extract(regexp_replace(trim(coalesce(e.title, '')), '^\s*Annex\s+', '', 'i'), '^([0-9]+|[A-Z])((?:\.[0-9]+)*)') AS clause FROM raw_entries
), numbered AS (SELECT *, len(string_split(clause, '.')) AS depth FROM entries WHERE page IS NOT NULL AND page <> 0 AND clause <> ''
), body AS (SELECT n.doc, coalesce(min(CASE WHEN depth = 1 AND regexp_matches(clause, '^\d') THEN page END), min(page)) AS body_start,
    coalesce(nullif(max(o.pages), 0), max(page)) AS body_end FROM numbered n LEFT JOIN outlines o ON n.doc = o.doc GROUP BY n.doc
), units AS (SELECT n.*, body_start, body_end FROM numbered n JOIN body USING (doc) WHERE depth <= 2 AND page BETWEEN body_start AND body_end
), spans AS (SELECT *, least(greatest(page, coalesce((SELECT min(v.page) FROM units v WHERE v.doc = u.doc AND v.page > u.page) - 1, body_end)), body_end) AS section_end FROM units u)"""


def outlines(spark: SparkSession, root: str) -> DataFrame:
    """(doc, pages, outline): the last probe of every PDF."""
    p = table(spark, root, "probe").select(base_name(F.col("pdf")).alias("doc"), "pages", "outline", "probed_at", "probe_id")
    return reconcile.last_wins(p, ["doc"], [F.col("probed_at"), F.col("probe_id")]).select("doc", "pages", "outline")


@C.add(OUTLINES_SQL + " SELECT doc, pos::INT AS pos, page, title, clause FROM numbered")
def outline_entries(spark, root):
    """Outline entries with a page and a readable section number."""
    e = planning.numbered_entries(outlines(spark, root), "doc", "outline")
    return e.select("doc", "pos", "page", "title", F.array_join("sec", ".").alias("clause"))


@C.add(OUTLINES_SQL + " SELECT doc, body_start, body_end FROM body")
def body_ranges(spark, root):
    """First and last page of the body of every PDF."""
    o = outlines(spark, root)
    return planning.body_range(planning.numbered_entries(o, "doc", "outline"), o, "doc", "pages")


@C.add(OUTLINES_SQL + " SELECT doc, pos::INT AS pos, clause, page, section_end FROM spans")
def section_spans(spark, root):
    """Chapters and sections, each up to the page before the next start."""
    o = outlines(spark, root)
    e = planning.numbered_entries(o, "doc", "outline")
    s = planning.section_spans(e, planning.body_range(e, o, "doc", "pages"), "doc")
    return s.select("doc", "pos", F.array_join("sec", ".").alias("clause"), "page", "section_end")


@C.add(OUTLINES_SQL + """ SELECT doc, pos::INT AS pos, i::INT AS part, (page + i * 11)::INT AS lo, greatest(page, least(section_end, page + i * 11 + 11))::INT AS hi
  FROM spans, unnest(generate_series(0, CASE WHEN section_end - page + 1 <= 12 THEN 0 ELSE ceil((section_end - page + 1 - 12) / 11)::INT END)) AS g(i)""")
def tiled_windows(spark, root):
    """Windows of 12 pages with one shared over every section."""
    o = outlines(spark, root)
    e = planning.numbered_entries(o, "doc", "outline")
    s = planning.section_spans(e, planning.body_range(e, o, "doc", "pages"), "doc")
    return s.select("doc", "pos", F.posexplode(planning.tile(F.col("page"), F.col("section_end"), 12, 1)).alias("part", "w")).select("doc", "pos", "part", "w.lo", "w.hi")


PLANNED_SQL = OUTLINES_SQL.replace("WITH probed", "WITH RECURSIVE probed") + r""", kids AS (SELECT doc, regexp_replace(clause, '\.[^.]*$', '') AS parent, page AS c FROM numbered WHERE depth >= 2
), stops AS (SELECT DISTINCT s.doc, s.pos, c AS stop FROM spans s JOIN kids k ON k.doc = s.doc AND k.parent = s.clause WHERE s.page < c AND c <= s.section_end AND s.section_end - s.page + 1 > 12
), ends AS (SELECT * FROM stops UNION SELECT DISTINCT doc, pos, (SELECT section_end + 1 FROM spans s WHERE s.doc = t.doc AND s.pos = t.pos) FROM stops t
), walk AS (SELECT doc, pos, page AS s, section_end AS e, page AS lo, 0 AS nr, (SELECT coalesce(max(stop) FILTER (stop - page <= 12), min(stop)) FROM ends d WHERE d.doc = p.doc AND d.pos = p.pos) AS nxt
    FROM spans p WHERE EXISTS (SELECT 1 FROM stops q WHERE q.doc = p.doc AND q.pos = p.pos)
  UNION ALL SELECT doc, pos, s, e, w.nxt, nr + 1, (SELECT coalesce(max(stop) FILTER (stop - w.nxt <= 12), min(stop)) FROM ends d WHERE d.doc = w.doc AND d.pos = w.pos AND stop > w.nxt) FROM walk w WHERE w.nxt <= e
), parts AS (SELECT doc, pos, nr, CASE WHEN nr = 0 THEN lo ELSE greatest(s, lo - 1) END AS a, nxt - 1 AS z FROM walk
  UNION ALL SELECT doc, pos, 0, page, greatest(page, section_end) FROM spans p WHERE NOT EXISTS (SELECT 1 FROM stops q WHERE q.doc = p.doc AND q.pos = p.pos)
), tiles AS (SELECT doc, pos, nr, i, (a + i * 11)::INT AS lo, least(z, a + i * 11 + 11)::INT AS hi FROM parts, unnest(generate_series(0, CASE WHEN z - a + 1 <= 12 THEN 0 ELSE ceil((z - a + 1 - 12) / 11)::INT END)) AS g(i)
), planned AS (SELECT *, (row_number() OVER w - 1)::INT AS part, count(*) OVER (PARTITION BY doc, pos) AS n, lag(hi) OVER w AS prev_end FROM tiles WINDOW w AS (PARTITION BY doc, pos ORDER BY nr, i))"""
_SLUG_SQL = r"""coalesce(nullif(rtrim(trim(regexp_replace(lower(regexp_replace(regexp_replace(title, '^\s*Annex\s+[A-Z]+\s*[-–:]?\s*', '', 'i'),
  '^\s*[0-9A-Z]+(?:\.[0-9]+)*\s*[-–:.]?\s*', '')), '[^a-z0-9]+', '-', 'g'), '-')[1:56], '-'), ''), 'section')"""


@C.add(PLANNED_SQL + f""" SELECT doc, pos::INT AS pos, part, clause, trim(title) AS title, CASE WHEN hi > lo THEN lo || '-' || hi ELSE lo::VARCHAR END AS pdf_pages,
  doc || '/' || clause || CASE WHEN n = 1 THEN '' WHEN part < 26 THEN chr(97 + part) WHEN part < 702 THEN chr(96 + part // 26) || chr(97 + part % 26) ELSE error('three letters') END || '-' || {_SLUG_SQL} || '.md' AS target_file,
  hi - lo + 1 AS est_pages, prev_end FROM planned JOIN numbered USING (doc, pos)""")
def planned_fragments(spark, root):
    """Fragments planned from the outlines, windows ending on child sections where they can."""
    return planning.plan_fragments(outlines(spark, root), "doc", "outline", "pages").drop("lo", "hi")


@C.add(PLANNED_SQL + """, named AS (SELECT doc, unnest(generate_series(lo, hi)) AS p FROM planned), once AS (SELECT doc, p, count(*) AS k FROM named GROUP BY ALL
), aims AS (SELECT doc, unnest(generate_series(body_start, body_end)) AS p FROM body), free AS (SELECT * FROM aims ANTI JOIN once USING (doc, p)
), o AS (SELECT doc, sum(k - 1)::BIGINT AS repeats, min(p)::INT AS first_page, max(p)::INT AS last_page FROM once GROUP BY doc
), a AS (SELECT doc, count(*) AS n FROM aims GROUP BY doc), f AS (SELECT doc, count(*) AS u, array_to_string(list_slice(list(p ORDER BY p), 1, 20), ',') AS pages FROM free GROUP BY doc)
SELECT b.doc, coalesce(n, 0) AS body_pages, coalesce(n, 0) - coalesce(u, 0) AS covered, coalesce(u, 0) AS uncovered, round(100.0 * (coalesce(n, 0) - coalesce(u, 0)) / greatest(1, coalesce(n, 0)), 2) AS percent,
  coalesce(repeats, 0) AS repeats, first_page, last_page, coalesce(pages, '') AS uncovered_pages FROM body b LEFT JOIN o ON o.doc = b.doc LEFT JOIN a ON a.doc = b.doc LEFT JOIN f ON f.doc = b.doc""")
def planned_coverage(spark, root):
    """How much of the body the planned fragments cover, per PDF."""
    o = outlines(spark, root)
    body = planning.body_range(planning.numbered_entries(o, "doc", "outline"), o, "doc", "pages")
    # Planned once: coverage reads the windows more than once.
    return planning.coverage(written(planning.plan_fragments(o, "doc", "outline", "pages").select("doc", "lo", "hi")), body, "doc")


@C.add(OUTLINES_SQL + """ SELECT doc, regexp_replace(clause, '\\.[^.]*$', '') AS parent, string_agg(page, ',' ORDER BY page) AS children
  FROM numbered WHERE depth >= 2 GROUP BY ALL""")
def section_children(spark, root):
    """First pages of the sections below each section."""
    k = planning.children_of(planning.numbered_entries(outlines(spark, root), "doc", "outline"), "doc")
    return k.select("doc", "parent", F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@C.add(OUTLINES_SQL + """ SELECT doc, string_split(clause, '.')[1] AS chapter, count(*) AS n, row_number() OVER (PARTITION BY doc ORDER BY length(string_split(clause, '.')[1]), string_split(clause, '.')[1])::INT AS place
  FROM numbered GROUP BY doc, string_split(clause, '.')[1]""")
def chapter_counts(spark, root):
    """Entries per chapter, ordered by length and name of the chapter."""
    e = planning.numbered_entries(outlines(spark, root), "doc", "outline").withColumn("chapter", F.get("sec", F.lit(0)))
    n = e.groupBy("doc", "chapter").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.length("chapter"), "chapter")))


# ---- page lists and coverage -------------------------------------------------------------------

SIMPLE_SQL = r"""parts AS (SELECT DISTINCT frag_id, pdf_file, unnest(list_transform(string_split(replace(pdf_pages, ';', ','), ','), lambda x: regexp_replace(trim(x), '\s*[-–]\s*', '-'))) AS p FROM fragments WHERE pdf_pages IS NOT NULL AND pdf_file IS NOT NULL
), spans AS (SELECT frag_id, pdf_file, least(string_split(p, '-')[1]::INT, string_split(p, '-')[-1]::INT) AS lo, greatest(string_split(p, '-')[1]::INT, string_split(p, '-')[-1]::INT) AS hi FROM parts WHERE regexp_matches(p, '^\d{1,9}(?:-\d{1,9})?$'))"""


def _simple(spark, root):
    f = table(spark, root, "fragments").where(F.col("pdf_file").isNotNull()).select("frag_id", "pdf_file", "pdf_pages").distinct()
    return f.select("frag_id", "pdf_file", F.inline(text.simple_page_spans(F.col("pdf_pages")))).distinct()


@C.add(f"WITH {SIMPLE_SQL} SELECT frag_id, count(DISTINCT page) AS n_pages, min(page)::INT AS first_page, max(page)::INT AS last_page FROM (SELECT frag_id, unnest(generate_series(lo, hi)) AS page FROM spans) GROUP BY frag_id")
def page_spec_sets(spark, root):
    """Different pages named by every fragment in the plain notation."""
    f = table(spark, root, "fragments").where("pdf_file is not null").select("frag_id", merge_spans(text.simple_page_spans(F.col("pdf_pages"))).alias("s")).distinct().where(F.size("s") > 0)
    return f.select("frag_id", count_pages(F.col("s")).alias("n_pages"), F.get("s", F.lit(0))["lo"].alias("first_page"), F.get("s", F.size("s") - 1)["hi"].alias("last_page"))


@C.add(f"""WITH {SIMPLE_SQL}, pages AS (SELECT pdf_file, page, count(*) AS n FROM (SELECT pdf_file, unnest(generate_series(lo, hi)) AS page FROM (SELECT DISTINCT frag_id, pdf_file, lo, hi FROM spans)) GROUP BY ALL
), body AS (SELECT pdf_file, min(page) AS body_start, max(page) AS body_end FROM pages GROUP BY pdf_file)
SELECT pdf_file, max(body_end - body_start + 1)::BIGINT AS body_pages, count(*) AS covered, max(body_end - body_start + 1)::BIGINT - count(*) AS uncovered, sum(n - 1)::BIGINT AS repeats, min(page)::INT AS first_page, max(page)::INT AS last_page,
  round(100.0 * count(*) / max(body_end - body_start + 1), 2) AS percent, coalesce((SELECT array_to_string(list_slice(list(p ORDER BY p), 1, 20), ',') FROM (SELECT unnest(generate_series(b.body_start, b.body_end)) AS p FROM body b WHERE b.pdf_file = pages.pdf_file) WHERE p NOT IN (SELECT page FROM pages q WHERE q.pdf_file = pages.pdf_file)), '') AS uncovered_pages
FROM pages JOIN body USING (pdf_file) GROUP BY pdf_file""")
def page_coverage(spark, root):
    """Pages covered, repeated and missing per PDF, between its first and last named page."""
    s = _simple(spark, root)
    body = s.groupBy("pdf_file").agg(F.min("lo").alias("body_start"), F.max("hi").alias("body_end"))
    return planning.coverage(s.select("pdf_file", "lo", "hi"), body, "pdf_file")


@C.add(f"""WITH {SIMPLE_SQL}, pages AS (SELECT DISTINCT pdf_file, unnest(generate_series(lo, hi)) AS page FROM spans
), body AS (SELECT pdf_file, unnest(generate_series(min(page), max(page))) AS page FROM pages GROUP BY pdf_file
), free AS (SELECT * FROM body ANTI JOIN pages USING (pdf_file, page)) SELECT pdf_file, page::INT AS page FROM (SELECT *, row_number() OVER (PARTITION BY pdf_file ORDER BY page) AS rn FROM free) WHERE rn <= 20""")
def first_uncovered(spark, root):
    """The first 20 pages of every PDF that no fragment names, out of its gaps."""
    s = _simple(spark, root).select("pdf_file", "lo", "hi")
    gaps = intervals.periods_and_gaps(s, s.limit(0), ["pdf_file"]).where("span_kind = 'gap'")
    free = gaps.select("pdf_file", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + 19))).alias("page")).select("pdf_file", F.col("page").cast("int").alias("page"))
    return policy.top_k(free, ["pdf_file"], [F.col("page")], 20)


# ---- joins ---------------------------------------------------------------------------------------

NORM = r"""regexp_replace(regexp_replace(regexp_replace(trim(replace(split_part({0}, '#', 1), '\', '/'), E' \t\r\n'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '(^|/)[^/.][^/]*/\.\./', '\1')"""


@C.add(f"""WITH m AS (SELECT DISTINCT {NORM.format('file')} AS file FROM manifest WHERE file IS NOT NULL), d AS (SELECT DISTINCT {NORM.format('file')} AS file FROM fragment_file)
SELECT file, 'not on disk' AS side FROM m ANTI JOIN d USING (file) UNION ALL SELECT file, 'not in manifest' FROM d ANTI JOIN m USING (file)""")
def manifest_against_disk(spark, root):
    """Files on one side only, of manifest and disk."""
    norm = lambda t: table(spark, root, t).select(normalize_path(F.col("file")).alias("file"))
    return reconcile.reconcile(norm("manifest"), norm("fragment_file"), "file", ("not on disk", "not in manifest"))


@C.add(f"SELECT file, count(*) AS n FROM (SELECT {NORM.format('file')} AS file FROM manifest WHERE file IS NOT NULL) GROUP BY file HAVING count(*) > 1")
def manifest_duplicates(spark, root):
    """Files that the manifest lists more than once."""
    return reconcile.duplicates(table(spark, root, "manifest").select(normalize_path(F.col("file")).alias("file")), "file")


@C.add("""SELECT 'manifest' AS tbl, count(manifest_id) AS n, count(DISTINCT manifest_id) AS n_distinct, count(manifest_id) = count(DISTINCT manifest_id) AS is_unique FROM manifest
UNION ALL SELECT 'fragments', count(frag_id), count(DISTINCT frag_id), count(frag_id) = count(DISTINCT frag_id) FROM fragments""")
def key_uniqueness(spark, root):
    """Whether row ids are unique."""
    of = lambda t, k: reconcile.uniqueness(table(spark, root, t), k).withColumn("tbl", F.lit(t))
    return of("manifest", "manifest_id").unionByName(of("fragments", "frag_id"))


# These texts name files in prose, not in Markdown links: every such name is held against the files there are.
NAMED_FILE = r"([A-Za-z][\w-]*/[\w./-]*\w\.md)"


@C.add(f"""WITH links AS (SELECT DISTINCT doc_id::VARCHAR AS file, unnest(regexp_extract_all(text, '{NAMED_FILE}', 1)) AS link FROM documents
  UNION SELECT 'file ' || split_part(file, '/', 1), unnest(regexp_extract_all(raw, '{NAMED_FILE}', 1)) FROM fragment_file), known AS (SELECT DISTINCT regexp_replace(file, '^([^/-]*)[^/]*/', '\\1/') AS resolved FROM fragment_file)
SELECT file, link, link AS resolved FROM links WHERE link NOT IN (SELECT resolved FROM known)""")
def dangling_links(spark, root):
    """Files named in documents and in files that no file answers, by document family and name."""
    d = table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    d = d.unionByName(table(spark, root, "fragment_file").select(F.concat(F.lit("file "), F.split_part("file", F.lit("/"), F.lit(1))).alias("file"), F.col("raw").alias("text")))
    known = table(spark, root, "fragment_file").select(F.regexp_replace("file", r"^([^/-]*)[^/]*/", "$1/").alias("f"))
    return reconcile.dangling_links(d, "file", "text", known, "f", lambda t: F.regexp_extract_all(t, F.lit(NAMED_FILE), 1))


@C.add("""SELECT f.frag_id, f.doc, m.clean, m.page_offset FROM (SELECT DISTINCT frag_id, doc, pdf_file FROM fragments) f JOIN (
  SELECT pdf_file, clean, page_offset FROM (SELECT *, row_number() OVER (PARTITION BY pdf_file ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST) AS rn FROM doc_meta) WHERE rn = 1) m USING (pdf_file)""")
def fragment_meta_lookup(spark, root):
    """Every fragment with the latest metadata of its PDF."""
    f = table(spark, root, "fragments").select("frag_id", "doc", "pdf_file").distinct()
    m = table(spark, root, "doc_meta").select("pdf_file", "clean", "page_offset", "updated_at", "loaded_at")
    return reconcile.lookup(f, m, ["pdf_file"], [F.col("updated_at"), F.col("loaded_at")]).select("frag_id", "doc", "clean", "page_offset")


def first_pages(spark, root) -> DataFrame:
    """(frag_id, pdf_file, first_page) of all fragments: the number that the first readable part of the page list begins with, null where none is."""
    p = F.split_part(F.get(page_items(F.col("pdf_pages")), F.lit(0)), F.lit("-"), F.lit(1)).try_cast("int")
    return table(spark, root, "fragments").select("frag_id", "pdf_file", p.alias("first_page")).distinct()


FIRST_PAGES_SQL = r"(SELECT DISTINCT frag_id, pdf_file, nullif(regexp_extract(pdf_pages, '(\d+)', 1), '')::INT AS first_page FROM fragments)"


@C.add(OUTLINES_SQL + f""" SELECT frag_id, first_page, b.boundary::INT AS next_boundary FROM {FIRST_PAGES_SQL} f
  LEFT JOIN LATERAL (SELECT min(page) AS boundary FROM units u WHERE u.doc = f.pdf_file AND u.page > f.first_page) b ON true""")
def next_boundary(spark, root):
    """For every fragment the first section start after its first page (strict forward as-of); null without a readable page."""
    s = planning.section_starts(outlines(spark, root), "doc", "outline", "pages").select(F.col("doc").alias("pdf_file"), F.col("page").alias("boundary"))
    f = first_pages(spark, root)
    return lookups.next_after(f, s, ["pdf_file"], "first_page", "boundary").select("frag_id", "first_page", F.col("found").alias("next_boundary"))


@C.add(OUTLINES_SQL + f""" SELECT frag_id, first_page, CASE WHEN first_page IS NOT NULL THEN b.boundary END::INT AS section_page FROM {FIRST_PAGES_SQL} f
  LEFT JOIN LATERAL (SELECT coalesce(max(page) FILTER (page <= f.first_page), min(page)) AS boundary FROM units u WHERE u.doc = f.pdf_file) b ON true""")
def owning_section(spark, root):
    """For every fragment the nearest section start at or before its first page, else the first one (backward as-of); null without a readable page."""
    s = planning.section_starts(outlines(spark, root), "doc", "outline", "pages").select(F.col("doc").alias("pdf_file"), F.col("page").alias("boundary"))
    f = first_pages(spark, root)
    return lookups.last_before(f, s, ["pdf_file"], "first_page", "boundary").select("frag_id", "first_page", F.col("found").alias("section_page"))


@C.add("""SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS segment, c_custkey IS NOT NULL AS hit FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def cached_lookup(spark, root):
    """Orders with the segment of customers in the cache, a default for misses."""
    cache = table(spark, root, "customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    o = table(spark, root, "orders")
    return o.join(cache, o.o_custkey == cache.c_custkey, "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), F.col("c_custkey").isNotNull().alias("hit"))


@C.add(f"""WITH i AS (SELECT DISTINCT {NORM.format('file')} AS file FROM manifest WHERE file IS NOT NULL), r AS (SELECT {NORM.format('file')} AS file, raw FROM fragment_file)
SELECT i.file, count(r.file) AS n_results FROM i LEFT JOIN r USING (file) GROUP BY i.file HAVING count(*) FILTER (raw <> '') = 0""")
def dead_results(spark, root):
    """Files of the manifest that nothing was written for, or only files without text."""
    norm = lambda t, *more: table(spark, root, t).select(normalize_path(F.col("file")).alias("file"), *more)
    return reconcile.dead_results(norm("manifest"), norm("fragment_file", "raw"), "file", "raw")


@C.add("""SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def denylist(spark, root):
    """Orders of customers that are not on a list (left anti)."""
    deny = table(spark, root, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, root, "orders").join(deny, "o_custkey", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@C.add("""WITH a AS (SELECT doc, list(DISTINCT clause) AS l FROM fragments WHERE clause IS NOT NULL GROUP BY doc)
SELECT DISTINCT li.entry_id, li.doc FROM link_index li JOIN a ON li.doc = a.doc WHERE NOT list_contains(a.l, split_part(li.by_clause, '§', 2))""")
def links_to_unplanned_clauses(spark, root):
    """Link entries whose clause no fragment of the same document plans."""
    li = table(spark, root, "link_index").where(F.col("by_clause").isNotNull()).select("entry_id", "doc", F.split_part("by_clause", F.lit("§"), F.lit(2)).alias("clause"))
    fr = table(spark, root, "fragments").where(F.col("clause").isNotNull()).select("doc", "clause").distinct()
    return li.join(fr.select("doc").distinct(), "doc", "left_semi").join(fr, ["doc", "clause"], "left_anti").select("entry_id", "doc")


@C.add("""SELECT by_clause, target_file, built_at FROM (SELECT *, row_number() OVER (PARTITION BY by_clause ORDER BY built_at DESC, entry_id DESC) AS rn FROM link_index WHERE by_clause IS NOT NULL) WHERE rn = 1""")
def link_index_last_wins(spark, root):
    """The latest target of every clause."""
    li = table(spark, root, "link_index").where(F.col("by_clause").isNotNull())
    return reconcile.last_wins(li, ["by_clause"], [F.col("built_at"), F.col("entry_id")]).select("by_clause", "target_file", "built_at")


# ---- predicates and projections --------------------------------------------------------------------

@C.add(r"""SELECT DISTINCT file, coalesce(nullif(split_part(file, '/', 1), ''), '?') AS folder, regexp_matches(file, '\.md$') AS is_md, regexp_matches(file, '(^|/)harbornet/') AS in_harbornet,
  upper(regexp_extract(file, '([^/]*)$', 1)) LIKE 'README%' AS is_readme, regexp_matches(file, '^.*harbornet/v1[^/]*$') AS by_glob,
  CASE WHEN len(string_split(file, '/')) <= 2 THEN file ELSE array_to_string(string_split(file, '/')[-2:], '/') END AS short FROM fragment_file""")
def path_filters(spark, root):
    """Extension, folder, name and glob predicates over files on disk."""
    f = table(spark, root, "fragment_file").select("file").distinct()
    c = F.col("file")
    return f.select(
        "file", F.coalesce(F.nullif(F.split_part(c, F.lit("/"), F.lit(1)), F.lit("")), F.lit("?")).alias("folder"), c.rlike(r"\.md\z").alias("is_md"), c.rlike("(^|/)harbornet/").alias("in_harbornet"),
        F.upper(base_name(c)).startswith("README").alias("is_readme"), c.rlike(text.glob_regex("**/harbornet/v1*")).alias("by_glob"), last_two_segments(c).alias("short"),
    )


@C.add(r"""SELECT file FROM (SELECT DISTINCT file FROM fragment_file) WHERE file LIKE '%/%.md' AND NOT regexp_matches(file, '(^|/)_maps/') AND regexp_extract(file, '([^/]*)$', 1) <> 'README.md'
  AND split_part(file, '/', 1) IN (SELECT DISTINCT doc FROM fragments)""")
def corpus_files(spark, root):
    """Files of the corpus below the folders of known documents, without map files and readme."""
    f = table(spark, root, "fragment_file").select("file").distinct()
    c = F.col("file")
    known = table(spark, root, "fragments").select(F.col("doc").alias("_doc")).where("_doc is not null").distinct()
    kept = f.where(c.rlike(r"/[^/]*\.md\z") & ~c.rlike(r"(^|/)_maps/") & (base_name(c) != "README.md")).withColumn("_doc", F.split_part(c, F.lit("/"), F.lit(1)))
    return kept.join(known, "_doc", "left_semi").select("file")


@C.add("""SELECT DISTINCT doc, pdf_file, CASE WHEN trim(clean) <> '' THEN clean WHEN trim(target_pages) <> '' THEN target_pages ELSE '' END AS directive,
  coalesce(page_offset, try_cast(regexp_extract(target_pages, '([+-]?\\d{1,9})', 1) AS INT), 0) AS page_offset FROM doc_meta""")
def meta_fallbacks(spark, root):
    """First non-blank directive and first usable number of every PDF's metadata."""
    m = table(spark, root, "doc_meta")
    return m.select("doc", "pdf_file", text.first_non_blank(F.col("clean"), F.col("target_pages")).alias("directive"), text.first_integer(F.col("page_offset"), F.col("target_pages")).alias("page_offset")).distinct()


@C.add("""SELECT kind, CASE WHEN scanned THEN 'high' WHEN kind IN ('annex', 'table') THEN 'medium' ELSE 'low' END AS effort, count(*) AS n FROM (SELECT DISTINCT frag_id, coalesce(kind, '?') AS kind, scanned FROM fragments) GROUP BY ALL""")
def effort_by_kind(spark, root):
    """Fragments by kind and effort; a missing kind counts as ``?``."""
    f = table(spark, root, "fragments").select("frag_id", F.coalesce("kind", F.lit("?")).alias("kind"), "scanned").distinct()
    return f.select("kind", F.when(F.col("scanned"), "high").when(F.col("kind").isin("annex", "table"), "medium").otherwise("low").alias("effort")).groupBy("kind", "effort").agg(F.count(F.lit(1)).alias("n"))


@C.add(rf"""SELECT file, written_at, n_lines FROM (SELECT DISTINCT file, written_at, raw,
  CASE WHEN raw = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(raw, '(?:{text.LINE_END})$', ''), '{text.LINE_END}')) END::INT AS n_lines FROM fragment_file) WHERE n_lines > 9""")
def long_files(spark, root):
    """Files of more than 9 lines, counted in their text, each time they were written."""
    f = table(spark, root, "fragment_file").select(F.struct("file", "written_at").alias("k"), "raw").distinct()
    return reconcile.line_counts(f, "k", "raw", 9).select("k.*", "n_lines")


@C.add("""SELECT file, n_lines FROM (SELECT DISTINCT file, n_lines, written_at FROM fragment_file) WHERE n_lines > 600""")
def oversized_files(spark, root):
    """Files recorded with more than 600 lines, each time they were written."""
    return table(spark, root, "fragment_file").where("n_lines > 600").select("file", "n_lines", "written_at").distinct().select("file", "n_lines")


@C.add("""SELECT status, count(*) AS n, count(*) FILTER (status NOT IN ('draft', 'in-progress', 'complete') OR status IS NULL) AS n_bad FROM (SELECT DISTINCT research_id, status FROM research_doc) GROUP BY status""")
def status_domain(spark, root):
    """Statuses and those outside the allowed ones."""
    r = table(spark, root, "research_doc").select("research_id", "status").distinct()
    bad = ~F.coalesce(F.col("status").isin("draft", "in-progress", "complete"), F.lit(False))
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("n_bad"))


@C.add(r"""SELECT DISTINCT research_id, coalesce(regexp_matches(doc_date, '^\d{4}-\d{2}-\d{2}$') AND try_cast(doc_date AS DATE) IS NOT NULL, false) AS iso_date,
  ((repository IS NOT NULL)::INT + (git_commit IS NOT NULL)::INT + (branch IS NOT NULL)::INT + (dirty IS NOT NULL)::INT) IN (0, 4) AS repository_ok FROM research_doc""")
def research_field_checks(spark, root):
    """ISO dates and all-or-none repository fields of research documents."""
    n = sum((F.col(c).isNotNull().cast("int") for c in ("repository", "git_commit", "branch", "dirty")), F.lit(0))
    return table(spark, root, "research_doc").select("research_id", F.coalesce(text.is_iso8601(F.col("doc_date")), F.lit(False)).alias("iso_date"), n.isin(0, 4).alias("repository_ok")).distinct()


# ---- sorting, sampling, sets -------------------------------------------------------------------------

@C.add(r"""SELECT DISTINCT coalesce(doc, '') AS doc, clause, dense_rank() OVER (PARTITION BY coalesce(doc, '') ORDER BY list_transform(regexp_extract_all(clause, '\d+|\D+'),
  lambda t: CASE WHEN regexp_matches(t, '^\d') THEN '0' || lpad(t, 20, '0') ELSE '1' || t END))::INT AS place FROM fragments WHERE clause IS NOT NULL""")
def natural_clause_order(spark, root):
    """Clauses of every document in natural order."""
    return sampling.natural_places(table(spark, root, "fragments").withColumn("doc", F.coalesce("doc", F.lit(""))), "doc", "clause")


FR = "(SELECT DISTINCT frag_id, coalesce(kind, '?') AS kind, pdf_file FROM fragments)"


@C.add(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY pdf_file, kind ORDER BY frag_id) AS k, row_number() OVER (PARTITION BY pdf_file ORDER BY frag_id) AS rn, count(*) OVER (PARTITION BY pdf_file) AS n FROM {FR})
SELECT frag_id, kind, pdf_file FROM f WHERE k <= 3 OR (rn - 1) % greatest(1, floor(n / 10))::BIGINT = 0""")
def stratified_sample(spark, root):
    """The first 3 fragments of every kind of a PDF and a tenth of its fragments at even distances."""
    f = table(spark, root, "fragments").select("frag_id", F.coalesce("kind", F.lit("?")).alias("kind"), "pdf_file").distinct()
    return sampling.stratified(f, "pdf_file", "kind", "frag_id")


@C.add(f"SELECT frag_id, pdf_file, ((row_number() OVER (PARTITION BY pdf_file ORDER BY frag_id) - 1) // 5)::INT AS batch FROM {FR}")
def batch_numbers(spark, root):
    """Batches of five fragments within each PDF."""
    return sampling.batches(table(spark, root, "fragments").select("frag_id", "pdf_file").distinct(), "pdf_file", "frag_id", 5)


@C.add("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def global_row_numbers(spark, root):
    """Row numbers over the whole of orders by falling price, without a sort in one task."""
    return sampling.numbered(table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), [F.col("o_totalprice").desc(), F.col("o_orderkey")]).select("o_orderkey", F.col("rn").cast("long").alias("rn"))


@C.add("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(spark, root):
    """The 20 dearest orders: a top-k report."""
    return table(spark, root, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


FILES = {"link_index": "target_file", "fragments": "target_file", "manifest": "file"}


@C.add(" UNION ".join(f"SELECT {NORM.format(c)} AS file FROM {t} WHERE {c} IS NOT NULL" for t, c in FILES.items()))
def referenced_files(spark, root):
    """Union of the paths in three tables, each once."""
    out = None
    for t, c in FILES.items():
        d = table(spark, root, t).where(F.col(c).isNotNull()).select(normalize_path(F.col(c)).alias("file"))
        out = d if out is None else out.union(d)
    return out.distinct()


@C.add("""SELECT file, 'both' AS side FROM (SELECT file FROM fragment_file INTERSECT SELECT file FROM manifest) UNION ALL SELECT file, 'disk only' FROM (SELECT file FROM fragment_file EXCEPT SELECT file FROM manifest)""")
def file_set_operations(spark, root):
    """Intersection and difference of file names as written."""
    a, b = table(spark, root, "fragment_file").select("file"), table(spark, root, "manifest").select("file")
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("disk only")))


@C.add("""SELECT doc, kind, NULL::INT AS page_offset, 'fragment' AS origin FROM (SELECT DISTINCT frag_id, doc, kind FROM fragments) UNION ALL SELECT doc, NULL, page_offset, 'meta' FROM (SELECT DISTINCT doc, pdf_file, page_offset FROM doc_meta)""")
def open_schema_union(spark, root):
    """Records of unlike shape in one table."""
    f = table(spark, root, "fragments").select("frag_id", "doc", "kind").distinct().select("doc", "kind", F.lit("fragment").alias("origin"))
    m = table(spark, root, "doc_meta").select("doc", "pdf_file", "page_offset").distinct().select("doc", "page_offset", F.lit("meta").alias("origin"))
    return f.unionByName(m, allowMissingColumns=True)


@C.add("SELECT event_type, min(event_id) AS first FROM events GROUP BY event_type")
def first_seen_types(spark, root):
    """Event types by where they were first seen."""
    return sampling.first_seen(table(spark, root, "events"), "event_type", "event_id")


# ---- arrays, maps, JSON ---------------------------------------------------------------------------------

@C.add("""SELECT frag_id, unnest(CASE WHEN len(coalesce(figures, [])) > 0 THEN figures ELSE [target_file] END) AS item FROM (SELECT DISTINCT frag_id, figures, target_file FROM fragments)""")
def figures_or_file(spark, root):
    """Every figure of a fragment, or its file where it has none."""
    f = table(spark, root, "fragments").select("frag_id", "figures", "target_file").distinct()
    return lookups.explode_or(f, "figures", F.col("target_file"), "item").select("frag_id", "item")


def _nth_use(f: DataFrame, key: str) -> DataFrame:
    """Adds ``nr``, how many times a figure's number was used by then within ``key``, in the order of fragments."""
    d = lagged.placed(f.withColumn("_o", F.struct("frag_id", "i")), [key, "fig"], "_o", F.floor(F.col("frag_id") / (1 << 16)))
    return d.withColumn("nr", F.col("_i") + 1).drop("_o", "_i", "_n")


@C.add("""SELECT doc, count(*) AS n_figures, count(DISTINCT frag_id) AS n_fragments, max(nr)::INT AS most_repeated FROM (
  SELECT doc, frag_id, row_number() OVER (PARTITION BY doc, fig ORDER BY frag_id, i) AS nr FROM (SELECT frag_id, doc, unnest(figures) AS fig, generate_subscripts(figures, 1) AS i FROM (SELECT DISTINCT frag_id, doc, figures FROM fragments))) GROUP BY doc""")
def figure_counts(spark, root):
    """Figures per document, and how often one number is used again."""
    f = table(spark, root, "fragments").select("frag_id", "doc", "figures").distinct().select("doc", "frag_id", F.posexplode("figures").alias("i", "fig"))
    f = _nth_use(f, "doc")
    return f.groupBy("doc").agg(F.count(F.lit(1)).alias("n_figures"), F.countDistinct("frag_id").alias("n_fragments"), F.max("nr").alias("most_repeated"))


@C.add("""SELECT frag_id, fig, 'figure-' || CASE WHEN length(fig) < 2 THEN lpad(fig, 2, '0') ELSE fig END || CASE WHEN nr = 1 THEN '' WHEN nr <= 26 THEN chr(96 + nr::INT)
  WHEN nr <= 702 THEN chr(96 + ((nr - 1) // 26)::INT) || chr(97 + ((nr - 1) % 26)::INT) ELSE error('three letters') END AS name FROM (
  SELECT *, row_number() OVER (PARTITION BY pdf_file, fig ORDER BY frag_id, i) AS nr FROM (SELECT frag_id, pdf_file, unnest(figures) AS fig, generate_subscripts(figures, 1) AS i FROM (SELECT DISTINCT frag_id, pdf_file, figures FROM fragments)))""")
def figure_names(spark, root):
    """Padded figure names; the second of a number gets ``b``, and so on; after ``z`` come ``aa``, ``ab``."""
    f = table(spark, root, "fragments").select("frag_id", "pdf_file", "figures").distinct().select("frag_id", "pdf_file", F.posexplode("figures").alias("i", "fig"))
    f = _nth_use(f, "pdf_file")
    padded = F.when(F.length("fig") < 2, F.lpad("fig", 2, "0")).otherwise(F.col("fig"))
    return f.select("frag_id", "fig", F.concat(F.lit("figure-"), padded, F.when(F.col("nr") > 1, text.letters(F.col("nr"))).otherwise("")).alias("name"))


@C.add("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), 0) AS k FROM events")
def event_properties(spark, root):
    """A number out of JSON text, 0 where there is none."""
    return table(spark, root, "events").select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@C.add("""SELECT map_id, coalesce(json_extract_string(j, '$.doc'), doc) AS doc, f ->> '$.clause' AS clause, coalesce(f ->> '$.kind', '?') AS kind FROM (
  SELECT map_id, doc, raw::JSON AS j, unnest(json_extract(raw::JSON, '$.fragments[*]')) AS f FROM map_raw WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')""")
def map_fragments(spark, root):
    """Fragments out of every readable map file, with the map's document."""
    m = table(spark, root, "map_raw").select("map_id", "doc", drift.parsed(F.col("raw")).alias("v")).where(F.col("v").isNotNull())
    f = F.explode(F.coalesce(F.try_variant_get("v", "$.fragments", "array<struct<clause:string,kind:string>>"), F.array().cast("array<struct<clause:string,kind:string>>")))
    return m.select("map_id", F.coalesce(F.try_variant_get("v", "$.doc", "string"), F.col("doc")).alias("doc"), f.alias("f")).select("map_id", "doc", "f.clause", F.coalesce("f.kind", F.lit("?")).alias("kind"))


@C.add("""WITH RECURSIVE t AS (SELECT n_nationkey AS id, NULL::INT AS parent FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, n_nationkey % 5 + CASE WHEN n_nationkey >= 10 THEN 5 ELSE 0 END FROM nation WHERE n_nationkey >= 5
), walk AS (SELECT id, 1 AS level, id::VARCHAR AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, level + 1, path || '/' || t.id FROM t JOIN walk ON t.parent = walk.id) SELECT id, level, path FROM walk""")
def tree_levels(spark, root):
    """A tree flattened with its true depth (nations as a tree of three levels)."""
    n = table(spark, root, "nation").select(F.col("n_nationkey").alias("id"))
    parent = F.when(F.col("id") >= 5, F.col("id") % 5 + F.when(F.col("id") >= 10, 5).otherwise(0))
    return lookups.flatten_tree(n.withColumn("parent", parent.cast("int")), "id", "parent")


# ---- order-dependent computations over events ----------------------------------------------------------

@C.add("""SELECT event_id, coalesce(last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 'any') AS mode FROM events""")
def event_forward_fill(spark, root):
    """The last marking event type carried forward for each user."""
    from sheaf.operators import pages

    e = table(spark, root, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"), F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type")).alias("hit"))
    day = F.floor(F.unix_micros(F.col("at.ts").cast("timestamp")) / 86_400_000_000)
    return pages.forward_fill(e, "user_id", "at", "hit", "mode", shard=day).select("event_id", "mode")


@C.add("""SELECT key, value, "at" FROM (SELECT user_id AS key, event_type AS value, ts AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1""")
def latest_state(spark, root):
    """Keyed state: the last event of every user."""
    e = table(spark, root, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("ts").alias("at"), "event_id")
    return state.compact(e, "key", "value", "at", "event_id")


# ---- outcomes and rule proposals -----------------------------------------------------------------------

@C.add("""SELECT o_orderstatus, outcome, count(*) AS n FROM (SELECT o_orderstatus, CASE WHEN o_totalprice IS NULL THEN 'dropped' WHEN o_orderpriority LIKE '1%' THEN 'error' WHEN o_orderpriority LIKE '2%' THEN 'dry-run' WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'clean'
  WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderstatus = 'P' THEN 'attention' ELSE 'resolved' END AS outcome FROM orders) GROUP BY ALL""")
def outcome_buckets(spark, root):
    """Outcome buckets in order of priority, over orders."""
    c = F.col
    out = policy.outcome(
        c("o_totalprice").isNull(), F.when(c("o_orderpriority").startswith("1"), "x"), c("o_orderpriority").startswith("2"), (c("o_orderstatus") == "F") & (c("o_totalprice") < 50000),
        (c("o_orderkey") % 3 == 0).cast("int"), (c("o_orderkey") % 5 == 0).cast("int"), F.when(c("o_orderstatus") == "P", F.lit(False)),
    )
    return table(spark, root, "orders").select("o_orderstatus", out.alias("outcome")).groupBy("o_orderstatus", "outcome").agg(F.count(F.lit(1)).alias("n"))


@C.add("""SELECT action, count(*) AS n FROM (SELECT CASE WHEN lower(o_orderstatus) = 'f' THEN 'fix' WHEN o_orderpriority LIKE '5%' THEN 'suppress' ELSE 'fix' END AS action FROM orders) GROUP BY action""")
def proposed_actions(spark, root):
    """Rule actions proposed with their fallbacks, counted."""
    rule = F.when(F.col("o_orderstatus") == "F", "fix")
    triage = F.when(F.col("o_orderpriority").startswith("5"), "mixed").otherwise("unknown")
    return table(spark, root, "orders").select(policy.proposed_action(rule, triage).alias("action")).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


# ---- runs with gaps, positioned words, nested records, frontmatter, figures ------------------------------

NAMED_SQL = f"""WITH {SIMPLE_SQL}, named AS (SELECT DISTINCT pdf_file, unnest(generate_series(lo, hi)) AS p FROM spans
), flagged AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY pdf_file ORDER BY p) - 1 <= 2 THEN 0 ELSE 1 END AS new FROM named
), runs AS (SELECT pdf_file, min(p) AS lo, max(p) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY pdf_file ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM flagged) GROUP BY pdf_file, run HAVING max(p) - min(p) >= 3)"""


def _tolerant(spark, root):
    return intervals.tolerant_runs(_simple(spark, root), ["pdf_file"], "lo", 2, 3, "hi")


@C.add(NAMED_SQL + " SELECT pdf_file, lo, hi FROM runs")
def tolerant_page_runs(spark, root):
    """Runs of named pages joined over gaps of up to two pages, spanning three or more."""
    return _tolerant(spark, root)


@C.add(NAMED_SQL + """, down AS (SELECT *, lag(lo) OVER (PARTITION BY pdf_file ORDER BY lo DESC) AS nxt FROM runs
), ok AS (SELECT *, min(CASE WHEN nxt IS NULL OR (nxt - hi <= 6 AND hi - lo < 40) THEN 1 ELSE 0 END) OVER (PARTITION BY pdf_file ORDER BY lo DESC ROWS UNBOUNDED PRECEDING) AS good FROM down)
SELECT pdf_file, min(lo) AS lo, max(hi) AS hi FROM ok WHERE good = 1 GROUP BY pdf_file""")
def last_block_upwards(spark, root):
    """The last run of every PDF with the close and short runs before it."""
    return intervals.merge_upwards(_tolerant(spark, root), ["pdf_file"], 6, 40)


WORDS_SQL = r"""WITH ls AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS y FROM documents WHERE text <> ''
), words AS (SELECT doc_id, y, unnest(string_split(l, ' ')) AS word, generate_subscripts(string_split(l, ' '), 1) AS x FROM ls)"""


def words(spark, root) -> DataFrame:
    """(doc_id, y, x, word): words of documents with line and place, for lack of positioned ones."""
    d = table(spark, root, "documents").where("text <> ''").select("doc_id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("y", "l"))
    w = d.select("doc_id", (F.col("y") + 1).alias("y"), F.posexplode(F.split("l", " ", -1)).alias("x", "word"))
    return w.withColumn("x", F.col("x") + 1)


@C.add(WORDS_SQL + """ SELECT doc_id, y::INT AS y, x::INT AS x, next_x::INT AS next_x FROM (SELECT *, lead(x) OVER (PARTITION BY doc_id, y ORDER BY x) AS next_x FROM words) WHERE lower(word) IN ('figure', 'fig.', 'bild')""")
def next_word_in_line(spark, root):
    """Words for figure with the place of the next word in their line."""
    w = lookups.nearest_right(words(spark, root), ["doc_id"], "x", "y")
    return w.where(F.lower("word").isin("figure", "fig.", "bild")).select("doc_id", "y", "x", "next_x")


@C.add(WORDS_SQL + """ SELECT doc_id, y::INT AS y, min(x)::INT AS x0, max(x)::INT AS x1, string_agg(word, ' ' ORDER BY x) AS text FROM words WHERE word <> '' GROUP BY doc_id, y""")
def line_boxes(spark, root):
    """Extent and text of every line put together from its words."""
    w = words(spark, root).where("word <> ''")
    b = lookups.line_boxes(w.withColumn("line", F.col("y")), ["doc_id", "line"], "x", "y", "x", "y", "word")
    return b.select("doc_id", F.col("line").alias("y"), "x0", "x1", "text")


@C.add(WORDS_SQL + r""", ln AS (SELECT doc_id, y, list(word ORDER BY x) AS ws FROM words GROUP BY ALL
), heads AS (SELECT doc_id, y, ws, generate_subscripts(ws, 1) AS i FROM ln
), found AS (SELECT doc_id, y, ws, i, regexp_extract(ws[i + 1], '^(\d{1,9})', 1)::INT AS num FROM heads WHERE regexp_matches(ws[i], '(?i)^(?:figure|fig\.?)$') AND i < len(ws) AND regexp_matches(ws[i + 1], '^\d')
), upto AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY doc_id, y ORDER BY i) - 1, len(ws)) AS z FROM found)
SELECT doc_id, num, trim(regexp_replace(array_to_string(ws[i:z], ' '), '\s+', ' ', 'g')) AS text FROM upto""")
def figure_captions(spark, root):
    """Mentions of a figure and its number in positioned words, each up to the next in its line."""
    w = words(spark, root).select("doc_id", (F.col("x") * 10.0).alias("x0"), (F.col("y") * 12.0 + 100).alias("y0"), (F.col("x") * 10.0 + 8).alias("x1"), (F.col("y") * 12.0 + 110).alias("y1"), "word")
    return figures.captions(w, ["doc_id"], 1e9).select("doc_id", "num", "text")


@C.add(r"""WITH ls AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\r?\n')) AS l, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS y FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_extract(l, '^#+ (\d+\.\d+)', 1) AS clause, min(y)::INT AS y FROM ls WHERE regexp_matches(l, '^#+ \d+\.\d+(?:\D|$)') GROUP BY ALL""")
def heading_heights(spark, root):
    """Where the heading of a clause starts in a document."""
    ls = table(spark, root, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("i", "l")).where(F.col("l").rlike(r"^#+ \d+\.\d+"))
    d = ls.select("doc_id", (F.col("i") + 1).alias("y"), F.regexp_replace("l", "^#+ ", "").alias("t"), F.regexp_extract("l", r"^#+ (\d+\.\d+)", 1).alias("clause"))
    return figures.heading_y(d, ["doc_id"], "t", "y", "clause").select("doc_id", "clause", "y")


@C.add("""SELECT pdf_file, to_json({'pdf_file': pdf_file, 'page_offset': coalesce(page_offset, 0), 'clean': coalesce(clean, '')}) AS record FROM (
  SELECT *, row_number() OVER (PARTITION BY pdf_file ORDER BY updated_at DESC, loaded_at DESC) AS rn FROM doc_meta) WHERE rn = 1""")
def nested_meta(spark, root):
    """Metadata of every PDF as one nested record, later deliveries over earlier ones, defaults for what lacks."""
    m = reconcile.last_wins(table(spark, root, "doc_meta"), ["pdf_file"], [F.col("updated_at"), F.col("loaded_at")])
    return m.select("pdf_file", F.to_json(F.struct("pdf_file", F.coalesce("page_offset", F.lit(0)).alias("page_offset"), F.coalesce("clean", F.lit("")).alias("clean"))).alias("record"))


@C.add("""SELECT doc, string_agg(f, ',' ORDER BY f) AS figures FROM (SELECT DISTINCT doc, unnest(figures) AS f FROM fragments) GROUP BY doc""")
def figures_by_document(spark, root):
    """Figure numbers of every document as one list."""
    f = table(spark, root, "fragments").select("doc", F.explode("figures").alias("f")).distinct()
    return f.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list("f")), ",").alias("figures"))


@C.add(r"""SELECT DISTINCT research_id, '---' || chr(10) || coalesce('researcher: "' || replace(replace(researcher, '\', '\\'), '"', '\"') || '"' || chr(10), '') || coalesce('topic: "' || replace(replace(topic, '\', '\\'), '"', '\"') || '"' || chr(10), '')
  || coalesce('tags: [' || array_to_string(list_transform(list_filter(list_transform(string_split(tags, ','), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13) || chr(160))), lambda x: x <> ''),
    lambda x: '"' || replace(replace(replace(replace(replace(x, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"'), ', ') || ']' || chr(10), '')
  || coalesce('dirty: ' || CASE WHEN dirty THEN 'true' WHEN NOT dirty THEN 'false' END || chr(10), '') || '---' || chr(10) AS frontmatter FROM research_doc""")
def emitted_frontmatter(spark, root):
    """Frontmatter written from the columns of all research documents, tags as a plain comma list; tabs and line ends in a tag are escaped."""
    r = table(spark, root, "research_doc").select("research_id", "researcher", "topic", "tags", "dirty").distinct()
    fm = sinks.frontmatter_text(("researcher", F.col("researcher")), ("topic", F.col("topic")), ("tags", (text.csv_values(F.col("tags")), "list")), ("dirty", (F.col("dirty"), "bool")))
    return r.select("research_id", fm.alias("frontmatter"))


@C.add(rf"""WITH f AS (SELECT file, arg_max(raw, (written_at, raw)) AS raw FROM fragment_file WHERE raw IS NOT NULL GROUP BY file
), heads AS (SELECT file, i, unnest(regexp_extract_all(l, '(?i)\bfig(?:ure|\.)?[ \t]*(\d+)', 1))::BIGINT AS num FROM (SELECT file, unnest(string_split(raw, chr(10))) AS l, generate_subscripts(string_split(raw, chr(10)), 1) AS i FROM f) WHERE regexp_matches(l, '^#{{1,6}}[ \t]')
), g AS (SELECT DISTINCT {NORM.format('target_file')} AS file, title, pdf_pages, unnest(figures) AS fig FROM fragments WHERE target_file IS NOT NULL
), figs AS (SELECT DISTINCT file, fig::BIGINT AS num, trim(title) AS caption, coalesce(nullif(regexp_extract(pdf_pages, '(\d{{1,9}})', 1), ''), '?')::VARCHAR AS page, 'figures/figure-' || fig || '.png' AS image FROM g WHERE regexp_matches(fig, '^\d{{1,18}}$') AND title IS NOT NULL
), put AS (SELECT figs.*, raw, EXISTS (SELECT 1 FROM heads h WHERE h.file = figs.file AND h.num = figs.num) AS below, contains(raw, '(' || image || ')') AS there0,
    row_number() OVER (PARTITION BY figs.file, image ORDER BY figs.num, caption, page) AS nr FROM figs JOIN f USING (file)
), done AS (SELECT *, there0 OR (below AND nr > 1) AS there FROM put
), n AS (SELECT file, count(*) FILTER (NOT there AND below) AS n_heading, count(*) FILTER (NOT there AND NOT below) AS n_appended, count(*) FILTER (there) AS n_there,
    coalesce(sum(length(chr(10) || chr(10) || '![' || caption || ' (source p.' || CASE WHEN page = '?' THEN page ELSE (page::INT)::VARCHAR END || ')](' || image || ')' || chr(10))) FILTER (NOT there AND below), 0) AS more_below,
    coalesce(sum(length(chr(10) || '**Figure ' || num || ' — ' || regexp_replace(caption, '(?i)^\s*fig(?:ure|\.)?\s*\d+[:.\s-]*', '') || '** (source p.' || CASE WHEN page = '?' THEN page ELSE (page::INT)::VARCHAR END || ')' || chr(10) || chr(10) || '![Figure ' || num || '](' || image || ')' || chr(10))) FILTER (NOT there AND NOT below), 0) AS more_last FROM done GROUP BY file)
SELECT f.file, coalesce(n_heading, 0) AS n_heading, coalesce(n_appended, 0) AS n_appended, coalesce(n_there, 0) AS n_there,
  (CASE WHEN coalesce(n_appended, 0) > 0 THEN length(rtrim(raw, chr(32) || chr(10) || chr(13) || chr(9))) + length(chr(10) || chr(10) || '## Figures' || chr(10)) ELSE length(raw) END + coalesce(more_below, 0) + coalesce(more_last, 0))::INT AS n_chars FROM f LEFT JOIN n USING (file)""")
def injected_figures(spark, root):
    """Figures of fragments put into their files: how many below a heading, appended, or there before."""
    fl = table(spark, root, "fragment_file").where(F.col("raw").isNotNull()).groupBy("file").agg(F.max_by("raw", F.struct("written_at", "raw")).alias("raw"))
    fr = table(spark, root, "fragments").where(F.col("target_file").isNotNull()).select(normalize_path(F.col("target_file")).alias("file"), "title", "pdf_pages", F.explode("figures").alias("f"))
    fg = fr.where(F.col("f").rlike(r"^\d{1,18}\z")).select("file", F.col("f").cast("long").alias("num"), F.col("title").alias("caption"), F.regexp_extract("pdf_pages", r"(\d{1,9})", 1).try_cast("int").alias("page"), F.concat(F.lit("figures/figure-"), "f", F.lit(".png")).alias("image")).where("caption is not null").distinct()
    return figures.inject_figures(fl, fg).select("file", "n_heading", "n_appended", "n_there", F.length("raw").alias("n_chars"))


# ---- engine extras over the star schema (labelled as such) -----------------------------------------------

@C.add("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def extra_pricing_summary(spark, root):
    """Engine extra: a pricing summary."""
    li = table(spark, root, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count(F.lit(1)).alias("n"))


@C.add("""SELECT n_name, c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_name, c_mktsegment)""")
def extra_cube(spark, root):
    """Engine extra: a cube over a star join."""
    o, c, n = (table(spark, root, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.cube("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


