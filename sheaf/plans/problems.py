"""Queries of the general training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.pages import page_spans, target_spans
from sheaf.functions.paths import base_name, normalize_path
from sheaf.operators import drift, intervals, orphans, packed
from sheaf.session import written
from sheaf.sources.tables import table


def _revisions(spark: SparkSession, root: str, schema: drift.TargetSchema = drift.MAP_SCHEMA) -> DataFrame:
    return drift.ingest(table(spark, root, "map_raw"), ["map_file", "rev"], "raw", "map_id", schema)


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Every change of fields between a readable revision of a map file and the one before it, read off the ingested table."""
    return drift.changes(written(_revisions(spark, root)), ["map_file"], "rev")


def _row_columns(schema: drift.TargetSchema) -> list:
    return [F.col("target_range.first").alias("target_first"), F.col("target_range.last").alias("target_last"), *[p.name for p in schema.pieces if p.name != "target_range"]]


def p1_rows(spark: SparkSession, root: str) -> DataFrame:
    """One consistent row per readable revision, what is unknown or uncastable rescued as JSON."""
    return drift.rows(_revisions(spark, root), ["map_file", "rev"]).select("map_file", "rev", *_row_columns(drift.MAP_SCHEMA), "rescued")


def p1_replayed(spark: SparkSession, root: str) -> DataFrame:
    """``language`` approved after ingestion: promoted out of the rescued JSON, without the source."""
    d = drift.rows(_revisions(spark, root), ["map_file", "rev"])
    return drift.replay(d, drift.Piece("language", ("language",), "text")).select("map_file", "rev", "language", "rescued")


def p1_approved(spark: SparkSession, root: str) -> DataFrame:
    """The table again under a schema read from a table of approved names, in which ``language`` is approved from the start."""
    names = drift.MAP_SCHEMA.promote(drift.Piece("language", ("language",), "text")).table(spark)
    schema = drift.TargetSchema.approved(names)
    return drift.rows(_revisions(spark, root, schema), ["map_file", "rev"], schema).select("map_file", "rev", *_row_columns(schema), "rescued")


def p1_report(spark: SparkSession, root: str) -> DataFrame:
    """How often each field changed in each way, and in how many files."""
    return p1_found(spark, root).groupBy("field_name", "change_kind").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("map_file").alias("n_files"))


#: Arrival times that part the history into the batches of the state.
BATCHES = ("2024-08-15", "2025-03-01")
MORE_BATCHES = ("2024-09-01", "2024-12-01", "2025-03-01", "2025-06-01", "2025-09-01")


def _arrivals(spark: SparkSession, root: str, bounds: tuple[str, ...]) -> DataFrame:
    """Events of all tables with the batch ``b`` they arrive in, written once; files arrive as they are written and deleted."""
    path = lambda c: normalize_path(F.col(c))
    batch = lambda c: sum((F.coalesce(F.col(c) >= F.lit(b).cast("timestamp"), F.lit(False)).cast("int") for b in bounds), F.lit(0)).alias("b")

    def referring(name: str, row_id: str, file: str, at: str) -> DataFrame:
        d = table(spark, root, name)
        return orphans.references(d.withColumn("_b", batch("loaded_at")), name, row_id, path(file), at, "_b").withColumnRenamed("_b", "b")

    files = orphans.parents(table(spark, root, "fragment_file"), path("file"), "written_at", "deleted_at")
    log = files.select("*", batch("at"))
    for given in (("link_index", "entry_id", "target_file", "built_at"), ("fragments", "frag_id", "target_file", "reported_at"), ("manifest", "manifest_id", "file", "built_at")):
        log = log.unionByName(referring(*given))
    return written(log, "b")


def _orphan_state(spark: SparkSession, root: str, bounds: tuple[str, ...]) -> orphans.OrphanState:
    """The state after all batches in the order of arrival, written between them; each is a large part of the history."""
    log, state = _arrivals(spark, root, bounds), None
    for b in range(len(bounds) + 1):
        new = log.where(F.col("b") == b).drop("b")
        if state is None:
            state = orphans.OrphanState.empty(new)
        else:
            state = orphans.OrphanState(state.index, written(state.states)).advance(new, few=0)
    return state


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references of the three tables: a snapshot of the keyed state after all arrivals."""
    return _orphan_state(spark, root, BATCHES).open_orphans().select("tbl", "row_id", "state")


def p2_by_month(spark: SparkSession, root: str) -> DataFrame:
    """Orphans per table and month of the reference, out of the same state."""
    return _orphan_state(spark, root, BATCHES).snapshot()


def p2_incremental(spark: SparkSession, root: str) -> DataFrame:
    """As ``p2_found``, with twice as many batches: the result does not depend on them."""
    return _orphan_state(spark, root, MORE_BATCHES).open_orphans().select("tbl", "row_id", "state")


def pdf_pages(spark: SparkSession, root: str) -> DataFrame:
    """(pdf_file, last_page): the most pages any probe of a PDF counted; base names are PDF names."""
    return (
        table(spark, root, "probe").select(base_name(F.col("pdf")).alias("pdf_file"), "pages").where(F.col("pages").isNotNull())
        .groupBy("pdf_file").agg(F.max("pages").alias("last_page"))
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Covered periods and gaps in the target pages of every PDF."""
    lists = table(spark, root, "fragments").where(F.col("pdf_file").isNotNull() & F.col("pdf_pages").isNotNull()).select("pdf_file", "pdf_pages")
    closed = lists.select("pdf_file", F.inline(page_spans(F.col("pdf_pages")))).where(F.col("hi").isNotNull())
    # Only lists with the word can have an open end; no other is read apart a second time.
    ending = lists.where(F.lower("pdf_pages").contains("end")).select("pdf_file", F.inline(page_spans(F.col("pdf_pages"))))
    opened = ending.where(F.col("hi").isNull()).distinct().join(pdf_pages(spark, root), "pdf_file", "left")
    opened = opened.select("pdf_file", "lo", F.coalesce(F.greatest("lo", "last_page"), "lo").alias("hi"))
    aims = (
        table(spark, root, "doc_meta").where(F.col("pdf_file").isNotNull())
        .select("pdf_file", F.inline(target_spans(F.col("target_pages")))).distinct()
        .join(pdf_pages(spark, root), "pdf_file", "left")
        .select("pdf_file", "lo", F.coalesce("hi", F.greatest("lo", "last_page"), "lo").alias("hi"))
    )
    out = intervals.periods_and_gaps(closed.unionByName(opened), aims, ["pdf_file"])
    return out.select("pdf_file", "span_kind", F.col("lo").cast("int").alias("page_from"), F.col("hi").cast("int").alias("page_to"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Every value of page lists and tag fields that hold two or more, with its position."""
    pages = packed.unpack_pages(table(spark, root, "fragments"), "frag_id", "pdf_pages", 2).withColumn("tbl", F.lit("fragments"))
    tags = packed.unpack_tags(table(spark, root, "research_doc"), "research_id", "tags", 2).withColumn("tbl", F.lit("research_doc"))
    return pages.unionByName(tags).select("tbl", "row_id", "pos", "item")


QUERIES = {f.__name__: f for f in (p1_found, p1_rows, p1_replayed, p1_approved, p1_report, p2_found, p2_by_month, p2_incremental, p4_found, p5_found)}

# ---- the same in SQL --------------------------------------------------------------------------

# Fixed values, written out again so that the SQL does not depend on the operator's own list.
_NAMES = """(VALUES ('page_offset', 1, 'printed_to_pdf_offset'), ('page_offset', 2, 'printedToPdfOffset'), ('page_offset', 3, 'offset'), ('page_offset', 4, 'pdf_offset'), ('page_offset', 5, 'page_shift'),
  ('structure_notes', 1, 'structure_notes'), ('structure_notes', 2, 'structureNotes'), ('structure_notes', 3, 'clean_notes'), ('structure_notes', 4, 'cleanNotes'), ('structure_notes', 5, 'clean'),
  ('target_range', 1, 'target_pdf_range'), ('target_range', 2, 'targetPdfRange'), ('target_range', 3, 'target_pages'), ('target_range', 4, 'body_range'),
  ('page_count', 1, 'total_pdf_pages'), ('page_count', 2, 'totalPages'), ('page_count', 3, 'pages'),
  ('pdf_name', 1, 'pdf_file'), ('pdf_name', 2, 'pdfFile'), ('pdf_name', 3, 'pdf_path'){more}) AS names(piece, place, name)"""
_CONCEPTS = f"(SELECT piece FROM {_NAMES.format(more='')} WHERE name = k)"
_P1 = f"""WITH r AS (SELECT map_file, rev, arg_min(raw, map_id) AS raw FROM map_raw WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY ALL
), o AS (SELECT map_file, rev, lag(rev) OVER (PARTITION BY map_file ORDER BY rev) AS before FROM r
), f AS (SELECT map_file, rev, k, CASE json_type(json_extract(raw, '$."' || k || '"')) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t
  FROM (SELECT map_file, rev, raw, unnest(json_keys(raw)) AS k FROM r)
), n AS (SELECT o.map_file, o.rev, k, t FROM o JOIN f USING (map_file, rev) WHERE before IS NOT NULL
), b AS (SELECT o.map_file, o.rev, k, t FROM o JOIN f ON f.map_file = o.map_file AND f.rev = before
), c AS (SELECT *, {_CONCEPTS} AS piece FROM n ANTI JOIN b USING (map_file, rev, k)
), w AS (SELECT *, {_CONCEPTS} AS piece FROM b ANTI JOIN n USING (map_file, rev, k)
), cr AS (SELECT *, row_number() OVER (PARTITION BY map_file, rev, piece ORDER BY k) AS i FROM c), wr AS (SELECT *, row_number() OVER (PARTITION BY map_file, rev, piece ORDER BY k) AS i FROM w
), m AS (SELECT cr.map_file, cr.rev, cr.k, wr.k AS old, cr.t, wr.t AS old_t FROM cr JOIN wr USING (map_file, rev, piece, i)
), found AS (SELECT map_file, rev, k AS field_name, 'renamed' AS change_kind FROM m
  UNION ALL SELECT map_file, rev, k, 'retyped' FROM m WHERE t <> old_t
  UNION ALL SELECT map_file, rev, k, 'added' FROM c WHERE (map_file, rev, k) NOT IN (SELECT (map_file, rev, k) FROM m)
  UNION ALL SELECT map_file, rev, k, 'removed' FROM w WHERE (map_file, rev, k) NOT IN (SELECT (map_file, rev, old) FROM m)
  UNION ALL SELECT n.map_file, n.rev, n.k, 'retyped' FROM n JOIN b USING (map_file, rev, k) WHERE n.t <> b.t)"""


def _rows_sql(more: str, extra: str) -> str:
    """The consistent table in SQL; ``more`` approves further names of text pieces."""
    text = """CASE t WHEN 'string' THEN v ->> '$' WHEN 'array' THEN array_to_string(v ->> '$[*]', ' ') WHEN 'object' THEN nullif(concat_ws(' ', v ->> '$.keep', v ->> '$.skip'), '') END"""
    return rf"""WITH r AS (SELECT map_file, rev, arg_min(raw, map_id) AS raw FROM map_raw WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' GROUP BY ALL
), f AS (SELECT map_file, rev, k, v, CASE json_type(v) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END AS t
  FROM (SELECT map_file, rev, k, json_extract(raw, '$."' || k || '"') AS v FROM (SELECT map_file, rev, raw, unnest(json_keys(raw)) AS k FROM r))
), named AS (SELECT f.*, piece, place, v ->> '$' AS s FROM f JOIN {_NAMES.format(more=more)} ON name = k
), cast_ AS (SELECT *, CASE WHEN piece IN ('page_offset', 'page_count') THEN CASE t WHEN 'number' THEN try_cast(s AS INT) WHEN 'object' THEN try_cast(v ->> '$.value' AS INT)
    WHEN 'string' THEN CASE WHEN regexp_matches(s, '(?i)^\s*printed\s*=\s*pdf\s*-') THEN try_cast(regexp_extract(s, '-\s*(\d{{1,9}})', 1) AS INT) ELSE try_cast(ltrim(regexp_extract(regexp_replace(s, '([+-])\s+(\d)', '\1\2', 'g'), '([+-]?\d{{1,9}})', 1), '+') AS INT) END END::VARCHAR
  WHEN piece = 'pdf_name' THEN CASE t WHEN 'string' THEN s WHEN 'object' THEN v ->> '$.name' END
  WHEN piece = 'target_range' THEN CASE t WHEN 'array' THEN try_cast(v ->> '$[0]' AS INT) || ' ' || try_cast(v ->> '$[1]' AS INT) WHEN 'object' THEN try_cast(v ->> '$.first' AS INT) || ' ' || try_cast(v ->> '$.last' AS INT)
    WHEN 'string' THEN nullif(regexp_extract(s, '(\d{{1,9}})', 1), '') || ' ' || nullif(regexp_extract(s, '\d+\D+(\d{{1,9}})', 1), '') END
  ELSE {text} END AS c FROM named
), taken AS (SELECT map_file, rev, piece, arg_min(k, place) AS k, arg_min(c, place) AS c FROM cast_ WHERE c IS NOT NULL GROUP BY ALL
), left_ AS (SELECT map_file, rev, '{{' || string_agg('"' || k || '":' || CASE WHEN t = 'object' THEN '{{' || array_to_string(list_transform(list_sort(json_keys(v)), lambda x: '"' || x || '":' || json_extract(v, '$."' || x || '"')::VARCHAR), ',') || '}}' WHEN t = 'number' AND contains(v::VARCHAR, '.') THEN regexp_replace(v::VARCHAR, '\.?0+$', '') ELSE v::VARCHAR END, ',' ORDER BY k) || '}}' AS rescued FROM f ANTI JOIN taken USING (map_file, rev, k) GROUP BY ALL
), wide AS (SELECT map_file, rev, max(c) FILTER (piece = 'page_offset')::INT AS page_offset, max(c) FILTER (piece = 'structure_notes') AS structure_notes, max(c) FILTER (piece = 'target_range') AS tr,
  max(c) FILTER (piece = 'page_count')::INT AS page_count, max(c) FILTER (piece = 'pdf_name') AS pdf_name{extra} FROM taken GROUP BY ALL)
SELECT r.map_file, r.rev, page_offset, structure_notes, split_part(tr, ' ', 1)::INT AS target_first, split_part(tr, ' ', 2)::INT AS target_last, page_count, pdf_name{', language' if extra else ''}, coalesce(rescued, '{{}}') AS rescued
FROM r LEFT JOIN wide ON r.map_file = wide.map_file AND r.rev = wide.rev LEFT JOIN left_ ON r.map_file = left_.map_file AND r.rev = left_.rev"""


_LANGUAGE = _rows_sql(", ('language', 1, 'language')", ", max(c) FILTER (piece = 'language') AS language")
_NORM = r"""regexp_replace(regexp_replace(regexp_replace(trim(replace(split_part({0}, '#', 1), '\', '/'), E' \t\r\n'), '/+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '(^|/)[^/.][^/]*/\.\./', '\1')"""
_P2 = f"""WITH f AS (SELECT DISTINCT {_NORM.format('file')} AS path, written_at, deleted_at FROM fragment_file
), refs AS (SELECT 'link_index' AS tbl, entry_id AS row_id, {_NORM.format('target_file')} AS path, built_at AS t FROM link_index WHERE target_file IS NOT NULL
  UNION ALL SELECT DISTINCT 'fragments', frag_id, {_NORM.format('target_file')}, reported_at FROM fragments WHERE target_file IS NOT NULL
  UNION ALL SELECT 'manifest', manifest_id, {_NORM.format('file')}, built_at FROM manifest WHERE file IS NOT NULL
), states AS (SELECT tbl, row_id, t, CASE WHEN count(written_at) = 0 THEN 'missing' WHEN min(written_at) > t THEN 'late'
  WHEN count(*) FILTER (written_at <= t AND (deleted_at IS NULL OR t < deleted_at)) = 0 THEN 'deleted' END AS state FROM refs LEFT JOIN f USING (path) GROUP BY tbl, row_id, t)"""
_ITEM = r"(\d+)(?:\s*(?:-|–|—|−|\.\.|to)\s*(\d+|end))?"


def _pages_sql(text: str) -> str:
    """Spans (lo, hi) of a page list in SQL, an open end reaching to ``last_page``."""
    return f"""(SELECT *, regexp_extract(m, '^(\\d+)', 1)::INT AS a, regexp_extract(m, '(\\d+|end)$', 1) AS z FROM (SELECT *, unnest(regexp_extract_all({text}, '{_ITEM}')) AS m FROM {{0}}))"""


_P4 = f"""WITH last AS (SELECT regexp_extract(pdf, '([^/]*)$', 1) AS pdf_file, max(pages) AS last_page FROM probe GROUP BY ALL
), fr AS (SELECT DISTINCT pdf_file, pdf_pages, last_page FROM fragments LEFT JOIN last USING (pdf_file) WHERE pdf_file IS NOT NULL
), dm AS (SELECT DISTINCT pdf_file, regexp_replace(target_pages, '\\[\\s*(\\d+)\\s*,\\s*(\\d+)\\s*\\]', '\\1-\\2', 'g') AS target_pages, last_page FROM doc_meta LEFT JOIN last USING (pdf_file) WHERE pdf_file IS NOT NULL
), cs AS (SELECT pdf_file, a, CASE WHEN z = 'end' THEN greatest(a, coalesce(last_page, a)) ELSE z::INT END AS z FROM {_pages_sql('pdf_pages').format('fr')}
), ts AS (SELECT pdf_file, a, CASE WHEN z = 'end' THEN greatest(a, coalesce(last_page, a)) ELSE z::INT END AS z FROM {_pages_sql('target_pages').format('dm')}
), cover AS (SELECT DISTINCT pdf_file, unnest(generate_series(least(a, z), greatest(a, z))) AS p FROM cs
), given AS (SELECT DISTINCT pdf_file, unnest(generate_series(least(a, z), greatest(a, z))) AS p FROM ts
), own AS (SELECT pdf_file, unnest(generate_series(min(p), max(p))) AS p FROM cover WHERE pdf_file NOT IN (SELECT pdf_file FROM given) GROUP BY pdf_file
), free AS (SELECT * FROM (SELECT * FROM given UNION ALL SELECT * FROM own) ANTI JOIN cover USING (pdf_file, p)
), every AS (SELECT pdf_file, 'period' AS span_kind, p FROM cover UNION ALL SELECT pdf_file, 'gap', p FROM free
), g AS (SELECT *, p - row_number() OVER (PARTITION BY pdf_file, span_kind ORDER BY p) AS i FROM every)
SELECT pdf_file, span_kind, min(p)::INT AS page_from, max(p)::INT AS page_to FROM g GROUP BY pdf_file, span_kind, i"""

SQL: dict[str, str] = {
    "p1_found": _P1 + " SELECT * FROM found",
    "p1_report": _P1 + " SELECT field_name, change_kind, count(*) AS n_changes, count(DISTINCT map_file) AS n_files FROM found GROUP BY ALL",
    "p1_rows": _rows_sql("", ""),
    "p1_approved": _LANGUAGE,
    "p1_replayed": f"SELECT map_file, rev, language, rescued FROM ({_LANGUAGE})",
    "p2_found": _P2 + " SELECT tbl, row_id, state FROM states WHERE state IS NOT NULL",
    "p2_by_month": _P2 + """ SELECT tbl, strftime(t, '%Y-%m') AS month, count(*) AS n_references, count(*) FILTER (state = 'missing') AS n_missing,
      count(*) FILTER (state = 'late') AS n_late, count(*) FILTER (state = 'deleted') AS n_deleted FROM states GROUP BY ALL""",
    "p2_incremental": _P2 + " SELECT tbl, row_id, state FROM states WHERE state IS NOT NULL",
    "p4_found": _P4,
}
