"""Queries over texts: scalars, page statistics, page runs, headings, frontmatter, messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import frontmatter, text
from sheaf.functions.bind import BLANK
from sheaf.operators import pages, policy, reconcile, validate
from sheaf.plans.catalog import Catalog
from sheaf.sources.tables import table

C = Catalog()
SPACE = text.SPACE
EOL = text.LINE_END

# Documents as pages: 500 consecutive ids of a source are one volume, so a volume stays small however large a source is
# and needs no shards of its own.
VOLUME = 500
PAGES_SQL = f"""WITH pages AS (
  SELECT coalesce(source, '') || '#' || (doc_id // {VOLUME}) AS volume, (doc_id % {VOLUME})::INT AS page, text FROM documents)"""

A_MARKERS, B_MARKERS = (" the ", " and ", " is "), (" le ", " la ", " der ", " die ", " el ")
REDLINE, FINAL = ("Revert", "draft"), ("agreed", "complete")


def page_table(spark: SparkSession, root: str) -> DataFrame:
    """(volume, page, text) of all documents."""
    d = table(spark, root, "documents")
    return d.select(
        F.concat_ws("#", F.coalesce("source", F.lit("")), F.expr(f"doc_id div {VOLUME}")).alias("volume"), (F.col("doc_id") % VOLUME).cast("int").alias("page"), "text"
    )


def _sum_counts(col: str, words) -> str:
    return " + ".join(f"(length({col}) - length(replace({col}, '{w}', ''))) // {len(w)}" for w in words)


CLASSIFIED_SQL = PAGES_SQL + f""", counted AS (
  SELECT volume, page, text, {_sum_counts('text', A_MARKERS)} AS a, {_sum_counts('text', B_MARKERS)} AS b,
    length(text) - length(translate(text, '{text.ACCENTS}', '')) AS accents,
    CASE WHEN {_sum_counts('text', FINAL)} > 0 THEN 'final' WHEN {_sum_counts('text', REDLINE)} > 0 THEN 'redline' END AS version_hit FROM pages
), classified AS (
  SELECT *, CASE WHEN a > b THEN 'a' WHEN b > a THEN 'b' WHEN accents >= 3 THEN 'b' ELSE 'a' END AS lang FROM counted
), filled AS (
  SELECT *, coalesce(last_value(version_hit IGNORE NULLS) OVER (PARTITION BY volume ORDER BY page ROWS UNBOUNDED PRECEDING), 'any') AS version FROM classified
), flagged AS (
  SELECT *, CASE WHEN lag(lang) OVER w IS NOT DISTINCT FROM lang AND lag(version) OVER w IS NOT DISTINCT FROM version AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
  FROM filled WINDOW w AS (PARTITION BY volume ORDER BY page)
), islands AS (SELECT *, sum(new) OVER (PARTITION BY volume ORDER BY page ROWS UNBOUNDED PRECEDING) AS run FROM flagged
), regions AS (SELECT volume, lang, version, min(page) AS "start", max(page) AS "end" FROM islands GROUP BY volume, lang, version, run)"""


def classified(spark: SparkSession, root: str) -> DataFrame:
    p = page_table(spark, root)
    return p.withColumn("_c", text.classify_page(F.col("text"), A_MARKERS, B_MARKERS, REDLINE, FINAL)).select("volume", "page", "text", "_c.*")


def _filled(spark: SparkSession, root: str) -> DataFrame:
    return pages.forward_fill(classified(spark, root), "volume", "page", "version_hit", "version")


def _regions(spark: SparkSession, root: str) -> DataFrame:
    return pages.runs(_filled(spark, root), "volume", "page", ["lang", "version"], width=None)


def _layer_sql(ratio: float, sampled: bool) -> str:
    chosen = (
        """, numbered AS (SELECT *, count(*) OVER (PARTITION BY volume) AS n, row_number() OVER (PARTITION BY volume ORDER BY page) - 1 AS i FROM pages
    ), chosen AS (SELECT volume, page, text FROM numbered WHERE n <= 60 OR i % greatest(1, n // 50) = 0)"""
        if sampled
        else ", chosen AS (SELECT * FROM pages)"
    )
    return PAGES_SQL + chosen + f""", ls AS (
  SELECT volume, page, regexp_replace(unnest(regexp_split_to_array(text, '{EOL}')), '{SPACE}+', '', 'g') AS norm FROM chosen
), n AS (SELECT volume, count(*) AS n FROM chosen GROUP BY volume
), df AS (SELECT volume, norm, count(DISTINCT page) AS df FROM ls WHERE length(norm) >= 8 GROUP BY volume, norm
), marks AS (SELECT volume, norm FROM df JOIN n USING (volume) WHERE n >= 3 AND df >= greatest(3, floor(n * {ratio}))
), kept AS (SELECT volume, page, sum(length(norm)) AS chars FROM ls ANTI JOIN marks USING (volume, norm) GROUP BY volume, page
), each AS (SELECT c.volume, c.page, coalesce(chars, 0) AS chars FROM chosen c LEFT JOIN kept k ON c.volume = k.volume AND c.page = k.page
), stats AS (SELECT volume, count(*) AS pages_sampled, sum((chars > 20)::INT)::BIGINT AS pages_with_text, sum(chars)::BIGINT AS chars_total FROM each GROUP BY volume)
SELECT *, round(pages_with_text / pages_sampled, 4) AS fraction, CASE WHEN pages_with_text / pages_sampled >= 0.85 THEN 'born-digital' WHEN pages_with_text / pages_sampled <= 0.15 THEN 'scanned' ELSE 'mixed' END AS verdict FROM stats"""


@C.add(_layer_sql(0.8, True))
def text_layer_verdict(spark, root):
    """Text layer of every volume's sampled pages without lines repeated on four fifths of them."""
    return pages.text_layer(pages.stride_sample(page_table(spark, root), "volume", "page", width=None), "volume", "page", "text")


@C.add(_layer_sql(0.05, False))
def text_layer_all_pages(spark, root):
    """As above over all pages, with lines on a twentieth of the pages taken for boilerplate."""
    return pages.text_layer(page_table(spark, root), "volume", "page", "text", 0.05)


@C.add(PAGES_SQL + """, t AS (SELECT volume, coalesce(trim(text, E' \\t\\r\\n\\f\\x0b'), '') AS t FROM pages
), r AS (SELECT volume, t, length(t) AS len, count(*) OVER (PARTITION BY volume) AS n, row_number() OVER (PARTITION BY volume ORDER BY length(t)) AS r FROM t)
SELECT volume, max(n) AS n_pages, count(DISTINCT t) AS n_distinct, max(CASE WHEN r = n // 2 + 1 THEN len END) AS median_length,
  max(CASE WHEN r = n // 2 + 1 THEN len END) >= 200 AND (max(n) < 5 OR count(DISTINCT t) > 2) AS usable FROM r GROUP BY volume""")
def usable_text(spark, root):
    """Distinct texts, upper median length and usability of every volume."""
    return pages.usable_text(page_table(spark, root), "volume", "text")


@C.add(CLASSIFIED_SQL + " SELECT volume, page, lang, version_hit, a AS a_markers, b AS b_markers, accents FROM classified")
def page_classification(spark, root):
    """Language by markers and accents, version sentinel of every page."""
    return classified(spark, root).drop("text")


@C.add(CLASSIFIED_SQL + " SELECT volume, page, lang, version FROM filled")
def version_forward_fill(spark, root):
    """The last version sentinel carried forward; the hit itself is not shown."""
    return _filled(spark, root).select("volume", "page", "lang", "version")


@C.add(CLASSIFIED_SQL + ' SELECT volume, lang, version, "start", "end" FROM regions')
def page_regions(spark, root):
    """Runs of pages alike in language and version."""
    return _regions(spark, root)


TARGET_SQL = CLASSIFIED_SQL + """, cand AS (SELECT volume, "start", "end" FROM regions WHERE lang = 'a' AND version IN ('final', 'any')
), reach AS (SELECT *, max("end") OVER (PARTITION BY volume ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cand
), isl AS (SELECT *, sum(CASE WHEN r IS NULL OR "start" > r + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY volume ORDER BY "start" ROWS UNBOUNDED PRECEDING) AS island FROM reach
), spans AS (SELECT volume, island, min("start") AS s, max("end") AS e FROM isl GROUP BY volume, island
), spine AS (SELECT volume, island FROM (SELECT *, row_number() OVER (PARTITION BY volume ORDER BY "end" - "start" DESC, "start") AS rn FROM isl) WHERE rn = 1
), target AS (SELECT volume, s AS "start", e AS "end" FROM spans JOIN spine USING (volume, island))"""


def _target(spark, root):
    return pages.target_region(_regions(spark, root), "volume", "a", "final", width=None)


@C.add(TARGET_SQL + ' SELECT volume, "start", "end" FROM target')
def target_region(spark, root):
    """The longest run in the target language and version, with runs at most 3 pages away."""
    return _target(spark, root)


CANDIDATES = r"[–\-]\s*(\d{1,3})\s*[–\-]"


@C.add(TARGET_SQL + f""", votes AS (SELECT volume, page - printed AS "offset", count(*) AS n
  FROM (SELECT volume, page, unnest(regexp_extract_all(text[1:600], '{CANDIDATES}', 1))::INT AS printed FROM pages) c JOIN target t USING (volume)
  WHERE page BETWEEN "start" AND "end" AND page >= printed GROUP BY ALL)
SELECT volume, max_by("offset", n * 1000000 + "offset") AS "offset", max(n) AS n_votes, sum(n)::BIGINT AS n_anchors FROM votes GROUP BY volume""")
def modal_page_offset(spark, root):
    """The offset between file pages and printed pages that most pages of the target region vote for."""
    p = page_table(spark, root).withColumn("printed", text.printed_candidates(F.col("text")))
    return pages.page_offset(p, "volume", "page", "printed", _target(spark, root))


@C.add(f"""SELECT doc_id, length(regexp_replace(text, '{SPACE}+', '', 'g')) AS n_nonspace,
  array_to_string(regexp_extract_all(text[1:600], '{CANDIDATES}', 1), ',') AS printed,
  array_to_string(regexp_extract_all(text, '\\]\\(([^)\\s#]+\\.md)(?:#[^)]*)?\\)', 1), ' ') AS links,
  len(string_split(text, ',')) - 1 AS n_commas FROM documents""")
def text_scalars(spark, root):
    """Length without white space, printed page numbers, links and literal counts of every document."""
    t = F.col("text")
    return table(spark, root, "documents").select(
        "doc_id", F.length(text.without_space(t)).alias("n_nonspace"),
        F.array_join(F.transform(F.regexp_extract_all(F.substring(t, 1, 600), F.lit(CANDIDATES), 1), lambda x: x), ",").alias("printed"),
        F.array_join(text.markdown_links(t), " ").alias("links"), text.count_literal(t, ",").cast("long").alias("n_commas"),
    )


SLUG_SQL = r"""coalesce(nullif(rtrim(trim(regexp_replace(lower(regexp_replace(regexp_replace({0}, '^\s*Annex\s+[A-Z]+\s*[-–:]?\s*', '', 'i'),
  '^\s*[0-9A-Z]+(?:\.[0-9]+)*\s*[-–:.]?\s*', '')), '[^a-z0-9]+', '-', 'g'), '-')[1:56], '-'), ''), 'section')"""


@C.add(rf"""SELECT DISTINCT clause, title, {SLUG_SQL.format('title')} AS slug, {SLUG_SQL.format("'Annex ' || clause || ' - ' || title")} AS annex_slug,
  nullif(regexp_extract(regexp_replace(trim(clause || ' ' || title), '^\s*Annex\s+', '', 'i'), '^([0-9]+|[A-Z])((?:\.[0-9]+)*)'), '') AS sec FROM fragments""")
def title_functions(spark, root):
    """Slugs and section numbers of all titles."""
    t = F.concat_ws(" ", "clause", "title")
    return table(spark, root, "fragments").select("clause", "title").distinct().select(
        "clause", "title", text.title_slug(F.col("title")).alias("slug"),
        text.title_slug(F.concat(F.lit("Annex "), F.col("clause"), F.lit(" - "), F.col("title"))).alias("annex_slug"),
        F.when(F.col("clause").isNotNull() & F.col("title").isNotNull(), F.array_join(text.section_number(t), ".")).alias("sec"),
    )


HEADS_SQL = f"""heads AS (SELECT doc_id, i - 1 AS pos, regexp_extract(l, '^#{{1,6}}\\s+(.+)$', 1) AS h FROM (
  SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '{EOL}') AS ls FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(l, '^#{{1,6}}\\s+.+$')
), slugged AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(replace(h, '`', ''))), '<[^>]+>', '', 'g'),
    '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS base FROM heads
), anchors AS (SELECT doc_id, pos, CASE WHEN n = 0 THEN base ELSE base || '-' || n END AS anchor FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) - 1 AS n FROM slugged))"""


@C.add(f"WITH {HEADS_SQL} SELECT doc_id, pos::INT AS pos, anchor FROM anchors")
def heading_anchors(spark, root):
    """Anchors of all headings, with suffixes for repeated ones."""
    return reconcile.heading_anchors(table(spark, root, "documents"), "doc_id", "text")


# These files name clauses in prose, not by anchors: the clauses a folder's files name are held against the numbers its headings begin with.
LINKED = r"clause (\d+(?:\.\d+)*)"


@C.add(f"""WITH linked AS (SELECT DISTINCT split_part(file, '/', 1) AS folder, unnest(regexp_extract_all(raw, '{LINKED}', 1)) AS anchor FROM fragment_file
), heads AS (SELECT split_part(file, '/', 1) AS folder, unnest(regexp_extract_all(raw, '(?m)^#{{1,6}}[ \\t]+(\\d+(?:\\.\\d+)*)[ \\t]', 1)) AS anchor FROM fragment_file)
SELECT folder, anchor FROM linked ANTI JOIN heads USING (folder, anchor)""")
def dangling_anchors(spark, root):
    """Clauses named in the files of a folder that no heading of the folder's files answers."""
    d = table(spark, root, "fragment_file").select(F.split_part("file", F.lit("/"), F.lit(1)).alias("folder"), F.col("raw").alias("text")).where("raw is not null").distinct()
    numbers = validate.headings(d, "folder", "text").select("folder", F.regexp_extract("title", r"^(\d+(?:\.\d+)*)\s", 1).alias("anchor")).distinct()
    return reconcile.dangling_anchors(d, "folder", "text", lambda t: F.regexp_extract_all(t, F.lit(LINKED), 1), numbers)


@C.add(r"""SELECT DISTINCT t AS message, regexp_replace(regexp_replace(t, '''[^'']*''', '''…''', 'g'), '\b\d+\b', '#', 'g') AS template FROM (
  SELECT unnest(regexp_extract_all(text, 'warning: ([^\n]*)', 1)) AS t FROM documents) WHERE t <> ''""")
def message_templates(spark, root):
    """Templates of the warnings in all lines of all documents."""
    return table(spark, root, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"warning: ([^\n]*)"), 1)).alias("message")).where("message <> ''").distinct().select("message", text.message_template(F.col("message")).alias("template"))


# Problems: every line of a document that carries a number, its source as the file.
PROBLEMS_SQL = f"""problems AS (SELECT doc_id, i AS line, source AS file, l AS message, CASE WHEN contains(l, '`') THEN 'WARNING' WHEN contains(l, '0x') THEN 'ERROR' ELSE 'INFO' END AS severity FROM (
  SELECT doc_id, source, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, source, regexp_split_to_array(text, '{EOL}') AS ls FROM documents WHERE text IS NOT NULL))
  WHERE regexp_matches(l, '[0-9]'))"""
TEMPLATE_SQL = r"regexp_replace(regexp_replace(message, '''[^'']*''', '''…''', 'g'), '\b\d+\b', '#', 'g')"


def problems(spark, root) -> DataFrame:
    """(seen, file, message, severity); ``seen`` is the place (doc_id, line), by which they are ordered."""
    d = table(spark, root, "documents").where(F.col("text").isNotNull())
    d = d.select("doc_id", F.col("source").alias("file"), F.posexplode(text.lines(F.col("text"))).alias("i", "message"))
    sev = F.when(F.contains("message", F.lit("`")), "WARNING").when(F.contains("message", F.lit("0x")), "ERROR").otherwise("INFO")
    return d.where(F.col("message").rlike("[0-9]")).select(F.struct("doc_id", (F.col("i") + 1).alias("line")).alias("seen"), "file", "message", sev.alias("severity"))


@C.add(rf"""WITH {PROBLEMS_SQL} SELECT {TEMPLATE_SQL} AS template, count(*) AS n, count(DISTINCT file) AS n_files, arg_min(severity, (doc_id, line)) AS severity,
  min(doc_id) AS doc_id, (min((doc_id, line)))[2]::INT AS line, array_to_string(list_slice(list(message ORDER BY doc_id, line), 1, 5), chr(10)) AS examples,
  '^' || replace(replace(regexp_replace({TEMPLATE_SQL}, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), '''…''', '''[^'']*'''), '#', '\d+') || '$' AS pattern FROM problems GROUP BY template""")
def message_types(spark, root):
    """Message types with counts, files, first severity and place, the first five examples and their pattern; the most frequent first."""
    t = policy.message_types(problems(spark, root), "message", "file", "severity", "seen", 5)
    return t.select("template", "n", "n_files", "severity", "first_seen.doc_id", "first_seen.line", F.array_join("examples", "\n").alias("examples"), "pattern")


@C.add(f"""WITH {PROBLEMS_SQL} SELECT template, doc_id, line::INT AS line, file, message, severity FROM (SELECT *, {TEMPLATE_SQL} AS template, row_number() OVER (PARTITION BY {TEMPLATE_SQL} ORDER BY doc_id, line) AS rn FROM problems) WHERE rn <= 5""")
def message_examples(spark, root):
    """The first five examples of each message type."""
    return policy.first_examples(problems(spark, root), "message", "seen", 5).select("template", "seen.*", "file", "message", "severity")


RULES = [
    {"description": r"0x[0-9A-F]+", "severity": "error", "action": "fix", "reason": "hexadecimal code"},
    {"description": "(unclosed", "action": "ignore", "reason": "never matches"},
    {"paths": ["reviews/*", "**/lagoon"], "action": "ignore", "reason": "reviews are read by people"},
    {"description": r"\bclause \d", "action": "suppress", "reason": "clause reference"},
    {"severity": "WARNING", "action": "whatever"},
]
ROUTED_SQL = rf"""{PROBLEMS_SQL}, matched AS (SELECT *, CASE WHEN regexp_matches(message, '0x[0-9A-F]+') AND severity = 'ERROR' THEN 0
  WHEN regexp_matches(file, '^(.*)?reviews/[^/]*$') OR regexp_matches(file, '^.*lagoon$') THEN 2
  WHEN regexp_matches(message, '\bclause \d') THEN 3 WHEN severity = 'WARNING' THEN 4 END AS rule_idx FROM problems
), routed AS (SELECT *, CASE WHEN severity NOT IN ('ERROR', 'WARNING') THEN 'outOfScope' WHEN rule_idx = 2 THEN 'ignored' ELSE 'actionable' END AS bucket FROM matched
), pinned AS (SELECT *, CASE WHEN bucket = 'actionable' THEN CASE rule_idx WHEN 0 THEN 'fix' WHEN 3 THEN 'suppress' ELSE 'auto' END END AS pinned_action,
  CASE WHEN bucket <> 'outOfScope' THEN CASE rule_idx WHEN 0 THEN 'hexadecimal code' WHEN 2 THEN 'reviews are read by people' WHEN 3 THEN 'clause reference' ELSE '' END END AS policy_reason FROM routed)"""


ROUTED_ALL_SQL = ROUTED_SQL.replace("severity NOT IN ('ERROR', 'WARNING')", "severity IS NULL")


def _routed(spark, root, floor=("error", "WARNING")):
    default, rules = policy.policy({"default": "nonsense", "rules": RULES})
    return policy.route(policy.first_match(problems(spark, root), rules, "message", "severity", "file"), rules, default, "severity", floor)


@C.add(f"WITH {ROUTED_SQL} SELECT doc_id, line::INT AS line, file, severity, rule_idx::INT AS rule_idx, bucket, pinned_action, policy_reason FROM pinned")
def policy_routing(spark, root):
    """Every problem with the first rule that matches it, its bucket and pinned action."""
    return _routed(spark, root).select("seen.*", "file", "severity", "rule_idx", "bucket", "pinned_action", "policy_reason")


@C.add(rf"""WITH {ROUTED_ALL_SQL}, t AS (SELECT *, {TEMPLATE_SQL} AS template FROM pinned WHERE bucket = 'actionable'
), f AS (SELECT template, file, min((doc_id, line)) AS first FROM t GROUP BY ALL)
SELECT template, count(*) AS occurrences, count(DISTINCT file) AS n_files, arg_min(message, (doc_id, line)) AS example,
  (SELECT array_to_string(list_slice(list(f.file ORDER BY f.first), 1, 10), ' ') FROM f WHERE f.template = t.template AND f.file IS NOT NULL) AS files,
  '^' || replace(replace(regexp_replace(template, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g'), '''…''', '''[^'']*'''), '#', '\d+') || '$' AS pattern
FROM t GROUP BY template HAVING count(DISTINCT file) >= 3""")
def recurring_messages(spark, root):
    """Types of actionable messages of any severity found in three files or more, with the first example and the first ten files; the most widespread first."""
    t = policy.recurring(_routed(spark, root, ("ALL",)).where("bucket = 'actionable'"), "message", "file", "seen")
    return t.withColumn("files", F.array_join("files", " "))


@C.add(f"WITH {ROUTED_SQL} SELECT bucket, pinned_action, count(*) AS n, count(DISTINCT file) AS n_files FROM pinned GROUP BY ALL")
def policy_counts(spark, root):
    """Problems by bucket and action."""
    return _routed(spark, root).groupBy("bucket", "pinned_action").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("n_files"))


LS = f"regexp_split_to_array(regexp_replace(raw, '(?:{EOL})$', ''), '{EOL}')"
FM_SQL = f"""WITH r AS (SELECT DISTINCT file, written_at, raw FROM fragment_file WHERE raw IS NOT NULL
), ls AS (SELECT file, written_at, raw, {LS} AS ls FROM r
), lines AS (SELECT file, written_at, raw, ls[1] AS opening, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM ls
), ends AS (SELECT file, written_at, min(CASE WHEN i > 1 AND trim(l) = '---' THEN i END) AS e FROM lines GROUP BY ALL
), pairs AS (SELECT file, written_at, opening, starts_with(raw, '---') AS starts, e, i, trim(l[1:strpos(l, ':') - 1]) AS key, trim(l[strpos(l, ':') + 1:]) AS v
  FROM lines JOIN ends USING (file, written_at) WHERE i > 1 AND (e IS NULL OR i < e) AND contains(l, ':')
), fields AS (SELECT file, written_at, opening, starts, key, arg_max(CASE WHEN length(v) >= 2 AND v[1] = v[-1] AND v[1] IN ('"', '''') THEN v[2:-2] ELSE v END, i) AS value FROM pairs GROUP BY ALL)"""


def _raw_files(spark, root):
    return table(spark, root, "fragment_file").where(F.col("raw").isNotNull()).select("file", "written_at", "raw").distinct()


@C.add(FM_SQL + " SELECT file, written_at, key, value FROM fields WHERE opening = '---'")
def frontmatter_lenient(spark, root):
    """Frontmatter of every file by the lenient grammar; the last of a repeated key counts."""
    return _raw_files(spark, root).select("file", "written_at", F.explode(frontmatter.lenient(F.col("raw"))))


@C.add(FM_SQL + """ SELECT r.file, r.written_at, CASE WHEN NOT starts_with(raw, '---') THEN 'no start' WHEN e IS NULL THEN 'not closed' END AS err,
  coalesce((SELECT string_agg(key, ',' ORDER BY key) FROM fields f WHERE f.file = r.file AND f.written_at = r.written_at AND f.starts), '') AS keys,
  array_to_string(list_filter(['source', 'clause', 'title', 'pdf_pages'], k -> k NOT IN (SELECT key FROM fields f WHERE f.file = r.file AND f.written_at = r.written_at AND f.starts AND value <> '')), ',') AS missing
FROM r JOIN ends USING (file, written_at)""".replace("array_to_string(list_filter(['source', 'clause', 'title', 'pdf_pages'], k -> k NOT IN (SELECT key FROM fields f WHERE f.file = r.file AND f.written_at = r.written_at AND f.starts AND value <> '')), ',')",
  "coalesce((SELECT string_agg(k, ',' ORDER BY p) FROM (VALUES (1, 'source'), (2, 'clause'), (3, 'title'), (4, 'pdf_pages')) q(p, k) WHERE k NOT IN (SELECT key FROM fields f WHERE f.file = r.file AND f.written_at = r.written_at AND f.starts AND value <> '')), '')"))
def frontmatter_checked(spark, root):
    """Error, keys and missing required fields of every file by the checked grammar."""
    d = _raw_files(spark, root).withColumn("_f", frontmatter.checked(F.col("raw")))
    f = F.col("_f.fields")
    need = [(n, F.try_element_at(f, F.lit(n))) for n in ("source", "clause", "title", "pdf_pages")]
    return d.select("file", "written_at", F.col("_f.err").alias("err"), F.array_join(F.array_sort(F.map_keys(f)), ",").alias("keys"), reconcile.missing_fields(*need).alias("missing"))


# A strict scalar in SQL: empty, bool, string, array or error.
KIND_SQL = r"""CASE WHEN {0} = '' THEN 'empty' WHEN {0} IN ('true', 'false') THEN 'bool' WHEN regexp_matches({0}, '^(?:"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*'')$') THEN 'string'
  WHEN regexp_matches({0}, '^\[\s*(?:(?:"[^"\\]*"|''[^''\\]*''|-?\d+)\s*(?:,\s*(?:"[^"\\]*"|''[^''\\]*''|-?\d+)\s*)*,?\s*)?\]$') THEN 'array'
  WHEN regexp_matches({0}, '^["''\[]') OR regexp_matches({0}, ':\s') OR regexp_matches({0}, '^[{{|>&*!]') THEN 'error' ELSE 'string' END"""
BLANKS = "'" + BLANK + "'"


def lines_sql(c: str) -> str:
    """Lines of a text in SQL."""
    return f"CASE WHEN {c} = '' THEN [] ELSE regexp_split_to_array(regexp_replace({c}, '(?:{EOL})$', ''), '{EOL}') END"



def _strict_sql(docs: str) -> str:
    """CTEs ``d`` (k, raw, ls, starts, e) and ``p`` (k, line, name, v, kind, nth) of the frontmatter of ``docs`` (k, raw)."""
    return f"""docs AS ({docs}), cut AS (SELECT k, raw, {lines_sql('raw')} AS ls, starts_with(raw, '---' || chr(10)) AS starts FROM docs WHERE raw IS NOT NULL
), d AS (SELECT *, CASE WHEN starts THEN coalesce(list_position(ls[2:], '---'), 0) ELSE 0 END AS e FROM cut
), block AS (SELECT k, unnest(ls[2:e]) AS l, generate_subscripts(ls[2:e], 1) + 1 AS line FROM d WHERE e > 0
), named AS (SELECT k, line, nullif(regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_-]*):\\s*(.*)$', 1), '') AS name, regexp_extract(l, '^([A-Za-z_][A-Za-z0-9_-]*):\\s*(.*)$', 2) AS value
  FROM block WHERE trim(l, {BLANKS}) <> '' AND NOT starts_with(ltrim(l), '#')
), p AS (SELECT *, trim(value, {BLANKS}) AS v, {KIND_SQL.format(f"trim(value, {BLANKS})")} AS kind, row_number() OVER (PARTITION BY k, name ORDER BY line) AS nth FROM named)"""


def _headings_sql(ls: str) -> str:
    """CTE ``hd`` (k, level, title, line) of the headings outside fences of ``ls`` (k, ls)."""
    return f"""l0 AS ({ls}), l1 AS (SELECT k, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM l0
), marks AS (SELECT k, i, left(ltrim(l), 3) AS m, row_number() OVER (PARTITION BY k ORDER BY i) AS nr FROM l1 WHERE left(ltrim(l), 3) IN ('```', '~~~')
), fences AS (SELECT k, nr, i, m AS open FROM marks WHERE nr = 1
  UNION ALL SELECT m.k, m.nr, m.i, CASE WHEN f.open IS NULL THEN m.m WHEN f.open <> m.m THEN f.open END FROM fences f JOIN marks m ON m.k = f.k AND m.nr = f.nr + 1
), hd AS (SELECT k, length(regexp_extract(l, '^(#{{1,6}})\\s+(.+?)\\s*$', 1)) AS level, regexp_extract(l, '^(#{{1,6}})\\s+(.+?)\\s*$', 2) AS title, i::INT AS line FROM l1
  WHERE regexp_matches(l, '^(#{{1,6}})\\s+(.+?)\\s*$') AND (SELECT arg_max(open, f.i) FILTER (true) FROM fences f WHERE f.k = l1.k AND f.i < l1.i AND f.i = (SELECT max(g.i) FROM fences g WHERE g.k = l1.k AND g.i < l1.i)) IS NULL)"""


@C.add("WITH " + _strict_sql("SELECT DISTINCT {'file': file, 'written_at': written_at} AS k, raw FROM fragment_file") + """ SELECT k.file AS file, k.written_at AS written_at, line::INT AS line, name, CASE WHEN name IS NULL THEN '' ELSE value END AS value, CASE WHEN name IS NOT NULL THEN kind END AS kind,
  CASE WHEN name IS NULL THEN 'malformed' WHEN nth > 1 THEN 'duplicate' WHEN kind = 'error' THEN 'scalar' END AS err FROM p""")
def frontmatter_strict(spark, root):
    """Every frontmatter line by the strict grammar, with duplicate and malformed ones marked."""
    d = _raw_files(spark, root).select(F.struct("file", "written_at").alias("k"), "raw")
    return frontmatter.strict(d, "k", "raw").select("k.*", "line", "name", "value", "kind", "err")


@C.add(rf"""SELECT doc_id, nullif(trim(regexp_extract(text, '(?m)^\*\*Status:\*\*\s*(\S.*?)\s*$', 1), '` '), '') AS status, nullif(trim(regexp_extract(text, '(?m)^\*\*Owner:\*\*\s*(\S.*?)\s*$', 1), '` '), '') AS owner,
  contains(text, '<!--') OR contains(text, '-->') AS has_comment, regexp_matches(text, '(?i)\b(?:TBD|TODO)\b') AS has_marker, contains(text, '…') AS has_ellipsis,
  len(list_filter(regexp_extract_all(text, '\[([^\]\n]+)\]', 1), lambda v: len(list_filter([{", ".join(repr(h) for h in text.HINTS)}], lambda h: contains(lower(v), h))) > 0))::INT AS n_hints FROM documents""")
def labels_and_placeholders(spark, root):
    """Labelled values and leftovers of templates in every document."""
    t = F.col("text")
    found = text.placeholders(t)
    return table(spark, root, "documents").select(
        "doc_id", text.label_value(t, "Status").alias("status"), text.label_value(t, "Owner").alias("owner"),
        F.array_contains(found, "comment").alias("has_comment"), F.array_contains(found, "marker").alias("has_marker"), F.array_contains(found, "ellipsis").alias("has_ellipsis"),
        F.size(F.filter(found, lambda x: x.startswith("["))).alias("n_hints"),
    )


@C.add("WITH RECURSIVE " + _headings_sql(f"SELECT doc_id AS k, {lines_sql('text')} AS ls FROM documents WHERE text IS NOT NULL") + " SELECT k AS doc_id, level::INT AS level, title, line FROM hd")
def document_headings(spark, root):
    """Headings of every document outside fenced code."""
    return validate.headings(table(spark, root, "documents"), "doc_id", "text")


SECTIONS_SQL = r"""s AS (SELECT k, unnest(hs) AS h, unnest(bs[2:]) AS body, generate_subscripts(hs, 1) - 1 AS pos FROM (SELECT k, regexp_extract_all(t, '(?m)^## (.+)$', 1) AS hs, regexp_split_to_array(t, '(?m)^## .+$') AS bs FROM docs)
), secs AS (SELECT k, pos, trim(h, {blanks}) AS heading, body FROM s)""".replace("{blanks}", BLANKS)


@C.add(f"WITH docs AS (SELECT doc_id AS k, text AS t FROM documents WHERE text IS NOT NULL), {SECTIONS_SQL} SELECT k AS doc_id, pos::INT AS pos, heading, length(body) AS body_length FROM secs")
def section_bodies(spark, root):
    """Second-level sections with the length of their bodies."""
    return validate.sections(table(spark, root, "documents"), "doc_id", "text").select("doc_id", "pos", "heading", F.length("body").alias("body_length"))


def _research_sql() -> str:
    unquoted = "CASE WHEN length(v) >= 2 AND v[1] = v[-1] AND v[1] IN ('\"', '''') THEN v[2:-2] ELSE v END"
    fields = ", ".join(f"'{n}'" for n in ("date", "researcher", "topic", "tags", "status", "last_updated", "last_updated_by"))
    texts = ", ".join(f"'{n}'" for n in ("date", "researcher", "repository", "git_commit", "branch", "topic", "status", "last_updated", "last_updated_by", "last_updated_note"))
    iso = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{3,6})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
    docs = "SELECT doc_id AS k, text AS raw FROM documents WHERE kind = 'research'"
    return f"""WITH RECURSIVE {_strict_sql(docs)}, body AS (SELECT k, raw, starts, e, CASE WHEN NOT starts THEN ls WHEN e > 0 THEN ls[(e + 2):] ELSE [] END AS b FROM d
), {_headings_sql('SELECT k, b AS ls FROM body')}, m AS (SELECT k, name, v, kind, {unquoted} AS u FROM p WHERE name IS NOT NULL AND nth = 1 AND kind <> 'error'
), h1 AS (SELECT k, (SELECT count(*) FROM hd WHERE hd.k = body.k AND level = 1) AS n FROM body
), c AS (SELECT k, list_filter(list_transform(b, lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS c, lower(array_to_string(b, chr(10))) AS low FROM body
), c1 AS (SELECT *, coalesce(list_position(list_transform(c, lambda x: starts_with(x, '# ')), true), 0) AS top FROM c
), c2 AS (SELECT *, c[(top + 1):] AS after FROM c1), c3 AS (SELECT *, coalesce(list_position(list_transform(after, lambda x: starts_with(x, '## ')), true), 0) AS stop FROM c2
), t AS (SELECT k, kind, list_filter(list_transform(string_split(regexp_replace(v, '^\\[|\\]$', '', 'g'), ','), lambda x: trim(x, {BLANKS})), lambda x: x <> '') AS tags FROM m WHERE name = 'tags'
), tg AS (SELECT k, kind = 'array' AND len(tags) > 0 AND len(list_filter(tags, lambda x: regexp_matches(x, '^(?:"[^"]*\\S[^"]*"|''[^'']*\\S[^'']*'')$'))) = len(tags) AS good, len(list_filter(tags, lambda x: x IN ('"research"', '''research'''))) AS n FROM t
), lack AS (SELECT d.k, list(n ORDER BY n) AS l FROM d, unnest(['branch', 'dirty', 'git_commit', 'repository']) AS f(n) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = d.k AND m.name = n) GROUP BY d.k)
SELECT k AS doc_id, 'error' AS severity, 'start' AS "check", '' AS detail FROM d WHERE NOT starts
UNION ALL SELECT k, 'error', 'not closed', '' FROM d WHERE starts AND e = 0
UNION ALL SELECT DISTINCT k, 'error', 'malformed line', '' FROM p WHERE name IS NULL
UNION ALL SELECT DISTINCT k, 'error', 'duplicate key', '' FROM p WHERE name IS NOT NULL AND nth > 1
UNION ALL SELECT DISTINCT k, 'error', 'malformed value', '' FROM p WHERE name IS NOT NULL AND nth = 1 AND kind = 'error'
UNION ALL SELECT k, 'error', 'missing field', n FROM d, unnest([{fields}]) AS f(n) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = d.k AND m.name = n)
UNION ALL SELECT k, 'error', 'not a string', name FROM m WHERE name IN ({texts}) AND kind NOT IN ('string', 'empty')
UNION ALL SELECT k, 'error', 'empty field', name FROM m WHERE name IN ({texts}) AND name IN ({fields}) AND kind IN ('string', 'empty') AND trim(u, {BLANKS}) = ''
UNION ALL SELECT k, 'error', 'not ISO 8601', name FROM m WHERE name IN ('date', 'last_updated') AND kind IN ('string', 'empty') AND NOT (regexp_matches(u, '{iso}') AND try_cast(u[1:10] AS DATE) IS NOT NULL
  AND coalesce(try_cast(u[12:13] AS INT), 0) < 24 AND coalesce(try_cast(u[15:16] AS INT), 0) < 60)
UNION ALL SELECT k, 'error', 'unknown status', u FROM m WHERE name = 'status' AND kind IN ('string', 'empty') AND u NOT IN ('draft', 'in-progress', 'complete')
UNION ALL SELECT k, 'error', 'bad tags', '' FROM tg WHERE NOT good UNION ALL SELECT k, 'warning', 'no research tag', '' FROM tg WHERE good AND n = 0
UNION ALL SELECT k, 'error', 'dirty is no bool', '' FROM m WHERE name = 'dirty' AND kind <> 'bool'
UNION ALL SELECT k, 'error', 'repository incomplete', array_to_string(l, ', ') FROM lack WHERE len(l) BETWEEN 1 AND 3
UNION ALL SELECT k, 'error', 'titles', n::VARCHAR FROM h1 WHERE n <> 1
UNION ALL SELECT k, 'warning', 'title not first', '' FROM c WHERE len(c) > 0 AND NOT starts_with(c[1], '# ')
UNION ALL SELECT k, 'warning', 'no summary', '' FROM c3 JOIN h1 USING (k) WHERE n > 0 AND top > 0 AND len(list_filter(CASE WHEN stop > 0 THEN after[1:(stop - 1)] ELSE after END, lambda x: NOT starts_with(x, '#') AND NOT starts_with(x, '<!--'))) = 0
UNION ALL SELECT k, 'warning', 'no open questions', '' FROM c WHERE NOT contains(low, 'open question') AND NOT contains(low, 'unresolved')
UNION ALL SELECT k, 'warning', 'no final line end', '' FROM d WHERE raw <> '' AND right(raw, 1) <> chr(10)"""


@C.add(_research_sql())
def research_violations(spark, root):
    """Violations of the research-document rules, over the documents of kind research."""
    return validate.research_document(table(spark, root, "documents").where("kind = 'research'").select("doc_id", "text"), "doc_id", "text")


def _plan_sql() -> str:
    label = lambda t, n: rf"nullif(trim(trim(regexp_extract({t}, '(?m)^\*\*{n}:\*\*\s*(\S.*?)\s*$', 1), {BLANKS}), '`'), '')"
    hints = ", ".join(f"'{h}'" for h in text.HINTS)
    metadata = " UNION ALL ".join(f"SELECT k, 'error', 'missing metadata', '{n}' FROM docs WHERE {label('t', n)} IS NULL" for n in ("Plan ID", "Status", "Parent manifest", "Grounded against", "Re-ground before"))
    per = " ".join(f"UNION ALL SELECT k, 'error', 'package without {n.lower()}', 'WP' || n FROM wp WHERE {label('body', n)} IS NULL" for n in ("Depends on", "Done when", "Checkpoint"))
    per += " " + " ".join(rf"UNION ALL SELECT k, 'error', 'package without {n.lower()}', 'WP' || n FROM wp WHERE NOT regexp_matches(body, '(?m)^### {n}\s*$')" for n in ("Tests", "Verification", "Implementation Notes"))
    decl = r"(?m)^\*\*(?:File|New file|Destination|Artifact):\*\*\s*.+$"
    return rf"""WITH docs AS (SELECT doc_id AS k, text AS t FROM documents WHERE kind = 'plans' AND text IS NOT NULL), {SECTIONS_SQL}
, x AS (SELECT k, t, {label('t', 'Status')} AS status, {label('t', 'Re-ground before')} AS reground, (SELECT arg_max(body, pos) FROM secs WHERE secs.k = docs.k AND heading = 'Open Decisions') AS decisions,
  (SELECT arg_max(body, pos) FROM secs WHERE secs.k = docs.k AND heading = 'File Inventory') AS inventory, (SELECT arg_max(body, pos) FROM secs WHERE secs.k = docs.k AND heading = 'Progress') AS progress,
  (SELECT count(*) FROM secs WHERE secs.k = docs.k AND regexp_matches(heading, '^Work Package (\d+):\s+.+')) AS n_wp FROM docs
), wp AS (SELECT k, pos, regexp_extract(heading, '^Work Package (\d+):\s+.+', 1) AS n, body, {label('body', 'ID')} AS id FROM secs WHERE regexp_matches(heading, '^Work Package (\d+):\s+.+')
), dl AS (SELECT k, unnest(regexp_extract_all(t, '{decl}')) AS l FROM docs), dp AS (SELECT k, regexp_extract(l, '^\*\*([^:]+):', 1) AS kind, unnest(regexp_extract_all(l, '`([^`]+)`', 1)) AS path, generate_subscripts(regexp_extract_all(l, '`([^`]+)`', 1), 1) AS i FROM dl
), rows_ AS (SELECT k, len(list_filter({lines_sql('decisions')}, lambda r: starts_with(r, '|') AND NOT contains(r, 'Decision') AND NOT regexp_matches(r, '^\|[\s|:-]+\|$'))) AS n FROM x WHERE decisions IS NOT NULL
), boxes AS (SELECT k, list_filter({lines_sql('progress')}, lambda r: regexp_matches(r, '^\s*- \[[ xX]\]')) AS b FROM x WHERE progress IS NOT NULL
), subs AS (SELECT k, pos, n, unnest(regexp_extract_all(body, '(?m)^### (.+)$', 1)) AS h, unnest(regexp_split_to_array(body, '(?m)^### .+$')[2:]) AS b FROM wp
), sub AS (SELECT k, pos, n, b FROM subs WHERE regexp_matches(trim(h, {BLANKS}), '^\d+\.\d+\s+') AND starts_with(trim(h, {BLANKS}), n || '.'))
SELECT k AS doc_id, severity, "check", detail FROM ({metadata.replace("SELECT k, 'error', 'missing metadata', 'Plan ID'", "SELECT k, 'error' AS severity, 'missing metadata' AS " + '"check"' + ", 'Plan ID' AS detail", 1)}
UNION ALL SELECT k, 'error', 'unknown status', status FROM x WHERE status NOT IN ('Ready', 'Conditional', 'Draft')
UNION ALL SELECT k, 'error', 'ready with open decisions', '' FROM x WHERE status = 'Ready' AND decisions IS NOT NULL
UNION ALL SELECT k, 'error', 'no open decisions', '' FROM x WHERE status IN ('Conditional', 'Draft') AND decisions IS NULL
UNION ALL SELECT k, 'error', 'no decision row', '' FROM x JOIN rows_ USING (k) WHERE status IN ('Conditional', 'Draft') AND n = 0
UNION ALL SELECT k, 'error', 'no trigger', '' FROM x WHERE status = 'Conditional' AND lower(reground) = 'none'
UNION ALL SELECT k, 'error', 'no packages', '' FROM x WHERE n_wp = 0
UNION ALL SELECT k, 'error', 'package ids repeat', '' FROM wp GROUP BY k HAVING count(id) <> count(DISTINCT id)
UNION ALL SELECT k, 'error', 'no inventory', '' FROM x WHERE n_wp > 1 AND inventory IS NULL
UNION ALL SELECT DISTINCT k, 'error', 'destination in ready plan', '' FROM x JOIN dp USING (k) WHERE status = 'Ready' AND kind = 'Destination'
UNION ALL SELECT k, 'error', 'not in inventory', string_agg(path, ', ') FROM x JOIN dp USING (k) WHERE inventory IS NOT NULL AND NOT contains(inventory, path) GROUP BY k
UNION ALL SELECT k, 'error', 'progress boxes', len(b)::VARCHAR FROM x JOIN boxes USING (k) WHERE len(b) <> n_wp
UNION ALL SELECT k, 'error', 'indented boxes', '' FROM boxes WHERE len(list_filter(b, lambda r: regexp_matches(r, '^[ \t]'))) > 0
UNION ALL SELECT k, 'error', 'placeholder', 'comment' FROM docs WHERE contains(t, '<!--') OR contains(t, '-->')
UNION ALL SELECT k, 'error', 'placeholder', 'marker' FROM docs WHERE regexp_matches(t, '(?i)\b(?:TBD|TODO)\b')
UNION ALL SELECT k, 'error', 'placeholder', 'ellipsis' FROM docs WHERE contains(t, '…')
UNION ALL SELECT k, 'error', 'placeholder', '[' || v || ']' FROM (SELECT k, unnest(regexp_extract_all(t, '\[([^\]\n]+)\]', 1)) AS v FROM docs) WHERE len(list_filter([{hints}], lambda h: contains(lower(v), h))) > 0
UNION ALL SELECT k, 'error', 'package without id', 'WP' || n FROM wp WHERE id IS NULL UNION ALL SELECT k, 'error', 'wrong package id', id FROM wp WHERE id <> 'WP' || n {per}
UNION ALL SELECT k, 'error', 'package without subtasks', 'WP' || n FROM wp WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.k = wp.k AND sub.pos = wp.pos)
UNION ALL SELECT DISTINCT k, 'error', 'subtask without declaration', 'WP' || n FROM sub WHERE NOT regexp_matches(b, '(?m)^\*\*(?:File|New file|Destination|Artifact):\*\*\s*.*`[^`]+`'))"""


@C.add(_plan_sql())
def plan_violations(spark, root):
    """Violations of the plan rules, over documents of kind plans."""
    d = table(spark, root, "documents").where("kind = 'plans'")
    return validate.plan_document(d, "doc_id", "text")
