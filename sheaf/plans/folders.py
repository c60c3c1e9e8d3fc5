"""Queries over files in folders: what sinks write is read back by the file sources. Folders lie below the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.operators import drift, policy, reconcile, validate
from sheaf.plans import texts
from sheaf.plans.catalog import Catalog
from sheaf.session import checkpoint_dir
from sheaf.sources import files, sinks
from sheaf.sources.tables import table

C = Catalog()


def folder(spark: SparkSession) -> str:
    """A new folder that all executors have mounted."""
    at = checkpoint_dir(spark)
    if ":" in at.split("/")[0] and not at.startswith("file:"):
        raise RuntimeError("files are written through the file system: give a mounted spark.checkpoint.dir")
    return "/" + at.removeprefix("file:").lstrip("/") + f"/files-{uuid.uuid4().hex}"


LAST_SQL = "last AS (SELECT file, arg_max(raw, (written_at, raw)) AS raw FROM fragment_file WHERE raw IS NOT NULL AND regexp_matches(file, '^[^/]+/[^/]+\\.md$') GROUP BY file)"


def last_files(spark, root) -> DataFrame:
    """(file, raw) as last written."""
    f = table(spark, root, "fragment_file").where(F.col("raw").isNotNull() & F.col("file").rlike(r"^[^/]+/[^/]+\.md\z"))
    return f.groupBy("file").agg(F.max_by("raw", F.struct("written_at", "raw")).alias("raw"))


@C.add(f"""WITH {LAST_SQL}, docs AS (SELECT DISTINCT split_part(file, '/', 1) AS doc FROM last)
SELECT 'manifest' AS rule, file, length(raw) AS n_chars FROM last UNION ALL SELECT 'manifest', doc || '/ReadMe-first.md', 6 FROM docs UNION ALL SELECT 'disk', file, length(raw) FROM last""")
def markdown_folder(spark, root):
    """Markdown files of a folder by the two rules for what is left out: maps and ``README.md``, or maps and every readme."""
    f, at = last_files(spark, root), folder(spark)
    docs = f.select(F.split_part("file", F.lit("/"), F.lit(1)).alias("doc")).distinct()
    names = F.explode(F.array(F.lit("README.md"), F.lit("ReadMe-first.md"), F.lit("notes.txt"))).alias("name")
    more = docs.select("doc", names).select(F.concat_ws("/", "doc", "name").alias("file"), F.lit("readme").alias("raw"))
    maps = docs.select(F.concat(F.lit("_maps/"), "doc", F.lit(".md")).alias("file"), F.lit("map").alias("raw"))
    sinks.write_texts(f.unionByName(more).unionByName(maps), at)
    read = lambda rule, any_readme: files.read_markdown(spark, at, any_readme).select(F.lit(rule).alias("rule"), "file", F.length("raw").alias("n_chars"))
    return read("manifest", False).unionByName(read("disk", True))


@C.add("""SELECT map_id, pos::INT AS pos, coalesce(nullif(j ->> '$.doc', ''), map_id::VARCHAR) AS doc, f ->> '$.clause' AS clause, f ->> '$.kind' AS kind FROM (
  SELECT map_id, j, unnest(json_extract(j, '$.fragments[*]')) AS f, generate_subscripts(json_extract(j, '$.fragments[*]'), 1) - 1 AS pos FROM (SELECT map_id, raw::JSON AS j FROM map_raw WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')) WHERE json_type(f) = 'OBJECT'""")
def map_folder(spark, root):
    """Fragments of all map files of a folder but the index of all, the map's document over their own; an unreadable file fails the read."""
    at = folder(spark)
    m = table(spark, root, "map_raw").where(drift.parsed(F.col("raw")).isNotNull()).select(F.concat(F.col("map_id").cast("string"), F.lit(".json")).alias("file"), "raw")
    sinks.write_texts(m, at)
    sinks.write_object({"doc": "index of all", "fragments": [{"clause": "0", "kind": "no"}]}, f"{at}/_all.json")
    d = files.read_json_objects(spark, at, "doc string, pdf_file string, fragments array<struct<clause:string,kind:string>>")
    return files.merge_maps(d).select(F.regexp_extract("file", r"^(\d+)", 1).cast("long").alias("map_id"), "pos", "doc", "clause", "kind")


NATURAL_SQL = r"list_transform(regexp_extract_all(clause, '\d+|\D+'), lambda t: CASE WHEN regexp_matches(t, '^\d') THEN '0' || lpad(t, 20, '0') ELSE '1' || t END)"


@C.add(f"""SELECT (row_number() OVER (ORDER BY doc NULLS FIRST, {NATURAL_SQL} NULLS FIRST, clause NULLS FIRST, title NULLS FIRST, file NULLS FIRST, manifest_id) - 1)::INT AS place, doc, clause, title, file, manifest_id FROM manifest""")
def manifest_file(spark, root):
    """The manifest as one sorted JSON array, read back with the place of each entry."""
    path = folder(spark) + "/manifest.json"
    m = table(spark, root, "manifest").select("doc", "clause", "title", "file", "manifest_id")
    sinks.write_manifest(m, path)
    e = files.read_entries(spark, path).select(F.col("place").cast("int"), F.from_json("entry", "doc string, clause string, title string, file string, manifest_id bigint", {"mode": "FAILFAST"}).alias("e"))
    return e.select("place", "e.*")


@C.add("""SELECT 'docMeta' AS part, doc AS key, page_offset::VARCHAR AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY updated_at DESC NULLS LAST, loaded_at DESC NULLS LAST, pdf_file DESC NULLS LAST) AS rn FROM doc_meta WHERE doc IS NOT NULL) WHERE rn = 1
UNION ALL SELECT 'byClause', by_clause, target_file FROM (SELECT *, row_number() OVER (PARTITION BY by_clause ORDER BY built_at DESC NULLS LAST, entry_id DESC) AS rn FROM link_index WHERE by_clause IS NOT NULL) WHERE rn = 1
UNION ALL SELECT DISTINCT 'fragments', frag_id::VARCHAR, target_file FROM fragments""")
def index_file(spark, root):
    """Metadata, links and fragments as one nested JSON object, replaced as a whole, read back part by part."""
    path = folder(spark) + "/maps/index.json"
    meta = reconcile.last_wins(table(spark, root, "doc_meta").where("doc is not null"), ["doc"], [F.col("updated_at"), F.col("loaded_at"), F.col("pdf_file")]).select("doc", "page_offset", "clean")
    links = reconcile.last_wins(table(spark, root, "link_index").where("by_clause is not null"), ["by_clause"], [F.col("built_at"), F.col("entry_id")]).select(F.col("by_clause").alias("key"), F.col("target_file").alias("file"))
    fragments = table(spark, root, "fragments").select("frag_id", "target_file").distinct()
    sinks.write_index(meta, links, fragments, path)
    part = lambda name, shape, *within: files.read_entries(spark, path, *within).select(F.lit(name).alias("part"), F.from_json("entry", shape, {"mode": "FAILFAST"}).alias("_e"))
    field = lambda d: d.select("part", F.explode(F.map_entries("_e")).alias("_e"))
    return (
        field(part("docMeta", "map<string,struct<page_offset:string,clean:string>>", "docMeta")).select("part", "_e.key", F.col("_e.value.page_offset").alias("value"))
        .unionByName(field(part("byClause", "map<string,string>", "linkIndex", "byClause")).select("part", "_e.key", "_e.value"))
        .unionByName(part("fragments", "frag_id string, target_file string", "fragments").select("part", F.col("_e.frag_id").alias("key"), F.col("_e.target_file").alias("value")))
    )


@C.add(f"""WITH v AS ({texts.C.sql['research_violations']}), n AS (SELECT "check", severity, count(*) AS n FROM v GROUP BY ALL)
SELECT "check", max(n) AS n, bool_or(severity = 'error') AS hard, 1 AS exit_code FROM n GROUP BY "check" """)
def report_checks(spark, root):
    """The report over all research documents: counts by check, hard ones marked, and the exit code."""
    report, code = sinks.report(validate.research_document(table(spark, root, "documents").where("kind = 'research'").select("doc_id", "text"), "doc_id", "text"))
    rows = [(c, n, c in report["hard_failures"], code) for c, n in report["checks"].items()]
    return spark.createDataFrame(rows, "check string, n bigint, hard boolean, exit_code int")


@C.add("SELECT probe_id, pages, size_bytes FROM probe")
def tool_page_counts(spark, root):
    """Pages and size out of what a command-line tool prints, ``Key: value`` by line; nothing where it prints none."""
    line = lambda k, c: F.coalesce(F.concat(F.lit(f"{k}:   "), F.col(c).cast("string"), F.lit("\n")), F.lit(""))
    printed = F.concat(F.lit("Title: a: b\nTagged\n"), line("Pages", "pages"), line("File size", "size_bytes"), F.lit("Pages: 0\n"))
    p = table(spark, root, "probe").select("probe_id", "pages", files.key_value_lines(F.when(F.col("pages").isNull(), F.replace(printed, F.lit("Pages: 0\n"), F.lit(""))).otherwise(printed)).alias("m"))
    return p.select("probe_id", F.try_element_at("m", F.lit("Pages")).try_cast("int").alias("pages"), F.try_element_at("m", F.lit("File size")).try_cast("long").alias("size_bytes"))


@C.add("""WITH good AS (SELECT map_id, len(json_keys(raw)) AS n, raw ->> '$.doc' AS doc FROM map_raw WHERE json_valid(raw) AND json_type(raw) = 'OBJECT')
SELECT m.map_id, coalesce(n, 0)::INT AS n_arguments, g.doc FROM map_raw m LEFT JOIN good g USING (map_id)""")
def argument_objects(spark, root):
    """Arguments that come as JSON text: an object, or none where it cannot be read."""
    a = table(spark, root, "map_raw").select("map_id", files.argument_map(F.col("raw")).alias("a"))
    return a.select("map_id", F.size("a").alias("n_arguments"), F.try_variant_get(F.try_element_at("a", F.lit("doc")), "$", "string").alias("doc"))


@C.add("""SELECT split_part(file, '/', 1) AS doc, count(*) AS n FROM (SELECT DISTINCT file, written_at, n_lines FROM fragment_file) WHERE n_lines > 300 AND regexp_matches(file, '^(?:harbornet|knot|teal)[^/]*/') GROUP BY ALL""")
def configured_files(spark, root):
    """Long files by folder, families and length set by defaults, a file's values and repeated flags, in this order."""
    conf = files.layered_config({"families": [], "above": 600, "unused": 1}, {"above": 300, "families": ["heron"]}, {"families": ["harbornet, knot", " teal ,"], "unused": None})
    f = table(spark, root, "fragment_file").select("file", "written_at", "n_lines").distinct().where(F.col("n_lines") > conf["above"])
    family = F.regexp_extract("file", r"^([a-z]+)[^/]*/", 1)
    return f.where(family.isin(*conf["families"])).groupBy(F.split_part("file", F.lit("/"), F.lit(1)).alias("doc")).agg(F.count(F.lit(1)).alias("n"))


@C.add(rf"""WITH {texts.PROBLEMS_SQL}, m AS (SELECT *, CASE WHEN regexp_matches(message, '\bclause \d') THEN 0 WHEN regexp_matches(file, '^(.*)?reviews/[^/]*$') THEN 1 END AS rule_idx FROM problems)
SELECT CASE WHEN rule_idx IS NULL THEN 'actionable' ELSE 'ignored' END AS bucket, CASE WHEN rule_idx IS NULL THEN 'auto' END AS pinned_action, CASE rule_idx WHEN 0 THEN 'clauses are known' ELSE '' END AS policy_reason, count(*) AS n FROM m GROUP BY ALL""")
def whitelisted_messages(spark, root):
    """Problems routed by an old whitelist, whose entries become rules that ignore; all else is left to the default."""
    default, rules = policy.policy(None, [{"description": r"\bclause \d", "reason": "clauses are known"}, {"paths": ["reviews/*"]}])
    r = policy.route(policy.first_match(texts.problems(spark, root), rules, "message", "severity", "file"), rules, default, "severity")
    return r.groupBy("bucket", "pinned_action", "policy_reason").agg(F.count(F.lit(1)).alias("n"))


@C.add("""SELECT DISTINCT frag_id, regexp_replace(trim(title), '(?i)^\\s*fig(?:ure|\\.)?\\s*\\d+[:.\\s-]*', '') AS plain, regexp_replace(trim('Fig. ' || frag_id || ': ' || title), '(?i)^\\s*fig(?:ure|\\.)?\\s*\\d+[:.\\s-]*', '') AS captioned,
  CASE WHEN est_pages > 1 THEN frag_id || '-' || (frag_id + est_pages - 1) ELSE frag_id::VARCHAR END AS pages FROM fragments WHERE title IS NOT NULL AND est_pages IS NOT NULL""")
def caption_texts(spark, root):
    """Titles and captions without a leading figure number, and page spans as text."""
    from sheaf.operators.figures import caption_text

    f = table(spark, root, "fragments").where("title is not null and est_pages is not null")
    caption = F.concat(F.lit("Fig. "), F.col("frag_id").cast("string"), F.lit(": "), "title")
    return f.select("frag_id", caption_text(F.col("title")).alias("plain"), caption_text(caption).alias("captioned"), text.pages_text(F.col("frag_id"), F.col("frag_id") + F.col("est_pages") - 1).alias("pages")).distinct()

