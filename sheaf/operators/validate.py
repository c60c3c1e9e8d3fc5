"""Structure of Markdown documents: headings, sections, and rule sets that report violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text as T
from sheaf.functions.bind import let, strip

_HEADING = r"^(#{1,6})\s+(.+?)\s*\z"


def headings_of(ls: Column) -> Column:
    """array<struct(level, title, line)> of a line array, outside fences; line numbers from 1.

    A fence closes with its own kind of marker only. The fold runs over marker and heading lines,
    not over all lines.
    """
    marked = F.filter(
        F.transform(ls, lambda l, i: F.struct((i + 1).alias("line"), l.alias("text"), F.ltrim(l).alias("left"))),
        lambda x: x["left"].startswith("```") | x["left"].startswith("~~~") | x["text"].rlike(_HEADING),
    )
    start = F.struct(F.lit(None).cast("string").alias("fence"), F.array().cast("array<struct<level:int,title:string,line:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        mark = F.left(x["left"], F.lit(3))
        is_mark = mark.isin("```", "~~~")
        fence = F.when(is_mark, F.when(acc["fence"].isNull(), mark).when(acc["fence"] != mark, acc["fence"])).otherwise(acc["fence"])
        head = F.struct(
            F.length(F.regexp_extract(x["text"], _HEADING, 1)).alias("level"), F.regexp_extract(x["text"], _HEADING, 2).alias("title"), x["line"].alias("line")
        )
        found = F.when(~is_mark & acc["fence"].isNull(), F.concat(acc["found"], F.array(head))).otherwise(acc["found"])
        return F.struct(fence.alias("fence"), found.alias("found"))

    return F.aggregate(marked, start, step)["found"]


def headings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level, title, line) of all headings outside fenced code."""
    return docs.select(key, F.inline(let(T.lines(F.col(text)), headings_of)))


def sections_of(t: Column, level: int = 2) -> Column:
    """array<struct(heading, body)>: each section of one level up to the next of that level (or above, for level 3)."""
    pattern = rf"(?md)^{'#' * level} (.+)$"
    heads = F.regexp_extract_all(t, F.lit(pattern), 1)
    bodies = F.split(t, rf"(?md)^{'#' * level} .+$", -1)
    return F.transform(heads, lambda h, i: F.struct(strip(h).alias("heading"), F.get(bodies, i + 1).alias("body")))


def sections(docs: DataFrame, key: str, text: str, level: int = 2) -> DataFrame:
    """(key, pos, heading, body) of all sections of one level."""
    return docs.select(key, F.posexplode(sections_of(F.col(text), level)).alias("pos", "_s")).select(key, "pos", "_s.heading", "_s.body")


def _violation(when: Column, check: str, detail: Column | str = "", severity: str = "error") -> Column:
    d = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), d.cast("string").alias("detail")))


def _report(df: DataFrame, key: str, found: list[Column]) -> DataFrame:
    return df.select(key, F.inline(F.array_compact(F.array(*found))))


# The fields, statuses and labels that these documents are checked for.
METADATA = ("Plan ID", "Status", "Parent manifest", "Grounded against", "Re-ground before")
REQUIRED = ("date", "researcher", "topic", "tags", "status", "last_updated", "last_updated_by")
TEXTS = ("date", "researcher", "repository", "git_commit", "branch", "topic", "status", "last_updated", "last_updated_by", "last_updated_note")
STATUSES = ("draft", "in-progress", "complete")
REPOSITORY = ("branch", "dirty", "git_commit", "repository")


def research_document(docs: DataFrame, key: str, raw: str) -> DataFrame:
    """(key, severity, check, detail) of every rule a research document breaks.

    Frontmatter fields, types, formats and groups; one title; a summary; open questions; a final
    line end. ``severity`` is error or warning; ``summary`` turns them into a pass or fail.
    """
    d = docs.where(F.col(raw).isNotNull()).withColumn("_ls", T.lines(F.col(raw))).withColumn("_starts", F.col(raw).startswith("---\n"))
    end = F.array_position(F.slice("_ls", F.lit(2), F.greatest(F.size("_ls"), F.lit(1))), "---").cast("int")
    d = d.withColumn("_end", F.when(F.col("_starts"), end).otherwise(0))
    none = F.array().cast("array<string>")
    d = d.withColumn("_block", F.when(F.col("_end") > 0, F.slice("_ls", F.lit(2), F.col("_end") - 1)).otherwise(none))
    d = d.withColumn("_body", F.when(~F.col("_starts"), F.col("_ls")).when(F.col("_end") > 0, F.slice("_ls", F.col("_end") + 2, F.size("_ls"))).otherwise(none))
    pattern = r"^([A-Za-z_][A-Za-z0-9_-]*):\s*(.*)\z"
    used = F.filter("_block", lambda x: (strip(x) != "") & ~F.ltrim(x).startswith("#"))
    pair = lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("n"), strip(F.regexp_extract(x, pattern, 2)).alias("v"), T.scalar_kind(F.regexp_extract(x, pattern, 2)).alias("k"))
    d = d.withColumn("_all", F.transform(used, pair))
    first = F.filter("_all", lambda p, i: (p["n"] != "") & ~F.exists(F.slice("_all", F.lit(1), i), lambda q: q["n"] == p["n"]))
    d = d.withColumn("_first", first)
    sound = F.filter("_first", lambda p: p["k"] != "error")
    d = d.withColumn("_m", F.map_from_entries(F.transform(sound, lambda p: F.struct(p["n"], F.struct(p["v"].alias("v"), p["k"].alias("k"))))))
    get = lambda n: F.try_element_at(F.col("_m"), F.lit(n))
    kind = lambda n: get(n)["k"]
    value = lambda n: T.unquoted(get(n)["v"])
    is_text = lambda n: kind(n).isin("string", "empty")
    found = [
        _violation(~F.col("_starts"), "start"),
        _violation(F.col("_starts") & (F.col("_end") == 0), "not closed"),
        _violation(F.exists("_all", lambda p: p["n"] == ""), "malformed line"),
        _violation(F.size("_first") < F.size(F.filter("_all", lambda p: p["n"] != "")), "duplicate key"),
        _violation(F.exists("_first", lambda p: p["k"] == "error"), "malformed value"),
    ]
    found += [_violation(get(n).isNull(), "missing field", n) for n in REQUIRED]
    found += [_violation(get(n).isNotNull() & ~is_text(n), "not a string", n) for n in TEXTS]
    found += [_violation(is_text(n) & (strip(value(n)) == ""), "empty field", n) for n in TEXTS if n in REQUIRED]
    found += [_violation(is_text(n) & ~T.is_iso8601(value(n)), "not ISO 8601", n) for n in ("date", "last_updated")]
    found += [_violation(is_text("status") & ~value("status").isin(*STATUSES), "unknown status", value("status"))]
    tags = T.csv_values(F.regexp_replace(get("tags")["v"], r"^\[|\]$", ""))
    good = (kind("tags") == "array") & (F.size(tags) > 0) & F.forall(tags, lambda t: t.rlike(r"""^(?:"[^"]*\S[^"]*"|'[^']*\S[^']*')\z"""))
    found += [_violation(get("tags").isNotNull() & ~good, "bad tags")]
    found += [_violation(good & ~F.exists(tags, lambda t: T.unquoted(t) == "research"), "no research tag", severity="warning")]
    found += [_violation(get("dirty").isNotNull() & (kind("dirty") != "bool"), "dirty is no bool")]
    lacking = F.array_compact(F.array(*[F.when(get(n).isNull(), F.lit(n)) for n in REPOSITORY]))
    found += [_violation(F.size(lacking).between(1, len(REPOSITORY) - 1), "repository incomplete", F.array_join(lacking, ", "))]
    d = d.withColumn("_h1", F.size(F.filter(headings_of(F.col("_body")), lambda h: h["level"] == 1)))
    found += [_violation(F.col("_h1") != 1, "titles", F.col("_h1"))]
    content = F.filter(F.transform("_body", strip), lambda x: x != "")
    d = d.withColumn("_content", content)
    head = F.get("_content", F.lit(0))
    found += [_violation((F.size("_content") > 0) & ~head.startswith("# "), "title not first", severity="warning")]
    at = F.array_position(F.transform("_content", lambda x: x.startswith("# ").cast("int")), 1).cast("int")
    after = F.slice("_content", at + 1, F.size("_content"))
    stop = F.array_position(F.transform(after, lambda x: x.startswith("## ").cast("int")), 1).cast("int")
    opening = F.when(stop > 0, F.slice(after, F.lit(1), stop - 1)).otherwise(after)
    found += [_violation((F.col("_h1") > 0) & (at > 0) & ~F.exists(opening, lambda x: ~x.startswith("#") & ~x.startswith("<!--")), "no summary", severity="warning")]
    low = F.lower(F.array_join("_body", "\n"))
    found += [_violation(~low.contains("open question") & ~low.contains("unresolved"), "no open questions", severity="warning")]
    found += [_violation((F.col(raw) != "") & ~F.col(raw).endswith("\n"), "no final line end", severity="warning")]
    return _report(d, key, found)


def plan_document(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, severity, check, detail) of every rule a plan breaks: metadata, decisions, packages, files, placeholders.

    A placeholder left in the plan is one row each: ``comment``, ``marker``, ``ellipsis`` or the
    bracketed hint itself. Null texts give no row.
    """
    t = F.col(text)
    d = docs.where(t.isNotNull()).select(key, t.alias("_t")).withColumn("_s", sections_of(F.col("_t")))
    t = F.col("_t")
    d = d.withColumn("_status", T.label_value(t, "Status")).withColumn("_reground", T.label_value(t, "Re-ground before")).withColumn("_left", T.placeholders(t))
    named = lambda n: F.get(F.filter("_s", lambda s: s["heading"] == n), F.size(F.filter("_s", lambda s: s["heading"] == n)) - 1)["body"]
    d = d.withColumn("_decisions", named("Open Decisions")).withColumn("_inventory", named("File Inventory")).withColumn("_progress", named("Progress"))
    package = r"^Work Package (\d+):\s+.+"
    d = d.withColumn("_wp", F.filter("_s", lambda s: s["heading"].rlike(package))).withColumn("_decl", T.declarations(t))
    waiting = F.col("_status").isin("Conditional", "Draft")
    data_rows = F.filter(T.lines(F.col("_decisions")), lambda x: x.startswith("|") & ~x.contains("Decision") & ~x.rlike(r"^\|[\s|:-]+\|\z"))
    boxes = F.filter(T.lines(F.col("_progress")), lambda x: x.rlike(r"^\s*- \[[ xX]\]"))
    undeclared = F.filter("_decl", lambda x: ~F.contains(F.col("_inventory"), x["path"]))
    ids = F.array_compact(F.transform("_wp", lambda w: T.label_value(w["body"], "ID")))
    found = [
        *[_violation(F.coalesce(T.label_value(t, n), F.lit("")) == "", "missing metadata", n) for n in METADATA],
        _violation(~F.col("_status").isin("Ready", "Conditional", "Draft"), "unknown status", F.col("_status")),
        _violation((F.col("_status") == "Ready") & F.col("_decisions").isNotNull(), "ready with open decisions"),
        _violation(waiting & F.col("_decisions").isNull(), "no open decisions"),
        _violation(waiting & (F.size(data_rows) == 0), "no decision row"),
        _violation((F.col("_status") == "Conditional") & (F.lower("_reground") == "none"), "no trigger"),
        _violation(F.size("_wp") == 0, "no packages"),
        _violation(F.size(ids) != F.size(F.array_distinct(ids)), "package ids repeat"),
        _violation((F.size("_wp") > 1) & F.col("_inventory").isNull(), "no inventory"),
        _violation((F.col("_status") == "Ready") & F.exists("_decl", lambda x: x["kind"] == "Destination"), "destination in ready plan"),
        _violation(F.col("_inventory").isNotNull() & (F.size(undeclared) > 0), "not in inventory", F.array_join(F.transform(undeclared, lambda x: x["path"]), ", ")),
        _violation(F.col("_progress").isNotNull() & (F.size(boxes) != F.size("_wp")), "progress boxes", F.size(boxes)),
        _violation(F.exists(boxes, lambda x: x.rlike(r"^[ \t]")), "indented boxes"),
    ]
    left = d.select(key, F.explode("_left").alias("detail")).select(key, F.lit("error").alias("severity"), F.lit("placeholder").alias("check"), "detail")
    w = d.select(key, F.explode("_wp").alias("_w")).select(key, F.regexp_extract("_w.heading", package, 1).alias("_n"), F.col("_w.body").alias("_b"))
    b = F.col("_b")
    wid = F.concat(F.lit("WP"), F.col("_n"))
    subs = F.filter(sections_of(b, 3), lambda s: s["heading"].rlike(r"^\d+\.\d+\s+") & s["heading"].startswith(F.concat(F.col("_n"), F.lit("."))))
    per = [_violation(T.label_value(b, "ID").isNull(), "package without id", wid), _violation(T.label_value(b, "ID") != wid, "wrong package id", T.label_value(b, "ID"))]
    per += [_violation(T.label_value(b, n).isNull(), f"package without {n.lower()}", wid) for n in ("Depends on", "Done when", "Checkpoint")]
    per += [_violation(~b.rlike(rf"(?md)^### {n}\s*$"), f"package without {n.lower()}", wid) for n in ("Tests", "Verification", "Implementation Notes")]
    per += [_violation(F.size(subs) == 0, "package without subtasks", wid), _violation(F.exists(subs, lambda s: F.size(T.declarations(s["body"])) == 0), "subtask without declaration", wid)]
    return _report(d, key, found).unionByName(left).unionByName(_report(w, key, per))


def summary(violations: DataFrame, keys: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """(key, n_errors, n_warnings, ok) of every document; strict counts warnings as errors."""
    n = violations.groupBy(key).agg(
        F.sum((F.col("severity") == "error").cast("long")).alias("n_errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("n_warnings")
    )
    e, w = F.coalesce("n_errors", F.lit(0)), F.coalesce("n_warnings", F.lit(0))
    return keys.select(key).distinct().join(n, key, "left").select(key, e.alias("n_errors"), w.alias("n_warnings"), ((e == 0) & (F.lit(not strict) | (w == 0))).alias("ok"))
