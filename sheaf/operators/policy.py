"""Ordered first-match rules, routing and message-template aggregation."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.text import matches_globs, message_template, template_regex

ACTIONS = ("ignore", "fix", "suppress", "auto")


def policy(raw: Mapping | None, whitelist: Sequence[Mapping] | None = None) -> tuple[str, list[dict]]:
    """(default action, rules); a legacy whitelist becomes ignore rules, an unknown default ``auto``."""
    if raw is None:
        raw = {"default": "auto", "rules": [{**w, "action": "ignore"} for w in whitelist or ()]}
    default = raw.get("default")
    return default if default in ACTIONS else "auto", list(raw.get("rules") or ())


def _readable(pattern: str, spark) -> bool:
    """Whether the engine reads a pattern: checked on the driver, as a bad one would fail the query."""
    try:
        re.compile(pattern)
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def in_scope(severity: Column, floor: Sequence[str] = ("ALL",)) -> Column:
    """Severity filter; ``ALL`` lets every one pass."""
    wanted = [s.upper() for s in floor]
    return F.lit("ALL" in wanted) | F.upper(severity).isin(*wanted)


def first_match(df: DataFrame, rules: Sequence[Mapping], description: str, severity: str, path: str) -> DataFrame:
    """Adds ``rule_idx`` of the first rule that matches, null if none does.

    The rules are few and known on the driver, so they become one CASE in their order: no join, no
    shuffle, and later rules are not even looked at. A rule with an unreadable pattern never matches.
    """
    case: Column | None = None
    for i, r in enumerate(rules):
        hit = F.lit(True)
        if r.get("description"):
            hit = hit & (F.col(description).rlike(r["description"]) if _readable(r["description"], df.sparkSession) else F.lit(False))
        if r.get("severity"):
            hit = hit & (F.upper(severity) == r["severity"].upper())
        if r.get("paths"):
            hit = hit & matches_globs(F.col(path), r["paths"])
        case = F.when(hit, i) if case is None else case.when(hit, i)
    return df.withColumn("rule_idx", F.lit(None).cast("int") if case is None else case)


def route(df: DataFrame, rules: Sequence[Mapping], default: str, severity: str, floor: Sequence[str] = ("ALL",)) -> DataFrame:
    """Adds ``bucket`` (outOfScope, ignored, actionable), ``pinned_action`` and ``policy_reason`` after ``first_match``."""

    def of_rule(field: str, other: str) -> Column:
        c = F.lit(other)
        for i, r in enumerate(rules):
            c = F.when(F.col("rule_idx") == i, F.lit(r.get(field) or "")).otherwise(c)
        return c

    action = of_rule("action", default)
    bucket = F.when(~F.coalesce(in_scope(F.col(severity), floor), F.lit(False)), "outOfScope").when(action == "ignore", "ignored").otherwise("actionable")
    d = df.withColumn("bucket", bucket)
    pinned = F.when(F.col("bucket") == "actionable", F.when(action.isin("fix", "suppress"), action).otherwise("auto"))
    reason = F.when(F.col("bucket") == "ignored", F.when(F.col("rule_idx").isNull(), "default: ignore").otherwise(of_rule("reason", ""))).when(F.col("bucket") == "actionable", of_rule("reason", ""))
    return d.withColumn("pinned_action", pinned).withColumn("policy_reason", reason)


def message_types(df: DataFrame, message: str, file: str, severity: str, order: str, examples: int = 5) -> DataFrame:
    """Per template: count, distinct files, the first severity, ``first_seen``, its first ``examples`` and its pattern.

    ``order`` is the order seen. The most frequent types come first, equally frequent ones as first
    seen. Examples are cut to their number in each task before they meet.
    """
    t = df.withColumn("template", message_template(F.col(message)))
    n = t.groupBy("template").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(file).alias("n_files"), F.min_by(severity, order).alias("severity"), F.min(order).alias("first_seen"))
    some = _in_order(top_k(t, ["template"], [F.col(order)], examples), "template", order, message, "examples")
    return n.join(some, "template").withColumn("pattern", template_regex(F.col("template"))).orderBy(F.desc("n"), "first_seen")


def _in_order(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """(key, array of values in order) of groups that ``top_k`` has made small."""
    got = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.transform(got, lambda s: s["_v"]).alias(out))


def first_examples(df: DataFrame, message: str, order: str, most: int = 5) -> DataFrame:
    """The first ``most`` rows of each template."""
    t = df.withColumn("template", message_template(F.col(message)))
    return top_k(t, ["template"], [F.col(order)], most)


def recurring(df: DataFrame, message: str, file: str, order: str, files: int = 3, shown: int = 10) -> DataFrame:
    """(template, occurrences, n_files, example, files, pattern) of templates found in at least ``files`` files.

    ``example`` is the first message, ``files`` the first ``shown`` files in the order seen; the
    most widespread templates come first. A null file is no file.
    """
    t = df.withColumn("template", message_template(F.col(message)))
    each = t.groupBy("template", F.col(file).alias("_file")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"), F.min_by(message, order).alias("_example"))
    some = each.groupBy("template").agg(F.sum("_n").alias("occurrences"), F.count("_file").alias("n_files"), F.min_by("_example", "_first").alias("example"), F.min("_first").alias("_seen"))
    named = _in_order(top_k(each.where("_file is not null"), ["template"], [F.col("_first")], shown), "template", "_first", "_file", "files")
    d = some.where(F.col("n_files") >= files).join(named, "template").orderBy(F.desc("n_files"), "_seen")
    return d.select("template", "occurrences", "n_files", "example", "files", template_regex(F.col("template")).alias("pattern"))


def outcome(dropped: Column, error: Column, dry_run: Column, clean: Column, remaining: Column, blocked: Column, approved: Column) -> Column:
    """Outcome of a result in order of priority; ``approved`` fails only if it is exactly false."""
    return (
        F.when(dropped, "dropped").when(error.isNotNull(), "error").when(dry_run, "dry-run").when(clean, "clean")
        .when((remaining > 0) | (blocked > 0) | F.coalesce(~approved, F.lit(False)), "attention").otherwise("resolved")
    )


def proposed_action(rule_action: Column, triage_action: Column) -> Column:
    """A rule's own action, else the triage's: ``mixed`` is suppress, unknown is fix."""
    known = ("ignore", "fix", "suppress")
    return F.when(rule_action.isin(*known), rule_action).when(triage_action == "mixed", "suppress").when(triage_action.isin(*known), triage_action).otherwise("fix")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows of each key; Spark keeps only ``k`` rows a key ahead of the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
