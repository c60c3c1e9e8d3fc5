"""The general problems against plain Python over the whole small tables."""

import json
import posixpath
import re
from collections import defaultdict

import duckdb

from sheaf.plans import problems


def read(root, name, cols):
    return duckdb.sql(f"select {cols} from '{root}/{name}.parquet'").fetchall()


def got(spark, root, q):
    return sorted(tuple(r) for r in q(spark, root).collect())


CONCEPTS = [
    {"printed_to_pdf_offset", "printedToPdfOffset", "offset", "pdf_offset", "page_shift"},
    {"structure_notes", "structureNotes", "clean_notes", "cleanNotes", "clean"},
    {"target_pdf_range", "targetPdfRange", "target_pages", "body_range"},
    {"total_pdf_pages", "totalPages", "pages"},
    {"pdf_file", "pdfFile", "pdf_path"},
]


def kind(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(v)]


def test_p1_found(spark, data):
    revs = defaultdict(dict)
    for f, rev, raw in read(data, "map_raw", "map_file, rev, raw"):
        try:
            o = json.loads(raw)
        except (TypeError, ValueError):
            continue
        if isinstance(o, dict):
            revs[f][rev] = o
    want = []
    for f, by in revs.items():
        order = sorted(by)
        for a, b in zip(order, order[1:]):
            old, new = by[a], by[b]
            went, came = set(old) - set(new), set(new) - set(old)
            for n in sorted(came):
                partner = next((w for c in CONCEPTS if n in c for w in sorted(went & c)), None)
                if partner is None:
                    want.append((f, b, n, "added"))
                else:
                    went.discard(partner)
                    want.append((f, b, n, "renamed"))
                    if kind(old[partner]) and kind(new[n]) and kind(old[partner]) != kind(new[n]):
                        want.append((f, b, n, "retyped"))
            want += [(f, b, n, "removed") for n in went]
            want += [(f, b, n, "retyped") for n in set(old) & set(new) if kind(old[n]) and kind(new[n]) and kind(old[n]) != kind(new[n])]
    assert want and got(spark, data, problems.p1_found) == sorted(want)


def test_p1_rows_keep_everything(spark, data):
    """Every field of every readable revision is either in a typed column or rescued."""
    rows = problems.p1_rows(spark, data).collect()
    raw = {}
    for f, rev, text in read(data, "map_raw", "map_file, rev, raw"):
        try:
            o = json.loads(text)
        except (TypeError, ValueError):
            continue
        raw[f, rev] = o
    assert {(r.map_file, r.rev) for r in rows} == set(raw)
    for r in rows:
        left = json.loads(r.rescued)
        typed = [r.page_offset, r.structure_notes, r.target_first, r.page_count, r.pdf_name]
        for c, v in zip(CONCEPTS, typed):
            names = [n for n in raw[r.map_file, r.rev] if n in c]
            assert (v is not None) == bool([n for n in names if n not in left])
        assert not set(left) - set(raw[r.map_file, r.rev])


def norm(p):
    p = p.split("#")[0].strip().replace("\\", "/")
    return posixpath.normpath(p)


def test_p2_found(spark, data):
    spans = defaultdict(set)
    for f, w, d in read(data, "fragment_file", "file, written_at, deleted_at"):
        spans[norm(f)].add((w, d))
    refs = {("link_index", *r) for r in read(data, "link_index", "entry_id, target_file, built_at")}
    refs |= {("fragments", *r) for r in read(data, "fragments", "frag_id, target_file, reported_at")}
    refs |= {("manifest", *r) for r in read(data, "manifest", "manifest_id, file, built_at")}
    want = []
    for t, i, p, at in refs:
        if p is None:
            continue
        s = spans.get(norm(p))
        if s is None:
            want.append((t, i, "missing"))
        elif all(w > at for w, _ in s):
            want.append((t, i, "late"))
        elif not any(w <= at and (d is None or at < d) for w, d in s):
            want.append((t, i, "deleted"))
    assert want and got(spark, data, problems.p2_found) == sorted(want)
    months = problems.p2_by_month(spark, data).collect()
    assert sum(r.n_missing + r.n_late + r.n_deleted for r in months) == len(want)


PAGE = re.compile(r"(\d+)(?:\s*(?:-|–|—|−|\.\.|to)\s*(\d+|end))?")


def items(s):
    return [(a, b or None) for a, b in PAGE.findall(s or "")]


def pages_known(data):
    last = {}
    for p, n in read(data, "probe", "pdf, pages"):
        if n is not None:
            b = p.split("/")[-1]
            last[b] = max(last.get(b, 0), n)
    return last


def page_set(s, last):
    out = set()
    for a, b in items(s):
        a = int(a)
        b = max(a, last or a) if b == "end" else int(b or a)
        out |= set(range(min(a, b), max(a, b) + 1))
    return out


def runs(pages):
    out = []
    for p in sorted(pages):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return out


def test_p4_found(spark, data):
    last, cover, target = pages_known(data), defaultdict(set), defaultdict(set)
    for f, s in read(data, "fragments", "pdf_file, pdf_pages"):
        if f is not None:
            cover[f] |= page_set(s, last.get(f))
    for f, s in read(data, "doc_meta", "pdf_file, target_pages"):
        if f is not None and s is not None:
            target[f] |= page_set(re.sub(r"\[\s*(\d+)\s*,\s*(\d+)\s*\]", r"\1-\2", s), last.get(f))
    want = []
    for f in set(cover) | set(target):
        c, t = cover[f], target[f]
        if not t and c:
            t = set(range(min(c), max(c) + 1))
        want += [(f, "period", *r) for r in runs(c)] + [(f, "gap", *r) for r in runs(t - c)]
    assert want and got(spark, data, problems.p4_found) == sorted(want)


TAGS = """research re-scan page-map framing follow-up offsets figures codebase manifest gateway codec addressing Java netio wire-format
état scheduling web tcp/ip timeouts v2.1 retry outline time-tag linking i/o größe checksum c++ ocr""".split()
TAGS += ["test bench", "late frames", "open question", "read/write path", "link layer", "error handling", "page offsets", "pages 3, 4"]
TAGS += ["client, embedded", "gateway | proxy", "start, stop, test", "ack; nack", 'the "strict" mode', "it's late", 'so-called "clean" copy']


def test_p5_found(spark, data):
    rows = got(spark, data, problems.p5_found)
    want = set()
    for i, s in read(data, "fragments", "frag_id, pdf_pages"):
        v = [a if b is None else f"{a}-{b}" for a, b in items(s)]
        if len(v) > 1:
            want |= {("fragments", i, k + 1, x) for k, x in enumerate(v)}
    assert sorted(want) == [r for r in rows if r[0] == "fragments"]
    tags = [r for r in rows if r[0] == "research_doc"]
    assert tags and {r[3] for r in tags} <= set(TAGS)
    # Each value is found in its text at or after the one before it, once escapes are gone.
    text = dict(read(data, "research_doc", "research_id, tags"))
    plain = {i: re.sub(r"\\u([0-9a-f]{4})", lambda m: chr(int(m[1], 16)), s).replace('\\"', '"').replace('""', '"').replace("\\", "") for i, s in text.items() if s}
    at = {}
    for _, i, _, item in tags:
        at[i] = plain[i].index(item, at.get(i, 0)) + len(item)


def tags_in(s):
    """Tags of a text by a dictionary of all there are, the longest first: no rule of quotes or separators is used."""
    s = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), s).replace('""', '"').replace("''", "'")
    s = re.sub(r"\\(.)", r"\1", s)
    out, i = [], 0
    while i < len(s):
        hit = next((t for t in sorted(TAGS, key=len, reverse=True) if s.startswith(t, i) and not s[i + len(t) : i + len(t) + 1].isalnum()), None)
        assert hit or not s[i].isalnum(), s
        out += [hit] if hit else []
        i += len(hit or "x")
    return out


def test_p5_tags_against_a_dictionary(spark, data):
    want = set()
    for i, s in read(data, "research_doc", "research_id, tags"):
        tags = tags_in(s or "")
        if len(tags) > 1:
            want |= {("research_doc", i, k, t) for k, t in enumerate(tags, 1)}
    assert want and sorted(want) == [r for r in got(spark, data, problems.p5_found) if r[0] == "research_doc"]
