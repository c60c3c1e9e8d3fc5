"""Sinks: sorted JSON, reports, Markdown files, frontmatter."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.bind import strip
from sheaf.functions.text import natural_key, yaml_quoted
from sheaf.session import ship


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON objects sorted over all files: for results of any size."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


@contextlib.contextmanager
def _replacing(path: str) -> Iterator[BinaryIO]:
    """A file to write to that takes the place of ``path`` at the end, as a whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    try:
        with os.fdopen(fd, "wb") as f:
            yield f
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


def _replace(path: str, content: str | bytes) -> None:
    with _replacing(path) as f:
        f.write(content.encode() if isinstance(content, str) else content)


def _put(path: str, content: bytes) -> None:
    """``_replace`` for many small files: the folder is looked at only where it is missing."""
    temp = os.path.join(os.path.dirname(path), f"tmp{uuid.uuid4().hex}.tmp")
    try:
        fd = os.open(temp, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    except FileNotFoundError:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        fd = os.open(temp, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(content)
        os.replace(temp, path)
    except BaseException:
        os.unlink(temp)
        raise


_plain = json.JSONEncoder(ensure_ascii=False).encode


def _indented(value, depth: int) -> str:
    """``value`` as ``json.dumps`` with an indent of 2 writes it so many levels deep."""
    if not value or not isinstance(value, (dict, list)):
        return _plain(value)
    pad = "\n" + "  " * depth
    if isinstance(value, dict):
        return "{" + ",".join(f"{pad}  {_plain(k)}: {_indented(v, depth + 1)}" for k, v in value.items()) + pad + "}"
    return "[" + ",".join(f"{pad}  {_indented(v, depth + 1)}" for v in value) + pad + "]"


def _append(out: BinaryIO, path: str, df: DataFrame, value: Column, depth: int, key: Column | None = None, most: int | None = None) -> int:
    """Appends one entry a row, in the order of ``df``, to a JSON array or (with ``key``) object opened in ``out``; their number.

    Every partition writes its entries to a file beside ``path``, on a file system that all executors
    have mounted; these are put together as bytes, so no process holds more than a batch of rows.
    """
    parts, pad = f"{os.path.abspath(path)}.{uuid.uuid4().hex}", "  " * depth

    def put(batches):
        part, n = TaskContext.get().partitionId(), 0
        with _replacing(os.path.join(parts, str(part))) as f:
            for b in batches:
                rows = map(json.loads, b.column(0).to_pylist())
                text = ",\n".join(pad + (f"{_plain(r['k'])}: " if "k" in r else "") + _indented(r["v"], depth) for r in rows)
                if text:
                    f.write((",\n" * bool(n) + text).encode())
                    n += b.num_rows
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [n]})

    ship(df.sparkSession)
    entry = F.struct(*([] if key is None else [key.alias("k")]), value.alias("v"))
    try:
        got = sorted(map(tuple, df.select(F.to_json(entry, {"ignoreNullFields": "false"})).mapInArrow(put, "part long, n long").where("n > 0").collect()))
        n = sum(k for _, k in got)
        if most is not None and n > most:
            raise ValueError(f"more than {most} rows: write JSON lines instead")
        for i, (part, _) in enumerate(got):
            out.write(b",\n" if i else b"\n")
            with open(os.path.join(parts, str(part)), "rb") as f:
                shutil.copyfileobj(f, out, 1 << 22)
            os.unlink(f.name)
        out.write(("\n" + pad[2:]).encode() * bool(n))
        return n
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def write_manifest(df: DataFrame, path: str, clause: str = "clause", doc: str = "doc", most: int | None = None) -> int:
    """One JSON array, by document and clause in natural order (then by all columns), in a folder that all executors have mounted.

    Of any size; beyond ``most`` rows, if given, it refuses. Characters stay as they are, absent
    values are null, the file ends with a line end. ``files.read_entries`` reads it.
    """
    d = df.orderBy(doc, natural_key(F.col(clause)), *[c for c in df.columns if c != doc])
    with _replacing(path) as f:
        f.write(b"[")
        n = _append(f, path, d, F.struct(*df.columns), 1, most=most)
        f.write(b"]\n")
    return n


def write_object(value: Mapping, path: str) -> None:
    """One JSON object, its folder made if needed, replaced as a whole or not at all."""
    _replace(path, json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def nested_index(meta: DataFrame, by_clause: DataFrame, fragments: DataFrame, most: int = 1_000_000) -> dict:
    """{docMeta, linkIndex: {byClause}, fragments} of (doc, ...), (key, file) and fragment rows.

    One object in the driver's memory; a frame of more than ``most`` rows is refused, not cut: ``write_index`` writes any size.
    """

    def rows(df: DataFrame) -> list:
        got = df.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"more than {most} rows: write JSON lines instead")
        return got

    return {
        "docMeta": {r["doc"]: {k: v for k, v in r.asDict(True).items() if k != "doc"} for r in rows(meta.orderBy("doc"))},
        "linkIndex": {"byClause": {r["key"]: r["file"] for r in rows(by_clause.orderBy("key"))}},
        "fragments": [r.asDict(True) for r in rows(fragments)],
    }


def write_index(meta: DataFrame, by_clause: DataFrame, fragments: DataFrame, path: str) -> None:
    """What ``write_object`` makes of ``nested_index``, of any size, replaced as a whole; keys must differ, all executors have the folder mounted."""
    with _replacing(path) as f:
        f.write(b'{\n  "docMeta": {')
        _append(f, path, meta.orderBy("doc"), F.struct(*[c for c in meta.columns if c != "doc"]), 2, F.col("doc"))
        f.write(b'},\n  "linkIndex": {\n    "byClause": {')
        _append(f, path, by_clause.orderBy("key"), F.col("file"), 3, F.col("key"))
        f.write(b'}\n  },\n  "fragments": [')
        _append(f, path, fragments, F.struct(*fragments.columns), 2)
        f.write(b"]\n}\n")


def report(violations: DataFrame, hard: tuple[str, ...] = ("error",)) -> tuple[dict, int]:
    """(report, exit code) of (severity, check, ...) rows: 0 if no hard failure, else 1. One row a check is collected."""
    n = violations.groupBy("severity", "check").agg(F.count(F.lit(1)).alias("n")).collect()
    checks = {r["check"]: r["n"] for r in sorted(n, key=lambda r: r["check"])}
    bad = sorted(r["check"] for r in n if r["severity"] in hard)
    return {"checks": checks, "ok": not bad, "hard_failures": bad, "warnings": sorted(r["check"] for r in n if r["severity"] not in hard)}, int(bool(bad))


def write_texts(df: DataFrame, root: str, file: str = "file", raw: str = "raw") -> None:
    """Every row's text or bytes to its own file below a folder that all executors have mounted; each replaced as a whole."""

    def put(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _put(os.path.join(root, name), data.encode() if isinstance(data, str) else data)
        yield from ()

    ship(df.sparkSession)
    df.select(file, raw).where(F.col(file).isNotNull() & F.col(raw).isNotNull()).mapInArrow(put, "n long").write.format("noop").mode("overwrite").save()


def frontmatter_text(*fields: tuple[str, Column]) -> Column:
    """YAML frontmatter of quoted fields; null ones are left out, arrays become quoted lists, booleans are bare.

    Line ends, and tabs within a list, are written as escapes.
    """

    def one_line(v: Column) -> Column:
        return F.replace(F.replace(v, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))

    parts = []
    for name, (c, kind) in ((n, x if isinstance(x, tuple) else (x, "string")) for n, x in fields):
        if kind == "list":
            v = F.concat(F.lit("["), F.array_join(F.transform(F.filter(c, lambda x: strip(x) != ""), lambda x: F.replace(one_line(yaml_quoted(strip(x))), F.lit("\t"), F.lit("\\t"))), ", "), F.lit("]"))
        elif kind == "bool":
            v = F.when(c, "true").when(~c, "false")
        else:
            v = one_line(yaml_quoted(c))
        parts.append(F.concat(F.lit(f"{name}: "), v, F.lit("\n")))
    return F.concat(F.lit("---\n"), F.concat_ws("", *parts), F.lit("---\n"))
