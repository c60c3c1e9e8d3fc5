"""File sources: Markdown folders, JSON objects, PDF pages, and small driver-side configuration."""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.operators.drift import parsed
from sheaf.session import ship


def read_markdown(spark: SparkSession, root: str, any_readme: bool = False) -> DataFrame:
    """(file, raw) of ``<root>/<doc>/*.md``, each file one row; ``file`` is relative to the root.

    Folders named ``_maps`` are left out, and ``README.md`` (or, with ``any_readme``, every name
    that begins with readme in any case). Sort by ``file`` where order matters.
    Files of a mounted file system are listed and read by the executors: the driver knows the folders only.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        return _mounted_markdown(spark, at.toUri().getPath(), any_readme)
    # Folders are listed, not globbed: a glob would make every file a root of its own to be listed again.
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("_p"), F.col("value").alias("raw"))
    path = F.url_decode(F.regexp_replace("_p", r"\+", "%2B"))
    top = re.sub(r"^[a-zA-Z][\w+.-]*:(?://[^/]*)?", "", root).strip("/")
    d = d.select(F.regexp_extract(path, rf"/{re.escape(top)}/([^/]+/[^/]+)\z", 1).alias("file"), "raw").where("file <> ''")
    return d.where(~_readme(F.split_part("file", F.lit("/"), F.lit(2)), any_readme) & ~F.col("file").startswith("_maps/"))


def _readme(name: Column, any_readme: bool) -> Column:
    return F.upper(name).startswith("README") if any_readme else name == "README.md"


def _mounted_markdown(spark: SparkSession, root: str, any_readme: bool, most: int = 8 << 20) -> DataFrame:
    """Names travel as bytes, batches hold ``most`` bytes or one file; a folder's files are dealt out to many tasks."""
    top = os.fsencode(root)

    def names(batches):
        for b in batches:
            for doc in b.column(0).to_pylist():
                with os.scandir(os.path.join(top, doc)) as es:
                    got = [e.name for e in es if e.name.endswith(b".md") and e.is_file()]
                for i in range(0, len(got), 10_000):
                    some = got[i : i + 10_000]
                    yield pa.RecordBatch.from_pydict({"doc": pa.array([doc] * len(some), pa.binary()), "name": pa.array(some, pa.binary())})

    def read(batches):
        def batch():
            return pa.RecordBatch.from_pydict({"file": pa.array(file, pa.binary()), "raw": pa.array(raw, pa.binary())})

        file, raw, size = [], [], 0
        for b in batches:
            for doc, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                file.append(doc + b"/" + name)
                with open(os.path.join(top, file[-1]), "rb", buffering=0) as f:
                    raw.append(f.read())
                size += len(raw[-1])
                if size > most or len(raw) == 10_000:
                    yield batch()
                    file, raw, size = [], [], 0
        if raw:
            yield batch()

    with os.scandir(top) as es:
        docs = [(bytearray(e.name),) for e in es if e.name != b"_maps" and e.is_dir()]
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    d = spark.createDataFrame(spark.sparkContext.parallelize(docs, max(1, min(len(docs), max(cores, len(docs) // 2000)))), "doc binary").mapInArrow(names, "doc binary, name binary")
    d = d.where(~_readme(F.col("name").cast("string"), any_readme)).repartition(max(4 * cores, len(docs) // 500), "doc", "name")
    return d.mapInArrow(read, "file binary, raw binary").select(F.col("file").cast("string"), F.col("raw").cast("string"))


def read_json_objects(spark: SparkSession, path: str, schema: StructType | str, skip: Sequence[str] = ("_all.json",)) -> DataFrame:
    """One row per JSON file below ``path`` with its base name in ``file``; unreadable JSON fails the read."""
    d = spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json")
    return d.select("*", F.col("_metadata.file_name").alias("file")).where(~F.col("file").isin(*skip))


def _over(spark: SparkSession, f: Callable, start: int, end: int, block: int) -> list:
    """What ``f`` lists for each (from, to) of a part of a file: a task a block, one block alone on the driver."""
    b = [(i, min(i + block, end)) for i in range(start, end, block)]
    return spark.sparkContext.parallelize(b, len(b)).flatMap(f).collect() if len(b) > 1 else [x for y in b for x in f(y)]


def _find(spark: SparkSession, path: str, text: bytes, start: int, end: int, block: int) -> int:
    """Where ``text`` first begins in a part of a file; ``end`` if nowhere."""

    def look(b):
        with open(path, "rb") as f:
            f.seek(b[0])
            at = f.read(b[1] - b[0] + len(text) - 1).find(text)
        return [b[0] + at] * (at >= 0)

    return min(_over(spark, look, start, end, block), default=end)


def read_entries(spark: SparkSession, path: str, *within: str, block: int = 8 << 20) -> DataFrame:
    """(place, entry) of the JSON array of objects, or the object, found under the keys ``within`` of a file.

    ``place`` counts from 0; ``entry`` is the JSON text of an element, or of an object of one field. The
    file must be laid out as ``write_manifest``, ``write_index`` and ``write_object`` do (an indent of 2) and be
    mounted by all executors. It is read in blocks by many tasks, so its size is not bounded by any memory.
    """
    end = os.path.getsize(path)
    with open(path, "rb") as f:
        opened, start = f.read(1), 1
        f.seek(max(1, end - 64))
        tail = f.read()
        end += len(tail.rstrip()) - len(tail) - 1
        f.seek(max(1, end - 1))
        end -= f.read(1) == b"\n"
        for depth, key in enumerate(within, 1):
            head = b"\n" + b"  " * depth + json.dumps(key, ensure_ascii=False).encode() + b": "
            start = _find(spark, path, head, start, end, block) + len(head) + 1
            if start > end:
                raise ValueError(f"{path} has no {'.'.join(within[:depth])}")
            f.seek(start - 1)
            opened, after = f.read(1), f.read(1)
            if opened not in (b"{", b"["):
                raise ValueError(f"{'.'.join(within[:depth])} of {path} is neither an array nor an object")
            end = start if after in (b"}", b"]") else _find(spark, path, b"\n" + b"  " * depth + (b"}" if opened == b"{" else b"]"), start, end, block)
    pad, keyed = b"\n" + b"  " * (len(within) + 1), opened == b"{"
    cut = b"," + pad + (b'"' if keyed else b"{")
    first = start + len(pad)

    def pieces(f, a: int, b: int) -> list[bytes]:
        """Entries that begin in a block, but for the first byte of all but the file's first; the last may go on."""
        f.seek(a)
        return f.read(min(b + len(cut) - 1, end) - a).split(cut)[a != first :]

    def count(b):
        with open(path, "rb") as f:
            return [(*b, len(pieces(f, *b)))]

    def read(batches):
        with open(path, "rb") as f:
            for t in batches:
                for a, b, n in zip(*(c.to_pylist() for c in t.columns)):
                    if not (got := pieces(f, a, b)):
                        continue
                    while (at := got[-1].find(cut)) < 0 and f.tell() < end:
                        got[-1] += f.read(min(max(1 << 16, len(got[-1])), end - f.tell()))
                    if at >= 0:
                        got[-1] = got[-1][:at]
                    got = [x if a == first and not i else cut[-1:] + x for i, x in enumerate(got)]
                    for i in range(0, len(got), 10_000):
                        some = got[i : i + 10_000]
                        yield pa.RecordBatch.from_pydict({"place": pa.array(range(n + i, n + i + len(some)), pa.int64()), "entry": pa.array([b"{" + x + b"}" for x in some] if keyed else some, pa.string())})

    ship(spark)
    found = _over(spark, count, first, end, block)
    rows = [(a, b, n) for (a, b, k), n in zip(found, accumulate((k for *_, k in found), initial=0)) if k]
    at = spark.createDataFrame(spark.sparkContext.parallelize(rows, max(1, len(rows))), "start long, end long, place long")
    return at.mapInArrow(read, "place long, entry string")


def merge_maps(maps: DataFrame) -> DataFrame:
    """Fragments of all map files, the map's document and PDF written over their own (header wins)."""
    doc = F.coalesce(F.nullif(F.col("doc"), F.lit("")), F.regexp_replace("file", r"\.json\z", ""))
    e = maps.select(doc.alias("doc"), F.coalesce("pdf_file", F.lit("")).alias("pdf_file"), "file", F.posexplode(F.coalesce("fragments", F.array().cast(maps.schema["fragments"].dataType))).alias("pos", "_f"))
    inner = [c for c in e.schema["_f"].dataType.names if c not in ("doc", "pdf_file")]
    return e.where(F.col("_f").isNotNull()).select("doc", "pdf_file", "file", "pos", *[F.col(f"_f.{c}").alias(c) for c in inner])


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, page, text) of PDF files, where a PDF reader is installed.

    ``status``: ok, encrypted or unreadable; a page that cannot be read has the empty text.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf

        for b in batches:
            out = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    r = pypdf.PdfReader(io.BytesIO(c))
                    if r.is_encrypted and not r.decrypt(""):
                        out.append((p, "encrypted", None, None))
                        continue
                except Exception:
                    out.append((p, "unreadable", None, None))
                    continue
                for i, page in enumerate(r.pages, 1):
                    try:
                        out.append((p, "ok", i, page.extract_text() or ""))
                    except Exception:
                        out.append((p, "ok", i, ""))
            yield pd.DataFrame(out, columns=["file", "status", "page", "text"])

    try:
        import pypdf  # noqa: F401
    except ImportError as x:
        raise RuntimeError("reading PDF files needs the pypdf package on driver and executors") from x
    return raw.mapInPandas(pages, "file string, status string, page int, text string")


def key_value_lines(c: Column) -> Column:
    """map<string,string> of ``Key: value`` lines, as command-line tools print them; the first of a key counts."""
    ls = F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^[^:]+:"))
    pair = F.transform(ls, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract(x, r"^[^:]+:(.*)\z", 1)).alias("value")))
    return F.map_from_entries(F.filter(pair, lambda p, i: ~F.exists(F.slice(pair, F.lit(1), i), lambda q: q["key"] == p["key"])))


def capabilities(tools: Sequence[str]) -> dict[str, bool]:
    """Which command-line tools the driver has."""
    return {t: shutil.which(t) is not None for t in tools}


def layered_config(defaults: Mapping, file: Mapping | None = None, flags: Mapping | None = None) -> dict:
    """Defaults, overwritten by a file's values, overwritten by flags that were given.

    A list-valued flag may be repeated and hold comma lists; parts are trimmed and blanks dropped.
    """
    out = {**defaults, **(file or {})}
    for k, v in (flags or {}).items():
        if v is None:
            continue
        if isinstance(defaults.get(k), list):
            given = v if isinstance(v, (list, tuple)) else [v]
            out[k] = [p.strip() for x in given for p in str(x).split(",") if p.strip()]
        else:
            out[k] = v
    return out


def arguments(given) -> dict:
    """An argument object, also where it comes as JSON text; anything unreadable is no arguments."""
    if isinstance(given, str):
        try:
            given = json.loads(given)
        except ValueError:
            return {}
    return given if isinstance(given, dict) else {}


def argument_map(c: Column) -> Column:
    """map<string,variant> of an argument object given as JSON text; empty where it is none or cannot be read."""
    return F.coalesce(parsed(c).cast("map<string,variant>"), F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>")))


def scoped_paths(listings: Sequence[DataFrame], path: str = "path", extensions: Sequence[str] = ("java", "kt"), below: Sequence[str] = (), kind: str = "all") -> DataFrame:
    """Distinct paths of several listings with given extensions, below any of ``below``, sorted by bytes.

    ``kind``: ``dir`` and ``module`` match whole path segments anywhere, ``package`` takes dots for
    slashes, ``file`` matches the whole path. Names are literals, not patterns.
    """
    out = None
    for d in listings:
        d = d.select(path)
        out = d if out is None else out.union(d)
    keep = F.lower(F.regexp_extract(path, r"\.([^./]+)\z", 1)).isin(*extensions)
    if below:
        hit = F.lit(False)
        for b in below:
            b = b.replace(".", "/") if kind == "package" else b.strip("/")
            hit = hit | (F.col(path) == b) if kind == "file" else hit | F.contains(F.concat(F.lit("/"), F.col(path)), F.lit(f"/{b}/"))
        keep = keep & hit
    return out.where(keep).distinct().orderBy(path)
