"""Files in and out, and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sheaf.operators import orphans
from sheaf.sources import files, sinks
from sheaf.streaming import maintain


def put(root, name, text):
    p = os.path.join(root, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


def test_read_markdown(spark, tmp_path):
    root = str(tmp_path)
    for n in ("d/a b.md", "d/README.md", "d/ReadMe-x.md", "_maps/m.md", "d/x.txt"):
        put(root, n, "---\nclause: 1\n---\nü\n")
    assert sorted(r.file for r in files.read_markdown(spark, root).collect()) == ["d/ReadMe-x.md", "d/a b.md"]
    got = files.read_markdown(spark, root, any_readme=True).collect()
    assert [(r.file, r.raw) for r in got] == [("d/a b.md", "---\nclause: 1\n---\nü\n")]


def test_markdown_is_not_listed_by_the_driver(spark, tmp_path):
    root = str(tmp_path / "a b%20+{x}")
    text = {f"d{i % 3}/{i:03d} ü+%41.md": f"text {i}\r\n" * (i % 4) for i in range(100)} | {"_d/_x.md": "x", ".h/.y.md": "y", "d0/latin.md": "z"}
    sinks.write_texts(spark.createDataFrame([*text.items(), ("d0/README.md", "no"), ("d0/deep/z.md", "no"), ("_maps/m.md", "no"), ("top.md", "no"), ("d0/x.txt", "no")], "file string, raw string"), root)
    with open(os.path.join(root, "d0/latin.md"), "wb") as f:
        f.write(b"\xff\n")
    for at in (root, f"file://{root}"):
        d = files.read_markdown(spark, at)
        assert not d.inputFiles()  # no file is known to the driver before it is read
        got = {r.file: bytes(r.raw) for r in d.select("file", F.col("raw").cast("binary").alias("raw")).collect()}
        assert got == {k: v.encode() for k, v in text.items()} | {"d0/latin.md": b"\xff\n"}
    put(root, "d1/big.md", "x" * (20 << 20))
    assert files.read_markdown(spark, root).agg(F.max(F.length("raw"))).collect()[0][0] == 20 << 20
    os.makedirs(tmp_path / "empty")
    assert files.read_markdown(spark, str(tmp_path / "empty")).collect() == []


def test_json_maps(spark, tmp_path):
    root = str(tmp_path)
    put(root, "a.json", json.dumps({"doc": "A", "pdf_file": "a.pdf", "fragments": [{"clause": "1", "kind": "x", "doc": "no"}, None]}))
    put(root, "b.json", json.dumps({"pdf_file": None, "fragments": None}, indent=1))
    put(root, "_all.json", "{}")
    schema = "doc string, pdf_file string, fragments array<struct<clause:string,kind:string,doc:string>>"
    m = files.read_json_objects(spark, root, schema)
    assert sorted(r.file for r in m.collect()) == ["a.json", "b.json"]
    assert [tuple(r) for r in files.merge_maps(m).collect()] == [("A", "a.pdf", "a.json", 0, "1", "x")]
    put(root, "c.json", "{broken")
    with pytest.raises(Exception):
        files.read_json_objects(spark, root, schema).collect()


def test_configuration(spark):
    d = {"a": [], "b": 1}
    assert files.layered_config(d, {"a": ["f"], "b": 2}, {"a": ["x, y", " ,z"], "b": None}) == {"a": ["x", "y", "z"], "b": 2}
    assert files.arguments('{"x": 1}') == {"x": 1} and files.arguments("{") == {} and files.arguments(None) == {}
    assert files.capabilities(["sh", "no-such-tool-here"]) == {"sh": True, "no-such-tool-here": False}
    t = spark.createDataFrame([("Pages:  12\nTitle: a: b\nPages: 3\nx",)], "t string").select(files.key_value_lines(F.col("t")).alias("m")).collect()[0].m
    assert t == {"Pages": "12", "Title": "a: b"}
    p = spark.createDataFrame([("m/src/a/B.java",), ("m/src/a/B.java",), ("n/a/C.kt",), ("n/a/D.txt",)], "path string")
    assert [r.path for r in files.scoped_paths([p, p]).collect()] == ["m/src/a/B.java", "n/a/C.kt"]
    assert [r.path for r in files.scoped_paths([p], below=["src.a"], kind="package").collect()] == ["m/src/a/B.java"]
    assert [r.path for r in files.scoped_paths([p], below=["n/a/C.kt"], kind="file").collect()] == ["n/a/C.kt"]


def test_pdf_pages_need_a_reader(spark, tmp_path):
    try:
        import pypdf  # noqa: F401
    except ImportError:
        put(str(tmp_path), "a.pdf", "x")
        with pytest.raises(RuntimeError):
            files.read_pdf_pages(spark, str(tmp_path))


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("d", "7.10", None), ("d", "7.2", "ü")], "doc string, clause string, file string")
    p = str(tmp_path / "x" / "m.json")
    assert sinks.write_manifest(d, p) == 2
    text = open(p, encoding="utf-8").read()
    assert text.endswith("]\n") and "ü" in text and [r["clause"] for r in json.loads(text)] == ["7.2", "7.10"] and json.loads(text)[1]["file"] is None
    with pytest.raises(ValueError):
        sinks.write_manifest(d, p, most=1)
    sinks.write_object({"a": 1}, p)
    assert json.load(open(p)) == {"a": 1} and os.listdir(os.path.dirname(p)) == ["m.json"]
    v = spark.createDataFrame([("error", "x"), ("error", "x"), ("warning", "y")], "severity string, check string")
    assert sinks.report(v) == ({"checks": {"x": 2, "y": 1}, "ok": False, "hard_failures": ["x"], "warnings": ["y"]}, 1)
    assert sinks.report(v.where("severity = 'warning'"))[1] == 0
    f = spark.createDataFrame([('a"b\nc', ["x ", ""], True)], "t string, l array<string>, b boolean")
    fm = f.select(sinks.frontmatter_text(("topic", F.col("t")), ("tags", (F.col("l"), "list")), ("dirty", (F.col("b"), "bool")), ("none", F.lit(None).cast("string"))).alias("x")).collect()[0].x
    assert fm == '---\ntopic: "a\\"b\\nc"\ntags: ["x"]\ndirty: true\n---\n'
    sinks.write_texts(spark.createDataFrame([("q/a.md", "hello")], "file string, raw string"), str(tmp_path))
    assert open(tmp_path / "q" / "a.md").read() == "hello"
    sinks.write_texts(spark.createDataFrame([("q/a.png", bytearray(b"\x89PNG")), ("q/b.png", None)], "file string, raw binary"), str(tmp_path))
    assert open(tmp_path / "q" / "a.png", "rb").read() == b"\x89PNG" and not os.path.exists(tmp_path / "q" / "b.png")
    sinks.write_json_lines(d, str(tmp_path / "lines"), "clause")
    assert spark.read.json(str(tmp_path / "lines")).count() == 2
    idx = sinks.nested_index(spark.createDataFrame([("d", 1)], "doc string, offset int"), spark.createDataFrame([("d §1", "f")], "key string, file string"), d.select("doc", "clause"))
    assert idx["docMeta"] == {"d": {"offset": 1}} and idx["linkIndex"]["byClause"] == {"d §1": "f"} and len(idx["fragments"]) == 2


def test_index_of_any_size(spark, tmp_path):
    docs = [(f'd "{i}"' + "ü" * (i % 7), None if i % 5 else i, "x\n    },\n") for i in range(300)]
    meta = spark.createDataFrame([*docs, ("byClause", 1, "{"), ("fragments", 2, "[")], "doc string, page_offset int, clean string").repartition(7)
    links = spark.createDataFrame([(f"d §{i}", f"{i}.md" if i % 3 else None) for i in range(200)], "key string, file string")
    fragments = spark.createDataFrame([(i, ["a", str(i)], (i, None)) for i in range(100)], "frag_id long, figures array<string>, s struct<a:long,b:string>").coalesce(1)
    p, q = str(tmp_path / "m" / "i.json"), str(tmp_path / "q.json")
    for n in (10_000, 0):
        some = [d.limit(n) if not n else d for d in (meta, links, fragments)]
        sinks.write_index(*some, p)
        sinks.write_object(sinks.nested_index(*some), q)
        assert open(p, encoding="utf-8").read() == open(q, encoding="utf-8").read() and os.listdir(tmp_path / "m") == ["i.json"]
        want = json.load(open(p))
        for within, part in ((("docMeta",), want["docMeta"]), (("linkIndex", "byClause"), want["linkIndex"]["byClause"]), (("fragments",), want["fragments"])):
            for block in (1 + os.path.getsize(p) // 60, 1 << 20):
                got = [json.loads(r.entry) for r in sorted(files.read_entries(spark, p, *within, block=block).collect())]
                assert got == ([{k: v} for k, v in part.items()] if isinstance(part, dict) else part)
    sinks.write_object({"a": {"b": {"c": 1}, "d": 2, "b2": "x" * 9}}, p)
    for block in (1, 2, 5):
        assert sorted(tuple(r) for r in files.read_entries(spark, p, "a", block=block).collect()) == [(0, '{"b": {\n      "c": 1\n    }}'), (1, '{"d": 2}'), (2, '{"b2": "xxxxxxxxx"}')]
    with pytest.raises(ValueError):
        files.read_entries(spark, p, "nothing")


def test_index_file_has_no_bound(spark, data, monkeypatch):
    from sheaf.plans import registry

    monkeypatch.setattr(sinks.nested_index, "__defaults__", (10,))
    got = registry.queries()["index_file"](spark, data)
    assert {r.part: r.n for r in got.groupBy("part").agg(F.count("*").alias("n")).collect()}["fragments"] > 10


def test_manifest_file_has_no_bound(spark, data, tmp_path, monkeypatch):
    from sheaf.plans import registry

    # All defaults of the sink as small as they may be: only a bound that is asked for refuses.
    monkeypatch.setattr(sinks.write_manifest, "__defaults__", tuple(10 if isinstance(x, int) else x for x in sinks.write_manifest.__defaults__))
    got = registry.queries()["manifest_file"](spark, data)
    n = spark.read.parquet(f"{data}/manifest.parquet").count()
    assert n > 10 and sorted(r.place for r in got.collect()) == list(range(n))


def test_manifest_layout_and_places(spark, tmp_path):
    rows = [(f"d{i % 3}", f"{i % 7}.{i}" if i % 11 else None, 'q"\n  },\n  {' + "ü" * (i % 5), i) for i in range(400)]
    d, p = spark.createDataFrame(rows, "doc string, clause string, title string, n long").repartition(5), str(tmp_path / "m.json")
    for some in (d, d.limit(0)):
        n = sinks.write_manifest(some, p)
        text = open(p, encoding="utf-8").read()
        want = json.loads(text)
        assert text == json.dumps(want, ensure_ascii=False, indent=2) + "\n" and sorted(map(repr, want)) == sorted(repr(r.asDict()) for r in some.collect()) and len(want) == n
        for block in (1 + len(text) // 50, 1 << 20):
            got = files.read_entries(spark, p, block=block).collect()
            assert [json.loads(r.entry) for r in sorted(got)] == want and sorted(r.place for r in got) == list(range(n))


def test_orphan_stream_equals_one_batch(spark, tmp_path):
    from test_operators import _events

    _, d = _events(spark, 9)
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    n = d.withColumn("b", F.pmod(F.xxhash64("key", "at", "kind", "row_id"), F.lit(2)))
    for i in (0, 1):
        n.where(f"b = {i}").drop("b").coalesce(1).write.mode("append").parquet(src)
        q = maintain.orphan_stream(spark.readStream.schema(maintain.EVENTS).parquet(src), state, str(tmp_path / "cp"))
        q.awaitTermination()
    got = sorted((r.row_id, r.state) for r in maintain.orphan_states(spark, state).where("state is not null").collect())
    want = sorted((r.row_id, r.state) for r in orphans.OrphanState.empty(d).open_orphans().collect())
    assert got == want and want


def test_orphan_store_rewrites_touched_buckets_only(spark, tmp_path):
    from test_operators import _events

    ev, d = _events(spark, 11)
    root = str(tmp_path / "state")
    store = maintain.OrphanStore(spark, root, 8)
    n = d.withColumn("b", F.pmod(F.xxhash64("key", "at", "kind", "row_id"), F.lit(3)))
    for i in (0, 1, 1, 2):  # a batch comes twice
        store.advance(n.where(f"b = {i}").drop("b"), i)
    one = spark.createDataFrame([("new", None, 2, "t", 9999)], "key string, at timestamp, kind int, tbl string, row_id long")
    store.advance(one, 3)
    assert [x for x in os.listdir(f"{root}/states/v=4") if x.startswith("b=")] == [x for x in os.listdir(f"{root}/states/v=4") if x.startswith("b=")][:1]
    want = orphans.OrphanState.empty(d.unionByName(one))
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert plain(store.states().where("state is not null")) == plain(want.open_orphans())
    assert plain(store.snapshot()) == plain(want.snapshot()) and store._steps() == [3, 4]


def test_streaming_aggregates(spark, tmp_path):
    src = str(tmp_path / "log")
    spark.createDataFrame([("a", "1", "2024-01-01 00:10:00"), ("a", "2", "2024-01-01 01:00:00"), ("b", "x 5", "2024-01-01 00:20:00")], "k string, v string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(src)
    s = spark.readStream.schema("k string, v string, at timestamp").parquet(src)
    q = maintain.latest_state_stream(s, "k", "v", "at").writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.k, r.v) for r in spark.table("latest").collect()) == [("a", "2"), ("b", "x 5")]
    q = maintain.message_counts_stream(s, "v", "at").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.template, r.n) for r in spark.table("counts").collect()) == [("#", 1), ("#", 1), ("x #", 1)]
