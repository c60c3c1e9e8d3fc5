"""Rows that queries once left out, on small tables of their own."""

from sheaf.plans import registry


def run(spark, root, name, **tables):
    for t, rows in tables.items():
        spark.createDataFrame(*rows).write.mode("overwrite").parquet(f"{root}/{t}.parquet")
    return registry.queries()[name](spark, str(root)).collect()


def test_long_lines_are_problems(spark, tmp_path):
    long = "Code 0x1F " + "and on and on " * 40 + "until `timer` 7"
    assert len(long) > 400
    rows = [(i, f"reviews/{i}", f"short 1\nno number\n{long}") for i in range(3)]
    docs = {"documents": (rows, "doc_id long, source string, text string")}
    template = long.replace("7", "#")
    types = {r.template: r for r in run(spark, tmp_path, "message_types", **docs)}
    assert set(types) == {"short #", template}
    assert (types[template].n, types[template].n_files, types[template].severity, types[template].examples, types[template].doc_id, types[template].line) == (3, 3, "WARNING", "\n".join([long] * 3), 0, 3)
    # All files are reviews, which a rule ignores: nothing is actionable, so nothing recurs.
    assert run(spark, tmp_path, "recurring_messages") == []
    assert sum(r.message == long for r in run(spark, tmp_path, "message_examples")) == 3
    assert sorted((r.doc_id, r.line, r.bucket) for r in run(spark, tmp_path, "policy_routing")) == [(i, n, b) for i in range(3) for n, b in ((1, "outOfScope"), (3, "ignored"))]
    assert {r.bucket: r.n for r in run(spark, tmp_path, "policy_counts")} == {"outOfScope": 3, "ignored": 3}


def test_recurring_long_messages(spark, tmp_path):
    long = "Code 0x1F " + "and on and on " * 40 + "until `timer` 7"
    rows = [(i, f"notes/{i % 12:02d}", f"short 1\n{long}") for i in range(24)] + [(99, None, long)]
    got = run(spark, tmp_path, "recurring_messages", documents=(rows, "doc_id long, source string, text string"))
    assert [(r.template, r.occurrences, r.n_files, r.example, r.files) for r in got] == [
        ("short #", 24, 12, "short 1", files := " ".join(f"notes/{i:02d}" for i in range(10))), (long.replace("7", "#"), 25, 12, long, files),
    ]


def test_frontmatter_of_tags_with_tabs_and_line_ends(spark, tmp_path):
    rows = [(1, "- research\n* Java\r\n- codebase", None), (2, "research\tweb, a\\b", True), (3, "research, web", False), (4, None, None)]
    rows = [(i, 'R "x"', "t", tags, dirty) for i, tags, dirty in rows]
    got = {r.research_id: r.frontmatter for r in run(spark, tmp_path, "emitted_frontmatter", research_doc=(rows, "research_id long, researcher string, topic string, tags string, dirty boolean"))}
    head = '---\nresearcher: "R \\"x\\""\ntopic: "t"\n'
    assert got == {
        1: head + 'tags: ["- research\\n* Java\\r\\n- codebase"]\n---\n',
        2: head + 'tags: ["research\\tweb", "a\\\\b"]\ndirty: true\n---\n',
        3: head + 'tags: ["research", "web"]\ndirty: false\n---\n',
        4: head + "---\n",
    }


def test_as_of_lookups_of_every_page_list(spark, tmp_path):
    lists = ["5", "p.26", '"23-24"', "94-90", "x", None, ""]
    outline = [(1, "1 One", 3), (1, "2 Two", 20), (1, "3 Three", 30)]
    tables = {
        "fragments": ([(i, "a.pdf", p) for i, p in enumerate(lists)], "frag_id long, pdf_file string, pdf_pages string"),
        "probe": ([(1, "in/a.pdf", 99, outline, "2024-01-01")], "probe_id long, pdf string, pages int, outline array<struct<level:int,title:string,page:int>>, probed_at string"),
    }
    first = {0: 5, 1: 26, 2: 23, 3: 94, 4: None, 5: None, 6: None}
    got = {r.frag_id: (r.first_page, r.next_boundary) for r in run(spark, tmp_path, "next_boundary", **tables)}
    assert got == {i: (p, {5: 20, 26: 30, 23: 30}.get(p)) for i, p in first.items()}
    got = {r.frag_id: (r.first_page, r.section_page) for r in run(spark, tmp_path, "owning_section")}
    assert got == {i: (p, {5: 3, 26: 20, 23: 20, 94: 30}.get(p)) for i, p in first.items()}


def test_figure_names_of_long_numbers_and_many_repeats(spark, tmp_path):
    rows = [(0, "a.pdf", ["100", "7"]), *((i, "a.pdf", ["3"]) for i in range(1, 704))]
    got = {(r.frag_id, r.fig): r.name for r in run(spark, tmp_path, "figure_names", fragments=(rows, "frag_id long, pdf_file string, figures array<string>"))}
    assert len(got) == 705 and got[0, "100"] == "figure-100" and got[0, "7"] == "figure-07"
    assert [got[i, "3"] for i in (1, 2, 26, 27, 28, 52, 53, 702, 703)] == [f"figure-03{x}" for x in ("", "b", "z", "aa", "ab", "az", "ba", "zz", "aaa")]
