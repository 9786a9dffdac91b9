"""Queries against their DuckDB twins, and their steps, on rows that the small tables lack."""

import duckdb
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import extract, extraction, protocol
from prosemill.plans import catalogue

TEXTS = {
    4471: "coo.79@mail2.example.com Que de la",
    8745: "kanghbhh.54@mail3.example.com Ingerha the",
    31363: "20.118.157.107 Betz das",
    4838: "name.ext of it",
    0: "zzqqxx.com is",
    1: "x.y",
    2: "of a.b c",
}


def both(spark, tmp_path, name):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    frame = catalogue.QUERIES[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(frame.columns)} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    return sorted(map(tuple, frame.collect()), key=str), sorted(want, key=str)


def test_ends_of_addresses_are_no_names(spark, tmp_path):
    got, want = both(spark, tmp_path, "proposal_reject_codes")
    assert got == want and [r for r in got if r[2] == "protected_range"] == [(4838, 1, "protected_range")]


def test_histogram_counts_no_ends_of_addresses(spark, tmp_path):
    got, want = both(spark, tmp_path, "category_histogram")
    assert got == want and dict(got)["protected_range"] == 1


def test_pages_of_many_ranges_are_full(spark):
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ("false", "8"), strict=True):
            spark.conf.set(n, v)
        paths = spark.range(20_000, numPartitions=4).select(F.format_string("p%09d", "id").alias("path"), F.col("id").alias("n"))
        rows = protocol.pages(paths).select("n", "page").collect()
        assert sorted((r.n, r.page) for r in rows) == [(n, n // 16) for n in range(20_000)]
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)


def test_comment_rows_are_dealt_once(spark, capsys):
    files = spark.createDataFrame([(1, "x(); // a\n/* prose-disable */\n// b\n/* prose-enable */\n/** c \u00a0*/")], "k long, text string")
    rows = extract.code_lines(files, "k", "typescript")
    rows.explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
    assert sorted((r.line, r.inner, r.outcome) for r in rows.collect() if r.directive is None) == [(1, "a", "segment"), (3, "b", "suppressed"), (5, "c", "segment")]


def test_marks_of_the_texts_own_count_as_letters(spark, tmp_path, monkeypatch):
    words = ["one\r", "two\u00a0 of", "\tthree", "fo\x01ur is", "a\x07b", "\ufefffive.", "six\x7f\u3000", "\u00e9\x0b", "x.y\t z"]
    monkeypatch.setitem(globals(), "TEXTS", {40 * k + i: "\n".join([w, "and", w + "\r"]) for k, w in enumerate(words) for i in range(36)})
    got, want = both(spark, tmp_path, "category_histogram")
    assert got == want and len(got) == 8


def test_protected_ranges_of_segments_are_found_once(spark, monkeypatch, capsys):
    monkeypatch.setattr(extraction, "checkpointed", lambda df: df)
    files = spark.createDataFrame([("a.md", "markdown", "See --flag and my_name.\nMore of x.y\n\nhttps://h.example/a\n")], "path string, format string, text string")
    found = extraction.extracted(files, ["markdown"]).segments
    found.explain()
    assert capsys.readouterr().out.count("<[A-Z][A-Z0-9_-]*>") == 1
    assert [(r.segment, r.line, r.text, [tuple(x) for x in r.ranges]) for r in found.collect()] == [(1, 1, "See --flag and my_name.\nMore of x.y", [(4, 10), (15, 22), (32, 35)])]


def test_hints_hide_no_identifiers(spark):
    texts = ["my_name", "aB", "x.y", "none here.", "A.b-c", "_", "a. b", "é.x", "", None, "a\0my_b\0", "-.x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.protected_ranges("t", families=("identifier",)).alias("a"), T.match_ranges("t", T.PROTECTED["identifier"]).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and sum(map(bool, (r.a for r in rows))) >= 5


def test_long_segments_are_cut_in_one_pass(spark, capsys):
    schema = "path string, segment long, line long, start_byte long, end_byte long, text string, ranges array<struct<start_byte:bigint,end_byte:bigint>>"
    rows = spark.createDataFrame([("p", 1, 1, 5, 10, "short", [(5, 7)]), ("p", 2, 2, 20, 42, "One is é. Two is it. ", [(23, 25), (32, 35)]), ("p", 3, 3, 50, 70, "nothingtocutinhereat", []), ("p", 4, 4, 80, 110, "lies. over lines.", [])], schema)
    out = extraction.prepared(rows, 12)
    out.explain()
    assert "Exchange" not in capsys.readouterr().out
    assert [(r.segment, r.part, r.start_byte, r.end_byte, r.text, [tuple(x) for x in r.ranges], r.code) for r in out.orderBy("segment", "part").collect()] == [
        (1, 0, 5, 10, "short", [(5, 7)], None),
        (2, 1, 20, 31, "One is é. ", [(23, 25)], None),
        (2, 2, 31, 42, "Two is it. ", [(32, 35)], None),
        (3, 0, 50, 70, "nothingtocutinhereat", [], "oversized_segment"),
        (4, 0, 80, 110, "lies. over lines.", [], "unmappable_segment"),
    ]


def test_files_without_directives_have_the_same_parts(spark):
    text = "---\na: b\n---\n# Head\n\nOne\n> two *three*\nfour `c` ![alt\ntext](x) &amp;\n\n- a\r\n  b\n\n<div>\n\n[x]: y\n"
    files = spark.createDataFrame([("plain", text), ("named", text + "\nno-disable\n"), ("none", None)], "k string, text string")
    rows = extract.markdown_parts(files, "k").collect()
    told = lambda k: sorted(tuple(r)[1:] for r in rows if r.k == k and r.raw != "no-disable")
    assert len(told("plain")) > 8 and told("plain") == told("named") and {r.k for r in rows} == {"plain", "named"}
