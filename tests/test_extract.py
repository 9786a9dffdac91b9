"""Extraction keeps byte provenance and leaves protected constructs out."""

import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from prosemill.operators import extract, markdown, script, table_functions

MARKDOWN = """---
title: x
---
# A héading 😀 here

Some *emphatic* text with `code` and [a label](http://x.y/z).
<!-- prose-disable -->
Hidden words.
<!-- prose-enable -->
```
fenced words
```
> quoted text
An &amp; entity here.
<!-- prose-disable-next-line -->
Skipped line.
Last line ![alt text](i.png) end
"""
JAVA = """/** Docs of a class.
 * @param x gone
 * Uses <b>html</b> here.
 */
class A { String s = "// not a comment"; // real comment é
  /* block starts
     and goes on */ int x;
  // eslint-disable-line
  // prose-disable
  // off
  // prose-enable
}
"""


def check(rows, source):
    raw = source.encode()
    for r in rows:
        assert raw[r.start_byte : r.end_byte].decode() == r.text


def test_markdown(spark):
    files = spark.createDataFrame([(1, MARKDOWN)], "f int, text string")
    rows = extract.markdown_segments(files, "f").orderBy("segment").collect()
    check(rows, MARKDOWN)
    assert [r.text for r in rows] == ["A héading 😀 here", "Some ", "emphatic", " text with ", " and ", "a label", "Last line ", "alt text", " end"]
    parts = extract.markdown_parts(files, "f")
    codes = {(r.line, r.code) for r in extract.markdown_diagnostics(parts, "f").collect()}
    assert (1, "protected_frontmatter") in codes and (13, "protected_markdown_construct") in codes


#: Files, and what of them may be edited: pieces with their place in the file's text.
INLINE = [
    ("Line with `code\nover lines` after", ["Line with ", " after"]),
    ('a <span\ntitle="some words">x</span> b', ["a ", "x", " b"]),
    ("see [label][ref words] on\n\n[ref  Words]: http://x.y 'T'", ["see ", "label", " on"]),
    ("see [label][no words] on", ["see [label][no words] on"]),
    ("[^1]: note words here\n\nwords[^1] and [^2] on", ["note words here", "words", " and [^2] on"]),
    ("> quote *one\n> two* three\n> four  \n> five\nlazy *a*", ["quote ", "one\n> two", " three\n> four", "five\nlazy ", "a"]),
    ("a\r\n**b**\r\nc\\\r\nd", ["a\r\n", "b", "\r\nc", "d"]),
    ("1. one\n2. two\n   more\n\n   para\n- [x] done", ["one", "two\n   more", "para", "done"]),
    ("e_f_g _h_ ***i*** *j **k*", ["e_f_g ", "h", "i", " *j *", "k"]),
    ("*a [b* c](d) ![e *f* g](h) [i ![j](k) l](m)", ["*a ", "b* c", "e *f* g", "i ", "j", " l"]),
    ("[a [b](c) d](e)", ["[a ", "b", " d](e)"]),
    ("| a | b \\| c |\n|---|:-:|\n| d *e* | `f` | gone |", ["a", "d ", "e"]),
    ("Head\n====\n\n# ATX *x* ##\n#hash\n***\ntail", ["Head", "ATX ", "x", "#hash", "tail"]),
    ("~~a~~ ~b~ ~~~c", ["a", "b", " ~~~c"]),
    ("see http://a.b/c(d)). and me@x.org or <http://e.f> now", ["see ", "http://a.b/c(d)", "). and ", "me@x.org", " or ", "http://e.f", " now"]),
    ("text <!-- c\nd --> z", ["text ", " z"]),
    ("[a]: <x y> 'title\nmore'\n[b]:\nz\nrest [a] [b][] [c]", ["rest ", "a", "b", " [c]"]),
    ("- a\n\n      code\n\n  b\n\n> - c\n> d", ["a", "b", "c\n> d"]),
    ("~~~\nno ```\n~~~~\n<pre>\n\nno\n</pre>\nyes", ["yes"]),
    ("\\*x\\* words", []),
]


@pytest.mark.parametrize(("source", "want"), INLINE)
def test_markup_over_lines_and_nests(source, want):
    rows = markdown.nodes(source)
    assert [source[a:b] for kind, a, b, _ in rows if kind in ("text", "alt") and re.search("[^\\W\\d_]", source[a:b]) and "\\" not in source[a:b]] == want


def test_nodes_in_spark_keep_their_bytes(spark):
    files = spark.createDataFrame(list(enumerate(s for s, _ in INLINE)), "f int, text string")
    for r in extract.markdown_segments(files, "f").collect():
        assert INLINE[r.f][0].encode()[r.start_byte : r.end_byte].decode() == r.text and r.text in INLINE[r.f][1]


def test_directives_cut_a_node_into_islands(spark):
    source = "One é\r\ntwo <!-- prose-disable -->\r\nthree\r\nfour <!-- prose-enable --> five\r\nsix\r\n\r\n<!-- prose-disable-next-line -->\r\n> seven\r\n> eight\r\n> nine\r\n"
    files = spark.createDataFrame([(1, source)], "f int, text string")
    parts = extract.markdown_parts(files, "f").orderBy("start_byte").collect()
    for r in parts:
        assert source.encode()[r.start_byte : r.end_byte].decode() == r.raw
    assert [(r.raw, r.line, r.outcome) for r in parts if r.kind == "text"] == [
        ("One é\r\n", 1, "segment"), ("two ", 2, "suppressed"), ("\r\nthree\r\nfour ", 2, "suppressed"), (" five\r\n", 4, "suppressed"), ("six", 5, "segment"), ("seven\r\n", 8, "suppressed"), ("> eight\r\n> nine", 9, "segment"),
    ]
    assert extract.markdown_suppressed(extract.markdown_parts(files, "f"), "f").collect()[0].n == 4


@settings(max_examples=300, deadline=None)
@given(st.text("ab `*_[]()<>!#>-+1.|~\\\r\n&:\"'=", max_size=120))
def test_any_text_gives_ordered_nodes(source):
    rows = [(a, b) for kind, a, b, _ in markdown.nodes(source) if kind in ("text", "alt")]
    assert all(0 <= a < b <= len(source) for a, b in rows) and all(x[1] <= y[0] for x, y in zip(rows, rows[1:], strict=False))


def test_long_hostile_markdown_takes_no_square_time():
    for piece in ("*a ", "[", "`" * 3 + " ", "<a ", "![x](", "_a_*b", "> " * 3, "&a;", "a@", "[x][y] ", "- ", "http://"):
        start = time.time()
        markdown.nodes(piece * (60_000 // len(piece)))
        assert time.time() - start < 20, piece


def test_code(spark):
    rows = extract.code_segments(spark.createDataFrame([(1, JAVA)], "f int, text string"), "f", "java").orderBy("segment").collect()
    check(rows, JAVA)
    assert [r.text for r in rows] == ["Docs of a class.", "real comment é", "block starts", "and goes on"]


def test_python_comments(spark):
    source = 's = "# no"  # yes it is\n# full line\nx = 1\n'
    rows = extract.code_segments(spark.createDataFrame([(1, source)], "f int, text string"), "f", "python").orderBy("segment").collect()
    check(rows, source)
    assert [r.text for r in rows] == ["yes it is", "full line"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("aé😀 `*[]()<>#.-\r\n\\&|", max_size=40), min_size=1, max_size=20))
def test_bytes_are_the_text(spark, texts):
    files = spark.createDataFrame(list(enumerate(texts)), "f int, text string")
    for r in extract.markdown_segments(files, "f").collect():
        assert texts[r.f].encode()[r.start_byte : r.end_byte].decode() == r.text


@pytest.mark.parametrize(("text", "most", "ends"), [("One. Two. Three. Four.", 10, [10, 17, 22]), ("x" * 30, 10, None), ("short", 10, [5]), ("A. é😀. " + "y" * 9, 9, [7, 16])])
def test_split(text, most, ends):
    assert extract.split_ends(text, [], most) == ends


def test_split_keeps_protected_ranges_whole(spark):
    rows = spark.createDataFrame([(1, "Aa bb. cc dd. ee", [(5, 9)])], "k int, text string, ranges array<struct<start_byte:bigint,end_byte:bigint>>")
    assert extract.split_texts(rows, "k", 14).first().ends == [14, 16]


@settings(max_examples=200, deadline=None)
@given(st.text("a. !?\n\r😀", max_size=60))
def test_parts_make_up_the_text(text):
    ends = extract.split_ends(text, [], 10)
    if ends is not None:
        parts = [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert "".join(parts) == text and all(len(p.encode("utf-16-le")) <= 20 for p in parts)


def test_whole_tables_are_extracted(spark, tmp_path):
    """Documents with markup and quotes of their own are extracted too; counts are made by hand."""
    from prosemill.plans import catalogue

    texts = {1: "plain words\nmore", 2: "a *b* [c](http://x.y) `no`", 3: "one & two\nR&amp;D here", 4: 'say "this" here', 5: "don't\nstop", 6: "x /* y\nz"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.segments, r.headings) for r in catalogue.QUERIES["extract_markdown"](spark, str(tmp_path)).collect()}
    assert got == {1: (14, 1), 2: (16, 1), 3: (13, 1), 4: (14, 1), 5: (14, 1), 6: (14, 1)}
    got = {r.doc_id: (r.segments, r.bytes) for r in catalogue.QUERIES["extract_comments"](spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and got[1] == (2, 15) and got[4] == (1, 15) and got[5] == (2, 9)


SOURCES = {
    "typescript": ("const u = `http://host/some words here`; // yes\nconst r = /[/*]\"'/.test(a) ? `a ${b(`// in`)}` : 1; /* two */ // three\n/**\n * Shown.\n * @example\n * gone\n * @returns x\n */\n", ["yes", "two", "three", "Shown."]),
    "go": ("package a\n\nvar s = `\n// not a comment at all\n`\n\n// cgo words\nimport \"C\"\n\n//go:build x\n//\tcode\n// real words\n", ["real words"]),
    "java": ("class A { int x; /* a one */ int y; // b two\n/// markdown doc\n// bad \\u0041 escape\n/** <pre>\n * code\n * </pre> x\n * After words. */ }\n", ["a one", "b two", "After words."]),
    "rust": ("fn f<'a>(x: &'a str) -> char { let s = r#\"// no\"#; '\"' } // yes\n/// Doc words.\n/// ```\n/// code\n/// ```\n/// More words.\n/* outer /* inner */ */ // end\n", ["yes", "Doc words.", "More words.", "end"]),
    "python": ('"""Module words.\n\n>>> example\n# heading line\n"""\n\n\ndef f():\n    "Short doc."\n    return """\n# not this\n"""  # last one\n\n\nclass C:\n    b"bytes"\n', ["Module words.", "# heading line", "Short doc.", "last one"]),
}


@pytest.mark.parametrize("language", SOURCES)
def test_lexers_carry_their_state(spark, language):
    source, want = SOURCES[language]
    files = spark.createDataFrame([(1, source), (2, "({"), (3, None), (4, "")], "f int, text string")
    rows = extract.code_segments(files, "f", language).orderBy("f", "segment").collect()
    check(rows, source)
    assert [r.text for r in rows] == want
    lines = extract.code_lines(files, "f", language)
    codes = {r.code for r in extract.code_diagnostics(lines, "f", language).where("f = 1").collect()}
    assert codes >= {"go": {"protected_cgo_preamble", "protected_comment_construct"}, "java": {"unsupported_java_markdown_doc", "protected_java_unicode_escape", "protected_documentation_construct"}, "python": {"unsupported_python_docstring", "protected_python_doctest"}}.get(language, {"protected_documentation_construct"})
    assert [(r.f, r.code) for r in extract.code_diagnostics(lines, "f", language).where("f <> 1").collect()] == [(2, "parse_error")]
    assert [r.code for r in extract.code_notices(lines, "f", language).collect()] == {"python": ["python_docstring_observable"], "rust": ["rust_documentation_observable"]}.get(language, [])


def test_blocks_that_are_no_prose(spark):
    source = "Text one.\n\n    indented code\n\n<div>\nraw words\n</div>\n\n[a]: http://x.y (title)\n\n```\n~~~\nfenced\n````\n\n- item words\n\n  more item\n\nText two.\n"
    rows = extract.markdown_segments(spark.createDataFrame([(1, source)], "f int, text string"), "f").orderBy("segment").collect()
    check(rows, source)
    assert [r.text for r in rows] == ["Text one.", "item words", "more item", "Text two."]


#: Scripts and the comments in them.
SCRIPTS = [
    ("const a = <p>see http://x.y for teh words</p>; // yes", ["// yes"]),
    ("if (ok) /\\(/.test(s); // a good note", ["// a good note"]),
    ("if (x) /[\"']/.test(y); // see \"this\" note", ['// see "this" note']),
    ("x = (a) / b; /* c */ y = a[0] / 2; // d", ["/* c */", "// d"]),
    ("a = {b: 1} / 2; // e\n{ f() }\n/[/*]/.test(g) // h", ["// e", "// h"]),
    ("i++ / 2 // j\nk! / 2 /* l/ */", ["// j", "/* l/ */"]),
    ("m = `// no ${n /* o */ + `${p}// no`} // no`; // q", ["/* o */", "// q"]),
    ("return <a b='// no' c={/* r */ d} /* s */ e>it's // no {/* t */} {u // v\n} <b.c/> \"</a> // w", ["/* r */", "/* s */", "/* t */", "// v", "// w"]),
    ("f = <T,>(x: T) => x; g = a < b; // h\nh = <T extends U>(y: T) => <></>; /* i */", ["// h", "/* i */"]),
    ("const e = cond ? <A x={<B/>}>// no<C>{`</A>`}</C></A> : /\\/\\//; // z", ["// z"]),
    ("s = 'a\\\nb // no'; t.return / 2 // u\nfor await (const x of y) /=\\//.test(x) // v", ["// u", "// v"]),
    ("#!/usr/bin/env node // no\nx // yes", ["// yes"]),
    ("<Foo<string> a=\"1\">// no</Foo> // p", ["// p"]),
]


@pytest.mark.parametrize(("source", "want"), SCRIPTS)
def test_scripts(source, want):
    assert [source[a:b] for a, b in script.script_comments(source, True)] == want


@pytest.mark.parametrize("source", ["(", "a)", "'x", "`${a`", "/* x", "<a>", "<a></b>", "<a b=>{</a>", "{[}]", "<a {...b}"])
def test_broken_scripts(source):
    assert script.script_comments(source, True) is None


def test_typescript_has_no_markup():
    assert script.script_comments("const a = <any>b; // c", False) == [(18, 22)]


def made_script(rng, depth=0):
    """(text, comments) of an expression that holds comment marks wherever they mean nothing."""
    kind = rng.choice(["word", "string", "regex", "template", "comment", "group", "call", "divide", "tag", "tag", "control", "object"] if depth < 4 else ["word", "string", "regex", "comment"])
    if kind == "word":
        return rng.choice(["a", "b1", "$c", "12", "d.e", "f.of"]), []
    if kind == "string":
        return rng.choice(["'// no'", '"/* no"', "'it\\'s */ //'"]), []
    if kind == "regex":
        return rng.choice(["(/[/*]\\/\\//g)", "(/['\"`]/)", "(/=\\/\\//)"]), []
    inner, found = made_script(rng, depth + 1)
    other, more = made_script(rng, depth + 1)
    if kind == "comment":
        c = rng.choice(["/* yes ' ` < { */", "// yes \" ( </a>\n"])
        return f"({inner} {c} )", [*found, c.rstrip("\n")]
    return {
        "template": (f"`// no ${{{inner}}} /* no ${{ {other} }}`", found + more), "group": (f"[({inner}), {other}]", found + more), "call": (f"f<T>({inner}, {other})", found + more),
        "divide": (f"({inner}) / ({other}) / 2", found + more), "tag": (f"(<a.b c='// no' d={{{inner}}}>it's // no \" /* {{{other}}} no */ <e/></a.b>)", found + more),
        "control": (f"(() => {{ if ({inner}) /'\\//.test(x); return {other} }})", found + more), "object": (f"({{k: {inner}, m: {{n: {other}}}}})", found + more),
    }[kind]


def test_made_scripts_offer_comments_and_nothing_else():
    for seed in range(400):
        rng, source, want = random.Random(seed), "", []
        for _ in range(6):
            text, found = made_script(rng)
            c = rng.choice(["", " // yes it's", " /* yes\n // \" */"])
            source += f"x = {text};{c}\n"
            want += [*found, *([c.strip()] if c else [])]
        got = script.script_comments(source, True)
        assert got is not None and [source[a:b] for a, b in got] == want, source


def test_table_function_equals_extraction(spark):
    table_functions.register(spark)
    sources = [s for s, _ in INLINE] + [MARKDOWN, "One\ntwo <!-- prose-disable -->\nthree\n\nfour <!-- prose-enable --> five\nsix\n\n<!-- prose-disable-next-line -->\n> seven\n> eight\n", "x\n<!-- prose-disable -->\ny", "", "\\_ a", "a\\\u00e9 b &#x41; c {#id} d"]
    files = spark.createDataFrame([*enumerate(sources), (1000, None)], "f int, text string")
    files.createOrReplaceTempView("some_files")
    columns = ["line", "start_byte", "end_byte", "text", "heading"]
    want = [(str(r.f), r.segment, *(r[c] for c in columns)) for r in extract.markdown_segments(files, "f").collect()]
    got = [(r.file, r.segment, *(r[c] for c in columns)) for r in spark.sql("select * from prose_segments(table(select f, text from some_files) partition by f)").collect()]
    assert sorted(got) == sorted(want) and len(want) > 60
