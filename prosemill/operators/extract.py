"""Prose of Markdown and source files, from the lines of their blocks and comments.

Scanners in lexer.py say where text nodes and comments are. Suppression,
islands, examples and other state that runs down a file are windows over their
lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACE, SPACES, byte_length, has_letter
from . import lexer, segments

# Constructs of a Markdown text that may not be edited.
MARKDOWN_PROTECTED = "(?i)\\{#[A-Za-z][^}]*\\}|\\\\[^\\p{L}\\p{N}\\s]|&(?:#\\d+|#x[0-9a-f]+|[a-z]+);"
_WORD_END = "(?![A-Za-z0-9_])"
# Comment lines that belong to tools.
PRAGMA = "(?i)^(?:eslint|prettier|istanbul|webpack|sourceMappingURL|@ts-|jshint|jslint)(?![A-Za-z0-9_])"
# Lines that say that a file is generated.
GENERATED_MARKERS = {
    "go_do_not_edit": "(?im)^[ \\t]*(?:<!--[ \\t]*)?(?:(?:/[/!*]|\\*|#)[ \\t]*)?Code generated .+ DO NOT EDIT\\.[ \\t]*(?:\\*/|-->)?[ \\t]*$",
    "protoc_banner": "(?im)^[ \\t]*(?:<!--[ \\t]*)?(?:(?:/[/!*]|\\*|#)[ \\t]*)?Generated by the protocol buffer compiler\\.?[ \\t]*(?:\\*/|-->)?[ \\t]*$",
    "generated_annotation": "(?im)^[ \\t]*(?:<!--[ \\t]*)?(?:(?:/[/!*]|\\*|#)[ \\t]*)?@generated(?![A-Za-z0-9_]).*?(?:-->)?[ \\t]*$",
    "auto_generated_region": "(?i)<auto-generated\\s*/?\\s*>",
}
# Lines of documentation that a language gives a meaning.
GO_LINE = f"\\A(?:go:|\\+build{_WORD_END}|#cgo{_WORD_END}|#[{SPACE}]|\\[.+\\]\\z)"
SCRIPT_DOC = f"\\A@[A-Za-z]+{_WORD_END}|\\{{@[A-Za-z]+{_WORD_END}|```"
JAVA_DOC = f"\\{{@(?:code|literal|link|linkplain|value|docRoot|inheritDoc|index|summary|systemProperty|snippet){_WORD_END}|\\A@(?:param|return|throws|exception|see|since|author|version|deprecated|serial|hidden|uses|provides){_WORD_END}"
RUST_DOC = f"\\A#(?:[{SPACE}]|\\z)|`|\\[[^\\]]+\\]\\([^)]*\\)|<[^>]+>"
DOC_CONSTRUCT = f"(?m)@(?:example|snippet){_WORD_END}|```|^\\s*#(?:\\s|$)|</?(?:pre|code|snippet){_WORD_END}|^//(?: {{5,}}|\\t)"

def _directive(body: Column, prefix: str, opening: str, closing: str) -> Column:
    """disable, enable or next, for a comment that is a directive and nothing else."""
    kind = F.regexp_extract(body, f"\\A\\s*{opening}\\s*{prefix}-(disable-next-line|disable|enable)\\s*{closing}\\s*\\z", 1)
    return F.when(kind == "disable-next-line", "next").when(kind != "", kind)


def markdown_parts(files: DataFrame, key: str, text: str = "text", prefix: str = "prose") -> DataFrame:
    """Nodes of Markdown files with what becomes of them.

    (key, node, island, kind, line, start_byte, end_byte, raw, heading, directive, outcome).
    A text node that runs over several lines stays whole unless directives
    change their mind within it; then it is cut into islands of lines that are
    all on or all off. outcome is segment, suppressed, protected_markdown_construct,
    protected_frontmatter or empty (nothing to edit).
    """
    # windows over lines are for files that may hold a directive; nodes of others are whole as they are found, and stay where they are
    named = F.col(text).contains("-disable") | F.col(text).contains("-enable")
    plain = lexer.markdown_nodes(files.where(~named), key, text, whole=True).drop("part")
    plain = plain.withColumns({"island": F.lit(0).cast("long"), "directive": F.lit(None).cast("string"), "disabled": F.lit(False)})
    rows = lexer.markdown_nodes(files.where(named), key, text)
    html = F.col("kind") == "html"
    rows = _suppressed_lines(rows.withColumn("comment", F.col("node")).withColumn("directive", F.when(html, _directive(F.col("raw"), prefix, "<!--", "-->"))), key)
    of_node = Window.partitionBy(key, "node").orderBy("part")
    changed = F.coalesce((F.col("disabled") != F.lag("disabled").over(of_node)).cast("int"), F.lit(0))
    # node and island are functions of what rows are dealt by, so nothing moves again
    marked = rows.withColumn("island", F.sum(changed).over(of_node))
    lines = F.array_sort(F.collect_list(F.struct("part", "raw", "start_byte", "line")))
    first = {"kind": F.first("kind"), "heading": F.first("heading"), "directive": F.first("directive"), "disabled": F.first("disabled"), "lines": lines}
    merged = marked.groupBy(key, "node", "island").agg(*(c.alias(n) for n, c in first.items()))
    merged = merged.withColumns({"raw": F.array_join(F.transform("lines", lambda x: x["raw"]), ""), "start_byte": F.get("lines", F.lit(0))["start_byte"], "line": F.get("lines", F.lit(0))["line"]}).drop("lines").unionByName(plain)
    prose = F.col("kind").isin("text", "alt")
    outcome = (
        F.when(F.col("kind") == "front", "protected_frontmatter").when(~prose, "protected_markdown_construct")
        .when(F.col("disabled"), F.when(has_letter("raw"), "suppressed").otherwise("empty"))
        .when(F.col("raw").rlike(MARKDOWN_PROTECTED), "protected_markdown_construct").when(has_letter("raw"), "segment").otherwise("empty")
    )
    return merged.select(key, "node", "island", "kind", "line", "start_byte", (F.col("start_byte") + byte_length("raw")).alias("end_byte"), "raw", "heading", "directive", outcome.alias("outcome"))


def markdown_segments(files: DataFrame, key: str, text: str = "text", prefix: str = "prose") -> DataFrame:
    """(key, segment, line, start_byte, end_byte, text, heading): editable pieces with their bytes in the file."""
    return part_segments(markdown_parts(files, key, text, prefix), key)


def part_segments(parts: DataFrame, key: str) -> DataFrame:
    placed = parts.where("outcome = 'segment'").withColumnRenamed("raw", "text")
    return placed.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("start_byte")).cast("long")).select(key, "segment", "line", "start_byte", "end_byte", "text", "heading")


def markdown_diagnostics(parts: DataFrame, key: str) -> DataFrame:
    """(key, line, code) from markdown_parts(): front matter, lines with protected constructs (each once), and directives that don't pair."""
    kept = parts.where("outcome like 'protected%'").select(key, "line", F.col("outcome").alias("code")).distinct()
    return kept.unionByName(segments.directive_diagnostics(parts.where("kind = 'html'"), key))


def markdown_suppressed(parts: DataFrame, key: str) -> DataFrame:
    """(key, n): pieces that directives take out, by file, from markdown_parts()."""
    return parts.where("outcome = 'suppressed'").groupBy(key).agg(F.count("*").alias("n"))


def code_lines(files: DataFrame, key: str, language: str, text: str = "text", prefix: str = "prose") -> DataFrame:
    """Lines of comments and docstrings with what becomes of them, one row each.

    Adds to the lexer's rows: ``inner``, the text without comment marks, its
    ``start`` and ``end`` bytes, ``doc``, ``directive``, ``disabled`` and
    ``outcome``: segment, suppressed, protected_comment_construct,
    protected_java_unicode_escape, empty (nothing to edit), passed (left out as a
    whole: Java's ///, comments before import "C", code in comments), or the
    lexer's parse_error and unsafe_docstring.
    """
    rows = lexer.comment_lines(files, key, language, text)
    docstring, first = F.col("kind") == "docstring", F.col("part") == 0
    # directives are whole comments; only those that name one are taken apart
    plain = F.regexp_replace(F.regexp_replace("whole", "\\A/[/!*]+|\\A#+|\\*+/\\z", ""), f"(?m)^[{SPACE}]*\\* ?", "")
    named = F.col("whole").contains("-disable") | F.col("whole").contains("-enable")
    kind = F.when((F.col("kind") == "comment") & first & named, _directive(plain, prefix, "", ""))
    # the rows are dealt by file once, before texts are cut out of them; windows over comments find them in place
    rows = _suppressed_lines(rows.withColumn("directive", kind), key)
    marked = {"rust": "\\A(?:///|//!|/\\*\\*|/\\*!)", "java": "\\A/\\*\\*", "javascript": "\\A/\\*\\*", "typescript": "\\A/\\*\\*", "tsx": "\\A/\\*\\*"}.get(language)
    of_comment = Window.partitionBy(key, "comment").orderBy("part")
    whole_comment = of_comment.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    doc = F.when(docstring, True).otherwise(F.coalesce(F.max(F.when(first, F.col("whole").rlike(marked))).over(whole_comment), F.lit(False)) if marked else F.lit(False))
    rows = rows.withColumn("doc", doc)
    opening = f"\\A[{SPACE}]*(?://[/]?!?|/\\*+!?|#)[{SPACE}]?"
    head = F.when(docstring, F.regexp_extract("raw", f"\\A[{SPACE}]*", 0)).when(first, F.regexp_extract("raw", opening, 0)).otherwise(F.regexp_extract("raw", f"\\A[{SPACE}]*\\*?[{SPACE}]?", 0))
    rows = rows.withColumn("head", head)
    rest = F.substring("raw", F.length("head") + 1, F.length("raw"))
    rows = rows.withColumn("body", rest)
    closed = F.rtrim(F.substring("body", F.lit(1), F.length("body") - 2), F.lit(SPACES))
    rows = rows.withColumn("body", F.when(~docstring & F.col("last") & F.col("body").endswith("*/"), closed).otherwise(F.col("body")))
    left = F.when(docstring, F.col("body")).otherwise(F.ltrim("body", F.lit(" \t")))
    rows = rows.withColumn("start", F.col("start_byte") + byte_length("head") + byte_length("body") - byte_length(left)).withColumn("inner", F.when(docstring, left).otherwise(F.rtrim(left, F.lit(" \t"))))
    rows = rows.withColumn("end", F.col("start") + byte_length("inner")).withColumn("trimmed", F.btrim("inner", F.lit(SPACES)))
    tag = F.when(F.col("doc") & ~docstring, F.regexp_extract("trimmed", f"\\A@([A-Za-z]+){_WORD_END}", 1))
    example = F.coalesce(F.last(F.when(tag != "", tag), ignorenulls=True).over(of_comment).isin("example", "snippet"), F.lit(False))
    passed = example
    if language == "go":
        passed = passed | F.col("cgo") | F.col("raw").rlike(f"\\A[{SPACE}]*(?://|\\*)(?: {{5,}}|\\t)")
    if language == "java":
        passed = passed | F.coalesce(F.max(F.when(first, F.col("whole").rlike(f"\\A[{SPACE}]*///"))).over(whole_comment), F.lit(False))
    if language == "python":
        passed = passed | (docstring & F.col("inner").rlike("\\A(?:>>>|\\.\\.\\.)"))
    rows = rows.withColumn("passed", passed)
    open_line = (F.col("kind").isin("comment", "docstring")) & ~F.col("passed") & ~F.col("disabled") & (F.length("inner") > 0)
    tool = (F.col("trimmed") == "") | F.col("trimmed").contains("/*") | F.col("trimmed").contains("*/") | F.col("trimmed").rlike(PRAGMA) | _directive(F.col("trimmed"), prefix, "", "").isNotNull()
    kept = _protected(rows.withColumn("open_line", open_line).withColumn("tool", tool), key, language)
    outcome = (
        F.when(F.col("kind").isin("parse_error", "unsafe_docstring"), F.col("kind")).when(F.col("passed"), "passed").when(F.length("inner") == 0, "empty")
        .when(F.col("disabled"), F.when(has_letter("inner"), "suppressed").otherwise("empty")).when(F.col("is_protected"), "protected_comment_construct")
    )
    if language == "java":
        outcome = outcome.when(F.col("inner").rlike("(?i)\\\\u[0-9a-f]{4}"), "protected_java_unicode_escape")
    return kept.withColumn("outcome", outcome.when(has_letter("inner"), "segment").otherwise("empty"))


def _suppressed_lines(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``disabled``: from a disable's line to that of the next enable or the end, and the line after a next. Rows need not cover all lines."""
    by_line = Window.partitionBy(key).orderBy("line")
    state = F.when(F.col("directive").isin("disable", "enable"), F.struct("comment", "directive", "line"))
    now = F.max(state).over(by_line.rangeBetween(Window.unboundedPreceding, 0))
    before = F.max(state).over(by_line.rangeBetween(Window.unboundedPreceding, -1))
    here = F.coalesce(F.max(F.col("directive") == "disable").over(by_line.rangeBetween(0, 0)), F.lit(False))
    after_next = F.coalesce(F.max(F.col("directive") == "next").over(by_line.rangeBetween(-1, -1)), F.lit(False))
    closing = (now["directive"] == "enable") & (now["line"] == F.col("line")) & (before["directive"] == "disable")
    return rows.withColumn("disabled", F.coalesce(now["directive"] == "disable", F.lit(False)) | F.coalesce(closing, F.lit(False)) | here | after_next)


def _protected(rows: DataFrame, key: str, language: str) -> DataFrame:
    """Adds ``is_protected`` from ``tool`` and the rules of the language; blocks stay open over lines that may be edited otherwise."""
    line, doc = F.col("trimmed"), F.col("doc")
    free = F.col("open_line") & ~F.col("tool") & doc
    so_far = Window.partitionBy(key).orderBy("start_byte", "comment")
    if language == "go":
        return rows.withColumn("is_protected", F.col("tool") | line.rlike(GO_LINE))
    if language == "rust":
        fence = free & line.startswith("```")
        inside = (F.sum(fence.cast("int")).over(so_far) % 2) == 1
        return rows.withColumn("is_protected", F.col("tool") | (doc & (fence | inside | line.rlike(RUST_DOC))))
    if language == "java":
        tagged = line.rlike(JAVA_DOC)
        opened, closed = line.rlike(f"(?i)<(?:pre|code|snippet){_WORD_END}"), line.rlike("(?i)</(?:pre|code|snippet)>")
        event = F.when(free & ~tagged & closed, "close").when(free & ~tagged & opened, "open")
        before = F.last(event, ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
        inside = opened | F.coalesce(before == "open", F.lit(False))
        return rows.withColumn("is_protected", F.col("tool") | (doc & (tagged | inside | line.rlike("</?[A-Za-z][^>]*>"))))
    if language in ("javascript", "typescript", "tsx"):
        return rows.withColumn("is_protected", F.col("tool") | (doc & line.rlike(SCRIPT_DOC)))
    return rows.withColumn("is_protected", F.col("tool"))


def code_segments(files: DataFrame, key: str, language: str, text: str = "text", prefix: str = "prose") -> DataFrame:
    """(key, segment, line, start_byte, end_byte, text, doc): one segment for each line of a comment or docstring that may be edited."""
    kept = code_lines(files, key, language, text, prefix).where("outcome = 'segment'")
    placed = kept.select(key, "line", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("inner").alias("text"), "doc")
    return placed.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("start_byte")).cast("long")).select(key, "segment", "line", "start_byte", "end_byte", "text", "doc")


def code_diagnostics(rows: DataFrame, key: str, language: str) -> DataFrame:
    """(key, line, code) from code_lines(): directives that don't pair, and constructs that are left alone."""
    first = rows.where("part = 0 and kind = 'comment'")
    found = [segments.directive_diagnostics(first, key), first.where(F.col("whole").rlike(DOC_CONSTRUCT)).select(key, "line", F.lit("protected_documentation_construct").alias("code"))]
    found.append(rows.where(F.col("outcome").isin("protected_comment_construct", "protected_java_unicode_escape", "parse_error")).select(key, "line", F.col("outcome").alias("code")))
    if language == "java":
        found.append(first.where(F.col("whole").rlike(f"\\A[{SPACE}]*///")).select(key, "line", F.lit("unsupported_java_markdown_doc").alias("code")))
    if language == "go":
        found.append(first.where("cgo").select(key, "line", F.lit("protected_cgo_preamble").alias("code")))
    if language == "python":
        docs = rows.where("part = 0 and kind in ('docstring', 'unsafe_docstring')")
        found.append(docs.where("kind = 'unsafe_docstring'").select(key, "line", F.lit("unsupported_python_docstring").alias("code")))
        found.append(docs.where("kind = 'docstring'").where(F.col("whole").rlike("(?m)^[ \\t]*(?:>>>|\\.\\.\\.)")).select(key, "line", F.lit("protected_python_doctest").alias("code")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def code_notices(rows: DataFrame, key: str, language: str) -> DataFrame:
    """(key, code), once a file: documentation that programs can see is offered for editing."""
    name = {"python": "python_docstring_observable", "rust": "rust_documentation_observable"}.get(language)
    return rows.where(F.lit(name is not None) & F.col("doc") & (F.col("outcome") == "segment")).select(key, F.lit(name).alias("code")).distinct()


def markdown_notices(rows: DataFrame, key: str) -> DataFrame:
    """(key, code), once a file: headings among the segments, whose anchors may change."""
    return rows.where("heading").select(key, F.lit("anchor_may_change").alias("code")).distinct()


def generated_marker(comment: Column | str) -> Column:
    """struct<marker, skipped>: the first kind of marker that a comment has, and how many line breaks stand before it; null for none."""
    comment = F.col(comment) if isinstance(comment, str) else comment
    found = F.lit(None).cast("struct<marker:string,skipped:bigint>")
    for name, pattern in reversed(GENERATED_MARKERS.items()):
        before = F.call_function("substring", comment, F.lit(1), F.regexp_instr(comment, F.lit(pattern)) - 1)
        line = (F.size(F.split(before, "\r\n|\r|\n")) - 1).cast("long")
        found = F.when(comment.rlike(pattern), F.struct(F.lit(name).alias("marker"), line.alias("skipped"))).otherwise(found)
    return found


def first_markers(comments: DataFrame, key: str, text: str, line: str, order: str) -> DataFrame:
    """(key, marker, line): the first marker of each file's comments, and the line that it stands on."""
    marked = comments.select(key, F.col(line).alias("line"), F.col(order).alias("place"), generated_marker(text).alias("found")).where("found is not null")
    return marked.groupBy(key).agg(F.min_by(F.struct("found.marker", (F.col("line") + F.col("found.skipped")).alias("line")), "place").alias("x")).select(key, "x.marker", "x.line")


# Where a long text may be cut.
_BOUNDARY = re.compile("[.!?][\"')\\]]*\\s+|(?:\\r?\\n|\\r(?!\\n)){2,}")


def split_ends(text: str, ranges: list[tuple[int, int]], most: int = 10_000) -> list[int] | None:
    """Ends, in characters, of the parts that a long text is split into; None if some part has no boundary to end at.

    A boundary follows a sentence end with space, or blank lines, and is not
    inside a protected byte range. Each part takes the farthest boundary within
    ``most`` UTF-16 units.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    units = np.concatenate(([0], np.cumsum(1 + (codes > 0xFFFF))))
    if units[-1] <= most:
        return [len(text)]
    bounds = np.array([m.end() for m in _BOUNDARY.finditer(text)], dtype=np.int64)
    if ranges and len(bounds):
        data = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64))))[bounds]
        starts, ends = (np.array(sorted(x), dtype=np.int64) for x in zip(*ranges, strict=True))
        bounds = bounds[np.searchsorted(starts, data, side="left") == np.searchsorted(ends, data, side="right")]
    reached = units[bounds]
    out, at = [], 0
    while units[-1] - units[at] > most:
        k = int(np.searchsorted(reached, units[at] + most, side="right")) - 1
        if k < 0 or bounds[k] <= at:
            return None
        at = int(bounds[k])
        out.append(at)
    return [*out, len(text)] if at < len(text) else out


def text_ends(most: int = 10_000) -> Callable[[Column, Column], Column]:
    """A column function: the ends of the parts of a text with its ranges, as split_ends() has them; null for null texts."""

    @F.arrow_udf("array<bigint>")
    def ends(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        pairs = ((t.as_py(), p) for t, p in zip(texts, ranges, strict=True))
        return pa.array([None if t is None else split_ends(t, [(r["start_byte"], r["end_byte"]) for r in p.as_py() or []], most) for t, p in pairs], pa.list_(pa.int64()))

    return ends


def split_texts(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """(key, ends) for rows of (key, text, ranges array<struct<start_byte, end_byte>>)."""

    def run(batches):
        for batch in batches:
            ends = [None if t is None else split_ends(t, [(r["start_byte"], r["end_byte"]) for r in p or []], most) for t, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends, pa.list_(pa.int64()))], names=[key, "ends"])

    return rows.select(key, "text", "ranges").mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, ends array<bigint>")
