"""Table functions for SQL: segments of Markdown files, a file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import lexer
from .extract import MARKDOWN_PROTECTED

_SEGMENTS = "file string, segment bigint, line bigint, start_byte bigint, end_byte bigint, text string, heading boolean"
_PROTECTED = re.compile(MARKDOWN_PROTECTED.replace("(?i)", "").replace("\\p{L}\\p{N}", "\\w").replace("[^\\w\\s]", "(?:[^\\w\\s]|_)"), re.IGNORECASE)
_LETTER = re.compile(r"[^\W\d_]")


def _disabled(rows: list[tuple], prefix: str) -> list[tuple[float, float]]:
    """(first, last) lines that directives switch off."""
    directive = re.compile(rf"\s*<!--\s*{re.escape(prefix)}-(disable-next-line|disable|enable)\s*-->\s*\Z")
    out, since = [], None
    for _, kind, _, line, _, raw, _ in rows:
        found = directive.match(raw) if kind == "html" else None
        if not found:
            continue
        if found[1] == "disable-next-line":
            out.append((line + 1, line + 1))
        elif found[1] == "disable":
            since = line if since is None else since
        elif since is not None:
            out.append((since, line))
            since = None
    return out if since is None else [*out, (since, float("inf"))]


def segments_of(source: str, prefix: str = "prose") -> Iterator[tuple]:
    """(line, start_byte, end_byte, text, heading) of what may be edited, as ``extract.markdown_segments`` has it."""
    rows = lexer.markdown_rows(source)
    off = _disabled(rows, prefix)
    islands: list[list] = []
    for node, kind, _, line, start, raw, heading in rows:
        if kind not in ("text", "alt"):
            continue
        hidden = any(a <= line <= b for a, b in off)
        if islands and islands[-1][:2] == [node, hidden]:
            islands[-1][4] += raw
        else:
            islands.append([node, hidden, line, start, raw, heading])
    for _, hidden, line, start, raw, heading in islands:
        if not hidden and _LETTER.search(raw) and not _PROTECTED.search(raw):
            yield line, start, start + len(raw.encode("utf-8", "surrogatepass")), raw, heading


def register(spark: SparkSession, name: str = "prose_segments", prefix: str = "prose") -> None:
    """Make ``SELECT * FROM prose_segments(TABLE(files) PARTITION BY file)`` possible in SQL.

    The table's first column names a file, its second holds the text. Rows of a
    partition are files of their own; null texts have no segments. Segments are
    numbered within their file.
    """

    @F.arrow_udtf(returnType=_SEGMENTS)
    class ProseSegments:
        def eval(self, files: pa.RecordBatch) -> Iterator[pa.Table]:
            rows = []
            for file, text in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                rows += [(str(file) if file is not None else None, n, *s) for n, s in enumerate(segments_of(text, prefix), 1)] if text is not None else []
            columns = zip(*rows, strict=True) if rows else [()] * 7
            types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in _SEGMENTS.split(", ")])

    spark.udtf.register(name, ProseSegments)
