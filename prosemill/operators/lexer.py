"""Comments, docstrings and Markdown nodes of one file, found by small scanners that tasks apply to their files.

Strings, templates and block comments run over lines and nest, so lines cannot
be told apart without what stands before them. A scanner only says where things
are; what may be edited is decided by column functions over its rows.
"""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import markdown, script

#: Rows that a scanner's task sends on at once.
ROWS_AT_ONCE = 5_000
#: Characters of files after which it sends its rows on, however few.
CHARACTERS_AT_ONCE = 1 << 21
_BREAK = re.compile("\r\n|\r|\n")
_MARK = re.compile(r"""//|/\*|(?<![A-Za-z0-9_])[bc]?r(?P<hashes>#*)"|["'`()\[\]{}]""")
_STRING = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*"', re.DOTALL), "'": re.compile(r"'(?:[^'\\\n]|\\.)*'", re.DOTALL)}
_LONG_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_TEXT_BLOCK = re.compile(r'"""(?:[^\\]|\\.)*?"""', re.DOTALL)
_RUST_CHAR = re.compile(r"'(?:[^'\\\n]|\\(?:u\{[0-9A-Fa-f_]+\}|x[0-9A-Fa-f]{2}|.))'")
_CLOSES = {"(": ")", "[": "]", "{": "}"}
_DOCSTRING = re.compile("[rRuU]{0,2}('''|\"\"\"|'|\")")


def _block_end(source: str, at: int, nested: bool) -> int | None:
    """Where the block comment that starts at ``at`` ends."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(source, at) if nested else ():
        depth += 1 if m[0] == "/*" else -1
        if depth == 0:
            return m.end()
    end = -1 if nested else source.find("*/", at + 2)
    return None if end < 0 else end + 2


def braced_comments(source: str, language: str) -> list[tuple[int, int]] | None:
    """(start, end) of the comments of Go, Java and Rust; None if strings, comments or brackets don't close."""
    found, stack, at = [], [], 0
    while m := _MARK.search(source, at):
        token, i = m[0], m.start()
        at = m.end()
        if token == "//":
            end = source.find("\n", i)
            at = len(source) if end < 0 else end
            found.append((i, at))
        elif token == "/*":
            end = _block_end(source, i, language == "rust")
            if end is None:
                return None
            found.append((i, end))
            at = end
        elif m["hashes"] is not None:
            if language != "rust":
                at = m.end() - 1
                continue
            end = source.find('"' + m["hashes"], at)
            if end < 0:
                return None
            at = end + 1 + len(m["hashes"])
        elif token in "([{":
            stack.append(token)
        elif token in ")]}":
            if not stack or _CLOSES[stack.pop()] != token:
                return None
        elif token in "\"'":
            if language == "rust":
                string = (_LONG_STRING if token == '"' else _RUST_CHAR).match(source, i)
                if string is None and token == "'":
                    continue  # a lifetime
            else:
                string = language == "java" and token == '"' and _TEXT_BLOCK.match(source, i) or _STRING[token].match(source, i)
            if not string:
                return None
            at = string.end()
        elif token == "`" and language == "go":
            at = source.find("`", at) + 1
            if not at:
                return None
    return None if stack else found


def python_comments(source: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, bool]]] | None:
    """(comments, docstrings with whether they are plain strings) of a Python file; None if it has syntax errors.

    A module's docstring counts only if no comment stands before it.
    """
    shift = int(source.startswith("\ufeff"))
    text = re.sub("\r(?!\n)", "\n", source[shift:])
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text, newline="").readline) if t.type == tokenize.COMMENT]
    except (SyntaxError, ValueError, RecursionError, MemoryError, tokenize.TokenError):
        return None
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    place = lambda row, byte: starts[row - 1] + len(lines[row - 1].encode()[:byte].decode()) + shift
    comments = [(starts[t.start[0] - 1] + t.start[1] + shift, starts[t.start[0] - 1] + t.start[1] + len(t.string.rstrip("\r\n")) + shift) for t in tokens]
    docs = []
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if not isinstance(node, (ast.Module, ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) or not body or not isinstance(body[0], ast.Expr):
            continue
        value = body[0].value
        if not (isinstance(value, ast.JoinedStr) or isinstance(value, ast.Constant) and isinstance(value.value, (str, bytes))):
            continue
        start, end = place(value.lineno, value.col_offset), place(value.end_lineno, value.end_col_offset)
        if (body[0].lineno, body[0].col_offset) != (value.lineno, value.col_offset) or isinstance(node, ast.Module) and any(c < start for c, _ in comments):
            continue
        own = source[start:end]
        opening = _DOCSTRING.match(own)
        plain = opening is not None and "\\" not in own and own.endswith(opening[1]) and opening[1] not in own[opening.end() : -len(opening[1])]
        docs.append((start, end, plain))
    return comments, sorted(docs)


_COMMENT_LINES = "comment int, kind string, part int, last boolean, line long, start_byte long, raw string, whole string, cgo boolean"
_CGO = re.compile(r"\s*import\s+[\"`]C[\"`]")


def _comment_rows(source: str, language: str) -> list[tuple]:
    docs: list[tuple[int, int, bool]] = []
    if language == "python":
        found = python_comments(source)
        spans, docs = found if found else (None, [])
    else:
        scripts = ("javascript", "typescript", "tsx")
        spans = script.script_comments(source, language != "typescript") if language in scripts else braced_comments(source, language)
    if spans is None:
        return [(0, "parse_error", 0, True, None, None, None, None, False)]
    breaks = [m.end() for m in _BREAK.finditer(source)]
    pieces = []
    for number, (start, end, kind) in enumerate(sorted([(s, e, "comment") for s, e in spans] + [(s, e, "docstring" if plain else "unsafe_docstring") for s, e, plain in docs])):
        whole = source[start:end]
        cgo = language == "go" and _CGO.match(source, end) is not None
        skip = len(_DOCSTRING.match(whole)[0]) if kind == "docstring" else 0
        body = whole[skip : len(whole) - len(_DOCSTRING.match(whole)[1])] if skip else whole
        parts = re.split("(?<=\n)", body) if kind != "unsafe_docstring" else [""]
        parts = parts[:-1] if len(parts) > 1 and not parts[-1] else parts
        at = start + skip
        for k, physical in enumerate(parts):
            pieces.append((at, (number, kind, k, k == len(parts) - 1, bisect.bisect_right(breaks, at) + 1), physical.rstrip("\r\n"), whole if k == 0 else None, cgo))
            at += len(physical)
    out, done, size = [], 0, 0
    for at, head, raw, whole, cgo in sorted(pieces, key=lambda p: p[0]):
        size += len(source[done:at].encode("utf-8", "surrogatepass"))
        done = at
        out.append((*head, size, raw, whole, cgo))
    return out


def scanned(batches: Iterator[pa.RecordBatch], scan: Callable[[str], list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Rows of a scanner over batches (key, text). Texts are taken out of a batch one by one and rows sent on by number and size, so that a task holds one batch and one text beside them."""
    for batch in batches:
        rows: list[tuple] = []
        size = 0

        def told(rows: list[tuple], of: pa.DataType = batch.column(0).type) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [of, *types], strict=True)], names=names)

        for k, source in zip(batch.column(0), batch.column(1), strict=True):
            key, text = k.as_py(), source.as_py()
            if text is None:
                continue
            rows += [(key, *row) for row in scan(text)]
            size += len(text)
            if len(rows) >= ROWS_AT_ONCE or size >= CHARACTERS_AT_ONCE:
                if rows:
                    yield told(rows)
                rows, size = [], 0
        if rows:
            yield told(rows)


def _apply(files: DataFrame, key: str, text: str, schema: str, scan: Callable[[str], list[tuple]]) -> DataFrame:
    names = [key, *(c.split()[0] for c in schema.split(", "))]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scanned(batches, scan, names, [kinds[c.split()[1]] for c in schema.split(", ")])

    return files.select(key, F.col(text).alias("text")).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, {schema}")


def comment_lines(files: DataFrame, key: str, language: str, text: str = "text") -> DataFrame:
    """(key, comment, kind, part, last, line, start_byte, raw, whole, cgo): each line of each comment and docstring of a file.

    kind is comment, docstring, unsafe_docstring (one row, no text) or
    parse_error (one row for a file that cannot be read). ``raw`` is the line
    without its end, of docstrings without the quotes; ``whole`` stands with the
    first line; ``cgo`` says that Go's import "C" follows. Null texts have no rows.
    """
    return _apply(files, key, text, _COMMENT_LINES, lambda source: _comment_rows(source, language))


_MARKDOWN_NODES = "node int, kind string, part int, line long, start_byte long, raw string, heading boolean"


def markdown_rows(source: str, whole: bool = False) -> list[tuple]:
    """A row for each line of each node, with the line's end, or a row for each ``whole`` node; front matter is a node of kind front."""
    breaks = [m.end() for m in _BREAK.finditer(source)]
    front = markdown.front_matter_end(source)
    pieces = [(0, 0, "front", 0, source[:front], False)] if front else []
    for number, (kind, start, end, heading) in enumerate(markdown.nodes(source), 1):
        # only what may be edited is looked at line by line
        ends = [b for b in breaks[bisect.bisect_right(breaks, start) : bisect.bisect_left(breaks, end)]] if kind in ("text", "alt") and not whole else []
        pieces += [(a, number, kind, k, source[a:b], heading) for k, (a, b) in enumerate(zip([start, *ends], [*ends, end], strict=True))]
    out, done, size = [], 0, 0
    for at, number, kind, part, raw, heading in pieces:
        size += len(source[done:at].encode("utf-8", "surrogatepass"))
        done = at
        out.append((number, kind, part, bisect.bisect_right(breaks, at) + 1, size, raw, heading))
    return out


def markdown_nodes(files: DataFrame, key: str, text: str = "text", whole: bool = False) -> DataFrame:
    """(key, node, kind, part, line, start_byte, raw, heading): the nodes of a Markdown file.

    kind is text or alt (a row for each line that the node is on, or one for a
    ``whole`` node), or one of code, html, definition and front, which hold no
    prose (one row). Null texts have no rows.
    """
    return _apply(files, key, text, _MARKDOWN_NODES, lambda source: markdown_rows(source, whole))
