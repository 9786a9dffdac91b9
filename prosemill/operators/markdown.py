"""Text nodes of one Markdown file: a stack of containers gives blocks, a stack of delimiters what is text within them.

Blocks are found line by line. A block's text is then read as one string,
whatever quote marks and indents stand between its lines, because code spans,
tags, links and emphasis run over lines. Which brackets are links depends on the
labels that the whole file defines, so inline text is read after all blocks.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

BREAK = re.compile("\r\n|\r|\n")
_FENCE = re.compile(r"(`{3,}(?!.*`)|~{3,})")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*\Z")
_SETEXT = re.compile(r"(?:=+|-+)[ \t]*\Z")
_RULE = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_BULLET = re.compile(r"([-*+])(?=[ \t]|\Z)")
_ORDERED = re.compile(r"(\d{1,9})[.)](?=[ \t]|\Z)")
_TASK = re.compile(r"\[[ xX]\](?=[ \t])")
_NOTE = re.compile(r"\[\^((?:[^\[\]\\\s]|\\.)+)\]:")
_DELIMITER_ROW = re.compile(r"\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_CELL = re.compile(r"(?:\\.|[^|\\])*")
_LABEL = r"\[(?=[^\]]*\S)((?:[^\[\]\\]|\\.)+)\]"
_TITLE = r"(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))"
_TARGET = r"(?:<(?:[^<>\\\n]|\\.)*>|(?!<)(?:[^\s()\\\x00-\x1f]|\\.|\((?:[^\s()\\\x00-\x1f]|\\.|\((?:[^\s()\\\x00-\x1f]|\\.)*\))*\))+)"
_SPACES = r"[ \t]*\n?[ \t]*"
_DEFINITION = re.compile(rf"{_LABEL}:{_SPACES}{_TARGET}(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE}[ \t]*(?=\n|\Z)|[ \t]*(?=\n|\Z))\n?", re.DOTALL)
_INLINE_TARGET = re.compile(rf"\({_SPACES}(?:{_TARGET})?(?:(?:[ \t]+|[ \t]*\n[ \t]*){_TITLE})?{_SPACES}\)", re.DOTALL)
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]", re.DOTALL)
_ATTRIBUTE = r"(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)"
_TAG = rf"<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
_INLINE_HTML = re.compile(rf"{_TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.DOTALL)
_AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>\x00-\x1f]*|[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
_BARE_LINK = re.compile(r"(?:https?://|www\.)[A-Za-z0-9][^\s<]*", re.IGNORECASE)
_BARE_MAIL = re.compile(r"[A-Za-z0-9._+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*[A-Za-z0-9])+(?![\w-])")
_HTML_UNTIL = [(re.compile(p, re.IGNORECASE), re.compile(e, re.IGNORECASE)) for p, e in ((r"<(?:script|pre|style|textarea)(?:[\s>]|\Z)", "</(?:script|pre|style|textarea)>"), ("<!--", "-->"), (r"<\?", r"\?>"), ("<![A-Za-z]", ">"), (r"<!\[CDATA\[", r"\]\]>"))]
_HTML = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)(?:[\s/>]|\Z)")
_HTML_ALONE = re.compile(rf"(?:{_TAG})[ \t]*\Z")
# Names of tags that start a block anywhere.
_BLOCK_TAGS = set("address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split())
_SPECIAL = re.compile(r"[\\`<!\[\]*_~\n]|(?<![A-Za-z])(?=https?://)|(?<![^\s*_~(])(?=www\.)|(?<![A-Za-z0-9._+-])(?=[A-Za-z0-9._+-]{1,64}@)", re.IGNORECASE)
_MARKS = re.compile(r"[\\`<!\[\]*_~\n]")  # of texts without links or addresses of their own
_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")

Node = tuple[str, int, int, bool]


def _label(text: str) -> str:
    return " ".join(text.split()).casefold()


class _Blocks:
    """Leaf blocks of a file: nodes that hold no prose, and texts as lists of (start, end) of their lines."""

    def __init__(self, source: str):
        self.source = source
        self.nodes: list[Node] = []
        self.texts: list[tuple[list[tuple[int, int]], bool]] = []
        self.labels: set[str] = set()
        self.notes: set[str] = set()
        self.open: list[tuple[str, int]] = []  # containers: quote, item or note, and the columns that their lines are indented by
        self.leaf: str | None = None
        self.lines: list[tuple[int, int]] = []
        self.until: re.Pattern | None = None
        self.fence, self.fresh_item, self.columns = "", False, 0
        at = front_matter_end(source) or int(source.startswith("﻿"))
        while at < len(source):
            found = BREAK.search(source, at)
            end, after = (found.start(), found.end()) if found else (len(source), len(source))
            self._line(at, end)
            at = after
        self._close_leaf()

    def _indent(self, at: int, end: int, column: int) -> tuple[int, int]:
        """(columns of white space from ``at`` on, where it ends)."""
        start = column
        while at < end and self.source[at] in " \t":
            column += 1 if self.source[at] == " " else 4 - column % 4
            at += 1
        return column - start, at

    def _skip(self, at: int, end: int, column: int, most: int) -> tuple[int, int]:
        """(place, column) after ``most`` columns of white space; a tab that reaches further counts whole."""
        goal = column + most
        while at < end and column < goal and self.source[at] in " \t":
            column += 1 if self.source[at] == " " else 4 - column % 4
            at += 1
        return at, column

    def _line(self, at: int, end: int) -> None:
        column, matched = 0, 0
        for kind, width in self.open:
            columns, text = self._indent(at, end, column)
            if kind == "quote":
                if columns > 3 or text >= end or self.source[text] != ">":
                    break
                at, column = self._skip(text + 1, end, column + columns + 1, 1)
            elif text >= end:
                if self.fresh_item and kind == "item" and matched == len(self.open) - 1:
                    break  # an item that starts with a blank line ends at a second one
            elif columns >= width:
                at, column = self._skip(at, end, column, width)
            else:
                break
            matched += 1
        whole = matched == len(self.open)
        self.fresh_item = False
        if self.leaf in ("fence", "html") and whole:
            self._within(at, end)
            return
        if self.leaf == "html_block" and whole:
            if self._indent(at, end, column)[1] < end:
                self.lines.append((at, end))
                return
            self._close_leaf()
        lazy = self.leaf == "paragraph" and not whole
        if not whole and not lazy:
            self._close_leaf()
        if not lazy:
            del self.open[matched:]
        while True:
            columns, text = self._indent(at, end, column)
            rest = self.source[text:end]
            if columns > 3 or not rest:
                break
            if rest[0] == ">":
                self._leave(matched)
                self.open.append(("quote", 0))
                at, column = self._skip(text + 1, end, column + columns + 1, 1)
            elif (item := self._item(rest, lazy)) and not _RULE.match(rest):
                self._leave(matched)
                mark, body = text + item, self._indent(text + item, end, column + columns + item)
                inside = body[0] if 1 <= body[0] <= 4 and body[1] < end else 1
                self.open.append(("item", columns + item + inside))
                self.fresh_item = body[1] >= end
                at, column = self._skip(mark, end, column + columns + item, inside)
                if task := _TASK.match(self.source, at, end):
                    at, column = task.end(), column + 3
            elif (note := _NOTE.match(rest)) and self.leaf != "paragraph":
                self._leave(matched)
                self.notes.add(_label(note[1]))
                self.open.append(("note", 4))
                at, column = text + note.end(), column + columns + note.end()
            else:
                break
            matched, lazy = len(self.open), False
        self._leaf_line(at, end, columns, text, rest, lazy, matched)

    def _item(self, rest: str, lazy: bool) -> int:
        """Length of a list marker at the start of ``rest``; 0 for none. Only filled items that start at 1 break paragraphs."""
        mark = _BULLET.match(rest) or _ORDERED.match(rest)
        if not mark:
            return 0
        breaks = self.leaf == "paragraph" and not lazy
        if breaks and (not rest[mark.end() :].strip() or mark[1].isdigit() and int(mark[1]) != 1):
            return 0
        return mark.end()

    def _leave(self, matched: int) -> None:
        self._close_leaf()
        del self.open[matched:]

    def _leaf_line(self, at: int, end: int, columns: int, text: int, rest: str, lazy: bool, matched: int) -> None:
        if not rest.strip():
            if self.leaf != "code":
                self._leave(matched)
            return
        if columns > 3:
            if self.leaf in ("paragraph", "table"):
                self.lines.append((text, end)) if self.leaf == "paragraph" else self._row(text, end)
            else:
                if self.leaf != "code":
                    self._close_leaf()
                    self.leaf, self.lines = "code", []
                self.lines.append((at, end))
            return
        if self.leaf == "code":
            self._close_leaf()
        started = self._start(text, end, rest, lazy, matched)
        if started:
            return
        if self.leaf == "table":
            self._row(text, end)
        elif self.leaf == "paragraph":
            if not lazy and _DELIMITER_ROW.match(rest) and ("|" in rest or ":" in rest) and self._table(rest):
                return
            self.lines.append((text, end))
        else:
            self.leaf, self.lines = "paragraph", [(text, end)]

    def _start(self, text: int, end: int, rest: str, lazy: bool, matched: int) -> bool:
        """Blocks that start with this line, or end with it."""
        paragraph = self.leaf == "paragraph"
        if paragraph and not lazy and _SETEXT.match(rest) and self._prose():
            self._close_leaf(heading=True)
        elif heading := _HEADING.match(rest):
            self._leave(matched)
            if heading[2]:
                self.texts.append(([(text + heading.start(2), text + heading.end(2))], True))
        elif _RULE.match(rest):
            self._leave(matched)
        elif mark := _FENCE.match(rest):
            self._leave(matched)
            self.leaf, self.fence, self.lines = "fence", mark[1], [(text, end)]
        elif rest[0] == "<" and (pair := next((p for p in _HTML_UNTIL if p[0].match(rest)), None)):
            self._leave(matched)
            self.leaf, self.until, self.lines = "html", pair[1], [(text, end)]
            if pair[1].search(rest, 2):
                self._close_leaf()
        elif rest[0] == "<" and ((tag := _HTML.match(rest)) and tag[1].lower() in _BLOCK_TAGS or not paragraph and _HTML_ALONE.match(rest)):
            self._leave(matched)
            self.leaf, self.lines = "html_block", [(text, end)]
        else:
            return False
        return True

    def _within(self, at: int, end: int) -> None:
        """A line of a fence, or of HTML that ends with a mark of its own."""
        self.lines.append((at, end))
        text = self.source[at:end]
        if self.leaf == "html":
            if self.until.search(text):
                self._close_leaf()
        elif re.match(rf" {{0,3}}{re.escape(self.fence[0])}{{{len(self.fence)},}}[ \t]*\Z", text):
            self._close_leaf()

    def _prose(self) -> list[tuple[int, int]]:
        """The lines of the open paragraph without the definitions that it starts with, which are taken note of."""
        while self.lines:
            text = "\n".join(self.source[a:b].rstrip(" \t") for a, b in self.lines)
            found = _DEFINITION.match(text) if text[0] == "[" else None
            if not found or text.startswith("[^"):
                break
            count = found[0].count("\n") + (not found[0].endswith("\n"))
            self.labels.add(_label(found[1]))
            self.nodes.append(("definition", self.lines[0][0], self.lines[count - 1][1], False))
            del self.lines[:count]
        return self.lines

    def _cells(self, at: int, end: int) -> list[tuple[int, int]]:
        """(start, end) of the trimmed cells of a table's row."""
        out, text = [], self.source[at:end].rstrip(" \t")
        place = 1 if text.startswith("|") else 0
        while place < len(text):
            cell = _CELL.match(text, place)
            own = cell[0].strip(" \t")
            start = place + len(cell[0]) - len(cell[0].lstrip(" \t"))
            out.append((at + start, at + start + len(own)))
            place = cell.end() + 1
        return out

    def _table(self, delimiters: str) -> bool:
        """Make the paragraph's last line the head of a table, if it has as many cells as the row of delimiters."""
        self.columns = len(delimiters.strip(" \t").strip("|").split("|"))
        head = self.lines[-1]
        if len(self._cells(*head)) != self.columns:
            return False
        before = self.lines[:-1]
        self.lines = before
        self._close_leaf()
        self.leaf, self.lines = "table", []
        self._row(*head)
        return True

    def _row(self, at: int, end: int) -> None:
        self.texts += [([cell], False) for cell in self._cells(at, end)[: self.columns] if cell[0] < cell[1]]

    def _close_leaf(self, heading: bool = False) -> None:
        if self.leaf == "paragraph" and self._prose():
            self.texts.append((self.lines, heading))
        elif self.leaf in ("fence", "code"):
            self.nodes.append(("code", self.lines[0][0], self.lines[-1][1], False))
        elif self.leaf in ("html", "html_block"):
            self.nodes.append(("html", self.lines[0][0], self.lines[-1][1], False))
        self.leaf, self.lines = None, []


def front_matter_end(source: str) -> int | None:
    """Where front matter ends that a file starts with."""
    opening = re.match("---(?:\r\n|\r|\n)", source)
    closing = re.compile("(?:(?<=\n)|(?<=\r)(?!\n))(?:---|\\.\\.\\.)(?:\r\n|\r|\n|\\Z)").search(source, opening.end()) if opening else None
    return closing.end() if closing else None


class _Inline:
    """What of a block's text is text: pieces of the string, in order, and nodes of code, tags and images within it."""

    def __init__(self, text: str, labels: set[str], notes: set[str]):
        self.text, self.labels, self.notes = text, labels, notes
        self.parts: list[list] = []  # [start, end, mark, can open, can close] of literal text; nodes and syntax leave gaps
        self.nodes: list[tuple[str, int, int]] = []
        self.brackets: list[tuple[int, int, bool, int]] = []  # (part, start, is image, nodes before)
        self.dead = 0  # brackets below cannot start links: links don't nest
        self.no_code: set[int] = set()
        special = _SPECIAL if "@" in text or "://" in text or "www." in text.lower() else _MARKS
        at = 0
        while at < len(text):
            found = special.search(text, at)
            stop = found.start() if found else len(text)
            if stop > at:
                self._literal(at, stop)
            at = self._special(stop) if found else stop
        self._emphasis(0)

    def pieces(self) -> Iterator[tuple[int, int]]:
        """Maximal stretches of literal text."""
        start = end = None
        for part in self.parts:
            if part[0] >= part[1]:
                continue
            if part[0] != end:
                if start is not None:
                    yield start, end
                start = part[0]
            end = part[1]
        if start is not None:
            yield start, end

    def _literal(self, start: int, end: int) -> int:
        self.parts.append([start, end, "", False, False])
        return end

    def _special(self, at: int) -> int:
        text, c = self.text, self.text[at]
        if c == "\\":
            if text[at + 1 : at + 2] == "\n":
                return at + 2
            return self._literal(at, at + 2 if text[at + 1 : at + 2] in _PUNCTUATION else at + 1)
        if c == "\n":
            if text[at - 2 : at] == "  ":  # a hard break takes the spaces before it
                self.parts[-1][1] -= 2
                return at + 1
            return self._literal(at, at + 1)
        if c == "`":
            return self._code(at)
        if c == "<":
            if link := _AUTOLINK.match(text, at):
                self._literal(*link.span(1))
                return link.end()
            tag = _INLINE_HTML.match(text, at)
            if tag:
                self.nodes.append(("html", at, tag.end()))
                return tag.end()
            return self._literal(at, at + 1)
        if c == "!" and text[at + 1 : at + 2] != "[":
            return self._literal(at, at + 1)
        if c in "![":
            end = at + 1 + (c == "!")
            self.brackets.append((len(self.parts), at, c == "!", len(self.nodes)))
            return self._literal(at, end)
        if c == "]":
            return self._closing(at)
        if c in "*_~":
            return self._delimiters(at)
        return self._bare(at)

    def _code(self, at: int) -> int:
        run = re.compile("`+").match(self.text, at)
        size = len(run[0])
        if size not in self.no_code:
            for closing in re.compile("`+").finditer(self.text, run.end()):
                if len(closing[0]) == size:
                    self.nodes.append(("code", at, closing.end()))
                    return closing.end()
            self.no_code.add(size)  # none follows, nor will for later runs
        return self._literal(at, run.end())

    def _bare(self, at: int) -> int:
        """A link or address that stands in the text by itself, or the character."""
        text = self.text
        link = _BARE_LINK.match(text, at)
        end = link.end() if link else 0
        while link and end > at:
            last = text[end - 1]
            if last == ";" and (entity := re.search(r"&[A-Za-z0-9]+;\Z", text[at:end])):
                end -= len(entity[0])
            elif last in "?!.,:*_~'\"" or last == ")" and text.count(")", at, end) > text.count("(", at, end):
                end -= 1
            elif last == "]":
                end = at + text[at:end].rfind("]")
            else:
                break
        if link and "]" in text[at:end]:
            end = at + text[at:end].index("]")
        host = re.match(r"(?:https?://)?([^/?#\s]+)", text[at:end], re.IGNORECASE)
        if not (link and host and "." in host[1] and "_" not in "".join(host[1].split(".")[-2:])):
            mail = _BARE_MAIL.match(text, at)
            end = mail.end() if mail and mail[0][-1] not in "-_" else 0
        if not end:
            return self._literal(at, at + 1)
        # a node of its own: no piece goes on across its edges
        self.parts.append([at, at, "", False, False])
        self.nodes.append(("text", at, end))
        return end

    def _delimiters(self, at: int) -> int:
        text, c = self.text, self.text[at]
        end = at
        while end < len(text) and text[end] == c:
            end += 1
        before, after = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        space = lambda x: x.isspace()
        mark = lambda x: unicodedata.category(x)[0] in "PS"
        left = not space(after) and (not mark(after) or space(before) or mark(before))
        right = not space(before) and (not mark(before) or space(after) or mark(after))
        opens, closes = left, right
        if c == "_":
            opens, closes = left and (not right or mark(before)), right and (not left or mark(after))
        if c == "~" and end - at > 2:
            return self._literal(at, end)
        self.parts.append([at, end, c, opens, closes, end - at])
        return end

    def _closing(self, at: int) -> int:
        """A closing bracket: the end of a link, an image or a note's mark, or a character."""
        text = self.text
        if not self.brackets:
            return self._literal(at, at + 1)
        part, start, image, nodes = self.brackets.pop()
        live = image or len(self.brackets) >= self.dead
        inner = text[start + 1 + image : at]
        if live and not image and inner.startswith("^") and _label(inner[1:]) in self.notes:
            del self.parts[part:], self.nodes[nodes:]
            self.parts.append([at, at, "", False, False])
            return at + 1
        end = self._target(at + 1, inner) if live else None
        if end is None:
            self.dead = min(self.dead, len(self.brackets))
            return self._literal(at, at + 1)
        if image:
            del self.parts[part:], self.nodes[nodes:]
            close = text.find("]", start + 2)
            if inner.strip():
                self.nodes.append(("alt", start + 2, close))
            return end
        self._emphasis(part)
        self.parts[part] = [start, start, "", False, False]
        self.dead = len(self.brackets)
        return end

    def _target(self, after: int, inner: str) -> int | None:
        """Where a link ends whose text ends before ``after``; None if there is none."""
        if found := _INLINE_TARGET.match(self.text, after):
            return found.end()
        if found := _REFERENCE.match(self.text, after):
            return found.end() if _label(found[1] or inner) in self.labels else None
        return after if _label(inner) in self.labels else None

    def _emphasis(self, bottom: int) -> None:
        """Pair delimiters from part ``bottom`` on; what is paired is no text. Unpaired ones stay literal and pair no more."""
        waiting: list[list] = []
        barred: dict[tuple, int] = {}
        for part in self.parts[bottom:]:
            if not part[2]:
                continue
            c = part[2]
            while part[4] and part[0] < part[1]:
                key = (c, part[3], part[5] % 3) if c != "~" else (c, part[5])
                floor = barred.get(key, 0)
                found = next((i for i in range(len(waiting) - 1, floor - 1, -1) if self._pairs(waiting[i], part)), None)
                if found is None:
                    barred[key] = len(waiting)
                    break
                opener = waiting[found]
                del waiting[found + 1 :]
                used = part[1] - part[0] if c == "~" else 2 if min(opener[1] - opener[0], part[1] - part[0]) > 1 else 1
                opener[1] -= used
                part[0] += used
                if opener[0] >= opener[1]:
                    waiting.pop()
                barred = {k: min(v, len(waiting)) for k, v in barred.items()}
            if part[3] and part[0] < part[1]:
                waiting.append(part)
        for part in self.parts[bottom:]:
            part[2] = ""

    @staticmethod
    def _pairs(opener: list, closer: list) -> bool:
        if opener[2] != closer[2]:
            return False
        if opener[2] == "~":
            return opener[5] == closer[5] and opener[1] - opener[0] == closer[1] - closer[0]
        # a run that may both open and close pairs only with fitting lengths
        return not ((opener[4] or closer[3]) and (opener[5] + closer[5]) % 3 == 0 and (opener[5] % 3 or closer[5] % 3))


def nodes(source: str) -> list[Node]:
    """(kind, start, end, heading) of a file's nodes by start: text and alt may be edited, code, html and definition may not.

    Places are characters. Text runs over line breaks where nothing but a break
    stands between; the stretch from start to end then holds quote marks and
    indents too.
    """
    blocks = _Blocks(source)
    out = blocks.nodes
    for lines, heading in blocks.texts:
        # trailing spaces belong to hard breaks, or to nothing
        trimmed = [(a, a + len(source[a:b].rstrip(" \t"))) for a, b in lines]
        tails = [source[b : y] for (_, b), (_, y) in zip(trimmed, lines, strict=True)]
        tails[-1] = ""
        owned = [source[a:b] + ("  " if t.endswith("  ") else "") for (a, b), t in zip(trimmed, tails, strict=True)]
        starts = [0]
        for own in owned:
            starts.append(starts[-1] + len(own) + 1)
        inline = _Inline("\n".join(owned), blocks.labels, blocks.notes)

        def place(at: int) -> int:
            line = bisect.bisect_right(starts, at) - 1
            return min(trimmed[line][0] + at - starts[line], trimmed[line][1])  # noqa: B023

        def after(at: int) -> int:
            """The end of the character before ``at``."""
            line = bisect.bisect_right(starts, at - 1) - 1
            if at - 1 - starts[line] < len(owned[line]):  # noqa: B023
                return place(at - 1) + 1
            return BREAK.search(source, trimmed[line][1]).end()  # noqa: B023

        found = [("text", a, b) for a, b in inline.pieces()] + inline.nodes
        # a break's own place is where the line's end stands, behind spaces
        for kind, a, b in found:
            line = bisect.bisect_right(starts, a) - 1
            first = BREAK.search(source, trimmed[line][1]).start() if a - starts[line] >= len(owned[line]) else place(a)
            out.append((kind, first, after(b), heading))
    return sorted(out, key=lambda n: (n[1], n[2]))
