"""Comments of JavaScript, TypeScript and TSX files: a pushdown lexer with modes for code, templates, tags and text of markup.

Whether a slash divides or starts a regular expression, and whether ``<``
compares or opens markup, depends on whether a value stands before it. Brackets
are kept on a stack with what they mean for the token after them.
"""

from __future__ import annotations

import re

_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[\w$#@\\]+")
_STRING = re.compile(r"\"(?:[^\"\\\r\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|.))*'", re.DOTALL)
_REGEX = re.compile(r"/(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|`|\$\{", re.DOTALL)
_LINE_END = re.compile("[\r\n\u2028\u2029]|\\Z")
_TAG_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_ATTRIBUTE = re.compile(r"[\w$:-]+|=|\"[^\"]*\"|'[^']*'")
_TYPE_PARAMETERS = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b(?!\s*[=/>])|=[^>]*>\s*\()")
_CHILD_END = re.compile("[<{]")
#: Words that a value follows, and words whose parentheses are not a value.
_VALUE_NEXT = set("return typeof case in of delete void throw new do else instanceof yield await default extends".split())
_CONTROL = {"if", "while", "for", "with"}
#: What a brace after it makes an object.
_OBJECT_AFTER = set("(,=:[!&|?+-*%^~") | {"return", "typeof", "case", "in", "of", "throw", "new", "yield", "await", "default", "void", "delete"}


class _Broken(Exception):
    """A file that doesn't close what it opens."""


class _Script:
    def __init__(self, source: str, markup: bool):
        self.source, self.markup, self.at = source, markup, 0
        self.found: list[tuple[int, int]] = []
        # open brackets and modes: (kind, what it means for the next token, or a tag's name)
        self.stack: list[tuple[str, object]] = []
        self.value, self.last, self.before_last = False, "", ""
        if source.startswith(("#!", "\ufeff#!")):
            self.at = _LINE_END.search(source).start()
        steps = {"children": self._children, "tag": self._tag}
        while self.at < len(source):
            steps.get(self.stack[-1][0] if self.stack else "", self._code)()
        if self.stack:
            raise _Broken

    def _comment(self) -> bool:
        if self.source.startswith("//", self.at):
            end = _LINE_END.search(self.source, self.at).start()
        elif self.source.startswith("/*", self.at):
            end = self.source.find("*/", self.at + 2) + 2
            if end < 2:
                raise _Broken
        else:
            return False
        self.found.append((self.at, end))
        self.at = end
        return True

    def _token(self, token: str, value: bool, length: int | None = None) -> None:
        self.before_last, self.last, self.value = self.last, token, value
        self.at += len(token) if length is None else length

    def _code(self) -> None:
        source, at = self.source, self.at
        c = source[at]
        if space := _SPACE.match(source, at):
            self.at = space.end()
        elif c == "/" and self._comment():
            pass
        elif word := _WORD.match(source, at):
            member = self.last in (".", "?.")
            self._token(word[0], member or word[0] not in _VALUE_NEXT)
        elif c in "\"'":
            string = _STRING.match(source, at)
            if not string:
                raise _Broken
            self._token(c, True, len(string[0]))
        elif c == "`":
            self.at += 1
            self._template()
        elif c == "/":
            regex = None if self.value else _REGEX.match(source, at)
            self._token("/", regex is not None, len(regex[0]) if regex else 1)
        elif c in "([{":
            self._open(c)
        elif c in ")]}":
            self._close(c)
        elif c == "<" and self.markup and not self.value and not _TYPE_PARAMETERS.match(source, at) and (source.startswith("<>", at) or _TAG_NAME.match(source, at + 1)):
            self._open_tag()
        elif source.startswith(("++", "--"), at):
            self.at += 2  # before or after a value, which stays what it was
        elif source.startswith("=>", at):
            self._token("=>", False)
        elif source.startswith("?.", at):
            self._token("?.", False)
        elif c == "!" and self.value and source[at + 1 : at + 2] != "=":
            self.at += 1  # an assertion after a value
        else:
            self._token(c, self.value and c == ".")

    def _open(self, c: str) -> None:
        if c == "(":
            control = self.last in _CONTROL and self.before_last != "." or self.last == "await" and self.before_last == "for"
            after: object = not control
        elif c == "{":
            after = not self.value and self.last in _OBJECT_AFTER
        else:
            after = True
        self.stack.append((c, after))
        self._token(c, False)

    def _close(self, c: str) -> None:
        kind, after = self.stack.pop() if self.stack else ("", None)
        if {"(": ")", "[": "]", "{": "}", "template": "}", "child": "}"}.get(kind) != c:
            raise _Broken
        if kind == "template":
            self.at += 1
            self._template()
        elif kind == "child":
            self.at += 1  # back to the tag or the text that it stands in
        else:
            self._token(c, bool(after))

    def _template(self) -> None:
        while part := _TEMPLATE.search(self.source, self.at):
            self.at = part.end()
            if part[0] == "${":
                self.stack.append(("template", None))
                self._token("(", False, 0)
                return
            if part[0] == "`":
                self._token("`", True, 0)
                return
        raise _Broken

    def _open_tag(self) -> None:
        name = _TAG_NAME.match(self.source, self.at + 1)
        self.at = name.end() if name else self.at + 1
        self.stack.append(("tag", name[0] if name else ""))
        if self.source.startswith("<", self.at):  # type arguments
            depth = 0
            for m in re.compile("[<>]").finditer(self.source, self.at):
                depth += 1 if m[0] == "<" else -(self.source[m.start() - 1] != "=")
                if not depth:
                    self.at = m.end()
                    return
            raise _Broken

    def _child(self) -> None:
        self.stack.append(("child", None))
        self._token("(", False, 1)

    def _end_element(self) -> None:
        if not self.stack or self.stack[-1][0] not in ("children", "tag"):
            self._token(">", True, 0)

    def _tag(self) -> None:
        source, at = self.source, self.at
        if space := _SPACE.match(source, at):
            self.at = space.end()
        elif self._comment():
            pass
        elif source.startswith("/>", at):
            self.at += 2
            self.stack.pop()
            self._end_element()
        elif source[at] == ">":
            self.at += 1
            self.stack[-1] = ("children", self.stack[-1][1])
        elif source[at] == "{":
            self._child()
        elif source[at] == "<":
            self._open_tag()
        elif attribute := _ATTRIBUTE.match(source, at):
            self.at = attribute.end()
        else:
            raise _Broken

    def _children(self) -> None:
        found = _CHILD_END.search(self.source, self.at)
        if not found:
            raise _Broken
        self.at = found.start()
        if found[0] == "{":
            self._child()
            return
        closing = re.compile(r"<\s*/\s*([\w$.:-]*)\s*>").match(self.source, self.at)
        if closing:
            if closing[1] != self.stack.pop()[1]:
                raise _Broken
            self.at = closing.end()
            self._end_element()
        elif self.source.startswith("<>", self.at) or _TAG_NAME.match(self.source, self.at + 1):
            self._open_tag()
        else:
            raise _Broken


def script_comments(source: str, markup: bool) -> list[tuple[int, int]] | None:
    """(start, end) of a script's comments; None if strings, comments, brackets or tags don't close. ``markup`` says whether it may hold tags."""
    try:
        return _Script(source, markup).found
    except _Broken:
        return None
