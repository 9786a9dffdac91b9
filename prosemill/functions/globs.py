"""Globs of the inclusion policy, compiled on the driver to anchored Java patterns."""

from __future__ import annotations

import itertools
import re

MOST_GROUPS, MOST_CHOICES, MOST_PATTERNS = 4, 32, 256


class GlobError(ValueError):
    pass


def check(glob: str) -> None:
    if not 1 <= len(glob) <= 1024 or glob[0] in "!/" or re.search(r"[\\:\x00-\x1f\x7f]", glob) or {".", ".."} & set(glob.split("/")):
        raise GlobError(f"unsafe glob {glob!r}")


def expanded(glob: str) -> list[str]:
    """The globs without braces that a glob stands for; the product is bounded before it is built."""
    check(glob)
    parts = re.split(r"(\{[^{}]*\})", glob)
    groups = [p[1:-1].split(",") if i % 2 else [p] for i, p in enumerate(parts)]
    braced = groups[1::2]
    if any(c in p for p in parts[::2] for c in "{}") or len(braced) > MOST_GROUPS or any(len(g) > MOST_CHOICES or "" in g for g in braced):
        raise GlobError(f"braces of {glob!r} are nested, empty or too many")
    total = 1
    for g in braced:
        total *= len(g)
    if total > MOST_PATTERNS:
        raise GlobError(f"{glob!r} stands for more than {MOST_PATTERNS} globs")
    out = ["".join(x) for x in itertools.product(*groups)]
    for x in out:
        check(x)
    return out


def pattern(glob: str) -> str:
    """An anchored pattern: ``**/`` is any folders, ``**`` anything, ``*`` and ``?`` stay within a name."""
    out = []
    for piece in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        out.append({"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", piece))
    return "\\A(?s:" + "".join(out) + ")\\z"


def patterns(globs: list[str]) -> list[str]:
    return [pattern(x) for g in globs for x in expanded(g)]
