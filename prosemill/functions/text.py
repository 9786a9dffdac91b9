"""Column functions over prose: lengths, line ends, identities, occurrences and protected ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .glossary import glossary_ranges

# White space of the edge and URL rules, written as a Java class.
SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: The same characters, for trims.
SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
# What may not be edited, by family. Word edges are ASCII. Possessive runs, and the start of multipart, change no match; they spare attempts.
_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
PROTECTED = {
    "url": f"https?://[^{SPACE})\\]}}>,]+",
    "path": "(?:\\.\\.?/|/)[A-Za-z0-9._~/-]+",
    "multipart": "(?<![A-Za-z0-9._-])(?:[A-Za-z0-9._-]++/)+[A-Za-z0-9._-]+",
    "email": f"(?:{_EDGE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}{_END}",
    "template": "\\{\\{[^{}\\r\\n]+\\}\\}|\\$\\{[^{}\\r\\n]+\\}|%\\([^)\\r\\n]+\\)s",
    "placeholder": "<[A-Z][A-Z0-9_-]*>",
    "flag": "--[A-Za-z0-9][A-Za-z0-9-]*",
    "package": "@[A-Za-z0-9._-]+/[A-Za-z0-9._-]+",
    "identifier": f"(?:{_EDGE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=-))(?:[A-Za-z][A-Za-z0-9]*_[A-Za-z0-9_]+|[a-z]+[A-Z][A-Za-z0-9]*|[A-Za-z0-9_-]+\\.[A-Za-z0-9]{{1,8}}){_END}",
    "call": f"(?:{_EDGE}(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=\\$))[A-Za-z_$][A-Za-z0-9_$]*\\(\\)",
}


#: Literals without which a family has no match: texts without any of them are not searched.
NEEDLES = {"url": ("://",), "path": ("/",), "multipart": ("/",), "email": ("@",), "template": ("{", "%("), "placeholder": ("<",), "flag": ("--",), "package": ("@",), "call": ("()",)}
#: The same for families that no literal tells: a short pattern without which there is no match.
HINTS = {"identifier": "_|[a-z][A-Z]|\\.[A-Za-z0-9]"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf16_length(c: Column | str) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("long")


def byte_length(c: Column | str) -> Column:
    return F.octet_length(col(c)).cast("long")


def has_letter(c: Column | str) -> Column:
    return col(c).rlike("\\p{L}")


def file_id(path: Column | str) -> Column:
    return F.concat(F.lit("f_"), F.substring(F.sha2(col(path), 256), 1, 20))


def eol_style(c: Column | str) -> Column:
    """crlf, lf, cr, mixed or none, by which line ends a text has."""
    c = col(c)
    crlf = c.contains("\r\n")
    rest = F.replace(c, F.lit("\r\n"), F.lit(""))
    lf, cr = rest.contains("\n"), rest.contains("\r")
    kinds = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(c.isNull(), F.lit(None)).when(kinds == 0, "none").when(kinds > 1, "mixed").when(crlf, "crlf").when(lf, "lf").otherwise("cr")


def line_breaks(c: Column | str) -> Column:
    """The line breaks of a text in order."""
    return F.regexp_extract_all(col(c), F.lit("\\r\\n|\\r|\\n"), F.lit(0))


def edge_space(c: Column | str) -> Column:
    """Leading and trailing white space, with a mark between."""
    c = col(c)
    return F.concat(F.regexp_extract(c, f"\\A[{SPACE}]*", 0), F.lit("|"), F.regexp_extract(c, f"[{SPACE}]*\\z", 0))


def occurrences(c: Column | str, token: Column | str) -> Column:
    """How often a literal (a string, or a column of such) occurs, without overlaps."""
    c, token = col(c), token if isinstance(token, Column) else F.lit(token)
    return ((F.length(c) - F.length(F.replace(c, token, F.lit("")))) / F.length(token)).cast("long")


def found_once(c: Column | str, part: Column | str) -> Column:
    """not_found, ambiguous or null for exactly one place; places may overlap."""
    c, part = col(c), col(part)
    first = F.call_function("locate", part, c)
    second = F.call_function("locate", part, c, first + 1)
    return F.when(first == 0, "original_not_found").when(second > 0, "ambiguous_original")


def match_ranges(c: Column | str, pattern: str) -> Column:
    """array<struct<start_byte, end_byte>> of a pattern's non-empty matches, in bytes.

    Matches are set between marks in one pass, so the text falls into what is
    between matches and matches, in turn; a match starts where the bytes of all
    before it end. The mark is the NUL character; those of the text are taken
    for the next one, of the same length.
    """
    # few texts hold a NUL, and to translate goes character by character
    free = F.when(col(c).contains("\0"), F.translate(col(c), "\0", "\1")).otherwise(col(c))
    marked = F.regexp_replace(free, pattern, "\0$0\0")
    sizes = F.transform(F.split(marked, "\0"), lambda p: F.octet_length(p).cast("long"))
    empty = F.expr("named_struct('at', 0L, 'match', false, 'out', cast(array() as array<struct<start_byte:bigint,end_byte:bigint>>))")

    def step(acc: Column, size: Column) -> Column:
        end = acc["at"] + size
        out = F.when(acc["match"] & (size > 0), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start_byte"), end.alias("end_byte"))))).otherwise(acc["out"])
        return F.struct(end.alias("at"), (~acc["match"]).alias("match"), out.alias("out"))

    return F.coalesce(F.aggregate(sizes, empty, step)["out"], F.expr("cast(array() as array<struct<start_byte:bigint,end_byte:bigint>>)"))


def protected_ranges(c: Column | str, families=tuple(PROTECTED), glossary: tuple[str, ...] = ()) -> Column:
    """All protected ranges of a text, sorted by start and end, each once; glossary terms are literals, found in one pass."""
    found = [_if_held(c, NEEDLES.get(f, ()), HINTS.get(f), match_ranges(c, PROTECTED[f])) for f in families]
    if glossary:
        found.append(glossary_ranges(glossary)(col(c)))
    return found[0] if len(found) == 1 else _merged(F.concat(*found))


def _merged(ranges: Column) -> Column:
    """Ranges sorted, each once: as numbers of start and length, which are told apart by a hash set, where structs would be compared pair by pair."""
    keys = F.sort_array(F.array_distinct(F.transform(ranges, lambda r: F.shiftleft(r["start_byte"], 32) + r["end_byte"] - r["start_byte"])))
    return F.transform(keys, lambda k: F.struct(F.shiftright(k, 32).alias("start_byte"), (F.shiftright(k, 32) + k.bitwiseAND(F.lit(0xFFFFFFFF))).alias("end_byte")))


def _if_held(c: Column | str, needles: tuple[str, ...], hint: str | None, ranges: Column) -> Column:
    tests = [*(col(c).contains(n) for n in needles), *([col(c).rlike(hint)] if hint else [])]
    if not tests:
        return ranges
    held = tests[0]
    for t in tests[1:]:
        held = held | t
    return F.when(held, ranges).otherwise(F.expr("cast(array() as array<struct<start_byte:bigint,end_byte:bigint>>)"))


def span_of(source_map: Column | str, start: Column | str, end: Column | str) -> Column:
    """The first span (start, end, start_byte) of a segment's map that holds a stretch of its text, null if none does."""
    start, end = col(start), col(end)
    return F.get(F.filter(col(source_map), lambda m: (start >= m["start"]) & (end <= m["end"])), F.lit(0))


def mapped_range(text: Column | str, span: Column, start: Column | str, end: Column | str) -> Column:
    """struct<start_byte, end_byte> in the file of characters ``start`` to ``end`` of a segment, by the span that holds them."""
    text, start, end = col(text), col(start), col(end)
    sub = lambda a, n: byte_length(F.call_function("substring", text, (a + 1).cast("int"), n.cast("int")))
    first = span["start_byte"] + sub(span["start"], start - span["start"])
    return F.struct(first.alias("start_byte"), (first + sub(start, end - start)).alias("end_byte"))


def display_position(c: Column | str, offset: Column | str) -> Column:
    """struct<line, column>, both from 1, of a character offset; CRLF, CR and LF end lines."""
    before = F.split(F.call_function("substring", col(c), F.lit(1), col(offset).cast("int")), "\r\n|\r|\n")
    # an offset between CR and LF stands on the line that CR ends
    return F.struct(F.size(before).cast("long").alias("line"), (F.length(F.element_at(before, -1)) + 1).cast("long").alias("column"))


def utf16_order(c: Column | str) -> Column:
    """A sort key by UTF-16 units."""
    return F.encode(col(c), "UTF-16BE")

def overlaps(ranges: Column | str, start: Column | str, end: Column | str) -> Column:
    """Whether a half-open byte range touches any of the ranges."""
    start, end = col(start), col(end)
    return F.exists(col(ranges), lambda r: (start < r["end_byte"]) & (end > r["start_byte"]))


def spliced(content: Column | str, edits: Column | str) -> Column:
    """Binary content with edits (start_byte, end_byte, replacement) applied; they must be sorted and apart."""
    raw = col(content).cast("binary")
    start = F.expr("named_struct('at', 0L, 'out', cast('' as binary))")

    def step(acc: Column, e: Column) -> Column:
        kept = F.call_function("substring", raw, (acc["at"] + 1).cast("int"), (e["start_byte"] - acc["at"]).cast("int"))
        return F.struct(e["end_byte"].cast("long").alias("at"), F.concat(acc["out"], kept, e["replacement"].cast("binary")).alias("out"))

    last = F.aggregate(col(edits), start, step)
    return F.concat(last["out"], F.call_function("substring", raw, (last["at"] + 1).cast("int"), F.octet_length(raw)))


def greedy_groups(items: Column | str, limits: list[tuple], most: int | None = None) -> Column:
    """Group number of each array item, filled greedily in order.

    ``limits`` lists (weight of an item, budget); a group closes before the item
    that would pass a budget, or the number of ``most`` items. An item that is
    heavier than a budget stands alone.
    """
    fields = [f"w{i}" for i in range(len(limits))]
    init = F.struct(F.lit(0).alias("group"), F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(f) for f in fields], F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, item: Column) -> Column:
        over = F.lit(False) if most is None else acc["n"] >= most
        for f, (weigh, budget) in zip(fields, limits, strict=True):
            over = over | (acc[f] + weigh(item) > budget)
        fresh = over & (acc["n"] > 0)
        group = F.when(fresh, acc["group"] + 1).otherwise(acc["group"])
        sums = [(F.when(fresh, F.lit(0).cast("long")).otherwise(acc[f]) + weigh(item)).alias(f) for f, (weigh, _) in zip(fields, limits, strict=True)]
        return F.struct(group.alias("group"), (F.when(fresh, 0).otherwise(acc["n"]) + 1).alias("n"), *sums, F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(col(items), init, step)["out"]
