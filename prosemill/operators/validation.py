"""Validation of proposals: the first failing test names the reject code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import byte_length, col, edge_space, found_once, line_breaks, mapped_range, occurrences, overlaps, span_of, utf16_length

# Delimiters whose number an edit may not change.
MARKDOWN_TOKENS = ["`", "[", "]", "(", ")", "{", "}", "<", ">", "#", "*", "_", "~", "!", "|", "\\"]
CODE_TOKENS = ["/*", "*/", "//", "```", "\\"]
PYTHON_TOKENS = [*CODE_TOKENS, "'''", '"""']
MOST_CANDIDATE_BYTES = 1 << 20


def tokens_of(file_format: Column | str) -> Column:
    """The delimiters that an edit of a file of this format may not add or remove."""
    listed = lambda tokens: F.array(*[F.lit(t) for t in tokens])
    return F.when(col(file_format) == "markdown", listed(MARKDOWN_TOKENS)).when(col(file_format) == "python", listed(PYTHON_TOKENS)).otherwise(listed(CODE_TOKENS))


def replacement_code(original: Column | str, replacement: Column | str, tokens: list[str] | Column = tuple(MARKDOWN_TOKENS)) -> Column:
    """Why a replacement is unsafe in itself; null if it isn't."""
    o, r = col(original), col(replacement)
    listed = tokens if isinstance(tokens, Column) else F.array(*[F.lit(t) for t in tokens])
    changed = F.exists(listed, lambda t: occurrences(o, t) != occurrences(r, t))
    grown = (utf16_length(r) > utf16_length(o) * 2 + 64) | (F.abs(utf16_length(r) - utf16_length(o)) > 128)
    return (
        F.when(o == r, "unchanged_proposal")
        .when(r.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), "unsafe_replacement")
        .when(edge_space(o) != edge_space(r), "whitespace_changed")
        .when(line_breaks(o) != line_breaks(r), "line_structure_changed")
        .when(grown, "replacement_too_large")
        .when(changed, "unsafe_delimiter_change")
    )


def proposal_code(text: Column | str, original: Column | str, replacement: Column | str, ranges: Column | str, start_byte: Column | str, tokens: list[str] | Column = tuple(MARKDOWN_TOKENS)) -> Column:
    """The reject code of one proposal for a segment, or null. Ranges and start are in bytes of the file."""
    begin = col(start_byte) + edit_offset(text, original)
    return F.coalesce(replacement_code(original, replacement, tokens), found_once(text, original), F.when(overlaps(ranges, begin, begin + byte_length(original)), "protected_range"))


def mapping_code(text: Column | str, original: Column | str, source_map: Column | str, content: Column | str) -> Column:
    """unmappable_proposal if no span of the segment's map holds the original, source_mapping_mismatch if the file has other bytes there, else null."""
    start = F.call_function("locate", col(original), col(text)) - 1
    end = start + F.length(col(original))
    span = span_of(source_map, start, end)
    at = mapped_range(text, span, start, end)
    held = F.call_function("substring", col(content).cast("binary"), (at["start_byte"] + 1).cast("int"), (at["end_byte"] - at["start_byte"]).cast("int"))
    return F.when(span.isNull(), "unmappable_proposal").when(held != col(original).cast("binary"), "source_mapping_mismatch")


def structure_code(before: Column | str, after: Column | str) -> Column:
    """file_structure_changed if a byte-order mark or the line end at the end of a file came or went."""
    b, a = col(before), col(after)
    return F.when((a.startswith("\ufeff") != b.startswith("\ufeff")) | (a.rlike("[\\r\\n]\\z") != b.rlike("[\\r\\n]\\z")), "file_structure_changed")


def edit_offset(text: Column | str, original: Column | str) -> Column:
    """Byte offset of the first place of ``original``."""
    at = F.call_function("locate", col(original), col(text))
    return byte_length(F.call_function("substring", col(text), F.lit(1), at - 1))


def reconciled(eligible: DataFrame, responses: DataFrame, file: str, segment: str) -> DataFrame:
    """(file, code, expected, received): duplicate, unknown or incomplete responses by file, in this order; code null if all is well."""
    e = eligible.select(file, segment).distinct().withColumn("e", F.lit(1))
    r = responses.groupBy(file, segment).agg(F.count("*").alias("r"))
    both = e.join(r, [file, segment], "full_outer")
    sums = both.groupBy(file).agg(F.max(F.coalesce("r", F.lit(0))).alias("most"), F.max(F.when(F.col("e").isNull(), 1).otherwise(0)).alias("unknown"), F.count("e").alias("expected"), F.count("r").alias("received"))
    code = F.when(F.col("most") > 1, "duplicate_segment_response").when(F.col("unknown") == 1, "unknown_segment_response").when(F.col("expected") != F.col("received"), "incomplete_segment_responses")
    return sums.select(file, code.alias("code"), "expected", "received")


def overlapping(edits: DataFrame, file: str) -> DataFrame:
    """Adds ``overlaps``: whether an edit starts before the one before it ends."""
    w = Window.partitionBy(file).orderBy("start_byte", "end_byte")
    return edits.withColumn("overlaps", F.coalesce(F.col("start_byte") < F.lag("end_byte").over(w), F.lit(False)))


def file_codes(proposals: DataFrame, file: str) -> DataFrame:
    """(file, code, accepted): the first code by segment and proposal order; any code rejects the file."""
    first = F.min_by("code", F.when(F.col("code").isNotNull(), F.struct("segment", "proposal")))
    return proposals.groupBy(file).agg(first.alias("code"), F.count("*").alias("n")).select(file, "code", F.when(F.col("code").isNull(), F.col("n")).otherwise(0).cast("long").alias("accepted"))
