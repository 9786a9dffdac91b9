"""Everything that extraction says of the files of a scan, whatever their formats."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import byte_length, protected_ranges, utf16_length
from . import extract, lexer, segments
from .lineage import checkpointed

MOST_UNITS = 10_000
SEGMENT = "path string, segment long, part long, line long, start_byte long, end_byte long, text string, ranges array<struct<start_byte:bigint,end_byte:bigint>>"


@dataclass
class Extraction:
    """Tables by path."""

    segments: DataFrame  # path, segment, line, start_byte, end_byte, text, ranges (in bytes of the file)
    suppressed: DataFrame  # path, n
    diagnostics: DataFrame  # path, line, code
    notices: DataFrame  # path, code
    generated: DataFrame  # path, marker, line of files with a marker in a comment

    def shape(self) -> DataFrame:
        """(path, shape): counts and codes that an edit may not change."""
        def listed(rows: DataFrame, name: str, *columns: str) -> DataFrame:
            return rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

        counts = self.segments.groupBy("path").agg(F.count("*").alias("segments"))
        both = counts.join(self.suppressed.withColumnRenamed("n", "suppressed"), "path", "full_outer").join(listed(self.diagnostics, "diagnostics", "line", "code"), "path", "full_outer").join(listed(self.notices, "notices", "code"), "path", "full_outer")
        return both.select("path", F.to_json(F.struct(F.coalesce("segments", F.lit(0)).alias("s"), F.coalesce("suppressed", F.lit(0)).alias("u"), "diagnostics", "notices")).alias("shape"))


def extracted(files: DataFrame, formats: Iterable[str], glossary: tuple[str, ...] = (), prefix: str = "prose") -> Extraction:
    """What there is in files (path, format, text); ``formats`` lists those that may occur."""
    pieces, suppressed, diagnostics, notices, generated = [], [], [], [], []
    empty = files.sparkSession.createDataFrame([], "path string, line long, code string")
    for f in sorted(formats):
        mine = files.where(F.col("format") == f).select("path", "text")
        if f == "markdown":
            parts = checkpointed(extract.markdown_parts(mine, "path", prefix=prefix))
            rows = extract.part_segments(parts, "path")
            pieces.append(rows.select("path", "line", "start_byte", "end_byte", "text"))
            suppressed.append(extract.markdown_suppressed(parts, "path"))
            diagnostics.append(extract.markdown_diagnostics(parts, "path"))
            notices.append(extract.markdown_notices(rows, "path"))
            generated.append(extract.first_markers(parts.where("kind = 'html'"), "path", "raw", "line", "start_byte"))
        else:
            lines = checkpointed(extract.code_lines(mine, "path", f, prefix=prefix))
            pieces.append(lines.where("outcome = 'segment'").select("path", "line", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("inner").alias("text")))
            suppressed.append(lines.where("outcome = 'suppressed'").groupBy("path").agg(F.count("*").alias("n")))
            diagnostics.append(extract.code_diagnostics(lines, "path", f))
            notices.append(extract.code_notices(lines, "path", f))
            generated.append(extract.first_markers(lines.where("part = 0 and kind = 'comment'"), "path", "whole", "line", "comment"))
    if not pieces:
        none = files.where("false")
        pieces = [none.select("path", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("start_byte"), F.lit(0).cast("long").alias("end_byte"), "text")]
        suppressed, diagnostics, notices, generated = [none.select("path", F.lit(0).cast("long").alias("n"))], [empty], [empty.select("path", "code")], [none.select("path", F.lit(None).cast("string").alias("marker"), F.lit(0).cast("long").alias("line"))]
    every = lambda frames: reduce(DataFrame.unionByName, frames)
    # the generator keeps ranges from being found once for the filter and again for the rows
    rows = every(pieces).withColumn("local", F.explode(F.array(protected_ranges("text", glossary=glossary))))
    whole = F.exists("local", lambda r: (r["start_byte"] == 0) & (r["end_byte"] == F.octet_length("text")))
    shifted = F.transform("local", lambda r: F.struct((r["start_byte"] + F.col("start_byte")).alias("start_byte"), (r["end_byte"] + F.col("start_byte")).alias("end_byte")))
    numbered = rows.where(~whole).withColumn("ranges", shifted).withColumn("segment", F.row_number().over(Window.partitionBy("path").orderBy("start_byte")).cast("long"))
    kept = checkpointed(numbered.select("path", "segment", "line", "start_byte", "end_byte", "text", "ranges"))
    return Extraction(kept, every(suppressed).where("n > 0"), every(diagnostics), every(notices), every(generated))


def prepared(rows: DataFrame, most: int = MOST_UNITS) -> DataFrame:
    """Segments ready for a request: (path, segment, part, line, start_byte, end_byte, text, ranges, code).

    A text of more than ``most`` UTF-16 units comes in parts, numbered from 1,
    with the ranges that touch them; one that cannot be cut keeps part 0 and gets
    the code oversized_segment, one whose bytes are not as many as its place has
    unmappable_segment. Others have part 0.
    """
    columns = ["path", "segment", "line", "start_byte", "end_byte", "text", "ranges"]
    # no text has more UTF-16 units than bytes
    long = (F.octet_length("text") > most) & (utf16_length("text") > most)
    fits = F.octet_length("text") == F.col("end_byte") - F.col("start_byte")
    local = F.transform("ranges", lambda r: F.struct((r["start_byte"] - F.col("start_byte")).alias("start_byte"), (r["end_byte"] - F.col("start_byte")).alias("end_byte")))
    coded = rows.select(*columns, F.when(long & ~fits, "unmappable_segment").when(long, "oversized_segment").alias("code"))
    # one pass: short texts go by the splitter as nulls
    tall = F.col("code") == "oversized_segment"
    ended = coded.withColumn("ends", extract.text_ends(most)(F.when(tall, F.col("text")), F.when(tall, local)))
    each = ended.select(*columns, "code", "ends", F.posexplode_outer("ends").alias("i", "to"))
    cut = F.col("to").isNotNull()
    begin = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.get("ends", F.col("i") - 1))
    text = F.call_function("substring", F.col("text"), (begin + 1).cast("int"), (F.col("to") - begin).cast("int"))
    first = F.col("start_byte") + byte_length(F.call_function("substring", F.col("text"), F.lit(1), begin.cast("int")))
    part = lambda own, other: F.when(cut, own).otherwise(other)
    parts = each.select(
        "path", "segment", "line", part(first, F.col("start_byte")).alias("start_byte"), part(first + byte_length(text), F.col("end_byte")).alias("end_byte"), part(text, F.col("text")).alias("text"), "ranges",
        part((F.col("i") + 1).cast("long"), F.lit(0).cast("long")).alias("part"), F.when(~cut, F.col("code")).alias("code"),
    )
    touching = F.filter("ranges", lambda r: (r["start_byte"] < F.col("end_byte")) & (r["end_byte"] > F.col("start_byte")))
    return parts.withColumn("ranges", F.when(F.col("part") > 0, touching).otherwise(F.col("ranges")))


def with_neighbours(rows: DataFrame, most: int = 500) -> DataFrame:
    return segments.with_context(rows, "path", "start_byte", "text", most)
