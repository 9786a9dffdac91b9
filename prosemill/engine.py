"""One object for the whole way of a tree: discover, extract, screen, validate, apply, score."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.globs import patterns
from .operators import evaluate, extraction, paging, policy, protocol, rollups, screen, validation
from .operators.lineage import checkpointed
from .sources import apply, config, tree

MOST_SEGMENTS = 10_000


class Engine:
    """Files are read once; everything else is a plan over them. What several steps read is checkpointed."""

    def __init__(self, spark: SparkSession, root: str, overrides: dict | None = None, config_name: str = ".prose.json", prefix: str = "prose", targets: tuple[str, ...] = ()):
        """``targets`` are paths below the root, files or folders, that a scan keeps to; none stands for all."""
        self.spark, self.root, self.prefix = spark, root, prefix
        self.preferences = config.load(root, overrides or {}, config_name)
        p = self.preferences
        protocol.check_glossary(list(p.glossary))
        self.policy_digest = protocol.policy_digest(root, dataclasses.asdict(p))
        # excluded and hidden folders are not entered; a link or folder with a name of the policy gets the policy's code
        self._take(tree.read_tree(spark, root, tuple(policy.MANDATORY_DIRECTORIES), not p.include_hidden, tuple(patterns(list(p.exclude))), targets))

    @classmethod
    def of_table(cls, files: DataFrame, overrides: dict | None = None, prefix: str = "prose", name: str = "table") -> Engine:
        """An engine over a table (path, content) of files, such as a crawl's; there is nothing to apply edits to.

        Contents are strings or bytes; paths are relative, not null and distinct. Rows
        pass the policy, the size limit and the checks of contents as files of a tree do.
        """
        engine = cls.__new__(cls)
        engine.spark, engine.root, engine.prefix = files.sparkSession, name, prefix
        engine.preferences = config.merged({}, overrides or {})
        protocol.check_glossary(list(engine.preferences.glossary))
        engine.policy_digest = protocol.policy_digest(name, dataclasses.asdict(engine.preferences))
        content = F.col("content").cast("binary")
        size = F.octet_length(content).cast("long")
        code = F.when(~policy.is_safe("path"), "unsafe_path").when(content.isNull(), "read_failed").when(size > tree.MOST_BYTES, "too_large")
        engine._take(files.select("path", F.lit("file").alias("path_type"), code.alias("code"), size.alias("byte_length"), F.when(code.isNull(), content).alias("content")))
        return engine

    def _take(self, rows: DataFrame) -> None:
        """Read (path, path_type, code, byte_length, content) once, and say what policy and contents make of each."""
        p = self.preferences
        named = policy.path_code("path", list(p.exclude), p.include_hidden)
        kind = F.when(named.isNotNull(), "unknown").otherwise(F.col("path_type"))
        coded = rows.withColumn("code", F.coalesce(named, F.col("code"), F.when(F.col("path_type") == "file", policy.scan_code("path", list(p.include), list(p.exclude), p.include_hidden)), policy.content_code("content"))).withColumn("path_type", kind)
        files = coded.withColumns({
            "state": policy.state("code"), "format": policy.file_format("path"), "id": T.file_id("path"), "sha256": F.sha2("content", 256), "text": F.when(F.col("code").isNull(), F.col("content").cast("string")),
        })
        # all later steps see the contents of one scan
        self.files = checkpointed(files.drop("content"))
        self._found: extraction.Extraction | None = None
        self._ready: DataFrame | None = None

    def _eligible(self) -> DataFrame:
        return self.files.where("state = 'eligible'").select("path", "format", "text", "sha256", "id")

    def _formats(self, files: DataFrame) -> list[str]:
        return [r.format for r in files.select("format").distinct().collect()]  # eight at most

    def extraction(self) -> extraction.Extraction:
        if self._found is None:
            files = self._eligible()
            self._found = extraction.extracted(files, self._formats(files), self.preferences.glossary, self.prefix)
        return self._found

    def prepared(self) -> DataFrame:
        """(path, segment, part, line, start_byte, end_byte, text, ranges, code): segments, long ones in parts; oversized_segment for one that cannot be cut."""
        if self._ready is None:
            found = self.extraction()
            rows = found.segments.join(found.generated, "path", "left_anti")
            self._ready = checkpointed(extraction.prepared(rows))
        return self._ready

    def segments(self) -> DataFrame:
        """(path, segment, part, line, start_byte, end_byte, text, ranges, context): the prose that may be edited."""
        return extraction.with_neighbours(self.prepared().where("code is null").drop("code"))

    def diagnostics(self) -> DataFrame:
        return self.extraction().diagnostics

    def notices(self) -> DataFrame:
        return self.extraction().notices

    def discover(self) -> DataFrame:
        """(path, path_type, state, code, format, id, sha256, byte_length, extracted_segments, eligible_segments, skipped_segments, suppressed_segments, diagnostics, notices, marker, marker_line): every path and what became of it."""
        found = self.extraction()
        counts = self.prepared().groupBy("path").agg(F.count_if(F.col("code").isNull()).alias("n"), F.count_if(F.col("code").isNotNull()).alias("skipped"), F.count_if(F.col("part") <= 1).alias("extracted"))
        broken = found.diagnostics.where("code = 'parse_error'").select("path").distinct().withColumn("broken", F.lit("parse_failed"))
        marked = found.generated.select("path", F.lit("generated_marker").alias("marked"), "marker", F.col("line").alias("marker_line"))
        told = found.diagnostics.groupBy("path").agg(F.count("*").alias("diagnosed"))
        noted = found.notices.groupBy("path").agg(F.count("*").alias("noticed"))
        joined = self.files.drop("text")
        for more in (counts, found.suppressed.withColumnRenamed("n", "suppressed"), broken, marked, told, noted):
            joined = joined.join(more, "path", "left")
        many = F.when(F.col("n") > MOST_SEGMENTS, "too_many_segments")
        coded = joined.withColumn("code", F.coalesce("code", "marked", "broken", many)).withColumn("state", policy.state("code"))
        here = lambda c: F.when(F.col("state") == "eligible", F.coalesce(c, F.lit(0)))
        return coded.select(
            "path", "path_type", "state", "code", "format", "id", "sha256", "byte_length", here("extracted").alias("extracted_segments"), here("n").alias("eligible_segments"), here("skipped").alias("skipped_segments"),
            here("suppressed").alias("suppressed_segments"), here("diagnosed").alias("diagnostics"), here("noticed").alias("notices"), "marker", "marker_line",
        )

    def summary(self) -> DataFrame:
        """One row of counts, status and reason."""
        return rollups.summary(self.discover().withColumn("all", F.lit(1)), ["all"]).drop("all")

    def by_format(self) -> DataFrame:
        return rollups.by_format(self.discover())

    def by_reason(self) -> DataFrame:
        return rollups.by_reason(self.discover())

    def page(self, cursor: int = 0, policy_digest: str | None = None, scope: str | None = None, size: int = protocol.SCREEN_PAGE) -> tuple[DataFrame, int | None, str]:
        """(eligible entries from ``cursor`` on, next cursor, digest of the scan); later pages must name the digests that they go on from."""
        protocol.guard(cursor, policy_digest, self.policy_digest, "policy_mismatch")
        entries = self.discover()
        now = protocol.scope_digest(entries, self.policy_digest)
        protocol.guard(cursor, scope, now, "scope_mismatch")
        rows, following, _ = protocol.page(entries.where("state = 'eligible'"), cursor, size)
        return rows, following, now

    def _unchanged(self, path: str, cursor: int, snapshot: str | None) -> None:
        """Later pages must name the digest of the file that they go on from; a named one must be the present one."""
        now = self._eligible().where(F.col("path") == path).select("sha256").first()
        protocol.guard(cursor, snapshot, now.sha256 if now else "", "snapshot_mismatch")

    def response(self, path: str, snapshot: str | None = None) -> DataFrame:
        """Segments, diagnostics and notices of one file; ``snapshot`` is the digest that the caller saw."""
        one = F.col("path") == path
        self._unchanged(path, 0, snapshot)
        return protocol.response(self.segments().where(one), self.diagnostics().where(one), self.notices().where(one))

    def records(self) -> DataFrame:
        """What is sent of each file, segments with their neighbours, as protocol.records() has it."""
        return protocol.records(extraction.with_neighbours(self.prepared()), self.diagnostics(), self.notices())

    def record_pages(self) -> DataFrame:
        """(path, page, cursor, next_cursor, records, characters, json_bytes): where requests for the records of a file start."""
        return paging.page_starts(paging.paged(self.records(), "path", "ord", "characters", "json_bytes"), "path", "ord")

    def record_page(self, path: str, cursor: int = 0, snapshot: str | None = None) -> tuple[DataFrame, int | None, int]:
        """(records of a file from ``cursor`` on, next cursor, number of all): as much as the budgets let through."""
        self._unchanged(path, cursor, snapshot)
        mine = checkpointed(self.records().where(F.col("path") == path))
        total = mine.count()
        if cursor > total:
            raise protocol.ProtocolError("invalid_cursor")
        rest = paging.paged(mine.where(F.col("ord") >= cursor), "path", "ord", "characters", "json_bytes")
        rows = mine.join(rest.select("path", "ord", "page", F.col("code").alias("page_code")), ["path", "ord"])
        if rows.where((F.col("ord") == cursor) & F.col("page_code").isNotNull()).limit(1).count():
            raise protocol.ProtocolError("record_too_large")
        here = rows.where("page = 0 and page_code is null").drop("page", "page_code")
        end = cursor + here.count()
        return here, end if end < total else None, total

    def screen(self, expected: DataFrame, score: Callable[[list[str]], list[float]]) -> DataFrame:
        """(path, verdict, error_probability, code) of the files (path, expected_sha256) of an earlier scan."""
        now = expected.join(self._eligible().select("path", "sha256"), "path", "left")
        return screen.screened(now, self.segments(), "path", score, order="start_byte")

    def screen_page(self, transport: screen.Transport, cursor: int = 0, policy_digest: str | None = None, scope: str | None = None) -> dict:
        """Verdicts of a page of eligible files by a scorer that is called for each chunk of their prose.

        Gives items (path, verdict, error_probability, code), total_files, next_cursor,
        scope, threshold, model and input_tokens. A page fails as a whole.
        """
        protocol.guard(cursor, policy_digest, self.policy_digest, "policy_mismatch")
        entries = self.discover()
        now = protocol.scope_digest(entries, self.policy_digest)
        protocol.guard(cursor, scope, now, "scope_mismatch")
        rows, following, total = protocol.page(entries.where("state = 'eligible'"), cursor)
        files = checkpointed(rows.select("path", "sha256", F.col("sha256").alias("expected_sha256")))
        items, tokens, model = screen.screened_by_calls(files, self.segments(), "path", transport, self.preferences.dialect, self.preferences.glossary, order="start_byte")
        return {"items": items, "total_files": total, "next_cursor": following, "scope": now, "threshold": rollups.FLAGGED_FROM, "model": model, "input_tokens": tokens}

    def score(self, gold: str, predictions: str, limit: int | None = None, results: str | None = None) -> tuple[DataFrame, DataFrame]:
        """(scores by category, expectations whose file is not eligible) of predictions against labelled files, both JSON.

        Of the first ``limit`` files only, if that is set; scores are added to the JSON lines in the folder ``results``.
        """
        expected, given = evaluate.read_gold(self.spark, gold), evaluate.read_predictions(self.spark, predictions)
        if limit is not None:
            first = expected.select("path").distinct().orderBy("path").limit(limit)
            expected, given = expected.join(first, "path", "left_semi"), given.join(first, "path", "left_semi")
        pairs = rollups.matched(expected, given, ["path", "original", "replacement", "category"])
        scores = rollups.scores(pairs, ["category"])
        if results:
            evaluate.write_results(scores, results)
        return scores, evaluate.not_eligible(expected, self.discover())

    def validate(self, responses: DataFrame, proposals: DataFrame) -> DataFrame:
        """(path, code, accepted, candidate, before_sha256): each answered file with its first reject code, or its new content.

        responses: (path, segment), one for each segment, parts of a long one as (path, segment, part);
        proposals: (path, segment, proposal, original, replacement), with the part where there are parts.
        Candidates are extracted again: counts, diagnostics and notices may not change.
        """
        ready = self.prepared().where("code is null").drop("code")
        name = F.to_json(F.struct("segment", "part"))
        part = lambda rows: rows if "part" in rows.columns else rows.withColumn("part", F.lit(0).cast("long"))
        rows = ready.withColumn("name", name)
        answers, offers = part(responses).withColumn("name", name), part(proposals).withColumn("name", name)
        answered = rows.join(answers.select("path").distinct(), "path", "left_semi")
        files = validation.reconciled(answered, answers, "path", "name").select("path", F.col("code").alias("file_code"))
        formats = self._eligible().select("path", "format", "text", "sha256").withColumnRenamed("text", "file_text")
        each = offers.drop("segment", "part").join(rows.select("path", "segment", "part", "name", "text", "start_byte", "ranges"), ["path", "name"]).join(formats.select("path", "format", "file_text"), "path")
        spans = F.array(F.struct(F.lit(0).alias("start"), F.length("text").alias("end"), F.col("start_byte").alias("start_byte")))
        code = validation.proposal_code("text", "original", "replacement", "ranges", "start_byte", validation.tokens_of("format"))
        coded = each.withColumn("code", F.coalesce(code, validation.mapping_code("text", "original", spans, "file_text")))
        begin = F.col("start_byte") + validation.edit_offset("text", "original")
        coded = coded.select("path", "segment", "part", "proposal", "replacement", "code", begin.alias("begin"), (begin + T.byte_length("original")).alias("end"))
        coded = checkpointed(coded)
        first = validation.file_codes(coded.withColumn("segment", F.struct("segment", "part")), "path").withColumnRenamed("code", "proposal_code")
        apart = validation.overlapping(coded.where("code is null").select("path", F.col("begin").alias("start_byte"), F.col("end").alias("end_byte"), "replacement"), "path")
        edits = apart.groupBy("path").agg(F.max("overlaps").alias("overlaps"), F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "replacement"))).alias("edits"))
        joined = files.join(first, "path", "left").join(edits, "path", "left").join(formats, "path")
        none = F.expr("cast(array() as array<struct<start_byte:bigint,end_byte:bigint,replacement:string>>)")
        candidate = T.spliced("file_text", F.coalesce("edits", none))
        early = F.coalesce("file_code", "proposal_code", F.when(F.col("overlaps"), "overlapping_proposals"))
        late = F.coalesce(F.when(F.octet_length("candidate") > validation.MOST_CANDIDATE_BYTES, "candidate_too_large"), validation.structure_code("file_text", F.col("candidate").cast("string")))
        out = joined.withColumn("early", early).withColumn("candidate", F.when(F.col("early").isNull(), candidate)).withColumn("code", F.coalesce("early", late))
        out = checkpointed(out.select("path", "format", "code", "accepted", "candidate", "sha256"))
        changed = out.where("code is null").select("path", "format", F.col("candidate").cast("string").alias("text"))
        again = extraction.extracted(changed, self._formats(changed), self.preferences.glossary, self.prefix)
        broken = again.diagnostics.where("code = 'parse_error'").select("path").distinct().withColumn("broken", F.lit(True))
        shapes = again.shape().withColumnRenamed("shape", "after").join(self.extraction().shape(), "path", "full_outer").where(~F.col("after").eqNullSafe(F.col("shape"))).select("path", F.lit(True).alias("differs"))
        checked = out.join(shapes, "path", "left").join(broken, "path", "left")
        final = F.coalesce("code", F.when(F.col("broken"), "candidate_parse_failed"), F.when(F.col("differs"), "structural_invariant_failed"))
        checked = checked.withColumn("code", final)
        return checked.select("path", "code", F.when(F.col("code").isNull(), F.coalesce("accepted", F.lit(0))).otherwise(0).cast("long").alias("accepted"), F.when(F.col("code").isNull(), F.col("candidate")).alias("candidate"), F.col("sha256").alias("before_sha256"))

    def apply(self, validated: DataFrame, state: str) -> list[tuple[str, str]]:
        """Commits validated files; returns (path, new digest, ``unchanged`` or an error code)."""
        rows = validated.where("code is null").select("path", "before_sha256", "candidate", F.col("accepted").alias("proposals"))
        return apply.apply_candidates(rows, self.root, state)
