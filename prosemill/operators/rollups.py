"""Rollups of a scan and of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.5, 0.7]
FLAGGED_FROM = 0.2


def summary(entries: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a scan, its narrow_coverage flag, status and the reason why nothing is eligible.

    entries: (path_type, state, code, eligible_segments, skipped_segments, suppressed_segments),
    and diagnostics and notices, which are summed up where there are any.
    """
    told = {"diagnostics": "diagnostic_count", "notices": "notice_count"}
    told = {c: name for c, name in told.items() if c in entries.columns}
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long")
    skipped = F.col("state") == "skipped"
    sums = entries.groupBy(*by).agg(
        F.count_if(F.col("state") == "eligible").alias("files_eligible"), F.count_if(F.col("path_type") == "file").alias("files_considered"),
        F.count_if(skipped).alias("paths_skipped"), F.count_if(F.col("state") == "failed").alias("paths_failed"),
        n("eligible_segments").alias("eligible_segments"), n("skipped_segments").alias("skipped_segments"), n("suppressed_segments").alias("suppressed_segments"),
        F.count_if(skipped & F.col("code").isin("invalid_utf8", "binary")).alias("encodings"), F.count_if(skipped & (F.col("code") == "too_large")).alias("oversized"),
        F.count_if(skipped & F.col("code").isin("unsupported_format", "plain_text_unsupported")).alias("unsupported"),
        *(n(c).alias(name) for c, name in told.items()),
    )
    narrow = (F.col("files_eligible") == 0) | ((F.col("files_considered") >= 10) & (F.col("files_eligible") / F.nullif("files_considered", F.lit(0)) < 0.5))
    status = F.when(F.col("paths_failed") > 0, "incomplete").when(F.col("eligible_segments") == 0, "no_eligible_text").otherwise("preview")
    has = F.col("files_eligible") > 0
    reason = (
        F.when(F.col("eligible_segments") > 0, None).when(has & (F.col("suppressed_segments") > 0), "all_prose_suppressed")
        .when(has & (F.col("skipped_segments") > 0), "prose_unavailable").when(has, "no_extractable_prose").when(F.col("paths_failed") > 0, "extraction_failure")
        .when(F.col("encodings") > 0, "unsupported_encoding").when(F.col("oversized") > 0, "oversized_files")
        .when((F.col("paths_skipped") > 0) & (F.col("unsupported") == F.col("paths_skipped")), "no_supported_file_types").when(F.col("paths_skipped") > 0, "all_candidates_excluded").otherwise("empty_scope")
    )
    return sums.select(*by, "files_eligible", "files_considered", "paths_skipped", "paths_failed", "eligible_segments", "skipped_segments", "suppressed_segments", *told.values(), narrow.alias("narrow_coverage"), status.alias("status"), reason.alias("reason"))


def by_format(entries: DataFrame) -> DataFrame:
    """(format, files, eligible_segments, skipped_segments, suppressed_segments) of eligible files, in the order of a dictionary."""
    n = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("long").alias(c)
    sums = entries.where("state = 'eligible'").groupBy("format").agg(F.count("*").alias("files"), n("eligible_segments"), n("skipped_segments"), n("suppressed_segments"))
    return sums.orderBy(F.collate("format", "UNICODE"))


def by_reason(entries: DataFrame) -> DataFrame:
    """(state, code, paths) of what is skipped and what failed, in the order of a dictionary."""
    return entries.where("state in ('skipped', 'failed')").groupBy("state", F.coalesce("code", F.lit("unknown")).alias("code")).agg(F.count("*").alias("paths")).orderBy(F.collate("state", "UNICODE"), F.collate("code", "UNICODE"))


def categories(proposals: DataFrame, validated: DataFrame, file: str) -> DataFrame:
    """(file, category, edits): the edits of each category in files whose answer is accepted. A null category counts as other."""
    accepted = validated.where("code is null").select(file)
    kept = proposals.join(accepted, file, "left_semi")
    return kept.groupBy(file, F.coalesce("category", F.lit("other")).alias("category")).agg(F.count("*").alias("edits"))


def verdict(code: Column, most: Column) -> Column:
    """flagged for a file that could not be read or scores at the threshold, clean below it, no_segments without prose."""
    return F.when(code.isNotNull(), "flagged").when(most.isNull(), "no_segments").when(most >= FLAGGED_FROM, "flagged").otherwise("clean")


def threshold_sweep(items: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """(threshold, gate_recall, skip_rate) over items (expected long, code, verdict, probability).

    An item with a code always counts as recalled, one without prose always as
    skipped. Each item is read once: a sum for each threshold, then unpivoted.
    """
    sums = []
    for i, t in enumerate(thresholds):
        past = F.coalesce(F.col("probability") >= t, F.lit(False)) | F.col("code").isNotNull()
        sums += [F.sum(F.when(past, F.col("expected")).otherwise(0)).alias(f"r{i}"), F.count_if((F.col("verdict") == "no_segments") | ~past).alias(f"s{i}")]
    total = items.agg(F.sum("expected").alias("expected"), F.count("*").alias("n"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"r{i}").alias("r"), F.col(f"s{i}").alias("s")) for i, t in enumerate(thresholds)])).alias("x")
    return total.select("expected", "n", rows).select("x.threshold", F.round(F.coalesce(F.col("x.r") / F.nullif("expected", F.lit(0)), F.lit(1.0)), 9).alias("gate_recall"), F.round(F.coalesce(F.col("x.s") / F.nullif("n", F.lit(0)), F.lit(0.0)), 9).alias("skip_rate"))


def matched(gold: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gold, predicted, tp, fp, fn): multisets compared by key."""
    g = gold.groupBy(*keys).agg(F.count("*").alias("gold"))
    p = predictions.groupBy(*keys).agg(F.count("*").alias("predicted"))
    both = g.join(p, keys, "full_outer").select(*keys, F.coalesce("gold", F.lit(0)).cast("long").alias("gold"), F.coalesce("predicted", F.lit(0)).cast("long").alias("predicted"))
    tp = F.least("gold", "predicted")
    return both.withColumns({"tp": tp, "fp": F.col("predicted") - tp, "fn": F.col("gold") - tp})


def scores(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """True and false positives, false negatives, precision and recall; 1 where there is nothing to count."""
    sums = pairs.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])
    share = lambda other: F.round(F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(other), F.lit(0)), F.lit(1.0)), 9)
    return sums.select(*by, "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
