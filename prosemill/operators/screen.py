"""Screening: chunks of a file's prose are scored, and the greatest score gives the verdict."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import greedy_groups
from .lineage import checkpointed
from .rollups import verdict

CHUNK = 60_000
#: Texts that a scorer gets at once.
AT_ONCE = 32


class ScorerError(Exception):
    """A scorer's failure: missing_key, auth_failed, unreachable, unavailable, invalid_response or cancelled. A page of files fails as a whole."""


#: What a scorer is asked; the state of a call is the dialect, the glossary and the prose.
QUESTION = "How likely is it that this prose holds an error of spelling, grammar, punctuation, capitalization or usage?"
#: Statuses after which a call is made again.
RETRIED = {429, 500, 502, 503, 504, 529}
ATTEMPTS, BACKOFF_SECONDS, CONCURRENT = 3, 0.5, 4
#: A call: takes what is asked, gives (status, answer), status None where nothing answered.
Transport = Callable[[dict], tuple[int | None, dict | None]]


@dataclass(frozen=True)
class Answer:
    probability: float
    model: str
    input_tokens: int


def scorer_state(dialect: str, glossary: tuple[str, ...], prose: str) -> dict:
    return {"question": QUESTION, "dialect": dialect, "glossary": list(glossary), "prose": prose}


def read_answer(body: dict | None) -> Answer:
    """The answer in a body (probability, model, input_tokens, 0 if absent); others are invalid_response."""
    try:
        found = Answer(float(body["probability"]), str(body["model"]), int(body.get("input_tokens") or 0))
    except (TypeError, KeyError, ValueError, AttributeError):
        raise ScorerError("invalid_response") from None
    if not 0 <= found.probability <= 1 or not 1 <= len(found.model) <= 256 or found.input_tokens < 0:
        raise ScorerError("invalid_response")
    return found


def ask(transport: Transport, state: dict, sleep: Callable[[float], None] = time.sleep) -> Answer:
    """One answer. Busy and failing servers are asked ``ATTEMPTS`` times, with a wait that doubles; nothing else is repeated."""
    for attempt in range(1, ATTEMPTS + 1):
        status, body = transport(state)
        if status is None:
            raise ScorerError("unreachable")
        if status in (401, 403):
            raise ScorerError("auth_failed")
        if status not in RETRIED:
            if not 200 <= status < 300:
                raise ScorerError("invalid_response")
            return read_answer(body)
        if attempt < ATTEMPTS:
            sleep(BACKOFF_SECONDS * 2 ** (attempt - 1))
    raise ScorerError("unavailable")


def asked(chunked: DataFrame, key: str, transport: Transport, dialect: str, glossary: tuple[str, ...] = (), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, chunk, probability, model, input_tokens, code) of chunks (key, chunk, prose).

    A task has ``CONCURRENT`` calls under way at most. After a call has failed,
    calls that the task has not begun are not made and get ``cancelled``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = threading.Event()

        def call(prose: str) -> tuple[Answer | None, str | None]:
            if failed.is_set():
                return None, "cancelled"
            try:
                return ask(transport, scorer_state(dialect, glossary, prose), sleep), None
            except ScorerError as e:
                failed.set()
                return None, str(e)

        with ThreadPoolExecutor(CONCURRENT) as pool:
            for batch in batches:
                found = list(pool.map(call, batch.column(2).to_pylist()))
                columns = [[getattr(a, name) if a else None for a, _ in found] for name in ("probability", "model", "input_tokens")]
                types = [pa.float64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns, types), pa.array([c for _, c in found], pa.string())], names=[key, "chunk", "probability", "model", "input_tokens", "code"])

    return chunked.select(key, F.col("chunk").cast("long"), "prose").mapInArrow(run, f"{key} {dict(chunked.dtypes)[key]}, chunk long, probability double, model string, input_tokens long, code string")


def usage(answers: DataFrame, key: str) -> tuple[int, str | None]:
    """(tokens of all calls, model of the first one); raises the error of the first call that failed, if one did."""
    sums = answers.agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("tokens"), F.min_by("model", F.struct(key, "chunk")).alias("model"),
        F.min_by("code", F.when(F.col("code").isNotNull(), F.struct(F.col("code") == "cancelled", key, "chunk"))).alias("code"),
    ).first()
    if sums.code:
        raise ScorerError(sums.code)
    return sums.tokens, sums.model


def share_of_known_errors(lexicon: frozenset[str]) -> Callable[[list[str]], list[float]]:
    """An offline scorer: the share of words found in a list of misspellings, ten times over, at most 1."""

    def score(texts: list[str]) -> list[float]:
        out = []
        for t in texts:
            words = re.findall(r"[^\W\d_]+", t.lower())
            out.append(min(1.0, 10 * sum(w in lexicon for w in words) / len(words)) if words else 0.0)
        return out

    return score


def chunks(segments: DataFrame, key: str, text: str, order: str, most: int = CHUNK) -> DataFrame:
    """(key, chunk, prose): a file's segments, packed greedily in order; a longer one stands alone."""
    rows = segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.length(text).cast("long").alias("n")))).alias("items"))
    grouped = rows.select(key, F.explode(F.arrays_zip("items", greedy_groups("items", [(lambda x: x["n"], most)]).alias("chunk"))).alias("x"))
    return grouped.groupBy(key, F.col("x.chunk").alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x.items.o", "x.items.t"))), lambda s: s["t"]), "\n").alias("prose"))


def screened(files: DataFrame, segments: DataFrame, key: str, score: Callable[[list[str]], list[float]], text: str = "text", order: str = "segment", most: int = CHUNK) -> DataFrame:
    """(key, verdict, error_probability, code) for files (key, sha256, expected_sha256): a stale file is flagged unread."""
    marked, fresh = _marked(files, segments, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, score, key)

    return _verdicts(marked, chunks(fresh, key, text, order, most).select(key, "prose").mapInArrow(run, f"{key} {dict(segments.dtypes)[key]}, p double"), key)


def scored(batches: Iterator[pa.RecordBatch], score: Callable[[list[str]], list[float]], key: str) -> Iterator[pa.RecordBatch]:
    """(key, p) of batches (key, prose), ``AT_ONCE`` texts at a time, so that a task never holds all of a batch as strings."""
    for batch in batches:
        found = [p for at in range(0, batch.num_rows, AT_ONCE) for p in score(batch.column(1).slice(at, AT_ONCE).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=[key, "p"])


def screened_by_calls(files: DataFrame, segments: DataFrame, key: str, transport: Transport, dialect: str, glossary: tuple[str, ...] = (), text: str = "text", order: str = "segment", most: int = CHUNK, sleep: Callable[[float], None] = time.sleep) -> tuple[DataFrame, int, str | None]:
    """(verdicts as ``screened`` gives them, tokens, model) from a scorer that is called for each chunk; raises if a call fails."""
    marked, fresh = _marked(files, segments, key)
    # calls cost; they are made once
    answers = checkpointed(asked(chunks(fresh, key, text, order, most), key, transport, dialect, glossary, sleep))
    tokens, model = usage(answers, key)
    return _verdicts(marked, answers.select(key, F.col("probability").alias("p")), key), tokens, model


def _marked(files: DataFrame, segments: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    stale = F.when(~F.col("sha256").eqNullSafe(F.col("expected_sha256")), "snapshot_mismatch")
    marked = files.select(key, stale.alias("code"))
    return marked, segments.join(marked.where("code is null").select(key), key, "left_semi")


def _verdicts(marked: DataFrame, scored: DataFrame, key: str) -> DataFrame:
    joined = marked.join(scored.groupBy(key).agg(F.max("p").alias("error_probability")), key, "left")
    return joined.select(key, verdict(F.col("code"), F.col("error_probability")).alias("verdict"), "error_probability", "code")
