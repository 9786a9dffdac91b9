"""Quality rules as weak supervision.

Rules vote good, bad or abstain on each document. Votes are counted by pattern
over all documents; there are at most 3 to the number of rules patterns, so the
expectation-maximisation of the rules' accuracies works on a table of fixed
size. A document is kept if its posterior probability of being good is at
least one half.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored

#: Pseudo-documents of the priors: bad and good votes of a rule on bad and on good documents.
PRIOR = np.array([[1.0, 1.0], [1.0, 99.0]])
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (rule, votes bad if, votes good if, over the measures below); otherwise it abstains.
RULES = [
    ("length", "n_words < 5", "n_words >= 60"),
    ("symbols", "n_symbols > 0.05 * n_words", "n_symbols <= 0.005 * n_words"),
    ("repeated_lines", "n_dup_lines >= 3 and n_dup_lines > 0.4 * n_lines", "n_dup_lines = 0"),
    ("repeated_words", "n_repeat_words > 0.35 * n_words and n_repeat_words > 20", "n_repeat_words <= 0.1 * n_words"),
    ("word_length", "word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3.5 * n_words and 9 * n_words"),
    ("letters", "n_letters < 0.75 * word_chars", "n_letters >= 0.85 * word_chars"),
    ("variety", "n_distinct < 0.15 * n_words", "n_distinct >= 0.3 * n_words"),
    ("sentences", "n_stops = 0 or n_words > 80 * n_stops or n_words < 1.5 * n_stops", "n_words between 3 * n_stops and 40 * n_stops"),
    ("capitals", "n_capitals > 0.3 * word_chars", "n_capitals <= 0.1 * word_chars"),
    ("symbol_words", "n_symbol_words > 0.05 * n_words", "n_symbol_words <= 0.01 * n_words"),
    ("symbol_ends", "n_symbol_ends > 0.05 * n_words", "n_symbol_ends <= 0.01 * n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_distinct", "n_stops", "n_capitals", "n_symbol_words", "n_symbol_ends"]
_SYMBOL_WORD = re.compile(r"[^\x20\x09-\x0D#*$%&|<>]*[#*$%&|<>][^\x20\x09-\x0D]*")
_SYMBOL_END = re.compile(r"[#*$%&|<>](?![^\x20\x09-\x0D])")


def repeated_words(numbers: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more. numbers: one for each word, equal for equal words."""
    n = len(numbers) - width + 1
    if n < 2:
        return 0
    base = int(numbers.max()) + 1
    codes = numbers[:n]
    for i in range(1, width):
        _, codes = np.unique(codes * base + numbers[i : n + i], return_inverse=True)
    again = np.bincount(codes)[codes] > 1
    covered = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + width, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def measure(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for a text; zeros for a null or empty one."""
    if not text:
        return (0,) * len(MEASURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return (0,) * len(MEASURES)
    numbering: dict[bytes, int] = {}
    numbers = np.array([numbering.setdefault(w, len(numbering)) for w in words], dtype=np.int64)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    chars = len(text) - sum(text.count(c) for c in _SPACES)
    symbols = sum(text.count(c) for c in _SYMBOLS)
    letters = chars - symbols - sum(text.count(c) for c in "0123456789.,;:!?'\"()-_/=@+~^`{}[]\\")
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(numbers),
        len(lines), letters, len(numbering), sum(text.count(c) for c in ".!?"), len(data) - len(data.translate(None, _CAPITALS)),
        len(_SYMBOL_WORD.findall(text)) if symbols else 0, len(_SYMBOL_END.findall(text)) if symbols else 0,
    )


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [measure(x) for x in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names=["doc_id", *MEASURES])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), step, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


def vote_pattern(rules=tuple(RULES)):
    """A number that holds all votes of a row, a base-3 digit for each rule: 0 abstains, 1 bad, 2 good."""
    return sum(F.when(F.expr(bad), 1).when(F.expr(good), 2).otherwise(0) * F.lit(3**i) for i, (_, bad, good) in enumerate(rules)).cast("long")


def fit(patterns: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 300) -> tuple[np.ndarray, float, np.ndarray]:
    """(rates, share of good, posterior of each pattern) by expectation-maximisation.

    rates[c, j] is the share of class c (0 bad, 1 good) on which rule j votes
    bad where it votes: one minus its accuracy on good documents, its accuracy
    on bad ones. Abstaining says nothing. It starts from documents without any
    bad vote being good; the priors weigh as much as a hundred documents. A rule
    votes bad on no fewer of bad documents than of good ones, which keeps the
    classes from changing places; a rule that errs alike on both counts for nothing.
    """
    votes = np.stack([patterns // 3**i % 3 for i in range(n_rules)], axis=1) if n_rules else np.zeros((len(patterns), 0), int)
    bad, good = (votes == 1).astype(float), (votes == 2).astype(float)
    posterior = np.where((votes == 1).any(axis=1), 0.05, 0.95)
    rates, share = np.full((2, n_rules), 0.5), 0.8
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        rates = (weight @ bad + PRIOR[:, :1]) / (weight @ (bad + good) + PRIOR.sum(axis=1, keepdims=True))
        rates[0] = np.maximum(rates[0], rates[1])
        share = float((weight[1].sum() + 8) / (counts.sum() + 10))
        score = np.log(share / (1 - share)) + bad @ np.log(rates[1] / rates[0]) + good @ np.log((1 - rates[1]) / (1 - rates[0]))
        new = 1 / (1 + np.exp(-np.clip(score, -500, 500)))
        settled = len(new) == 0 or np.abs(new - posterior).max() < 1e-9
        posterior = new
        if settled:
            break
    return rates, share, posterior


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=tuple(RULES), least: float = 0.5) -> DataFrame:
    """(doc_id, measures, votes, posterior, good), a row for each row of docs.

    Null and empty texts, and such without a word, have zero measures and are
    voted on like others. A very long text takes one row's work, in proportion
    to its length. Repeated rows count each. A posterior of exactly ``least`` is
    good. A table without rows gives none. Other columns are not read.
    """
    measured = stored(measures(docs, doc_id, text).withColumn("votes", vote_pattern(rules)), "quality-measures")
    seen = measured.groupBy("votes").count().toArrow()
    patterns, counts = seen.column("votes").to_numpy(), seen.column("count").to_numpy().astype(float)
    _, _, posterior = fit(patterns, counts, len(rules))
    order = np.argsort(patterns)
    known = [(int(patterns[i]), float(round(posterior[i], 9))) for i in order]
    # at most 3^rules rows
    table = docs.sparkSession.createDataFrame(known, "votes long, posterior double")
    return measured.join(F.broadcast(table), "votes").withColumn("good", F.col("posterior") >= least)
