"""Which words are misspellings of which: neighbourhoods over a reduced alphabet.

Letters are hashed to a few symbols. If two words differ by one inserted,
deleted or replaced letter, so do their reduced words, or these are equal. So
the full neighbourhood of a reduced word, all strings at one edit and itself,
holds the reduced words of all near words; with few symbols it is small. Of
each two neighbours one generates the other, so that a pair meets once: an
insertion is a deletion seen from the other word, and of two replacements one
goes to the lower symbol. A join of these with the reduced vocabulary gives
candidates, which are then compared as they are written.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, stored

#: Maximal runs of letters, a fixed pattern.
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Symbols of the reduced alphabet.
SYMBOLS = "012345"
#: Words that a task counts at once before it sends its counts.
COUNTED = 500_000
#: Words of one reduced word that meet in one group; more are dealt over several.
CROWD = 2_000


def lowered(word: str) -> str:
    """``word`` with A-Z in lower case and other letters as they are."""
    return word.lower() if word.isascii() else word.translate(_LOWER)


def dropped(doc: str, word: str, every: int) -> str:
    """``word`` less one letter, if the hash of document and word says so."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 7, least_count: int = 2, drop_every: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all whole texts, with A-Z in lower case, and their numbers.

    Kept are words of ``least_length`` code points and ``least_count``
    occurrences. With ``drop_every`` = k, a word of a document loses one letter
    wherever k divides the crc32 of ``doc_id:word``; a null doc_id counts as the
    empty string. Null and empty texts have no words, and empty tables give
    none. Repeated rows count each. A text is cut at once, so a very long one
    needs some times its size. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in sliced(batch, 1):
                for doc, body in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if not body:
                        continue
                    # runs that differ by case alone are one word
                    own: Counter[str] = Counter()
                    for run_, n in Counter(LETTERS.findall(body)).items():
                        if len(run_) >= least_length:
                            own[lowered(run_)] += n
                    for word, n in own.items():
                        kept = dropped(doc, word, drop_every) if drop_every else word
                        if len(kept) >= least_length:
                            seen[kept] += n
                if len(seen) > COUNTED:
                    yield told()
                    seen.clear()
        yield told()

    told = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("body")).mapInArrow(run, "word string, n long")
    return told.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letter_symbols(words: DataFrame) -> dict[str, str]:
    """A symbol for each letter of the words: the symbols get about equal shares of all letters, so that reduced words spread."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    load, symbols = [0] * len(SYMBOLS), {}
    for r in sorted(letters.collect(), key=lambda r: (-r["count"], r.letter)):
        least = load.index(min(load))
        load[least] += r["count"]
        symbols[r.letter] = SYMBOLS[least]
    return symbols


def reduced(word: Column, symbols: dict[str, str]) -> Column:
    """``word`` with each letter replaced by its symbol."""
    return F.translate(word, "".join(symbols), "".join(symbols.values()))


def lower_half(word: Column) -> Column:
    """``word`` and its neighbours that come before it: one symbol deleted, or replaced by a lower one. Each once.

    Of two reduced words at one edit just one is in the lower half of the
    other's neighbourhood, so the halves together hold every pair.
    """

    def at(i: Column) -> Column:
        head, tail = F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)
        own = F.substr(word, i, F.lit(1))
        return F.concat(F.array(F.concat(head, tail)), F.transform(F.filter(F.array(*map(F.lit, SYMBOLS)), lambda s: s < own), lambda s: F.concat(head, s, tail)))

    return F.array_distinct(F.concat(F.array(word), F.flatten(F.transform(F.sequence(F.lit(1), F.length(word)), at))))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): each pair of words at one edit, in both orders, from a written table (word, n).

    A reduced word that more than ``CROWD`` words share is dealt over several
    parts, to which its neighbours are sent each; no pair is lost or repeated.
    """
    symbols = letter_symbols(words)
    known = words.where("word <> ''").select("word", "n", reduced(F.col("word"), symbols).alias("key"))
    crowds = known.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("key", F.ceil(F.col("m") / CROWD).cast("int").alias("dealt"))
    keys = known.select("word", "n", F.explode(lower_half(F.col("key"))).alias("key"))
    if crowds.limit(1).count() == 0:
        met = keys.join(known.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    else:
        crowds = stored(crowds, "spelling-crowds")
        part = F.coalesce("dealt", F.lit(1))
        there = known.join(crowds, "key", "left").select("key", F.pmod(F.xxhash64("word"), part).cast("int").alias("part"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        here = keys.join(crowds, "key", "left").select("word", "n", "key", F.explode(F.sequence(F.lit(0), part - 1)).alias("part"))
        met = here.join(there, ["key", "part"])
    # words of one reduced word meet in both orders, others in one
    once = (F.col("word") < F.col("near")) | (reduced(F.col("word"), symbols) != reduced(F.col("near"), symbols))
    pairs = met.where(F.levenshtein("word", "near", 1) == 1).where(once)
    both = F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form): the last word on the way along forms.

    Ways double each round: after k rounds all of 2^k steps are done. Forms lead
    to ever more frequent words, so there are no cycles.
    """
    at = stored(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = stored(at.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").limit(1).count() == 0:
            return at


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of each row of (word, n).

    Near words differ by exactly one inserted, deleted or replaced code point.
    ``form`` is the most frequent near word, the least in code-point order of
    several, if it is ``ratio`` times as frequent as the word (null else);
    ``root`` the end of the way along forms. Words are distinct and not null, of
    any letters and lengths; the empty word is near to none. A word without near
    words has ``n_near`` 0 and is its own root; empty tables give none. ``ratio``
    is above 1, so forms never lead back.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = stored(words, "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near_n = -F.col("best.less")
    fits = near_n >= ratio * F.col("n")
    forms = stored(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, near_n).alias("form_n")), "spelling-forms")
    return forms.join(roots(forms), "word", "left").select("word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
