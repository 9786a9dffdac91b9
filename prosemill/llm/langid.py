"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn by a hash of its code point
in lower case, so letters of every script have their own; what is no letter is
a gap between words. A trigram's vector binds (multiplies) the vectors of its
letters, permuted (rotated) by place: two places for the first letter, one for
the second, none for the third. A text bundles (adds) its trigrams' vectors, a
language bundles those of its training texts, each text with weight one, and a
text goes to the language whose vector has the largest cosine with its own.

Bundles of training texts are sums of whole numbers, so they don't depend on
the order of tasks; a task holds one vector for each language and the vectors
of the letters it met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, mix64, sliced

#: A multiple of 64.
DIMENSIONS = 384
UNDETERMINED = "und"
#: Standard deviations of a random text's cosine, 1 / sqrt(DIMENSIONS), under which a text is like noise.
DEVIATIONS = 4.0
#: Parts of one in which sums of training texts are counted.
PARTS = 1e6
#: Texts that are bundled together, trigrams that are bound at once, and how many cells of their table one trigram is worth.
TOGETHER, BOUND, APART = 256, 1 << 13, 40


@lru_cache(1)
def letters() -> np.ndarray:
    """The lower-case code point of each letter below 0x110000, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[:1])
    return table


class LetterVectors:
    """The vectors of code points, made when they are first met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.row = np.full(0x110000, -1, dtype=np.int32)
        self.rotated = [np.zeros((0, dimensions), dtype=np.int8) for _ in range(3)]

    def rows(self, codes: np.ndarray) -> np.ndarray:
        new = np.unique(codes[self.row[codes] < 0])
        if len(new):
            words = mix64((new.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(1, self.dimensions // 64 + 1, dtype=np.uint64)[None, :])
            bits = np.unpackbits(np.ascontiguousarray(words.astype("<u8")).view(np.uint8), axis=1).astype(np.int8) * 2 - 1
            self.row[new] = np.arange(len(new)) + len(self.rotated[0])
            self.rotated = [np.concatenate((have, np.roll(bits, turn, axis=1))) for have, turn in zip(self.rotated, (2, 1, 0), strict=True)]
        return self.row[codes]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of trigrams, +1 and -1."""
        rows = [self.rows(grams >> shift & 0x1FFFFF) for shift in (42, 21, 0)]
        first, second, third = (table[r] for table, r in zip(self.rotated, rows, strict=True))
        first *= second
        first *= third
        return first

    def bundles(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """For each text's trigrams and counts, the sum of their vectors. A trigram that many texts have is bound once for all of them."""
        out = np.zeros((len(found), self.dimensions), dtype=np.float32)
        sizes = np.array([len(g) for g, _ in found], dtype=np.int64)
        if not sizes.sum():
            return out
        every, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        if len(every) * len(found) > APART * len(place):  # texts with few trigrams in common
            for i, (grams, counts) in enumerate(found):
                for at in range(0, len(grams), BOUND):
                    out[i] += counts[at : at + BOUND].astype(np.float32) @ self.bound(grams[at : at + BOUND]).astype(np.float32)
            return out
        text = np.repeat(np.arange(len(found)), sizes)
        counts = np.concatenate([c for _, c in found]).astype(np.float32)
        for at in range(0, len(every), BOUND):
            mine = (place >= at) & (place < at + BOUND)
            table = np.zeros((len(found), min(BOUND, len(every) - at)), dtype=np.float32)
            table[text[mine], place[mine] - at] = counts[mine]
            out += table @ self.bound(every[at : at + BOUND]).astype(np.float32)
        return out


@lru_cache(1)
def letter_vectors() -> LetterVectors:
    """One table for each Python worker."""
    return LetterVectors()


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of letters and word gaps of a text, 21 bits for each place, with their counts; none without letters."""
    codes = letters()[np.frombuffer(f" {text or ''} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def language_profiles(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """A unit vector for each language of ``docs``."""
    return {name: vector for name, (vector, _) in learned(docs, lang, text).items()}


def learned(docs: DataFrame, lang: str = "lang", text: str = "text") -> dict[str, tuple[np.ndarray, float]]:
    """For each language of ``docs`` a unit vector and the mean cosine of one of its trigrams with that. All rows are bundled; what reaches the driver is one vector a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        table = letter_vectors()
        for batch in batches:
            for part in sliced(batch, 1):
                by_name: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    grams, counts = trigrams(text)
                    if len(grams):
                        by_name.setdefault(name, []).append((grams, np.rint(counts * (PARTS / np.sqrt(np.dot(counts, counts))))))
                for name, found in by_name.items():
                    mine = sums.setdefault(name, np.zeros(DIMENSIONS + 1))
                    grams, place = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                    weights = np.bincount(place, np.concatenate([w for _, w in found]))
                    for at in range(0, len(grams), BOUND):
                        mine[:-1] += weights[at : at + BOUND] @ table.bound(grams[at : at + BOUND]).astype(np.float64)
                    mine[-1] += weights.sum()
        for name, mine in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(mine), pa.string()), pa.array(np.arange(len(mine), dtype=np.int32)), pa.array(mine.astype(np.int64))], names=["lang", "place", "weight"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sums = rows.mapInArrow(run, "lang string, place int, weight long").groupBy("lang", "place").agg(F.sum("weight").alias("weight")).toPandas()
    out = {}
    for name, mine in sorted(sums.groupby("lang"), key=lambda x: x[0]):
        weights = mine.sort_values("place").weight.to_numpy().astype(np.float64)
        size = float(np.linalg.norm(weights[:-1]))
        if size:
            out[name] = weights[:-1] / size, size / (weights[-1] * np.sqrt(DIMENSIONS))
    return out


def classified(texts: list[str | None], names: list[str], matrix: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, cosine and effective number of trigrams (that of equally frequent ones) of each text. A row of ``matrix`` is a language's unit vector."""
    best, score, grams = [], [], []
    for at in range(0, len(texts), TOGETHER):
        found = [trigrams(x) if names else trigrams(None) for x in texts[at : at + TOGETHER]]
        own = letter_vectors().bundles(found)
        sizes = np.linalg.norm(own, axis=1)
        cosines = own @ matrix.T / np.maximum(sizes, 1e-12)[:, None] if names else np.zeros((len(found), 1))
        for (_, counts), size, row in zip(found, sizes, cosines, strict=True):
            if not len(counts):
                best.append(UNDETERMINED), score.append(0.0), grams.append(0.0)
                continue
            k = int(np.argmax(row)) if size else 0
            best.append(names[k]), score.append(min(1.0, max(0.0, float(row[k])))), grams.append(float(counts.sum()) ** 2 / float(np.dot(counts, counts)))
    return best, score, grams


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): score is the cosine, 0 at least; ``und`` and 0 for a null text or one without letters. Ties go to the first language by name."""
    names = sorted(profiles)
    matrix = np.stack([profiles[n] for n in names]) if names else np.zeros((0, DIMENSIONS))

    def step(part: pa.RecordBatch) -> pa.RecordBatch:
        best, score, _ = classified(part.column(1).to_pylist(), names, matrix)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_texts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), step, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 2 by 4. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs; learned from the labelled rows that aren't held out.

    Only text and lang are learned from, and only text is an input of a
    prediction. Without labelled rows every prediction is ``und``. Repeated
    rows get the same prediction, null and empty texts and such without letters
    ``und``; very long texts are read whole. Other columns are not read.
    """
    profiles = language_profiles(docs.where(~held_out(doc_id)), lang, text)
    return predict(docs, profiles, doc_id, text).withColumn("held_out", held_out("doc_id")).select("doc_id", "held_out", "lang_pred", "score")


def like_noise(name: str, score: float, grams: float, typical: float, deviations: float = DEVIATIONS) -> bool:
    """Whether a text has no language, or a cosine as random text has although text of its length would stand clear of that.

    n trigrams of a language whose single trigrams have the mean cosine c come
    to sqrt(n) c / sqrt(1 + n c^2). Shorter texts cannot be told from noise and pass.
    """
    bound = deviations / np.sqrt(DIMENSIONS)
    return name == UNDETERMINED or score < bound and np.sqrt(grams) * typical / np.sqrt(1 + grams * typical**2) >= 2 * bound


def keep_identified(docs: DataFrame, deviations: float = DEVIATIONS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` without rows whose language is undetermined or that are like noise: junk that is like no language.

    Null and empty texts, and those without a letter, are undetermined and go;
    null ids count as training rows. Equal rows are judged alike. A very long
    text is bundled in slices, and its whole counts. Without training rows
    nothing is determined, and empty tables give none. Other columns pass
    through, whatever their names.
    """
    profiles = learned(docs.where(~held_out(doc_id)), lang, text)
    names = sorted(profiles)
    matrix = np.stack([profiles[n][0] for n in names]) if names else np.zeros((0, DIMENSIONS))
    typical = min((c for _, c in profiles.values()), default=0.0)
    columns, at = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, at):
                found = zip(*classified(part.column(at).to_pylist(), names, matrix), strict=True)
                yield part.filter(pa.array([not like_noise(*x, typical, deviations) for x in found], pa.bool_()))

    return docs.select(*columns).mapInArrow(run, docs.schema)
