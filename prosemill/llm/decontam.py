"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the texts notes where words of the benchmark stand, and counts
   in how many documents each does. Other words are in no common subsequence
   with an item. Items are taken ``ITEMS_AT_ONCE`` at a time, so what is sent to
   tasks has a fixed bound.
2. Document frequencies of those words over all documents give weights.
3. Passages, the weighted words of 32-word pieces of all documents and the
   items themselves, form a TF-IDF matrix A of which a distributed randomised
   SVD takes the leading right singular vectors in one pass: tasks sum A'A
   times an orthonormal random block, and the driver takes the vectors of the
   matrix of the block's rank that gives the same product (Nystroem).
4. Overlapping windows of each document and the items are compared by cosine
   in that space.
   Before that, pairs go that cannot pass the check: the words that a window
   and an item share bound their common subsequence.
5. Candidates are checked: the longest common subsequence of words has to cover
   ``least_cover`` of the item, or ``answer_cover`` with the item's answer
   standing in the window word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, sliced, stored

ITEMS_AT_ONCE = 8_192
WORDS_AT_ONCE = 160_000
RANK, OVERSAMPLE = 96, 16
PIECE = 32
#: A word in more than this share of documents has weight only for items with few rarer words.
COMMON, ENOUGH = 0.1, 4
#: Items that windows are compared with at once; bounds the tables of a task.
GROUP = 256
#: Terms whose sums one group adds up.
SUMMED = 16

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


@dataclass
class Items:
    """A batch of benchmark items: their word numbers, answers and the vocabulary."""

    ids: list[int]
    terms: list[np.ndarray]
    answers: list[np.ndarray]
    vocabulary: dict[bytes, int]


def read_items(rows: list[tuple[int, str | None, str | None]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    ids, terms, answers = [], [], []
    for item, text, answer in rows:
        words = words_of(text)
        if not words:
            continue
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64)
        own = [vocabulary[w] for w in words_of(answer) if w in vocabulary] if answer else []
        ids.append(item), terms.append(numbers)
        answers.append(np.array(own, dtype=np.int64) if own else numbers[-max(3, len(numbers) // 4) :])
    return Items(ids, terms, answers, vocabulary)


def item_batches(benchmark: DataFrame, item_id: str, text: str, answer: str | None) -> Iterator[Items]:
    rows, words = [], 0
    chosen = benchmark.select(F.col(item_id), F.col(text), F.col(answer) if answer else F.lit(None).cast("string")).where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).distinct()
    for row in chosen.toLocalIterator():
        rows.append(tuple(row))
        words += len(row[1].split())
        if len(rows) >= ITEMS_AT_ONCE or words >= WORDS_AT_ONCE:
            yield read_items(rows)
            rows, words = [], 0
    if rows:
        yield read_items(rows)


def word_hits(docs: DataFrame, doc_id: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, places, terms): where the vocabulary's words stand, packed; texts without any give no row.

    A row without doc_id stands at the end of each task: terms, and in how many of its documents they are.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    n = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, sums = held.value.get, np.zeros(n, dtype=np.int64)
        packed = lambda x: x.astype("<i4").tobytes()
        for batch in batches:
            for part in sliced(batch, 1):
                rows, places, terms, distinct = [], [], [], []
                for i, x in enumerate(part.column(1).to_pylist()):
                    words = words_of(x)
                    found = np.fromiter(map(get, words, repeat(-1)), np.int32, len(words))
                    at = np.flatnonzero(found >= 0)
                    if len(at):
                        own = found[at]
                        rows.append(i), places.append(packed(at)), terms.append(packed(own)), distinct.append(np.unique(own))
                if rows:
                    sums += np.bincount(np.concatenate(distinct), minlength=n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(places, pa.binary()), pa.array(terms, pa.binary())], names=["doc_id", "places", "terms"])
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([packed(met)], pa.binary()), pa.array([packed(sums[met])], pa.binary())], names=["doc_id", "places", "terms"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, places binary, terms binary")


def _hits(batch: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, row of each hit, place, term)."""
    ids, places, terms = (batch.column(k).to_pylist() for k in range(3))
    counts = [len(p) // 4 for p in places]
    return ids, np.repeat(np.arange(len(ids)), counts), np.frombuffer(b"".join(places), "<i4").astype(np.int64), np.frombuffer(b"".join(terms), "<i4").astype(np.int64)


def document_frequencies(counts: DataFrame, n: int) -> np.ndarray:
    """In how many documents each of n terms occurs, from the rows of word_hits without doc_id; the driver gets n numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, term, docs = _hits(batch)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(docs)], names=["term", "docs"])

    sums = counts.mapInArrow(run, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    out = np.zeros(n, dtype=np.int64)
    out[sums.column("term").to_numpy()] = sums.column("docs").to_numpy()
    return out


def term_weights(items: Items, docs_with: np.ndarray, total: int) -> np.ndarray:
    """Inverse document frequencies; 0 for common words that no item depends on."""
    weights = np.log((total + 1) / (docs_with + 0.5))
    weights = np.maximum(weights, 1e-3)
    common = docs_with > COMMON * total
    needed = np.zeros(len(weights), dtype=bool)
    for terms in items.terms:
        own = np.unique(terms)
        if np.count_nonzero(~common[own]) < ENOUGH:
            needed[own] = True
    weights[common & ~needed] = 0
    return weights.astype(np.float32)


def gram_times(hits: DataFrame, items: Items, weights: np.ndarray, block: np.ndarray, balance: float) -> np.ndarray:
    """A'A times ``block``, where A has a unit row for each passage, and items' rows count ``balance`` times. Tasks send the rows of terms they met; sums are of the block's size."""
    spark = hits.sparkSession
    held = spark.sparkContext.broadcast((weights, block.astype(np.float32)))
    width, n = block.shape[1], len(weights)

    def add(sums: np.ndarray, met: np.ndarray, cells: np.ndarray, terms: np.ndarray, w: np.ndarray, b: np.ndarray) -> None:
        pairs, counts = np.unique(cells * n + terms, return_counts=True)
        cells, terms = pairs // n, pairs % n
        values = w[terms] * (1 + np.log(counts)).astype(np.float32)
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(cells)])))
        values /= np.repeat(np.sqrt(np.add.reduceat(values * values, starts)), sizes)
        for at in range(0, len(starts), 4096):  # bounds the rows held at once
            lo, hi = starts[at], starts[at + 4096] if at + 4096 < len(starts) else len(cells)
            y = np.add.reduceat(b[terms[lo:hi]] * values[lo:hi, None], starts[at : at + 4096] - lo, axis=0)
            back = np.repeat(y, sizes[at : at + 4096], axis=0) * values[lo:hi, None]
            order = np.argsort(terms[lo:hi], kind="stable")
            t = terms[lo:hi][order]
            s = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
            sums[t[s]] += np.add.reduceat(back[order], s, axis=0)
        met[terms] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = held.value
        sums, met = np.zeros((n, width), dtype=np.float32), np.zeros(n, dtype=bool)
        for batch in batches:
            _, row, place, term = _hits(batch)
            kept = w[term] > 0
            cells = (row << 32 | place // PIECE)[kept]
            term = term[kept]
            if len(cells):
                _, inverse, counts = np.unique(cells, return_inverse=True, return_counts=True)
                several = counts[inverse] > 1
                if several.any():
                    add(sums, met, cells[several], term[several], w, b)
        found = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([sums[i].tobytes() for i in found], pa.binary())], names=["term", "row"])

    def total(rows: pa.Table) -> pa.Table:
        term = rows.column("term").to_numpy()
        data = np.frombuffer(b"".join(rows.column("row").to_pylist()), dtype=np.float32).reshape(-1, width)
        order = np.argsort(term, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(term[order]) != 0)))
        summed = np.add.reduceat(data[order].astype(np.float64), starts, axis=0).astype(np.float32)
        return pa.Table.from_arrays([pa.array(term[order][starts]), pa.array([x.tobytes() for x in summed], pa.binary())], names=["term", "row"])

    rows = hits.mapInArrow(run, "term long, row binary")
    summed = rows.groupBy(F.floor(F.col("term") / SUMMED)).applyInArrow(total, "term long, row binary").toArrow()
    out, met = np.zeros((n, width), dtype=np.float32), np.zeros(n, dtype=bool)
    if summed.num_rows:
        out[summed.column("term").to_numpy()] = np.frombuffer(b"".join(summed.column("row").to_pylist()), dtype=np.float32).reshape(-1, width)
    terms = np.concatenate(items.terms)
    owner = np.repeat(np.arange(len(items.terms)), [len(t) for t in items.terms])
    kept = weights[terms] > 0
    own = np.zeros((n, width), dtype=np.float32)
    if kept.any():
        add(own, met, owner[kept], terms[kept], weights, block.astype(np.float32))
    held.unpersist()
    return out + own * np.float32(balance)


def latent_basis(hits: DataFrame, items: Items, weights: np.ndarray, rank: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms by rank, singular values): leading right singular vectors of the passages.

    Items weigh as much as the passages of ``total`` documents, three each, so
    that the space holds what tells items apart, not only what fills documents.
    """
    balance = max(1.0, 3 * total / len(items.ids))
    width = min(rank + OVERSAMPLE, len(weights))
    block, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((len(weights), width)))
    product = gram_times(hits, items, weights, block, balance).astype(np.float64)
    inner = block.T @ product
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    kept = values > 1e-7 * max(1e-12, values.max())
    root = product @ (turn[:, kept] / np.sqrt(values[kept]))  # root times its transpose gives the product
    values, turn = np.linalg.eigh(root.T @ root)
    lead = np.argsort(values)[::-1][:rank]
    lead = lead[values[lead] > 0]
    return (root @ (turn[:, lead] / np.sqrt(values[lead]))).astype(np.float32), np.sqrt(values[lead])


def common_subsequence(masks: dict[int, int], length: int, sequence: list[int]) -> int:
    """Length of the longest common subsequence; bit i of masks[t] says that item word i is t."""
    full = (1 << length) - 1
    v = full
    for t in sequence:
        if m := masks.get(t):
            u = v & m
            v = (v + u) | (v - u)
    return length - (v & full).bit_count()


def contains_run(places: np.ndarray, terms: np.ndarray, run: np.ndarray) -> bool:
    """Whether the terms of ``run`` stand at consecutive places."""
    at = np.flatnonzero(terms[: len(terms) - len(run) + 1] == run[0]) if len(terms) >= len(run) else []
    return any(places[i + len(run) - 1] - places[i] == len(run) - 1 and np.array_equal(terms[i : i + len(run)], run) for i in at)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", answer: str | None = None,
    rank: int = RANK, least_cosine: float = 0.25, least_cover: float = 0.7, answer_cover: float = 0.5,
) -> DataFrame:
    """(doc_id, item_id, cosine, cover, answer_found), a row for each document and the item found in it.

    Null ids, and null or empty texts on either side, match nothing. Repeated
    rows of one doc_id give one row an item, the best. Without an ``answer``
    column an item's answer is its last quarter, 3 words at least. Ties need
    no rule: every pair that passes is listed. A very long text is a
    sequence of words to slide windows over, all of it. Other columns are not read.
    """
    out = None
    total = docs.count()
    for items in item_batches(benchmark, item_id, item_text, answer):
        noted = stored(word_hits(docs, doc_id, text, items.vocabulary), "leaks-hits")
        hits = noted.where("doc_id is not null")
        weights = term_weights(items, document_frequencies(noted.where("doc_id is null"), len(items.vocabulary)), total)
        basis, _ = latent_basis(hits, items, weights, rank, total)
        found = matches(hits, items, weights, basis, least_cosine, least_cover, answer_cover)
        out = found if out is None else out.unionByName(found)
    schema = "doc_id long, item_id long, cosine double, cover double, answer_found boolean"
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("cover").alias("cover"), F.max("answer_found").alias("answer_found"))
    return best.select("doc_id", "item_id", "cosine", "cover", "answer_found")


class Matcher:
    """Compares windows of documents with items, by cosine and then by words."""

    def __init__(self, ids: list[int], terms: list[np.ndarray], answers: list[np.ndarray], weights: np.ndarray, basis: np.ndarray, least_cosine: float, least_cover: float, answer_cover: float):
        self.ids, self.terms, self.answers, self.weights = ids, terms, answers, weights
        self.least_cosine, self.least_cover, self.answer_cover = least_cosine, least_cover, answer_cover
        self.rows = basis * weights[:, None]
        self.lengths = np.array([len(t) for t in terms])
        # words that a text must share with an item to pass, and how many of the item's have no weight
        self.need = np.maximum(1, np.ceil(min(answer_cover, least_cover) * self.lengths - 1e-9)).astype(np.int64)
        self.light = np.array([np.count_nonzero(weights[t] == 0) for t in terms])
        vectors = np.stack([self.rows[t].sum(axis=0) for t in terms])
        self.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]).astype(np.float32)
        self.steps = np.maximum(4, 2 ** np.ceil(np.log2(self.lengths)).astype(np.int64)) // 4
        # (step, items, row of each term, what a hit of the term adds for each item: 65536 with weight, 1 without)
        self.groups = []
        for step in np.unique(self.steps).tolist():
            of_step = np.flatnonzero(self.steps == step)
            for at in range(0, len(of_step), GROUP):
                mine = of_step[at : at + GROUP]
                own = np.unique(np.concatenate([terms[i] for i in mine]))
                local = np.full(len(weights), -1, dtype=np.int32)
                local[own] = np.arange(len(own))
                adds = np.zeros((len(own), len(mine)), dtype=np.uint32)
                for k, i in enumerate(mine):
                    adds[local[terms[i]], k] = np.where(weights[terms[i]] > 0, 1 << 16, 1)
                self.groups.append((step, mine, local, adds))
        self.masks: dict[int, dict[int, int]] = {}

    def candidates(self, group: tuple, row: np.ndarray, place: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, first place, item, cosine) of windows and items of a group that are alike and share as many words as passing needs.

        A window has five steps, an item four at most: some window holds all of
        it. Shared words are counted in the text that is checked, which reaches
        one step farther on either side. Each word of a common subsequence is
        a hit of the item's words, and no more than ``light`` of them have no weight.
        """
        step, mine, local, adds = group
        need, light = self.need[mine], self.light[mine].astype(np.uint32)
        held = np.flatnonzero(local[term] >= 0)
        if not len(held):
            return
        row, place, term = row[held], place[held], term[held]
        cells = row << 32 | place // step + 5
        starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
        names, sizes = cells[starts], np.diff(np.concatenate((starts, [len(cells)])))
        heavy = np.add.reduceat((self.weights[term] > 0).astype(np.int64), starts)
        windows = np.unique(np.concatenate([names[heavy > 0] - k for k in range(5)]))
        found = np.searchsorted(names, windows[:, None] + np.arange(-1, 6))
        there = names[np.minimum(found, len(names) - 1)] == windows[:, None] + np.arange(-1, 6)
        found = np.where(there, found, len(names))
        least = max(1, int((need - light).min()))
        dense = (np.append(sizes, 0)[found].sum(axis=1) >= int(need.min())) & (np.append(heavy, 0)[found].sum(axis=1) >= least)
        windows, found = windows[dense], found[dense]
        if not len(windows):
            return
        shared = np.zeros((len(names) + 1, len(mine)), dtype=np.uint32)
        sums = np.zeros((len(names) + 1, self.rows.shape[1]), dtype=np.float32)
        for j in range(int(sizes.max())):  # a cell has a step's words at most
            longer = np.flatnonzero(sizes > j)
            now = term[starts[longer] + j]
            shared[longer] += adds[local[now]]
            weighted = self.weights[now] > 0
            sums[longer[weighted]] += self.rows[now[weighted]]
        for a in range(0, len(windows), 8192):
            cell = found[a : a + 8192]
            both = shared[cell[:, 0]]
            for k in range(1, 7):
                both += shared[cell[:, k]]
            enough = np.minimum(both & 0xFFFF, light) + (both >> 16) >= need
            some = np.flatnonzero(enough.any(axis=1))
            if not len(some):
                continue
            window = sums[cell[some, 1]]
            for k in range(2, 6):
                window += sums[cell[some, k]]
            cosines = window @ self.vectors[mine].T
            norms = np.maximum(np.linalg.norm(window, axis=1), 1e-12)
            i, k = np.nonzero(enough[some] & (cosines >= self.least_cosine * norms[:, None]))
            name = windows[a : a + 8192][some[i]]
            yield name >> 32, ((name & 0xFFFFFFFF) - 5) * step, mine[k], cosines[i, k] / norms[i]

    def item_masks(self, item: int) -> dict[int, int]:
        if item not in self.masks:
            own: dict[int, int] = {}
            for j, t in enumerate(self.terms[item].tolist()):
                own[t] = own.get(t, 0) | 1 << j
            self.masks[item] = own
        return self.masks[item]

    def leaks(self, n_docs: int, row: np.ndarray, place: np.ndarray, term: np.ndarray) -> dict[tuple[int, int], list]:
        """{(row, item): [cosine, cover, answer found]} of a batch of hits."""
        bounds = np.searchsorted(row, np.arange(n_docs + 1))
        best: dict[tuple[int, int], list] = {}
        for group in self.groups:
            step = group[0]
            for rows, firsts, items, cosines in self.candidates(group, row, place, term):
                for r, first, item, cosine in zip(rows.tolist(), firsts.tolist(), items.tolist(), cosines.tolist(), strict=True):
                    now = best.get((r, item))
                    if now and now[1] == 1 and now[2]:
                        now[0] = max(now[0], cosine)
                        continue
                    lo, hi = np.searchsorted(place[bounds[r] : bounds[r + 1]], (first - step, first + 6 * step)) + bounds[r]
                    length = int(self.lengths[item])
                    cover = common_subsequence(self.item_masks(item), length, term[lo:hi].tolist()) / length
                    if cover < self.answer_cover:
                        continue
                    answered = contains_run(place[lo:hi], term[lo:hi], self.answers[item])
                    if cover >= self.least_cover or answered:
                        now = best.setdefault((r, item), [0.0, 0.0, False])
                        now[:] = max(now[0], cosine), max(now[1], cover), now[2] or answered
        return best


def matches(hits: DataFrame, items: Items, weights: np.ndarray, basis: np.ndarray, least_cosine: float, least_cover: float, answer_cover: float) -> DataFrame:
    held = hits.sparkSession.sparkContext.broadcast((items.ids, items.terms, items.answers, weights, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(*held.value, least_cosine, least_cover, answer_cover)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, row, place, term = _hits(batch.slice(at, 256))
                best = matcher.leaks(len(doc_ids), row, place, term)
                if best:
                    yield pa.RecordBatch.from_arrays([
                        pa.array([doc_ids[r] for r, _ in best], pa.int64()), pa.array([matcher.ids[k] for _, k in best], pa.int64()),
                        *(pa.array([v[j] for v in best.values()]) for j in range(3)),
                    ], names=["doc_id", "item_id", "cosine", "cover", "answer_found"])

    return hits.mapInArrow(run, "doc_id long, item_id long, cosine double, cover double, answer_found boolean")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **parameters) -> DataFrame:
    """``docs`` without the rows in which an item is found. Rows of one doc_id with other texts stay, and so do null ids and texts.

    Equal rows go together. A very long text is looked through as ``find_leaks``
    does, window by window, and goes as a whole. A benchmark without items
    leaves all rows; empty tables give none. Other columns pass through,
    whatever their names.
    """
    row, leaking = free_name(docs, "row_key"), free_name(docs, "leaking_row")
    # rows of one doc_id and one text are alike, so their hash tells which go, whatever order tasks see them in
    keyed = docs.withColumn(row, F.when(F.col(doc_id).isNotNull() & F.col(text).isNotNull(), F.xxhash64(doc_id, text)))
    found = find_leaks(keyed, benchmark, row, text, **parameters).select(F.col("doc_id").alias(leaking)).distinct()
    return keyed.join(found, F.col(row) == F.col(leaking), "left_anti").select(*docs.columns)
