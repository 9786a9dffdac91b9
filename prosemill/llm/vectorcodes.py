"""Codes for vectors of integers: each of 16 equal parts is replaced by the index of its codebook's nearest entry.

Distances are exact. With |x - c|^2 = |x|^2 - 2 x.c + |c|^2, the dot products of
many parts with all entries are products of matrices. Integers are split into
limbs, so narrow that a product of two limb matrices stays below 2^53, where
float64 arithmetic of BLAS makes no error in whatever order it adds; the
products of limbs are shifted and added up as 64-bit integers. The first least
distance decides.

A round of training is a pass over the vectors: tasks assign parts and send the
sums of each entry, and the driver gets one row a component of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored

#: Codebook entries are named by two hex digits.
MOST_ENTRIES = 256
#: Components that a numpy step takes at once; bounds the memory of a task.
STEP = 1 << 20
#: Bits that float64 holds exactly, and that distances may have.
EXACT_BITS, LONG_BITS = 53, 62
#: A label is common that holds one row in so many.
COMMON = 1000


def limb_bits(width: int) -> int:
    """Bits of a limb, so that sums of ``width`` products of two limbs stay below 2^53."""
    bits = (EXACT_BITS - max(1, width).bit_length()) // 2
    if bits < 1:
        raise ValueError("parts are too wide")
    return bits


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """``values`` as float64 limbs of ``bits`` bits, the lowest first; only the last is signed."""
    out = []
    while True:
        if not len(values) or -(1 << bits) < values.min() and values.max() < 1 << bits:
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def exact_products(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The dot products of the rows of two int64 matrices, exact as long as they fit 63 bits."""
    bits = limb_bits(x.shape[1])
    out = np.zeros((len(x), len(entries)), dtype=np.int64)
    others = limbs(entries.ravel(), bits)
    for i, own in enumerate(limbs(x.ravel(), bits)):
        for j, other in enumerate(others):
            out += (own.reshape(x.shape) @ other.reshape(entries.shape).T).astype(np.int64) << (bits * (i + j))
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, the lower of several; squared distance) of each row of ``x``."""
    reach = int(np.abs(x).max(initial=0)) + int(np.abs(entries).max(initial=0))
    if (reach * reach * max(1, x.shape[1])).bit_length() > LONG_BITS:
        raise ValueError("components are too large for distances of 63 bits")
    far = np.einsum("ij,ij->i", entries, entries) - 2 * exact_products(x, entries)
    at = far.argmin(axis=1)
    return at, np.einsum("ij,ij->i", x, x) + far[np.arange(len(x)), at]


def _is_whole(vector: str) -> Column:
    """A vector that holds neither nulls nor what is not a finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.col(vector).isNotNull() & ~bad


def _integers(batch: pa.RecordBatch, column: int, length: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as rows of integers."""
    step = max(1, STEP // max(1, length))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        flat = part.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        scaled = np.floor(flat * scale)
        if len(scaled) and np.abs(scaled).max() >= 2.0**LONG_BITS:
            raise ValueError("components are too large for distances of 63 bits")
        yield part, scaled.astype(np.int64).reshape(part.num_rows, length)


class Codebooks:
    """Entries by part, entry and place within the part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def parts(self) -> int:
        return self.entries.shape[0]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assigned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(indices, squared distances), each with a row a vector and a column a part."""
        width = self.entries.shape[2]
        each = [nearest(x[:, p * width : (p + 1) * width], self.entries[p]) for p in range(self.parts)]
        return np.stack([e[0] for e in each], axis=1), np.stack([e[1] for e in each], axis=1)


def first_codebooks(kept: DataFrame, vec_id: str, vector: str, parts: int, entries: int, scale: float) -> Codebooks | None:
    """The parts of the vectors of the least ids; of equal ids the least vectors come first. None without vectors."""
    rows = kept.where(F.col(vec_id).isNotNull()).orderBy(vec_id, vector).limit(entries).select(vector).toArrow().combine_chunks()
    if not rows.num_rows:
        return None
    length = len(rows.column(0)[0])
    x = np.concatenate([x for b in rows.to_batches() for _, x in _integers(b, 0, length, scale)])
    return Codebooks(x.reshape(len(x), parts, length // parts).transpose(1, 0, 2).copy())


def retrained(kept: DataFrame, vector: str, books: Codebooks, scale: float) -> Codebooks:
    """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.entries.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        bound = 0

        def told() -> pa.RecordBatch:
            used = np.argwhere(counts > 0)
            flat = sums[used[:, 0], used[:, 1]]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat(used[:, 0] * entries + used[:, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width), len(used)).astype(np.int32)),
                pa.array(flat.ravel()), pa.array(np.repeat(counts[used[:, 0], used[:, 1]], width)),
            ], names=["entry", "place", "total", "members"])

        for batch in batches:
            for _, x in _integers(batch, 0, parts * width, scale):
                most = int(np.abs(x).max(initial=0)) * len(x)
                if bound + most >> LONG_BITS:
                    yield told()
                    sums[:], counts[:], bound = 0, 0, 0
                bound += most
                at = books.assigned(x)[0]
                for p in range(parts):
                    np.add.at(sums[p], at[:, p], x[:, p * width : (p + 1) * width])
                    counts[p] += np.bincount(at[:, p], minlength=entries)
        yield told()

    partial = kept.select(vector).mapInArrow(run, "entry int, place int, total long, members long")
    wide = F.sum(F.col("total").cast("decimal(38,0)"))
    found = partial.groupBy("entry", "place").agg(wide.alias("total"), F.sum("members").alias("members"))
    new = books.entries.copy()
    for r in found.collect():  # parts x entries x width rows at most
        new[r.entry // entries, r.entry % entries, r.place] = int(r.total) // r.members
    return Codebooks(new)


def fit(kept: DataFrame, vec_id: str, vector: str, parts: int, entries: int, rounds: int, scale: float) -> Codebooks | None:
    books = first_codebooks(kept, vec_id, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = retrained(kept, vector, books, scale)
    return books


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, parts: int) -> DataFrame:
    """Rows whose vector can be cut into ``parts`` and holds finite numbers only, all of the length that the least vec_id has."""
    kept = vectors.where(_is_whole(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0))
    first = kept.where(F.col(vec_id).isNotNull()).orderBy(vec_id, vector).select(F.size(vector)).first()
    return kept.where(F.size(vector) == (first[0] if first else -1))


def encode(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of each vector, and the codebooks.

    A component x counts as floor(``scale`` * x). ``code`` is a string of two hex
    digits a part, ``error`` the sum of the parts' squared distances. Left out
    are rows whose vector is null or empty, holds nulls or what is not finite,
    can't be cut into ``parts``, or differs in length from that of the least
    vec_id; a table without others gives no rows and no codebooks. Rows without
    vec_id are coded but do not start entries; repeated rows are coded each, and
    take several entries where their ids are among the least. With fewer vectors
    than ``entries`` the codebooks are as much smaller. Equal distances go to the
    lower index. Components so large that a distance passes 63 bits raise. Other
    columns are not read.
    """
    if not 1 <= entries <= MOST_ENTRIES:
        raise ValueError("codebooks have 1 to 256 entries")
    kept = whole_vectors(vectors.select(vec_id, label, vector), vec_id, vector, parts)
    fields = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"`{vec_id}` {fields[vec_id]}, `{label}` {fields[label]}, code string, error long"
    books = fit(kept, vec_id, vector, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema), None
    hexes = np.array([f"{i:02x}" for i in range(MOST_ENTRIES)])
    names = [vec_id, label, "code", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _integers(batch, 2, parts * books.entries.shape[2], scale):
                at, far = books.assigned(x)
                code = ["".join(row) for row in hexes[at].tolist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=names)

    return kept.select(vec_id, label, vector).mapInArrow(run, schema), books


def decode(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``codes`` with the integers that each code stands for; a null code gives null. A clashing name raises."""
    if vector.lower() in {c.lower() for c in codes.columns}:
        raise ValueError(f"codes already has a column {vector}")
    chosen = []
    for p in range(books.parts):
        entries = F.array(*(F.array(*(F.lit(v).cast("long") for v in e)) for e in books.entries[p].tolist()))
        chosen.append(F.get(entries, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")))
    return codes.withColumn(vector, F.when(F.col(code).isNotNull(), F.concat(*chosen)))


def with_label_sums(coded: DataFrame, label: str = "label", error: str = "error", name: str = "label_error") -> DataFrame:
    """``coded``, a written table, with the sum of ``error`` over the rows of an equal label; nulls are one label.

    Sums are made before rows move. Labels that hold one row in ``COMMON`` or
    more, ``COMMON`` at most, are sent to the rows; rows of others meet theirs
    by a shuffle in which no label has a large share.
    """
    key, members = free_name(coded, "label_key"), free_name(coded, "label_rows")
    sums = stored(coded.groupBy(F.col(label).alias(key)).agg(F.sum(error).alias(name), F.count("*").alias(members)), "vector-labels")
    total = sums.agg(F.sum(members)).first()[0] or 0
    common = F.broadcast(sums.where(F.col(members) * COMMON >= total))
    rare = sums.where(F.col(members) * COMMON < total)
    same = coded[label].eqNullSafe(F.col(key))
    sent, met = coded.join(common, same), coded.join(common, same, "left_anti").join(rare, same)
    return sent.select(*coded.columns, name).union(met.select(*coded.columns, name))
