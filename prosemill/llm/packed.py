"""Which members of many sets are in another set too, found without a row for each member.

Tasks pack the hashes of many sets into a few binary rows, dealt by hash into
buckets; buckets count in how many sets a hash is and send the shared ones on
to groups of sets. What moves is eight bytes a member, once.

A hash that very many sets have would make its bucket grow with the input. Such
hashes are found beforehand from partial counts and are known to be shared, so
their members go past the buckets, dealt by set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_lists, sliced

#: Members that a task packs at once, and that a bucket holds about.
PACKED, BUCKET = 800_000, 3_000_000
#: A hash is frequent from this count on, where stored frequencies end, and from one part in ``MOST_FREQUENT`` of all members on, which bounds their number.
FREQUENT, MOST_FREQUENT = 65_535, 100_000
#: Sets of a pack that have a hash before the pack reports it. A hash that no pack reports has one part in 50,000 of all members at most.
REPORTED = 16


def reported(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes that ``REPORTED`` sets of a pack have, and in how many each is."""
    found, counts = np.unique(hashes, return_counts=True)
    return found[counts >= REPORTED], counts[counts >= REPORTED]


def frequent_hashes(counted: DataFrame, total: int) -> np.ndarray:
    """Sorted frequent hashes, ``MOST_FREQUENT`` at most, from (hash long, seen long) of packs with ``total`` members together."""
    sums = counted.groupBy("hash").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(FREQUENT, total / MOST_FREQUENT))
    return np.sort(sums.select("hash").toArrow().column("hash").to_numpy().astype(np.int64).view(np.uint64))


def pack_counts(packed: DataFrame) -> DataFrame:
    """(hash, seen): what the packs of a written table report."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0).to_pylist():
                found, counts = reported(np.frombuffer(row, "<u8"))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], names=["hash", "seen"])

    return packed.select("hashes").mapInArrow(run, "hash long, seen long")


def _group_of(keys: np.ndarray, groups: int, width: int) -> np.ndarray:
    return keys.view("<u4")[:: width // 4].astype(np.int64) % groups


def frequent_apart(batch: pa.RecordBatch, frequent: np.ndarray, groups: int, width: int) -> Iterator[pa.RecordBatch]:
    """``batch`` of packed rows with members of frequent hashes in rows of their own; the bucket of these is -1 less the group of their sets."""
    keys, sizes, lengths, hashes = (_joined(batch, c, d) for c, d in (("keys", f"S{width}"), ("sizes", "<u2"), ("lengths", "<u4"), ("hashes", "<u8")))
    at = np.searchsorted(frequent, hashes)
    often = np.zeros(len(hashes), dtype=bool) if len(frequent) == 0 else frequent[np.minimum(at, len(frequent) - 1)] == hashes
    if not often.any():
        yield batch
        return
    cells = np.array([len(k) // width for k in batch.column("keys").to_pylist()])
    bucket = np.repeat(batch.column("bucket").to_numpy(), cells)
    owner = np.repeat(np.arange(len(keys)), lengths)
    for mine, to in ((~often, bucket), (often, -1 - _group_of(keys, groups, width))):
        mine = np.flatnonzero(mine)
        mine = mine[np.argsort(to[owner[mine]], kind="stable")]
        own = owner[mine]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
        cell = own[first]
        starts = np.flatnonzero(np.concatenate(([True], to[cell][1:] != to[cell][:-1]))) if len(cell) else np.zeros(0, np.int64)
        ends = np.concatenate((starts[1:], [len(cell)])) if len(cell) else starts
        count = np.diff(np.concatenate((first, [len(own)]))).astype("<u4")
        yield pa.RecordBatch.from_arrays([
            pa.array(to[cell][starts], pa.int64()), binary_lists(keys[cell], ends, width), binary_lists(sizes[cell], ends, 2), binary_lists(count, ends, 4), binary_lists(hashes[mine], np.cumsum(count)[ends - 1], 8),
        ], names=batch.schema.names)


def without_frequent(packed: DataFrame, frequent: np.ndarray, groups: int, width: int) -> DataFrame:
    """Rows of a written packed table, those of frequent hashes apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from frequent_apart(batch.slice(k, 1), frequent, groups, width)

    return packed.mapInArrow(run, packed.schema) if len(frequent) else packed


def packed_sets(docs: DataFrame, text: str, hasher: Callable[[], Callable[[list[str | None]], list[tuple[bytes, np.ndarray]]]], buckets: int, width: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(bucket, keys, sizes, lengths, hashes): the sets of many texts, dealt by hash. sizes are of whole sets, lengths of the bucket's parts.

    ``hasher`` makes, in each task, a function from texts to pairs of a 16-byte
    key and a set of distinct 64-bit hashes; sets of one key are the same. The
    first ``width`` bytes of a key go with each part (see key_width). Members
    of ``frequent`` hashes go past the buckets.
    """
    frequent = np.zeros(0, np.uint64) if frequent is None else frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, sets = hasher(), {}
        count = 0

        def pack() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(sets), dtype=f"S{width}")
            sizes = np.array([len(s) for s in sets.values()])
            hashes = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(sets), dtype=np.int64), sizes)
            sizes = np.minimum(sizes, 65535).astype("<u2")
            bucket = ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            hashes, cell = hashes[order], bucket[order] * len(sets) + owner[order]
            starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            cells = cell[starts]
            lengths = np.diff(np.concatenate((starts, [len(cell)]))).astype("<u4")
            which, first = np.unique(cells // len(sets), return_index=True)
            ends = np.concatenate((first[1:], [len(cells)]))
            owners = cells % len(sets)
            token_ends = np.cumsum(lengths)[ends - 1]
            return pa.RecordBatch.from_arrays([
                pa.array(which, pa.int64()), binary_lists(keys[owners], ends, width), binary_lists(sizes[owners], ends, 2), binary_lists(lengths, ends, 4), binary_lists(hashes, token_ends, 8),
            ], names=["bucket", "keys", "sizes", "lengths", "hashes"])

        for batch in batches:
            for part in sliced(batch, 0):
                for key, s in hashed(part.column(0).to_pylist()):
                    key = key[:width]
                    if len(s) and key not in sets:
                        sets[key] = s
                        count += len(s)
                if count >= PACKED:
                    yield from frequent_apart(pack(), frequent, buckets, width)
                    sets, count = {}, 0
        if sets:
            yield from frequent_apart(pack(), frequent, buckets, width)

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, keys binary, sizes binary, lengths binary, hashes binary")


def _joined(table: pa.Table | pa.RecordBatch, column: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype=dtype)


def key_width(keys: DataFrame, column: str) -> int:
    """8 if the first 8 bytes tell all of the distinct 16-byte keys apart, else 16."""
    return 16 if keys.groupBy(F.substring(column, 1, 8)).count().where("count > 1").limit(1).count() else 8


def shared_hashes(packed: DataFrame, groups: int, percent: int, width: int) -> DataFrame:
    """(set_key, hashes, freqs) of the sets of which at least ``percent`` is in another set; only shared hashes are listed, rarest first.

    Keys have ``width`` bytes. Sets of more than 65535 members count as of so
    many, so some more of them may be listed.
    """

    def within_bucket(table: pa.Table) -> pa.Table:
        keys, sizes, lengths, hashes = (_joined(table, c, d) for c, d in (("keys", f"S{width}"), ("sizes", "<u2"), ("lengths", "<u4"), ("hashes", "<u8")))
        if table.column("bucket")[0].as_py() < 0:  # frequent hashes of the sets of one group
            keys, first, owner = np.unique(keys, return_index=True, return_inverse=True)
            owner = np.repeat(owner, lengths)
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
            owner, hashes = owner[fresh], hashes[fresh]
            sizes, lengths = sizes[first], np.bincount(owner, minlength=len(keys))
            freq = np.full(len(hashes), FREQUENT)
        else:
            _, first = np.unique(keys, return_index=True)
            kept = np.zeros(len(keys), dtype=bool)
            kept[first] = True  # copies of a set that other tasks packed too count once
            hashes = hashes[np.repeat(kept, lengths)]
            keys, sizes, lengths = keys[kept], sizes[kept], lengths[kept]
            order = np.argsort(hashes, kind="stable")
            by = hashes[order]
            starts = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate((starts, [len(by)])))
            freq = np.empty(len(by), dtype=np.int64)
            freq[order] = np.repeat(counts, counts)
        shared = freq > 1
        owner = np.repeat(np.arange(len(keys)), lengths)[shared]
        hashes, freq = hashes[shared], np.minimum(freq[shared], FREQUENT).astype("<u2")
        left = np.bincount(owner, minlength=len(keys))
        group = _group_of(keys, groups, width)
        has = np.flatnonzero(left)
        has = has[np.argsort(group[has], kind="stable")]
        starts_of = np.concatenate(([0], np.cumsum(left)))[:-1]
        take = np.repeat(starts_of[has] - np.concatenate(([0], np.cumsum(left[has])))[:-1], left[has]) + np.arange(int(left[has].sum()))
        which, at = np.unique(group[has], return_index=True)
        to = np.concatenate((at[1:], [len(has)]))[: len(which)]
        token_ends = np.cumsum(left[has])[to - 1] if len(has) else np.zeros(0, np.int64)
        return pa.Table.from_arrays([
            pa.array(which, pa.int64()), binary_lists(keys[has], to, width), binary_lists(sizes[has], to, 2), binary_lists(left[has].astype("<u4"), to, 4), binary_lists(hashes[take], token_ends, 8), binary_lists(freq[take], token_ends, 2),
        ], names=["grp", "keys", "sizes", "lengths", "hashes", "freqs"])

    def within_group(table: pa.Table) -> pa.Table:
        keys, sizes, lengths, hashes, freqs = (_joined(table, c, d) for c, d in (("keys", f"S{width}"), ("sizes", "<u2"), ("lengths", "<u4"), ("hashes", "<u8"), ("freqs", "<u2")))
        names, first, owner = np.unique(keys, return_index=True, return_inverse=True)
        n = sizes[first].astype(np.int64)
        owner = np.repeat(owner, lengths)
        able = np.bincount(owner, minlength=len(names)) * 100 >= percent * n
        mine = able[owner]
        owner, hashes, freqs = owner[mine], hashes[mine], freqs[mine]
        order = np.lexsort((hashes, freqs, owner))
        ends = np.cumsum(np.bincount(owner, minlength=len(names)))[able]
        return pa.Table.from_arrays([binary_lists(keys[first][able], np.arange(1, int(able.sum()) + 1), width), binary_lists(hashes[order], ends, 8), binary_lists(freqs[order], ends, 2)], names=["set_key", "hashes", "freqs"])

    by_bucket = packed.groupBy("bucket").applyInArrow(within_bucket, "grp long, keys binary, sizes binary, lengths binary, hashes binary, freqs binary")
    return by_bucket.groupBy("grp").applyInArrow(within_group, "set_key binary, hashes binary, freqs binary")
