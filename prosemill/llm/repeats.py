"""Repeats across documents by common-prefix interval trees of enhanced suffix arrays.

Texts are byte strings. Every window of ``WINDOW`` bytes picks an anchor by its
content (see anchors.py), so equal windows meet at equal anchors:

1. Anchors that stand in two texts are found without a row for each anchor;
   those that stand twice in one text are seen at the text.
2. A block is the windows that pick one anchor. Of equal blocks the first one,
   by doc_id and place, stays; the others are repeats as a whole.
3. Anchors with unequal blocks are split by their 66 bytes of near context.
   The first blocks' strings left and right of the anchor give two suffix
   arrays. A stack-scan over longest common prefixes lists the intervals of the
   left one; in each, its members in right order are scanned the same way.
   An interval whose members fall in several children on the left has diverse
   left extensions: it is a maximal repeat, reported with all its occurrences.
   Repeats reach as far as the windows of their anchor; longer ones are runs
   of such repeats, which join in the documents.
4. In each repeat all occurrences but the first are removed.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .anchors import Hashes, anchors
from .common import shared_folder, sliced, stored
from .packed import BUCKET, frequent_hashes, key_width, pack_counts, packed_sets, shared_hashes, without_frequent

WINDOW, GRAM = 100, 32
#: Bytes left of an anchor from which a window belongs to the left half.
SIDE = 34
#: Text bytes in a bucket of the document table, and variant blocks in a group of the suffix scan.
BODY_BUCKET, VARIANTS = 48 << 20, 60_000


def _key(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _hasher():
    def hashed(texts: list[str | None]) -> list[tuple[bytes, np.ndarray]]:
        data = [(x or "").encode() for x in texts]
        owner, _, _, _, hashes, _ = anchors(data, WINDOW, GRAM)
        bounds = np.searchsorted(owner, np.arange(len(data) + 1))
        return [(_key(d), np.unique(hashes[a:b])) for d, a, b in zip(data, bounds, bounds[1:], strict=False)]

    return hashed


def _bodies(docs: DataFrame) -> DataFrame:
    """(doc_id, body): texts, compressed on their way through shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in sliced(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([press.compress((x or "").encode()) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "body"])

    return docs.mapInArrow(run, "doc_id long, body binary")


def bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table bucketed by doc_id in the shared folder, so that joins on doc_id don't move it again."""
    spark = df.sparkSession
    name = f"prosemill_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, "doc_id").write.bucketBy(buckets, "doc_id").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(name)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _shared_blocks(part: pa.RecordBatch) -> tuple[list[int], list[bytes], tuple[np.ndarray, ...]]:
    """Doc_ids, texts and those blocks whose anchor stands elsewhere too. part: (doc_id, body, shared)."""
    press = zstandard.ZstdDecompressor()
    ids, texts = part.column(0).to_pylist(), [press.decompress(b) for b in part.column(1).to_pylist()]
    owner, place, first, count, anchor, block = anchors(texts, WINDOW, GRAM)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    again = np.zeros(len(owner), dtype=bool)
    for i, s in enumerate(part.column(2).to_pylist()):
        own = anchor[bounds[i] : bounds[i + 1]]
        _, inverse, n = np.unique(own, return_inverse=True, return_counts=True)
        again[bounds[i] : bounds[i + 1]] = (n[inverse] > 1) if len(own) else False
        if s:
            shared = np.frombuffer(s, "<u8")
            again[bounds[i] : bounds[i + 1]] |= np.isin(own, shared)
    return ids, texts, tuple(x[again] for x in (owner, place, first, count, anchor, block))


_OCCURRENCES = "anchor long, block long, doc_id long, first long"


def occurrences(bodies: DataFrame) -> DataFrame:
    """(anchor, block, doc_id, first): the first of equal blocks of a slice of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                ids, _, (owner, _, first, _, anchor, block) = _shared_blocks(part)
                doc = np.array(ids, dtype=np.int64)[owner]
                order = np.lexsort((first, doc, block, anchor))
                a, b = anchor[order], block[order]
                new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
                kept = order[new]
                yield pa.RecordBatch.from_arrays([pa.array(x[kept].astype(np.int64)) for x in (anchor.view(np.int64), block.view(np.int64), doc, first)], names=["anchor", "block", "doc_id", "first"])

    return bodies.select("doc_id", "body", "shared").mapInArrow(run, _OCCURRENCES)


_PIECES = "doc_id long, start long, stop long, half long, place long, reach int, least int, string binary"


def pieces(bodies: DataFrame) -> DataFrame:
    """Two kinds of rows: spans (start, stop) of blocks that stand elsewhere before; and, with ``half`` set, halves of first blocks of anchors with several.

    bodies: (doc_id, body, shared, firsts, several): firsts are the first windows of blocks that come first, several
    tells which of them have an anchor with unequal blocks. A half has its anchor's
    ``place``, the bytes ``reach`` left of it, the ``least`` offset of its windows and the string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                ids, texts, (owner, place, first, count, _, _) = _shared_blocks(part)
                bounds = np.searchsorted(owner, np.arange(len(ids) + 1))
                rows: list[list] = [[] for _ in range(8)]
                firsts, several = part.column(3).to_pylist(), part.column(4).to_pylist()
                for i, doc in enumerate(ids):
                    mine = slice(bounds[i], bounds[i + 1])
                    kind = dict(zip(firsts[i] or [], several[i] or [], strict=True))
                    spans, halves = [], []
                    for p, f, c in zip(place[mine].tolist(), first[mine].tolist(), count[mine].tolist(), strict=True):
                        if f not in kind:
                            spans.append((f, f + c + WINDOW - 1))
                        elif kind[f]:
                            halves.append((p, p - f, p - f - c + 1))
                    for s, e in merged(spans):
                        for column, x in zip(rows, (doc, s, e, None, None, None, None, None), strict=True):
                            column.append(x)
                    if halves:
                        hashes = Hashes(np.frombuffer(texts[i], dtype=np.uint8))
                        at = np.array([p for p, _, _ in halves])
                        left = hashes.of(np.maximum(at - SIDE, 0), at + GRAM).view(np.int64)
                        right = hashes.of(at, np.minimum(at + WINDOW - SIDE + 1, len(texts[i]))).view(np.int64)
                        for k, (p, most, least) in enumerate(halves):
                            if most >= SIDE:
                                low = max(least, SIDE)
                                for column, x in zip(rows, (doc, None, None, int(left[k]), p, most, low, texts[i][p - most : p + WINDOW - low]), strict=True):
                                    column.append(x)
                            if least < SIDE:
                                high = min(most, SIDE - 1)
                                for column, x in zip(rows, (doc, None, None, ~int(right[k]), p, high, least, texts[i][p - high : p + WINDOW - least]), strict=True):
                                    column.append(x)
                kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=[c.split()[0] for c in _PIECES.split(", ")])

    return bodies.select("doc_id", "body", "shared", "firsts", "several").mapInArrow(run, _PIECES)


def _suffix_order(group: np.ndarray, strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp): rows sorted by group and string, and the common prefix of each with the row before, -1 across groups. Strings are padded with a byte that no text has."""
    width = -(-strings.shape[1] // 8) * 8
    padded = np.full((len(strings), width), 255, dtype=np.uint8)
    padded[:, : strings.shape[1]] = strings
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort([*(words[:, i] for i in range(words.shape[1] - 1, -1, -1)), group])
    return order, _common(group[order], strings[order], lengths[order])


def _common(group: np.ndarray, strings: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the row before; -1 across groups."""
    out = np.full(len(group), -1, dtype=np.int64)
    for at in range(1, len(group), 1 << 17):
        to = min(len(group), at + (1 << 17))
        differ = strings[at:to] != strings[at - 1 : to - 1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
        same = np.minimum(same, np.minimum(lengths[at:to], lengths[at - 1 : to - 1]))
        out[at:to] = np.where(group[at:to] == group[at - 1 : to - 1], same, -1)
    return out


def left_intervals(lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, depth) of the intervals of two rows and more of an LCP array; a stack-scan. to is exclusive."""
    out, stack = [], [(-1, 0)]
    for i, depth in enumerate([*lcp[1:].tolist(), -1], 1):
        start = i - 1
        while stack[-1][0] > depth:
            d, start = stack.pop()
            out.append((start, i, d))
        if depth > stack[-1][0]:
            stack.append((depth, start))
    return out


def maximal_repeats(group: np.ndarray, strings: list[bytes], reach: np.ndarray, location: np.ndarray) -> tuple[np.ndarray, ...]:
    """(repeat, row, left, right, first) of every occurrence of a maximal repeat of WINDOW bytes or more.

    Row i has a string whose anchor starts after ``reach[i]`` bytes; rows of one
    group are compared at their anchors. A repeat takes ``left`` bytes before the
    anchor and ``right`` from it on; ``first`` marks its least location.
    """
    n = len(strings)
    reach = reach.astype(np.int64)
    right_length = np.array([len(s) for s in strings], dtype=np.int64) - reach
    left = np.full((n, int(reach.max()) + 1), 255, dtype=np.uint8)
    right = np.full((n, WINDOW + 1), 255, dtype=np.uint8)
    for i, s in enumerate(strings):
        data, r = np.frombuffer(s, dtype=np.uint8), int(reach[i])
        left[i, :r] = data[:r][::-1]
        right[i, : len(data) - r] = data[r:]
    order, lcp = _suffix_order(group, left, reach)
    nodes = left_intervals(lcp)
    if not nodes:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    lo, hi, depth = (np.array(x, dtype=np.int64) for x in zip(*nodes, strict=True))
    size = hi - lo
    node = np.repeat(np.arange(len(nodes)), size)
    member = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    # the child of a node that a member falls in: the next deeper node around it, or itself alone
    by_member = np.lexsort((depth[node], member))
    node, member = node[by_member], member[by_member]
    inner = np.concatenate((member[1:] == member[:-1], [False]))
    child = np.where(inner, np.concatenate((node[1:], [0])), -member - 1)
    rank = np.empty(n, dtype=np.int64)
    right_order, _ = _suffix_order(group, right, right_length)
    rank[right_order] = np.arange(n)
    row = order[member]
    within = np.lexsort((rank[row], node))
    node, row, child = node[within], row[within], child[within]
    shared = _common(node, right[row], right_length[row])
    place = np.empty(n, dtype=np.int64)
    place[np.argsort(location, kind="stable")] = np.arange(n)
    where, need = place[row].tolist(), (WINDOW - depth).tolist()
    kids, of = child.tolist(), node.tolist()
    found: list[tuple[int, int, int, int, int]] = []
    stack: list[list[int]] = []
    for i, d in enumerate([*shared.tolist(), -2]):
        # entries: depth, from, least child, largest child, least location
        if i:
            held = [i - 1, kids[i - 1], kids[i - 1], where[i - 1]]
            while stack and stack[-1][0] > d:
                top = stack.pop()
                held = [top[1], min(held[1], top[2]), max(held[2], top[3]), min(held[3], top[4])]
                if top[0] >= need[of[i - 1]] and held[1] != held[2]:
                    found.append((top[1], i, top[0], of[i - 1], held[3]))
            if d >= 0:
                if stack and stack[-1][0] == d:
                    top = stack[-1]
                    top[2], top[3], top[4] = min(top[2], held[1]), max(top[3], held[2]), min(top[4], held[3])
                else:
                    stack.append([d, *held])
    if not found:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none.astype(bool)
    a, b, r, k, least = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
    size = b - a
    repeat = np.repeat(np.arange(len(found)), size)
    rows = row[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    return repeat, rows, depth[k][repeat], r[repeat], place[rows] == least[repeat]


def scan_halves(halves: DataFrame, groups: int) -> DataFrame:
    """(doc_id, start, stop): occurrences of maximal repeats other than the first, from rows of pieces() with a half."""

    def run(table: pa.Table) -> pa.Table:
        half, doc, at, reach, least = (table.column(c).to_numpy().astype(np.int64) for c in ("half", "doc_id", "place", "reach", "least"))
        _, group, counts = np.unique(half, return_inverse=True, return_counts=True)
        several = np.flatnonzero(counts[group] > 1)
        if not len(several):
            return pa.table({c: pa.array([], pa.int64()) for c in ("doc_id", "start", "stop")})
        strings = table.column("string").take(pa.array(several)).to_pylist()
        group, doc, at, reach, least = (x[several] for x in (group, doc, at, reach, least))
        location = np.empty(len(doc), dtype=np.int64)
        location[np.lexsort((at, doc))] = np.arange(len(doc))
        _, row, left, right, first = maximal_repeats(group, strings, reach, location)
        row, left, right = row[~first], left[~first], right[~first]
        # windows at offsets from WINDOW - right to left, as far as the row's own go
        low, high = np.maximum(WINDOW - right, least[row]), np.minimum(left, reach[row])
        ok = low <= high
        spans = np.unique(np.stack([doc[row], at[row] - high, at[row] - low + WINDOW], axis=1)[ok], axis=0)
        return pa.table({c: pa.array(spans[:, i]) for i, c in enumerate(("doc_id", "start", "stop"))})

    dealt = halves.withColumn("part", F.pmod(F.xxhash64("half"), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(run, "doc_id long, start long, stop long")


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, bodies, spans).

    The ids of docs are distinct and not null.
    texts: (doc_id, n_bytes, sha256, kept_doc), a row for each row of docs, kept_doc the
    least doc_id of the equal text. bodies: (doc_id, body) of those, compressed.
    spans: (doc_id, spans) of theirs, repeats of what stands earlier, ends exclusive.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
    texts = stored(named.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256")), "repeats-texts")
    kept = stored(texts.where("doc_id is not null").groupBy("sha256").agg(F.min("doc_id").alias("kept_doc"), F.first("n_bytes").alias("n")), "repeats-kept")
    size = kept.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(size * 2 / (WINDOW - GRAM + 2) / BUCKET))
    keyed = kept.select(F.substring(F.unhex("sha256"), 1, 16).alias("set_key"), F.col("kept_doc").alias("doc_id"))
    bytes_of_key = key_width(keyed, "set_key")
    keyed = keyed.withColumn("set_key", F.substring("set_key", 1, bytes_of_key))
    packed = stored(packed_sets(named, "text", _hasher, parts, bytes_of_key), "repeats-packed")
    frequent = frequent_hashes(pack_counts(packed), packed.agg(F.sum(F.octet_length("hashes") / 8)).first()[0] or 0)
    shared = shared_hashes(without_frequent(packed, frequent, parts, bytes_of_key), parts, 0, bytes_of_key)
    wanted = stored(keyed.join(shared.select("set_key", F.col("hashes").alias("shared")), "set_key", "left").select("doc_id", "shared").where("doc_id is not null").groupBy("doc_id").agg(F.first("shared", ignorenulls=True).alias("shared")), "repeats-shared")
    buckets = max(4, math.ceil(size / BODY_BUCKET))
    bodies = bucketed(_bodies(named).join(wanted, "doc_id"), buckets)
    every = occurrences(bodies)
    first = stored(every.groupBy("anchor", "block").agg(F.min(F.struct("doc_id", "first")).alias("at")).select("anchor", "at.doc_id", "at.first"), "repeats-firsts")
    unequal = first.groupBy("anchor").agg(F.count("*").alias("blocks")).where("blocks > 1").select("anchor", F.lit(True).alias("several"))
    by_doc = first.join(unequal, "anchor", "left").groupBy("doc_id").agg(F.collect_list(F.struct("first", F.coalesce("several", F.lit(False)).alias("several"))).alias("b"))
    marked = bodies.join(by_doc.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "body", "shared", F.col("b.first").alias("firsts"), F.col("b.several").alias("several"))
    found = stored(pieces(marked), "repeats-pieces")
    halves = found.where("half is not null")
    groups = max(1, math.ceil(halves.count() / VARIANTS))
    partial = scan_halves(halves, groups)
    spans = found.where("half is null").select("doc_id", "start", "stop").unionByName(partial).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(kept.select("sha256", "kept_doc"), "sha256", "left"), bodies.select("doc_id", "body"), stored(spans, "repeats-spans")


def ranked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, sha256, text, row): the distinct pairs of id and text, numbered by id, nulls last, then by digest.

    Rows are numbered within ranges of ids, and ranges start where those before end.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(t, 256).alias("sha256"), t.alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("sha256").asc()]
    once = rows.groupBy("doc_id", "sha256").agg(F.first("text").alias("text"))
    dealt = stored(once.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "repeats-ranks")
    counts = dealt.groupBy("block").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("block", before.alias("start"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("block").orderBy(*order))
    return dealt.withColumn("place", place).join(F.broadcast(starts), "block").select("doc_id", "sha256", "text", (F.col("start") + F.col("place")).cast("long").alias("row"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs.

    A byte goes if a 100-byte string over it also starts earlier: in a smaller
    doc_id, or before in the document. Null texts are empty, and null ids come
    after all others. Rows of one doc_id with one text are one document and get
    one result; several texts of one doc_id are documents in the order of their
    digests. Very long texts are cut into pieces that overlap by a window. A
    table without rows gives none. Other columns are not read.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    again = plain.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if again.limit(1).count() == 0:
        return _removed(plain)
    rows = stored(ranked(docs, doc_id, text), "repeats-rows")
    found = _removed(rows.select(F.col("row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "row")
    named = rows.select("row", F.col("doc_id").alias("id"), F.col("sha256").alias("digest")).join(found, "row")
    each = plain.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    return each.join(named, each["doc_id"].eqNullSafe(F.col("id")) & (each["sha256"] == F.col("digest"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """remove_repeats for distinct ids without null."""
    texts, bodies, spans = find_repeats(docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, body, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, at, kept, removed = press.decompress(body), 0, hashlib.sha256(), 0
                joined = merged([(s["start"], s["stop"]) for s in own])
                for s, e in joined:
                    kept.update(data[at:s])
                    removed += e - s
                    at = e
                kept.update(data[at:])
                rows.append((doc, removed, len(joined), kept.hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["kept_doc", "removed", "runs", "digest"])

    cut = bodies.join(spans.hint("shuffle_hash"), "doc_id").select("doc_id", "body", "spans").mapInArrow(run, "kept_doc long, removed long, runs long, digest string")
    copy = (F.col("doc_id") > F.col("kept_doc")) & (F.col("n_bytes") >= WINDOW)
    own = F.coalesce(F.col("doc_id") == F.col("kept_doc"), F.lit(False))
    out = texts.join(cut, "kept_doc", "left")
    return out.select(
        "doc_id", "n_bytes",
        F.when(copy, F.col("n_bytes")).when(own, F.coalesce("removed", F.lit(0))).otherwise(0).cast("long").alias("n_removed"),
        F.when(copy, 1).when(own, F.coalesce("runs", F.lit(0))).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(own, F.coalesce("digest", "sha256")).otherwise(F.col("sha256")).alias("kept_sha256"),
    )
