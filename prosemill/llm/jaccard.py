"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its distinct word shingles. Two documents link when
``100 * intersection >= percent * union``. The stages:

1. Each text is shingled; equal sets form a class, named by its least doc_id.
2. Shingles are dealt by hash into buckets as packed blocks, where those of
   one class alone are dropped: they are in no intersection. A class of whose
   shingles fewer than ``percent`` are shared cannot link and is dropped too.
3. What is left is ordered by document frequency. A class picks how many
   prefix shingles it must share with a partner, 1 to ``MOST_MATCHES``: a
   prefix longer by k needs k more common shingles. It takes the number with
   the least estimated cost, postings read plus candidates verified, from the
   frequencies in its prefix. A pair must share the lesser of the two numbers.
4. Classes that posting lists connect form canopies; a pair that links is in
   one. A canopy is dealt into blocks, within which pairs that share enough
   prefix shingles are verified by products of membership matrices. Of canopies
   of several blocks, components meet by one class each as long as that joins
   many; then only classes outside of the largest component meet the others, by
   their posting lists or block by block. No task sees more than two blocks, a
   task gives a spanning forest of its links, and no connection is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, free_name, mix64, sliced, stored
from .packed import BUCKET, PACKED, frequent_hashes, key_width, packed_sets, reported, shared_hashes

MOST_MATCHES = 6
#: Cost of verifying a pair against that of reading a posting.
VERIFY_COST = 4.0
#: Classes of a canopy in one block, and shingles that one product of matrices covers.
BLOCK, COLUMNS = 256, 4096
WORDS_KEPT = 250_000


class Shingler:
    """Distinct shingle hashes of texts; words are cut at ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > WORDS_KEPT:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            import xxhash

            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)

    def hashes(self, text: str | None) -> np.ndarray:
        words = self.word_hashes((text or "").encode().lower().split())
        if len(words) == 0:
            return words
        n = max(1, len(words) - self.width + 1)
        mixed = np.full(n, len(words) if len(words) < self.width else self.width, dtype=np.uint64)
        for i in range(min(self.width, len(words))):
            mixed = mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
        return np.unique(mixed)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(hashes.tobytes())


def _hasher(width: int):
    shingler = Shingler(width)
    return lambda texts: [(set_key(s), s) for s in map(shingler.hashes, texts)]


def shingle_sets(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, h, n_shingles, set_key, seen), a row for each row of docs; h is a hash of the text, the key is null for empty sets.

    Rows with a count in ``seen`` are no documents: so many sets of a pack have the shingle h.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, pack = Shingler(width), {}

        def reports() -> pa.RecordBatch:
            found, counts = reported(np.concatenate(list(pack.values())))
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(found.view(np.int64)), none, pa.nulls(len(found), pa.binary()), pa.array(counts.astype(np.int64))], names=names)

        names, members = ["doc_id", "h", "n_shingles", "set_key", "seen"], 0
        for batch in batches:
            for part in sliced(batch, 2):
                sets = [shingler.hashes(x) for x in part.column(2).to_pylist()]
                keys = [set_key(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.nulls(len(sets), pa.int64())], names=names)
                for key, s in zip(keys, sets, strict=True):
                    if key is not None and key not in pack:
                        pack[key] = s
                        members += len(s)
                if members >= PACKED:
                    yield reports()
                    pack, members = {}, 0
        if pack:
            yield reports()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, h long, n_shingles long, set_key binary, seen long")


def prefix_choice(n: int, freqs: np.ndarray, percent: int) -> tuple[int, int]:
    """(matches needed, shared shingles in the prefix) of least estimated cost. freqs: of the shared shingles, rarest first; the others precede them."""
    alone = n - len(freqs)
    shortest = n - -(-percent * n // 100)
    partners = np.concatenate(([0], np.cumsum(freqs.astype(np.int64) - 1)))
    best = None
    for matches in range(1, MOST_MATCHES + 1):
        length = min(len(freqs), max(0, shortest + matches - alone))
        if matches > 1 and shortest + matches > n:
            break
        cost = partners[length] * (1 + VERIFY_COST / matches)
        if best is None or cost < best[0]:
            best = cost, matches, length
    return best[1], best[2]


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(hash, id, n, matches): the prefix of each class, without shingles of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, needs, parts = [], [], [], []
            for i, n, h, f in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                matches, length = prefix_choice(n, np.frombuffer(f, "<u2"), percent)
                parts.append(np.frombuffer(h, "<i8")[:length])
                ids.append(np.full(length, i)), sizes.append(np.full(length, n)), needs.append(np.full(length, matches))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (parts, ids, sizes, needs)], names=["hash", "id", "n", "matches"])

    return sets.select("id", "n", "hashes", "freqs").mapInArrow(run, "hash long, id long, n long, matches long")


def overlap_counts(rows: list[np.ndarray]) -> np.ndarray:
    """How many items each two of the sorted sets share, by products of membership matrices over a range of items at a time."""
    items = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    _, column, counts = np.unique(items, return_inverse=True, return_counts=True)
    several = counts[column] > 1
    owner, column = owner[several], (np.cumsum(counts > 1) - 1)[column[several]]
    out = np.zeros((len(rows), len(rows)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        at, to = np.searchsorted(column, (lo, lo + COLUMNS))
        member = np.zeros((len(rows), COLUMNS), dtype=np.float32)
        member[owner[at:to], column[at:to] - lo] = 1
        out += member @ member.T
    return out.astype(np.int64)


def forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (rows of two places below n)."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        if (x := root(i)) != (y := root(j)):
            parent[y] = x
            kept.append((i, j))
    return kept


def met_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between the classes of each cell (label, x, y) of ``cells``, which has (id, label, x, y, block, part).

    A cell is one block (x = y) or two that meet. Classes of one part are
    joined already and are not compared. Pairs that share too few prefix
    shingles are left out before their whole sets are compared. A cell gives a
    spanning forest of its links.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, n, block, part = (table.column(c).to_numpy() for c in ("id", "n", "block", "part"))
        hashes = [np.frombuffer(h, "<u8") for h in table.column("hashes").to_pylist()]
        freqs = [np.frombuffer(f, "<u2") for f in table.column("freqs").to_pylist()]
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        chosen = [prefix_choice(int(k), f, percent) for k, f in zip(n, freqs, strict=True)]
        need = np.array([c[0] for c in chosen])
        common = overlap_counts([h[: c[1]] for h, c in zip(hashes, chosen, strict=True)])
        able = np.triu(common >= np.minimum(need[:, None], need[None, :]), 1)
        able &= (n[:, None] * 100 >= n[None, :] * percent) & (n[None, :] * 100 >= n[:, None] * percent)
        able &= part[:, None] != part[None, :]
        if x != y:
            able &= block[:, None] != block[None, :]
        links = np.zeros((0, 2), dtype=np.int64)
        if able.any():
            both = overlap_counts(hashes)
            links = np.argwhere(able & (100 * both >= percent * (n[:, None] + n[None, :] - both)))
        kept = forest(links, len(ids))
        return pa.table({"a": pa.array([ids[i] for i, _ in kept], pa.int64()), "b": pa.array([ids[j] for _, j in kept], pa.int64())})

    # written, so that Spark knows the size by which it picks the join, and few cells don't shuffle all sets
    dealt = stored(cells.select("id", "label", "x", "y", "block", "part"), "jaccard-cells")
    return dealt.join(sets, "id").groupBy("label", "x", "y").applyInArrow(run, "a long, b long")


def _numbered(classes: DataFrame, salt: int) -> DataFrame:
    """``classes`` (id, label, part) as cells of one block each."""
    sizes = classes.groupBy("label").agg(F.count("*").alias("m")).where("m > 1")
    block = F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col("m") / BLOCK)).cast("int")
    return classes.join(sizes, "label").withColumn("block", block).select("id", "label", F.col("block").alias("x"), F.col("block").alias("y"), "block", "part")


def posting_links(sets: DataFrame, entries: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different parts, from the pairs that meet in enough posting lists of at most ``BLOCK`` entries."""
    mine = entries.join(parts.select("id", "part"), "id")
    left = mine.select("hash", F.col("id").alias("a"), F.col("n").alias("an"), F.col("matches").alias("am"), F.col("part").alias("ap"))
    right = mine.select("hash", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("matches").alias("bm"), F.col("part").alias("bp"))
    near = left.join(right, "hash").where("a < b and ap <> bp").where((F.col("an") * 100 >= F.col("bn") * percent) & (F.col("bn") * 100 >= F.col("an") * percent))
    pairs = near.groupBy("a", "b").agg(F.count("*").alias("common"), F.min(F.least("am", "bm")).alias("need")).where("common >= need").select("a", "b")
    sides = [sets.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("hashes").alias(f"h_{c}")) for c in "ab"]

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b, h_a, h_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "h_a", "h_b"))
            both = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(h_a, h_b, strict=True)]
            good = [100 * k >= percent * (p + q - k) for k, p, q in zip(both, n_a, n_b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "n_a", "n_b", "h_a", "h_b").mapInArrow(verified, "a long, b long")


def cross_links(sets: DataFrame, entries: DataFrame, canopies: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """(a, b): ``links`` and the links between the blocks of canopies that have several.

    Only connections count, so what one component holds already does not meet
    again. As long as that halves their number, one class of each component
    meets those of other components in blocks; near copies of one text become
    one component this way, by as many comparisons as blocks times their size.
    The classes outside of the largest component of a canopy then meet all
    others: by posting lists where these are short and few pairs meet in them,
    else block by block. M classes of which r stay outside take r * M
    comparisons at most, and no task more than two blocks.
    """
    found = stored(links.join(canopies.select(F.col("id").alias("a")), "a", "left_semi"), "jaccard-within")
    before, salt = canopies.count(), 0
    while True:
        joined = components(canopies.select("id"), found, "jaccard-parts").select("id", F.col("label").alias("part"))
        parts = stored(canopies.join(joined, "id").select("id", "label", "part"), "jaccard-parts")
        heads = parts.where("id = part")
        number = heads.count()
        if 2 * number > before:
            break
        before, salt = number, salt + 1
        found = stored(found.unionByName(met_links(_numbered(heads, salt), sets, percent)), "jaccard-heads")
    sizes = parts.groupBy("label", "part").agg(F.count("*").alias("size"))
    shape = sizes.groupBy("label").agg(F.max(F.struct("size", "part")).alias("most"), F.sum("size").alias("m")).where("most.size < m")
    shape = stored(shape.select("label", F.col("most.part").alias("main"), F.col("most.size").alias("size"), "m"), "jaccard-shapes")
    lists = entries.join(canopies, "id").groupBy("label", "hash").agg(F.count("*").alias("k"))
    short = lists.groupBy("label").agg(F.max("k").alias("longest"), F.sum(F.expr("k * (k - 1)")).alias("pairs")).where(F.col("longest") <= BLOCK)
    sparse = stored(shape.join(short, "label").where("pairs * 4 <= (m - size) * m").select("label"), "jaccard-sparse")
    by_list = posting_links(sets, entries, parts.join(sparse, "label", "left_semi"), percent)
    dense = parts.join(shape.join(sparse, "label", "left_anti"), "label")
    main, p, q = F.col("part") == F.col("main"), F.ceil(F.col("size") / BLOCK), F.ceil((F.col("m") - F.col("size")) / BLOCK)
    spread = F.xxhash64("id", F.lit(-1))
    dealt = dense.select("id", "label", "part", F.when(main, F.pmod(spread, p)).otherwise(p + F.pmod(spread, q)).cast("int").alias("block"), F.when(main, p).otherwise(F.lit(0)).cast("int").alias("low"), (p + q - 1).cast("int").alias("high"))
    tiles = dealt.withColumn("other", F.explode(F.sequence("low", "high")))
    cells = tiles.select("id", "label", "part", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return links.unionByName(found).unionByName(by_list).unionByName(met_links(cells, sets, percent))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id), a row for each row of docs.

    ``set_id`` is the least doc_id with an equal set; ``component_id`` the least
    doc_id reachable by links. Texts of fewer than ``width`` words are one
    shingle, their whole sequence; a very long text is one set like others.
    Null or empty texts link with nothing: both ids are their own doc_id.
    Repeated rows stay, each with its class, and a doc_id with several texts is
    in the class of each; a null doc_id takes no part in naming and gets the
    name of its class. Tables without rows give none. Other columns of docs are
    not read.
    """
    return _named_rows(docs, doc_id, text, width, percent).select("doc_id", "n_shingles", "set_id", "component_id")


def _named_rows(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    if not 50 <= percent <= 100:
        raise ValueError("percent is between 50 and 100")
    written = stored(shingle_sets(docs, doc_id, text, width), "jaccard-sets")
    members = written.where("seen is null").drop("seen")
    frequent = frequent_hashes(written.where("seen is not null").select(F.col("h").alias("hash"), "seen"), members.agg(F.sum("n_shingles")).first()[0] or 0)
    named = members.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("name"), F.first("n_shingles").alias("n")).where("name is not null")
    # numbers that are written once stay as they are
    classes = stored(named.withColumn("id", F.monotonically_increasing_id()), "jaccard-classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(1, math.ceil(total / BUCKET))
    bytes_of_key = key_width(classes, "set_key")
    shared = shared_hashes(packed_sets(docs, text, partial(_hasher, width), parts, bytes_of_key, frequent), parts, percent, bytes_of_key)
    short = classes.select(F.substring("set_key", 1, bytes_of_key).alias("set_key"), "id", "n")
    able = F.octet_length("hashes") / 8 * 100 >= percent * F.col("n")
    sets = stored(shared.join(short, "set_key").where(able).select("id", "n", "hashes", "freqs"), "jaccard-shared")
    entries = stored(postings(sets, percent), "jaccard-postings")
    labels = stored(link_components(sets, entries, percent).join(classes.select("id", "name"), "id"), "jaccard-labels")
    names = labels.groupBy("label").agg(F.min("name").alias("component_id"))
    linked = classes.join(labels.join(names, "label").select("id", "label", "component_id"), "id", "left").select("set_key", F.col("name").alias("set_id"), F.coalesce("component_id", "name").alias("component_id"), F.coalesce("label", "id").alias("label"))
    return members.join(linked, "set_key", "left").select("doc_id", "h", "n_shingles", "label", F.coalesce("set_id", "doc_id").alias("set_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def link_components(sets: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """(id, label) of every class in ``sets``: label is the least id reachable."""
    nodes = sets.select("id")
    lists = entries.groupBy("hash").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1")
    met = entries.join(lists, "hash").select("a", F.col("id").alias("b")).where("a <> b").distinct()
    # the heads of the lists that a class is in hang on the least of them, once for all such classes
    least = met.select("a", "b", F.min("a").over(Window.partitionBy("b")).alias("m"))
    hung = least.select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a <> b")
    canopies = stored(components(nodes, hung, "jaccard-canopies"), "jaccard-canopies")
    links = stored(met_links(_numbered(canopies.withColumn("part", F.col("id")), 0), sets, percent), "jaccard-links")
    large = canopies.groupBy("label").count().where(F.col("count") > BLOCK)
    if large.limit(1).count():
        several = stored(canopies.join(large, "label", "left_semi"), "jaccard-large")
        links = stored(cross_links(sets, entries, several, links, percent), "jaccard-links")
    return components(nodes, links, "jaccard-components")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row for each component, that of the least doc_id; if that has several of its rows, the one with the least text.

    Null and empty texts and null doc_ids stay; rows of one doc_id are judged
    each by its own text. Equal rows count once. A very long text is a set of
    very many shingles, of eight bytes each. Empty tables give none. Other
    columns pass through, whatever their names.
    """
    own, mine, name, rank = free_name(docs, "class_hash"), free_name(docs, "text_hash"), free_name(docs, "component"), free_name(docs, "rank")
    key, group = free_name(docs, "id_key"), free_name(docs, "label")
    found = _named_rows(docs, doc_id, text, width, percent).where("doc_id is not null and n_shingles > 0")
    names = found.groupBy("doc_id", "h").agg(F.min("component_id").alias(name), F.min("label").alias(group)).select(F.col("doc_id").alias(key), F.col("h").alias(own), name, group)
    hashed = docs.withColumn(mine, F.xxhash64(text))
    out = hashed.join(names, (hashed[doc_id] == F.col(key)) & (hashed[mine] == F.col(own)), "left").where(F.col(name).isNull() | (F.col(name) == F.col(doc_id)))
    if docs.groupBy(doc_id).count().where(f"count > 1 and `{doc_id}` is not null").limit(1).count() == 0:
        return out.select(*docs.columns)
    order = Window.partitionBy(doc_id, group).orderBy(F.col(text))
    return out.withColumn(rank, F.row_number().over(order)).where(F.col(name).isNull() | (F.col(rank) == 1)).select(*docs.columns)
