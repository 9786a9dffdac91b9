"""K-d tree partitioning into shards of near-equal bytes, with DataFrame functions only.

A node with k shards to fill is split along its widest dimension, spread
measured against that of the whole table, at the weighted median: the point
where a share k // 2 of k of its bytes lies below. All nodes of a level are
split together. A split point is found exactly by summing bytes over bins of a
60-bit key, the dimension's value and then a hash of the text, narrowing to one
bin ``60 / STEP_BITS`` times; per node and narrowing one task sees 2^STEP_BITS
bins at most, and the driver gets one row. Rows are written once and find their
node by the comparisons of the tree so far.

Dimensions are functions of the text (its bytes, lines, and shares of spaces,
capitals and digits), so equal texts stay together. Only a group of equal texts
with more bytes than a shard is to hold is spread by doc_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

DIMENSIONS = ("bytes", "lines", "gaps", "capitals", "digits")
#: Bits of a dimension's value in the key (no text has 2^31 bytes), of the tie-breaking hash, and of one narrowing.
VALUE_BITS, HASH_BITS, STEP_BITS = 32, 28, 15
#: What shares of a text's characters are counted in.
PARTS = 1_000_000
#: Rows that one window numbers, about.
NUMBERED = 500_000


def _key(dimension: str) -> Column:
    return F.shiftleft(F.col(dimension), HASH_BITS) + F.shiftrightunsigned("tie", 64 - HASH_BITS)


def described(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h) and the DIMENSIONS of each row; null texts are empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    share = lambda n: F.floor(n.cast("long") * PARTS / F.greatest(F.length(t), F.lit(1))).cast("long")
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t).alias("text_crc32"), F.xxhash64(t).alias("h"),
        F.octet_length(t).cast("long").alias("bytes"), without("\n").cast("long").alias("lines"), share(without(" ")).alias("gaps"),
        share(F.regexp_count(t, F.lit("[A-Z]"))).alias("capitals"), share(F.regexp_count(t, F.lit("[0-9]"))).alias("digits"),
    )


def _by_node(values: dict[int, object], kind: str) -> Column:
    """The value of each row's node, null for others, out of one literal array."""
    return F.get(F.array(*[F.lit(values.get(n)).cast(kind) for n in range(max(values) + 1)]), F.col("node"))


def split_points(rows: DataFrame, nodes: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node, the least key that goes to the right. nodes: the dimension's place and the bytes wanted below.

    rows: (node, size, keys), of these nodes only.
    """
    keyed = rows.select("node", F.get("keys", _by_node({n: d for n, (d, _) in nodes.items()}, "int")).alias("key"), "size")
    found = {n: (0, 0.0) for n in nodes}  # the bins chosen so far, the bytes below them
    shift = VALUE_BITS + HASH_BITS
    while shift:
        shift -= STEP_BITS
        inside = F.shiftright("key", shift + STEP_BITS) == _by_node({n: p for n, (p, _) in found.items()}, "long")
        bins = keyed.where(inside).groupBy("node", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("w"))
        below = F.sum("w").over(Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        wanted = _by_node({n: float(want - found[n][1]) for n, (_, want) in nodes.items()}, "double")
        chosen = bins.select("node", "bin", "w", below.alias("upto")).where(F.col("upto") >= wanted).groupBy("node").agg(F.min(F.struct("bin", "upto", "w")).alias("c"))
        for r in chosen.collect():  # a row a node
            found[r.node] = int(r.c.bin), found[r.node][1] + float(r.c.upto - r.c.w)
            last = float(r.c.w)
            if shift == 0:
                # the side that comes nearer gets the last bin, one key
                off = nodes[r.node][1] - found[r.node][1]
                found[r.node] = (found[r.node][0] + (off * 2 >= last), found[r.node][1])
    return {n: p for n, (p, _) in found.items()}


def kd_shards(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row for each row of docs.

    ``size`` is UTF-8 bytes plus 8, and 8 for a null text. Slots number a shard's
    rows from 0 without gaps, by blocks of a hash of doc_id and in them by doc_id. Equal texts
    share a shard unless together they outweigh one. Repeated rows get slots
    each; a null doc_id is treated like another value. A table with fewer texts
    than shards leaves some empty. Ties in a dimension are broken by the text's
    hash. A very long text is one row like others, and may outweigh its shard.
    Other columns are not read.
    """
    rows = stored(described(docs, doc_id, text), "shards-rows")
    first = rows.agg(F.sum("size").alias("size"), F.count("*").alias("n"), *(F.max(d).alias(f"max_{d}") for d in DIMENSIONS), *(F.min(d).alias(f"min_{d}") for d in DIMENSIONS)).first()
    if not first.n:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    target = first.size / shards
    # fewer of these than shards
    large = [(r.h, r.text_crc32) for r in rows.groupBy("h", "text_crc32").agg(F.sum("size").alias("w")).where(F.col("w") > target).select("h", "text_crc32").collect()]
    is_large = F.lit(False)
    for h, crc in large:
        is_large |= (F.col("h") == h) & (F.col("text_crc32") == crc)
    rows = rows.withColumn("tie", F.when(is_large, F.xxhash64("doc_id", "h")).otherwise(F.col("h"))).withColumn("keys", F.array(*[_key(d) for d in DIMENSIONS]))
    whole = {d: max(1, first[f"max_{d}"] - first[f"min_{d}"]) for d in DIMENSIONS}
    splits: dict[int, tuple[int, int]] = {}  # node: the dimension's place, least key that goes to the right

    def route() -> Column:
        """The node of a row: from the root, 2n to the left and 2n + 1 to the right, as far as nodes are split."""
        if not splits:
            return F.lit(1)
        table = F.array(*[F.struct(F.lit(splits[n][0]).alias("at"), F.lit(int(splits[n][1])).cast("long").alias("point")) if n in splits else F.lit(None) for n in range(max(splits) + 1)])
        step = lambda n, _: F.coalesce(2 * n + (F.get("keys", F.get(table, n)["at"]) >= F.get(table, n)["point"]).cast("int"), n)
        return F.aggregate(F.sequence(F.lit(1), F.lit(max(splits).bit_length())), F.lit(1), step)

    level = {1: (0, shards)}  # node: first shard, shards
    leaves: dict[int, int] = {}
    while level:
        leaves |= {n: at for n, (at, k) in level.items() if k == 1}
        level = {n: x for n, x in level.items() if x[1] > 1}
        if not level:
            break
        here = rows.withColumn("node", route()).where(F.col("node").isin(list(level)))
        stats = here.groupBy("node").agg(F.sum("size").alias("size"), *(F.max(d).alias(f"max_{d}") for d in DIMENSIONS), *(F.min(d).alias(f"min_{d}") for d in DIMENSIONS)).collect()
        spread = lambda r, d: (r[f"max_{d}"] - r[f"min_{d}"]) / whole[d]
        widest = {r.node: (max(range(len(DIMENSIONS)), key=lambda i: spread(r, DIMENSIONS[i])), r.size * (level[r.node][1] // 2) / level[r.node][1]) for r in stats}
        points = split_points(here, widest) if widest else {}
        splits |= {n: (widest[n][0], p) for n, p in points.items()}
        # a node without rows stays one leaf, and its other shards stay empty
        leaves |= {n: at for n, (at, _) in level.items() if n not in points}
        level = {m: x for n, (at, k) in level.items() if n in points for m, x in ((2 * n, (at, k // 2)), (2 * n + 1, (at + k // 2, k - k // 2)))}
    shard = F.element_at(F.create_map(*[F.lit(int(x)) for n, at in leaves.items() for x in (n, at)]), route())
    return numbered(rows.withColumn("shard", shard), first.n // shards // NUMBERED + 1)


def numbered(rows: DataFrame, blocks: int) -> DataFrame:
    """Slots within shards: rows are numbered within blocks, and blocks start where those before end."""
    blocked = rows.select("doc_id", "size", "text_crc32", "h", "shard", F.pmod(F.xxhash64("doc_id"), F.lit(16 * blocks)).alias("block"))
    counts = blocked.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "block", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "h", "size")
    placed = blocked.withColumn("place", F.row_number().over(order) - 1)
    return placed.join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))
