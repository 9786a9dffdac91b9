"""Chat formatting of reply trees.

Iterative self-joins list each leaf's ancestors: in round k every listed message
is joined with the ancestor 2^k above it, so a path of n messages takes log n
rounds. Branches of a tree are ranked by the mean score of their messages, and
each chosen path becomes one conversation in the template below. Control
strings inside texts are escaped, so the turns can be read back exactly.

    user       <s>[INST]text[/INST]
    assistant  <s>text</s>
    others     <s>[ROLE]role[/ROLE]text</s>
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: The tree of turns without conv_id; no conversation may have it as its id.
NO_ID = -(1 << 63)
_ESCAPE = {"\\": "\\\\", "<": "\\l", "[": "\\b"}
_PLAIN = {v: k for k, v in _ESCAPE.items()}
_TURN = re.compile(r"<s>(?:\[INST\]([^<\[]*)\[/INST\]|\[ROLE\]([^<\[]*)\[/ROLE\]([^<\[]*)</s>|([^<\[]*)</s>)")


def escaped(text: str) -> str:
    return re.sub(r"[\\<\[]", lambda m: _ESCAPE[m[0]], text)


def unescaped(text: str) -> str:
    return re.sub(r"\\.", lambda m: _PLAIN[m[0]], text)


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(conversation, spans under the loss mask): code points, of the assistant's texts."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        if role == "user":
            piece = f"<s>[INST]{body}[/INST]"
        elif role == "assistant":
            piece = f"<s>{body}</s>"
            spans.append((at + 3, at + 3 + len(body)))
        else:
            piece = f"<s>[ROLE]{escaped(role)}[/ROLE]{body}</s>"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def read_back(conversation: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(conversation):
        m = _TURN.match(conversation, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m[1] is not None:
            turns.append(("user", unescaped(m[1])))
        elif m[2] is not None:
            turns.append((unescaped(m[2]), unescaped(m[3])))
        else:
            turns.append(("assistant", unescaped(m[4])))
        at = m.end()
    return turns


def _links(messages: DataFrame) -> DataFrame:
    """(tree, node, above): each message's parent, where there is one."""
    there = messages.select("tree", F.col("node").alias("parent"))
    return messages.select("tree", "node", "parent").join(there, ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("above"))


def leaf_scores(messages: DataFrame) -> DataFrame:
    """(tree, leaf, total, n): the sum of scores and the number of messages from each leaf up to its root.

    messages: (tree, node, parent, score), as ``branches`` takes them. Every
    message knows what a stretch of its ancestors sums up to, and the stretches
    double each round by a join with those of the message where they end. A
    round has a row for each message whose stretch does not reach its root. A leaf whose ancestors
    run into a cycle reaches no root and is left out.
    """
    most = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    rows = stored(messages.select("tree", "node", F.col("score").alias("total")).join(_links(messages), ["tree", "node"], "left").select("tree", "node", "above", "total", F.lit(1).cast("long").alias("n")), "chat-sums")
    inner = rows.where("above is not null").select("tree", F.col("above").alias("node")).distinct()
    leaves = stored(rows.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf")), "chat-leaves")
    # only what has ancestors left takes part in a round
    done, left, span = rows.where("above is null"), rows.where("above is not null"), 1
    while span < most and left.limit(1).count():
        beyond = done.unionByName(left).select("tree", F.col("node").alias("above"), F.col("above").alias("farther"), F.col("total").alias("more"), F.col("n").alias("steps"))
        joined = left.join(beyond, ["tree", "above"])
        moved = stored(joined.select("tree", "node", F.col("farther").alias("above"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("steps")).alias("n")), "chat-sums")
        done, left = done.unionByName(moved.where("above is null")), moved.where("above is not null")
        span *= 2
    return done.withColumnRenamed("node", "leaf").join(leaves, ["tree", "leaf"], "left_semi").select("tree", "leaf", "total", "n")


def branches(messages: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """(tree, leaf, node, back): each leaf's ancestors and itself, back steps above it; of ``leaves`` (tree, leaf) only, if given.

    messages: (tree, node, parent). A parent that isn't there makes a root. The
    pairs (tree, node) are distinct and not null. A leaf whose ancestors run
    into a cycle reaches no root and gives no path, and a cycle has no leaf. A
    round's rows are written once; the rounds end as no path has more steps
    than its tree has messages.
    """
    above = jump = stored(_links(messages), "chat-above")
    if leaves is None:
        leaves = messages.join(jump.select("tree", F.col("above").alias("node")).distinct(), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    sizes = messages.groupBy("tree").agg(F.count("*").alias("n"))
    paths = stored(leaves.join(sizes, "tree").select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"), "n"), "chat-paths")
    span, cut = 1, False
    while True:
        more = stored(paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("back") + span).alias("back"), "n"), "chat-paths")
        found = more.agg(F.count_if(F.col("back") < F.col("n")).alias("kept"), F.count_if(F.col("back") >= F.col("n")).alias("cut")).first()
        cut = cut or found.cut > 0
        if not found.kept:
            break
        paths = paths.unionByName(more.where(F.col("back") < F.col("n")))
        far = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("farther"))
        jump = stored(jump.join(far, ["tree", "above"]).select("tree", "node", F.col("farther").alias("above")), "chat-above")
        span *= 2
    if cut:
        rooted = paths.join(above.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "leaf")
        paths = paths.join(rooted, ["tree", "leaf"], "left_semi")
    return paths.select("tree", "leaf", "node", "back")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, branch_rank, score, conversation, loss_spans): the ``top`` branches of each tree.

    messages: (tree long, node long, parent long, role, text, score double).
    Null roles and texts are empty ones. Branches are ranked by mean score,
    null as 0, then the longer one, then the lesser leaf. All messages of a
    path meet in one row, its conversation; a very long text only makes that row
    long. Scores are summed along stretches that double, so means may differ in
    their last bits from sums taken one by one. A tree without a leaf that reaches a root gives no row, and so do rows
    with a null tree or node, which nothing can reply to. Other columns are not read.
    """
    messages = messages.where("tree is not null and node is not null")
    told = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = leaf_scores(told).select("tree", "leaf", (F.col("total") / F.col("n")).alias("score"), "n")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    chosen = stored(scored.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= top), "chat-chosen")
    # only the chosen branches are listed, so rows grow with the messages and not with all paths
    paths = branches(told, chosen.select("tree", "leaf"))
    turns = paths.join(chosen, ["tree", "leaf"]).join(told.select("tree", "node", "role", "text"), ["tree", "node"]).groupBy("tree", "leaf", "branch_rank", "score").agg(F.collect_list(F.struct("back", "role", "text")).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for i in range(batch.num_rows):
                rows = sorted(batch.column(4)[i].as_py(), key=lambda t: -t["back"])
                text, spans = formatted([(t["role"], t["text"]) for t in rows])
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(4)), pa.array([text], pa.string()), pa.array([[{"start": s, "end": e} for s, e in spans]], pa.list_(span))], names=["tree", "leaf", "branch_rank", "score", "conversation", "loss_spans"])

    return turns.mapInArrow(run, "tree long, leaf long, branch_rank int, score double, conversation string, loss_spans array<struct<start:long,end:long>>")


def from_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each row replies to the row before it, by turn, then role and text.

    Rows without conv_id are one conversation, of the tree ``NO_ID``. Repeated
    rows are turns each. Other columns are not read.
    """
    order = Window.partitionBy("tree").orderBy(F.col(turn), F.col(role), F.col(text))
    rows = conversations.select(F.coalesce(F.col(conv_id).cast("long"), F.lit(NO_ID)).alias("tree"), F.col(turn), F.col(role), F.col(text))
    return rows.select("tree", F.row_number().over(order).cast("long").alias("node"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score")).withColumn("parent", F.col("node") - 1)


def digests(formatted_trees: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the conversations; conv_id is null for ``NO_ID``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = read_back(text)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                told = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((tree, len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted_trees.select(F.nullif("tree", F.lit(NO_ID)).alias("tree"), "conversation", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
