r"""Reply trees as conversations.

A message answers at most one other message of its tree. Every path from a root
to a leaf is a branch; branches are ranked in their tree by the sum of their
messages' scores (ties: the longer one, then the smaller leaf) and each chosen
branch is formatted as one conversation.

Paths are found by self-joins that double their reach: after k rounds each leaf
knows its nearest 2**k ancestors, so a thread of n messages takes about log2(n)
rounds, each written to the shared folder. A conversation is kept as one row per
turn, in order, and is put together or read back as a stream over sorted rows,
so that one very long thread needs no more memory than its longest turn.

A turn is ``### <role>: <text></turn>`` and a line break. In roles and texts a
backslash is doubled and a backslash goes before ``###`` and ``</turn>``; in
roles also before a colon. Reading back drops one backslash before any
character. The loss mask covers the text of each assistant turn.

Defined cases: null roles, texts and trees count as empty text, empty text and one
tree of their own; a message whose parent is null or not in its tree is a root; a
null id is a message that nothing answers; a repeated id keeps the smallest (role,
text, score); a missing score counts 0; messages that answer in a circle are an
error; very long texts are kept whole; columns that are not named are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortline.session import materialize, small_table

OPEN, CLOSE = "###", "</turn>"
LOSS_ROLE = "assistant"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escaped(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in (OPEN, CLOSE):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def branches(messages: DataFrame) -> DataFrame:
    """``tree, leaf, node, up``: each leaf with itself and all messages above it, ``up`` steps away.

    ``messages`` holds ``tree``, ``node`` and ``parent``, as text and without nulls
    in the first two.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jump = materialize(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")), "jump")
    # a message that answers itself has a parent, so a circle of one is kept and found below
    paths = nodes.join(jump.select("tree", F.col("above").alias("node")), ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    paths, step, limit = materialize(paths, "paths"), 1, max(1, messages.count())
    while not jump.isEmpty():
        if step > limit:
            raise ValueError("messages answer in a circle")
        more = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), F.col("up") + step)
        paths = materialize(paths.union(more), "paths")
        upper = jump.select("tree", F.col("node").alias("above"), F.col("above").alias("top"))
        jump = materialize(jump.join(upper, ["tree", "above"]).select("tree", "node", F.col("top").alias("above")), "jump")
        step *= 2
    return paths


def conversation_turns(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str,
                       score: str | None = None, best: int | None = None) -> DataFrame:
    """One row per turn: ``tree, leaf, branch, position, formatted, loss_start, loss_chars``.

    ``branch`` ranks the branches of a tree from 1; with ``best``, only so many of
    each tree are formatted. ``loss_start`` counts code points from the turn's
    start; without loss it is null and ``loss_chars`` is 0.
    """
    value = F.col(f"`{score}`").cast("double") if score else F.lit(0.0)
    rows = messages.select(
        F.col(f"`{tree}`").alias("tree_value"), F.coalesce(F.col(f"`{tree}`").cast("string"), F.lit("\0")).alias("tree"),
        F.coalesce(F.col(f"`{node}`").cast("string"),
                   F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))).alias("node"),
        F.col(f"`{parent}`").cast("string").alias("parent"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce(value, F.lit(0.0)).alias("score"))
    rows = rows.groupBy("tree_value", "tree", "node").agg(
        F.min(F.struct("role", "text", "score", "parent")).alias("m")).select("tree_value", "tree", "node", "m.*")
    rows = materialize(rows, "messages")
    paths = branches(rows)
    if score or best:
        sums = paths.join(rows.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(
            F.sum("score").alias("total"), F.max("up").alias("depth"))
    else:
        sums = paths.groupBy("tree", "leaf").agg(F.lit(0.0).alias("total"), F.max("up").alias("depth"))
    order = Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("depth"), "leaf")
    ranked = sums.withColumn("branch", F.row_number().over(order).cast("long"))
    if best is not None:
        ranked = ranked.filter(F.col("branch") <= best)
    turns = paths.join(ranked.select("tree", "leaf", "branch", "depth"), ["tree", "leaf"]).join(rows, ["tree", "node"])
    head = F.concat(F.lit(OPEN + " "), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")), F.lit(": "))
    body = escaped(F.col("text"))
    mine = F.col("role") == LOSS_ROLE
    return turns.select(
        F.col("tree_value").alias("tree"), "leaf", "branch", (F.col("depth") - F.col("up")).alias("position"),
        F.concat(head, body, F.lit(CLOSE + "\n")).alias("formatted"),
        F.when(mine, F.length(head)).cast("long").alias("loss_start"),
        F.when(mine, F.length(body)).otherwise(0).cast("long").alias("loss_chars"))


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order, a conversation never spread over two tasks."""
    return turns.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "position")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``tree, branch, formatted, loss_spans`` (start and end, in code points)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, spans, at = None, [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"tree": key[0], "branch": key[1], "formatted": "".join(parts),
                                                "loss_spans": spans}], schema)

        schema = pa.schema([("tree", pa.int64()), ("branch", pa.int64()), ("formatted", pa.string()),
                            ("loss_spans", pa.list_(pa.list_(pa.int64())))])
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["tree"], r["branch"]):
                    if key:
                        yield row()
                    key, parts, spans, at = (r["tree"], r["branch"]), [], [], 0
                if r["loss_start"] is not None:
                    spans.append([at + r["loss_start"], at + r["loss_start"] + r["loss_chars"]])
                parts.append(r["formatted"])
                at += len(r["formatted"])
        if key:
            yield row()

    return in_order(turns).withColumn("tree", F.col("tree").cast("long")).mapInArrow(
        run, "tree long, branch long, formatted string, loss_spans array<array<long>>")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation as parsed from its formatted turns.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done = None, []

        def row():
            return {"conv_id": key[0], "n_turns": n, "turns_sha256": turn_hash.hexdigest(), "loss_chars": loss,
                    "loss_sha256": loss_hash.hexdigest(), "formatted_chars": chars}

        for batch in batches:
            for tree, branch, piece, start, length in zip(
                    *(batch.column(c).to_pylist() for c in ("tree", "branch", "formatted", "loss_start", "loss_chars"))):
                if key != (tree, branch):
                    if key:
                        done.append(row())
                    key, n, chars, loss = (tree, branch), 0, 0, 0
                    turn_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                for role, text in _TURN.findall(piece):
                    n += 1
                    turn_hash.update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                chars += len(piece)
                if start is not None:
                    masked = unescaped(piece[start:start + length])
                    loss += len(masked)
                    loss_hash.update(masked.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if key:
            yield pa.RecordBatch.from_pylist([row()], schema)

    return in_order(turns).select(F.col("tree").cast("long").alias("tree"), "branch", "formatted", "loss_start",
                                  "loss_chars").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def threads(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply chains: each row answers the one before it (ties by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = conversations.select("conv_id", "role", "text", F.row_number().over(order).alias("node"))
    return at.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def with_control_texts(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts look like the template."""
    said = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(
        small_table(conversations.sparkSession, rows, "conv_id long, turn long, role string, text string"))


SQL = r"""
WITH c AS (
    SELECT conv_id, turn, role AS raw_role, text AS raw, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL
          SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body,
      replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS head FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw NULLS FIRST)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw NULLS FIRST)) AS loss_sha256,
       sum(length('### ' || head || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
