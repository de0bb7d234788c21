"""Reply trees to training conversations.

Messages point to the message they answer. Jump tables (the ancestor 1, 2, 4, ...
steps up, and the scores on the way) come from joining the table with itself, so a
tree of depth d takes log2(d) rounds, after which every message knows the length and
score of its path. Branches are ranked by the mean score of their messages, then by
leaf; only the chosen leaves are spread over their paths by the same jumps, and each
path becomes one formatted conversation. Rows grow with the messages times log2(d)
and with the chosen paths, whatever the number of leaves.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. In texts, ``<|`` and
every ``<`` that stands before backslashes and a bar gets one backslash more, so
no text can hold a control string and taking one away gives the text back. Roles
are URL-encoded. The loss mask lists the spans (code points, end exclusive) of the
formatted string that hold texts of the learning role.

Null text, role or score count as empty, empty and 0. A message whose parent is
null or not in its tree is a root. Repeated (tree, node) rows count once, with their
smallest parent, largest score and smallest (role, text). Branches of equal score go
by leaf. Messages that lead into a cycle reach no root and make no path. Texts of any
length are taken whole. An empty table gives none. Other columns, whatever their
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formbook.llm.graph import stored

# The control strings of the template.
START = "<|im_start|>"
END = "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _climb(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, total, n) of all messages that reach a root, and the jump tables.

    ``total`` and ``n`` are the score and the number of the messages from the node to its
    root. Jump table k has (tree, node, up_node): the ancestor 2^k steps up, if any.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0))
    nodes = messages.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max(score).alias("total"))
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    state = stored(
        nodes.join(known, ["tree", "parent"], "left").select(
            "tree", "node", F.when(F.col("_known"), F.col("parent")).alias("up_node"), "total", F.lit(1).cast("long").alias("n")
        ),
        "chat-nodes",
    )
    largest = state.groupBy("tree").count().agg(F.max("count").alias("n")).first()["n"] or 0
    arrived, jumps = state.where("up_node IS NULL"), []
    # After k rounds a message has met 2^k others; no path is longer than its tree.
    for _ in range(largest.bit_length()):
        moving = state.where("up_node IS NOT NULL")
        if moving.isEmpty():
            break
        jumps.append(moving.select("tree", "node", "up_node"))
        above = arrived.unionByName(moving).select(
            "tree", F.col("node").alias("up_node"), F.col("up_node").alias("_up"), F.col("total").alias("_total"), F.col("n").alias("_n")
        )
        state = stored(
            moving.join(above, ["tree", "up_node"]).select(
                "tree", "node", F.col("_up").alias("up_node"), (F.col("total") + F.col("_total")).alias("total"), (F.col("n") + F.col("_n")).alias("n")
            ),
            "chat-jumps",
        )
        arrived = arrived.unionByName(state.where("up_node IS NULL"))
    return arrived.drop("up_node"), jumps


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, up, score, branch): the messages on the way from the best
    ``branches`` leaves of each tree to its root, ``up`` steps away; ``branch`` from 1.

    ``messages``: tree, node, parent, score; ``tree`` and ``node`` aren't null.
    """
    climbed, jumps = _climb(messages)
    answered = jumps[0].select("tree", F.col("up_node").alias("node")).distinct() if jumps else None
    leaves = climbed.join(answered, ["tree", "node"], "left_anti") if jumps else climbed
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))
    chosen = (
        leaves.select("tree", F.col("node").alias("leaf"), F.try_divide("total", "n").alias("score"))
        .withColumn("branch", place)
        .where(F.col("branch") <= branches)
    )
    way = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"), "score", "branch")
    for k, jump in enumerate(jumps):
        step = way.join(jump, ["tree", "node"]).select(
            "tree", "leaf", F.col("up_node").alias("node"), (F.col("up") + (1 << k)).alias("up"), "score", "branch"
        )
        way = stored(way.unionByName(step), "chat-ways")
    return way


def format_turns(turns: Column, learn: str = "assistant") -> tuple[Column, Column]:
    """The formatted string and the loss spans of an array of (role, text) structs."""
    parts = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(START), F.url_encode(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == learn).alias("learn"),
        ),
    )
    formatted = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "")
    tail = len(END) + 1
    nothing = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"),
    )

    def add(state: Column, p: Column) -> Column:
        start = state["at"] + F.length(p["head"])
        stop = start + F.length(p["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(
            (stop + tail).alias("at"),
            F.when(p["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return formatted, F.aggregate(parts, nothing, add, lambda s: s["spans"])


def conversations(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """(tree, leaf, branch, score, formatted, loss_spans), one row per chosen path.

    ``messages``: tree, node, parent, role, text, score. Only the path of one
    conversation meets in one row.
    """
    said = messages.select(
        "tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    said = said.groupBy("tree", "node").agg(F.min(F.struct("role", "text")).alias("said"))
    turns = (
        chosen_paths(messages, branches)
        .join(said, ["tree", "node"])
        .groupBy("tree", "leaf", "branch", "score")
        .agg(F.collect_list(F.struct((-F.col("up")).alias("at"), "said")).alias("turns"))
    )
    ordered = F.transform(F.array_sort("turns"), lambda t: t["said"])
    formatted, spans = format_turns(F.col("turns"), learn)
    return turns.withColumn("turns", ordered).select(
        "tree", "leaf", "branch", "score", formatted.alias("formatted"), spans.alias("loss_spans")
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) structs that a formatted string holds."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        head = F.substring(piece, len(START) + 1, cut - len(START) - 1)
        return F.struct(
            F.url_decode(head).alias("role"),
            unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_learned(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescape(
                F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )


def linear_messages(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations as reply trees in which each turn answers the one before.

    Turns of a conversation are ordered by turn (null last), role and text; a null
    conversation is one of its own. Adds ``tree``, a text that is never null.
    """
    tree = F.coalesce(F.concat(F.lit("c"), F.col(conv_id).cast("string")), F.lit(""))
    order = [F.col(turn).asc_nulls_last(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first()]
    node = F.row_number().over(Window.partitionBy("tree").orderBy(*order)).cast("long")
    return turns.withColumn("tree", tree).select(
        "tree",
        F.col(conv_id).alias("conv_id"),
        node.alias("node"),
        F.nullif(node - 1, F.lit(0)).alias("parent"),
        F.col(role).alias("role"),
        F.col(text).alias("text"),
        F.lit(0.0).alias("score"),
    )
