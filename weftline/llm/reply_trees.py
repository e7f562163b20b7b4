"""Chat formatting of reply trees.

Messages form trees by parent. Root-to-leaf paths come from iterative self-joins: jump tables reach 1, 2, 4, ...
messages up (each a self-join of the one before), and a leaf's path is expanded with them from the longest jump down,
so that a thread of depth d takes log2(d) joins and no row is made that is not part of a path. Branches are ranked by
their mean score (ties: smaller leaf) and the best of each tree are formatted, each as one conversation.

The template wraps each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a text a backslash is doubled and
``<|`` becomes ``<\\|``, which no reader takes for a control string; roles are URL-encoded. ``parse`` reverses both.
The loss mask is a list of spans (start, end; code points) over the texts of assistant turns, without their wrapping.

Defined results: null roles and texts are empty. A null tree id is a tree of its own. A parent that does not exist
makes its child a root. Messages on a cycle, or below one, reach no root and are left out. Messages of equal turn are
ordered by role, then text (``linear``), so repeated rows are turns of their own; equal node ids within a tree are not
allowed otherwise. Very long texts are formatted whole. No messages, no rows. Other columns are ignored. A conversation
is one row of the result, so its turns come together in one task, whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import cut

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


def linear(conversations: DataFrame) -> DataFrame:
    """Turns of plain conversations as messages, each replying to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _on(a: str, b: str) -> Column:
    return F.col(f"a.{a}").eqNullSafe(F.col(f"b.{b}"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up) for every message on a path from a leaf to its root; ``up`` is its distance from the leaf."""
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select("tree", "node").alias("b")
    # a parent that is not there makes a root
    jump = nodes.where("parent is not null").alias("a").join(known, _on("tree", "tree") & (F.col("a.parent") == F.col("b.node"))).select("a.tree", "a.node", F.col("a.parent").alias("to"))
    jump = cut(jump, "jump")
    leaves = nodes.alias("a").join(jump.alias("b"), _on("tree", "tree") & (F.col("a.node") == F.col("b.to")), "left_anti").select("tree", "node")
    jumps, total = [], nodes.count()
    while not jump.isEmpty() and 1 << len(jumps) <= total:
        jumps.append(jump)
        further = jump.alias("a").join(jump.alias("b"), _on("tree", "tree") & (F.col("a.to") == F.col("b.node"))).select("a.tree", "a.node", "b.to")
        jump = cut(further, "jump")
    if not jump.isEmpty():  # these never come to a root
        leaves = leaves.alias("a").join(jump.alias("b"), _on("tree", "tree") & (F.col("a.node") == F.col("b.node")), "left_anti")
    found = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(jumps))):
        higher = found.alias("a").join(jumps[k].alias("b"), _on("tree", "tree") & (F.col("a.node") == F.col("b.node")))
        found = cut(found.unionByName(higher.select("a.tree", "a.leaf", F.col("b.to").alias("node"), (F.col("a.up") + (1 << k)).alias("up"))), "paths")
    return found


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, n_turns, branch_score, formatted and loss (array of start, end) of the best branches of each tree."""
    on_path = paths(messages).alias("a").join(messages.alias("b"), _on("tree", "tree") & (F.col("a.node") == F.col("b.node")))
    role, text = F.coalesce("b.role", F.lit("")), F.coalesce("b.text", F.lit(""))
    rows = on_path.select("a.tree", "a.leaf", "a.up", "b.score", F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n")).alias("head"), escape(text).alias("body"), (role == ASSISTANT).alias("learned"))
    order = Window.partitionBy("tree", "leaf").orderBy(F.desc("up"))
    length = F.length("head") + F.length("body") + len(CLOSE)
    rows = rows.withColumn("start", F.sum(length).over(order) - length + F.length("head"))
    part = F.struct((-F.col("up")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), "learned", "start", (F.col("start") + F.length("body")).alias("end"))
    whole = rows.groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.sort_array(F.collect_list(part)).alias("parts"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    whole = whole.withColumn("rank", rank).where(F.col("rank") <= branches)
    loss = F.transform(F.filter("parts", lambda p: p["learned"]), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return whole.select("tree", "leaf", "branch_score", F.size("parts").cast("long").alias("n_turns"), F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), "\n", 1)
        return F.struct(F.url_decode(head).alias("role"), unescape(F.substr(piece, F.length(head) + len(OPEN) + 2)).alias("text"))

    return F.transform(turns, turn)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask, hashed."""
    said = F.array_join(F.transform(F.col("turns"), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    rows = formatted.withColumns({"turns": parse(F.col("formatted")), "learned": learned})
    return rows.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
