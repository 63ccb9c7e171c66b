"""Chat formatting of reply trees.

Messages point to the message they reply to. Iterative self-joins (doubling the
distance each time) enumerate the root-to-leaf paths; the paths of a tree are
ranked by the mean score of their messages, and each chosen path is formatted
as one conversation:

    ### role: text</turn>

with a line feed after each turn. Within texts and roles ``\\``, ``#`` and ``<``
become ``\\0``, ``\\1`` and ``\\2``, and in roles ``:`` becomes ``\\3``; so no text holds a
control string and the output can be read back exactly. Loss spans cover the
texts of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

START, COLON, END = "### ", ": ", "</turn>\n"
_TEXT = (("\\", "\\0"), ("#", "\\1"), ("<", "\\2"))
_ROLE = (*_TEXT, (":", "\\3"))


def escape(c: Column, table=_TEXT) -> Column:
    for a, b in table:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column, table=_TEXT) -> Column:
    for a, b in reversed(table):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """(tree, path, pos, node, role, text) of the ``top`` best paths of each tree (None: all), pos counting from the root.

    ``messages``: tree, node, parent (null at a root), role, text, score. A
    parent that isn't there counts as none; of rows that repeat (tree, node)
    the first by parent, role and text stands; a null tree or node and messages
    that only loop back to themselves are left out. Null scores count as 0.
    Equal paths are ranked by their leaf.
    """
    m = messages.where("tree is not null and node is not null").select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("tree", "node", "x.*")
    m = materialise(m, "messages")
    ids = m.select("tree", "node", "score")  # texts stay behind until the paths are chosen
    up = m.where("parent is not null and parent <> node").select("tree", "node", F.col("parent").alias("to"))
    up = materialise(up.join(m.select("tree", F.col("node").alias("to")), ["tree", "to"], "left_semi"), "replies")
    leaf = m.select("tree", "node").join(up.select("tree", F.col("to").alias("node")).distinct(), ["tree", "node"], "left_anti")
    walk = leaf.select("tree", F.col("node").alias("path"), "node", F.lit(0).cast("long").alias("depth"))
    jump, reach = up, 1
    most = ids.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while reach < most and not jump.isEmpty():
        step = jump.select("tree", F.col("node").alias("n"), "to")
        # those at the far edge of what is known so far go on by ``reach``
        on = walk.join(step, (walk["tree"] == step["tree"]) & (walk["node"] == step["n"])).select(walk["tree"], "path", F.col("to").alias("node"), (F.col("depth") + reach).alias("depth"))
        walk = materialise(walk.union(on), "walk")
        nxt = step.select(F.col("tree").alias("t"), F.col("n").alias("mid"), F.col("to").alias("far"))
        jump = materialise(jump.join(nxt, (jump["tree"] == nxt["t"]) & (jump["to"] == nxt["mid"])).select("tree", "node", F.col("far").alias("to")), "jump")
        reach *= 2
    full = walk.join(ids, ["tree", "node"])
    if top is not None:
        score = full.groupBy("tree", "path").agg((F.sum("score") / F.count("*")).alias("score"))
        best = score.withColumn("place", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("score"), "path"))).where(F.col("place") <= top)
        full = full.join(materialise(best.select("tree", "path"), "best"), ["tree", "path"])
    deepest = W.partitionBy("tree", "path")
    full = full.select("tree", "path", (F.max("depth").over(deepest) - F.col("depth")).alias("pos"), "node")
    return full.join(m.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "path", "pos", "node", "role", "text")


def format_paths(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """One row per path: tree, path, formatted (string) and loss (array of struct(begin, end) of code points, ends exclusive).

    Null roles and texts count as empty. A path's turns meet in one task, as its output is one string.
    """
    role, text = escape(F.coalesce("role", F.lit("")), _ROLE), escape(F.coalesce("text", F.lit("")))
    x = turns.withColumn("_head", F.concat(F.lit(START), role, F.lit(COLON))).withColumn("_body", text)
    line = W.partitionBy("tree", "path").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    size = F.length("_head") + F.length("_body") + len(END)
    x = x.withColumn("_at", F.coalesce(F.sum(size).over(line), F.lit(0)) + F.length("_head"))
    turn = F.struct("pos", F.concat("_head", "_body", F.lit(END)).alias("turn"), (F.col("role") == assistant).alias("own"), F.col("_at").alias("begin"), (F.col("_at") + F.length("_body")).alias("end"))
    x = x.groupBy("tree", "path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: F.coalesce(t["own"], F.lit(False))), lambda t: F.struct(t["begin"], t["end"]))
    return x.select("tree", "path", F.concat_ws("", F.transform("turns", lambda t: t["turn"])).alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (array of struct(role, text)) and loss_text, both parsed and unescaped from the output string."""
    parts = F.split("formatted", END, -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(s: Column) -> Column:
        at = F.instr(s, COLON)
        return F.struct(unescape(F.substring(s, F.lit(len(START) + 1), at - len(START) - 1), _ROLE).alias("role"), unescape(F.substring(s, at + len(COLON), F.length(s))).alias("text"))

    loss = F.concat_ws("", F.transform("loss", lambda x: F.substring(F.col("formatted"), (x["begin"] + 1).cast("int"), (x["end"] - x["begin"]).cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", unescape(loss))


def threads(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before. Ties in turn go by role and text, null turns come first.

    Null conversation ids make one conversation. The tree id is the id as text, so that null has one.
    """
    tree = F.coalesce(F.col(conv_col).cast("string"), F.lit("null"))
    order = W.partitionBy("tree").orderBy(F.col(turn_col).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    x = rows.select(tree.alias("tree"), F.col(turn_col), "role", F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("node", F.row_number().over(order).cast("long"))
    return x.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))
