"""Operator 2, chat formatting of reply trees.

Replies (thread, node, parent, role, text, score) form trees. Self-joins that double their reach find every
node's way up: its ancestor 2, 4, 8, ... steps above, and the score of the path to its root. The leaves of a thread are
ranked by that score, and the same jumps taken from the longest to the shortest list the nodes of each chosen path,
which is written as one conversation with the character spans of assistant texts (the loss mask).

Template: `<|im_start|>role\\ntext<|im_end|>\\n` a turn. Control strings inside texts and roles are broken up
reversibly: a backslash is doubled, and `\\:` goes after the first character of a control string.

Only DataFrame functions run here. Null texts and roles count as empty. A parent that a thread lacks
makes a node a root. Nodes on or below a cycle have no root and make no path. Repeated (thread, node) rows stay in their path,
ordered by role and text. Ranks break ties by the smaller leaf. A null thread is a thread of its own. Texts of any
length are formatted whole. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Control strings of common chat formats.
CONTROL = r"([<\[])(/?s>|/?INST\]|</?SYS>>|/?SYS>>|\|[A-Za-z0-9_]+\|>|(?:start|end)_of_turn>)"
START, END, LINE = "<|im_start|>", "<|im_end|>", "<|im_line|>"


def escape(col: Column) -> Column:
    return F.regexp_replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\:$2")


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"\\(?:(\\)|:)", "$1")


def _role(col: Column) -> Column:
    return F.replace(escape(col), F.lit("\n"), F.lit(LINE))


def chosen_paths(replies: DataFrame, keep: int = 1) -> DataFrame:
    """(thread, leaf, rank, up, node): nodes of the `keep` best paths of each thread, up steps above the leaf."""
    nodes = replies.groupBy("thread", "node").agg(F.min("parent").alias("parent"), F.sum("score").alias("score"))
    has = nodes.select("thread", F.col("node").alias("parent"), F.lit(True).alias("there"))
    start = nodes.join(has, ["thread", "parent"], "left").select("thread", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum"))
    state = save(start, "op2-jump")
    jumps, most = [], state.count()
    while not state.where("up is not null").isEmpty() and 1 << len(jumps) <= most:
        jumps.append(state.where("up is not null").select("thread", "node", "up"))
        above = state.select("thread", F.col("node").alias("up"), F.col("up").alias("next"), F.col("sum").alias("more"))
        state = save(state.join(above, ["thread", "up"], "left").select("thread", "node", F.col("next").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0.0))).alias("sum")), "op2-jump")
    parents = nodes.select("thread", F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = state.where("up is null").join(parents, ["thread", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("thread").orderBy(F.desc("sum"), "node"))
    path = leaves.withColumn("rank", rank).where(F.col("rank") <= keep).select("thread", F.col("node").alias("leaf"), "rank", F.lit(0).alias("up"), "node")
    for k in reversed(range(len(jumps))):
        further = path.join(jumps[k].withColumnRenamed("up", "to"), ["thread", "node"]).select("thread", "leaf", "rank", (F.col("up") + (1 << k)).alias("up"), F.col("to").alias("node"))
        path = save(path.union(further), "op2-path")
    return path


def format_chats(replies: DataFrame, keep: int = 1) -> DataFrame:
    """(thread, leaf, rank, chat, mask): mask holds the (start, end) code points of assistant texts in chat."""
    replies = replies.withColumn("thread", F.coalesce("thread", F.lit("")))
    path = chosen_paths(replies, keep)
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turn = path.join(replies.select("thread", "node", role.alias("role"), escape(text).alias("body")), ["thread", "node"])
    turn = turn.withColumn("head", F.concat(F.lit(START), _role(F.col("role")), F.lit("\n"))).withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    order = [F.desc("up"), "role", "body"]
    place = Window.partitionBy("thread", "leaf", "rank").orderBy(*order)
    turn = turn.withColumn("k", F.row_number().over(place)).withColumn("ends", F.sum(F.length("piece")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("ends") - F.length("piece") + F.length("head")
    turn = turn.select("thread", "leaf", "rank", F.struct("k", "piece", F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span")).alias("t"))
    done = turn.groupBy("thread", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return done.select("thread", "leaf", "rank", F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("chat"), F.filter(F.transform("t", lambda t: t["span"]), lambda s: s.isNotNull()).alias("mask"))


def read_turns(chat: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.slice(F.split(chat, r"<\|im_start\|>"), 2, 1_000_000_000)

    def parsed(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        text = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - 1 - F.lit(len(END) + 1))
        return F.struct(unescape(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, parsed)


def read_masked(chat: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, one after the other."""
    return F.array_join(F.transform(mask, lambda s: unescape(chat.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def conversation_replies(conversations: DataFrame) -> DataFrame:
    """Rows by turn as reply trees without branches: each turn answers the one before it (ties by role and text)."""
    thread = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    w = Window.partitionBy("thread").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("thread", thread).withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("thread", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"))
