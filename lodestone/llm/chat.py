"""Chat formatting (4): root-to-leaf paths of reply trees, ranked by score, one conversation each.

Messages are nodes (conv_id, node, parent). Self-joins double a table's reach: from each node's way of 1, 2, 4, ...
steps up, with the sum of the scores on it, comes the way of twice the length, so a tree of depth d takes log2(d)
joins. Once every way has reached its root, leaves are ranked by their sums, and only the chosen leaves' paths are
read off the same tables. Only ids and scores travel in the iterations; texts are joined to the chosen paths at the
end. All of it is DataFrame code.

Template: `<turn>` role newline text `</turn>` newline. Within role and text a backslash is doubled and the two
marks lose their first character to `\\l`; a newline within a role is `\\n`. Reading back undoes that exactly.

Defined cases: null role or text is empty; a parent that is null or absent makes a root; nodes of a cycle have
no root and no path, so they are not formatted; a null conv_id is a conversation of its own; rows with a null node
id are not formatted; of rows that repeat a node id, the one with the smallest parent (none first), role, text and
score counts (`linear` numbers its rows, so none repeats there); an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

OPEN, CLOSE = "<turn>", "</turn>"


def escape(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    c = F.replace(F.replace(c, F.lit(OPEN), F.lit("\\l" + OPEN[1:])), F.lit(CLOSE), F.lit("\\l" + CLOSE[1:]))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescape(c: Column) -> Column:
    """Doubled backslashes split the string into parts in which `\\l` and `\\n` are the only escapes left."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(plain, "\\")


def linear(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees that are one chain: each row answers the one before (ties: by role, then text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long")).select(
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tables (conv_id, node, above, steps, score): per node the ancestor 1, 2, 4, ... steps up, null where the way has
    ended at a root before; the number of nodes on the way, without the ancestor, and their scores' sum. A table holds
    the nodes whose ways had not ended in the one before it."""
    known = nodes.select("conv_id", F.col("node").alias("known"), F.lit(True).alias("there")).alias("k")
    own = nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")).alias("n")
    ways = [materialize(own.join(known, F.expr("n.conv_id <=> k.conv_id and n.parent = k.known"), "left").select(
        "n.conv_id", "n.node", F.when(F.col("there"), F.col("parent")).alias("above"), F.lit(1).cast("long").alias("steps"), "n.score"), "ways")]
    most = None
    while True:
        going = ways[-1].where("above is not null")
        if going.isEmpty():
            return ways
        most = nodes.count() if most is None else most
        if 1 << (len(ways) - 1) > most:  # only cycles are left, which have no root
            return ways
        w, o = going.alias("w"), going.unionByName(ended(ways)).alias("o")
        ways.append(materialize(w.join(o, F.expr("w.conv_id <=> o.conv_id and w.above = o.node")).select(
            "w.conv_id", "w.node", "o.above", *[F.expr(f"w.{c} + o.{c}").alias(c) for c in ("steps", "score")]), "ways"))


def ended(ways: list[DataFrame]) -> DataFrame:
    """Nodes whose ways have reached their roots, with the steps and scores of the whole way."""
    return reduce(DataFrame.unionByName, [way.where("above is null") for way in ways])


def chosen_leaves(ways: list[DataFrame], top: int) -> DataFrame:
    """conv_id, leaf, depth (nodes on its path), score, branch: the `top` leaves of each conversation by score."""
    answered = ways[0].where("above is not null").select("conv_id", "above").distinct().alias("a")
    leaves = ended(ways).alias("w").join(answered, F.expr("w.conv_id <=> a.conv_id and w.node = a.above"), "left_anti")
    ranks = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    return leaves.select("conv_id", F.col("node").alias("leaf"), F.col("steps").alias("depth"), "score").withColumn("branch", F.row_number().over(ranks)).where(F.col("branch") <= top)


def paths(ways: list[DataFrame], chosen: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): the nodes on the way from each chosen leaf to its root, `up` steps above the leaf."""
    way = chosen.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for i, table in enumerate(ways[:-1]):
        w, t = way.alias("w"), table.where("above is not null").alias("t")
        more = w.join(t, F.expr("w.conv_id <=> t.conv_id and w.node = t.node")).select("w.conv_id", "w.leaf", F.col("t.above").alias("node"), (F.col("w.up") + (1 << i)).alias("up"))
        way = materialize(way.unionByName(more), "path")
    return way


def _one_each(nodes: DataFrame) -> DataFrame:
    return nodes.where("node is not null").groupBy("conv_id", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("x")).select("conv_id", "node", "x.*")


def format_trees(nodes: DataFrame, top: int = 1, unique: bool = False) -> DataFrame:
    """conv_id, leaf, branch, score, formatted, loss_spans of the `top` best-scored paths of each conversation.

    A path's score is the sum of its nodes' scores; ties go to the smaller leaf. loss_spans are (start, end) of
    the assistant texts in `formatted`, counted in code points. unique: no node id repeats, as in `linear`.
    """
    nodes = nodes if unique else materialize(_one_each(nodes), "nodes")
    ways = climb(nodes)
    chosen = materialize(chosen_leaves(ways, top), "leaves")
    way = paths(ways, chosen)
    chosen = chosen.alias("c")
    turns = (
        way.alias("w").join(chosen, F.expr("w.conv_id <=> c.conv_id and w.leaf = c.leaf"))
        .select("w.conv_id", "w.leaf", "w.node", "c.branch", "c.score", (F.col("c.depth") - F.col("w.up")).alias("pos")).alias("t")
        .join(nodes.select("conv_id", "node", "role", "text").alias("n"), F.expr("t.conv_id <=> n.conv_id and t.node = n.node"))
        .select("t.conv_id", "t.leaf", "t.branch", "t.score", "t.pos", "n.role",
                F.concat(F.lit(OPEN), escape(F.coalesce("n.role", F.lit("")), role=True), F.lit("\n")).alias("head"),
                escape(F.coalesce("n.text", F.lit(""))).alias("body"))
    )
    along = Window.partitionBy("conv_id", "leaf").orderBy("pos")
    size = F.length("head") + F.length("body") + len(CLOSE) + 1
    start = F.coalesce(F.sum(size).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    spans = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), (start + F.length("body")).alias("end")))
    piece = F.struct("pos", F.concat("head", "body", F.lit(CLOSE + "\n")).alias("s"), F.col("span"))
    whole = turns.withColumn("span", spans).groupBy("conv_id", "leaf", "branch", "score").agg(F.sort_array(F.collect_list(piece)).alias("x"))
    return whole.select(
        "conv_id", "leaf", "branch", "score", F.concat_ws("", F.transform("x", lambda p: p["s"])).alias("formatted"),
        F.filter(F.transform("x", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from nothing but the formatted string and its spans."""
    marked = F.split("formatted", CLOSE + "\n", -1)
    turns = F.transform(F.slice(marked, 1, F.size(marked) - 1), lambda t: F.struct(
        unescape(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(t, F.lit(len(OPEN) + 2) + F.length(F.substring_index(F.substr(t, F.lit(len(OPEN) + 1)), "\n", 1)))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.concat_ws("", loss))


def digest(formatted: DataFrame) -> DataFrame:
    text = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
e as (select *, length(replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'))
   + length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n')) + 15 as chars from c),
g as (select conv_id, count(*) as n_turns, sum(chars)::bigint as formatted_chars,
   string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first) as turns,
   coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, r0 nulls first, t0 nulls first), '') as loss from e group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g"""
