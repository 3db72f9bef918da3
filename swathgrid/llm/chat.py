"""Chat formatting: reply trees by iterative self-joins, branches ranked by score, one conversation per chosen path.

DataFrame and SQL functions only. Self-joins double the distance to an ancestor, so a tree of depth d needs about log2(d)
rounds for the scores of all root-to-node paths and as many to list the nodes of the chosen ones: rows, not arrays, until a
path's turns are gathered into its text.

Template: each turn is ``<s>ROLE \\nBODY</s>``; the body of a user's turn is ``[INST] TEXT [/INST]``, other bodies are the
text. Inside role and text a backslash is doubled and a backslash is put behind the first character of ``<s>``, ``</s>``,
``[INST]`` and ``[/INST]``; line ends in a role get one in front. Dropping one backslash before any character undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import again, written

_CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _is_user(role: Column) -> Column:
    return F.coalesce(role, F.lit("")) == "user"


def reply_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees, best first.

    nodes: ``tree, node, parent, role, text, score``; a parent that is null or not in its tree makes a root. Returns
    ``tree, leaf, rank, path_score, depth, node, role, text``, one row per node of each chosen path, depth from 0 at the
    root. A path's score is the sum of its nodes' (null: 0); ties go to the smallest leaf; ``top`` None keeps every path.
    A tree or node id may not be null, and (tree, node) names one row: of repeated rows the least (parent, role, text)
    counts. Nodes on a cycle of parents have no root and so no path. An empty table gives no rows.
    """
    one = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("r"))
    own = written(one.select("tree", "node", "r.*"), "nodes")
    ids = again(own).select("tree", F.col("node").alias("parent"), F.col("node").alias("p"))
    up = own.select("tree", "node", "parent", "score").join(ids, ["tree", "parent"], "left")
    # level 0: the parent; level k: the ancestor 2**k above, with the number and score of the nodes passed
    level = written(up.select("tree", "node", F.col("p").alias("up"), F.lit(1).alias("hops"), "score"), "level")
    parents = again(level).where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = written(level.join(parents, ["tree", "node"], "left_anti").select("tree", "node"), "leaves")
    levels = [level]
    bound = max(1, own.count()).bit_length() + 1  # deeper is a cycle
    while len(levels) <= bound and levels[-1].where("up is not null").limit(1).count():
        last = levels[-1]
        further = again(last).select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"), F.col("score").alias("score2"))
        joined = last.where("up is not null").join(further, ["tree", "up"])
        done = last.where("up is null")
        levels.append(written(joined.select("tree", "node", F.col("up2").alias("up"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("score") + F.col("score2")).alias("score")).union(done.select("tree", "node", "up", "hops", "score")), "level"))
    full = levels[-1].where("up is null").join(leaves, ["tree", "node"])
    order = F.struct((-F.col("score")).alias("s"), F.col("node").alias("leaf"), "hops")
    if top == 1:  # no window: a tree may hold a third of all leaves
        chosen = full.groupBy("tree").agg(F.min(order).alias("b")).select("tree", "b.leaf", F.lit(1).alias("rank"), (-F.col("b.s")).alias("path_score"), "b.hops")
    else:
        ranked = full.select("tree", F.col("node").alias("leaf"), F.expr("row_number() over (partition by tree order by score desc, node)").alias("rank"), F.col("score").alias("path_score"), "hops")
        chosen = ranked if top is None else ranked.where(F.col("rank") <= top)
    chosen = written(chosen, "chosen")
    # list each path's nodes: those known so far and, level by level from the top, what stands 2**k above them
    known = chosen.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).alias("above"))
    for k in range(len(levels) - 1, -1, -1):
        jump = again(levels[k]).where("up is not null").select("tree", "node", "up")
        known = known.union(known.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above")))
        known = written(known, "paths")
    out = known.join(chosen, ["tree", "leaf"]).join(again(own).select("tree", "node", "role", "text"), ["tree", "node"])
    return out.select("tree", "leaf", "rank", "path_score", (F.col("hops") - 1 - F.col("above")).alias("depth"), "node", "role", "text")


def chain(turns: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: each row answers the row before it (ties: by role, then text)."""
    n = F.expr(f"row_number() over (partition by {tree} order by {order}, role, text)")
    rows = turns.select(F.col(tree).alias("tree"), n.alias("node"), "role", "text")
    return rows.select("tree", F.col("node").cast("long").alias("node"), F.when(F.col("node") > 1, (F.col("node") - 1).cast("long")).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_paths(paths: DataFrame) -> DataFrame:
    """``tree, leaf, rank, path_score, formatted, loss_mask``: one conversation per path.

    loss_mask: ``array<struct<start,length>>`` in code points of formatted, over the (escaped) texts of assistant turns.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    user = _is_user(F.col("role"))
    head = F.concat(F.lit("<s>"), role, F.lit(" \n"), F.when(user, F.lit("[INST] ")).otherwise(F.lit("")))
    tail = F.when(user, F.lit(" [/INST]</s>")).otherwise(F.lit("</s>"))
    turns = paths.select("tree", "leaf", "rank", "path_score", "depth", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), tail.alias("tail"), (F.coalesce("role", F.lit("")) == "assistant").alias("loss"))
    turns = turns.withColumn("n", F.length("head") + F.length("body") + F.length("tail"))
    grouped = turns.groupBy("tree", "leaf", "rank", "path_score").agg(F.array_sort(F.collect_list(F.struct("depth", F.concat("head", "body", "tail").alias("t"), F.length("head").alias("h"), F.length("body").alias("b"), "n", "loss"))).alias("turns"))
    spans = F.expr("aggregate(turns, named_struct('at', 0, 'm', cast(array() as array<struct<start:int,length:int>>)), (a, t) -> named_struct('at', a.at + t.n, 'm', if(t.loss, concat(a.m, array(named_struct('start', a.at + t.h, 'length', t.b))), a.m)), a -> a.m)")
    return grouped.select("tree", "leaf", "rank", "path_score", F.array_join(F.transform("turns", lambda t: t["t"]), "").alias("formatted"), spans.alias("loss_mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """formatted with ``turns array<struct<role,text>>`` and ``loss_text``, both read back from the text and its mask."""
    parts = F.expr("filter(split(formatted, '</s>'), x -> x <> '')")
    cut = F.transform(parts, lambda x: F.struct(F.substring_index(F.substr(x, F.lit(4)), " \n", 1).alias("r"), F.substr(x, F.length(F.substring_index(x, " \n", 1)) + 3).alias("b")))

    def turn(p: Column) -> Column:
        role = unescape(p["r"])
        text = F.when(_is_user(role), F.substr(p["b"], F.lit(8), F.greatest(F.length(p["b"]) - 15, F.lit(0)))).otherwise(p["b"])
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    loss = F.transform("loss_mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.transform(cut, turn)).withColumn("loss_text", F.array_join(loss, ""))
