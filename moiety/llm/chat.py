r"""Chat formatting of reply trees, with DataFrame operations only.

Paths from each leaf up to its root come from iterative self-joins that double their reach each
time (a path of n nodes takes about log2 n joins); only node keys travel there. Paths of a tree
are ranked by the sum of their nodes' scores, and each chosen path becomes one conversation.

Template: a turn is ``<|role|>`` newline, text, ``<|end|>`` newline. Control strings are ``<|``,
``<s>``, ``</s>``, ``<<SYS>>``, ``<</SYS>>``, ``[INST]`` and ``[/INST]``; in a text one more backslash is put after
their first bracket, also where some are there already, so that taking one away gives the text
back. A role is escaped likewise, and ``|>`` in it too. The loss mask is a list of spans (start,
length, in code points of the output): the texts of the trained role, without marks.

Defined results: a null text or role is empty; a null score is 0; a node whose parent is not in
its tree is a root; rows that repeat a node are taken once per copy in every path through it; a
cycle raises ValueError; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moiety.llm.cluster import cut

END = "<|end|>\n"
TRAINED = "assistant"
_NULL = -(2**63)
_RULES = ((r"<(\\*)(\||/?s>)", r"<\\$1$2"), (r"<(\\*)(</?SYS>>)", r"<\\$1$2"), (r"\[(\\*)(/?INST\])", r"[\\$1$2"))
_BACK = ((r"<\\(\\*)(\||/?s>)", r"<$1$2"), (r"<\\(\\*)(</?SYS>>)", r"<$1$2"), (r"\[\\(\\*)(/?INST\])", r"[$1$2"))


def escape(text: Column) -> Column:
    for pattern, to in _RULES:
        text = F.regexp_replace(text, pattern, to)
    return text


def unescape(text: Column) -> Column:
    for pattern, to in reversed(_BACK):
        text = F.regexp_replace(text, pattern, to)
    return text


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"\|(\\*)>", r"|\\$1>")


def unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"\|\\(\\*)>", r"|$1>"))


def paths(nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """``nodes`` (tree, node, parent) to (tree, leaf, node, depth): depth 0 is the leaf.

    A chain still going on after as many doublings as the largest tree has nodes (or ``rounds``) holds a cycle.
    """
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    up = nodes.select("tree", "node", "parent").distinct().join(known, ["tree", "parent"])
    jumps = [cut(up.select("tree", "node", F.col("parent").alias("up")))]
    most = known.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    # one row a node in each round, as long as it has one parent: nothing multiplies here
    while not jumps[-1].isEmpty():
        if len(jumps) > rounds or 1 << (len(jumps) - 1) > most:
            raise ValueError("a reply chain never ends: the parents hold a cycle")
        jump = jumps[-1]
        jumps.append(cut(jump.join(jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2")), ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")).distinct()))
    leaves = nodes.select("tree", "node").distinct().join(jumps[0].select("tree", F.col("up").alias("node")).distinct(), ["tree", "node"], "left_anti")
    member = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("depth"))
    for k, jump in enumerate(jumps[:-1]):
        further = member.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth"))
        member = cut(member.unionByName(further))
    return member


def format_trees(nodes: DataFrame, keep: int | None = None, trained: str = TRAINED) -> DataFrame:
    """Conversations of ``nodes`` (tree, node, parent long; role, text string; score double).

    One row per chosen path: tree, leaf, rank (1 is the best sum of scores, ties to the smaller
    leaf), formatted, loss_spans. ``keep`` limits the paths of a tree; None keeps all.
    """
    nodes = nodes.withColumn("tree", F.coalesce(F.col("tree"), F.lit(_NULL)))
    member = paths(nodes)
    light = nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
    total = member.join(light, ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = total.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if keep is not None:
        rank = rank.filter(F.col("rank") <= keep)
    rank = rank.select("tree", "leaf", "rank")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = nodes.select("tree", "node", F.concat(F.lit("<|"), escape_role(role), F.lit("|>\n")).alias("head"), escape(text).alias("body"), (role == trained).alias("loss"))
    rows = member.join(rank, ["tree", "leaf"]).join(turn, ["tree", "node"])
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("depth"), "head", "body")
    size = (F.length("head") + F.length("body") + len(END)).cast("long")
    rows = rows.select("tree", "leaf", "rank", F.row_number().over(w).alias("at"), F.concat("head", "body", F.lit(END)).alias("piece"), (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - size + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"), "loss")
    one = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("at", "piece", "start", "length", "loss"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return one.select(F.when(F.col("tree") != _NULL, F.col("tree")).alias("tree"), "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, parsed from ``formatted`` and ``loss_spans`` alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: x != "")

    def parse(x: Column) -> Column:
        at = F.instr(x, "|>\n")
        return F.struct(unescape_role(F.substring(x, F.lit(3), at - 3)).alias("role"), unescape(F.substring(x, at + 3, F.length(x))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(parts, parse)).withColumn("loss_text", F.array_join(loss, ""))


def from_rows(conversations: DataFrame) -> DataFrame:
    """A conversation's rows, by turn (ties by role, then text), as a tree that is one chain.

    Rows are numbered within their conversation, which becomes one row of the output in any case.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", F.col("role"), F.col("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select(F.col("conv_id").cast("long").alias("tree"), "node", (F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, counts and digests of what the output says."""
    back = read_back(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
