"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, ranked and written as conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import settle

TURN, END = "<|turn|>", "<|end|>"
#: Every "<" of a text is escaped, so a mark never appears inside one; every backslash is, so each escape is one.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("\n", "\\n"))
MAX_ROUNDS = 40

SQL = """
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), c as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(length(role) + length(role) - length(replace(replace(replace(role, '\\', ''), '<', ''), chr(10), ''))
      + length(text) + length(text) - length(replace(replace(text, '\\', ''), '<', '')) + 16) as formatted_chars
  from t group by conv_id
)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  cast(formatted_chars as bigint) as formatted_chars
from c
"""


def escape(text: Column, line: bool = False) -> Column:
    """Control strings made harmless; with ``line`` line ends too."""
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES if line else ESCAPES[:2], text)


def unescape(text: Column, line: bool = False) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES if line else ESCAPES[:2]), text)


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees ``(tree, node, parent, score)``: one row per leaf and node on its path.

    Columns ``tree, leaf, node, up`` (steps from the leaf) and ``score``. Round
    k joins the paths found so far with the links that skip 2^k nodes, and
    these links with themselves, so a chain of n turns takes log2(n) rounds.

    A parent that is null, missing or the node itself makes a root. A cycle
    stops the job. (tree, node) must be unique; null trees are one tree.
    """
    t = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    p = t.select(F.col("tree").alias("__t"), F.col("node").alias("__n"))
    linked = t.join(
        p, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("parent") == F.col("__n")) & (F.col("node") != F.col("parent")),
        "left",
    ).select("tree", "node", F.col("__n").alias("parent"), "score")
    linked = settle(linked)
    sizes = linked.groupBy("tree").agg(F.count(F.lit(1)).alias("__size"))
    sizes = sizes.withColumnRenamed("tree", "__t")
    inner = linked.where("parent is not null").select(F.col("tree").alias("__t"), F.col("parent").alias("__n")).distinct()
    leaf = linked.join(
        inner, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n")), "left_anti"
    )
    found = leaf.join(sizes, F.col("tree").eqNullSafe(F.col("__t"))).select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"), "__size"
    )
    jump = linked.where("parent is not null").select("tree", "node", "parent")
    for k in range(MAX_ROUNDS):
        link = jump.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "parent")
        on = F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n"))
        more = found.join(link, on).select(
            "tree", "leaf", F.col("parent").alias("node"),
            F.when(F.col("up") + (1 << k) < F.col("__size"), F.col("up") + (1 << k))
            .otherwise(F.raise_error(F.lit("the replies of a tree form a cycle"))).alias("up"), "__size",
        )
        found = settle(found.unionByName(more))
        far = jump.join(link.withColumnRenamed("parent", "__p"), F.col("tree").eqNullSafe(F.col("__t")) & (F.col("parent") == F.col("__n")))
        jump = settle(far.select("tree", "node", F.col("__p").alias("parent")))
        if jump.isEmpty():
            break
    else:
        raise ValueError("the replies of a tree form a cycle")
    own = linked.select(F.col("tree").alias("__t"), F.col("node").alias("__n"), "score")
    return found.join(own, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n"))).select(
        "tree", "leaf", "node", "up", "score"
    )


def conversations(nodes: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One formatted conversation per root-to-leaf path of ``(tree, node, parent, role, text, score)``.

    Columns: ``tree``, ``leaf``, ``score`` (mean over the path), ``rank`` of the
    branch in its tree (1 = best; ties by leaf), ``formatted`` and ``loss``, an
    array of (start, length) code point spans, from 1, of the learned texts.
    Null role and text count as empty; other columns are ignored.
    """
    walk = paths(nodes)
    said = nodes.select(
        F.col("tree").alias("__t"), F.col("node").alias("__n"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = walk.join(said, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("node") == F.col("__n"))).select(
        "tree", "leaf", "up", "score", (F.col("role") == learn_role).alias("learn"),
        F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
    )
    whole = turns.groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "head", "body", "learn"))).alias("turns"),
    )
    size = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.expr("array(named_struct('start', 0, 'length', 0))").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(
                x["learn"],
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")
                        )
                    ),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: F.filter(acc["spans"], lambda s: s["start"] > 0),
    )
    made = whole.select(
        "tree", "leaf", "score",
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss"),
    )
    best = made.select("tree", "leaf", "score")
    better = best.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "leaf"))).alias("order"))
    ranks = better.select("tree", F.posexplode("order").alias("pos", "b")).select(
        F.col("tree").alias("__t"), F.col("b.leaf").alias("__l"), (F.col("pos") + 1).alias("rank")
    )
    return made.join(ranks, F.col("tree").eqNullSafe(F.col("__t")) & (F.col("leaf") == F.col("__l"))).select(
        "tree", "leaf", "score", "rank", "formatted", "loss"
    )


def parsed(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p, i: i > 0)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1), True).alias("role"),
            unescape(F.substring_index(F.substr(p, F.char_length(F.substring_index(p, "\n", 1)) + 2), END, 1)).alias("text"),
        ),
    )


def learned(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def digests(rows: DataFrame) -> DataFrame:
    """The contract's columns, read back from the formatted conversations of ``(tree, formatted, loss)`` rows."""
    r = rows.select("tree", "formatted", parsed(F.col("formatted")).alias("turns"), learned(F.col("formatted"), F.col("loss")).alias("text"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("text").cast("long").alias("loss_chars"), F.sha2("text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
