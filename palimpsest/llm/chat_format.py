"""Chat formatting of reply trees, with DataFrame functions only.

Messages name the message that they answer. Root-to-leaf paths are enumerated from the leaves by
self-joins that double the distance covered each time (a join of the paths with the pointers to
ancestors 1, 2, 4, ... steps up, then of the pointers with themselves), so a tree of depth d takes
log2(d) rounds. The branches of a tree are ranked by their messages' mean score, and each chosen
path is formatted as one conversation.

Template: ``<s>``, then for each turn ``[ROLE]`` role ``[/ROLE]`` text ``</s>``. Control strings
inside roles and texts are escaped by a backslash after their first character, one more than
there was, and so can be told from marks and be restored exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, table

BEGIN, END, ROLE, ROLE_END = "<s>", "</s>", "[ROLE]", "[/ROLE]"
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|ROLE\]))"
_ESCAPED = r"([<\[])(\\*)\\(/?(?:s>|INST\]|ROLE\]))"
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _same(left: DataFrame, right: DataFrame, **on: str) -> Column:
    out = F.lit(True)
    for a, b in on.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the nodes on the way from each leaf, ``up`` steps above it. nodes:
    (tree, node, parent), node not null and unique in its tree. A parent that isn't there counts
    as none. Raises ValueError where replies go in a circle: no way up has as many steps as there are
    nodes."""
    there = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    linked = nodes.join(there, _same(nodes, there, tree="_t") & (nodes["parent"] == there["_n"]), "left").select("tree", "node", F.col("_n").alias("parent"))
    jumps = materialize(linked, "parents")
    parents = jumps.where("parent IS NOT NULL").select(F.col("tree").alias("_t"), F.col("parent").alias("_p")).distinct()
    found = jumps.join(parents, _same(jumps, parents, tree="_t") & (jumps["node"] == parents["_p"]), "left_anti")
    found = found.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    most, steps = jumps.count(), []
    while not (jumps := jumps.where("parent IS NOT NULL")).isEmpty():
        if 1 << len(steps) >= most:
            raise ValueError("replies go in a circle")
        step = jumps.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("parent").alias("_p"))
        steps.append(step)
        jumps = materialize(jumps.join(step, _same(jumps, step, tree="_t") & (jumps["parent"] == step["_n"])).select("tree", "node", F.col("_p").alias("parent")), "jumps")
    for k, step in enumerate(steps):
        further = found.join(step, _same(found, step, tree="_t") & (found["node"] == step["_n"])).select("tree", "leaf", F.col("_p").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = materialize(found.unionByName(further), "paths")
    return found


def format_branches(messages: DataFrame, best: int | None = None, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Conversations from messages (tree, node, parent, role, text, score).

    Returns tree, leaf, score, branch_rank, n_turns, formatted and loss_spans (array of first, last:
    code points of ``formatted`` that are trained on, which are the texts of ``loss_roles``). A
    tree's branches are ranked from 1 by mean score (nulls left out, none: lowest), ties by leaf;
    ``best`` keeps so many of them. A null
    role or text is empty, a null tree is a tree, a null node is dropped by nobody but can't be
    answered: such rows must be numbered before. Of rows with the same tree and node the first by
    (role, text) counts. Empty messages give an empty result."""
    first = Window.partitionBy("tree", "node").orderBy("role", "text", "parent", "score")
    rows = messages.select("tree", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("score").cast("double").alias("score"))
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    on = paths(rows.select("tree", "node", "parent"))
    scores = rows.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "score")
    means = on.join(scores, _same(on, scores, tree="_t", node="_n")).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    rank = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")
    ranked = means.withColumn("branch_rank", F.row_number().over(rank))
    chosen = materialize(ranked if best is None else ranked.where(F.col("branch_rank") <= best), "chosen")
    if best is not None:
        kept = chosen.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"))
        on = on.join(kept, _same(on, kept, tree="_t", leaf="_l"), "left_semi")
    said = rows.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", "text")
    turns = on.join(said, _same(on, said, tree="_t", node="_n")).select("tree", "leaf", "up", "role", escape(F.col("text")).alias("body"))
    turns = turns.withColumn("head", F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(ROLE_END)))
    turns = turns.withColumn("length", (F.length("head") + F.length("body") + len(END)).cast("long"))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    at = F.lit(len(BEGIN)) + F.coalesce(F.sum("length").over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("at", at.cast("long"))
    span = F.when(F.col("role").isin(*loss_roles), F.struct(F.col("at").alias("first"), (F.col("at") + F.length("body")).alias("last")))
    turns = turns.select("tree", "leaf", F.struct((-F.col("up")).alias("place"), F.concat("head", "body", F.lit(END)).alias("turn"), span.alias("span")).alias("x"))
    out = turns.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list("x")).alias("x"))
    formatted = F.concat(F.lit(BEGIN), F.array_join(F.transform("x", lambda x: x["turn"]), ""))
    spans = F.filter(F.transform("x", lambda x: x["span"]), lambda x: x.isNotNull())
    out = out.select(F.col("tree").alias("_t"), F.col("leaf").alias("_l"), "n_turns", formatted.alias("formatted"), spans.alias("loss_spans"))
    return chosen.join(out, _same(chosen, out, tree="_t", leaf="_l")).select("tree", "leaf", "score", "branch_rank", "n_turns", "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a conversation, as an array of (role, text)."""
    turns = F.split(formatted.substr(F.lit(len(BEGIN) + 1), F.length(formatted)), END, -1)
    shape = r"(?s)^\[ROLE\](.*?)\[/ROLE\](.*)$"
    part = lambda x, i: unescape(F.regexp_extract(x, shape, i))
    return F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda x: F.struct(part(x, 1).alias("role"), part(x, 2).alias("text")))


def trained_on(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), "")


def turns_as_tree(rows: DataFrame) -> DataFrame:
    """Messages from conversations that go by turn: each answers the turn before, and its score is
    the length of its text. Rows with the same turn are taken in the order of (role, text), null
    turns first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select(F.col("conv_id").alias("tree"), F.row_number().over(order).cast("long").alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.coalesce(F.length("text"), F.lit(0)).cast("double"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best branch of every conversation, whose turns are a tree of one branch, formatted and
    read back. A conversation's turns come together in one row, as its text does. Null, empty and
    very long texts are turns like others; an empty table gives conversation -7 alone."""
    text = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(more)
    out = format_branches(materialize(turns_as_tree(rows), "turns"), best=1)
    read = F.array_join(F.transform(read_back(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    trained = trained_on(F.col("formatted"), F.col("loss_spans"))
    return out.select(F.col("tree").alias("conv_id"), F.size(read_back(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(read, 256).alias("turns_sha256"), F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "branch_rank", F.round("score", 6).alias("score"))


OP1_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(role, '{_CONTROL}', '\1\2\\\3', 'g') AS er, regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g') AS et FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
  CAST(3 + sum(length(er) + length(et) + 17) AS BIGINT) AS formatted_chars, round(avg(length(text)), 6) AS score FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, 1 AS branch_rank, score FROM g
"""
