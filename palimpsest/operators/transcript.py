"""Transcripts for the model, and what its facts have to satisfy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.tokens import Counter, characters

CONTEXT = 10


def entry(target: Column) -> Column:
    """A message's JSON in a transcript; only targets carry their id. sent_at has seven digits
    below the second and the offset of UTC."""
    sent = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0+00:00"))
    return F.to_json(F.struct(F.when(target, F.col("id")).alias("id"), F.col("peer").alias("speaker"), F.when(target, "target").otherwise("context").alias("role"), sent.alias("sent_at"), F.col("content")))


def head(target_peer: Column, instructions: Column) -> Column:
    """A transcript without messages, up to their list: message_instructions only where there are some."""
    named = F.to_json(F.struct(target_peer.alias("target_peer"), F.when(F.size(instructions) > 0, instructions).alias("message_instructions")))
    return F.concat(F.substring(named, 1, F.length(named) - 1), F.lit(',"messages":['))


def assembled(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batches of leased items (unit, id, workspace, session, message_id): (unit, workspace,
    session, message_ids by item id) of whole ones, and (unit, problem) of malformed ones, whose
    items lack a workspace, a session or a message, differ in them, or repeat a message."""
    lists = items.groupBy("unit").agg(
        F.min("workspace").alias("workspace"), F.min("session").alias("session"), F.count(F.lit(1)).alias("n"), F.count_distinct("message_id").alias("messages"),
        F.bool_or(F.col("workspace").isNull()).alias("no_workspace"), F.bool_or(F.col("session").isNull()).alias("no_session"), F.bool_or(F.col("message_id").isNull()).alias("no_message"),
        ((F.min("workspace") != F.max("workspace")) | (F.min("session") != F.max("session"))).alias("mixed"), F.array_sort(F.collect_list(F.struct("id", "message_id"))).alias("x"),
    )
    problem = F.when(F.col("no_workspace"), "no workspace").when(F.col("no_session"), "no session").when(F.col("mixed"), "another workspace or session").when(F.col("no_message"), "no message").when(F.col("messages") < F.col("n"), "repeated message")
    told = lists.withColumn("problem", problem)
    whole = told.where("problem IS NULL").select("unit", "workspace", "session", F.transform("x", lambda x: x["message_id"]).alias("message_ids"))
    return whole, told.where("problem IS NOT NULL").select("unit", "problem")


def context_window(messages: DataFrame, targets: DataFrame, budget: int | Column, context: int = CONTEXT, sizes: DataFrame | None = None, cost: Column | None = None) -> DataFrame:
    """The messages of each session's transcript. targets: (session, seq) of a batch. All targets
    are in; context are the messages among the last (messages of the batch + ``context``) seq values
    up to the last target, newest first, as long as the budget of tokens that the targets leave
    isn't passed: filling stops at the first that doesn't fit. A batch has as many messages as
    ``sizes`` (session, n) says, as not all of them need be targets, else as it has targets.
    ``cost`` is a message's price, its token_count if not given; it may ask for ``target``."""
    marks = targets.select("session", "seq").distinct().withColumn("target", F.lit(True))
    ends = marks.groupBy("session").agg(F.max("seq").alias("last"), F.count(F.lit(1)).alias("n"))
    if sizes is not None:
        ends = ends.drop("n").join(sizes.select("session", "n"), "session")
    near = messages.join(ends, "session").where((F.col("seq") <= F.col("last")) & (F.col("seq") > F.col("last") - F.col("n") - context))
    far = messages.join(marks, ["session", "seq"], "left_semi").join(ends, "session").where(F.col("seq") <= F.col("last") - F.col("n") - context)
    rows = near.unionByName(far).join(marks, ["session", "seq"], "left").withColumn("target", F.coalesce("target", F.lit(False)))
    rows = rows.withColumn("_cost", F.col("token_count") if cost is None else cost)
    session = Window.partitionBy("session")
    spent = F.sum(F.when(F.col("target"), F.col("_cost")).otherwise(0)).over(session)
    newest = session.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.when(F.col("target"), 0).otherwise(F.col("_cost"))).over(newest)
    return rows.withColumn("used", spent + running).where(F.col("target") | (F.col("used") <= budget)).drop("last", "n", "_cost")


def transcripts(messages: DataFrame, batches: DataFrame, budget: int, context: int = CONTEXT, counter: Counter = characters) -> DataFrame:
    """(unit, transcript): what the model gets for each batch (unit, target_peer, session, targets,
    n, system, instructions): targets are ids of its messages, n how many it has, system the system
    prompt's text. Messages: (session, seq, id, peer, content, created_at). The budget is for the
    system prompt, the transcript without messages, and each message's JSON. A batch's rows are
    bounded by its targets and the context."""
    named = F.coalesce("instructions", F.array().cast("array<string>"))
    batches = batches.withColumn("_head", head(F.col("target_peer"), named))
    batches = batches.withColumn("_room", (F.lit(budget) - counter(F.col("system")) - counter(F.concat("_head", F.lit("]}")))).cast("bigint"))
    # a session may have several batches, so the unit stands for the session
    mine = messages.join(batches.select("unit", "session", "_room"), "session").drop("session").withColumnRenamed("unit", "session")
    asked = batches.select(F.col("unit").alias("session"), F.explode("targets").alias("id"))
    marks = mine.join(asked, ["session", "id"], "left_semi")
    rows = context_window(mine, marks, F.col("_room"), context, batches.select(F.col("unit").alias("session"), "n"), counter(entry(F.col("target"))))
    lists = rows.groupBy(F.col("session").alias("unit")).agg(F.array_sort(F.collect_list(F.struct("seq", entry(F.col("target")).alias("entry")))).alias("x"))
    body = F.array_join(F.transform(F.col("x"), lambda x: x["entry"]), ",")
    return batches.join(lists, "unit", "left").select("unit", F.concat("_head", F.coalesce(body, F.lit("")), F.lit("]}")).alias("transcript"))


def instructions(rows: DataFrame) -> DataFrame:
    """The distinct instructions of each session that aren't blank, sorted."""
    return rows.where(F.col("instruction").rlike(r"\S")).groupBy("session").agg(F.array_sort(F.collect_set("instruction")).alias("instructions"))


def target_messages(items: DataFrame) -> DataFrame:
    """Items to derive from: not blank, and reasoning enabled by the item, else the session, else yes."""
    return items.where(F.coalesce("item_reasoning", "session_reasoning", F.lit(True)) & F.coalesce(F.col("content").rlike(r"(?U)\S"), F.lit(False)))


def valid_facts(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facts (fact_id, unit, content, source_ids) with content and sources that are all targets
    (unit, id, place); sources become distinct, in the targets' order."""
    each = facts.where(F.col("content").rlike(r"(?U)\S") & (F.size("source_ids") > 0)).select("fact_id", "unit", "content", F.explode("source_ids").alias("source_id"))
    known = each.join(targets.select("unit", F.col("id").alias("_id"), "place"), (each["source_id"] == F.col("_id")) & (each["unit"] == targets["unit"]), "left").select("fact_id", each["unit"], "content", "source_id", "place")
    lists = known.groupBy("fact_id", "unit", "content").agg(F.array_sort(F.collect_set(F.struct("place", "source_id"))).alias("x"), F.count_if(F.col("place").isNull()).alias("strange"))
    return lists.where("strange = 0").select("fact_id", "unit", "content", F.transform("x", lambda x: x["source_id"]).alias("source_ids"))


def route_facts(facts: DataFrame, observers: DataFrame) -> DataFrame:
    """(fact_id, observer): a fact goes to the observers that saw every one of its sources.
    observers: (id, observers) by message; source_ids are distinct. Lists of observers are met with
    one another; a row for each observer is made only of what is left. Rows go to their fact before
    lists are gathered: a fact's sources rarely lie in one partition, so gathering them there first
    would sort all lists and shorten nothing."""
    seen = observers.select(F.col("id").alias("source_id"), "observers")
    each = facts.select("fact_id", F.size("source_ids").alias("n"), F.explode("source_ids").alias("source_id"))
    lists = each.join(seen, "source_id").repartition("fact_id").groupBy("fact_id", "n").agg(F.collect_list("observers").alias("x")).where(F.size("x") == F.col("n"))
    common = F.aggregate(F.slice("x", 2, F.col("n")), F.col("x")[0], F.array_intersect)
    return lists.select("fact_id", F.explode(common).alias("observer")).where("observer IS NOT NULL")


def echo_facts(targets: DataFrame) -> DataFrame:
    """The offline model: each target message is a fact about itself."""
    return targets.select(F.col("id").alias("fact_id"), "unit", "content", F.array("id").alias("source_ids"))
