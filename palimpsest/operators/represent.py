"""What an observer knows about a peer: visibility, ranked branches, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import bullet


def visible(rows: DataFrame, sessions: list[str] | None, scopes: list[str] | None = None) -> DataFrame:
    """With an allowlist of sessions only explicit conclusions of those are seen; an empty list
    shows none. To be applied before anything is counted or ranked. Scopes aren't supported: any
    list of them, an empty one too, is a ValueError."""
    if scopes is not None:
        raise ValueError("scopes aren't supported")
    if sessions is None:
        return rows
    return rows.where(F.col("session").isin(list(sessions)) & (F.col("level") == 0)) if sessions else rows.where(F.lit(False))


def allowed_workspaces(grants: DataFrame) -> DataFrame:
    """For each principal: whether all workspaces are granted, else which. Other roles don't count."""
    mine = grants.where(F.col("role") == "workspace")
    every = F.coalesce(F.bool_or(F.col("workspace").isNull()), F.lit(False))
    return mine.groupBy("principal").agg(every.alias("every"), F.array_sort(F.collect_set("workspace")).alias("workspaces"))


def branches(rows: DataFrame, most: int, search: DataFrame | None = None, frequent: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """Up to ``most`` conclusions of each group of ``keys`` (of all rows, without keys): those of
    ``search`` (id, place) first, then the most derived, then the newest; a conclusion counts in
    the first branch that has it. Adds rank (the branch) and place (within it)."""
    parts = []
    if search is not None:
        parts.append(rows.join(search.select("id", F.col("place").cast("int").alias("place")), "id").withColumn("rank", F.lit(0)))
    for rank, order in ((1, [F.desc("times_derived"), F.desc("created_at"), F.desc("id")]), (2, [F.desc("created_at"), F.desc("id")])):
        if rank == 2 or frequent:
            if keys:
                part = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= most)
            else:
                part = rows.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
            parts.append(part.withColumn("rank", F.lit(rank)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    once = both.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "id").orderBy("rank", "place"))).where("_r = 1").drop("_r")
    kept = F.row_number().over(Window.partitionBy(*(keys or [F.lit(1)])).orderBy("rank", "place", "id"))
    return once.withColumn("_r", kept).where(F.col("_r") <= most).drop("_r")


def render(rows: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """Markdown with a section for each level and a bullet for each conclusion, in the order of
    (rank, created_at, id). The rows of a text are capped by branches()."""
    line = F.concat(F.lit("- "), bullet(F.col("content")), F.lit("\n"))
    items = F.array_sort(F.collect_list(F.struct("rank", "created_at", "id", line.alias("line"))))
    sections = rows.groupBy(*keys, "level").agg(items.alias("x"))
    title = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("level") + 1)
    text = F.concat(F.lit("## "), title, F.lit("\n\n"), F.array_join(F.transform("x", lambda x: x["line"]), ""))
    whole = sections.select(*keys, F.struct("level", text.alias("text")).alias("s")).groupBy(*keys).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select(*keys, F.array_join(F.transform("s", lambda s: s["text"]), "\n").alias("representation"))


def peer_context(texts: DataFrame, cards: DataFrame, keys: list[str], hidden: bool = False) -> DataFrame:
    """Representations with the peer's card; a restricted reader doesn't see the card."""
    if hidden:
        return texts.withColumn("card", F.lit(None).cast("array<string>"))
    return texts.join(cards.select(*keys, F.col("entries").alias("card")), keys, "left")


def resolved_sources(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, source_ids): sources in their order, without those that aren't known any more."""
    each = rows.select("id", F.posexplode("source_ids").alias("place", "source_id"))
    there = each.join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    lists = there.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "source_id"))).alias("x"))
    kept = rows.select("id").join(lists, "id", "left")
    return kept.select("id", F.coalesce(F.transform("x", lambda x: x["source_id"]), F.array().cast("array<string>")).alias("source_ids"))
