"""Deduplication of derived facts: exact, then by vector, then within the batch."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import content_hash, upper_of
from palimpsest.functions.text import is_richer as richer
from palimpsest.operators import search
from palimpsest.scratch import materialize

MAX_DISTANCE = 0.05
#: The words of functions.text.words().
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_SCOPE = ["workspace", "observer", "observed", "session"]
_OUTCOME = "workspace string, observer string, observed string, session string, position long, outcome string, id string, content string, embedding array<float>, source_ids array<string>"


def duplicate_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with equal keys and content: the smallest id, and how many there are. Only the hash is
    shuffled; the content is compared through a second hash of other bytes."""
    marked = rows.select(*keys, "id", content_hash(F.col("content")).alias("content_hash"), F.xxhash64("content").alias("_second"))
    groups = marked.groupBy(*keys, "content_hash", "_second").agg(F.min("id").alias("oldest"), F.count(F.lit(1)).alias("n"))
    return groups.where("n > 1").drop("_second")


def exact_matches(facts: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each fact (fact_id, keys, content) the oldest row (id, keys, content) with the same
    keys and the very same text. A text is known by the SHA-256 of its bytes; the oldest row of
    each is found before the join, so that copies don't meet as pairs."""
    left = facts.select("fact_id", *keys, F.sha2("content", 256).alias("h")).alias("l")
    right = rows.select("id", *keys, F.sha2("content", 256).alias("h")).groupBy(*keys, "h").agg(F.min("id").alias("id")).alias("r")
    same = F.col("l.h") == F.col("r.h")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).groupBy("l.fact_id").agg(F.min("r.id").alias("id"))


def match_existing(facts: DataFrame, rows: DataFrame, most: float = MAX_DISTANCE) -> DataFrame:
    """Adds to facts (fact_id, scope, content, embedding, ...) the row each one matches: the exact
    one, else the nearest within ``most``; match_id and match_content are null without any. Rows
    are the live explicit conclusions of committed batches."""
    exact = exact_matches(facts, rows, _SCOPE).withColumnRenamed("id", "exact_id")
    left = facts.join(exact, "fact_id", "left")
    probes = materialize(left.where("exact_id IS NULL").select(F.col("fact_id").alias("probe"), *_SCOPE, "embedding"), "fold-probes")
    near = search.nearest(probes, rows.where("embedding IS NOT NULL"), _SCOPE, most).select(F.col("probe").alias("fact_id"), F.col("id").alias("near_id"))
    left = left.join(near, "fact_id", "left").withColumn("match_id", F.coalesce("exact_id", "near_id")).drop("exact_id", "near_id")
    return left.join(rows.select(F.col("id").alias("match_id"), F.col("content").alias("match_content")), "match_id", "left")


def is_richer(new: str, old: str) -> bool:
    """functions.text.is_richer() inside a task."""
    longer = len(new.encode("utf-16-le")) > len(old.encode("utf-16-le"))
    return longer and {upper_of(x) for x in _WORD.findall(old)} <= {upper_of(x) for x in _WORD.findall(new)}


def _same(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], most: float) -> bool:
    if a[0] == b[0]:
        return True
    if len(a[1]) != len(b[1]):
        return False
    norm = float(a[1] @ a[1]) * float(b[1] @ b[1])
    return bool(norm) and 1 - float(a[1] @ b[1]) / norm**0.5 <= most


def _components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of links (a, b): the least node that each one reaches."""
    both = materialize(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "fold-links")
    labels, before, last = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), None, None
    while True:
        labels = last = materialize(labels, "fold-labels", last)
        now = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)")).alias("x")).first()["x"]
        if now == before:
            return labels
        before = now
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "label")
        least = labels.unionByName(near).groupBy("node").agg(F.min("label").alias("label"))
        jump = least.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = least.join(jump, "label").select("node", F.least("label", "next").alias("label"))


def _richest(matched: DataFrame) -> DataFrame:
    """corroborate or replace for each matched conclusion. Only texts that are richer than the
    conclusion's own can replace it, each of them once: whatever is the best then, is at least as
    rich as when the text first came."""
    keys = ["_scope", "match_id"]
    base = matched.groupBy(*keys, *_SCOPE).agg(F.min("position").alias("position"))
    new = matched.where(richer(F.col("content"), F.col("match_content"))).groupBy(*keys, F.sha2("content", 256).alias("_h")).agg(F.min_by(F.struct("position", "content", "embedding", "match_content"), "position").alias("x"))

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for row in pdf.sort_values("position").to_dict("records"):
            if is_richer(row["content"], row["match_content"] if best is None else best["content"]):
                best = row
        return pd.DataFrame([[*key, best["content"], best["embedding"]]], columns=["_scope", "match_id", "content", "embedding"])

    best = new.select(*keys, "x.*").groupBy(*keys).applyInPandas(step, f"_scope string, match_id {matched.schema['match_id'].dataType.simpleString()}, content string, embedding array<float>")
    out = base.join(best.withColumn("_new", F.lit(True)), keys, "left")
    new_vector = F.when(F.col("_new"), F.coalesce("embedding", F.array().cast("array<float>")))
    return out.select(*_SCOPE, "position", F.when(F.col("_new"), "replace").otherwise("corroborate").alias("outcome"), F.col("match_id").cast("string").alias("id"), "content", new_vector.alias("embedding"), F.lit(None).cast("array<string>").alias("source_ids"))


def fold(facts: DataFrame, most: float = MAX_DISTANCE) -> DataFrame:
    """What a batch of matched facts (match_existing(), with position and source_ids) does to each
    scope: rows with outcome insert, corroborate (id) or replace (id, content, embedding).

    Facts are taken by position. A matched conclusion counts once; the richest content replaces
    its own. A fact without a match joins the first pending one that is the same, whose sources
    take in its own and whose content gives way to a richer one. source_ids are distinct.

    A pending fact's content and vector are always those of one of the facts, so facts meet only
    if links of equal texts and near vectors connect them. Texts that no link leaves are folded by
    aggregates; the order matters, and likeness isn't transitive, only among facts that links
    connect, and each such group goes through one task."""
    facts = materialize(facts.withColumn("_scope", F.to_json(F.struct(*_SCOPE))), "fold-facts")
    waiting = facts.where("match_id IS NULL").withColumn("node", F.concat_ws(" ", F.sha2("_scope", 256), F.coalesce(F.sha2("content", 256), F.lit("-"))))
    vectors = materialize(waiting.groupBy("_scope", "node", "embedding").agg(F.lit(1).alias("one")), "fold-vectors")
    labels = _components(search.linked(vectors, ["_scope"], most, "node"))
    several = vectors.groupBy("node").agg(F.count("one").alias("n")).where("n > 1").select("node", F.col("node").alias("label"))
    groups = materialize(labels.unionByName(several.join(labels, "node", "left_anti")), "fold-groups")
    alone = waiting.join(groups, "node", "left_anti").groupBy("node", *_SCOPE).agg(F.min("position").alias("position"), F.first("content").alias("content"), F.first("embedding").alias("embedding"), F.array_sort(F.collect_list(F.struct("position", "source_ids"))).alias("x"))
    none = F.array().cast("array<string>")
    sources = F.array_distinct(F.flatten(F.transform("x", lambda x: F.coalesce(x["source_ids"], none))))
    alone = alone.select(*_SCOPE, "position", F.lit("insert").alias("outcome"), F.lit(None).cast("string").alias("id"), "content", F.coalesce("embedding", F.array().cast("array<float>")).alias("embedding"), sources.alias("source_ids"))

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        inserts: list[dict] = []
        for row in pdf.sort_values("position").to_dict("records"):
            vector = np.array([] if row["embedding"] is None else row["embedding"], dtype=np.float64)
            sources = [] if row["source_ids"] is None else list(row["source_ids"])
            held = next((x for x in inserts if _same((x["content"], x["vector"]), (row["content"], vector), most)), None)
            if held is None:
                inserts.append({"outcome": "insert", "position": row["position"], "content": row["content"], "vector": vector, "source_ids": dict.fromkeys(sources)})
                continue
            held["source_ids"] |= dict.fromkeys(sources)
            if is_richer(row["content"], held["content"]):
                held.update(content=row["content"], vector=vector)
        for x in inserts:
            x["embedding"], x["source_ids"] = x.pop("vector").astype(np.float32).tolist(), list(x["source_ids"])
        names = [x.split(" ")[0] for x in _OUTCOME.split(", ")]
        scope = dict(zip(_SCOPE, key[1:], strict=True))
        return pd.DataFrame([[(x | scope).get(n) for n in names] for x in inserts], columns=names, dtype=object)

    together = waiting.join(groups, "node").groupBy("label", *_SCOPE).applyInPandas(step, _OUTCOME)
    return _richest(facts.where("match_id IS NOT NULL")).unionByName(alone).unionByName(together)


def fact_key(*parts: str) -> bytes:
    """An unambiguous key of several texts."""
    return b"".join(struct.pack(">i", len(p.encode())) + p.encode() for p in parts)


def times_derived(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts after a batch: one more for each matched conclusion, 1 for an inserted one."""
    more = changes.where("outcome <> 'insert'").groupBy("id").agg(F.count(F.lit(1)).alias("more"))
    return rows.join(more, "id", "left").withColumn("times_derived", F.col("times_derived") + F.coalesce("more", F.lit(0))).drop("more")


def collection_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """For each collection: how many explicit conclusions it gained, and its last activity."""
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("explicit_count"), F.max("created_at").alias("last_activity"))
