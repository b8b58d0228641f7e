"""Toxicity by a classifier chain.

One logistic model for each category, in order. A model's features are the presence of words and
of their first four and five letters, and the logits that the models before it give. In training
those logits come out of fold: a document's logit is given by a model that hasn't seen it, so that
later models learn how far earlier ones can be trusted. Each category's decision threshold is the
one with the best F1 out of fold.

Training takes at most ``SAMPLE`` labelled documents (those with the smallest hashes of doc_id);
features are counted over that sample by Spark, and ``FEATURES`` of them, chosen by how far their
share of positives is from the overall one, are fitted. All documents are scored, whole texts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, table

#: The label columns that the tables have, in the order of the chain; toxicity is one of them, not several.
CATEGORIES = ("quality", "toxic")
SAMPLE = 8_000
#: Features that are fitted; they come from at most SAMPLE documents, so there are at most so many to choose from.
FEATURES = 6_000
FOLDS = 3
ROUNDS = 50
RIDGE = 1.0
_EDGES = "\"'.,;:!?()[]{}<>*#$%&|-_=+/\\`~^@0123456789"


def features(text: str | None) -> set[str]:
    """Distinct words in lower case without marks at their edges, and word beginnings, ending in *."""
    words = {x.strip(_EDGES) for x in set((text or "").lower().split())}
    words.discard("")
    return words | {x[:4] + "*" for x in words if len(x) > 4} | {x[:5] + "*" for x in words if len(x) > 5}


def quasi_newton(loss, x: np.ndarray, rounds: int, kept: int = 10) -> np.ndarray:
    """Minimises a smooth convex function (value and slope) by limited-memory BFGS."""
    value, slope = loss(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, parts = slope.copy(), []
        for s, y, r in reversed(moves):
            parts.append(r * (s @ way))
            way -= parts[-1] * y
        way *= 1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 1 / max(np.abs(slope).max(), 1e-12)
        for (s, y, r), part in zip(moves, reversed(parts), strict=True):
            way += (part - r * (y @ way)) * s
        step, drop = 1.0, slope @ way
        while step > 1e-6:
            after, bent = loss(x - step * way)
            if after <= value - 1e-4 * step * drop:
                break
            step /= 2
        else:
            break
        s, y = -step * way, bent - slope
        if s @ y > 1e-10:
            moves = [*moves, (s, y, 1 / (s @ y))][-kept:]
        done = value - after < 1e-6 * max(1.0, abs(after))
        x, value, slope = x + s, after, bent
        if done:
            break
    return x


class Logistic:
    """A ridge logistic model over sets of features and a few numbers; the intercept isn't shrunk."""

    def fit(self, rows: np.ndarray, columns: np.ndarray, extra: np.ndarray, y: np.ndarray, width: int) -> Logistic:
        n, k = extra.shape
        extra = np.concatenate((extra / 10, np.ones((n, 1))), axis=1)
        shrunk = np.append(np.full(width + k, RIDGE), 0.0)

        def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
            z = np.bincount(rows, weights=w[columns], minlength=n) + extra @ w[width:]
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            slope = np.concatenate((np.bincount(columns, weights=error[rows], minlength=width), extra.T @ error))
            return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (shrunk * w * w).sum()), slope + shrunk * w

        start = np.zeros(width + k + 1)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
        start[-1] = np.log(mean / (1 - mean))
        w = quasi_newton(loss, start, ROUNDS)
        self.w, self.v = w[:width], np.append(w[width:-1] / 10, w[-1])
        return self

    def logits(self, rows: np.ndarray, columns: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.clip(np.bincount(rows, weights=self.w[columns], minlength=len(extra)) + extra @ self.v[:-1] + self.v[-1], -30, 30)


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit from which on a category is said, with the best F1; infinite without positives."""
    if not y.any():
        return float("inf")
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(2 * hits / (np.arange(1, len(y) + 1) + y.sum())))
    low = logits[order[best + 1]] if best + 1 < len(y) else logits[order[best]] - 1
    return float((logits[order[best]] + low) / 2)


class Chain:
    """One model and threshold for each category, over a fixed vocabulary."""

    def __init__(self, vocabulary: list[str]):
        self.index = {x: i for i, x in enumerate(vocabulary)}
        self.models: list[Logistic] = []
        self.thresholds: list[float] = []

    def fit(self, rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
        """labels: a column for each category, NaN where unknown; such rows aren't learned from."""
        n, width = len(labels), len(self.index)
        extra = np.zeros((n, 0))
        for j in range(labels.shape[1]):
            y, known = labels[:, j], ~np.isnan(labels[:, j])
            out = np.zeros(n)

            def fitted(use: np.ndarray, y=y, extra=extra) -> Logistic:
                place = np.cumsum(use) - 1
                own = use[rows]
                return Logistic().fit(place[rows[own]], columns[own], extra[use], y[use], width)

            for fold in range(FOLDS):
                part = fitted(known & (folds != fold)).logits(rows, columns, extra)
                out[folds == fold] = part[folds == fold]
            self.models.append(fitted(known))
            self.thresholds.append(best_threshold(out[known], y[known]))
            extra = np.concatenate((extra, out[:, None]), axis=1)
        return self

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities and decisions, a row for each text and a column for each category."""
        found = [[self.index[x] for x in features(t) if x in self.index] for t in texts]
        rows = np.repeat(np.arange(len(texts)), [len(x) for x in found]).astype(np.int64)
        columns = np.array([i for x in found for i in x], dtype=np.int64)
        logits = np.zeros((len(texts), 0))
        for model in self.models:
            logits = np.concatenate((logits, model.logits(rows, columns, logits)[:, None]), axis=1)
        return 1 / (1 + np.exp(-logits)), logits >= np.array(self.thresholds)


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE) -> Chain:
    """A chain from labelled documents: docs (doc_id, text), labels (doc_id, a 0/1 column for each
    category). Repeated labels of a document count as their maximum, missing ones aren't used; of
    several texts under one doc_id the first by code point is learned from. Without any labelled document every category has one constant answer, no."""
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(F.col(c).cast("double")).alias(c) for c in categories])
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *categories).agg(F.min("text").alias("text"))

    def listed(batches):
        for batch in batches:
            found = [sorted(features(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]], ["doc_id", "features", *categories])

    fields = ", ".join(f"{c} double" for c in categories)
    known = materialize(labelled.select("doc_id", "text", *categories).mapInArrow(listed, f"doc_id long, features array<string>, {fields}"), "labelled")
    means = known.agg(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in categories]).first()

    def tallied(batches):
        counts: Counter = Counter()
        positive = [Counter() for _ in categories]
        for batch in batches:
            for i, found in enumerate(batch.column(1).to_pylist()):
                counts.update(found)
                for j, hits in enumerate(positive):
                    if batch.column(2 + j)[i].as_py():
                        hits.update(found)
        often = [x for x in counts]
        arrays = [pa.array(often, pa.string()), pa.array([counts[x] for x in often], pa.int64()), *[pa.array([hits[x] for x in often], pa.int64()) for hits in positive]]
        yield pa.RecordBatch.from_arrays(arrays, ["feature", "n", *categories])

    sums = known.mapInArrow(tallied, "feature string, n long, " + ", ".join(f"{c} long" for c in categories)).groupBy("feature").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in categories])
    odds = [(F.col(c) - F.col("n") * m) ** 2 / (F.col("n") * max(m * (1 - m), 1e-6)) for c, m in zip(categories, means, strict=True)]
    vocabulary = [r["feature"] for r in sums.where("n >= 4").orderBy(F.desc(F.greatest(*odds, F.lit(-1.0))), "feature").limit(FEATURES).select("feature").collect()]
    chain = Chain(sorted(vocabulary))
    index = known.sparkSession.sparkContext.broadcast(chain.index)

    def numbered(batches):
        for batch in batches:
            found = [[index.value[x] for x in xs if x in index.value] for xs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32())), *batch.columns[2:]], ["doc_id", "found", *categories])

    got = known.mapInArrow(numbered, f"doc_id long, found array<int>, {fields}").toPandas().sort_values("doc_id")
    sizes = [len(x) for x in got["found"]]
    rows_at = np.repeat(np.arange(len(got)), sizes).astype(np.int64)
    columns = np.concatenate([np.zeros(0, dtype=np.int64), *got["found"]]).astype(np.int64)
    folds = np.arange(len(got)) % FOLDS
    return chain.fit(rows_at, columns, got[list(categories)].to_numpy(dtype=float).reshape(len(got), len(categories)), folds)


def score_documents(docs: DataFrame, chain: Chain, categories: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """(doc_id, p_<category> and is_<category> for each category) for every row of docs. A null or
    empty text has no features and gets what the intercepts say; its answers to toxic is no as
    long as most labelled documents aren't."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", *[f"p_{c}" for c in categories], *[f"is_{c}" for c in categories]]

    def scored(batches):
        for batch in batches:
            p, yes = sent.value.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in p.T], *[pa.array(x) for x in yes.T]], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join([f"p_{c} double" for c in categories] + [f"is_{c} boolean" for c in categories])
    return rows.mapInArrow(scored, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_documents() over all documents, by a chain from all labels. Repeated rows are answered
    alike, null and empty texts by what the intercepts say."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    chain = train_chain(docs, table(spark, sf_dir, "labels", "doc_id", *CATEGORIES))
    out = score_documents(docs, chain)
    return out.select("doc_id", "p_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
