"""Models as plug-ins: plain functions that tasks call with batches of rows.

A model may fail. Vectors are then asked for row by row, so that one text doesn't cost its
neighbours theirs; facts are asked of the next model in line.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.vectors import deterministic_embedding
from palimpsest.operators.conclusions import pending, save_embeddings

#: A model of vectors takes texts and gives as many vectors; one of facts takes a system prompt and
#: a transcript and gives a JSON object whose ``facts`` have content and source_ids.
Embedder = Callable[[list[str]], list[list[float]]]
Deriver = Callable[[str, str], str]
BATCH, MOST_BATCHES = 64, 100


def deterministic_embedder(dims: int) -> Embedder:
    return lambda texts: [deterministic_embedding(x, dims) for x in texts]


def embedded(rows: DataFrame, model: Embedder, dims: int, batch: int = BATCH) -> DataFrame:
    """(id, content, vector) for rows (id, content): the model's vectors, null where it fails on a
    text alone, or gives one of another length or with components that aren't finite."""

    def sound(vector) -> list[float] | None:
        out = np.asarray(vector, dtype=np.float64)
        return out.tolist() if out.shape == (dims,) and np.isfinite(out).all() else None

    def asked(texts: list[str]) -> list[list[float] | None]:
        try:
            found = list(model(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
            return [sound(x) for x in found]
        except Exception:  # whatever a model raises
            return [None] if len(texts) == 1 else [asked([x])[0] for x in texts]

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [frame.iloc[i : i + batch] for i in range(0, len(frame), batch)]
            vectors = [v for part in parts for v in asked(part["content"].tolist())]
            yield frame.assign(vector=vectors)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "content").mapInPandas(within, f"id {kind}, content string, vector array<float>")


def embedding_tick(rows: DataFrame, model: Embedder, dims: int, batch: int = BATCH, most: int = MOST_BATCHES) -> DataFrame:
    """Conclusions after one turn of the backlog: the oldest pending ones, at most ``most`` batches,
    have their vectors or are marked as failed."""
    return save_embeddings(rows, embedded(pending(rows, limit=batch * most), model, dims, batch))


def echo_model(system: str, transcript: str) -> str:
    """The offline model: each target message is a fact about itself."""
    targets = [m for m in json.loads(transcript)["messages"] if "id" in m]
    return json.dumps({"facts": [{"content": m["content"], "source_ids": [m["id"]]} for m in targets]})


def derived(batches: DataFrame, models: list[Deriver]) -> DataFrame:
    """(unit, fact_id, content, source_ids) from batches (unit, system, transcript): of each batch
    the facts of the first model that gives valid ones, numbered within the unit. A batch that no
    model answers fails its task, so that it is tried again."""

    def facts(answer: str) -> list[tuple[str, list[str]]]:
        found = json.loads(answer)["facts"]
        if not all(isinstance(x["content"], str) and all(isinstance(s, str) for s in x["source_ids"]) for x in found):
            raise ValueError("facts of another form")
        return [(x["content"], x["source_ids"]) for x in found]

    def within(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for unit, system, transcript in frame.itertuples(index=False, name=None):
                errors = []
                for model in models:
                    try:
                        out.extend((unit, f"{unit}/{i}", *fact) for i, fact in enumerate(facts(model(system, transcript))))
                        break
                    except Exception as error:  # whatever a model raises
                        errors.append(repr(error))
                else:
                    raise RuntimeError(f"no model answers {unit}: {errors}")
            yield pd.DataFrame(out, columns=["unit", "fact_id", "content", "source_ids"])

    return batches.select("unit", F.coalesce("system", F.lit("")).alias("system"), "transcript").mapInPandas(within, "unit string, fact_id string, content string, source_ids array<string>")
