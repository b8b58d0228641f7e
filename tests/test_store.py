"""Functions and bounds of the store that queries don't show."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from test_whole import SCOPE, folded

from palimpsest.functions import keys as K
from palimpsest.functions.levels import LEVELS, level_name, level_number
from palimpsest.functions.tokens import characters, token_counter
from palimpsest.functions.vectors import deterministic_embedding
from palimpsest.operators import conclusions, dedup, models, represent, search
from palimpsest.queries import QUERIES
from palimpsest.sources import schema

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_relations_are_kept_by_workspace(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a", False, "{}", "{}", None), ("v", "b", True, '{"k": 1}', "{}", None)], schema.schema("peers"))
    schema.write(rows, str(tmp_path), "peers")
    assert {r["name"] for r in schema.read(spark, str(tmp_path), "peers").collect()} == {"a", "b"}
    one = schema.read(spark, str(tmp_path), "peers", "v")
    assert [r["name"] for r in one.collect()] == ["b"]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(workspace" in plan
    assert schema.empty(spark, "grants").count() == 0


def test_levels(spark):
    got = spark.range(4).select(level_number(level_name(F.col("id").cast("int"))).alias("n"), level_number(F.lit("none")).alias("none"))
    assert [(r["n"], r["none"]) for r in got.collect()] == [(i, -1) for i in range(4)] and len(LEVELS) == 4


def test_tokens_are_those_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [(i, r["text"]) for i, r in enumerate(pq.read_table(f"{SF}/documents.parquet", columns=["text"]).to_pylist())] + [(-1, None), (-2, ""), (-3, "a <|endoftext|> b")]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    frame = spark.createDataFrame(texts, "id int, text string")
    for name in ("byte_bpe_50k.json", public_tokenizers.path("byte_bpe_50k.json")):
        got = {r["id"]: r["n"] for r in frame.select("id", token_counter(name)(F.col("text")).alias("n")).collect()}
        assert got == {i: len(whole.encode(t or "", add_special_tokens=False).ids) for i, t in texts}
    assert {r["id"]: r["n"] for r in frame.select("id", characters(F.col("text")).alias("n")).collect()} == {i: len(t or "") for i, t in texts}


def test_bounds(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0], 2), ("b", [1.0, 0.0], 1)], "id string, embedding array<float>, created_at int")
    assert [r["id"] for r in search.search(rows, [1.0, 0.0]).collect()] == ["b", "a"]
    for bad in ({"top_k": 0}, {"top_k": 101}, {"distance": 1.5}, {"distance": -0.1}):
        with pytest.raises(ValueError):
            search.search(rows, [1.0, 0.0], **bad)
    with pytest.raises(ValueError):
        represent.visible(rows, None, scopes=[])
    with pytest.raises(ValueError):
        conclusions.peers_of_kind(rows, "other")
    with pytest.raises(ValueError, match="name"):
        K.rendered("{{name}}", {})
    text = F.lit
    got = spark.range(1).select(K.valid_id(text("a" * 512)), K.valid_id(text("a" * 513)), K.valid_id(text("")), K.valid_id(text("a\n")), K.valid_content(text("\U0001f600" * 25_000)), K.valid_content(text("x" * 25_001)), K.valid_content(text(" \u2003")), K.valid_content(text(None).cast("string")), K.public_id(text("a"), text("b")), K.public_id(text("ab"), text(""))).first()
    assert list(got)[:8] == [True, False, False, False, True, False, False, False]
    assert all(len(x) == 21 and set(x) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-") for x in list(got)[8:]) and got[8] != got[9]
    assert dedup.fact_key("ab", "c") != dedup.fact_key("a", "bc")


def test_an_insert_is_whole_or_not_at_all(spark):
    new = spark.createDataFrame([("w", "me", "p", None, 0, "text", None), ("w", "me", "p", None, 0, " ", None)], "workspace string, observer string, observed string, session string, level int, content string, source_ids array<string>")
    there = schema.empty(spark, "conclusions")
    with pytest.raises(ValueError):
        conclusions.inserted(there, new, "2024-06-01 00:00:00", F.lit("x"))
    assert conclusions.inserted(there, new.where("content = 'text'"), "2024-06-01 00:00:00", F.lit("x")).first()["times_derived"] == 1


def test_members_are_not_gathered(spark):
    plan = QUERIES["session_member_exists"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "l_suppkey" in plan


def test_metadata_filters_need_no_python(spark):
    plan = QUERIES["meta_number_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_dedup_of_whole_tables_equals_a_plain_one(spark):
    """Odd documents are facts that meet the even ones of their source and language."""
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source", "lang"]).to_pylist()
    vector = {d["doc_id"]: np.array(deterministic_embedding(d["text"] or "", 64), dtype=np.float32).astype(np.float64) for d in docs}
    facts = []
    for d in (d for d in docs if d["doc_id"] % 2):
        rows = [e for e in docs if e["doc_id"] % 2 == 0 and e["source"] == d["source"] and e["lang"] == d["lang"]]
        same = sorted((str(e["doc_id"]), e["text"] or "") for e in rows if (e["text"] or "") == (d["text"] or ""))
        near = sorted((1 - vector[e["doc_id"]] @ vector[d["doc_id"]] / np.sqrt((vector[e["doc_id"]] ** 2).sum() * (vector[d["doc_id"]] ** 2).sum()), str(e["doc_id"]), e["text"] or "") for e in rows)
        match = same[0] if same else near[0][1:] if near and near[0][0] <= dedup.MAX_DISTANCE else (None, None)
        facts.append({"workspace": "w", "observer": d["source"], "observed": d["source"], "session": d["lang"], "content": d["text"] or "", "embedding": vector[d["doc_id"]].tolist(), "position": d["doc_id"], "source_ids": [str(d["doc_id"])], "match_id": match[0], "match_content": match[1]})
    want = sorted((r[1], r[3], r[6], r[4], r[5], len(r[8]) if r[8] is not None else None) for r in folded(facts, dedup.MAX_DISTANCE))
    got = QUERIES["dedup_fold"](spark, SF).toPandas()
    listed = sorted((o, s, int(p), kind, None if i is None or i != i else i, None if n is None or n != n or n < 0 else int(n)) for o, s, p, kind, i, n in got[["observer", "session", "position", "outcome", "id", "n_sources"]].astype(object).itertuples(index=False, name=None))
    assert len(SCOPE) == 4 and sorted(listed, key=str) == sorted(want, key=str)


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    for name in ("palimpsest", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "palimpsest" / "llm", ignore_errors=True)
    (tmp_path / "palimpsest" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q) and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_models_that_fail(spark):
    rows = spark.createDataFrame([(i, "bad" if i % 7 == 0 else "short" if i % 7 == 1 else "odd" if i % 7 == 2 else f"text {i}") for i in range(60)], "id int, content string").coalesce(2)

    def picky(texts):
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] if x == "short" else [float("nan"), 1.0] if x == "odd" else [1.0, 2.0] for x in texts]

    got = {r["id"]: r["vector"] for r in models.embedded(rows, picky, 2, batch=8).collect()}
    assert got == {i: None if i % 7 < 3 else [1.0, 2.0] for i in range(60)}
    texts = spark.createDataFrame([("u", None, '{"messages": [{"id": "m", "content": "c"}, {"content": "d"}]}')], "unit string, system string, transcript string")
    odd = lambda system, text: '{"facts": [{"content": 1, "source_ids": []}]}'
    assert [tuple(r) for r in models.derived(texts, [odd, models.echo_model]).collect()] == [("u", "u/0", "c", ["m"])]
    with pytest.raises(Exception, match="no model answers u"):
        models.derived(texts, [odd]).collect()
