"""What happens beyond one block, tile, shard or group, and where hashes or lengths clash."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import frame_of, union_find, write_documents
from test_contracts import brute_vectors, rows_of, shingles

from palimpsest.llm import embedding_dedup, ngram_join
from palimpsest.llm.common import components
from palimpsest.llm.queries import QUERIES


def near_copies(r, base, many, edits):
    """Copies of a text with so many words changed."""
    words = base.split()
    for i in range(many):
        own = words.copy()
        for k in r.sample(range(len(own)), r.choice(edits)):
            own[k] = f"x{i}y{k}"
        yield " ".join(own)


def crowded(r):
    """Two large groups of near copies, of which many don't link with each other, beside a passage that unrelated texts share."""
    base = [" ".join(f"{name}{i}" for i in range(120)) for name in ("a", "b")]
    texts = [t for b in base for t in near_copies(r, b, 60, (0, 1, 2, 3, 4, 5, 9, 14))]
    passage = " ".join(f"p{i}" for i in range(30))
    texts += [passage + " " + " ".join(f"u{i}w{k}" for k in range(r.choice((2, 5, 9, 40)))) for i in range(60)]
    return [(i, t, "en", "s") for i, t in enumerate(r.sample(texts, len(texts)))]


def linked(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    return sets, [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("bits", [64, 3])
def test_ngram_join_over_several_tiles(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "BLOCK", 12)
    monkeypatch.setattr(ngram_join, "TASK_ROWS", 30)
    rows = crowded(random.Random(bits))
    docs = spark.read.parquet(write_documents(tmp_path, rows) + "/documents.parquet")
    sets, links = linked(rows)
    least = union_find(len(rows), links, [d for d, *_ in rows])
    assert len(set(least)) > 10 and len(links) > 500
    got = ngram_join.jaccard_components(docs, bits).toPandas()
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter((d, len(s), c) for (d, *_), s, c in zip(rows, sets, least, strict=True))
    pairs, members = ngram_join.jaccard_links(docs, bits)
    named = dict(members.toPandas().itertuples(index=False, name=None))
    want = {tuple(sorted((named[rows[i][0]], named[rows[j][0]]))) for i, j in links if sets[i] != sets[j]}
    assert sorted(map(tuple, pairs.toPandas().to_numpy().tolist())) == sorted(want)
    assert len(set(named.values())) == len({frozenset(s) for s in sets})


def test_hot_shingles_lead_all_their_classes(spark, tmp_path, monkeypatch):
    cls = np.arange(-40, 60, dtype=np.int64)
    assert set(ngram_join.salt_of(5, np.array([0, 12]))) == {-1} and ngram_join.salt_of(-(1 << 60) + 385, np.array([15]))[0] in range(8)
    tokens = [(1, int(ngram_join.salt_of(int(c) << 7, np.array([15]))[0]), int(c)) for c in cls] + [(2, -1, 3), (2, -1, 9), (3, -1, 4)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted(tokens), strict=True)], ["token", "salt", "cls"])
    got = [r for part in ngram_join._leaders([batch.slice(0, 7), batch.slice(7)]) for r in part.to_pylist()]
    assert [(r["leader"], r["cls"]) for r in got if r["token"] is None] == [(3, 9)]
    hot = [r for r in got if r["token"] is not None]
    assert {r["cls"] for r in hot} == set(cls) and len({r["leader"] for r in hot}) == 8


def turned(r, rows, cosine):
    """Unit vectors at so much of an angle to rows."""
    way = r.standard_normal(rows.shape)
    way -= (way * rows).sum(axis=1, keepdims=True) * rows
    return cosine * rows + np.sqrt(1 - cosine**2) * way / np.linalg.norm(way, axis=1, keepdims=True)


def vectors_of(tmp_path, vectors, kind):
    pq.write_table(pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(kind)), "label": pa.array([0] * len(vectors), pa.int32())}), tmp_path / "embeddings.parquet")
    return str(tmp_path)


def test_planted_links_near_the_threshold_are_found(spark, tmp_path):
    """Recall against brute force, over links at a cosine of 0.951 to 0.97."""
    r = np.random.default_rng(5)
    centers = embedding_dedup.unit(r.standard_normal((40, 48)))
    spread = embedding_dedup.unit(np.concatenate((r.standard_normal((2000, 48)), turned(r, np.repeat(centers, 50, axis=0), 0.7))))
    planted = np.concatenate([turned(r, spread[i::8], c) for i, c in enumerate((0.951, 0.955, 0.96, 0.97))])
    vectors = np.concatenate((spread, planted)).astype(np.float32).tolist()
    got = frame_of(QUERIES["op10_embedding_near_dedup"](spark, vectors_of(tmp_path, vectors, pa.float32())), "vec_id")
    sure, may = brute_vectors(vectors)
    assert len(sure) >= 2000
    most = Counter(i for pair in may for i in pair)
    assert all(got.loc[i, "n_links"] <= most[i] for i in range(len(vectors)))
    recall = sum(got["n_links"]) / (2 * len(sure))
    print(f"recall {recall:.4f} of {len(sure)} links")
    assert recall >= 0.98


def test_vectors_of_all_lengths_and_of_doubles(spark, tmp_path):
    a, b = [1.0, 2.0, 3.0], [1.0] * 8
    vectors = [a, a, [2.0, 4.0, 6.0], *[[float(i == k) for k in range(8)] for i in range(6)], b, [3.0] * 8, [0.5], [7.0], [-1.0], [1e300, 1e300], [1e299, 1e299], [1e-320, 0.0], [5.0, 0.0]]
    got = frame_of(QUERIES["op10_embedding_near_dedup"](spark, vectors_of(tmp_path, vectors, pa.float64())), "vec_id")
    assert got["n_links"].sort_index().tolist() == [2, 2, 2, *[0] * 6, 1, 1, 1, 1, 0, 1, 1, 1, 1]
    assert got["component_id"].sort_index().tolist() == [0, 0, 0, *range(3, 10), 9, 11, 11, 13, 14, 14, 16, 16]


def test_a_crowded_cell_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    r = np.random.default_rng(2)
    base = embedding_dedup.unit(r.standard_normal((1, 16)))
    vectors = turned(r, np.repeat(base, 500, axis=0), 0.97)
    vectors = np.concatenate((vectors, r.standard_normal((300, 16)))).astype(np.float32).tolist()
    got = frame_of(QUERIES["op10_embedding_near_dedup"](spark, vectors_of(tmp_path, vectors, pa.float32())), "vec_id")
    sure, may = brute_vectors(vectors)
    degree, most = Counter(i for p in sure for i in p), Counter(i for p in may for i in p)
    assert sum(got["n_links"]) >= 0.98 * sum(degree.values()) and all(got.loc[i, "n_links"] <= most[i] for i in range(len(vectors)))


def test_components_of_chains_hubs_and_loops(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 170)] + [(500, i) for i in range(501, 700)] + [(7, 7), (9, 8), (8, 9)] + [(r.randint(1000, 1400), r.randint(1000, 1400)) for _ in range(180)]
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    least = union_find(len(nodes), [(place[a], place[b]) for a, b in edges if a != b], nodes)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(x["node"], x["component"]) for x in got} == set(zip(nodes, least, strict=True)) and len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
