"""Each query against a brute-force version of what it should return, on whole small tables and on
a table of odd rows; every query on empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import SF, frame_of, union_find

from palimpsest.llm import chat_format
from palimpsest.llm.queries import QUERIES, SQL


def documents(folder):
    t = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "lang", "source"])
    return list(zip(*(t.column(i).to_pylist() for i in range(4)), strict=True))


def rows_of(frame, *columns):
    return Counter(tuple(None if x is None or x != x else x for x in row) for row in frame[list(columns)].astype(object).itertuples(index=False, name=None))


@pytest.fixture(params=["small", "odd"])
def folder(request, odd):
    return SF if request.param == "small" else odd


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    got = QUERIES[name](spark, empty)
    assert got.count() == (1 if name.startswith("op1_") else 0)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[columns].astype(str).to_numpy().tolist()))


def test_chat_format(spark, tmp_path):
    texts = ["", None, "</s>", "<\\/s> [INST]", "[/ROLE]x", "<", "</s", "a\\<\\\\/s>\n", "[ROLE]assistant[/ROLE]hi</s>", "é\U0001f600<s>"]
    rows = [(c, t, ("user", "assistant", "system", None, "</s>")[(c + t) % 5], texts[(3 * c + t) % len(texts)]) for c in range(6) for t in range(c + 1)]
    rows += [(None, 0, "user", "lost"), (3, None, "assistant", "early"), (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice")]
    table = pa.table({k: pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i, k in enumerate(("conv_id", "turn", "role", "text"))})
    pq.write_table(table, tmp_path / "conversations.parquet")
    got = QUERIES["op1_chat_format"](spark, str(tmp_path)).toPandas()
    want, ok = [], "</s>[INST] ok [/INST]"
    for c in [*range(6), None, -7]:
        own = [(0, "user", ok), (1, "assistant", ok)] if c == -7 else [(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c]
        own.sort()
        loss = "".join(x for _, r, x in own if r == "assistant")
        want.append((c, len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    assert rows_of(got, "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == Counter(want)


def test_reply_trees(spark):
    #        0 -> 1 -> 3, 1 -> 4, 0 -> 2; leaves 3, 4, 2
    nodes = [("t", 0, None, "user", "q", 1.0), ("t", 1, 0, "assistant", "a", 1.0), ("t", 2, 0, "assistant", "b", 0.0), ("t", 3, 1, "user", "c", 5.0), ("t", 4, 1, "user", "d", None), ("u", 7, 99, "user", "only", None)]
    messages = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    every = {(r["tree"], r["leaf"]): r for r in chat_format.format_branches(messages).collect()}
    assert set(every) == {("t", 2), ("t", 3), ("t", 4), ("u", 7)}
    assert every["t", 3]["formatted"] == "<s>[ROLE]user[/ROLE]q</s>[ROLE]assistant[/ROLE]a</s>[ROLE]user[/ROLE]c</s>"
    spans = every["t", 3]["loss_spans"]
    assert [every["t", 3]["formatted"][a:b] for a, b in spans] == ["a"]
    best = {(r["tree"], r["leaf"]) for r in chat_format.format_branches(messages, best=1).collect()}
    assert best == {("t", 3), ("u", 7)}
    deep = spark.range(70).selectExpr("'x' AS tree", "id AS node", "CASE WHEN id > 0 THEN id - 1 END AS parent", "'user' AS role", "cast(id AS string) AS text", "0.0D AS score")
    assert [r["n_turns"] for r in chat_format.format_branches(deep).collect()] == [70]
    ring = spark.createDataFrame([("r", 1, 2), ("r", 2, 1), ("r", 3, 1)], "tree string, node long, parent long")
    with pytest.raises(ValueError, match="circle"):
        chat_format.paths(ring)


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, folder, tokenizer):
    got = QUERIES["op2_token_counts"](spark, folder).toPandas()
    want = [(d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, _, _ in documents(folder)]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == Counter(want)


def shingles(text):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_ngram_jaccard(spark, folder):
    docs = documents(folder)
    sets = [shingles(t) for _, t, _, _ in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = union_find(len(docs), links, [d for d, *_ in docs])
    got = QUERIES["op3_ngram_jaccard"](spark, folder).toPandas()
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == Counter((d, len(s), c) for (d, *_), s, c in zip(docs, sets, least, strict=True))
    assert links


def test_ngram_jaccard_at_the_threshold(spark, tmp_path):
    words = [f"w{i}" for i in range(104)]
    rows, doc = [], 0
    for cut in range(5, 30):  # 100 shingles against 100 - cut of them and others
        for tail in (0, 3, 7):
            own = words[: 104 - cut] + [f"t{doc}x{k}" for k in range(tail)]
            rows.append((doc := doc + 1, " ".join(own), "en", "a"))
    rows.append((0, " ".join(words), "en", "a"))
    from helpers import write_documents

    folder = write_documents(tmp_path, rows)
    test_ngram_jaccard(spark, folder)


def targets(totals):
    names = sorted((k for k in totals if k is not None), key=lambda x: [ord(c) for c in x]) + [None] * (None in totals)
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, opened, out = 1.5 * sum(totals.values()), set(names), {}
    while opened:
        level = left / sum(weight[k] for k in opened)
        full = {k for k in opened if level * weight[k] > 2 * totals[k]}
        if not full:
            out |= {k: level * weight[k] for k in opened}
            break
        out |= {k: 2.0 * totals[k] for k in full}
        left -= sum(2 * totals[k] for k in full)
        opened -= full
    return out


def test_mixing(spark, folder):
    docs = documents(folder)
    sizes = [len([x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]) for _, t, _, _ in docs]
    totals = defaultdict(int)
    for (_, _, _, s), n in zip(docs, sizes, strict=True):
        totals[s] += n
    aims, source = targets(totals), {d: s for d, _, _, s in docs}
    got = QUERIES["op4_mixing"](spark, folder).toPandas()
    again = QUERIES["op4_mixing"](spark, folder).toPandas()
    assert rows_of(got, *got.columns) == rows_of(again, *got.columns)
    assert rows_of(got, "doc_id", "size", "source_size") == Counter((d, n, totals[s]) for (d, _, _, s), n in zip(docs, sizes, strict=True))
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] % got["size"].clip(lower=1) == 0).all()
    got["source"] = [source[None if d != d else d] for d in got["doc_id"].astype(object)]
    for name, own in got.groupby("source", dropna=False):
        aim = aims[None if name != name else name]
        assert own["target"].to_numpy() == pytest.approx(aim, rel=1e-9)
        assert abs(own["taken"].sum() - aim) <= (0.02 * aim if folder == SF else own["size"].max())


def test_toxicity(spark):
    folder = SF.replace("0.001", "0.01")
    got = QUERIES["op5_toxicity"](spark, folder).toPandas().rename(columns={"toxic": "said"}).merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    said, is_so = got["said"].to_numpy(bool), got["toxic"].to_numpy(bool)
    assert (said & is_so).sum() >= 0.9 * is_so.sum() and (said & ~is_so).sum() <= 0.05 * (~is_so).sum()


def test_toxicity_of_odd_rows(spark, odd):
    got = QUERIES["op5_toxicity"](spark, odd).toPandas()
    assert len(got) == len(documents(odd)) and got["p_toxic"].between(0, 1).all()


def test_exact_dedup(spark, folder):
    docs = documents(folder)
    keys = [hashlib.sha256((t or "").encode().lower()).hexdigest() for _, t, _, _ in docs]
    groups = defaultdict(list)
    for (d, *_), k in zip(docs, keys, strict=True):
        groups[k].append(d)
    best = {k: max((d for d in v if d is not None), default=None) for k, v in groups.items()}
    got = QUERIES["op6_exact_dedup"](spark, folder).toPandas()
    distinct = {(d, best[k], len(groups[k]), d == best[k], k) for (d, *_), k in zip(docs, keys, strict=True)}
    assert set(rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == distinct


def test_packing(spark, folder, tokenizer):
    docs = documents(folder)
    ids = defaultdict(list)
    for d, t, _, _ in docs:
        ids[d].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    got = QUERIES["op7_packing"](spark, folder).toPandas()
    pieces = Counter()
    for d, own in ids.items():
        for x in own:
            for start in range(0, len(x), 1024):
                part = np.array(x[start : start + 1024], dtype="<u4")
                pieces[d, start, len(part), zlib.crc32(part.tobytes()), len(x)] += 1
    assert rows_of(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == pieces
    filled = 0
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 1024
        filled += 1
    assert filled <= got["length"].sum() / 1024 * 1.05 + 1


def test_language_id(spark, odd):
    folder = SF.replace("0.001", "0.01")
    docs = documents(folder)
    got = QUERIES["op8_language_id"](spark, folder).toPandas().set_index("doc_id")
    assert all(got.loc[d, "held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in docs) and len(got) == len(docs)
    held = [(got.loc[d, "lang_pred"], lang) for d, t, lang, _ in docs if got.loc[d, "held_out"] and any(c.isalpha() for c in t)]
    assert np.mean([a == b for a, b in held]) >= 0.95
    rest = QUERIES["op8_language_id"](spark, odd).toPandas()
    none = {d for d, t, *_ in documents(odd) if not any(c.isalpha() for c in t or "")}
    assert {d for d, p in zip(rest["doc_id"], rest["lang_pred"], strict=True) if p == "und"} == none
    assert rest["score"].between(0, 1).all() and len(rest) == len(documents(odd))


KINDS = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24))


def test_secret_scan(spark, folder):
    want = []
    for d, t, _, _ in documents(folder):
        spans = sorted((m.start(), k, name, m.end()) for k, (name, shape, ok) in enumerate(KINDS) for m in shape.finditer(t or "") if ok(m))
        base = ",".join(f"{name}:{a}:{b}" for a, _, name, b in spans)
        want.append((d, *(sum(k == i for _, k, _, _ in spans) for i in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    got = QUERIES["op9_secret_scan"](spark, folder).toPandas()
    assert rows_of(got, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == Counter(want)
    for spans, digest in zip(got["spans"], got["base_sha256"], strict=True):
        base = [x for x in spans.split(",") if x and x.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == digest


def test_ownership(spark):
    from palimpsest.llm.secrets import scan

    rows = [(i, f"s{i % 5}", 'api_key="AbC123dEf456GhI789jK"') for i in range(5)] + [(9, "s1", 'api_key="Zz9Yy8Xx7Ww6Vv5Uu4Tt"'), (10, "s1", "token=changeme123456789")]
    got = {r["doc_id"]: {x["kind"] for x in r["added"]} for r in scan(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got == {**{i: {3} for i in range(5)}, 9: {4}, 10: set()}


def brute_vectors(vectors):
    good = [i for i, v in enumerate(vectors) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([vectors[i] for i in good], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    return {(good[i], good[j]) for i, j in np.argwhere(np.triu(cosine >= 0.95 + 1e-12, 1))}, {(good[i], good[j]) for i, j in np.argwhere(np.triu(cosine >= 0.95 - 1e-12, 1))}


def test_embeddings(spark, tmp_path):
    t = pq.read_table(f"{SF}/embeddings.parquet")
    ids, vectors = t.column("vec_id").to_pylist(), t.column("embedding").to_pylist()
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] * 64, [float("inf")] + [1.0] * 63, vectors[3], vectors[3], [2 * x for x in vectors[3]], [1.0, 2.0]]
    ids, vectors = [*ids, *range(10_000, 10_010)], [*vectors, *odd]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "links": pa.array(ids), "cls": pa.array(ids), "label": pa.array([None] * len(ids), pa.int32())}), tmp_path / "embeddings.parquet")
    got = frame_of(QUERIES["op10_embedding_near_dedup"](spark, str(tmp_path)), "vec_id")
    sure, may = brute_vectors([v if v is None or len(v) != 2 else None for v in vectors])
    degree = Counter(i for pair in sure for i in pair)
    most = Counter(i for pair in may for i in pair)
    assert len(got) == len(ids)
    assert all(got.loc[ids[i], "n_links"] <= most[i] for i in range(len(ids)))
    assert sum(got["n_links"]) >= 0.97 * sum(degree.values())
    least = union_find(len(ids), may, ids)
    for i, vec_id in enumerate(ids):  # found links are true ones, so found components lie within true ones
        assert least[i] <= got.loc[vec_id, "component_id"] <= vec_id
        assert got.loc[vec_id, "kept"] == (got.loc[vec_id, "component_id"] == vec_id)
    assert np.mean([got.loc[v, "component_id"] == least[i] for i, v in enumerate(ids)]) >= 0.97
