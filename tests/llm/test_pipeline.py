"""Each stage of the pipeline against a brute-force version of what it does to its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
from helpers import SF, union_find, write_documents
from test_contracts import shingles, targets

from palimpsest.llm.common import materialize
from palimpsest.llm.mixing import mix


def listed(frame):
    return frame.toPandas().astype(object).where(lambda x: x.notna(), None).to_dict("records")


def stages_of(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [(docs.columns, listed(docs))]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        out.append((docs.columns, listed(docs)))
    return out


def key(row, columns):
    return tuple(row[c] for c in columns)


def check(spark, folder):
    (columns, start), (_, spoken), (_, unique), (_, apart), (_, mixed), (_, packed) = found = stages_of(spark, folder)
    assert all(names == columns for names, _ in found[:-1])

    assert Counter(key(r, columns) for r in spoken) <= Counter(key(r, columns) for r in start)
    assert not any(r for r in spoken if not any(c.isalpha() for c in r["text"] or ""))

    best = {}
    for r in spoken:
        k = (r["text"] or "").encode().lower()
        best[k] = max((x for x in (best.get(k), r["doc_id"]) if x is not None), default=None)
    assert {r["doc_id"] for r in unique} == set(best.values())
    assert len(unique) == len(best)

    sets = [shingles(r["text"]) for r in unique]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = union_find(len(sets), links, [r["doc_id"] for r in unique])
    assert Counter(key(r, columns) for r in apart) == Counter(key(r, columns) for r, c in zip(unique, least, strict=True) if c == r["doc_id"])

    totals, taken = defaultdict(int), defaultdict(int)
    for r in apart:
        totals[r["source"]] += len(r["text"].split())
    for r in mixed:
        taken[r["source"]] += len(r["text"].split())
    times = Counter(key(r, columns) for r in mixed)
    assert set(times) <= {key(r, columns) for r in apart} and max(times.values(), default=0) <= 2
    longest = max((len(r["text"].split()) for r in apart), default=0)
    assert all(abs(taken[k] - aim) <= longest for k, aim in targets(totals).items())

    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    whole = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert tokens == {d: whole[d] * n for d, n in Counter(r["doc_id"] for r in mixed).items()}
    return found


def test_pipeline(spark):
    found = check(spark, SF)
    assert len(found[1][1]) >= 0.97 * len(found[0][1])
    assert Counter(tuple(r.items()) for r in listed(corpus_pipeline.run(spark, SF).drop("sequence_id", "offset"))) == Counter(tuple((k, v) for k, v in r.items() if k not in ("sequence_id", "offset")) for r in found[-1][1])


def test_pipeline_of_odd_rows(spark, odd):
    check(spark, odd)


def test_pipeline_of_an_empty_table(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_a_mixture_of_repeated_doc_ids_takes_what_mix_takes(spark, tmp_path):
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    rows = [(None if i % 9 == 0 else i % 40, words(i, 3 + i * 7 % 60), "en", "abc"[i % 3]) for i in range(160)]
    rows += [rows[5]] * 6 + [(1, None, "en", "a")]
    docs = spark.read.parquet(write_documents(tmp_path, rows) + "/documents.parquet")
    got = listed(corpus_pipeline.mixture(spark, docs, str(tmp_path)))
    totals, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in rows:
        totals[source] += len((text or "").split())
    for r in got:
        taken[r["source"]] += len((r["text"] or "").split())
    mixed = defaultdict(int)
    for r in listed(mix(docs)):
        mixed[r["source"]] += r["taken"]
    assert taken == mixed and all(abs(taken[k] - aim) <= 3 for k, aim in targets(totals).items())
    most = Counter((r[0], r[1]) for r in rows)
    assert all(n <= 2 * most[k] for k, n in Counter((r["doc_id"], r["text"]) for r in got).items())


def test_near_copies_without_doc_ids_leave_one(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    copy = lambda k: " ".join([*base[:k], "other", *base[k + 1 :]])
    rows = [(None, copy(k), "en", "a") for k in range(4)] + [(7, copy(20), "en", "a"), (7, copy(30), "en", "a"), (None, "quite another text of some words", "en", "a"), (3, None, "en", "a")]
    for some, kept in ((rows, {(7,), (None, "quite another text of some words"), (3,)}), (rows[:4], {(None,)})):
        docs = spark.read.parquet(write_documents(tmp_path, some) + "/documents.parquet")
        got = listed(corpus_pipeline.near(spark, docs, str(tmp_path)))
        assert len(got) == len(kept) and {r["doc_id"] for r in got} == {k[0] for k in kept}
