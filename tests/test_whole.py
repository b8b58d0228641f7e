"""Queries that take every row of their table."""

import random
from collections import defaultdict

import pyarrow.parquet as pq

from palimpsest.operators import dedup, search
from palimpsest.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_event_has_its_observers(spark):
    events = pq.read_table(f"{SF}/events.parquet").to_pylist()
    joined, left = {}, {}
    for e in sorted(events, key=lambda e: e["ts"]):
        if e["event_type"] == "signup":
            joined.setdefault(e["user_id"], e["ts"])
        elif e["event_type"] == "error":
            left[e["user_id"]] = e["ts"]
    want, rooms = {}, defaultdict(list)
    for e in events:
        u, at = e["user_id"], e["ts"]
        want[str(e["event_id"])] = {str(m) for m in joined if m // 16 == u // 16 and joined[m] <= at and (m not in left or at < left[m])} | {str(u)}
        rooms[u // 16].append(e["event_id"])
    assert {r["id"]: set(r["observers"].split(",")) for r in QUERIES["observer_interval_join_rooms"](spark, SF).collect()} == want
    assert {r["id"] for r in QUERIES["enqueue_work_rooms"](spark, SF).collect()} == set(want)
    facts = {(str(a), o) for ids in rooms.values() for a, b in zip(sorted(ids), sorted(ids)[1:], strict=False) for o in want[str(a)] & want[str(b)]}
    assert {(r["fact_id"], r["observer"]) for r in QUERIES["fact_routing_rooms"](spark, SF).collect()} == facts


def test_every_document_is_asked_for_its_oldest_copy(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang", "text"]).to_pylist()
    oldest = {}
    for d in docs:
        k = (d["lang"], d["text"] or "")
        oldest[k] = min(d["doc_id"], oldest.get(k, d["doc_id"]))
    got = {r["fact_id"]: r["id"] for r in QUERIES["exact_match_oldest_all"](spark, SF).collect()}
    assert got == {d["doc_id"]: oldest[d["lang"], d["text"] or ""] for d in docs}


def test_copies_do_not_meet_as_pairs(spark):
    frame = spark.sql("SELECT id, if(id = 0, NULL, 's') AS session, if(id = 5, NULL, 'copy') AS content FROM range(3000)")
    found = dedup.exact_matches(frame.withColumnRenamed("id", "fact_id"), frame, ["session"])
    assert [tuple(r) for r in found.groupBy("id").count().orderBy("id").collect()] == [(0, 1), (1, 2998)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join"):]
    assert "min(id" in join  # each side's copies are one row before they are joined


SCOPE = ("workspace", "observer", "observed", "session")
FACT = "fact_id string, workspace string, observer string, observed string, session string, content string, embedding array<float>, position bigint, source_ids array<string>, match_id string, match_content string"


def folded(facts, most):
    """Every scope's facts, one after the other."""
    out = []
    for scope in {tuple(f[k] for k in SCOPE) for f in facts}:
        inserts, matched = [], {}
        for f in sorted((f for f in facts if tuple(f[k] for k in SCOPE) == scope), key=lambda f: f["position"]):
            v = dedup.np.array(f["embedding"] or [], dtype=dedup.np.float64)
            if f["match_id"] is not None:
                old = matched.setdefault(f["match_id"], ["corroborate", f["position"], f["match_content"], None])
                if dedup.is_richer(f["content"], old[2]):
                    old[0], old[2], old[3] = "replace", f["content"], f["content"]
                continue
            held = next((x for x in inserts if dedup._same((x[1], x[2]), (f["content"], v), most)), None)
            if held is None:
                inserts.append([f["position"], f["content"], v, dict.fromkeys(f["source_ids"])])
                continue
            held[3] |= dict.fromkeys(f["source_ids"])
            if dedup.is_richer(f["content"], held[1]):
                held[1:3] = f["content"], v
        out += [(*scope, "insert", None, p, c, tuple(s)) for p, c, _, s in inserts] + [(*scope, o, i, p, c, None) for i, (o, p, _, c) in matched.items()]
    return sorted(out, key=str)


def test_fold_equals_one_fact_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 16)
    r = random.Random(7)
    words = "a b c d e f".split()
    facts = []
    for i in range(400):
        m = r.choice([None, None, None, "m1", "m2"])
        angle = r.random() * 6.28
        content = " ".join(r.sample(words, r.randint(1, 4)))
        near = r.choice([None, [0.0, 0.0], [1.0, 2.0, 3.0], *[[dedup.np.cos(angle) * (1 + i % 3), dedup.np.sin(angle)]] * 6])
        vector = None if near is None else [float(x) for x in near]
        facts.append((f"f{i}", "w", "o", r.choice("pq"), r.choice([None, "s"]), content + (f" {i}" if i % 3 else ""), vector, i, [f"x{r.randint(0, 30)}", f"y{i}"], m, m and {"m1": "a", "m2": "b c"}[m]))
    frame = spark.createDataFrame(facts, FACT)
    for most in (0.00001, 0.05):
        got = sorted((tuple(x[k] for k in SCOPE) + (x["outcome"], x["id"], x["position"], x["content"], None if x["source_ids"] is None else tuple(x["source_ids"])) for x in dedup.fold(frame, most).collect()), key=str)
        assert got == folded([x.asDict() for x in frame.collect()], most)


def test_nearest_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 8)
    r = random.Random(3)
    vectors = [[r.gauss(0, 1) for _ in range(3)] for _ in range(120)]
    frame = spark.createDataFrame([(i, "xy"[i % 2], v) for i, v in enumerate(vectors + vectors[:40])], "id int, c string, embedding array<float>").cache()
    probes = frame.where("id % 3 = 0").withColumnRenamed("id", "probe")
    a, b = probes.alias("a"), frame.alias("b")
    pairs = a.join(b, dedup.F.expr("a.c = b.c")).withColumn("d", search.cosine_distance(dedup.F.col("b.embedding"), dedup.F.col("a.embedding"))).where("d <= 0.2")
    want = {x["probe"]: (x["x"]["d"], x["x"]["id"]) for x in pairs.groupBy("a.probe").agg(dedup.F.min(dedup.F.struct("d", "b.id")).alias("x")).collect()}
    assert {x["probe"]: (x["distance"], x["id"]) for x in search.nearest(probes, frame, ["c"], 0.2).collect()} == want


def test_unlike_facts_of_a_scope_do_not_meet_in_one_group(spark):
    frame = spark.sql("SELECT string(id) AS fact_id, 'w' AS workspace, 'o' AS observer, 'p' AS observed, 's' AS session, string(id) AS content, array(float(cos(id)), float(sin(id))) AS embedding, id AS position, array('m') AS source_ids, string(NULL) AS match_id, string(NULL) AS match_content FROM range(40)")
    got = dedup.fold(frame, most=1e-7)
    assert got.count() == 40
    groups = [x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapGroupsInPandas" in x]
    assert groups and not [x for x in groups if "FlatMapGroupsInPandas [workspace" in x]


def test_a_text_is_embedded_once_for_the_fold(spark, monkeypatch):
    matched = []
    monkeypatch.setattr(dedup, "fold", lambda facts: matched.append(facts) or facts.withColumns({"outcome": dedup.F.lit("insert"), "id": dedup.F.lit("")}))
    QUERIES["dedup_fold"](spark, SF)
    plan = matched[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "ArrowEvalPython" not in plan  # vectors are read, not made anew by each branch


def test_tiles_pass_rows_that_are_near_nothing():
    cosine = dedup.np.array([[0.1, 0.2], [0.99, float("nan")], [float("nan")] * 2, [-1.0, 0.95]])
    at, distance = search._close(cosine, 0.05)
    assert at.tolist() == [1, 3] and distance[1].tolist() == [2.0, 1 - 0.95]
