from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions import text as X
from palimpsest.functions.vectors import cosine_distance, deterministic_embedding
from palimpsest.operators import dedup, members, observe, paging, represent, search, transcript
from palimpsest.operators import work_queue as Q
from palimpsest.plans.filters import compile_filter
from palimpsest.sources import log

NOW = "2024-06-01 00:00:00"


def t(minutes):
    return datetime(2024, 5, 31, 23, 0) + timedelta(minutes=minutes)


def rows(frame, *names):
    return sorted(tuple(r[n] for n in names) for r in frame.collect())


def test_text_functions(spark):
    one = spark.createDataFrame([("  a\t b  c ", "Alpha beta, GAMMA", "alpha beta gamma delta", "é")], "a string, b string, c string, d string")
    got = one.select(X.collapse(F.col("a")).alias("a"), X.is_richer(F.col("c"), F.col("b")).alias("r"), X.is_richer(F.col("b"), F.col("c")).alias("q"), X.normalize(F.col("d")).alias("d"), X.bullet(F.lit("x\r\ny z")).alias("l"), X.utf16_length(F.lit("\U0001f600a")).alias("n"), X.content_hash(F.lit("a")).alias("h")).first()
    import hashlib

    assert (got["a"], got["r"], got["q"], got["d"], got["l"], got["n"]) == ("a b c", True, False, "é", "x y z", 3)
    assert got["h"] == hashlib.sha256("a".encode("utf-16-le")).hexdigest()


def test_each_letter_has_one_upper_case(spark):
    texts = ["weiß WEISS weiẞ ßß", "ŉ ﬁ fi ᾳ ᾼ αι", "\U0001f600ß", "", None, "abc é"]
    want = ["WEIẞ WEISS WEIẞ ẞẞ", "ŉ ﬁ FI ᾼ ᾼ ΑΙ", "\U0001f600ẞ", "", None, "ABC É"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r["u"] for r in frame.select("i", X.upper(F.col("t")).alias("u")).collect()] == want
    assert [None if x is None else X.upper_of(x) for x in texts] == want
    assert {r["n"] for r in frame.where("i = 0").select(F.size(X.words(F.col("t"))).alias("n")).collect()} == {3}
    assert not dedup.is_richer("weiss und mehr", "weiß") and dedup.is_richer("WEIẞ und mehr", "weiß")
    said = spark.createDataFrame([("weiß",), ("WEISS",)], "content string")
    assert [r["content"] for r in said.where(compile_filter('{"content": {"icontains": "ss"}}', "message")).collect()] == ["WEISS"]


def test_keys_and_configuration(spark):
    got = spark.range(1).select(K.work_unit_key(F.lit("w"), F.lit("a b"), F.lit("p")).alias("k"), K.resolve(("m", F.lit(None).cast("int")), ("s", F.lit(2))).alias("c"), K.json_flag(F.lit('{"observe_me": false}'), "observe_me").alias("f"), K.json_flag(F.lit('{"observe_me": "false"}'), "observe_me").alias("g"), K.backoff_seconds(F.lit(3)).alias("b"), K.backoff_seconds(F.lit(30)).alias("most"), K.valid_id(F.lit("a b")).alias("v")).first()
    assert got["k"] == "representation:w:~8787cc9dfd0216ba87644d9029ea5523:p"  # the hash of UTF-16LE bytes
    assert (got["c"]["value"], got["c"]["source"], got["f"], got["g"], got["b"], got["most"], got["v"]) == (2, "s", False, None, 20.0, 300.0, False)
    assert K.canonical_json('{"b": 1.00, "a": [true, {"d": 1e400, "c": null}]}') == '{"a":[true,{"c":null,"d":1e400}],"b":1.00}'
    assert K.request_hash("POST", "/x", ["a", "bc"], "{}") != K.request_hash("POST", "/x", ["ab", "c"], "{}")


def test_cosine_and_embeddings(spark):
    got = spark.range(1).select(cosine_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"), cosine_distance(F.array(F.lit(2.0)), F.array(F.lit(2.0))).alias("same")).first()
    assert (got["zero"], str(got["same"])) == (1.0, "0.0")
    vector = deterministic_embedding("hello", 20)
    assert len(vector) == 20 and abs(sum(x * x for x in vector) - 1) < 1e-5 and vector == deterministic_embedding("hello", 20)


def test_pages(spark):
    frame = spark.range(10).withColumnRenamed("id", "seq")
    assert [r["seq"] for r in paging.page(frame, ("seq",), 2, 4).collect()] == [4, 5, 6, 7]
    assert [r["seq"] for r in paging.page(frame, ("seq",), 1, 3, reverse=True).collect()] == [9, 8, 7]
    assert paging.page(frame, ("seq",), 9, 4).count() == 0
    assert paging.totals(frame, 4).first()["pages"] == 3
    assert [r["seq"] for r in paging.each_page(frame, ("seq",))] == list(range(10))
    with pytest.raises(ValueError):
        paging.page(frame, ("seq",), 1, 101)


def test_nearest_takes_the_block_and_the_threshold(spark):
    schema = "id string, c string, embedding array<float>"
    base = spark.createDataFrame([("a", "x", [1.0, 0.0]), ("b", "x", [1.0, 0.1]), ("d", "y", [1.0, 0.0]), ("e", "x", None)], schema)
    probes = spark.createDataFrame([("p", "x", [1.0, 0.0]), ("q", "x", [0.0, 1.0]), ("r", "z", [1.0, 0.0])], "probe string, c string, embedding array<float>")
    assert rows(search.nearest(probes, base, ["c"], 0.05), "probe", "id") == [("p", "a")]
    assert [r["id"] for r in search.knn(base, [1.0, 0.0], 2).collect()] == ["a", "d"]
    assert [r["id"] for r in search.knn(base, [1.0, 0.0], 9, most=0.001).collect()] == ["a", "d"]


FACT = "fact_id string, workspace string, observer string, observed string, session string, content string, embedding array<float>, position bigint, source_ids array<string>"


def test_dedup_against_the_store_and_within_the_batch(spark):
    store = spark.createDataFrame([("c1", "w", "o", "p", "s", "likes tea", [1.0, 0.0]), ("c2", "w", "o", "p", "s", "likes tea", [1.0, 0.0]), ("c3", "w", "o", "p", "other", "has a dog", [0.0, 1.0])], "id string, workspace string, observer string, observed string, session string, content string, embedding array<float>")
    facts = spark.createDataFrame([
        ("f1", "w", "o", "p", "s", "likes tea", [1.0, 0.0], 1, ["m1"]),
        ("f2", "w", "o", "p", "s", "likes tea and milk", [1.0, 0.01], 2, ["m2"]),
        ("f3", "w", "o", "p", "s", "has a dog", [0.0, 1.0], 3, ["m3"]),
        ("f4", "w", "o", "p", "s", "has a big dog", [0.01, 1.0], 4, ["m4", "m3"]),
        ("f5", "w", "o", "p", "s", "walks", [-1.0, 1.0], 5, ["m5"]),
    ], FACT)
    matched = dedup.match_existing(facts, store)
    assert rows(matched.where("match_id IS NOT NULL"), "fact_id", "match_id") == [("f1", "c1"), ("f2", "c1")]
    got = dedup.fold(matched)
    assert sorted((r["outcome"], r["id"], r["content"], r["source_ids"]) for r in got.collect()) == [("insert", None, "has a big dog", ["m3", "m4"]), ("insert", None, "walks", ["m5"]), ("replace", "c1", "likes tea and milk", None)]
    counts = dedup.times_derived(store.withColumn("times_derived", F.lit(1)), got)
    assert rows(counts, "id", "times_derived") == [("c1", 2), ("c2", 1), ("c3", 1)]
    assert dedup.fold(matched.where("false")).count() == 0


def test_observers_by_interval(spark):
    said = spark.createDataFrame([("m1", "s", "a", t(10), None), ("m2", "s", "a", t(20), None), ("m3", "s", "b", t(10), False), ("m4", "q", "a", t(10), True)], "id string, session string, peer string, created_at timestamp_ntz, observe_me boolean")
    people = spark.createDataFrame([("s", "a", t(0), None, True), ("s", "b", t(5), t(20), True), ("s", "c", t(10), None, True), ("s", "d", t(1), None, None)], "session string, peer string, joined_at timestamp_ntz, left_at timestamp_ntz, observe_others boolean")
    assert {r["id"]: r["observers"] for r in observe.observers(said, people, ["session"]).collect()} == {"m1": ["a", "b", "c"], "m2": ["a", "c"], "m4": ["a"]}


ITEM = "id bigint, unit string, session string, token_count int, status int, attempts int, available_at timestamp_ntz, created_at timestamp_ntz"


def test_queue(spark):
    items = spark.createDataFrame([
        (1, "u", "s", 300, 0, 0, t(0), t(50)), (2, "u", "s", 300, 0, 0, t(0), t(50)), (3, "u", "s", 900, 1, 1, t(100), t(50)), (4, "u", "s", 9, 0, 0, t(0), t(50)),
        (5, "v", "s", 10, 0, 0, t(0), t(50)), (6, "w", "s", 10, 0, 0, t(0), t(30)), (7, "x", None, 2000, 0, 0, t(0), t(0)), (8, "y", "s", 600, 0, 4, t(90), t(0)), (9, "z", "s", 5, 2, 1, t(0), t(0)),
    ], ITEM)
    leases = spark.createDataFrame([("x", "o", 7, t(60)), ("u", "o", 5, t(59))], "unit string, owner string, token bigint, expires_at timestamp_ntz")
    assert rows(Q.claimable(items, NOW), "id") == [(1,), (2,), (5,), (6,), (7,)]
    assert rows(Q.due_units(items, leases, NOW), "unit", "tokens") == [("u", 600), ("w", 10)]
    given, batch = Q.acquire(items, leases, NOW, "me")
    assert rows(given, "unit", "token") == [("u", 8), ("w", 9)]
    assert rows(batch, "id", "attempts") == [(1, 1), (2, 1), (6, 1)]
    big = items.withColumn("token_count", F.lit(600))
    assert rows(Q.token_batch(big.where("unit = 'u'")), "id") == [(1,)]
    assert rows(Q.failed(items.where("id IN (3, 8)"), NOW, "e" * 5000, most=4).withColumn("n", F.length("error")), "id", "status", "n") == [(3, 1, 4000), (8, 3, 4000)]
    assert rows(Q.released(items.where("id IN (1, 8)"), NOW), "id", "attempts") == [(1, 0), (8, 3)]
    status = {r["session"]: (r["completed"], r["dead_lettered"], r["in_progress"], r["pending"]) for r in Q.status(items, leases, NOW).collect()}
    assert status == {"s": (1, 0, 0, 7), None: (1, 0, 1, 7)}
    back = Q.backlog(items, leases, NOW).first()
    assert (back["due_units"], back["oldest_open"]) == (2, t(0))
    assert Q.fenced(items.withColumn("token", F.lit(7)), leases).count() == 1
    done = Q.completed(items.where("id = 1"), NOW)
    assert Q.pruned(done, "2024-06-08 00:00:00").count() == 0 and Q.pruned(done, "2024-06-07 23:59:59").count() == 1
    assert rows(Q.renewed(leases, "o", NOW), "unit", "expires_at") == [("u", t(59)), ("x", t(65))]


def test_transcripts_and_facts(spark):
    said = spark.createDataFrame([(str(i), "s", i, "p" if i > 8 else "q", f"text {i}", 10) for i in range(1, 11)], "id string, session string, seq bigint, peer string, content string, token_count int")
    targets = said.where("seq IN (9, 10)")
    window = transcript.context_window(said, targets, budget=45, context=4)
    assert rows(window, "seq", "target") == [(7, False), (8, False), (9, True), (10, True)]
    stops = said.withColumn("token_count", F.when(F.col("seq") == 8, 100).otherwise(F.col("token_count")))
    assert rows(transcript.context_window(stops, targets, budget=60, context=4), "seq") == [(9,), (10,)]
    from datetime import datetime as when
    import json

    said = said.withColumn("created_at", F.lit(when(2024, 5, 1, 2, 3, 4, 56)).cast("timestamp_ntz"))
    batches = spark.createDataFrame([("u", "s", 'p"x', ["9", "10", "gone"], 3, ["a", 'b"'], "sys"), ("v", "s", "q", ["2"], 1, [], "")], "unit string, session string, target_peer string, targets array<string>, n int, instructions array<string>, system string")
    made = {r["unit"]: json.loads(r["transcript"]) for r in transcript.transcripts(said, batches, 10_000, context=1).collect()}
    assert made["u"]["target_peer"] == 'p"x' and made["u"]["message_instructions"] == ["a", 'b"'] and "message_instructions" not in made["v"]
    assert [m.get("id") for m in made["u"]["messages"]] == [None, None, "9", "10"] and list(made["u"]["messages"][2]) == ["id", "speaker", "role", "sent_at", "content"]
    assert made["u"]["messages"][0] == {"speaker": "q", "role": "context", "sent_at": "2024-05-01T02:03:04.0000560+00:00", "content": "text 7"}
    assert [m.get("id") for m in made["v"]["messages"]] == [None, "2"]
    tight = transcript.transcripts(said, batches.where("unit = 'u'"), sum(map(len, (json.dumps(m, separators=(",", ":")) for m in made["u"]["messages"][1:]))) + 3 + len('{"target_peer":"p\\"x","message_instructions":["a","b\\""],"messages":[]}'), context=9)
    assert [m["content"] for m in json.loads(tight.first()["transcript"])["messages"]] == ["text 8", "text 9", "text 10"]
    facts = spark.createDataFrame([("f1", "u", "a", ["2", "1", "2"]), ("f2", "u", " ", ["1"]), ("f3", "u", "b", ["1", "9"]), ("f4", "u", "c", [])], "fact_id string, unit string, content string, source_ids array<string>")
    marks = spark.createDataFrame([("u", "1", 0), ("u", "2", 1)], "unit string, id string, place int")
    valid = transcript.valid_facts(facts, marks)
    assert [(r["fact_id"], r["source_ids"]) for r in valid.collect()] == [("f1", ["1", "2"])]
    seen = spark.createDataFrame([("1", ["a", "b"]), ("2", ["b"])], "id string, observers array<string>")
    assert rows(transcript.route_facts(valid, seen), "fact_id", "observer") == [("f1", "b")]


def test_representation(spark):
    base = spark.createDataFrame([(i, "s", i % 2, f"fact\n{i}", 10 - i, i) for i in range(6)], "id bigint, session string, level int, content string, times_derived int, created_at bigint")
    merged = represent.branches(base, 3, search=spark.createDataFrame([(4, 1)], "id bigint, place int"))
    assert rows(merged, "id", "rank") == [(0, 1), (1, 1), (4, 0)]
    text = represent.render(merged, ("Explicit", "Deductive")).first()["representation"]
    assert text == "## Explicit\n\n- fact 4\n- fact 0\n\n## Deductive\n\n- fact 1\n"
    assert represent.visible(base, []).count() == 0 and represent.visible(base, ["s"]).count() == 3 and represent.visible(base, None).count() == 6
    grants = spark.createDataFrame([("a", "w", "workspace"), ("a", None, "admin"), ("b", None, "workspace")], "principal string, workspace string, role string")
    assert rows(represent.allowed_workspaces(grants), "principal", "every") == [("a", False), ("b", True)]
    links = spark.createDataFrame([("x", ["b", "gone", "a"]), ("y", [])], "id string, source_ids array<string>")
    known = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {r["id"]: r["source_ids"] for r in represent.resolved_sources(links, known).collect()} == {"x": ["b", "a"], "y": []}


MEMBER = "workspace string, session string, peer string, observe_me boolean, observe_others boolean, joined_at timestamp_ntz, left_at timestamp_ntz"


def test_memberships(spark):
    have = spark.createDataFrame([("w", "s", "a", None, True, t(0), None), ("w", "s", "b", None, True, t(0), t(1)), ("w", "s", "c", None, True, t(0), None), ("w", "q", "c", None, True, t(0), None)], MEMBER)
    asked = spark.createDataFrame([("w", "s", "a", False, False), ("w", "s", "b", None, False), ("w", "s", "d", True, True)], "workspace string, session string, peer string, observe_me boolean, observe_others boolean")
    now = datetime(2024, 6, 1)
    got = {(r["session"], r["peer"]): (r["observe_others"], r["joined_at"], r["left_at"]) for r in members.set_peers(have, asked, NOW).collect()}
    assert got == {("s", "a"): (True, t(0), None), ("s", "b"): (False, now, None), ("s", "c"): (True, t(0), now), ("s", "d"): (True, now, None), ("q", "c"): (True, t(0), None)}


def test_appends(spark):
    said = spark.createDataFrame([("s", 1, 1, "x"), ("s", 1, 0, "y"), ("s", 0, 5, "z"), ("q", 0, 0, "n")], "session string, batch int, position int, content string")
    last = spark.createDataFrame([("s", 7)], "session string, last_seq bigint")
    assert rows(members.number_messages(said, last), "session", "seq", "content") == [("q", 1, "n"), ("s", 8, "z"), ("s", 9, "y"), ("s", 10, "x")]
    asked = spark.createDataFrame([("w", "a", 1), ("w", "a", 0), ("w", "b", 2), ("w", "c", 3)], "workspace string, key_hash string, position int")
    have = spark.createDataFrame([("w", "b", t(61)), ("w", "c", t(60))], "workspace string, key_hash string, expires_at timestamp_ntz")
    assert rows(members.unseen_requests(asked, have, NOW), "key_hash", "position") == [("a", 0), ("c", 3)]
    from palimpsest.operators import conclusions

    waiting = spark.createDataFrame([("1", "x", None, 0, None), ("2", "y", None, 0, None), ("3", "z", [1.0], 1, None)], "id string, content string, embedding array<float>, embedding_state int, deleted_at timestamp_ntz")
    made = spark.createDataFrame([("1", "x", [2.0]), ("2", "changed", [2.0]), ("3", "z", [2.0])], "id string, content string, vector array<float>")
    assert rows(conclusions.save_embeddings(waiting, made), "id", "embedding") == [("1", [2.0]), ("2", None), ("3", [1.0])]


def test_log_publishes_batches_once(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    ddl = "id string, at int, value string"
    assert log.read_log(spark, root, "rows", ddl).count() == 0
    first = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], ddl)
    assert log.publish(spark, root, "b1", {"rows": first})
    assert not log.publish(spark, root, "b1", {"rows": first})
    assert log.publish(spark, root, "b2", {"rows": spark.createDataFrame([("a", 2, None), ("c", 2, "z")], ddl)})
    spark.createDataFrame([("ghost", 9, "g")], ddl).write.parquet(f"{root}/data/b3-{'0' * 32}/rows")
    seen = log.read_log(spark, root, "rows", ddl)
    assert rows(seen, "id", "at", "batch_id") == [("a", 1, "b1"), ("a", 2, "b2"), ("b", 1, "b1"), ("c", 2, "b2")]
    assert sorted((r["id"], r["value"]) for r in log.latest_values(seen, ["id"], "at", ["value"]).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]
    asked = spark.createDataFrame([("a", "new", 0), ("d", "one", 1), ("d", "two", 0)], "name string, metadata string, position int")
    there = spark.createDataFrame([("a", "old")], "name string, metadata string")
    assert rows(log.create_missing(there, asked, ["name"]), "name", "metadata") == [("a", "old"), ("d", "two")]


def test_queue_as_a_stream(spark, tmp_path):
    from palimpsest.streaming.work_queue import batches, cut, start_available

    assert cut([600, 600]) == 1 and cut([2000]) == 1 and cut([500, 524, 1]) == 2 and cut([]) == 0
    source = str(tmp_path / "in")
    schema = "unit string, id bigint, token_count int"
    for part in ([("u", 1, 300), ("v", 2, 10)], [("u", 3, 300), ("u", 4, 900), ("v", 5, 2000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = batches(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    query = start_available(spark, stream.writeStream.format("memory").queryName("queue_batches").option("checkpointLocation", str(tmp_path / "check")).outputMode("append"))
    assert query.awaitTermination(60)
    got = spark.table("queue_batches")
    assert rows(got, "unit", "batch", "ids", "reason") == [("u", 1, [1, 3], "tokens"), ("u", 2, [4], "tokens"), ("v", 1, [2], "tokens"), ("v", 2, [5], "tokens")]


def test_old_items_leave_a_stream_by_age(spark, tmp_path):
    import time

    from palimpsest.streaming.work_queue import batches

    source, schema = str(tmp_path / "in"), "unit string, id bigint, token_count int"
    spark.createDataFrame([("u", 1, 5), ("v", 2, 600)], schema).coalesce(1).write.mode("append").parquet(source)
    stream = batches(spark.readStream.schema(schema).parquet(source), minutes=0.05)
    query = stream.writeStream.format("memory").queryName("old_batches").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        end = time.monotonic() + 50
        while spark.table("old_batches").count() < 2 and time.monotonic() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert rows(spark.table("old_batches"), "unit", "batch", "ids", "reason") == [("u", 1, [1], "age"), ("v", 1, [2], "tokens")]


def test_messages_meet_lists_of_members(spark, monkeypatch):
    """Observers are made of lists: no row for each of a message's observers is shuffled (F2, F3)."""
    said = spark.createDataFrame([(f"m{i}", "st"[i % 2] if i % 5 else None, f"p{i % 9}", t(i), None if i % 7 else False) for i in range(40)], "id string, session string, peer string, created_at timestamp_ntz, observe_me boolean")
    people = spark.createDataFrame([("s", f"p{i % 8}", t(i), t(i + 9) if i % 3 else None, i % 4 > 0) for i in range(24)], "session string, peer string, joined_at timestamp_ntz, left_at timestamp_ntz, observe_others boolean")
    ins = people.collect()
    want = {m["id"]: sorted({m["peer"]} | {p["peer"] for p in ins if p["session"] == m["session"] and p["observe_others"] and p["joined_at"] <= m["created_at"] and (p["left_at"] is None or m["created_at"] < p["left_at"])}) for m in said.collect() if m["observe_me"] is not False}
    for most in (4, 1024):
        monkeypatch.setattr(observe, "MEMBERS", most, raising=False)
        seen = observe.observers(said, people, ["session"])
        assert {r["id"]: r["observers"] for r in seen.collect()} == want
    facts = spark.createDataFrame([(f"f{i}", [f"m{i}", f"m{i + 2}", f"m{i + 4}"]) for i in range(40)], "fact_id string, source_ids array<string>")
    routed = transcript.route_facts(facts, seen)
    assert {(r["fact_id"], r["observer"]) for r in routed.collect()} == {(f"f{i}", o) for i in range(40) for o in set(want.get(f"m{i}", [])) & set(want.get(f"m{i + 2}", [])) & set(want.get(f"m{i + 4}", []))}
    plan = routed._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(observers" not in plan and "collect_set" not in plan


def test_rows_go_to_their_fact_before_lists_are_gathered(spark):
    """Lists aren't sorted into groups on the way to their fact, where they would spill (F3)."""
    people = [f"p{i}" for i in range(12)]
    seen = spark.createDataFrame([(f"m{i}", [p for k, p in enumerate(people) if (i + k) % 5]) for i in range(300)] + [("none", [None, "p1"]), ("few", [])], "id string, observers array<string>")
    sources = [[f"m{i}", *[f"m{i + k * k}" for k in range(1, i % 4 + 1)]] for i in range(250)] + [["m0", f"m{i}"] for i in range(1, 50)] + [["none", "m1"], ["none"], ["few", "m1"], ["m1", "strange"]]
    facts = spark.createDataFrame([(f"f{i}", x) for i, x in enumerate(sources)], "fact_id string, source_ids array<string>")
    routed = transcript.route_facts(facts, seen)
    of = {r["id"]: set(r["observers"]) for r in seen.collect()}
    want = sorted((f"f{i}", o) for i, x in enumerate(sources) for o in set.intersection(*[of.get(s, set()) for s in x]) if o is not None)
    assert rows(routed, "fact_id", "observer") == want
    plan = routed._jdf.queryExecution().executedPlan().toString().splitlines()
    first = [k for k, line in enumerate(plan) if "partial_collect_list(observers" in line]
    assert first and all("ObjectHashAggregate" in plan[k - 1] for k in first)  # no exchange after it
