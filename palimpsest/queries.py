"""Queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions import text as X
from palimpsest.functions.levels import level_name
from palimpsest.functions.vectors import embed
from palimpsest.operators import dedup, members, observe, paging, represent, search, transcript
from palimpsest.operators import work_queue as Q
from palimpsest.plans.filters import compile_filter
from palimpsest.registry import QUERIES, SQL, query
from palimpsest.scratch import materialize
from palimpsest.sources import log, views as V

NOW = f"TIMESTAMP '{V.NOW}'"


def _filtered(name: str, request: str, where: str, resource: str = "message", view: str = "messages", columns: str = "id") -> None:
    """A filter over one of the message views, beside the condition that it means."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = V.messages(spark, sf_dir) if view == "messages" else V.event_messages(spark, sf_dir)
        return rows.where(compile_filter(request, resource)).select(*columns.split(", "))

    QUERIES[name] = run
    SQL[name] = f"WITH {V.MESSAGES if view == 'messages' else V.EVENT_MESSAGES} SELECT {columns} FROM {view} WHERE {where}"


@query(f"WITH {V.MESSAGES} SELECT id, session, seq, peer, content FROM messages WHERE peer = 'user' AND contains(content, 'th') ORDER BY session, seq LIMIT 50")
def list_page(spark, sf_dir):
    rows = V.messages(spark, sf_dir).where(compile_filter('{"peer_id": "user", "content": {"contains": "th"}}', "message"))
    return paging.page(rows, ("session", "seq")).select("id", "session", "seq", "peer", "content")


_filtered("filter_text_eq", '{"peer_id": "assistant"}', "peer = 'assistant'")
_filtered("filter_text_ne", '{"peer_id": {"ne": "assistant"}}', "peer IS DISTINCT FROM 'assistant'")
_filtered("filter_text_in", '{"peer_id": ["system", "user", null]}', "peer IN ('system', 'user') OR peer IS NULL")
_filtered("filter_contains", '{"content": {"contains": "tion"}}', "contains(content, 'tion')")
_filtered("filter_icontains", '{"content": {"icontains": "THE AN"}}', "contains(upper(content), 'THE AN')")
_filtered("filter_number_range", '{"token_count": {"gte": "200", "lt": 5e2}}', "token_count >= 200 AND token_count < 500")
_filtered("filter_number_beyond", '{"token_count": {"lt": 1e400, "gt": 150.0}}', "token_count > 150")
_filtered("filter_wildcard_and_unknown", '{"peer_id": "*", "colour": 3, "AND": [], "NOT": []}', "true")
_filtered("filter_match_none", '{"OR": []}', "false")
_filtered("filter_null_checks", '{"session_id": {"ne": null}, "NOT": [{"peer_id": null}]}', "session IS NOT NULL AND peer IS NOT NULL")
_filtered("filter_and_or_not", '{"OR": [{"peer_id": "system"}, {"AND": [{"peer_id": "user"}, {"token_count": {"gt": 300}}]}], "NOT": [{"content": {"contains": "x"}}]}', "(peer = 'system' OR (peer = 'user' AND token_count > 300)) AND NOT contains(content, 'x')")
_filtered("filter_timestamp_range", '{"created_at": {"gte": "2024-01-10", "lt": "2024-01-20T12:30:00+02:00"}}', "created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20 10:30:00'", view="event_messages")
_filtered("meta_number_eq", '{"metadata": {"k": 7.0}}', "k = 7", view="event_messages")
_filtered("meta_number_ne", '{"metadata": {"k": {"ne": 7}}}', "k IS DISTINCT FROM 7", view="event_messages")
_filtered("meta_number_range", '{"metadata": {"k": {"gt": 10, "lte": 5e1}}}', "k > 10 AND k <= 50", view="event_messages")
_filtered("meta_in", '{"metadata": {"k": {"in": [1, 2.0, "3", null]}}}', "k IN (1, 2) OR k IS NULL", view="event_messages")
_filtered("meta_set", '{"metadata": {"k": "*"}}', "k IS NOT NULL", view="event_messages")
_filtered("meta_unset", '{"metadata": {"absent": null, "k": {"ne": "7"}}}', "true", view="event_messages")
_filtered("meta_contains_object", '{"metadata": {"contains": {"k": 3}}}', "k = 3", view="event_messages")

_SESSIONS = f"WITH {V.ORDER_SESSIONS}, {V.ORDER_MEMBERS}"


def _sessions(name: str, request: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return members.where_sessions(V.order_sessions(spark, sf_dir), V.order_members(spark, sf_dir), request).select("name")

    QUERIES[name] = run
    SQL[name] = f"{_SESSIONS} SELECT name FROM order_sessions s WHERE {where}"


_HAS = "EXISTS (SELECT 1 FROM order_members m WHERE m.session = s.name AND active AND peer = '3')"
_sessions("session_is_active", '{"is_active": true}', "is_active")
_sessions("session_is_inactive", '{"is_active": {"ne": true}}', "NOT is_active")
_sessions("session_member_exists", '{"peer_id": "3"}', _HAS)
_sessions("session_member_ne", '{"peer_id": {"ne": "3"}}', f"NOT {_HAS}")
_sessions("session_without_members", '{"peer_id": null}', "NOT EXISTS (SELECT 1 FROM order_members m WHERE m.session = s.name AND active)")


@query(f"{_SESSIONS} SELECT name, is_active FROM order_sessions s WHERE {_HAS}")
def sessions_of_peer(spark, sf_dir):
    return members.sessions_with(V.order_sessions(spark, sf_dir), V.order_members(spark, sf_dir), "3").select("name", "is_active")


@query(f"{_SESSIONS} SELECT name, is_active FROM order_sessions s WHERE NOT {_HAS}")
def sessions_without_peer(spark, sf_dir):
    return members.sessions_without(V.order_sessions(spark, sf_dir), V.order_members(spark, sf_dir), "3").select("name", "is_active")


@query(f"WITH {V.MESSAGES} SELECT session, seq, peer, token_count FROM messages ORDER BY seq DESC, CAST(session AS BIGINT) DESC LIMIT 20 OFFSET 40")
def list_page_reverse(spark, sf_dir):
    rows = V.messages(spark, sf_dir).withColumn("s", F.col("session").cast("bigint"))
    return paging.page(rows, ("seq", "s"), number=3, size=20, reverse=True).select("session", "seq", "peer", "token_count")


@query(f"WITH {V.MESSAGES} SELECT count(*) AS total, 20 AS size, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM messages WHERE peer = 'user'")
def page_totals(spark, sf_dir):
    return paging.totals(V.messages(spark, sf_dir).where(compile_filter('{"peer_id": "user"}', "message")), 20)


@query(f"WITH {V.MESSAGES} SELECT id, seq, content FROM messages WHERE session = '3' AND seq BETWEEN 2 AND 5")
def seq_range(spark, sf_dir):
    return paging.seq_range(V.messages(spark, sf_dir).where(F.col("session") == "3"), 2, 5).select("id", "seq", "content")


_PROBE = [round(0.01 * ((i * 37) % 64 - 31.5), 4) for i in range(64)]
_DISTANCE = "1 - list_cosine_similarity(embedding::DOUBLE[], {0}) + 0.0"
_PROBE_SQL = "[" + ", ".join(map(str, _PROBE)) + "]::DOUBLE[]"


@query(f"SELECT vec_id AS id, label AS collection, round({_DISTANCE.format(_PROBE_SQL)}, 6) AS distance FROM embeddings ORDER BY {_DISTANCE.format(_PROBE_SQL)}, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    return search.knn(V.vector_conclusions(spark, sf_dir), _PROBE, 10).select("id", "collection", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id AS id, round({_DISTANCE.format(_PROBE_SQL)}, 6) AS distance FROM embeddings WHERE label = 3 AND {_DISTANCE.format(_PROBE_SQL)} <= 0.9 ORDER BY {_DISTANCE.format(_PROBE_SQL)}, vec_id LIMIT 100")
def knn_max_distance(spark, sf_dir):
    rows = V.vector_conclusions(spark, sf_dir).where("collection = 3")
    return search.knn(rows, _PROBE, 100, most=0.9).select("id", F.round("distance", 6).alias("distance"))


@query("""WITH p AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0),
d AS (SELECT p.vec_id AS probe, v.vec_id AS id, round(1 - list_cosine_similarity(p.e, v.embedding::DOUBLE[]), 9) + 0.0 AS distance FROM p JOIN embeddings v ON p.label = v.label AND p.vec_id <> v.vec_id)
SELECT probe, arg_min(id, (distance, id)) AS id, round(min(distance), 6) AS distance FROM d WHERE distance <= 0.8 GROUP BY probe""")
def nearest_per_probe(spark, sf_dir):
    """For every twentieth vector the nearest other one of its collection, within 0.8."""
    rows = V.vector_conclusions(spark, sf_dir)
    probes = rows.where("id % 20 = 0").select(F.col("id").alias("probe"), "collection", "embedding")
    best = search.nearest(probes, rows, ["collection"], 0.8, apart=True)
    return best.select("probe", "id", F.round("distance", 6).alias("distance"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 0.0, 6) AS distance
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 0.6""")
def near_duplicate_pairs(spark, sf_dir):
    pairs = search.pairs_within(V.vector_conclusions(spark, sf_dir), ["collection"], 0.6)
    return pairs.select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"WITH {V.TEXT_CONCLUSIONS} SELECT session, min(id) AS oldest, count(*) AS n FROM text_conclusions GROUP BY session, content HAVING count(*) > 1")
def exact_duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(V.text_conclusions(spark, sf_dir), ["session"]).select("session", "oldest", "n")


@query(f"WITH {V.TEXT_CONCLUSIONS}, oldest AS (SELECT collection, session, content, min(id) AS id FROM text_conclusions GROUP BY ALL) SELECT f.id AS fact_id, min(o.id) AS id FROM text_conclusions f JOIN oldest o ON f.content = o.content AND f.session IS NOT DISTINCT FROM o.session AND f.collection IS NOT DISTINCT FROM o.collection GROUP BY f.id")
def exact_match_oldest(spark, sf_dir):
    rows = V.text_conclusions(spark, sf_dir)
    return dedup.exact_matches(rows.withColumnRenamed("id", "fact_id"), rows, ["collection", "session"])


@query(f"WITH {V.TEXT_CONCLUSIONS}, oldest AS (SELECT session, content, min(id) AS id FROM text_conclusions GROUP BY session, content) SELECT f.id AS fact_id, min(o.id) AS id FROM text_conclusions f JOIN oldest o ON f.content = o.content AND f.session IS NOT DISTINCT FROM o.session GROUP BY f.id")
def exact_match_oldest_all(spark, sf_dir):
    rows = V.text_conclusions(spark, sf_dir)
    return dedup.exact_matches(rows.withColumnRenamed("id", "fact_id"), rows, ["session"])


_ROOM = 16
_ROOMS = f"""WITH {V.EVENT_MESSAGES}, {V.MEMBERSHIPS}, said AS (SELECT id, peer, CAST(peer AS BIGINT) // {_ROOM} AS room, created_at, token_count FROM event_messages),
seen AS (SELECT s.id, m.peer FROM said s JOIN memberships m ON s.room = CAST(m.peer AS BIGINT) // {_ROOM} AND m.joined_at <= s.created_at AND (m.left_at IS NULL OR s.created_at < m.left_at) UNION SELECT id, peer FROM said),
listed AS (SELECT id, list_sort(list(DISTINCT peer)) AS observers FROM seen GROUP BY id)"""


def _rooms(spark, sf_dir):
    """Every event, as a message to the room of its user; a room has the members of sixteen user ids."""
    room = F.expr(f"CAST(peer AS BIGINT) DIV {_ROOM}").alias("room")
    return V.event_messages(spark, sf_dir).select("*", room), V.memberships(spark, sf_dir).select("*", room, F.lit(True).alias("observe_others"))


@query(f"{_ROOMS} SELECT id, len(observers) AS n_observers, array_to_string(observers, ',') AS observers FROM listed")
def observer_interval_join_rooms(spark, sf_dir):
    rows, people = _rooms(spark, sf_dir)
    return observe.observers(rows, people, ["room"]).select("id", F.size("observers").alias("n_observers"), F.array_join("observers", ",").alias("observers"))


_PAYLOAD = """'{"observers":["' || array_to_string(observers, '","') || '"]' || CASE WHEN token_count % 3 = 0 THEN ',"reasoning_enabled":true' WHEN token_count % 3 = 1 THEN ',"reasoning_enabled":false' ELSE '' END || CASE WHEN token_count % 5 = 0 THEN ',"custom_instructions":"in \\"short\\""' ELSE '' END || '}'"""


def _reasoned(rows):
    """Messages with settings of their own, some of them unset."""
    rest = F.col("token_count") % 3
    return rows.withColumn("reasoning_enabled", F.when(rest == 0, True).when(rest == 1, False)).withColumn("custom_instructions", F.when(F.col("token_count") % 5 == 0, 'in "short"'))


@query(f"{_ROOMS} SELECT s.id, 'representation:w:' || s.room || ':' || s.peer AS unit, {_PAYLOAD} AS payload, len(observers) AS n_observers, token_count FROM said s JOIN listed USING (id)")
def enqueue_work_rooms(spark, sf_dir):
    rows, people = _rooms(spark, sf_dir)
    return observe.enqueue(_reasoned(rows), people, ["room"], F.lit("w"), "room")


_TYPED = f"""WITH {V.EVENT_MESSAGES}, {V.MEMBERSHIPS}, said AS (SELECT id, peer, session, CAST(peer AS BIGINT) // {_ROOM} AS room, created_at, token_count FROM event_messages),
ins AS (SELECT peer, CAST(peer AS BIGINT) // {_ROOM} AS room, joined_at, left_at, unnest(['purchase', 'click', 'view']) AS session FROM memberships),
seen AS (SELECT s.id, m.peer FROM said s JOIN ins m ON s.session = m.session AND s.room = m.room AND m.joined_at <= s.created_at AND (m.left_at IS NULL OR s.created_at < m.left_at) UNION SELECT id, peer FROM said),
listed AS (SELECT id, list_sort(list(DISTINCT peer)) AS observers FROM seen GROUP BY id)"""


def _typed(spark, sf_dir):
    """Every event, as a message to the session of its type in its user's room; members are in the
    sessions of three types, so that messages of the others are seen by their senders alone."""
    rows, people = _rooms(spark, sf_dir)
    return rows, people.withColumn("session", F.explode(F.array(*[F.lit(x) for x in ("purchase", "click", "view")])))


@query(f"{_TYPED} SELECT id, len(observers) AS n_observers, array_to_string(observers, ',') AS observers FROM listed")
def observer_interval_join(spark, sf_dir):
    rows, people = _typed(spark, sf_dir)
    return observe.observers(rows, people, ["session", "room"]).select("id", F.size("observers").alias("n_observers"), F.array_join("observers", ",").alias("observers"))


@query(f"{_TYPED} SELECT s.id, 'representation:~21c69770074226839a64b983330c41ca:' || s.session || ':' || s.peer AS unit, {_PAYLOAD} AS payload, len(observers) AS n_observers, token_count FROM said s JOIN listed USING (id)")
def enqueue_work(spark, sf_dir):
    rows, people = _typed(spark, sf_dir)
    return observe.enqueue(_reasoned(rows), people, ["session", "room"], F.lit("w w"), "session")


_WORK = f"WITH {V.WORK_ITEMS}, {V.LEASES}"
_CLAIM = f"""{_WORK}, open AS (SELECT *, min(id) FILTER (available_at > {NOW}) OVER (PARTITION BY unit) AS blocked FROM work_items WHERE status IN (0, 1)),
claim AS (SELECT * FROM open WHERE blocked IS NULL OR id < blocked), taken AS (SELECT unit FROM leases WHERE expires_at >= {NOW}),
due AS (SELECT unit, min(id) AS first_id, count(*) AS n_items, CAST(sum(token_count) AS BIGINT) AS tokens, min(created_at) AS oldest FROM claim WHERE unit NOT IN (SELECT unit FROM taken) GROUP BY unit
  HAVING sum(token_count) >= {Q.TOKENS} OR min(created_at) + INTERVAL {Q.MAX_AGE_MINUTES} MINUTE <= {NOW})"""


@query(f"{_CLAIM} SELECT id, unit, token_count FROM claim")
def queue_claimable_prefix(spark, sf_dir):
    return Q.claimable(V.work_items(spark, sf_dir), V.NOW).select("id", "unit", "token_count")


@query(f"{_CLAIM} SELECT unit, first_id, n_items, tokens FROM due")
def queue_due_units(spark, sf_dir):
    return Q.due_units(V.work_items(spark, sf_dir), V.leases(spark, sf_dir), V.NOW).select("unit", "first_id", "n_items", "tokens")


@query(f"""{_WORK}, running AS (SELECT unit, id, token_count, row_number() OVER w AS place, CAST(sum(token_count) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM work_items WINDOW w AS (PARTITION BY unit ORDER BY id))
SELECT unit, id, place, running FROM running WHERE place <= 200 AND (place = 1 OR running <= 1024)""")
def queue_token_batch(spark, sf_dir):
    return Q.token_batch(V.work_items(spark, sf_dir)).select("unit", "id", "place", "running")


@query(f"""{_CLAIM}, chosen AS (SELECT *, row_number() OVER (ORDER BY first_id) AS place FROM due ORDER BY first_id LIMIT 32)
SELECT unit, 'me' AS owner, (SELECT coalesce(max(token), 0) FROM leases) + place AS token FROM chosen""")
def queue_acquire(spark, sf_dir):
    given, _ = Q.acquire(V.work_items(spark, sf_dir), V.leases(spark, sf_dir), V.NOW, "me")
    return given.select("unit", "owner", "token")


_STATUS = f"""{_WORK}, marked AS (SELECT session, status, unit IN (SELECT unit FROM leases WHERE expires_at >= {NOW}) AS busy FROM work_items),
counts AS (SELECT session, count(*) FILTER (status = 2) AS completed, count(*) FILTER (status = 3) AS dead_lettered, count(*) FILTER (status IN (0, 1) AND busy) AS in_progress,
  count(*) FILTER (status IN (0, 1) AND NOT busy) AS pending FROM marked GROUP BY ROLLUP (session))"""


@query(f"{_STATUS} SELECT * FROM counts")
def queue_status(spark, sf_dir):
    return Q.status(V.work_items(spark, sf_dir), V.leases(spark, sf_dir), V.NOW)


@query(f"{_STATUS} SELECT session, completed + dead_lettered AS completed, in_progress, pending, completed + dead_lettered + in_progress + pending AS total FROM counts")
def queue_wire_status(spark, sf_dir):
    return Q.wire_status(Q.status(V.work_items(spark, sf_dir), V.leases(spark, sf_dir), V.NOW))


@query(f"{_CLAIM} SELECT count(*) AS due_units, (SELECT min(created_at) FROM open) AS oldest_open FROM due")
def queue_backlog(spark, sf_dir):
    return Q.backlog(V.work_items(spark, sf_dir), V.leases(spark, sf_dir), V.NOW)


@query(f"""{_WORK} SELECT id, CASE WHEN attempts >= 3 THEN 3 ELSE 1 END AS status,
  CASE WHEN attempts >= 3 THEN available_at ELSE {NOW} + to_seconds(CAST(least(5 * pow(2, attempts - 1), 300) AS INTEGER)) END AS available_at FROM work_items WHERE status = 0 AND attempts > 0""")
def queue_fail_transition(spark, sf_dir):
    items = V.work_items(spark, sf_dir).where("status = 0 AND attempts > 0")
    return Q.failed(items, V.NOW, "no answer", most=3).select("id", "status", "available_at")


@query(f"{_WORK} SELECT id, greatest(attempts - 1, 0) AS attempts FROM work_items WHERE status = 0")
def queue_release(spark, sf_dir):
    return Q.released(V.work_items(spark, sf_dir).where("status = 0"), V.NOW).select("id", "attempts")


@query(f"{_WORK} SELECT id FROM work_items WHERE NOT (status = 2 AND created_at + INTERVAL 7 DAY <= {NOW})")
def queue_prune(spark, sf_dir):
    return Q.pruned(V.work_items(spark, sf_dir).withColumn("completed_at", F.col("created_at")), V.NOW).select("id")


@query(f"""WITH {V.MESSAGES}, targets AS (SELECT session, seq FROM messages WHERE peer = 'user' AND seq > 2), ends AS (SELECT session, max(seq) AS last, count(*) AS n FROM targets GROUP BY session),
near AS (SELECT m.*, t.seq IS NOT NULL AS target FROM messages m JOIN ends e USING (session) LEFT JOIN targets t USING (session, seq) WHERE m.seq <= last AND (m.seq > last - n - 3 OR t.seq IS NOT NULL)),
spent AS (SELECT *, CAST(sum(CASE WHEN target THEN token_count ELSE 0 END) OVER (PARTITION BY session) + sum(CASE WHEN target THEN 0 ELSE token_count END) OVER (PARTITION BY session ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM near)
SELECT session, seq, target, used FROM spent WHERE target OR used <= 2500""")
def context_window_budget(spark, sf_dir):
    rows = V.messages(spark, sf_dir)
    return transcript.context_window(rows, rows.where("peer = 'user' AND seq > 2"), 2500, context=3).select("session", "seq", "target", "used")


_BRANCHES = f"""WITH {V.TEXT_CONCLUSIONS}, ranked AS (
  SELECT *, 1 AS rank, row_number() OVER (PARTITION BY collection ORDER BY times_derived DESC, created_at DESC, id DESC) AS place FROM text_conclusions
  UNION ALL SELECT *, 2, row_number() OVER (PARTITION BY collection ORDER BY created_at DESC, id DESC) FROM text_conclusions),
once AS (SELECT *, row_number() OVER (PARTITION BY collection, id ORDER BY rank, place) AS r FROM ranked WHERE place <= 8),
kept AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY rank, place, id) AS q FROM once WHERE r = 1)"""


@query(f"{_BRANCHES} SELECT collection, id, rank, place FROM kept WHERE q <= 8")
def representation_merge(spark, sf_dir):
    return represent.branches(V.text_conclusions(spark, sf_dir), 8, keys=("collection",)).select("collection", "id", "rank", "place")


@query(f"""{_BRANCHES}, lines AS (SELECT collection, level, string_agg('- ' || regexp_replace(content, '\\r\\n|[\\r\\n\\f\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') || chr(10), '' ORDER BY rank, created_at, id) AS body FROM kept WHERE q <= 8 GROUP BY collection, level)
SELECT collection, sha256(string_agg('## ' || CASE level WHEN 0 THEN 'Explicit' WHEN 1 THEN 'Deductive' ELSE 'Inductive' END || chr(10) || chr(10) || body, chr(10) ORDER BY level)) AS digest FROM lines GROUP BY collection""")
def representation_text(spark, sf_dir):
    rows = represent.branches(V.text_conclusions(spark, sf_dir), 8, keys=("collection",))
    return represent.render(rows, ("Explicit", "Deductive", "Inductive"), ("collection",)).select("collection", F.sha2("representation", 256).alias("digest"))


@query(f"WITH {V.TEXT_CONCLUSIONS} SELECT id FROM text_conclusions WHERE session IN ('de', 'fr') AND level = 0 ORDER BY created_at DESC, id DESC LIMIT 25")
def visibility_allowlist(spark, sf_dir):
    rows = represent.visible(V.text_conclusions(spark, sf_dir), ["de", "fr"])
    return paging.page(rows, ("created_at", "id"), size=25, reverse=True).select("id")


@query(f"WITH {V.TEXT_CONCLUSIONS} SELECT collection, session, CAST(count(*) FILTER (level = 0) AS BIGINT) AS explicit_count, max(created_at) AS last_activity FROM text_conclusions GROUP BY collection, session")
def collection_counters(spark, sf_dir):
    return dedup.collection_counters(V.text_conclusions(spark, sf_dir), ["collection", "session"])


@query(f"WITH {V.TEXT_CONCLUSIONS} SELECT id, CASE level WHEN 0 THEN 'explicit' WHEN 1 THEN 'deductive' ELSE 'inductive' END AS level FROM text_conclusions")
def level_projection(spark, sf_dir):
    return V.text_conclusions(spark, sf_dir).select("id", level_name(F.col("level")).alias("level"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS session, o_orderkey AS id, 100 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders""")
def sequence_allocation(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("batch"), F.col("o_orderkey").alias("position"))
    return members.number_messages(rows, rows.select("session").distinct().withColumn("last_seq", F.lit(100))).select("session", "id", "seq")


@query("SELECT o_custkey AS customer, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
def latest_state(spark, sf_dir):
    rows = V.table(spark, sf_dir, "orders")
    return log.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("last_order"))


@query("""WITH r AS (SELECT 'w' AS workspace, CAST(user_id AS VARCHAR) AS key_hash, event_id AS position FROM events), f AS (SELECT key_hash, min(position) AS position FROM r GROUP BY key_hash)
SELECT key_hash, position FROM f WHERE CAST(key_hash AS BIGINT) % 3 <> 0""")
def idempotent_requests(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.lit("w").alias("workspace"), F.col("user_id").cast("string").alias("key_hash"), F.col("event_id").alias("position"))
    n = F.col("key_hash").cast("bigint")
    records = rows.select("workspace", "key_hash").distinct().where(n % 3 != 1).withColumn("expires_at", F.timestamp_add("MINUTE", F.when(n % 3 == 0, 5).otherwise(0), F.to_timestamp_ntz(F.lit(V.NOW))))
    return members.unseen_requests(rows, records, V.NOW).select("key_hash", "position")


@query("""SELECT c_custkey AS id, 'representation:w:' || replace(c_name, '#', '-') || ':~' || left(sha256(regexp_replace(c_mktsegment || ' !', '(.)', '\\1' || chr(0), 'g')), 32) AS unit FROM customer""")
def work_unit_keys(spark, sf_dir):
    rows = V.table(spark, sf_dir, "customer")
    name = F.regexp_replace("c_name", "#", "-")
    return rows.select(F.col("c_custkey").alias("id"), K.work_unit_key(F.lit("w"), name, F.concat("c_mktsegment", F.lit(" !"))).alias("unit"))


@query(f"WITH {V.MESSAGES} SELECT id, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS content FROM messages")
def collapse_text(spark, sf_dir):
    return V.messages(spark, sf_dir).select("id", X.collapse(F.col("content")).alias("content"))


@query("""SELECT o_orderkey AS id, coalesce(m, s, w, 5) AS value, CASE WHEN m IS NOT NULL THEN 'message' WHEN s IS NOT NULL THEN 'session' WHEN w IS NOT NULL THEN 'workspace' ELSE 'global' END AS source
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS m, CASE WHEN o_orderkey % 3 = 0 THEN 3 END AS s, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS w FROM orders)""")
def config_resolution(spark, sf_dir):
    key = F.col("o_orderkey")
    layers = (("message", F.when(key % 2 == 0, key)), ("session", F.when(key % 3 == 0, 3)), ("workspace", F.when(key % 5 == 0, 4)), ("global", F.lit(5)))
    return V.table(spark, sf_dir, "orders").select(key.alias("id"), K.resolve(*layers).alias("x")).select("id", F.col("x.value").cast("bigint").alias("value"), "x.source")


@query(f"""{_TYPED}, facts AS (SELECT id AS fact_id, id AS s1, lead(id) OVER (PARTITION BY session, room ORDER BY CAST(id AS BIGINT)) AS s2 FROM said),
u AS (SELECT id, unnest(observers) AS observer FROM listed)
SELECT fact_id, x.observer FROM facts JOIN u x ON x.id = s1 JOIN u y ON y.id = s2 AND x.observer = y.observer""")
def fact_routing(spark, sf_dir):
    """A fact for each message and the next one in its session and room."""
    rows, people = _typed(spark, sf_dir)
    after = F.lead("id").over(Window.partitionBy("session", "room").orderBy(F.col("id").cast("bigint")))
    facts = rows.select(F.col("id").alias("fact_id"), after.alias("next")).where("next IS NOT NULL").select("fact_id", F.array("fact_id", "next").alias("source_ids"))
    return transcript.route_facts(facts, observe.observers(rows, people, ["session", "room"]))


@query(f"""{_ROOMS}, facts AS (SELECT id AS fact_id, id AS s1, lead(id) OVER (PARTITION BY room ORDER BY CAST(id AS BIGINT)) AS s2 FROM said),
u AS (SELECT id, unnest(observers) AS observer FROM listed)
SELECT fact_id, x.observer FROM facts JOIN u x ON x.id = s1 JOIN u y ON y.id = s2 AND x.observer = y.observer""")
def fact_routing_rooms(spark, sf_dir):
    """A fact for each message and the next one in its room."""
    rows, people = _rooms(spark, sf_dir)
    after = F.lead("id").over(Window.partitionBy("room").orderBy(F.col("id").cast("bigint")))
    facts = rows.select(F.col("id").alias("fact_id"), after.alias("next")).where("next IS NOT NULL").select("fact_id", F.array("fact_id", "next").alias("source_ids"))
    return transcript.route_facts(facts, observe.observers(rows, people, ["room"]))


@query()
def dedup_fold(spark, sf_dir):
    """Facts are the odd documents, matched with the even ones of the same source and language."""
    rows = V.text_conclusions(spark, sf_dir).select(F.col("id").cast("string").alias("id"), F.lit("w").alias("workspace"), F.col("collection").alias("observer"), F.col("collection").alias("observed"), "session", "content", "level")
    rows = materialize(rows.withColumn("embedding", embed(F.col("content"), 64)), "fold-rows")  # each text is embedded once
    facts = rows.where("id % 2 = 1").select(F.col("id").alias("fact_id"), *dedup._SCOPE, "content", "embedding", F.col("id").cast("bigint").alias("position"), F.array("id").alias("source_ids"))
    matched = dedup.match_existing(facts, rows.where("id % 2 = 0"))
    return dedup.fold(matched).select("observer", "session", "position", "outcome", "id", F.size("source_ids").alias("n_sources"))


from palimpsest import store_queries as _more  # noqa: E402, F401  registers its own
