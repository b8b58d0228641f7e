"""Queries of the store: related tables, memberships, grants, transcripts, and filters over them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions import text as X
from palimpsest.functions.tokens import token_counter
from palimpsest.operators import conclusions as C
from palimpsest.operators import dedup, members, models, paging, represent, search, transcript
from palimpsest.operators import work_queue as Q
from palimpsest.plans.filters import compile_filter
from palimpsest.registry import QUERIES, SQL, query
from palimpsest.sources import log, wire
from palimpsest.sources import views as V

NOW = f"TIMESTAMP '{V.NOW}'"

# Filters over other resources.


def _peers(spark, sf_dir):
    """Customers as peers, with metadata of several depths."""
    rows = V.table(spark, sf_dir, "customer")
    info = F.struct(F.col("c_mktsegment").alias("segment"), F.array(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("tags"), F.struct(F.col("c_nationkey").alias("n")).alias("deep"))
    return rows.select(F.col("c_name").alias("name"), (F.col("c_nationkey") % 5 == 0).alias("is_internal"), F.to_json(F.struct(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"), info.alias("info"))).alias("metadata"))


def _of_peers(name: str, request: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _peers(spark, sf_dir).where(compile_filter(request, "peer")).select("name")
    SQL[name] = f"SELECT c_name AS name FROM customer WHERE {where}"


_of_peers("peer_name_contains", '{"peer_id": {"contains": "00012"}, "id": {"ne": "Customer#000000120"}}', "contains(c_name, '00012') AND c_name <> 'Customer#000000120'")
_of_peers("meta_nested_path", '{"metadata": {"info": {"segment": "BUILDING", "deep": {"n": {"gte": 3, "lt": 1.2e1}}}}}', "c_mktsegment = 'BUILDING' AND c_nationkey >= 3 AND c_nationkey < 12")
_of_peers("meta_string_order", '{"metadata": {"info": {"segment": {"gt": "BUILDING", "lte": "HOUSEHOLD"}}}}', "c_mktsegment > 'BUILDING' AND c_mktsegment <= 'HOUSEHOLD'")
_of_peers("meta_list_contains_all", '{"metadata": {"info": {"tags": ["MACHINERY", "7"]}}}', "c_mktsegment = 'MACHINERY' AND c_nationkey = 7")
_of_peers("meta_string_contains", '{"metadata": {"info": {"segment": {"contains": "HOLD"}}}}', "contains(c_mktsegment, 'HOLD')")
_of_peers("meta_string_icontains", '{"metadata": {"info": {"segment": {"icontains": "Hold"}}}, "NOT": [{"metadata": {"nation": {"in": [1, 2, 3.0]}}}]}', "contains(c_mktsegment, 'HOLD') AND c_nationkey NOT IN (1, 2, 3)")
_of_peers("meta_element_contains", '{"metadata": {"info": {"tags": {"contains": "11"}}}}', "c_nationkey = 11")
_of_peers("meta_decimal_order", '{"metadata": {"balance": {"gt": 1234.56, "lt": 99999999999999999999999999}}}', "CAST(c_acctbal AS DECIMAL(12,2)) > 1234.56")
_of_peers("meta_object_is_no_scalar", '{"metadata": {"info": {"ne": "x"}, "nation": {"gt": "1"}}}', "false")
_of_peers("filter_blank", " ", "true")


@query("SELECT c_name AS name FROM customer WHERE c_nationkey % 5 <> 0")
def peers_of_regular_kind(spark, sf_dir):
    return C.peers_of_kind(_peers(spark, sf_dir)).select("name")


@query("SELECT n_name AS name FROM nation WHERE (n_name IN ('NATION_3', 'JAPAN') OR contains(n_name, '_1')) AND n_name <> 'NATION_11'")
def filter_workspaces(spark, sf_dir):
    rows = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return rows.where(compile_filter('{"OR": [{"id": {"in": ["NATION_3", "JAPAN"]}}, {"name": {"contains": "_1"}}], "name": {"ne": "NATION_11"}}', "workspace"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-03' AND contains(CAST(o_orderkey AS VARCHAR), '7') AND o_orderstatus <> 'O'")
def filter_session_fields(spark, sf_dir):
    request = '{"created_at": {"gte": "1996-02-03T00:00:00Z"}, "session_id": {"contains": "7"}, "is_active": false}'
    return members.where_sessions(V.order_sessions(spark, sf_dir), V.order_members(spark, sf_dir), request).select("name")


@query(f"""WITH {V.ORDER_SESSIONS}, {V.ORDER_MEMBERS} SELECT name FROM order_sessions s WHERE (EXISTS (SELECT 1 FROM order_members m WHERE m.session = s.name AND active AND (peer = '3' OR contains(peer, '1')))
  OR is_active) AND NOT EXISTS (SELECT 1 FROM order_members m WHERE m.session = s.name AND active AND peer IN ('2', '5'))""")
def session_members_mixed(spark, sf_dir):
    request = '{"OR": [{"peer_id": "3"}, {"peer_id": {"contains": "1"}}, {"is_active": true}], "NOT": [{"peer_id": {"in": ["2", "5"]}}]}'
    return members.where_sessions(V.order_sessions(spark, sf_dir), V.order_members(spark, sf_dir), request).select("name")


def _of_conclusions(name: str, request: str, where: str) -> None:
    def run(spark, sf_dir):
        rows = V.text_conclusions(spark, sf_dir).withColumns({"observer": F.lit("me"), "observed": F.col("collection")})
        return rows.where(compile_filter(request, "conclusion")).select("id")

    QUERIES[name] = run
    SQL[name] = f"WITH {V.TEXT_CONCLUSIONS} SELECT id FROM text_conclusions WHERE {where}"


_of_conclusions("filter_conclusion_fields", '{"observer_id": "me", "observed_id": {"icontains": "Rc1"}, "session_id": {"in": ["de", "fr"]}}', "contains(upper(collection), 'RC1') AND session IN ('de', 'fr')")
_of_conclusions("filter_level_eq", '{"level": "explicit"}', "level = 0")
_of_conclusions("filter_level_in_and_ne", '{"level": {"in": ["deductive", "inductive", "no level"], "ne": "inductive"}}', "level = 1")
_of_conclusions("filter_level_contains", '{"level": {"contains": "ductive"}, "NOT": [{"level": {"icontains": "DED"}}]}', "level = 2")

# Lookups and listings over related tables.


@query("SELECT c_name AS name, c_nationkey % 5 = 0 AS is_internal FROM customer WHERE c_name = 'Customer#000000042'")
def point_lookup(spark, sf_dir):
    return C.found(_peers(spark, sf_dir), "name", "Customer#000000042").select("name", "is_internal")


@query("SELECT c_name AS name FROM customer WHERE c_name IN ('Customer#000000007', 'Customer#000000008')")
def rows_among_a_list(spark, sf_dir):
    return C.among(spark, _peers(spark, sf_dir), "name", ["Customer#000000007", "nobody", "Customer#000000008", "Customer#000000007"]).select("name")


@query(f"WITH {V.CONCLUSIONS} SELECT id, 'me' AS observer, source AS observed, lang AS session, level FROM conclusions WHERE deleted_at IS NULL AND source IS NOT NULL")
def conclusion_listing(spark, sf_dir):
    t = V.conclusion_tables(spark, sf_dir)
    return C.listing(t["conclusions"], t["collections"], t["peers"], t["sessions"]).select("id", "observer", "observed", "session", "level")


@query(f"WITH {V.CONCLUSIONS} SELECT id, content, 'me' AS observer_id, source AS observed_id, lang AS session_id, CASE level WHEN 0 THEN 'explicit' WHEN 1 THEN 'deductive' ELSE 'inductive' END AS level, created_at FROM conclusions WHERE deleted_at IS NULL AND source IS NOT NULL")
def conclusions_on_the_wire(spark, sf_dir):
    t = V.conclusion_tables(spark, sf_dir)
    return wire.wire(C.listing(t["conclusions"], t["collections"], t["peers"], t["sessions"]), "conclusion")


@query(f"""WITH {V.CONCLUSIONS}, oldest AS (SELECT id FROM conclusions WHERE deleted_at IS NULL AND embedding_state = 0 ORDER BY created_at, id LIMIT 96)
SELECT id, CASE WHEN id IN (SELECT id FROM oldest) THEN CASE WHEN contains(content, 'qu') THEN 2 ELSE 1 END ELSE embedding_state END AS embedding_state FROM conclusions""")
def embedding_backlog_tick(spark, sf_dir):
    """One turn of the backlog, by a model that fails on some texts."""
    rows = V.conclusion_tables(spark, sf_dir)["conclusions"].withColumns({"embedding": F.lit(None).cast("array<float>")})

    def picky(texts: list[str]) -> list[list[float]]:
        if any("qu" in x for x in texts):
            raise ValueError("no such letters")
        return models.deterministic_embedder(8)(texts)

    return models.embedding_tick(rows, picky, 8, batch=32, most=3).select("id", "embedding_state")


@query(f"WITH {V.CONCLUSIONS} SELECT id FROM conclusions WHERE deleted_at IS NULL AND embedding_state = 1")
def searchable_conclusions(spark, sf_dir):
    return C.live(V.conclusion_tables(spark, sf_dir)["conclusions"], searchable=True).select("id")


@query(f"WITH {V.CONCLUSIONS} SELECT id, content FROM conclusions WHERE deleted_at IS NULL AND embedding_state = 0 ORDER BY created_at, id LIMIT 64")
def pending_oldest(spark, sf_dir):
    rows = V.conclusion_tables(spark, sf_dir)["conclusions"]
    return C.pending(rows, spark.createDataFrame([("w",), ("v",)], "name string"), 64).select("id", "content")


@query(f"WITH {V.CONCLUSIONS} SELECT count(*) AS pending FROM conclusions WHERE deleted_at IS NULL AND embedding_state = 0")
def pending_count(spark, sf_dir):
    return C.count_pending(V.conclusion_tables(spark, sf_dir)["conclusions"])


@query(f"WITH {V.CONCLUSIONS} SELECT id, CASE WHEN deleted_at IS NULL AND id % 7 = 0 THEN {NOW} ELSE deleted_at END AS deleted_at FROM conclusions")
def conclusions_tombstoned(spark, sf_dir):
    rows = V.conclusion_tables(spark, sf_dir)["conclusions"]
    gone = rows.where("id % 7 = 0").select("workspace", "id").unionByName(spark.createDataFrame([("w", -1), ("other", 7)], "workspace string, id bigint"))
    return C.tombstoned(rows, gone, V.NOW).select("id", "deleted_at")


@query(f"WITH {V.CONCLUSIONS} SELECT id FROM conclusions WHERE deleted_at IS NULL OR deleted_at + INTERVAL 24 HOUR > {NOW}")
def conclusions_purged(spark, sf_dir):
    return C.purged(V.conclusion_tables(spark, sf_dir)["conclusions"], V.NOW).select("id")


@query(f"SELECT event_id AS id FROM events WHERE ts + INTERVAL 3120 HOUR > {NOW}")
def requests_unexpired(spark, sf_dir):
    rows = V.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.timestamp_add("HOUR", F.lit(3120), F.col("ts")).alias("expires_at"))
    return C.unexpired(rows, V.NOW).select("id")


_IDS = "left(replace(replace(to_base64(unhex(sha256('[\"' || doc_id || '\",\"new\"]'))), '+', '-'), '/', '_'), 21)"


@query(f"""SELECT {_IDS} AS id, source AS observed, 0 AS embedding_state, 1 AS times_derived, {NOW} AS created_at, sha256(coalesce(lang, '-')) AS session_hash FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S') AND source IS NOT NULL""")
def conclusions_inserted(spark, sf_dir):
    from palimpsest.sources.schema import empty

    rows = V.table(spark, sf_dir, "documents").where(F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)) & F.col("source").isNotNull())
    new = rows.select(F.lit("w").alias("workspace"), F.lit("me").alias("observer"), F.col("source").alias("observed"), F.col("lang").alias("session"), F.pmod("doc_id", F.lit(3)).alias("level"), F.col("text").alias("content"), F.array(F.col("doc_id").cast("string")).alias("source_ids"))
    out = C.inserted(empty(spark, "conclusions"), new, V.NOW, K.public_id(F.col("source_ids")[0], F.lit("new")))
    return out.select("id", "observed", F.col("embedding_state").cast("int").alias("embedding_state"), "times_derived", "created_at", F.sha2(F.coalesce("session", F.lit("-")), 256).alias("session_hash"))


@query(f"""WITH {V.CONCLUSIONS} SELECT id, CASE WHEN embedding_state = 0 AND deleted_at IS NULL AND id % 4 = 0 THEN 1 WHEN embedding_state = 0 AND deleted_at IS NULL AND id % 4 = 1 THEN 2 ELSE embedding_state END AS embedding_state,
  CASE WHEN embedding_state = 0 AND deleted_at IS NULL AND id % 4 = 0 THEN 'm1' END AS model FROM conclusions""")
def embeddings_saved(spark, sf_dir):
    """Vectors come back for three of four conclusions: a vector, a failure, and one for a text that was changed."""
    rows = V.conclusion_tables(spark, sf_dir)["conclusions"].withColumns({"embedding": F.lit(None).cast("array<float>"), "embedding_model": F.lit(None).cast("string")})
    kind = F.col("id") % 4
    made = rows.where(kind < 3).select("id", F.when(kind == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"), F.when(kind != 1, F.array(F.lit(1.0).cast("float"))).alias("vector"), F.lit("m1").alias("model"))
    return C.save_embeddings(rows, made).select("id", "embedding_state", F.col("embedding_model").alias("model"))


@query(f"WITH {V.MESSAGES} SELECT m.id, n_name AS peer_name FROM (SELECT * FROM messages ORDER BY seq, CAST(session AS BIGINT) LIMIT 50) m LEFT JOIN nation ON n_nationkey = seq")
def page_with_names(spark, sf_dir):
    rows = paging.page(V.messages(spark, sf_dir).withColumn("s", F.col("session").cast("bigint")), ("seq", "s"))
    names = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("seq"), F.col("n_name").alias("peer_name"))
    return paging.with_names(rows, names, "seq").select("id", "peer_name")


@query(f"""WITH {V.MESSAGES}, p AS (SELECT *, row_number() OVER (ORDER BY seq, CAST(session AS BIGINT)) AS place FROM messages WHERE peer = 'user')
SELECT (SELECT string_agg(id || '=' || seq, ';' ORDER BY place) FROM p WHERE place > 20 AND place <= 40) AS items, 2 AS page, count(*) AS total, 20 AS size, CAST(ceil(count(*) / 20) AS BIGINT) AS pages FROM p""")
def page_envelope(spark, sf_dir):
    rows = V.messages(spark, sf_dir).where("peer = 'user'").withColumn("s", F.col("session").cast("bigint"))
    out = paging.envelope(rows.select("id", "seq", "s"), ("seq", "s"), 2, 20)
    return out.withColumn("items", F.array_join(F.transform("items", lambda x: F.concat_ws("=", x["id"], x["seq"].cast("string"))), ";"))


# The queue.

_POLICIES = {0: (300, 20), 1: (900, 45)}
_TYPED_WORK = f"""WITH {V.WORK_ITEMS}, {V.LEASES}, typed AS (SELECT *, CAST(id % 3 AS INTEGER) AS task_type FROM work_items),
open AS (SELECT *, min(id) FILTER (available_at > {NOW}) OVER (PARTITION BY unit) AS blocked FROM typed WHERE status IN (0, 1) AND task_type IN (0, 1)),
claim AS (SELECT * FROM open WHERE (blocked IS NULL OR id < blocked) AND unit NOT IN (SELECT unit FROM leases WHERE expires_at >= {NOW})),
units AS (SELECT unit, min(id) AS first_id, arg_min(task_type, id) AS task_type, CAST(sum(token_count) AS BIGINT) AS tokens, min(created_at) AS oldest FROM claim GROUP BY unit)"""


@query(f"{_TYPED_WORK} SELECT unit, first_id, task_type, tokens FROM units WHERE (task_type = 0 AND (tokens >= 300 OR oldest + INTERVAL 20 MINUTE <= {NOW})) OR (task_type = 1 AND (tokens >= 900 OR oldest + INTERVAL 45 MINUTE <= {NOW}))")
def queue_due_by_policy(spark, sf_dir):
    items = V.work_items(spark, sf_dir).withColumn("task_type", (F.col("id") % 3).cast("int"))
    return Q.due_units(items, V.leases(spark, sf_dir), V.NOW, policies=_POLICIES).select("unit", "first_id", "task_type", "tokens")


@query(f"""WITH {V.WORK_ITEMS}, {V.LEASES}, mine AS (SELECT session, status, unit IN (SELECT unit FROM leases WHERE expires_at >= {NOW}) AS busy FROM work_items WHERE peer = 'user' AND id % 2 = 0 AND CAST(session AS BIGINT) % 2 = 1)
SELECT session, count(*) FILTER (status = 2) AS completed, count(*) FILTER (status = 3) AS dead_lettered, count(*) FILTER (status IN (0, 1) AND busy) AS in_progress, count(*) FILTER (status IN (0, 1) AND NOT busy) AS pending FROM mine GROUP BY ROLLUP (session)""")
def queue_status_of_one(spark, sf_dir):
    """By sender, observer and workspace."""
    items = V.work_items(spark, sf_dir).withColumns({"observers": F.when(F.col("id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"))), "workspace": F.when(F.col("session").cast("bigint") % 2 == 1, "w").otherwise("v")})
    return Q.status(items, V.leases(spark, sf_dir), V.NOW, sender="user", observer="x", workspace="w")


@query(f"WITH {V.WORK_ITEMS} SELECT w.id, CASE WHEN w.id % 5 > 0 THEN n_name END AS workspace, CASE WHEN o_orderkey IS NOT NULL THEN o_orderstatus END AS session, m.id AS message FROM work_items w LEFT JOIN nation ON w.id % 5 > 0 AND n_nationkey = w.id % 30 LEFT JOIN orders ON o_orderkey = w.id % 1000 LEFT JOIN messages m ON CAST(m.session AS BIGINT) * 1000 + m.seq = w.id")
def work_items_named(spark, sf_dir):
    items = V.work_items(spark, sf_dir).select("id", F.when(F.col("id") % 5 > 0, F.col("id") % 30).alias("workspace_id"), (F.col("id") % 1000).alias("session_id"), F.col("id").alias("message_id"))
    workspaces = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    sessions = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("name"))
    messages = V.messages(spark, sf_dir).select((F.col("session").cast("bigint") * 1000 + F.col("seq")).alias("id"), F.col("id").alias("public_id"))
    return Q.named_items(items, workspaces, sessions, messages).select("id", "workspace", "session", "message")


# Transcripts and facts.

_BATCHES = f"""WITH {V.TIMED_MESSAGES}, batch AS (SELECT * FROM timed WHERE seq > 2),
targets AS (SELECT *, CASE WHEN seq % 4 = 1 THEN 'Be brief.' WHEN seq % 4 = 3 THEN ' ' ELSE 'Say "why".' END AS instruction FROM batch WHERE peer = 'user')"""


def _batches(spark, sf_dir):
    batch = V.timed_messages(spark, sf_dir).where("seq > 2")
    instruction = F.when(F.col("seq") % 4 == 1, "Be brief.").when(F.col("seq") % 4 == 3, " ").otherwise('Say "why".')
    return batch, batch.where("peer = 'user'").withColumn("instruction", instruction)


@query(f"{_BATCHES} SELECT session, array_to_string(list_sort(list(DISTINCT instruction)), '|') AS instructions FROM targets WHERE trim(instruction) <> '' GROUP BY session")
def message_instructions(spark, sf_dir):
    return transcript.instructions(_batches(spark, sf_dir)[1]).select("session", F.array_join("instructions", "|").alias("instructions"))


_ENTRY = """'{' || CASE WHEN target THEN '"id":' || to_json(id) || ',' ELSE '' END || '"speaker":' || to_json(peer) || ',"role":"' || CASE WHEN target THEN 'target' ELSE 'context' END
  || '","sent_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00","content":' || to_json(content) || '}'"""


def _asked_batches(spark, sf_dir):
    """(unit, session, target_peer, targets, n, instructions, system) of each session with targets."""
    batch, targets = _batches(spark, sf_dir)
    sizes = batch.groupBy("session").agg(F.count(F.lit(1)).alias("n"))
    asked = targets.groupBy("session").agg(F.collect_list("id").alias("targets"))
    batches = asked.join(sizes, "session").join(transcript.instructions(targets), "session", "left")
    return batches.select(F.concat(F.lit("u"), "session").alias("unit"), "session", F.lit("user").alias("target_peer"), "targets", "n", "instructions", F.lit("a prompt").alias("system"))


@query(f"{_BATCHES} SELECT id AS source, content FROM targets")
def facts_by_model(spark, sf_dir):
    """The facts that the offline model finds in each session's transcript, after one that fails."""
    batches = _asked_batches(spark, sf_dir)
    texts = transcript.transcripts(V.timed_messages(spark, sf_dir), batches, 3000, context=2)

    def broken(system: str, text: str) -> str:
        return "no JSON"

    facts = models.derived(texts.withColumn("system", F.lit("a prompt")), [broken, models.echo_model])
    return facts.select(F.col("source_ids")[0].alias("source"), "content")


@query(f"""{_BATCHES}, said AS (SELECT session, list_sort(list(DISTINCT instruction) FILTER (trim(instruction) <> '')) AS instructions, max(seq) AS last FROM targets GROUP BY session),
sizes AS (SELECT session, count(*) AS n FROM batch GROUP BY session),
heads AS (SELECT said.*, n, '{{"target_peer":"user"' || CASE WHEN len(instructions) > 0 THEN ',"message_instructions":' || to_json(instructions) ELSE '' END || ',"messages":[' AS head FROM said JOIN sizes USING (session)),
near AS (SELECT m.*, h.last, h.n, h.head, t.seq IS NOT NULL AS target FROM timed m JOIN heads h USING (session) LEFT JOIN targets t USING (session, seq) WHERE m.seq <= last AND (m.seq > last - n - 2 OR t.seq IS NOT NULL)),
entries AS (SELECT session, seq, target, head, {_ENTRY} AS entry FROM near),
spent AS (SELECT *, sum(CASE WHEN target THEN length(entry) ELSE 0 END) OVER (PARTITION BY session) + sum(CASE WHEN target THEN 0 ELSE length(entry) END) OVER (PARTITION BY session ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM entries)
SELECT session, sha256(any_value(head) || string_agg(entry, ',' ORDER BY seq) || ']}}') AS digest, count(*) AS n FROM spent WHERE target OR used <= 3000 - 8 - length(head) - 2 GROUP BY session""")
def transcript_build(spark, sf_dir):
    """What the model gets for each session's batch, by characters: instructions, targets, context while it fits."""
    batches = _asked_batches(spark, sf_dir)
    out = transcript.transcripts(V.timed_messages(spark, sf_dir), batches, 3000, context=2)
    n = F.size(F.split("transcript", '"sent_at":"2024-')) - 1
    return out.select(F.substring("unit", 2, 100).alias("session"), F.sha2("transcript", 256).alias("digest"), n.cast("bigint").alias("n"))


@query(f"""{_BATCHES}, marked AS (SELECT *, CASE WHEN seq % 3 = 0 THEN false WHEN seq % 3 = 1 THEN true END AS item, CASE WHEN CAST(session AS BIGINT) % 2 = 0 THEN false END AS ses FROM batch)
SELECT id FROM marked WHERE coalesce(item, ses, true) AND trim(content) <> ''""")
def reasoning_targets(spark, sf_dir):
    rows = _batches(spark, sf_dir)[0]
    rows = rows.withColumns({"item_reasoning": F.when(F.col("seq") % 3 == 0, False).when(F.col("seq") % 3 == 1, True), "session_reasoning": F.when(F.col("session").cast("bigint") % 2 == 0, False)})
    return transcript.target_messages(rows).select("id")


@query(f"""{_BATCHES} SELECT session AS unit, array_to_string(list(id ORDER BY seq), ',') AS message_ids, CASE WHEN CAST(session AS BIGINT) % 4 = 1 THEN 'no session' WHEN CAST(session AS BIGINT) % 4 = 2 AND count(*) > 1 THEN 'repeated message' END AS problem FROM batch WHERE CAST(session AS BIGINT) % 4 NOT IN (1, 2) OR (CAST(session AS BIGINT) % 4 = 2) GROUP BY session HAVING problem IS NULL
UNION ALL SELECT session, NULL, CASE WHEN CAST(session AS BIGINT) % 4 = 1 THEN 'no session' ELSE 'repeated message' END FROM batch WHERE CAST(session AS BIGINT) % 4 IN (1, 2) GROUP BY session HAVING CAST(session AS BIGINT) % 4 = 1 OR count(*) > 1""")
def batch_assembly(spark, sf_dir):
    """Batches by session; in some the session is missing, or one message stands for all items."""
    rows, kind = _batches(spark, sf_dir)[0], F.col("session").cast("bigint") % 4
    first = F.first("id").over(Window.partitionBy("session").orderBy("seq"))
    items = rows.select(F.col("session").alias("unit"), F.col("seq").alias("id"), F.lit("w").alias("workspace"), F.when(kind != 1, F.col("session")).alias("session"), F.when(kind == 2, first).otherwise(F.col("id")).alias("message_id"))
    whole, malformed = transcript.assembled(items)
    whole = whole.select("unit", F.array_join("message_ids", ",").alias("message_ids"), F.lit(None).cast("string").alias("problem"))
    return whole.unionByName(malformed.select("unit", F.lit(None).cast("string").alias("message_ids"), "problem"))


@query(f"""{_BATCHES}, places AS (SELECT session, id, seq, row_number() OVER (PARTITION BY session ORDER BY seq) AS place FROM batch), facts AS (SELECT a.id, a.session, a.id AS s1, b.id AS s2 FROM places a LEFT JOIN places b ON a.session = b.session AND b.place = a.place - 1)
SELECT id AS fact_id, session AS unit, CASE WHEN s2 IS NULL THEN s1 ELSE s2 || ',' || s1 END AS source_ids FROM facts WHERE s2 IS NOT NULL OR CAST(session AS BIGINT) % 2 = 0""")
def facts_validated(spark, sf_dir):
    """A fact for each message and the one before; where there is none, odd sessions' facts name one that isn't a target."""
    rows = _batches(spark, sf_dir)[0]
    order = Window.partitionBy("session").orderBy("seq")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("id").over(order))
    odd = F.when(F.col("session").cast("bigint") % 2 == 1, "nobody")
    sources = F.filter(F.array("id", F.coalesce("before", odd), "id"), lambda x: x.isNotNull())
    facts = rows.select(F.col("id").alias("fact_id"), F.col("session").alias("unit"), F.lit("a fact").alias("content"), sources.alias("source_ids"))
    found = transcript.valid_facts(facts, rows.select(F.col("session").alias("unit"), "id", "place"))
    return found.select("fact_id", "unit", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"{_BATCHES} SELECT id AS fact_id, session AS unit, content, id AS source FROM batch")
def facts_echoed(spark, sf_dir):
    rows = _batches(spark, sf_dir)[0].select("id", F.col("session").alias("unit"), "content")
    return transcript.echo_facts(rows).select("fact_id", "unit", "content", F.col("source_ids")[0].alias("source"))


@query()
def message_tokens(spark, sf_dir):
    """Tokens of every message by a public vocabulary."""
    rows = V.messages(spark, sf_dir)
    return rows.select("id", token_counter()(F.col("content")).alias("tokens"))


# Memberships, grants, state by key.

_PEOPLE = """people AS (SELECT CAST(l_orderkey AS VARCHAR) AS session, CAST(l_suppkey AS VARCHAR) AS peer, bool_or(l_linenumber = 1) AS me, CASE WHEN bool_and(l_returnflag = 'R') THEN TIMESTAMP '2024-05-30' END AS left_at FROM lineitem GROUP BY ALL)"""


def _people(spark, sf_dir):
    rows = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("session"), F.col("l_suppkey").cast("string").alias("peer"))
    day = lambda x: F.to_timestamp_ntz(F.lit(x))
    out = rows.agg(F.bool_or(F.col("l_linenumber") == 1).alias("observe_me"), F.when(F.bool_and(F.col("l_returnflag") == "R"), day("2024-05-30 00:00:00")).alias("left_at"))
    return out.select(F.lit("w").alias("workspace"), "session", "peer", "observe_me", F.lit(True).alias("observe_others"), day("2024-05-01 00:00:00").alias("joined_at"), "left_at")


def _asked(spark, sf_dir):
    """Supplier 3 is asked into the sessions of every order."""
    rows = V.table(spark, sf_dir, "orders").select(F.lit("w").alias("workspace"), F.col("o_orderkey").cast("string").alias("session"), F.lit("3").alias("peer"))
    return rows.withColumns({"observe_me": F.lit(False), "observe_others": F.lit(None).cast("boolean")})


_ASKED = f"""WITH {_PEOPLE}, asked AS (SELECT CAST(o_orderkey AS VARCHAR) AS session, '3' AS peer FROM orders), joined AS (SELECT coalesce(p.session, a.session) AS session, coalesce(p.peer, a.peer) AS peer, p.session IS NOT NULL AS had, a.session IS NOT NULL AS asked, me, left_at FROM people p FULL JOIN asked a ON p.session = a.session AND p.peer = a.peer)"""


def _membership(frame):
    return frame.select("session", "peer", "observe_me", "joined_at", "left_at")


_ADDED = f"""SELECT session, peer, CASE WHEN asked AND (NOT had OR left_at IS NOT NULL) THEN false ELSE me END AS observe_me, CASE WHEN asked AND (NOT had OR left_at IS NOT NULL) THEN {NOW} ELSE TIMESTAMP '2024-05-01' END AS joined_at"""


@query(f"{_ASKED} {_ADDED}, CASE WHEN asked THEN NULL ELSE left_at END AS left_at FROM joined")
def members_added(spark, sf_dir):
    return _membership(members.add_peers(_people(spark, sf_dir), _asked(spark, sf_dir), V.NOW))


@query(f"{_ASKED} {_ADDED}, CASE WHEN asked THEN NULL WHEN session IN (SELECT session FROM asked) AND left_at IS NULL THEN {NOW} ELSE left_at END AS left_at FROM joined")
def members_set(spark, sf_dir):
    return _membership(members.set_peers(_people(spark, sf_dir), _asked(spark, sf_dir), V.NOW))


@query(f"WITH {_PEOPLE} SELECT session, peer, me AS observe_me, TIMESTAMP '2024-05-01' AS joined_at, CASE WHEN peer = '3' AND left_at IS NULL THEN {NOW} ELSE left_at END AS left_at FROM people")
def members_removed(spark, sf_dir):
    return _membership(members.remove_peers(_people(spark, sf_dir), _asked(spark, sf_dir), V.NOW))


@query(f"WITH {_PEOPLE} SELECT session, me AS observe_me FROM people WHERE peer = '3' AND left_at IS NULL")
def member_configuration(spark, sf_dir):
    return members.configuration(_people(spark, sf_dir), _asked(spark, sf_dir)).select("session", "observe_me")


@query(f"WITH {_PEOPLE} SELECT session, peer, CASE WHEN peer = '3' AND left_at IS NULL THEN false ELSE me END AS observe_me, true AS observe_others FROM people")
def members_configured(spark, sf_dir):
    return members.configure(_people(spark, sf_dir), _asked(spark, sf_dir)).select("session", "peer", "observe_me", "observe_others")


@query(f"{_ASKED} SELECT session, peer, coalesce(CAST(CASE WHEN had THEN me END AS VARCHAR), '-') AS observe_me, CASE WHEN asked AND (NOT had OR left_at IS NOT NULL) THEN {NOW} ELSE TIMESTAMP '2024-05-01' END AS joined_at, CASE WHEN asked THEN NULL ELSE left_at END AS left_at FROM joined")
def senders_joined(spark, sf_dir):
    """Members after supplier 3 has said something in the sessions of every order."""
    rows = _membership(members.appended(_people(spark, sf_dir), _asked(spark, sf_dir), V.NOW))
    return rows.withColumn("observe_me", F.coalesce(F.col("observe_me").cast("string"), F.lit("-")))


_GRANTS = "g AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS principal, CASE WHEN c_custkey % 9 > 0 THEN c_mktsegment END AS workspace, CASE WHEN c_custkey % 2 = 0 THEN 'admin' ELSE 'workspace' END AS role FROM customer)"


def _grants(spark, sf_dir):
    rows, key = V.table(spark, sf_dir, "customer"), F.col("c_custkey")
    return rows.select(F.col("c_nationkey").cast("string").alias("principal"), F.when(key % 9 > 0, F.col("c_mktsegment")).alias("workspace"), F.when(key % 2 == 0, "admin").otherwise("workspace").alias("role")).distinct()


def _more_grants(spark, sf_dir):
    rows = V.table(spark, sf_dir, "nation")
    return rows.select(F.col("n_nationkey").cast("string").alias("principal"), F.when(F.col("n_regionkey") > 0, "BUILDING").alias("workspace"), F.lit("admin").alias("role"))


_MORE = "more AS (SELECT CAST(n_nationkey AS VARCHAR) AS principal, CASE WHEN n_regionkey > 0 THEN 'BUILDING' END AS workspace, 'admin' AS role FROM nation)"


@query(f"WITH {_GRANTS} SELECT principal, bool_or(workspace IS NULL) AS every, coalesce(string_agg(workspace, ',' ORDER BY workspace), '') AS workspaces FROM g WHERE role = 'workspace' GROUP BY principal")
def grants_resolved(spark, sf_dir):
    return represent.allowed_workspaces(_grants(spark, sf_dir)).select("principal", "every", F.array_join("workspaces", ",").alias("workspaces"))


@query(f"WITH {_GRANTS}, {_MORE} SELECT * FROM more EXCEPT SELECT * FROM g")
def grants_missing(spark, sf_dir):
    return members.missing_grants(_grants(spark, sf_dir), _more_grants(spark, sf_dir))


@query(f"WITH {_GRANTS}, {_MORE} SELECT * FROM g EXCEPT SELECT * FROM more")
def grants_removed(spark, sf_dir):
    return members.without_grants(_grants(spark, sf_dir), _more_grants(spark, sf_dir))


@query(f"WITH {_GRANTS} SELECT * FROM g WHERE principal = '7'")
def grants_listed(spark, sf_dir):
    return members.grants_of(_grants(spark, sf_dir), "7")


@query("""WITH asked AS (SELECT o_custkey AS name, o_orderkey AS position, o_orderpriority AS metadata FROM orders), new AS (SELECT name, arg_min(metadata, position) AS metadata FROM asked GROUP BY name)
SELECT c_custkey AS name, c_mktsegment AS metadata FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT * FROM new WHERE name NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)""")
def created_or_there(spark, sf_dir):
    """Get-or-create: every second customer is there, orders ask for theirs."""
    there = V.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("metadata"))
    asked = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderpriority").alias("metadata"), F.col("o_orderkey").alias("position"))
    return log.create_missing(there, asked, ["name"])


@query("""SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'view') AS metadata, arg_max(value, event_id) FILTER (value > 50) AS configuration FROM events GROUP BY user_id""")
def metadata_updated(spark, sf_dir):
    """The last metadata and configuration of each user; an update without one leaves it."""
    rows = V.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("metadata"), F.when(F.col("value") > 50, F.col("value")).alias("configuration"))
    return log.latest_values(rows, ["user_id"], "event_id", ["metadata", "configuration"])


_CARDS = "cards AS (SELECT source AS collection, arg_max(text, doc_id) AS card FROM documents WHERE source IS NOT NULL GROUP BY source)"


def _cards(spark, sf_dir):
    rows = V.table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("collection"), F.array("text").alias("entries"), F.col("doc_id").alias("updated"))
    return log.latest(rows, ["collection"], ["updated"])


@query(f"WITH {_CARDS} SELECT collection, sha256(card) AS card FROM cards")
def peer_cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("collection", F.sha2(F.col("entries")[0], 256).alias("card"))


@query(rf"""WITH {V.TEXT_CONCLUSIONS}, {_CARDS}, top AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY created_at DESC, id DESC) AS place FROM text_conclusions WHERE level = 0),
lines AS (SELECT collection, '## Explicit' || chr(10) || chr(10) || string_agg('- ' || regexp_replace(content, '\r\n|[\r\n\f\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g') || chr(10), '' ORDER BY created_at, id) AS representation FROM top WHERE place <= 5 GROUP BY collection)
SELECT l.collection, sha256(representation) AS digest, sha256(card) AS card FROM lines l LEFT JOIN cards c ON l.collection = c.collection""")
def peer_contexts(spark, sf_dir):
    rows = V.text_conclusions(spark, sf_dir).where("level = 0")
    texts = represent.render(represent.branches(rows, 5, frequent=False, keys=("collection",)), ("Explicit",), ("collection",))
    out = represent.peer_context(texts, _cards(spark, sf_dir), ["collection"])
    return out.select("collection", F.sha2("representation", 256).alias("digest"), F.sha2(F.col("card")[0], 256).alias("card"))


@query("""WITH links AS (SELECT doc_id AS id, unnest([doc_id + 1, doc_id - 2, doc_id + 5]) AS source_id, unnest([1, 2, 3]) AS place FROM documents), kept AS (SELECT l.* FROM links l JOIN documents d ON d.doc_id = l.source_id)
SELECT d.doc_id AS id, coalesce(string_agg(source_id, ',' ORDER BY place), '') AS source_ids FROM documents d LEFT JOIN kept k ON k.id = d.doc_id GROUP BY d.doc_id""")
def sources_resolved(spark, sf_dir):
    known = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    rows = known.select("id", F.array(F.col("id") + 1, F.col("id") - 2, F.col("id") + 5).cast("array<string>").alias("source_ids"))
    return represent.resolved_sources(rows, known.select(F.col("id").cast("string").alias("id"))).select("id", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"WITH {V.TEXT_CONCLUSIONS}, changes AS (SELECT doc_id * 2 AS id FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT doc_id FROM documents WHERE doc_id % 5 = 0) SELECT t.id, times_derived + (SELECT count(*) FROM changes c WHERE c.id = t.id) AS times_derived FROM text_conclusions t")
def times_derived_after(spark, sf_dir):
    rows = V.text_conclusions(spark, sf_dir)
    kinds = rows.select((F.col("id") * 2).alias("id"), F.when(F.col("id") % 3 == 0, "insert").when(F.col("id") % 3 == 1, "replace").otherwise("corroborate").alias("outcome"))
    more = rows.where("id % 5 = 0").select("id", F.lit("corroborate").alias("outcome"))
    return dedup.times_derived(rows, kinds.unionByName(more)).select("id", F.col("times_derived").cast("bigint").alias("times_derived"))


_VECTORS = "v AS (SELECT vec_id AS id, CAST(label AS INTEGER) % 3 AS level, vec_id // 10 AS created_at, vec_id % 7 AS times_derived, embedding::DOUBLE[] AS e FROM embeddings)"
_ASKED_VECTOR = [round(0.02 * ((i * 29) % 64 - 31.5), 4) for i in range(64)]


@query(f"""WITH {_VECTORS}, near AS (SELECT *, row_number() OVER (ORDER BY 1 - list_cosine_similarity(e, [{', '.join(map(str, _ASKED_VECTOR))}]::DOUBLE[]), created_at, id) AS place FROM v),
ranked AS (SELECT id, 0 AS rank, place FROM near WHERE place <= 6
  UNION ALL SELECT id, 1, row_number() OVER (ORDER BY times_derived DESC, created_at DESC, id DESC) AS place FROM v QUALIFY place <= 9
  UNION ALL SELECT id, 2, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM v QUALIFY place <= 9),
once AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY id ORDER BY rank, place) = 1)
SELECT id, rank, place FROM once QUALIFY row_number() OVER (ORDER BY rank, place, id) <= 9""")
def representation_with_search(spark, sf_dir):
    """The six conclusions nearest to a question, then the most derived, then the newest."""
    rows = V.vector_conclusions(spark, sf_dir).withColumns({"times_derived": F.col("id") % 7})
    order = Window.orderBy("distance", "created_at", "id")  # of six rows
    found = search.search(rows, _ASKED_VECTOR, 6).select("id", F.row_number().over(order).alias("place"))
    return represent.branches(rows, 9, search=found).select("id", "rank", "place")


# Functions over whole tables.


@query(rf"""WITH {V.MESSAGES}, w AS (SELECT id, content, lag(content) OVER (PARTITION BY session ORDER BY seq) AS before FROM messages),
s AS (SELECT *, list_distinct([upper(x) FOR x IN regexp_extract_all(content, '[\p{{L}}\p{{N}}]+')]) AS a, list_distinct([upper(x) FOR x IN regexp_extract_all(before, '[\p{{L}}\p{{N}}]+')]) AS b FROM w WHERE before IS NOT NULL)
SELECT id, length(content) > length(before) AND list_has_all(a, b) AS richer, len(a) AS n_words FROM s""")
def richer_than_before(spark, sf_dir):
    before = F.lag("content").over(Window.partitionBy("session").orderBy("seq"))
    rows = V.messages(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL")
    return rows.select("id", X.is_richer(F.col("content"), F.col("before"), F.length).alias("richer"), F.size(X.words(F.col("content"))).cast("bigint").alias("n_words"))


@query("SELECT c_custkey AS id, regexp_full_match(c_name, '[A-Za-z0-9_-]{1,512}') AS named, regexp_full_match(replace(c_name, '#', '-'), '[A-Za-z0-9_-]{1,512}') AS plain, length(c_name) <= 17 AS short FROM customer")
def ids_validated(spark, sf_dir):
    name = F.col("c_name")
    return V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), K.valid_id(name).alias("named"), K.valid_id(F.replace(name, F.lit("#"), F.lit("-"))).alias("plain"), K.valid_content(name, 17).alias("short"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN '9999-12-31 23:59:59.999999' WHEN event_id % 3 = 1 THEN '0001-01-01 00:00:00.000000' ELSE strftime(ts + to_seconds(event_id), '%Y-%m-%d %H:%M:%S.%f') END AS at FROM events""")
def clamped_times(spark, sf_dir):
    rows, key = V.table(spark, sf_dir, "events"), F.col("event_id")
    far = F.lit(9 * 10**18)
    at = K.clamped_add(F.col("ts"), F.when(key % 3 == 0, far).when(key % 3 == 1, -far).otherwise(key * 1_000_000))
    return rows.select(key.alias("id"), F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))


@query("SELECT c_custkey AS id, 'Dear {{' || c_name || '}}, about ' || c_mktsegment || ' and {{c_name}} {{' || c_mktsegment || '.' AS prompt FROM customer")
def prompts_rendered(spark, sf_dir):
    rows = V.table(spark, sf_dir, "customer")
    values = {"name": F.concat(F.lit("{{"), "c_name", F.lit("}}")), "about": F.concat("c_mktsegment", F.lit(" and {{c_name}}")), "again": F.concat(F.lit("{{"), "c_mktsegment")}
    return rows.select(F.col("c_custkey").alias("id"), K.rendered("Dear {{name}}, about {{about}} {{again}}.", values).alias("prompt"))


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '-' END AS flag FROM events")
def flags_read(spark, sf_dir):
    key = F.col("event_id")
    raw = F.when(key % 4 == 0, '{"observe_me": true, "k": 1}').when(key % 4 == 1, '{"observe_me": false}').when(key % 4 == 2, '{"observe_me": "true"}').otherwise('{"k": 1}')
    return V.table(spark, sf_dir, "events").select(key.alias("id"), F.coalesce(K.json_flag(raw, "observe_me").cast("string"), F.lit("-")).alias("flag"))


@query(f"WITH {V.MESSAGES} SELECT id, trim(regexp_replace(nfc_normalize(content || ' e' || chr(769)), '\\s+', ' ', 'g')) AS content FROM messages")
def normalized_text(spark, sf_dir):
    return V.messages(spark, sf_dir).select("id", X.normalize(F.concat("content", F.lit(" e\u0301"))).alias("content"))
