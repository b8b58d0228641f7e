"""Secret scans with corpus-wide ownership.

Candidates are found by patterns. The hash of each candidate's value is counted over the corpus by
distinct documents (repositories) and distinct sources (owners): a value in the hands of
``SHARED_OWNERS`` or more owners, or in ``SHARED_DOCUMENTS`` or more documents, is a widely copied
example; one that fewer have and that looks like a random key is taken for a live credential of its
owner. Only DataFrame functions are used; texts stay in the scan, and only candidates, as positions
and hashes, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialize, table

#: Fixed patterns of the three kinds, in the order in which kinds are listed. The last two ask for
#: their least length at once, as a run that is too short at its start is so everywhere in it.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "example", "live")
SHARED_OWNERS = 3
#: A live credential may stand in a few documents of its owner; one in so many is copied text.
SHARED_DOCUMENTS = 10
#: A live-looking value has at least so many characters, letters and digits, and no placeholder word.
LIVE_LEAST = 16
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|x{4,}|\*{3,}|0{8,}|12345678"
_SPAN = "array<struct<first:int,kind:int,last:int,start:int,value:string>>"
#: Matches that are laid out together: appending to a list copies it, so long lists are made of parts.
_PART = 512


def _matches(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """Spans (first, kind, last) of the leftmost matches that don't overlap, and the start and
    text of their value; the value stands at the match's end. Positions count code points."""
    gaps, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.slice(F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")), F.lit(1), F.size(whole))
    none = F.array().cast(_SPAN)

    def step(state: Column, row: Column) -> Column:
        first = state["at"] + F.length(row["gap"])
        last = first + F.length(row["whole"])
        span = F.struct(first.alias("first"), F.lit(kind).alias("kind"), last.alias("last"), (last - F.length(row["value"])).alias("start"), row["value"].alias("value"))
        return F.struct(last.alias("at"), F.when(F.length(row["value"]) >= least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    def part(state: Column, rows: Column) -> Column:
        own = F.aggregate(rows, F.struct(state["at"].alias("at"), none.alias("spans")), step)
        return F.struct(own["at"].alias("at"), F.concat(state["spans"], own["spans"]).alias("spans"))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / _PART).cast("int")), lambda k: F.slice(rows, k * _PART + 1, F.lit(_PART)))
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("spans")), part)["spans"]
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """All candidates of a text, by start and then kind."""
    return F.array_sort(F.concat(_matches(text, ASSIGN, 0, 2, ASSIGN_LEAST), _matches(text, ACCESS, 1, 0, 1), _matches(text, HEX, 2, 0, 1)))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["first"].cast("string"), x["last"].cast("string"))), ",")


def scan(docs: DataFrame, shared_owners: int = SHARED_OWNERS, shared_documents: int = SHARED_DOCUMENTS) -> DataFrame:
    """(doc_id, base, added) for every row of docs (doc_id, source, text): arrays of spans.

    ``added`` has a span over a candidate's value: ``example`` where ``shared_owners`` or more
    sources or ``shared_documents`` or more distinct doc_ids have the value, ``live`` where fewer do
    and it looks like a key; a value found by two patterns is added once. A
    null text is empty and has no spans; a null source is an owner and a null doc_id a repository
    like any other. Repeated rows are scanned one by one and count as one repository."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    slim = F.transform(base_spans(F.col("text")), lambda x: F.struct(x["first"], x["kind"], x["last"], x["start"], F.sha2(x["value"], 256).alias("digest"), _live_looking(x["value"]).alias("live")))
    found = materialize(rows.select("row", "doc_id", "owner", slim.alias("base")), "candidates")
    each = found.where(F.size("base") > 0).select("row", "doc_id", "owner", F.explode("base").alias("x"))
    each = each.select("row", "doc_id", "owner", "x.start", "x.last", "x.digest", "x.live")
    counted = lambda key, name: each.groupBy("digest", key).agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("one").alias(name))
    # written, so that the join reads counts and a value that very many documents hold can be split
    owned = materialize(counted("owner", "owners").join(counted("doc_id", "repositories"), "digest"), "owned")
    shared = (F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_documents)
    kinds = each.join(owned, "digest").withColumn("kind", F.when(shared, 3).when(F.col("live"), 4)).where("kind IS NOT NULL")
    spans = kinds.groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("start").alias("first"), F.col("kind").cast("int").alias("kind"), F.col("last").alias("last")))).alias("added"))
    base = F.transform("base", lambda x: F.struct(x["first"].alias("first"), x["kind"].alias("kind"), x["last"].alias("last"))).alias("base")
    none = F.array().cast("array<struct<first:int,kind:int,last:int>>")
    some = found.where(F.size("base") > 0).join(spans.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    some = some.select("doc_id", base, F.coalesce("added", none).alias("added"))
    return found.where(F.size("base") == 0).select("doc_id", base, none.alias("added")).unionByName(some)


def _live_looking(value: Column) -> Column:
    return (F.length(value) >= LIVE_LEAST) & F.regexp_like(value, F.lit("[A-Za-z]")) & F.regexp_like(value, F.lit("[0-9]")) & ~F.regexp_like(value, F.lit(PLACEHOLDER))


def _listed(out: DataFrame) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    text = _joined(F.array_sort(F.concat("base", "added")))
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), text.alias("spans"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() over all documents."""
    return _listed(scan(table(spark, sf_dir, "documents", "doc_id", "source", "text")))


def _sql_spans(kind: str, order: int, pattern: str, group: int, least: int) -> str:
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, owner, {order} AS k, '{kind}' AS kind, value,
    sum(length(gap) + length(coalesce(whole, ''))) OVER (PARTITION BY doc_id ORDER BY i) AS last, whole
  FROM (SELECT doc_id, owner, unnest(range(len(gaps))) AS i, unnest(gaps) AS gap, unnest(list_concat(wholes, [NULL])) AS whole, unnest(list_concat(vals, [NULL])) AS value
    FROM (SELECT doc_id, owner, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS wholes, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM d))
  QUALIFY whole IS NOT NULL AND length(value) >= {least}"""


OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_sql_spans(*x) for x in (("assign", 0, ASSIGN, 2, ASSIGN_LEAST), ("access", 1, ACCESS, 0, 1), ("hex", 2, HEX, 0, 1)))}),
base AS (SELECT doc_id, owner, k, kind, last - length(whole) AS first, last, last - length(value) AS start, value FROM found),
owned AS (SELECT value, count(DISTINCT owner) >= {SHARED_OWNERS} OR count(DISTINCT coalesce(CAST(doc_id AS VARCHAR), '')) >= {SHARED_DOCUMENTS} AS shared FROM base GROUP BY value),
extra AS (SELECT DISTINCT doc_id, CASE WHEN shared THEN 3 ELSE 4 END AS k, CASE WHEN shared THEN 'example' ELSE 'live' END AS kind, start AS first, last FROM base JOIN owned USING (value)
  WHERE shared OR (length(value) >= {LIVE_LEAST} AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]') AND NOT regexp_matches(value, '{PLACEHOLDER}'))),
every AS (SELECT doc_id, k, kind, first, last FROM base UNION ALL SELECT doc_id, k, kind, first, last FROM extra),
lists AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(concat_ws(':', kind, first, last), ',' ORDER BY first, k) FILTER (k < 3) AS base, string_agg(concat_ws(':', kind, first, last), ',' ORDER BY first, k, last) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN lists USING (doc_id)
"""
