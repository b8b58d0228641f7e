"""What counts over the whole corpus, on small tables made for it."""

import duckdb
from helpers import write_documents

from palimpsest.llm.queries import QUERIES, SQL


def test_values_in_many_documents_are_examples(spark, tmp_path):
    key = lambda i: f'api_key="AbC123dEf456GhI789jK{i}"'
    rows = [(i, key(0), "en", f"s{i % 2}") for i in range(12)] + [(100 + i, key(1), "en", "s0") for i in range(9)] + [(200 + i, key(2), "en", f"s{i}") for i in range(3)]
    rows += [(300, key(3), "en", "s0")] * 12 + [(400 + i % 9, key(4), "en", f"s{i % 2}") for i in range(18)]
    folder = write_documents(tmp_path, rows)
    got = QUERIES["op9_secret_scan"](spark, folder).toPandas()
    last = lambda spans: spans.split(",")[-1].split(":")[0]
    assert {d // 100: {last(s) for s in got["spans"][got["doc_id"] // 100 == d // 100]} for d in got["doc_id"]} == {0: {"example"}, 1: {"live"}, 2: {"example"}, 3: {"live"}, 4: {"live"}}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT DISTINCT doc_id, source, text FROM read_parquet('{folder}/documents.parquet') WHERE doc_id < 400")
    want = duck.sql(SQL["op9_secret_scan"]).df()
    kept = got[got["doc_id"] < 400].drop_duplicates()
    assert sorted(map(tuple, kept[sorted(kept)].astype(str).to_numpy().tolist())) == sorted(map(tuple, want[sorted(kept)].astype(str).to_numpy().tolist()))
