import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
import pytest  # noqa: E402
from helpers import ROWS, write_documents  # noqa: E402


@pytest.fixture(scope="session")
def odd(tmp_path_factory):
    return write_documents(tmp_path_factory.mktemp("odd"), ROWS)


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write_documents(folder, [])
    pq.write_table(pa.table({"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}), f"{folder}/conversations.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float32())), "label": pa.array([], pa.int32())}), f"{folder}/embeddings.parquet")
    return str(folder)
